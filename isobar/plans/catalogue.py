"""The queries of this library and the SQL that they must agree with."""

from __future__ import annotations

from . import inference, models, more, programs, relations, scenarios, series, standard

QUERIES: dict = series.QUERIES | relations.QUERIES | scenarios.QUERIES | more.QUERIES | models.QUERIES | standard.QUERIES | inference.QUERIES | programs.QUERIES
SQL: dict = series.SQL | relations.SQL | scenarios.SQL | more.SQL | standard.SQL | inference.SQL | programs.SQL | models.SQL
