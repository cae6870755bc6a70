"""Queries on rules, audits, linkage, joins, set operations and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import linkage, metrics, quality, series
from .base import r, rounded, table


def physical_nulling(spark, sf):
    x = table(spark, sf, "lineitem")
    out = x.select("l_orderkey", "l_linenumber", c.in_range_or_null("l_quantity", 5, 45).alias("quantity"), c.in_range_or_null("l_discount", 0.01, 0.09).alias("discount"), c.in_range_or_null("l_tax", 0, 0.07).alias("tax"))
    return out.withColumn("complete", c.complete("quantity", "discount", "tax"))


def _rules():
    return [
        quality.Rule("price", F.col("l_extendedprice") > 90000), quality.Rule("quantity", F.col("l_quantity") < 3),
        quality.Rule("discount", ~c.within("l_discount", 0.0, 0.09)), quality.Rule("unit_price", F.col("l_extendedprice") / F.col("l_quantity") > 2000),
        quality.Rule("high_tax", F.col("l_tax") > 0.07, "review"), quality.Rule("returned", F.col("l_returnflag") == "R", "review"),
    ]


def rule_cascade(spark, sf):
    return quality.cascade_audit(table(spark, sf, "lineitem"), _rules())


def rule_outcomes(spark, sf):
    j = quality.judged(table(spark, sf, "lineitem"), _rules())
    return j.groupBy(F.coalesce("first_failed_rule", F.lit("kept")).alias("outcome"), "review").agg(F.count("*").alias("n"))


def regimes(spark, sf):
    q = F.col("l_quantity")
    flags = [c.within("l_quantity", 2, 48).cast("int"), c.within("l_discount", 0.0, 0.08).cast("int")]
    regime = c.first_of([("fast", q > 30), ("slow", q.between(5, 30)), ("still", q < 5)])
    x = table(spark, sf, "lineitem").withColumns({"regime": regime, "all_pass": F.least(*flags), "hard": (q.isNotNull() & ~q.between(2, 48)).cast("int")})
    return x.groupBy("regime").agg(F.count("*").alias("n"), F.sum("all_pass").alias("passing"), F.sum("hard").alias("hard_outliers"), F.min("all_pass").alias("worst"))


def power_bound(spark, sf):
    """An upper bound by capacity: kW times specific use, per row."""
    x = table(spark, sf, "part").withColumn("bound", F.col("p_size") * 1000.0 * 250 / 6e6)
    use = F.col("p_retailprice") / 1000
    return x.select("p_partkey", r("bound").alias("bound"), (use > F.col("bound")).alias("beyond"), c.first_of([("delete", use > 1.2 * F.col("bound")), ("review", use > 1.05 * F.col("bound"))], "keep").alias("band"))


def mad_low_flag(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("bin", F.floor(F.col("l_quantity") / 5).cast("long"))
    f = quality.mad_flags(x, ["l_returnflag", "l_linestatus", "bin"], "l_extendedprice", 1.2, 50)
    return f.groupBy("l_returnflag", "l_linestatus", "bin").agg(F.count("*").alias("n"), r(F.first("group_median"), 3).alias("median"), r(F.first("group_mad"), 3).alias("mad"), F.sum(F.col("low").cast("long")).alias("low"))


def speed_review(spark, sf):
    x = table(spark, sf, "lineitem")
    f = x.join(quality.upper_fences(x, ["l_suppkey"], "l_extendedprice", 0.95, 0.2), "l_suppkey")
    over = (F.col("l_extendedprice") > F.col("high_quantile")) & (F.col("l_extendedprice") > F.col("iqr_fence"))
    return f.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(over.cast("long")).alias("flagged"), r(F.max("iqr_fence"), 2).alias("fence"))


def threshold_sensitivity(spark, sf):
    t = quality.threshold_counts(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", [10.0, 25.0, 40.0])
    return t.select("l_returnflag", "rows", "level", "above", r("share").alias("share"))


def descriptive_stats(spark, sf):
    x = table(spark, sf, "lineitem").withColumns({"quantity": F.when(F.col("l_quantity") > 2, F.col("l_quantity")), "price": F.col("l_extendedprice") / 1000})
    p = quality.profile(x, ["l_returnflag"], ["quantity", "price"])
    return p.select("l_returnflag", "variable", "rows", *[r(k).alias(k) for k in ("missing_share", "mean", "std", "q05", "median", "q95")])


def unit_detection(spark, sf):
    """By the median of a column, and row by row by ranges."""
    x = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    middle = series.quantiles(x, ["o_orderstatus"], "o_totalprice", [0.5]).select("o_orderstatus", F.col("q0").alias("m"))
    by_group = x.join(middle, "o_orderstatus").withColumn("kilo", F.when(F.col("m") > 100000, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice")))
    return by_group.select("o_orderkey", r("kilo").alias("by_group"), r(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice"))).alias("by_row"))


def numeric_parse(spark, sf):
    t = F.concat(F.format_string("%,d", F.col("o_orderkey") * 1234), F.when(F.col("o_orderkey") % 7 == 0, " m").when(F.col("o_orderkey") % 11 == 0, "x-").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", c.parse_number(t).alias("number"), c.blank_to_null(F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderstatus"))).alias("status"))


def one_hot(spark, sf):
    x = table(spark, sf, "customer")
    return x.select("c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(s.lower()) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE")])


def provenance(spark, sf):
    v, s = c.coalesced([("high", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice"))), ("even", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 2)), ("default", F.lit(1.0))])
    return table(spark, sf, "orders").groupBy(s.alias("source")).agg(F.count("*").alias("n"), r(F.sum(v), 3).alias("total"))


def fingerprints(spark, sf):
    parts = [F.format_string("%d", F.col("p_size").cast("long")), F.col("p_brand"), F.format_string("%d", F.round(F.col("p_retailprice")).cast("long"))]
    f = F.concat(F.lit("F"), F.upper(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 14)))
    known = F.col("p_size").isNotNull().cast("int") + F.col("p_brand").isNotNull().cast("int") + (F.col("p_size") > 10).cast("int")
    return table(spark, sf, "part").select("p_partkey", f.alias("fingerprint"), r(known / 3).alias("completeness"))


def confidence_grades(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("share"))
    return x.select("l_suppkey", "n", r("share").alias("share"), c.first_of([("high", (F.col("share") >= 0.35) & (F.col("n") >= 500)), ("medium", F.col("share") >= 0.33)], "low").alias("grade"))


def _two_sides(spark, sf):
    o = table(spark, sf, "orders")
    left = o.select(F.col("o_orderkey").alias("l_id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("price"))
    right = o.filter("o_orderkey % 13 > 0").select(
        (F.col("o_orderkey") + 1_000_000).alias("r_id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day"),
        (F.round("o_totalprice").cast("long") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("price"))
    return left, right


def tiered_linkage(spark, sf):
    left, right = _two_sides(spark, sf)
    pairs = linkage.tiered(left, right, [("strong", ["cust", "day", "price"], "kth"), ("medium", ["cust", "day"], "kth"), ("weak", ["day"], "unique")], "l_id", "r_id")
    return pairs.groupBy("tier").agg(F.count("*").alias("pairs"), F.sum((F.col("r_id") - F.col("l_id") == 1_000_000).cast("long")).alias("true_pairs"), F.countDistinct("r_id").alias("right_ids"))


def link_proof(spark, sf):
    left, right = _two_sides(spark, sf)
    return linkage.proves_one_to_one(linkage.kth_match(left, right, ["cust", "day"], "l_id", "r_id"), "l_id", "r_id")


def unique_key_match(spark, sf):
    left, right = _two_sides(spark, sf)
    return linkage.unique_match(left, right, ["cust", "day"], "l_id", "r_id")


def table_diff(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderkey % 17 > 0").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    b = table(spark, sf, "orders").filter("o_orderkey % 19 > 0").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1.001).otherwise(1.0)).alias("o_totalprice"), F.when(F.col("o_orderkey") % 23 > 0, F.col("o_custkey").cast("double")).alias("cust"))
    return linkage.table_diff(a, b, ["o_orderkey"], ["o_totalprice", "cust"], 1e-6, 1e-6)


def outer_indicator(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    b = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 100).alias("c_custkey")).agg(F.count("*").alias("orders"))
    return linkage.outer_with_side(a, b, ["c_custkey"]).groupBy("side").agg(F.count("*").alias("n"), F.sum("orders").alias("orders"), r(F.sum("c_acctbal"), 2).alias("balance"))


def overlay(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = base.filter("c_custkey % 4 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"))
    return linkage.overlay(base, patch, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_mktsegment", r("c_acctbal", 2).alias("c_acctbal"), "overlaid")


def semi_anti(spark, sf):
    o, x = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_quantity > 49")
    hit = o.join(x, o.o_orderkey == x.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("with_large"))
    miss = o.join(x, o.o_orderkey == x.l_orderkey, "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("without"))
    return hit.join(miss, "o_orderpriority")


def side_condition_join(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    j = s.join(F.broadcast(n), (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 0), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("none")).alias("nation")).agg(F.count("*").alias("n"))


def duplicate_keys(spark, sf):
    k = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("copies"))
    return k.groupBy("copies").agg(F.count("*").alias("keys"))


def null_safe_difference(spark, sf):
    a = table(spark, sf, "orders").withColumns({"x": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")), "y": F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey"))})
    return a.groupBy(F.col("x").eqNullSafe(F.col("y")).alias("same")).agg(F.count("*").alias("n"))


def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("nation", F.coalesce("segment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def entity_sets(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("set"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.distinct().exceptAll(b.distinct()), "left")).unionByName(count(a.union(b).distinct(), "any"))


def jaccard_topk(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    top = lambda k: x.orderBy(F.desc(k), "l_partkey").limit(200).agg(F.collect_list("l_partkey").alias(k))
    both = top("q").join(F.broadcast(top("p")))
    return both.select(F.size(F.array_intersect("q", "p")).cast("long").alias("shared"), r(F.size(F.array_intersect("q", "p")) / F.size(F.array_union("q", "p"))).alias("jaccard"))


def _sales(spark, sf):
    x, o, cu, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = x.join(o, x.l_orderkey == o.o_orderkey).join(cu, o.o_custkey == cu.c_custkey).join(F.broadcast(n), cu.c_nationkey == n.n_nationkey)
    return j.withColumns({"y": F.col("l_extendedprice") / 1000, "p": F.col("l_quantity") * 1.4})


def flagship_revenue(spark, sf):
    return _sales(spark, sf).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


def grouping_scopes(spark, sf):
    s = metrics.scopes(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", [F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean")])
    return s.select("l_returnflag", "l_linestatus", "level", "n", "mean")


def balanced_mean(spark, sf):
    m = metrics.balanced_mean(_sales(spark, sf), ["c_mktsegment"], "n_name", "y")
    return m.select("c_mktsegment", "entities", r("balanced_mean").alias("balanced_mean"), r("pooled_mean").alias("pooled_mean"))


def intensity_by_entity(spark, sf):
    i = metrics.intensity(_sales(spark, sf), ["n_name"], "y", "o_totalprice", "l_quantity", 3.114e6)
    return i.select("n_name", r("consumed", 4).alias("consumed"), r("capacity", 3).alias("capacity"), r("intensity").alias("intensity"))


def regression_metrics(spark, sf):
    m = metrics.by_metrics(_sales(spark, sf), ["c_mktsegment"], "y", "p")
    return m.select("c_mktsegment", "n", *[r(k).alias(k) for k in ("mse", "rmse", "mae", "bias", "mape", "smape", "r2", "nrmse")])


def within_bands(spark, sf):
    s = _sales(spark, sf).withColumn("d", F.col("p") - F.col("y"))
    return metrics.within_bands(s, ["c_mktsegment"], "n_name", "d", [1.0, 10.0]).select("c_mktsegment", "band", *[r(k).alias(k) for k in ("above", "below", "near")])


def pivot_status(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(k, F.lit(0)).alias(f"n_{k.lower()}") for k in "FOP"])


def static_mode(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("mode")
    return o.groupBy("o_custkey").agg(best, (F.count("*") > 1).alias("conflict"))


def filtered_aggregates(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.groupBy("l_suppkey").agg(F.expr("count(*) FILTER (WHERE l_returnflag = 'R')").alias("returned"), r(F.expr("avg(l_tax) FILTER (WHERE l_discount > 0.05)")).alias("tax"), F.countDistinct(F.round("l_tax", 2)).alias("taxes"), F.expr("min_by(l_partkey, struct(l_shipdate, l_orderkey, l_linenumber)) FILTER (WHERE l_quantity > 10)").alias("first_part"))


QUERIES = {f.__name__: f for f in (
    physical_nulling, rule_cascade, rule_outcomes, regimes, power_bound, mad_low_flag, speed_review, threshold_sensitivity, descriptive_stats, unit_detection,
    numeric_parse, one_hot, provenance, fingerprints, confidence_grades, tiered_linkage, link_proof, unique_key_match, table_diff, outer_indicator, overlay,
    semi_anti, side_condition_join, duplicate_keys, null_safe_difference, union_by_name, entity_sets, jaccard_topk, flagship_revenue, grouping_scopes,
    balanced_mean, intensity_by_entity, regression_metrics, within_bands, pivot_status, static_mode, filtered_aggregates,
)}

R = rounded
JUDGED = """j AS (SELECT *, CASE WHEN l_extendedprice > 90000 THEN 'price' WHEN l_quantity < 3 THEN 'quantity' WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN 'discount'
  WHEN l_extendedprice / l_quantity > 2000 THEN 'unit_price' END AS f, concat_ws(';', CASE WHEN l_tax > 0.07 THEN 'high_tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS review FROM lineitem)"""
SIDES = """l AS (SELECT o_orderkey AS l_id, o_custkey AS cust, o_orderdate AS day, round(o_totalprice)::BIGINT AS price FROM orders),
  q AS (SELECT o_orderkey + 1000000 AS r_id, o_custkey AS cust, o_orderdate AS day, round(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 13 > 0)"""


def _kth(name: str, left: str, right: str, keys: str) -> str:
    part = lambda t, i: f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {i}) AS k FROM {t})"
    return f"{name} AS (SELECT l_id, r_id FROM {part(left, 'l_id')} JOIN {part(right, 'r_id')} USING ({keys}, k))"


SALES = """s AS (SELECT *, l_extendedprice / 1000 AS y, l_quantity * 1.4::DOUBLE AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

SQL = {
    "physical_nulling": """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity, CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN l_discount END AS discount,
      CASE WHEN l_tax BETWEEN 0 AND 0.07 THEN l_tax END AS tax FROM lineitem) SELECT *, quantity IS NOT NULL AND discount IS NOT NULL AND tax IS NOT NULL AS complete FROM a""",
    "rule_cascade": f"""WITH {JUDGED}, n AS (SELECT unnest(['price', 'quantity', 'discount', 'unit_price']) AS rule, unnest([1, 2, 3, 4])::BIGINT AS step), c AS (SELECT step, rule, (SELECT count(*) FROM j WHERE f = rule) AS removed, (SELECT count(*) FROM j) AS total FROM n),
      d AS (SELECT *, sum(removed) OVER (ORDER BY step)::BIGINT AS so_far FROM c) SELECT step, rule, total - so_far + removed AS reached, removed, total - so_far AS left_over FROM d""",
    "rule_outcomes": f"WITH {JUDGED} SELECT coalesce(f, 'kept') AS outcome, review, count(*) AS n FROM j GROUP BY ALL",
    "regimes": """SELECT CASE WHEN l_quantity > 30 THEN 'fast' WHEN l_quantity BETWEEN 5 AND 30 THEN 'slow' WHEN l_quantity < 5 THEN 'still' END AS regime, count(*) AS n,
      sum(CASE WHEN l_quantity BETWEEN 2 AND 48 AND l_discount BETWEEN 0 AND 0.08 THEN 1 ELSE 0 END)::BIGINT AS passing, sum(CASE WHEN l_quantity BETWEEN 2 AND 48 THEN 0 ELSE 1 END)::BIGINT AS hard_outliers,
      min(CASE WHEN l_quantity BETWEEN 2 AND 48 AND l_discount BETWEEN 0 AND 0.08 THEN 1 ELSE 0 END)::INT AS worst FROM lineitem GROUP BY 1""",
    "power_bound": f"""WITH a AS (SELECT p_partkey, p_size * 1000.0::DOUBLE * 250 / 6e6 AS b, p_retailprice / 1000 AS u FROM part) SELECT p_partkey, {R('b')} AS bound, u > b AS beyond,
      CASE WHEN u > 1.2::DOUBLE * b THEN 'delete' WHEN u > 1.05::DOUBLE * b THEN 'review' ELSE 'keep' END AS band FROM a""",
    "mad_low_flag": f"""WITH a AS (SELECT l_returnflag, l_linestatus, floor(l_quantity / 5)::BIGINT AS bin, l_extendedprice AS v FROM lineitem), m AS (SELECT *, median(v) OVER w AS med, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, bin)),
      d AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY l_returnflag, l_linestatus, bin) AS mad FROM m)
      SELECT l_returnflag, l_linestatus, bin, count(*) AS n, {R('any_value(med)', 3)} AS median, {R('any_value(mad)', 3)} AS mad, sum(CASE WHEN n >= 50 AND v < med - 1.2::DOUBLE * mad THEN 1 ELSE 0 END)::BIGINT AS low FROM d GROUP BY ALL""",
    "speed_review": f"""WITH f AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.95) AS h, quantile_cont(l_extendedprice, 0.75) + 0.2::DOUBLE * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS e FROM lineitem GROUP BY 1)
      SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_extendedprice > h AND l_extendedprice > e THEN 1 ELSE 0 END)::BIGINT AS flagged, {R('max(e)', 2)} AS fence FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1""",
    "threshold_sensitivity": f"""SELECT l_returnflag, count(*) AS rows, level, sum(CASE WHEN l_quantity > level THEN 1 ELSE 0 END)::BIGINT AS above, {R('avg(CASE WHEN l_quantity > level THEN 1.0 ELSE 0.0 END)')} AS share
      FROM lineitem, (SELECT unnest([10.0::DOUBLE, 25, 40]) AS level) GROUP BY 1, 3""",
    "descriptive_stats": f"""WITH u AS (SELECT l_returnflag, 'quantity' AS variable, CASE WHEN l_quantity > 2 THEN l_quantity END AS v FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice / 1000 FROM lineitem)
      SELECT l_returnflag, variable, count(*) AS rows, {R('1 - count(v)::DOUBLE / count(*)')} AS missing_share, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS std, {R('quantile_cont(v, 0.05)')} AS q05, {R('median(v)')} AS median, {R('quantile_cont(v, 0.95)')} AS q95 FROM u GROUP BY 1, 2""",
    "unit_detection": f"""WITH a AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) SELECT o_orderkey, {R('CASE WHEN m > 100000 THEN o_totalprice / 1000 ELSE o_totalprice END')} AS by_group,
      {R('CASE WHEN o_totalprice > 200000 THEN o_totalprice / 1000 ELSE o_totalprice END')} AS by_row FROM a""",
    "numeric_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 1234)::DOUBLE END AS number, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders""",
    "one_hot": "SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT AS automobile, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'FURNITURE')::INT AS furniture FROM customer",
    "provenance": f"""SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'default' END AS source, count(*) AS n,
      {R("sum(CASE WHEN o_totalprice > 300000 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 ELSE 1.0 END)", 3)} AS total FROM orders GROUP BY 1""",
    "fingerprints": f"""SELECT p_partkey, 'F' || upper(substr(md5(concat_ws('|', p_size::VARCHAR, p_brand, round(p_retailprice)::BIGINT::VARCHAR)), 1, 14)) AS fingerprint, {R('(2 + (p_size > 10)::INT) / 3.0::DOUBLE')} AS completeness FROM part""",
    "confidence_grades": f"""WITH a AS (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END) AS s FROM lineitem GROUP BY 1)
      SELECT l_suppkey, n, {R('s')} AS share, CASE WHEN s >= 0.35 AND n >= 500 THEN 'high' WHEN s >= 0.33 THEN 'medium' ELSE 'low' END AS grade FROM a""",
    "tiered_linkage": f"""WITH {SIDES}, {_kth('t1', 'l', 'q', 'cust, day, price')}, l2 AS (SELECT * FROM l WHERE l_id NOT IN (SELECT l_id FROM t1)), q2 AS (SELECT * FROM q WHERE r_id NOT IN (SELECT r_id FROM t1)), {_kth('t2', 'l2', 'q2', 'cust, day')},
      l3 AS (SELECT * FROM l2 WHERE l_id NOT IN (SELECT l_id FROM t2)), q3 AS (SELECT * FROM q2 WHERE r_id NOT IN (SELECT r_id FROM t2)),
      t3 AS (SELECT l_id, r_id FROM (SELECT day, min(l_id) AS l_id FROM l3 GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT day, min(r_id) AS r_id FROM q3 GROUP BY 1 HAVING count(*) = 1) USING (day)),
      p AS (SELECT 'strong' AS tier, * FROM t1 UNION ALL SELECT 'medium', * FROM t2 UNION ALL SELECT 'weak', * FROM t3)
      SELECT tier, count(*) AS pairs, sum((r_id - l_id = 1000000)::INT)::BIGINT AS true_pairs, count(DISTINCT r_id) AS right_ids FROM p GROUP BY 1""",
    "link_proof": f"WITH {SIDES}, {_kth('t', 'l', 'q', 'cust, day')} SELECT count(*) AS pairs, count(DISTINCT l_id) AS left_ids, count(DISTINCT r_id) AS right_ids, count(*) = count(DISTINCT l_id) AND count(*) = count(DISTINCT r_id) AS one_to_one FROM t",
    "unique_key_match": f"""WITH {SIDES} SELECT l_id, r_id FROM (SELECT cust, day, min(l_id) AS l_id FROM l GROUP BY 1, 2 HAVING count(*) = 1) JOIN (SELECT cust, day, min(r_id) AS r_id FROM q GROUP BY 1, 2 HAVING count(*) = 1) USING (cust, day)""",
    "table_diff": """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_custkey::DOUBLE AS c FROM orders WHERE o_orderkey % 17 > 0),
      b AS (SELECT o_orderkey AS k, o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1.001::DOUBLE ELSE 1 END AS v, CASE WHEN o_orderkey % 23 > 0 THEN o_custkey::DOUBLE END AS c FROM orders WHERE o_orderkey % 19 > 0),
      f AS (SELECT a.k AS ak, b.k AS bk, coalesce(abs(a.v - b.v) > 1e-6 + 1e-6 * abs(b.v), (a.v IS NULL) <> (b.v IS NULL)) AS dv, coalesce(abs(a.c - b.c) > 1e-6 + 1e-6 * abs(b.c), (a.c IS NULL) <> (b.c IS NULL)) AS dc FROM a FULL JOIN b ON a.k = b.k)
      SELECT variable, (SELECT count(*) FROM f WHERE ak IS NOT NULL AND bk IS NOT NULL) AS both, (SELECT count(*) FROM f WHERE bk IS NULL) AS left_only, (SELECT count(*) FROM f WHERE ak IS NULL) AS right_only,
      (SELECT count(*) FROM f WHERE ak IS NOT NULL AND bk IS NOT NULL AND CASE WHEN variable = 'cust' THEN dc ELSE dv END) AS differing FROM (SELECT unnest(['o_totalprice', 'cust']) AS variable)""",
    "outer_indicator": f"""WITH a AS (SELECT c_custkey, c_acctbal FROM customer), b AS (SELECT o_custkey + 100 AS k, count(*) AS orders FROM orders GROUP BY 1)
      SELECT CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n, sum(orders)::BIGINT AS orders, {R('sum(c_acctbal)', 2)} AS balance FROM a FULL JOIN b ON c_custkey = k GROUP BY 1""",
    "overlay": f"SELECT c_custkey, c_mktsegment, {R('CASE WHEN c_custkey % 4 = 0 THEN -c_acctbal ELSE c_acctbal END', 2)} AS c_acctbal, c_custkey % 4 = 0 AS overlaid FROM customer",
    "semi_anti": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) AS with_large, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) AS without FROM orders GROUP BY 1""",
    "side_condition_join": "SELECT coalesce(n_name, 'none') AS nation, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1",
    "duplicate_keys": "SELECT copies, count(*) AS keys FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1",
    "null_safe_difference": "SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END IS NOT DISTINCT FROM CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS same, count(*) AS n FROM orders GROUP BY 1",
    "union_by_name": "WITH u AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier) SELECT nation, coalesce(segment, 'none') AS segment, count(*) AS n, sum(id)::BIGINT AS ids FROM u GROUP BY 1, 2",
    "entity_sets": """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
      SELECT 'both' AS set, (SELECT count(*) FROM a WHERE k IN (FROM b)) AS n UNION ALL SELECT 'left', (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) UNION ALL SELECT 'any', (SELECT count(*) FROM (FROM a UNION FROM b))""",
    "jaccard_topk": f"""WITH x AS (SELECT l_partkey AS k, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1), a AS (SELECT k FROM x ORDER BY q DESC, k LIMIT 200), b AS (SELECT k FROM x ORDER BY p DESC, k LIMIT 200), s AS (SELECT count(*) AS n FROM a JOIN b USING (k))
      SELECT n AS shared, {R('n / (400.0::DOUBLE - n)')} AS jaccard FROM s""",
    "flagship_revenue": f"WITH {SALES} SELECT n_name, c_mktsegment, count(*) AS n, {R('sum(l_extendedprice * (1 - l_discount))', 4)} AS revenue FROM s GROUP BY 1, 2",
    "grouping_scopes": f"""SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, {R('avg(l_quantity)')} AS mean
      FROM lineitem GROUP BY GROUPING SETS ((), (lineitem.l_returnflag), (lineitem.l_linestatus), (lineitem.l_returnflag, lineitem.l_linestatus))""",
    "balanced_mean": f"WITH {SALES}, e AS (SELECT c_mktsegment, n_name, avg(y) AS m, sum(y) AS t, count(y) AS n FROM s GROUP BY 1, 2) SELECT c_mktsegment, count(*) AS entities, {R('avg(m)')} AS balanced_mean, {R('sum(t) / sum(n)')} AS pooled_mean FROM e GROUP BY 1",
    "intensity_by_entity": f"""WITH {SALES}, e AS (SELECT n_name, sum(y) AS c, median(o_totalprice) AS k, sum(l_quantity) AS w FROM s GROUP BY 1) SELECT n_name, {R('c', 4)} AS consumed, {R('k', 3)} AS capacity, {R('3.114e6 * c / nullif(k * w, 0)')} AS intensity FROM e""",
    "regression_metrics": f"""WITH {SALES} SELECT c_mktsegment, count(*) AS n, {R('avg((p - y) ** 2)')} AS mse, {R('sqrt(avg((p - y) ** 2))')} AS rmse, {R('avg(abs(p - y))')} AS mae, {R('avg(p - y)')} AS bias, {R('avg(abs(p - y) / nullif(abs(y), 0))')} AS mape,
      {R('avg(2 * abs(p - y) / nullif(abs(y) + abs(p), 0))')} AS smape, {R('1 - sum((p - y) ** 2) / (var_pop(y) * count(*))')} AS r2, {R('sqrt(avg((p - y) ** 2)) / (max(y) - min(y))')} AS nrmse FROM s GROUP BY 1""",
    "within_bands": f"""WITH {SALES}, e AS (SELECT c_mktsegment, n_name, band, avg((p - y > band)::INT) AS u, avg((p - y < -band)::INT) AS d, avg((abs(p - y) <= band)::INT) AS z FROM s, (SELECT unnest([1.0::DOUBLE, 10]) AS band) GROUP BY 1, 2, 3)
      SELECT c_mktsegment, band, {R('avg(u)')} AS above, {R('avg(d)')} AS below, {R('avg(z)')} AS near FROM e GROUP BY 1, 2""",
    "pivot_status": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{k}') AS n_{k.lower()}" for k in "FOP") + " FROM orders GROUP BY 1",
    "static_mode": "WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS mode, count(*) > 1 AS conflict FROM a GROUP BY 1",
    "filtered_aggregates": f"""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, {R('avg(l_tax) FILTER (WHERE l_discount > 0.05)')} AS tax, count(DISTINCT round(l_tax, 2)) AS taxes,
      first(l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) FILTER (WHERE l_quantity > 10) AS first_part FROM lineitem GROUP BY 1""",
}
