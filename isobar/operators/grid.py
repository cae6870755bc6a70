"""Space-time grids: brackets, interpolation, tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c


def cell(points: DataFrame, lat: str, lon: str, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """Adds the lower corner's indices i, j and the fractions fy, fx; null outside the grid."""
    def place(x: str, x0: float, n: int) -> tuple[Column, Column]:
        at = (F.col(x) - x0) / step
        i = F.when(at.between(0, n - 1), F.least(F.floor(at), F.lit(n - 2)).cast("int"))
        return i, at - i

    (i, fy), (j, fx) = place(lat, lat0, n_lat), place(lon, lon0, n_lon)
    return points.withColumns({"i": i, "j": j, "fy": fy, "fx": fx})


def bilinear(points: DataFrame, grid: DataFrame, key: str, at: list[str], field: str, circular: bool = False, partial: bool = False) -> DataFrame:
    """(key, field) from grid(i, j, *at, field) at the points' cells: an equi-join on the four corners and one sum.

    A missing corner that has weight makes the value null, unless partial, where the others' weights are scaled up.
    Circular fields go by their sines and cosines.
    """
    corner = F.explode(F.array(*[
        F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), ((F.col("fy") if di else 1 - F.col("fy")) * (F.col("fx") if dj else 1 - F.col("fx"))).alias("w"))
        for di in (0, 1) for dj in (0, 1)
    ]))
    want = points.filter("i IS NOT NULL AND j IS NOT NULL").select(key, *at, corner.alias("k")).select(key, *at, "k.i", "k.j", "k.w").filter("w > 0")
    hit = want.join(grid.select("i", "j", *at, field), ["i", "j", *at], "left")
    there, v = F.col(field).isNotNull(), F.col(field)
    w = F.when(there, F.col("w"))
    if circular:
        value = c.from_sin_cos(F.sum(F.sin(F.radians(v)) * w), F.sum(F.cos(F.radians(v)) * w))
    else:
        value = F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0))
    whole = F.min(F.when(there, 1).otherwise(0)) == 1
    return hit.groupBy(key).agg((value if partial else F.when(whole, value)).alias(field))


def between(low: Column, high: Column, weight: Column, circular: bool = False) -> Column:
    """Between two times' values; equal times need only one, otherwise a missing value makes it null."""
    if circular:
        mixed = [f(F.radians(low)) * (1 - weight) + f(F.radians(high)) * weight for f in (F.sin, F.cos)]
        value = c.from_sin_cos(*mixed)
    else:
        value = low * (1 - weight) + high * weight
    return F.when(weight == 0, low).when(weight == 1, high).otherwise(value)


def routed(points: DataFrame, manifest: DataFrame, lat: str, lon: str, step: float = 10.0) -> DataFrame:
    """points with part: an equi-join on the tile. manifest: part, tile_cells ("r:c|r:c")."""
    pair = F.split(F.col("cell"), ":")
    cells = manifest.select("part", F.explode(F.split("tile_cells", r"\|")).alias("cell")).select("part", pair[0].cast("int").alias("tile_row"), pair[1].cast("int").alias("tile_col"))
    tiled = points.withColumns({"tile_row": c.tile(lat, -90, step, int(180 / step)), "tile_col": c.tile(c.wrap_180(lon), -180, step, int(360 / step))})
    return tiled.join(cells, ["tile_row", "tile_col"], "left")


def circular_span(bins: DataFrame, group: list[str], name: str, count: int) -> DataFrame:
    """The smallest arc, in bins, that has all occupied ones: what the largest gap leaves."""
    w = Window.partitionBy(*group).orderBy(name)
    whole = Window.partitionBy(*group)
    ahead = F.coalesce(F.lead(name).over(w), F.min(name).over(whole) + count) - F.col(name)
    return bins.select(*group, name).distinct().withColumn("gap", ahead).groupBy(*group).agg((count - F.max("gap") + 1).cast("long").alias("span_bins"))


def tile_components(tiles: DataFrame) -> DataFrame:
    """(tile_row, tile_col, component): 8-neighbour components; at most 648 tiles of 10 degrees, so they are joined on the driver."""
    left = {(r[0], r[1]) for r in tiles.select("tile_row", "tile_col").dropna().distinct().collect()}
    out = []
    while left:
        todo = [left.pop()]
        found = []
        while todo:
            a, b = todo.pop()
            found.append((a, b))
            near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        least = min(a * 1000 + b for a, b in found)
        out += [(a, b, least) for a, b in found]
    return tiles.sparkSession.createDataFrame(out, "tile_row int, tile_col int, component int")


def nodes(points: DataFrame) -> DataFrame:
    """The distinct grid nodes that the points' cells need."""
    corner = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (0, 1) for b in (0, 1)]))
    return points.filter("i IS NOT NULL AND j IS NOT NULL").select(corner.alias("k")).select("k.i", "k.j").distinct()


def area(lat: list[Column], lon: list[Column], pad: float, step: float) -> dict[str, Column]:
    """A padded box, rounded outwards to grid steps."""
    down = lambda x: F.floor((x - pad) / step) * step
    up = lambda x: F.ceil((x + pad) / step) * step
    return {"south": down(lat[0]), "north": up(lat[1]), "west": down(lon[0]), "east": up(lon[1])}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def box_partition(cells: DataFrame, least_fill: float, most_rows: int = 18, most_cols: int = 36) -> DataFrame:
    """(box, south, north, west, east, cells): boxes over tiles, each split at its largest empty stretch, or else in the
    middle, while too little of it is filled or it is higher or wider than allowed.

    Tiles number 648 at most, so their boxes are planned on the driver.
    """
    todo = [sorted({(r[0], r[1]) for r in cells.select("tile_row", "tile_col").distinct().collect()})]
    out = []
    while todo:
        box = todo.pop()
        if not box:
            continue
        rows, cols = sorted({a for a, _ in box}), sorted({b for _, b in box})
        full = (rows[-1] - rows[0] + 1) * (cols[-1] - cols[0] + 1)
        steps = [(b - a, axis, b) for axis, x in enumerate((rows, cols)) for a, b in zip(x, x[1:], strict=False)]
        high, wide = rows[-1] - rows[0] + 1, cols[-1] - cols[0] + 1
        if (len(box) >= least_fill * full and high <= most_rows and wide <= most_cols) or not steps:
            out.append((len(out), rows[0], rows[-1], cols[0], cols[-1], len(box)))
            continue
        gap, axis, at = max(steps)
        if gap == 1:
            over = (high / most_rows, wide / most_cols)
            axis = int(over[1] >= over[0]) if max(over) > 1 else int(len(cols) > len(rows))
            axis = axis if len((rows, cols)[axis]) > 1 else 1 - axis
            line = cols if axis else rows
            at = line[len(line) // 2]
        todo += [[c for c in box if c[axis] < at], [c for c in box if c[axis] >= at]]
    return cells.sparkSession.createDataFrame(out, "box int, south int, north int, west int, east int, cells int")
