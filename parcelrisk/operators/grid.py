"""Grid cells for maps: a heat map per cell, the neighbours of one location, all
neighbours of many within a radius, and the nearest few of each.  Cells are plain
integer columns; rows meet by cell, so rows far apart are never paired."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelrisk.session import checkpoint_dir


def cell(c, size: float) -> Column:
    """Integer cell index of a coordinate."""
    return F.floor(F.col(c) / F.lit(size)).cast("bigint")


def heat_map(df: DataFrame, x: str, y: str, dx: float, dy: float, value: str | None = None) -> DataFrame:
    """Rows, and mean / sum of ``value``, per (cell_x, cell_y)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if value:
        aggs += [F.avg(value).alias("mean_value"), F.sum(value).alias("sum_value")]
    return df.groupBy(cell(x, dx).alias("cell_x"), cell(y, dy).alias("cell_y")).agg(*aggs)


def neighbours(df: DataFrame, x: str, y: str, x0: float, y0: float, radius: float) -> DataFrame:
    """Rows within Euclidean ``radius`` of (x0, y0), with their distance.
    The bounding box is stated first so it can be pushed to the scan."""
    box = (F.col(x) >= x0 - radius) & (F.col(x) <= x0 + radius) \
        & (F.col(y) >= y0 - radius) & (F.col(y) <= y0 + radius)
    d = F.sqrt((F.col(x) - F.lit(x0)) ** 2 + (F.col(y) - F.lit(y0)) ** 2)
    return df.where(box).withColumn("distance", d).where(F.col("distance") <= radius)


_PART_ROWS = 4096            # a fuller cell is dealt into parts
_TASK_PAIRS = 1 << 24        # rows that meet in a task, on average


def neighbours_of(points: DataFrame, df: DataFrame, x: str, y: str, radius: float,
                  point_key: str, key: str) -> DataFrame:
    """(``point_key`` as ``point``, ``key`` as ``neighbour``, ``distance``):
    the rows of ``df`` within ``radius`` of each point.  Cells have the side
    ``radius``, so a point meets its own cell and the eight around it; rows of
    other cells are never paired.  The rows of a full cell are dealt into parts by
    their hash, and the pairs that will meet are counted first: there are as many
    tasks as they need, however few bytes the rows have."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.select(F.col(point_key).alias("point"), F.col(x).alias("_px"), F.col(y).alias("_py"),
                      cell(x, radius).alias("_ci"), cell(y, radius).alias("_cj"),
                      F.explode(around).alias("_o"))
    p = p.select("point", "_px", "_py", (F.col("_ci") + F.col("_o.i")).alias("_ci"),
                 (F.col("_cj") + F.col("_o.j")).alias("_cj"))
    plain = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    d = df.select(F.col(key).alias("neighbour"), F.col(x).alias("_x"), F.col(y).alias("_y"),
                  cell(x, radius).alias("_ci"), cell(y, radius).alias("_cj"), F.xxhash64(*plain).alias("_h"))
    at = ["_ci", "_cj"]
    checkpoint_dir(df.sparkSession)
    # a row per cell that has both
    met = d.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).join(
        p.groupBy(*at).agg(F.count(F.lit(1)).alias("_m")), at).checkpoint()
    pairs = met.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0         # one number
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / _TASK_PAIRS))
    full = met.where(F.col("_n") > _PART_ROWS).select(
        *at, F.ceil(F.col("_n") / _PART_ROWS).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    p = p.join(full, at, "left").select("point", "_px", "_py", *at, F.explode(
        F.sequence(F.lit(0), parts - 1)).alias("_part")).repartition(tasks, *at, "_part")
    d = d.join(full, at, "left").select("neighbour", "_x", "_y", *at, F.pmod("_h", parts).cast("int").alias(
        "_part")).repartition(tasks, *at, "_part")
    gap = F.sqrt((F.col("_x") - F.col("_px")) ** 2 + (F.col("_y") - F.col("_py")) ** 2)
    return p.join(d, [*at, "_part"]).withColumn("distance", gap).where(
        F.col("distance") <= radius).select("point", "neighbour", "distance")


def _at_levels(df: DataFrame, x: str, y: str, x0: float, y0: float, span: float, levels) -> DataFrame:
    """``df`` with its cell (_l, _ci, _cj) at each level; a cell's side is
    ``span / 2 ** level``."""
    d = df.withColumn("_l", F.explode(F.array(*[F.lit(i) for i in levels])))
    side = F.lit(span) / F.pow(F.lit(2.0), F.col("_l"))
    return d.withColumns({"_ci": F.floor((F.col(x) - x0) / side), "_cj": F.floor((F.col(y) - y0) / side)})


def _around(points: DataFrame) -> DataFrame:
    """Each row in its cell and the eight cells around it."""
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.withColumn("_o", F.explode(step))
    return p.withColumns({"_ci": F.col("_ci") + F.col("_o.i"), "_cj": F.col("_cj") + F.col("_o.j")}).drop("_o")


def nearest_k(points: DataFrame, df: DataFrame, x: str, y: str, k: int, point_key: str, key: str,
              exclude_self: bool = False) -> DataFrame:
    """(``point``, ``neighbour``, ``distance``, ``rank``): the ``k`` rows of ``df`` nearest
    to each point, ties by ``key``; fewer where ``df`` has fewer.  ``exclude_self``
    leaves out the row with the point's own key.

    Cells of halving sides are counted first, on every level, and a point takes
    the smallest cell that holds enough rows together with the eight around it;
    rows beyond these are farther than a cell's side.  Where the k-th is farther
    than that too, the point alone goes on to the level whose cells reach as far
    as it.  So a point meets few more rows than it needs, in thin and in dense
    regions; of rows at one place only the first ``k`` can count.  Rows without
    finite coordinates or a key have no neighbours and are none; equal points
    count once."""
    need = k + (1 if exclude_self else 0)
    finite = F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.abs("_x") < float("inf")) \
        & (F.abs("_y") < float("inf")) & F.col("_key").isNotNull()

    def at(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.col(name).alias("_key"), F.col(x).cast("double").alias("_x"),
                        F.col(y).cast("double").alias("_y")).where(finite)

    place = Window.partitionBy("_x", "_y").orderBy("_key")
    rows = at(df, key).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= need).drop("_n")
    asked = at(points, point_key).select(F.col("_key").alias("point"), F.col("_x").alias("_px"),
                                         F.col("_y").alias("_py")).distinct()
    box = rows.select("_x", "_y").unionByName(asked.select(F.col("_px").alias("_x"), F.col("_py").alias("_y")))
    r = box.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y"), F.count(F.lit(1))).first()   # five numbers
    x0, y0 = r[0] or 0.0, r[1] or 0.0
    span = max((r[2] or 0.0) - x0, (r[3] or 0.0) - y0) or 1.0
    depth = min(24, max(0, math.ceil(math.log(max(r[4], 1) / need, 4))) + 3)
    levels = range(depth + 1)

    held = _at_levels(rows, "_x", "_y", x0, y0, span, levels).groupBy("_l", "_ci", "_cj").agg(
        F.count(F.lit(1)).alias("_n"))
    seen = _around(_at_levels(asked, "_px", "_py", x0, y0, span, levels)).join(held, ["_l", "_ci", "_cj"])
    enough = seen.groupBy("point", "_px", "_py", "_l").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= need)
    level = enough.groupBy("point", "_px", "_py").agg(F.max("_l").alias("_at"))
    checkpoint_dir(df.sparkSession)
    start = asked.join(level, ["point", "_px", "_py"], "left").select(
        "point", "_px", "_py", F.coalesce("_at", F.lit(0)).alias("_at")).checkpoint()

    def search(ps: DataFrame) -> DataFrame:
        used = [q["_at"] for q in ps.select("_at").distinct().collect()]           # one row per level
        if not used:
            used = [0]
        cells = _around(_at_levels(ps, "_px", "_py", x0, y0, span, used).where("_l = _at"))
        dx, dy = F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py")
        met = cells.join(_at_levels(rows, "_x", "_y", x0, y0, span, used), ["_l", "_ci", "_cj"])
        if exclude_self:
            met = met.where(F.col("_key") != F.col("point"))
        met = met.withColumn("distance", F.sqrt(dx * dx + dy * dy))
        first = Window.partitionBy("point", "_px", "_py").orderBy("distance", "_key")
        return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
            "point", "_px", "_py", "_at", F.col("_key").alias("neighbour"), "distance", "rank")

    got = search(start).checkpoint()
    far = got.groupBy("point", "_px", "_py", "_at").agg(F.max("distance").alias("_d"))
    side = F.lit(span) / F.pow(F.lit(2.0), F.col("_at"))
    far = far.where((F.col("_at") > 0) & (F.col("_d") > side * (1 - 1e-9)))
    wider = F.greatest(F.lit(0), F.floor(F.log2(F.lit(span) / F.col("_d")) - 1e-9)).cast("int")
    far = far.select("point", "_px", "_py", F.least(wider, F.col("_at") - 1).alias("_at")).checkpoint()
    settled = got.join(far.select("point", "_px", "_py"), ["point", "_px", "_py"], "left_anti")
    out = settled if far.isEmpty() else settled.unionByName(search(far))
    return out.select("point", "neighbour", "distance", "rank")
