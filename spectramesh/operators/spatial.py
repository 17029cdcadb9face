"""Nearest neighbours and counts within radii over large groups, by cells of space.

A group of n points is cut into about sqrt(n) cells of about sqrt(n) points each: strips of equally many points along the first
coordinate, and equally many points along the second one (the first again, if it is alone) within each strip. Cells know their bounding boxes, so
a search compares boxes with boxes, points with the boxes that are left, and points with points only where a box is neither out of
reach nor, when counting, wholly within. A point's own cell gives the first k distances; the k-th of them is the radius within which nearer
points could be, and every cell that this radius touches is searched, so the result is exact. That takes about n^1.5 pairs where the
first two coordinates tell points apart; where they don't, all pairs are left.

Points without a vector, or with a null or NaN in it, take no part. Equal distances go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectramesh.functions.columns import chebyshev, euclidean
from spectramesh.sources.tables import written

METRICS = {"chebyshev": chebyshev, "euclidean": euclidean}
#: Quantiles of a coordinate among which the strips' borders are picked: at most so many strips, and as many cells in each.
STEPS = 256


def beside(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables with a row or more per point: sorted and merged, since a broadcast would take the points through the driver."""
    return rows.join(other.hint("merge"), on, how)


def _borders(coordinate: Column) -> Column:
    return F.percentile_approx(coordinate, F.array(*(F.lit(j / STEPS) for j in range(1, STEPS))), 4 * STEPS)


def _picked(found: str) -> Column:
    """Every (STEPS / m)-th of the quantiles; none for one strip."""
    some = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda j: F.get(found, (F.floor(j * STEPS / F.col("m")) - 1).cast("int")))
    return F.when(F.col("m") > 1, some).otherwise(F.array().cast("array<double>"))


def place(df: DataFrame, group: str, key: str, vector: str, alone: int = 256) -> DataFrame:
    """g, i, v, n (points of the group), cell - as a written table. Groups of up to `alone` points are one cell."""
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("i"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first, second = F.get("v", 0), F.coalesce(F.get("v", 1), F.get("v", 0))
    m = F.when(F.col("n") <= alone, 1).otherwise(F.least(F.lit(STEPS - 1), F.ceil(F.pow("n", F.lit(0.25))).cast("int")))
    # A row per group, then one per strip: some n^0.25 for n points.
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), _borders(first).alias("_q")).withColumn("m", m.cast("int")).select("g", "n", "m", _picked("_q").alias("_b"))
    rows = rows.join(groups, "g").withColumn("strip", F.size(F.filter("_b", lambda b: b < first))).drop("_b")
    strips = rows.groupBy("g", "strip").agg(F.max("m").alias("m"), _borders(second).alias("_q")).select("g", "strip", _picked("_q").alias("_b"))
    rows = rows.join(strips, ["g", "strip"]).withColumn("cell", F.col("strip") * STEPS + F.size(F.filter("_b", lambda b: b < second)))
    return written(rows.select("g", "i", "v", "n", "cell"))


def _boxes(points: DataFrame, *more: Column) -> DataFrame:
    """g, cell and the box over the first two coordinates; `flat`: there are no others."""
    x, y = F.get("v", 0), F.coalesce(F.get("v", 1), F.lit(0.0))
    return points.groupBy("g", "cell").agg(F.count("*").alias("many"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), (F.max(F.size("v")) <= 2).alias("flat"), *more)


def _joined(dx: Column, dy: Column, metric: str) -> Column:
    return F.greatest(dx, dy) if metric == "chebyshev" else F.sqrt(dx * dx + dy * dy)


def _gap(a: tuple, b: tuple, metric: str) -> Column:
    """The least distance between two boxes (x0, x1, y0, y1); a point is a box."""
    zero = F.lit(0.0)
    return _joined(F.greatest(zero, b[0] - a[1], a[0] - b[1]), F.greatest(zero, b[2] - a[3], a[2] - b[3]), metric)


def _span(a: tuple, b: tuple, metric: str) -> Column:
    """The largest distance between points of two boxes."""
    return _joined(F.greatest(b[1] - a[0], a[1] - b[0]), F.greatest(b[3] - a[2], a[3] - b[2]), metric)


_BOX = ("x0", "x1", "y0", "y1")


def _box(prefix: str = "") -> tuple:
    return tuple(F.col(prefix + c) for c in _BOX)


def _here() -> tuple:
    x, y = F.get("v", 0), F.coalesce(F.get("v", 1), F.lit(0.0))
    return x, x, y, y


def _others(boxes: DataFrame) -> DataFrame:
    return boxes.select("g", F.col("cell").alias("other"), F.col("many").alias("o_many"), F.col("flat").alias("o_flat"), *(F.col(c).alias(f"o_{c}") for c in _BOX))


def nearest(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """g, i, j, d, rank (1..k) of each placed point's k nearest others of its group."""
    d = METRICS[metric]
    b = points.select("g", F.col("cell").alias("other"), F.col("i").alias("j"), F.col("v").alias("w"))
    own = beside(points, b.withColumnRenamed("other", "cell"), ["g", "cell"]).where("i <> j").select("g", "cell", "i", "j", d("v", "w").alias("d"))
    first = own.groupBy("g", "cell", "i").agg(F.get(F.array_sort(F.collect_list("d")), k - 1).alias("r"))
    reach = written(beside(points, first, ["g", "cell", "i"], "left").select("g", "cell", "i", "v", F.coalesce("r", F.lit(float("inf"))).alias("r")))
    boxes = _boxes(reach, F.max("r").alias("r_max"))
    near = boxes.join(_others(boxes), "g").where((F.col("cell") != F.col("other")) & (_gap(_box(), _box("o_"), metric) <= F.col("r_max"))).drop(*_BOX, "many", "flat", "r_max")
    asks = beside(reach, near, ["g", "cell"]).where(_gap(_here(), _box("o_"), metric) <= F.col("r")).select("g", "i", "v", "r", "other")
    more = beside(asks, b, ["g", "other"]).select("g", "i", "j", "r", d("v", "w").alias("d"))
    both = beside(own, reach.select("g", "i", "r"), ["g", "i"]).select("g", "i", "j", "r", "d").unionByName(more).where(F.col("d") <= F.col("r"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("g", "i").orderBy("d", "j"))).where(F.col("rank") <= k).select("g", "i", "j", "d", "rank")


def within(points: DataFrame, radii: DataFrame, strict: bool = True, metric: str = "chebyshev") -> DataFrame:
    """g, i, n: placed points of the group (itself included) within the radius of each point. radii: g, i, r."""
    d, inside = METRICS[metric], (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    rows = written(beside(points, radii.select("g", "i", "r"), ["g", "i"]).select("g", "i", "v", "cell", "r"))
    boxes = _boxes(points)
    cells = rows.groupBy("g", "cell").agg(F.min("r").alias("r_min"), F.max("r").alias("r_max")).join(boxes, ["g", "cell"])
    pairs = cells.join(_others(boxes), "g").where(inside(_gap(_box(), _box("o_"), metric), F.col("r_max")))
    whole = F.col("flat") & F.col("o_flat") & inside(_span(_box(), _box("o_"), metric), F.col("r_min"))
    pairs = pairs.select("g", "cell", "other", "o_many", *(f"o_{c}" for c in _BOX), (F.col("flat") & F.col("o_flat")).alias("exact"), whole.alias("whole"))
    sums = pairs.where("whole").groupBy("g", "cell").agg(F.sum("o_many").alias("k"))
    asks = beside(rows, pairs.where("not whole"), ["g", "cell"]).where(inside(_gap(_here(), _box("o_"), metric), F.col("r")))
    asks = asks.withColumn("all", F.col("exact") & inside(_span(_here(), _box("o_"), metric), F.col("r")))
    b = points.select("g", F.col("cell").alias("other"), F.col("v").alias("w"))
    hits = beside(asks.where("not all"), b, ["g", "other"]).where(inside(d("v", "w"), F.col("r"))).select("g", "i", F.lit(1).cast("bigint").alias("k"))
    some = rows.join(sums, ["g", "cell"], "left").select("g", "i", F.coalesce("k", F.lit(0)).cast("bigint").alias("k"))
    found = some.unionByName(asks.where("all").select("g", "i", F.col("o_many").alias("k"))).unionByName(hits)
    return found.groupBy("g", "i").agg(F.sum("k").alias("n"))
