"""Nearest-neighbour estimates of entropy and mutual information within groups (Kraskov et al. 2004 and the variants in use).

All operate on a table with a group, an id and vector columns (arrays of double). In groups of up to `BLOCK` points all pairs are built by
an equality join, and everything that an estimate needs of a point is folded from its one sorted list of distances. If any group is larger,
neighbours and counts come from cells of space (`spatial`), some n^1.5 pairs in the one to three dimensions that the estimators work in, and no
list holds more than a cell's points. Neighbours of vectors beyond three components come from blocks of all pairs (`blocks`). All ways give the same rows. Ties are broken by id; estimates come with the value before clamping at zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectramesh.functions.columns import chebyshev, digamma, euclidean
from spectramesh.operators import blocks, spatial

#: Points of a group that a task has on either side of its pairs.
BLOCK = 2048
#: Components up to which boxes over the first two tell enough.
FEW = 3


def pair_distances(df: DataFrame, group: str, key: str, vectors: list[str], metric: str = "chebyshev", block: int = BLOCK) -> DataFrame:
    """group, i, j, d_<vector> for all ordered pairs within a group, each point with itself included.

    A group's points are dealt into blocks of about `block`, and every block meets every other as a key of its own, so that neither side of
    a task's pairs grows with the group.
    """
    d = {"chebyshev": chebyshev, "euclidean": euclidean}[metric]
    # A row per group.
    parts = F.broadcast(df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")))
    rows = df.join(parts, F.col(group) == F.col("_g"))
    own, all_of = F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = rows.select(F.col(group).alias("g"), F.col(key).alias("i"), own.alias("_p"), all_of.alias("_q"), *(F.col(v).alias(f"_a_{v}") for v in vectors))
    b = rows.select("_g", F.col(key).alias("j"), own.alias("_s"), all_of.alias("_r"), *(F.col(v).alias(f"_b_{v}") for v in vectors))
    on = (F.col("g") == F.col("_g")) & (F.col("_p") == F.col("_r")) & (F.col("_q") == F.col("_s"))
    return a.join(b, on).select("g", "i", "j", *(d(f"_a_{v}", f"_b_{v}").alias(f"d_{v}") for v in vectors))


def large(df: DataFrame, group: str, block: int = BLOCK) -> bool:
    """Whether a group has more than `block` points."""
    return (df.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > block


def _extent(df: DataFrame, group: str, vector: str) -> tuple[int, int]:
    """Points of the largest group, and components of the longest vector."""
    most, width = df.groupBy(group).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("w")).agg(F.max("n"), F.max("w")).first()
    return most or 0, width or 0


def neighbour_lists(df: DataFrame, group: str, key: str, vector: str, k: int, metric: str = "euclidean") -> DataFrame:
    """g, i, near: `neighbours` as one array of (d, j) for each point that has any, by rank."""
    if _extent(df, group, vector)[1] > FEW:
        return blocks.nearest_lists(df, group, key, vector, k, metric)
    found = neighbours(df, group, key, vector, k, metric).withColumnRenamed(group, "g")
    return found.groupBy("g", "i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))


def neighbours(df: DataFrame, group: str, key: str, vector: str, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """group, i, j, d, rank (1..k) of each point's k nearest others in its group; equals by id."""
    most, width = _extent(df, group, vector)
    if width > FEW:
        return blocks.nearest(df, group, key, vector, k, metric).withColumnRenamed("g", group)
    if most > block:
        return spatial.nearest(spatial.place(df, group, key, vector), k, metric).withColumnRenamed("g", group)
    pairs = pair_distances(df, group, key, [vector], metric).where("i <> j")
    order = Window.partitionBy("g", "i").orderBy(f"d_{vector}", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("g").alias(group), "i", "j", F.col(f"d_{vector}").alias("d"), "rank")


def count_within(df: DataFrame, group: str, key: str, vector: str, radius: str, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """group, i, n: points of the group (itself included) within each point's own radius."""
    radii = df.select(F.col(group).alias("g"), F.col(key).alias("i"), F.col(radius).alias("r"))
    if large(df, group, block):
        return spatial.within(spatial.place(df, group, key, vector), radii, strict).withColumnRenamed("g", group)
    near = pair_distances(df, group, key, [vector], "chebyshev").join(radii, ["g", "i"])
    hit = F.col(f"d_{vector}") < F.col("r") if strict else F.col(f"d_{vector}") <= F.col("r")
    return near.groupBy(F.col("g").alias(group), "i").agg(F.count_if(hit).alias("n"))


def _points(df: DataFrame, group: str, key: str, vectors: list[str], metric: str = "chebyshev") -> DataFrame:
    """g, i, n (group size), _s: the distances to all others, sorted by the joint distance and id."""
    pairs = pair_distances(df, group, key, vectors, metric).where("i <> j")
    joint = F.greatest(*(F.col(f"d_{v}") for v in vectors)) if len(vectors) > 1 else F.col(f"d_{vectors[0]}")
    entry = F.struct(joint.alias("d"), "j", *(F.col(f"d_{v}").alias(f"d{n}") for n, v in enumerate(vectors)))
    return pairs.groupBy("g", "i").agg(F.array_sort(F.collect_list(entry)).alias("_s")).withColumn("n", F.size("_s") + 1)


def _count(test) -> Column:
    return F.aggregate("_s", F.lit(0), lambda s, e: s + F.when(test(e), 1).otherwise(0))


def _beside(near, name: str, radius: str):
    return lambda e: near(e[name], F.col(radius))


def _widest(near: Column, name: str) -> Column:
    return F.array_max(F.transform(near, lambda e: e[name]))


def _need(points: DataFrame, k: int) -> DataFrame:
    short = F.raise_error(F.format_string("a group has %d points; k + 1 = %d are needed", F.col("n"), F.lit(k + 1)))
    return points.withColumn("n", F.when(F.col("n") >= k + 1, F.col("n")).otherwise(short.cast("int")))


def _around(df: DataFrame, group: str, key: str, vectors: list[str], k: int, limits, strict: bool = True, metric: str = "chebyshev", block: int = BLOCK) -> DataFrame:
    """g, i, n (group size), _k: the k nearest others by the joint distance, and for each vector f: _r<f>, _c<f>.

    limits(_k) gives a radius per vector; _c counts the others within it. _k holds structs d, j, d0, d1 ...: the joint distance and each vector's.
    """
    at = [(f"_r{f}", limit) for f, limit in enumerate(limits(F.col("_k")))]
    if not large(df, group, block):
        p = _need(_points(df, group, key, vectors, metric), k).withColumn("_k", F.slice("_s", 1, k)).withColumns(dict(at))
        near = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
        return p.withColumns({f"_c{f}": _count(_beside(near, f"d{f}", r)) for f, (r, _) in enumerate(at)}).drop("_s")
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("i"), *(F.col(v).alias(f"_v{f}") for f, v in enumerate(vectors)), F.concat(*vectors).alias("_all"))
    placed = spatial.place(rows, "g", "i", "_all")
    _need(placed.groupBy("g").agg(F.max("n").alias("n")), k).agg(F.max("n")).first()
    found = spatial.nearest(placed, k, metric)
    mine, theirs = rows.drop("_all"), rows.select("g", F.col("i").alias("j"), *(F.col(f"_v{f}").alias(f"_w{f}") for f in range(len(vectors))))
    entry = F.struct("d", "j", *(spatial.METRICS[metric](f"_v{f}", f"_w{f}").alias(f"d{f}") for f in range(len(vectors))))
    p = spatial.beside(spatial.beside(found, mine, ["g", "i"]), theirs, ["g", "j"]).groupBy("g", "i").agg(F.array_sort(F.collect_list(entry)).alias("_k"))
    p = spatial.beside(p, placed.select("g", "i", "n"), ["g", "i"]).withColumns(dict(at))
    if at:
        p = spatial.written(p)
    for f, (r, _) in enumerate(at):
        # One vector alone takes the joint distance's cells.
        cells = placed if len(vectors) == 1 else spatial.place(rows, "g", "i", f"_v{f}")
        n = spatial.within(cells, p.select("g", "i", F.col(r).alias("r")), strict)
        own = F.when(F.col(r) > 0, 1).otherwise(0) if strict else F.lit(1)
        p = spatial.beside(p, n.select("g", "i", F.col("n").alias("_n")), ["g", "i"]).withColumn(f"_c{f}", F.col("_n") - own).drop("_n")
    return p


def _estimate(points: DataFrame, group: str, raw: Column) -> DataFrame:
    return points.groupBy("g").agg(raw.alias("mi_raw")).select(F.col("g").alias(group), F.greatest(F.lit(0.0), "mi_raw").alias("mi"), "mi_raw")


def mutual_information(df: DataFrame, group: str, key: str, x: str, y: str, k: int = 3, method: int = 1, base: float = math.e, variant: str = "reference", block: int = BLOCK) -> DataFrame:
    """group, mi, mi_raw (before clamping) between two vector columns.

    method 1: radius to the k-th joint neighbour, strict counts. method 2: each variable's largest distance among the k neighbours,
    closed counts and a term 1/k in nats. variant `reference` counts the point itself in method 1 and takes psi(n + 1) in method 2;
    `paper` follows the publication (no self, psi(n + 1) in 1 and psi(n) in 2). Groups below k + 1 points raise an error.
    """
    if method not in (1, 2):
        raise ValueError("method must be 1 or 2")
    if variant not in ("reference", "paper"):
        raise ValueError(f"unknown variant {variant!r}: reference, paper")
    if method == 1:
        p = _around(df, group, key, [x, y], k, lambda near: [F.get(near, k - 1)["d"]] * 2, block=block)
        more = F.when(F.col("_r0") > 0, 2).otherwise(1) if variant == "reference" else F.lit(1)
        shift = F.lit(0.0)
    else:
        p = _around(df, group, key, [x, y], k, lambda near: [_widest(near, "d0"), _widest(near, "d1")], False, block=block)
        more = F.lit(1 if variant == "reference" else 0)
        shift = F.lit(1.0 / k)
    p = p.select("g", "n", digamma(F.col("_c0") + more, base).alias("_px"), digamma(F.col("_c1") + more, base).alias("_py"))
    return _estimate(p, group, digamma(F.lit(k), base) - shift - F.avg(F.col("_px") + F.col("_py")) + digamma(F.max("n"), base))


def multivariate_mutual_information(df: DataFrame, group: str, key: str, variables: list[str], k: int = 3, base: float = math.e, block: int = BLOCK) -> DataFrame:
    """group, mi, mi_raw of two or more vector columns: psi(k) + (m - 1) psi(N) - sum of mean psi(n_i + 1), strict counts with the point itself."""
    if len(variables) < 2:
        raise ValueError("two variables at least")
    p = _around(df, group, key, variables, k, lambda near: [F.get(near, k - 1)["d"]] * len(variables), block=block)
    own = F.when(F.col("_r0") > 0, 1).otherwise(0)
    sums = [digamma(F.col(f"_c{f}") + own + 1, base) for f in range(len(variables))]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    p = p.select("g", "n", total.alias("_p"))
    return _estimate(p, group, digamma(F.lit(k), base) + (len(variables) - 1) * digamma(F.max("n"), base) - F.avg("_p"))


def conditional_mutual_information(df: DataFrame, group: str, key: str, x: str, y: str, z: str, k: int = 3, base: float = math.e, block: int = BLOCK) -> DataFrame:
    """group, cmi: I(X; [Y, Z]) - I(X; Z) by method 1; each term is clamped, the difference isn't."""
    joint = df.withColumn("_yz", F.concat(y, z))
    a = mutual_information(joint, group, key, x, "_yz", k, 1, base, block=block).select(group, F.col("mi").alias("_a"))
    b = mutual_information(df, group, key, x, z, k, 1, base, block=block).select(group, F.col("mi").alias("_b"))
    return a.join(b, group).select(group, (F.col("_a") - F.col("_b")).alias("cmi"))


def ball_volume(d: int) -> float:
    return 1.0 if d == 1 else math.pi ** (d / 2) / math.gamma(d / 2 + 1)


def entropy(df: DataFrame, group: str, key: str, x: str, d: int, k: int = 3, block: int = BLOCK) -> DataFrame:
    """group, entropy in nats of vectors with d components: -psi(k) + psi(N) + ln c_d + d * mean ln(distance to the k-th neighbour).

    c_d is the unit ball's volume, but one for d = 1. A k-th distance of zero leaves its point out of the mean.
    """
    p = _around(df, group, key, [x], k, lambda near: [], metric="euclidean", block=block).select("g", "n", F.log(F.get("_k", k - 1)["d"]).alias("_l"))
    raw = -digamma(F.lit(k)) + digamma(F.max("n")) + math.log(ball_volume(d)) + d * F.avg("_l")
    return p.groupBy("g").agg(raw.alias("entropy")).withColumnRenamed("g", group)


def mi_matrix(long: DataFrame, group: str, key: str, field: str, vector: str, k: int = 3, base: float = math.e, block: int = BLOCK) -> DataFrame:
    """group, field_i, field_j, mi, mi_raw for all pairs of fields (method 2), mirrored, with the diagonal. long: group, key, field, vector.

    Each field's distances are computed once per pair of points; a pair of fields then joins two of those lists. If a group has more than
    `block` points, each pair of fields becomes a group of its own, with both values of each point.
    """
    if large(long.withColumn("_gf", F.struct(group, field)), "_gf", block):
        one = long.select(F.col(group).alias("_g"), F.col(key).alias("_i"), F.col(field).alias("_f"), F.col(vector).alias("_x"))
        other = one.select("_g", "_i", F.col("_f").alias("_h"), F.col("_x").alias("_y"))
        both = spatial.beside(one, other, ["_g", "_i"]).where("_f >= _h").select(F.struct("_g", "_f", "_h").alias("_of"), "_i", "_x", "_y")
        found = mutual_information(both, "_of", "_i", "_x", "_y", k, 2, base, block=block)
        return _mirrored(found.select(F.col("_of._g").alias(group), F.col("_of._f").alias("field_i"), F.col("_of._h").alias("field_j"), "mi", "mi_raw"), group)
    rows = long.withColumn("_gf", F.struct(F.col(group).alias("g"), F.col(field).alias("f")))
    d = pair_distances(rows, "_gf", key, [vector]).where("i <> j").select("g.g", "g.f", "i", "j", F.col(f"d_{vector}").alias("d"))
    lists = d.groupBy("g", "f", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda e: e["d"]).alias("_d"))
    a, b = lists.select("g", "i", F.col("f").alias("field_i"), F.col("_d").alias("_a")), lists.select("g", "i", F.col("f").alias("field_j"), F.col("_d").alias("_b"))
    pairs = a.join(b, ["g", "i"]).where("field_i >= field_j")
    both = F.zip_with("_a", "_b", lambda x, y: F.struct(F.greatest(x, y).alias("d"), x.alias("d0"), y.alias("d1")))
    at = F.array_sort(F.transform(both, lambda e, n: F.struct(e["d"].alias("d"), n.alias("n"), e["d0"].alias("d0"), e["d1"].alias("d1"))))
    p = _need(pairs.withColumn("_s", at).withColumn("n", F.size("_s") + 1), k).withColumn("_k", F.slice("_s", 1, k))
    p = p.withColumn("_e0", F.array_max(F.transform("_k", lambda e: e["d0"]))).withColumn("_e1", F.array_max(F.transform("_k", lambda e: e["d1"])))
    nx, ny = _count(lambda e: e["d0"] <= F.col("_e0")) + 1, _count(lambda e: e["d1"] <= F.col("_e1")) + 1
    p = p.select("g", "field_i", "field_j", "n", (digamma(nx, base) + digamma(ny, base)).alias("_p"))
    low = p.groupBy("g", "field_i", "field_j").agg((digamma(F.lit(k), base) - 1.0 / k - F.avg("_p") + digamma(F.max("n"), base)).alias("mi_raw"))
    return _mirrored(low.select(F.col("g").alias(group), "field_i", "field_j", F.greatest(F.lit(0.0), "mi_raw").alias("mi"), "mi_raw"), group)


def _mirrored(low: DataFrame, group: str) -> DataFrame:
    return low.unionByName(low.where("field_i <> field_j").select(group, F.col("field_j").alias("field_i"), F.col("field_i").alias("field_j"), "mi", "mi_raw"))


def display_matrix(matrix: DataFrame, group: str) -> DataFrame:
    """Add `shown`: mi over the group's largest, null on the diagonal."""
    most = Window.partitionBy(group)
    return matrix.withColumn("shown", F.when(F.col("field_i") != F.col("field_j"), F.try_divide("mi", F.max("mi").over(most))))
