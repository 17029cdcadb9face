"""Selection of well segmented items: predicates, quantile cuts, strided samples, work still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _above(x: Column, limit: float) -> Column:
    """x > limit, where NaN and null count as not above (the engine orders NaN above all numbers)."""
    return F.coalesce((x > limit) & ~F.isnan(x), F.lit(False))


def _below(x: Column, limit: float) -> Column:
    return F.coalesce((x < limit) & ~F.isnan(x), F.lit(False))


def quality_filter(mesh: DataFrame, features: DataFrame, on: list[str], intensity: str, sphericity: str, tol: float = 1.0, most: float = 1.3) -> DataFrame:
    """Mesh rows but those with an intensity below `tol` or a sphericity above `most`; both limits are strict.

    Mesh rows without features stay, as do rows whose value is NaN or null; features without a mesh row don't appear.
    """
    f = features.select(*on, F.col(f"`{intensity}`").alias("_intensity"))
    return mesh.join(f, on, "left").where(~(_below(F.col("_intensity"), tol) | _above(F.col(f"`{sphericity}`"), most))).drop("_intensity")


#: Rows whose values one task may sort out for an exact quantile.
NEAR_ROWS = 1 << 20


def exact_quantiles(df: DataFrame, value: str, shares: tuple[float, ...], near_rows: int = NEAR_ROWS) -> DataFrame:
    """One row with the array `q` of exact quantiles (linear interpolation); nulls are left out, without values all are null.

    A table of up to `near_rows` values is sorted out at once. In a larger one, each quantile is first bracketed: a pass counts the values
    below and within the bracket and takes approximate quantiles within, until few enough distinct values are left that could be the quantile.
    """
    v = F.col(value).cast("double")
    some = df.where(v.isNotNull()).select(v.alias("v"))
    n = some.count()
    if n <= near_rows:
        return some.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    found = []
    for share in shares:
        at = share * (n - 1)
        low, high, below, within = None, None, 0, some
        while True:
            count = within.count()
            if count <= near_rows:
                break
            # Around the wanted place, as far as the sketch may err and one value more.
            place, slack = (at - below) / (count - 1), 2e-4 + 2 / count
            a, b = within.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, place - slack)), F.lit(min(1.0, place + slack))), 20_000)).first()[0]
            a, b = (a if place > slack else low), (b if place < 1 - slack else high)
            if (a, b) == (low, high) or a is not None and a == b:
                break  # many equal values: few distinct ones
            low, high = a, b
            within = some.where((F.lit(low is None) | (F.col("v") >= low)) & (F.lit(high is None) | (F.col("v") <= high)))
            below = 0 if low is None else some.where(F.col("v") < low).count()
        values = within.groupBy("v").agg(F.count("*").alias("c"))
        ends = F.aggregate(
            F.array_sort(F.collect_list(F.struct("v", "c"))),
            F.struct(F.lit(float(below)).alias("n"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")),
            lambda s, x: F.struct((s["n"] + x["c"]).alias("n"), F.when(s["a"].isNull() & (s["n"] + x["c"] > int(at)), x["v"]).otherwise(s["a"]).alias("a"), F.when(s["b"].isNull() & (s["n"] + x["c"] > min(n - 1, int(at) + 1)), x["v"]).otherwise(s["b"]).alias("b")),
        )
        e = values.agg(ends.alias("e")).select("e.a", "e.b").first()
        found.append(e.a + (at - int(at)) * ((e.b if e.b is not None else e.a) - e.a))
    return df.sparkSession.createDataFrame([(found,)], "q array<double>")


#: Bins that a bracket is cut into in each round.
BINS = 1024


def grouped_quantile(df: DataFrame, by: list[str], value: str, share: float = 0.5, near_rows: int = NEAR_ROWS) -> DataFrame:
    """by, q: the exact quantile (linear interpolation) of each group; nulls are left out.

    Groups of up to `near_rows` values are sorted out at once. Otherwise all groups are narrowed down together: a round counts the values in
    BINS equal parts of each bracket and keeps the part that holds the wanted place, until the brackets hold few values or one alone. Counts
    are added up before the shuffle, so no task sees a whole group.
    """
    from spectramesh.sources.tables import written

    v = F.col(value).cast("double")
    some = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    sizes = some.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= near_rows:
        return some.groupBy(*by).agg(F.percentile("_v", F.lit(share)).alias("q"))
    at = F.lit(share) * (F.col("_n") - 1)
    # Two places a group, the second one only where interpolation needs it: the _want-th value (from 0) lies in [_lo, _hi], below which are _below values.
    places = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))
    state = written(sizes.select(*by, at.alias("_at"), places.alias("_want"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside")))
    while state.where((F.col("_inside") > near_rows) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        width = (F.col("_hi") - F.col("_lo")) / BINS
        part = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width))).cast("int")
        open_ = state.where((F.col("_inside") > near_rows) & (F.col("_lo") < F.col("_hi")))
        within = some.join(open_, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bins = within.groupBy(*by, "_want", F.coalesce(part, F.lit(0)).alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = Window.partitionBy(*by, "_want").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_sum", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = bins.join(open_.select(*by, "_want", "_at", "_below"), [*by, "_want"]).where((F.col("_below") + F.col("_sum") <= F.col("_want")) & (F.col("_want") < F.col("_below") + F.col("_sum") + F.col("_c")))
        moved = hit.select(*by, "_at", "_want", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_sum")).alias("_below"), F.col("_c").alias("_inside"))
        state = written(moved.unionByName(state.where((F.col("_inside") <= near_rows) | (F.col("_lo") >= F.col("_hi")))))
    rest = some.join(state.where("_lo < _hi"), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    found = rest.groupBy(*by, "_want", "_at", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_s")).select(*by, "_at", "_want", F.get("_s", (F.col("_want") - F.col("_below")).cast("int")).alias("_x"))
    found = found.unionByName(state.where("_lo = _hi").select(*by, "_at", "_want", F.col("_lo").alias("_x")))
    near = F.col("_want") == F.floor("_at")
    both = found.groupBy(*by, "_at").agg(F.max(F.when(near, F.col("_x"))).alias("_a"), F.max(F.when(~near, F.col("_x"))).alias("_b"))
    return both.select(*by, (F.col("_a") + (F.col("_at") - F.floor("_at")) * F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0))).alias("q"))


def percentile_cut(df: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Rows strictly below the exact q-quantile (linear interpolation) over all rows."""
    cut = exact_quantiles(df, value, (q,)).select(F.get("q", 0).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(value) < F.col("_cut")).drop("_cut")


def strided_sample(df: DataFrame, group: list[str], order: list[str], step: int = 10) -> DataFrame:
    """Rows at positions 0, step, 2 step, ... of each group."""
    return df.withColumn("_pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where((F.col("_pos") - 1) % step == 0).drop("_pos")


def existing(items: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    return items.join(files, on, "left_semi")


def pending(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Items without output yet."""
    return items.join(done, on, "left_anti")


def without_blacklist(items: DataFrame, blacklist: DataFrame, on: list[str]) -> DataFrame:
    return items.join(blacklist, on, "left_anti")


def variance_filter(long: DataFrame, dim: str, value: str, threshold: float = 1e-10) -> DataFrame:
    """Rows of the dimensions whose population variance exceeds the threshold."""
    keep = long.groupBy(dim).agg(F.var_pop(value).alias("_var")).where(F.col("_var") > threshold).select(dim)
    return long.join(keep, dim, "left_semi")


def equals(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns have the given values, such as one cluster or one timepoint."""
    for name, v in values.items():
        df = df.where(F.col(name) == F.lit(v))
    return df


def exclude_labels(fields: DataFrame, names: DataFrame, exclude: tuple[str, ...] = ("DAPI (nuclei)",), field: str = "field") -> DataFrame:
    """Fields with their label, looked up by the name's first five letters, without the excluded ones.

    names: prefix, label. A prefix that isn't listed is an error when its row is read.
    """
    found = fields.withColumn("prefix", F.substring(field, 1, 5)).join(F.broadcast(names), "prefix", "left")
    checked = F.coalesce("label", F.raise_error(F.concat(F.lit("unknown field prefix: "), F.col("prefix"))).cast("string"))
    return found.withColumn("label", checked).where(~F.col("label").isin(*exclude))


def random_pick(df: DataFrame, key: str, n: int = 20, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of the key: a fixed random sample for each seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    return exact_quantiles(df, value, shares).select(*(F.get("q", i).alias(f"p{q * 100:g}".replace(".", "_")) for i, q in enumerate(shares)))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin, n: equal bins from least to largest value, the last one closed; empty bins are left out. One value alone falls in bin 0."""
    edge = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
