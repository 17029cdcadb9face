"""Vocabularies and clusters: distances to centres, k-means, soft encoding, exemplars, and the way back from codes to spectra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.functions.columns import euclidean, hashed_uniform, inverse_soft_assignment, soft_assignment

METHODS = ("nearest", "weighted", "nearest_sample", "sphere_intersection")


def distances(points: DataFrame, centers: DataFrame, key: list[str], vector: str = "x") -> DataFrame:
    """key, cluster, d for every point and centre. centers: cluster, center; a vocabulary is a few rows and is broadcast."""
    return points.select(*key, F.col(vector).alias("_x")).crossJoin(F.broadcast(centers)).select(*key, "cluster", euclidean("_x", "center").alias("d"))


def center_array(centers: DataFrame) -> DataFrame:
    """One row: the centres ordered by cluster, as `clusters` and `centers`."""
    both = F.array_sort(F.collect_list(F.struct("cluster", "center")))
    return centers.agg(both.alias("_c")).select(F.transform("_c", lambda x: x["cluster"]).alias("clusters"), F.transform("_c", lambda x: x["center"]).alias("centers"))


def distance_vector(points: DataFrame, centers: DataFrame, vector: str = "x", out: str = "d") -> DataFrame:
    """Add the array of distances to the centres, in the order of clusters: no row per pair and no shuffle."""
    return points.crossJoin(F.broadcast(center_array(centers))).withColumn(out, F.transform("centers", lambda c: euclidean(F.col(vector), c))).drop("centers")


def assign(points: DataFrame, centers: DataFrame, vector: str = "x") -> DataFrame:
    """Add cluster (the nearest centre, the first of equals) and distance."""
    d = distance_vector(points, centers, vector, "_d")
    return d.withColumn("cluster", F.get("clusters", (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))).withColumn("distance", F.array_min("_d")).drop("_d", "clusters")


def bandwidth(points: DataFrame, centers: DataFrame, vector: str = "x", mode: str = "own") -> DataFrame:
    """One row, sigma. own: mean distance to the own centre; legacy: sum over clusters of share times mean distance to its centre."""
    if mode == "own":
        return assign(points, centers, vector).agg(F.avg("distance").alias("sigma"))
    if mode != "legacy":
        raise ValueError(f"unknown mode {mode!r}: own, legacy")
    d = distance_vector(points, centers, vector, "_d")
    own = (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
    rows = d.select(own.alias("_own"), F.posexplode("_d").alias("_c", "_v"))
    by = rows.groupBy("_c").agg(F.avg("_v").alias("_mean"), F.avg(F.when(F.col("_c") == F.col("_own"), 1.0).otherwise(0.0)).alias("_share"))
    return by.agg(F.sum(F.col("_mean") * F.col("_share")).alias("sigma"))


def encode(points: DataFrame, centers: DataFrame, sigma: DataFrame, vector: str = "x", out: str = "code") -> DataFrame:
    """Add the Gaussian soft assignment to every centre, as an array. sigma: one row."""
    d = distance_vector(points, centers, vector, "_d").crossJoin(F.broadcast(sigma.select(F.col("sigma").alias("_sigma"))))
    return d.withColumn(out, F.transform("_d", lambda v: soft_assignment(v, F.col("_sigma")))).drop("_d", "clusters", "_sigma")


def flatten_codes(codes: DataFrame, item: str, order: str, code: str = "code", out: str = "code") -> DataFrame:
    """One row per item: its rows' codes one after another, by `order`."""
    return codes.groupBy(item).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(code).alias("c")))), lambda s: s["c"])).alias(out))


def unflatten(flat: DataFrame, item: str, width: int, code: str = "code") -> DataFrame:
    """The way back: item, l, code, with `width` entries a row."""
    steps = F.sequence(F.lit(0), (F.size(code) / width).cast("int") - 1)
    return flat.select(item, F.posexplode(F.transform(steps, lambda i: F.slice(code, i * width + 1, width))).alias("l", "code"))


def spectra_vectors(long: DataFrame, item: str, order: list[str], value: str, out: str = "x") -> DataFrame:
    """Vectors from long form: values by the order columns."""
    key = F.struct(*order, F.col(value).alias("_v"))
    return long.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["_v"]).alias(out))


# ---- k-means --------------------------------------------------------------------------------------------------------


def lloyd_step(points: DataFrame, centers: DataFrame, vector: str = "x") -> DataFrame:
    """Centres after one step; a centre without points stays where it is. Sums are combined before the shuffle."""
    own = assign(points, centers, vector).select("cluster", F.posexplode(vector).alias("dim", "_v"))
    mean = own.groupBy("cluster", "dim").agg(F.avg("_v").alias("_m"))
    moved = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "_m"))), lambda s: s["_m"]).alias("_new"))
    return centers.join(moved, "cluster", "left").select("cluster", F.coalesce("_new", "center").alias("center"))


def _table(spark, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def lloyd(points: DataFrame, centers: DataFrame, steps: int, vector: str = "x", still: float | None = None) -> DataFrame:
    """Steps from given centres: as many as told, or fewer if no component of any centre moves by more than `still`. After each step the few centres come to the driver, which ends the lineage."""
    held = [(r.cluster, list(r.center)) for r in centers.orderBy("cluster").collect()]
    for _ in range(steps):
        before, held = held, [(r.cluster, list(r.center)) for r in lloyd_step(points, _table(points.sparkSession, held), vector).orderBy("cluster").collect()]
        if still is not None and max((abs(p - q) for (_, u), (_, v) in zip(before, held, strict=True) for p, q in zip(u, v, strict=True)), default=0.0) <= still:
            break
    return _table(points.sparkSession, held)


def seeds(points: DataFrame, k: int, key: str, vector: str = "x", seed: int = 42) -> DataFrame:
    """Centres to begin with: cluster, center. The first is a random point, each further one a point drawn by its squared distance to the nearest so far.

    A draw is a race: each point's time is exponential with that distance as its rate, from a hash of seed, round and key, and the least time wins. So
    a round is one sum over the points, and the same points win on any partitioning; equal times go by key. Fewer distinct points give fewer centres.
    """
    rows, chosen = points.select(F.col(key).alias("key"), F.col(vector).alias("x")).where(F.col(vector).isNotNull()), []
    for j in range(k):
        rate = F.lit(1.0)
        if chosen:
            near = F.lit(None).cast("double")
            for c in chosen:
                near = F.least(near, F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
            rate = near
        time = -F.log(hashed_uniform(seed, F.lit(j), "key")) / rate
        won = rows.where(rate > 0).agg(F.min(F.struct(time.alias("t"), "key", "x")).alias("w")).first().w
        if won is None:
            break
        chosen.append([float(v) for v in won.x])
    return _table(points.sparkSession, list(enumerate(chosen)))


def kmeans(points: DataFrame, k: int, vector: str = "x", seed: int = 42, steps: int = 100, key: str | None = None, still: float = 1e-12) -> DataFrame:
    """Centres of k-means: cluster, center. Drawn seeds, then Lloyd steps until nothing moves. key: what tells points apart; without it, the vector."""
    from spectramesh.sources.tables import written

    # Every round reads the points; what they are made from is computed once.
    named = written(points.select(F.col(vector).alias("x"), (F.col(key) if key else F.to_json(F.struct(vector))).alias("key")), "points")
    return lloyd(named, seeds(named, k, "key", "x", seed), steps, "x", still)


def exemplars(points: DataFrame, centers: DataFrame, key: str, vector: str = "x", order: list[int] | None = None) -> DataFrame:
    """cluster, key, d: the point nearest to each centre, the smallest key of equals. order: clusters in the order of the rows, as `position`."""
    best = distances(points, centers, [key], vector).groupBy("cluster").agg(F.min(F.struct("d", key)).alias("_b")).select("cluster", F.col(f"_b.{key}"), F.col("_b.d").alias("d"))
    if order is None:
        return best
    place = F.array_position(F.array(*map(F.lit, order)), F.col("cluster")) - 1
    return best.where(F.col("cluster").isin(order)).withColumn("position", place.cast("int"))


# ---- decoding -------------------------------------------------------------------------------------------------------


def decode(codes: DataFrame, centers: DataFrame, method: str = "nearest", code: str = "code", out: str = "x", sigma: float | DataFrame | None = None, samples: DataFrame | None = None, sample_key: str = "id") -> DataFrame:
    """Spectra for codes (arrays with an entry per centre).

    nearest: the centre of the largest entry, the first of equals. weighted: centres weighted by entry over the sum plus 1e-8.
    nearest_sample: the sample (columns sample_key, code, x) with the nearest code, the smallest key of equals. sphere_intersection:
    the point whose distances to the centres are those that the entries stand for, by least squares.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
    if method == "nearest_sample":
        if samples is None:
            raise ValueError("nearest_sample needs samples")
        return decode_by_sample(codes, samples, sample_key, code, out)
    c = codes.crossJoin(F.broadcast(center_array(centers))).drop("clusters")
    if method == "nearest":
        return c.withColumn(out, F.get("centers", (F.array_position(code, F.array_max(code)) - 1).cast("int"))).drop("centers")
    if method == "weighted":
        total = F.aggregate(code, F.lit(0.0), lambda s, v: s + v) + F.lit(1e-8)
        zero = F.transform(F.get("centers", 0), lambda _: F.lit(0.0))
        mixed = F.aggregate(F.zip_with(code, "centers", lambda e, v: F.struct(e.alias("e"), v.alias("v"))), zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b * p["e"]))
        return c.withColumn("_t", total).withColumn(out, F.transform(mixed, lambda v: v / F.col("_t"))).drop("centers", "_t")
    if sigma is None:
        raise ValueError("sphere_intersection needs sigma")
    from spectramesh.kernels.embed import intersect_spheres

    one = sigma.select(F.col("sigma").alias("_sigma")) if isinstance(sigma, DataFrame) else c.sparkSession.createDataFrame([(float(sigma),)], "_sigma double")
    c = c.crossJoin(F.broadcast(one))
    return c.withColumn("_d", F.transform(code, lambda e: inverse_soft_assignment(e, F.col("_sigma")))).drop("_sigma").withColumn(out, intersect_spheres(F.col("centers"), F.col("_d"))).drop("centers", "_d")


#: Samples that a code is compared with at once.
SAMPLE_BLOCK = 1024


def decode_by_sample(codes: DataFrame, samples: DataFrame, key: str, code: str = "code", out: str = "x", block: int = SAMPLE_BLOCK) -> DataFrame:
    """Each code's nearest sample. Samples are packed into blocks, a row each, and a block's nearest is folded where code and block meet; the smallest of those is kept on the way into the shuffle.

    Codes get numbers in a written copy, since rows may be equal; the winner's vector is looked up afterwards.
    """
    from spectramesh.sources.tables import written

    s = samples.select(F.col(key).alias("_key"), F.col(code).alias("_code"), F.col("x").alias("_x"))
    parts = max(1, -(-s.count() // block))
    blocks = s.groupBy(F.pmod(F.xxhash64("_key"), F.lit(parts)).alias("_b")).agg(F.collect_list(F.struct("_key", "_code")).alias("_some")).select("_some")
    own = written(codes.withColumn("_row", F.monotonically_increasing_id()), "codes")

    def near(best, one):
        now = F.struct(euclidean(F.col(code), one["_code"]).alias("d"), one["_key"].alias("k"))
        return F.least(best, now)

    start = F.lit(None).cast(f"struct<d:double,k:{samples.schema[key].dataType.simpleString()}>")
    pairs = own.select("_row", code).crossJoin(blocks).select("_row", F.aggregate("_some", start, near).alias("_n"))
    best = pairs.groupBy("_row").agg(F.min("_n").alias("_n")).select("_row", F.col("_n.k").alias("_key"))
    return own.join(best, "_row").join(s.select("_key", "_x"), "_key").drop("_row", "_key").withColumnRenamed("_x", out)


def stack_with_centers(points: DataFrame, centers: DataFrame, vector: str = "x") -> DataFrame:
    """Points and centres in one table, told apart by `kind` (data, center), with an `id` each."""
    return points.select(F.lit("data").alias("kind"), F.col("id").cast("long").alias("id"), F.col(vector).alias("x")).unionByName(centers.select(F.lit("center").alias("kind"), F.col("cluster").cast("long").alias("id"), F.col("center").alias("x")))


# ---- the whole extractor --------------------------------------------------------------------------------------------


@dataclass
class SpectralFeatures:
    """Parameters of the two-level clustering of spectra: words of single bands, then clusters of whole items."""

    n_words: int = 8
    n_clusters: int = 5
    seed: int = 42
    offset: float = 1e-10
    steps: int = 100

    def preprocess(self, spectra: DataFrame, value: str = "power") -> DataFrame:
        """spectra: id, l, t, value. Adds `log`."""
        return spectra.withColumn("log", F.log(F.col(value) + F.lit(self.offset)))

    def words(self, spectra: DataFrame, centers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(codes: id, l, code; centers; sigma; scaler) of a table id, l, t, log: scale each t, cluster the bands, encode softly."""
        from spectramesh.operators import scaling

        rows = spectra.groupBy("id", "l").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "log"))), lambda s: s["log"]).alias("raw"))
        scaler = scaling.fit_array_scaler(rows, "raw")
        x = scaling.scale_array(rows, scaler, "raw", "x").drop("raw")
        centers = kmeans(x.withColumn("_key", F.concat_ws(":", "id", "l")), self.n_words, "x", self.seed, self.steps, key="_key") if centers is None else centers
        sigma = bandwidth(x, centers)
        return encode(x, centers, sigma).drop("x"), centers, sigma, scaler

    def clusters(self, codes: DataFrame, centers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(id, code, cluster, distance; centers) of the flattened codes."""
        flat = flatten_codes(codes, "id", "l")
        centers = kmeans(flat, self.n_clusters, "code", self.seed, self.steps, key="id") if centers is None else centers
        return assign(flat, centers, "code"), centers

    def fit_transform(self, spectra: DataFrame, value: str = "power", method: str = "pca", components: int = 2) -> tuple[DataFrame, DataFrame]:
        """(id, cluster, y ...; centers) : preprocess, words, clusters, and a low-dimensional embedding of the items."""
        from spectramesh.operators.embedding import reduce_dimensions

        codes, *_ = self.words(self.preprocess(spectra, value))
        found, centers = self.clusters(codes)
        low = reduce_dimensions(found.select("id", F.col("code").alias("x")), centers, method, components, self.seed)
        return found.join(low.where("kind = 'data'").drop("kind", "x"), "id"), centers

