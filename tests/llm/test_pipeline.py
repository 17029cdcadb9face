"""The pipeline's stages take effect and keep clean documents whole."""

import corpus_pipeline as P

import random

from spectramesh.llm import decontaminate, langid, simhash, toxicity


def test_stages(spark, data):
    clean = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(60)) for _ in range(20)]
    docs = clean.unionByName(spark.createDataFrame([(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], clean.schema))
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    now, left = docs, [docs.count()]
    for k, (_, f) in enumerate(P.STAGES[:-1]):
        before = {r.doc_id for r in now.select("doc_id").collect()}
        path = f"{langid.__name__}-{k}"
        out = f(spark, now, data)
        assert out.columns == docs.columns, path
        now = out.cache()
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= before
        left.append(len(after))
        if k == 0:  # foreign text goes, the rest stays
            assert max(after) < 10**9 and len(after) >= 0.99 * clean.count()
    assert left[1] < left[0] and left[-1] > 0.5 * left[0]
    assert decontaminate.overlaps(now, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert simhash.near_duplicates(now).count() == 0
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    score = model.scorer()
    assert all(score(r.text) < 0.5 for r in now.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in now.collect())


def test_run(spark, data):
    got = P.run(spark, data)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert P.ORACLE_SQL is None


def test_hostile_tables(spark, data):
    """No documents at all; and null, empty, repeated and long rows with columns whose names clash with the stages' own."""
    clean = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size int, k string, rep bigint"
    kept = [(*r, 0.5, 1, "k", 7) for r in clean.collect()]
    first = next(r for r in kept if len(r[1]) > 400)
    odd = [(None, first[1] + " more words", "en", "s", 3, 0.0, 0, "", 0), (10**7, None, None, None, None, None, None, None, None), (10**7 + 1, "", "en", "", 0, 0.0, 0, "", 0), first, first, (first[0], "another text with the same key and other words in it", "en", "", 0, 0.0, 0, "", 0), (10**7 + 2, (first[1] + " ") * 300, "en", "", 0, 0.0, 0, "", 0)]
    for rows in ([], kept + odd):
        now = spark.createDataFrame(rows, schema)
        for k, (_, f) in enumerate(P.STAGES):
            out = f(spark, now, data)
            assert k == 4 or out.columns == now.columns
            now = out.cache()
        assert (now.count() == 0) == (not rows)
    ids = {r.doc_id for r in now.collect()}
    assert ids <= {r[0] for r in kept + odd} and 10**7 not in ids and len(ids) > 30
