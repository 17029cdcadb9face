"""Multiset fingerprints: the law of sums, and the query against a plain loop."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectramesh.llm import multiset as M

SCHEMA = "doc_id bigint, text string, part int, kind string, print string"
some = st.lists(st.text(alphabet=st.sampled_from("ab c\té  "), max_size=60), max_size=6)


@settings(max_examples=60, deadline=None)
@given(some, some)
def test_law_of_sums(a, b):
    """Order doesn't count; inserting and deleting are inverse; paragraphs add up."""
    whole = M.vector(a + b)
    assert (whole == M.vector(b + a)).all()
    assert (M.insert(M.vector(a), b) == whole).all()
    assert (M.delete(whole, b) == M.vector(a)).all()
    assert M.likeness(whole, whole) == 1.0 and 0 <= M.likeness(M.vector(a), M.vector(b)) <= 1


def test_runs_are_exact_counts():
    line = " ".join(f"w{i % 50}" for i in range(200))
    text = [line, "two words", "", "x" * 100, line]
    runs = M.runs([t.encode() for t in text])
    assert len(runs) == 2 * 196 + 5 + 96
    want = np.zeros(M.SKETCH, int)
    for h in runs:
        for k in range(M.SKETCH // 64):
            word = int(M._mix(np.array([h + np.uint64(k)]))[0])
            want[64 * k : 64 * k + 64] += [1 if word >> j & 1 else -1 for j in range(64)]
    assert (M.signs(runs) == want).all()
    many = np.tile(runs, 200)  # more than are unpacked at once
    assert (M.signs(many) == 200 * want).all()


def brute(rows):
    """Each document with its follower, by key (nulls first), then by the hash and the text."""
    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    texts = sorted(((k is not None, k or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), (t or "").encode(), k, t or "") for k, t, *_ in rows), key=lambda r: r[:4])
    out = []
    for i, r in enumerate(texts):
        text, after = r[5], texts[(i + 1) % len(texts)][5]
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        a, e, n = M.fingerprint(text), M.fingerprint(new), M.fingerprint(after)
        out.append((r[4], len(text), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), e.tobytes().hex(), M.likeness(a, e), M.likeness(a, n)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_query(spark, parts):
    rng = random.Random(4)
    words = [f"w{i}é" for i in range(80)]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))), 1, "k", "p") for i in range(120)]
    rows += [(200 + i, rows[5][1], 1, "k", "p") for i in range(30)]
    rows += [(300, None, 0, "", ""), (301, "", 0, "", ""), (302, "\n\n", 0, "", ""), (303, "abc", 0, "", ""), (304, "🎉" * 50, 0, "", ""), (305, "long text here " * 60000, 0, "", ""), (306, "x" * 500_000, 0, "", "")]
    rows += [(7, "another\ntext", 0, "", ""), rows[7], rows[7], (None, "no key\nhere", 0, "", ""), (None, None, 0, "", "")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = M.fingerprint_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_document_and_none(spark):
    one = [(5, "all alone\nin the table", 0, "", "")]
    assert sorted(map(tuple, M.fingerprint_documents(spark.createDataFrame(one, SCHEMA)).collect())) == brute(one)
    assert M.fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_likeness_tells_edits(spark, data):
    """A text is nearer to its edited self than to the next text, but for very short ones."""
    found = M.fingerprint_documents(spark.read.parquet(f"{data}/documents.parquet")).collect()
    long = [r for r in found if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next or r.near_next == 1 for r in long) >= 0.99 * len(long)
    assert 0.6 < np.mean([r.near_edited for r in long]) < 0.9 and np.mean([r.near_next for r in long]) < 0.2
    by_text = {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
