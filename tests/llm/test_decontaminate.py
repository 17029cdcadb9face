"""Spaced seeds leave no tolerant overlap unseen, and hits are exactly those of a brute-force comparison."""

import itertools
import random
import re

import pytest

from spectramesh.llm import decontaminate as D

DOCS = "doc_id bigint, text string, words string, hash bigint"


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def brute(docs, items):
    out = set()
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            if len(b) < D.LEAST:
                continue
            w = min(D.WINDOW, len(b))
            allowed = 0 if w < D.TOLERANT else w // D.SHARE
            if any(sum(a[x + k] == b[y + k] for k in range(w)) >= w - allowed for x in range(len(a) - w + 1) for y in range(len(b) - w + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("size", range(D.LEAST, D.WINDOW + 1))
def test_masks_are_lossless(size):
    allowed = 0 if size < D.TOLERANT else size // D.SHARE
    for bad in itertools.combinations(range(size), allowed):
        assert any(all(o + p not in bad for p in m) for m in D.MASKS for o in range(size - m[-1]))


def fixture(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 5, 7, 8, 14, 15, 16, 30, 60])]
    items += [(100, None), (101, "")]
    docs = []
    for n in range(60):
        base = rng.choices(vocab, k=rng.choice([0, 5, 30, 200]))
        it = words(rng.choice(items)[1])
        for _ in range(rng.choice([0, 1, 3, 6])):
            if it:
                it[rng.randrange(len(it))] = rng.choice(vocab)
        at = rng.randrange(len(base) + 1)
        docs.append((n, " ".join(base[:at] + it + base[at:])))
    return docs, items


def test_repeated_keys_are_judged_row_by_row(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "a"), (1, "clean", "a"), (None, text, "b"), (None, "clean", "b"), (2, "clean", "c")]
    kept = D.remove_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string, _row string"), spark.createDataFrame([(1, text)], "item_id bigint, text string"))
    assert kept.columns == ["doc_id", "text", "_row"] and sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if r[1] == "clean"), key=repr)


def test_against_brute_force(spark):
    docs, items = fixture()
    got = D.overlaps(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_long_text_across_blocks(spark):
    item = [f"b{i}" for i in range(20)]
    rng = random.Random(3)
    for at in (D.BLOCK - 21, D.BLOCK - 10, D.BLOCK, 2 * D.BLOCK - 1):
        text = [f"f{rng.randrange(10**6)}" for _ in range(3 * D.BLOCK)]
        text[at : at + 20] = item
        got = D.overlaps(spark.createDataFrame([(1, " ".join(text), None, 0)], DOCS), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
        assert [(r.doc_id, r.item_id, r.matched, r.first_word) for r in got] == [(1, 7, 16, at)]


def test_edges(spark):
    item = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id bigint, text string")
    text = "ONE, two three four -- five six seven eight!"
    docs = spark.createDataFrame([(1, text, None, 0), (1, text, None, 0), (None, text, None, 0), (2, None, None, 0), (3, "", None, 0), (4, "one two three", None, 0)], DOCS)
    got = D.overlaps(docs, item).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (True, 0)]
    assert D.overlaps(docs.limit(0), item).count() == 0
    assert D.overlaps(docs, item.limit(0)).count() == 0
    kept = D.remove_contaminated(docs, item)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [2, 3, 4]  # the passage goes under a null key too


def test_short_shared_phrase_is_no_passage(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    b[10:18] = a[10:18]
    assert D.overlaps(spark.createDataFrame([(1, " ".join(b), None, 0)], DOCS), spark.createDataFrame([(1, " ".join(a))], "item_id bigint, text string")).count() == 0


def test_shortest_items_against_brute_force(spark):
    """Items of five to eight words, planted as they are at either end and in the middle."""
    rng = random.Random(5)
    vocab = [f"s{i}" for i in range(300)]
    items = [(n, " ".join(rng.choices(vocab, k=n))) for n in (4, 5, 6, 7, 8)]
    docs = []
    for _, t in items:
        for at in (0, 9, 20):
            base = rng.choices(vocab, k=20)
            docs.append((len(docs), " ".join([*base[:at], *words(t), *base[at:]])))
        docs.append((len(docs), t))
    got = D.overlaps(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert {r.doc_id for r in got if r.item_id == 5} == {4, 5, 6, 7} and all(r.matched == r.window for r in got if r.item_id < 8)


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_benchmark_beyond_a_broadcast(spark, most):
    """Without room for the seeds in a broadcast, and with hardly any for their hashes, the rows are the same; a frequent seed too."""
    docs, items = fixture(seed=3)
    items.append((9000, "never seen before by anyone here"))
    docs = docs + [(20_000 + i, "x never seen before by anyone here y") for i in range(60)] + [(None, "never seen before by anyone here")]
    a = spark.createDataFrame([(k, t, "", 0) for k, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, D.overlaps(a, b).collect()), key=repr)
    got = sorted(map(tuple, D.overlaps(a, b, most_seeds=0, most=most).collect()), key=repr)
    assert got == want and len(want) > 60
