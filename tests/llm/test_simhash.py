"""Fingerprints, index and components against plain loops; near-duplicates against exact Jaccard."""

import random
import re

import numpy as np
import pytest
import xxhash

from spectramesh.llm import simhash as S
from spectramesh.llm.components import components

DOCS = "doc_id bigint, text string, fp string, component_id string"


def plain_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    vocab = [f"Wörd{i}" for i in range(50)]
    texts = [None, "", " \t\n", "One", "one two", "a b c", "A b\tC", "x" * 3000 + " y z q"]
    for _ in range(40):
        base = rng.choices(vocab, k=rng.choice([4, 80, 700]))
        texts.append(" ".join(base))
        for _ in range(2):
            base[rng.randrange(len(base))] = "edit"
            texts.append(" ".join(base))
    got = {r.doc_id: r for r in S.link_documents(spark.createDataFrame([(i, t, "?", "?") for i, t in enumerate(texts)], DOCS)).collect()}
    fps = [plain_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [format(f, "016x") for f in fps]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[i].component_id for i in range(len(texts))] == want


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c", "", ""), (4, "a b c", "", ""), (4, "a b c", "", ""), (None, "only here and nowhere else", "", "")], DOCS)
    got = S.link_documents(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert S.link_documents(df.limit(0)).count() == 0


def planted(n, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n).astype(np.uint64)
    for i in range(0, n - spread, spread):
        for k in range(1, spread):
            x[i + k] = x[i + k - 1]
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x[i + k] ^= np.uint64(1) << np.uint64(b)
    return np.unique(x)


@pytest.mark.parametrize("hot", [10**6, 3])
def test_links_are_complete(spark, hot):
    x = np.unique(np.concatenate([planted(500, 1, 5), np.uint64(0xABCD) + (np.arange(60, dtype=np.uint64) << np.uint64(20))]))
    table = spark.createDataFrame([(S.signed(int(v)), i) for i, v in enumerate(x)], "fp bigint, rep bigint")
    links = S.fingerprint_links(table, hot=hot)
    found = {r.node: r.component for r in components(links).collect()}
    want = roots(len(x), [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3).tolist()])
    assert [found.get(i, i) for i in range(len(x))] == want
    assert all((int(x[a]) ^ int(x[b])).bit_count() < 64 for a, b in links.collect())


def test_gray_index():
    x = planted(3000, 4, 3)
    g = (x % np.uint64(7)).astype(np.int64)
    order = np.lexsort((S.gray_rank(x), g))
    x, g = x[order], g[order]
    index = S.GrayIndex(x, g)
    q, m = index.search(x, g, 3)
    got = set(zip(q.tolist(), m.tolist()))
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero((np.bitwise_count(x ^ x[i]) <= 3) & (g == g[i])).tolist()}
    assert got == want
    assert (S.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)) == np.arange(8)).all()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 480)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots(500, pairs)
    assert all(got.get(i, i) == want[i] for i in range(500))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    line = " ".join(rng.choices(vocab, k=30))
    texts = []
    for k in range(60):
        base = rng.choices(vocab, k=rng.choice([3, 40, 150, 900, 4000]))
        texts.append(" ".join(base) + " " + line * (k % 3 == 0))
        for edits in (0, len(base) // 100, len(base) // 20):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    jac = lambda a, b: len(a & b) / len(a | b)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jac(sets[i], sets[j]) >= 0.8]
    want = roots(len(texts), near)
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert all(want[i] == got.get(i, i) for i in range(len(texts)))
    kept = S.keep_one(df.unionByName(df.where("doc_id = 1")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def brute(texts):
    """Components of all pairs with a similarity of 0.8, each pair compared."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    return roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def test_reach_loses_no_pair():
    """The first shingles of two alike sets share one, in any order of the shingles."""
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        for _ in range(20):
            x, y = (np.unique(np.concatenate([base[: n - c], rng.integers(0, 2**63, c).astype(np.uint64)])) for c in rng.integers(0, n // 4 + 1, 2))
            if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
                assert set(x[: S.reach(len(x), 0.8)].tolist()) & set(y[: S.reach(len(y), 0.8)].tolist())


@pytest.mark.parametrize("common, most", [(64, 1_000_000), (3, 1_000_000), (3, 5)])
def test_common_passages_and_small_broadcasts(spark, common, most):
    """Passages that most documents share, copies, near copies and empty texts; with every shared shingle called common, and hardly a table broadcast."""
    rng = random.Random(21)
    vocab = [f"p{i}" for i in range(4000)]
    passage, texts = rng.choices(vocab, k=60), []
    for k in range(90):
        base = rng.choices(vocab, k=rng.choice([10, 30, 120])) + passage * (k % 2)
        for edits in (0, 0, 1, 2):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    texts += ["", None, " ", "one", "one", "two"]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, common=common, most=most).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == brute(texts)


def test_repeated_keys_with_other_texts(spark):
    """A repeated key drops no text of its own, whatever the table's other columns are called."""
    long, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, long, "x"), (1, other, "x"), (2, long, "y"), (2, "quite something else", "y"), (None, long, "z"), (3, other + " c", "w")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, _row string"))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, long), (1, long), (1, other), (2, "quite something else")])


def test_fine_counters_lose_no_pair():
    """Documents of any sizes, and counters that don't fit a byte."""
    rng = np.random.default_rng(8)
    for n in (3, 80, 300, 5000, 9000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.7, 0.85, 0.95):
            y = np.unique(np.concatenate([base[: int(n * share)], rng.integers(0, 2**63, int(n * (1 - share) / 3)).astype(np.uint64)]))
            if len(np.intersect1d(base, y)) >= 0.8 * len(np.union1d(base, y)):
                assert S.may_be_alike(S.fine_counts(base), S.fine_counts(y), 0.8)
    same = np.arange(1000, dtype=np.uint64)  # all in one counter
    assert S.may_be_alike(S.fine_counts(same), S.fine_counts(same[:900]), 0.8)
    far = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2)]
    assert not S.may_be_alike(*map(S.fine_counts, far), 0.8)


def test_keys_of_any_size(spark):
    rows = [((1 << 62) + 5, "a b c"), ((1 << 62) + 6, "a b c"), (-(1 << 63), "x y z q"), ((1 << 63) - 1, "x y z q"), ((1 << 63) - 2, "k l m n")]
    got = {r.doc_id: r.component_id for r in S.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1 << 62) + 5: (1 << 62) + 5, (1 << 62) + 6: (1 << 62) + 5, -(1 << 63): -(1 << 63), (1 << 63) - 1: -(1 << 63), (1 << 63) - 2: (1 << 63) - 2}


def test_components_with_hardly_a_broadcast(spark):
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 200)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), most=3).collect()}
    assert [got.get(i, i) for i in range(400)] == roots(400, pairs)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    vocab = [f"u{i}" for i in range(5000)]
    base = rng.choices(vocab, k=300)
    texts = [" ".join(base)]
    for _ in range(400):
        other = list(base)
        for _ in range(4):
            other[rng.randrange(300)] = rng.choice(vocab)
        texts.append(" ".join(other))
    rng.shuffle(texts)
    got = S.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.component_id for r in got} == {0} and len(got) >= 0.99 * len(texts)


def test_majority_of_many():
    h = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert S.majority(h) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > 1000)


def test_empty_near(spark):
    df = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0
    some = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (None, "a", "", ""), (None, "a", "", "")], DOCS)
    assert sorted(r.doc_id or 0 for r in S.keep_one(some).collect()) == [0, 0, 1]


def test_large_group_without_its_original(spark):
    """No member is near all others: links between non-pivots decide, and they are those of a comparison of all pairs."""
    rng = random.Random(12)
    vocab = [f"t{i}" for i in range(5000)]
    texts = []
    for group in range(4):
        base = rng.choices(vocab, k=200)
        for _ in range(150):
            other = list(base)
            for at in rng.sample(range(200), rng.choice([2, 3, 4])):
                other[at] = rng.choice(vocab)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_cells_lose_no_pair():
    """All pairs of different components and enough similarity come out of a cell, of one block or of two."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    made = [np.unique(np.concatenate([rng.choice(base, 54, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)])) for _ in range(40)]
    counts, sizes = np.array([np.frombuffer(S.shingle_counts(h), np.uint8) for h in made]), np.array([len(h) for h in made])
    sets, ids, parts = [set(h.tolist()) for h in made], np.arange(100, 140), np.arange(40) % 7
    for side in (np.zeros(40, int), np.arange(40) % 2):
        got = set(S.crossing(ids, parts, side, counts, sizes, 0.8, False))
        want = {(100 + i, 100 + j) for i in range(40) for j in range(i) if parts[i] != parts[j] and (side[i] != side[j] or not side.any()) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert want and want <= got and all(parts[a - 100] != parts[b - 100] for a, b in got)
        assert set(S.crossing(ids, parts, side, counts, sizes, 0.8, True)) <= got
