"""Token files, their index and packing: exact round trips against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from spectramesh.llm import packing, tokens
from spectramesh.llm.queries import END_ID, vocabulary

FILE = vocabulary()
TEXTS = ["Hello, world", None, "", "don't  it's\n3.5", "İSTANBUL ΣΑΣ naïve", "<|endoftext|> a", "word " * 3000, "Hello, world", "a\x1cb\x85c\xa0d ª²½", "x" * 5000]
SCHEMA = "doc_id bigint, text string, ids string, part int"


@pytest.fixture(scope="module")
def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [END_ID], "<u4") for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(10 * i, t, "clash", 3) for i, t in enumerate(TEXTS)][::-1], SCHEMA)


def test_encoder_equals_library(expected):
    e = tokens.Encoder(FILE)
    for _ in range(2):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e([t or "" for t in TEXTS])] == [x[:-1].tolist() for x in expected]
    e.memo = dict.fromkeys(map(str, range(tokens.MEMO_WORDS + 1)), b"")
    e.hot = set()
    assert np.frombuffer(e(["Hello, world"])[0], e.dtype).tolist() == expected[0][:-1].tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabulary(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    e = tokens.Encoder(vocabulary(name))
    assert [np.frombuffer(x, e.dtype).tolist() for x in e(["Hello, world", ""])] == [t.encode(x, add_special_tokens=False).ids for x in ("Hello, world", "")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 30000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    index = tokens.KeyIndex.build(keys)
    assert sorted(index._slot(keys).tolist()) == list(range(len(keys)))
    assert (index.find(keys) == np.arange(len(keys))).all()
    absent = np.setdiff1d(np.random.default_rng(n + 1).integers(-(2**62), 2**62, 1000), keys)
    assert (index.find(absent) == -1).all()


def test_files_round_trip(spark, docs, expected):
    folder, manifest = tokens.write_files(docs, FILE, END_ID, file_tokens=4000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_files(manifest).collect()}
    start, want = 0, {}
    for i, x in enumerate(expected):
        want[10 * i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert got == want
    rows = manifest.orderBy("start").collect()
    assert all(a.last_key < b.first_key for a, b in zip(rows, rows[1:])) and all(r.path.startswith(folder) for r in rows)
    f = tokens.TokenFile(tokens.get_bytes(rows[0].path))
    assert f.get(0).tolist() == expected[0].tolist() and f.get(5) is None


def test_repeated_keys_and_empty_table(spark, docs):
    twice = docs.unionByName(docs.where("doc_id = 0"))
    _, manifest = tokens.write_files(twice, FILE, END_ID)
    got = [r for r in tokens.read_files(manifest).collect() if r.doc_id == 0]
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 4), (4, 4)]
    _, manifest = tokens.write_files(docs.limit(0), FILE, END_ID)
    assert tokens.read_files(manifest).count() == 0
    nobody = spark.createDataFrame([(None, "Hello, world", "", 0), (None, None, "", 0)], SCHEMA)
    _, manifest = tokens.write_files(docs.unionByName(nobody), FILE, END_ID)
    got = tokens.read_files(manifest).collect()
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == [1, 4] and next(r.start for r in got if r.doc_id == 0) == 5


def test_packing(spark, docs, expected):
    length = 64
    pieces = packing.pack(docs.repartition(3), FILE, END_ID, length, with_ids=True).cache()
    rows, per, seq = pieces.collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        x = expected[r.doc_id // 10]
        assert r.ids == x[r.start : r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(x)
        per[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    assert sorted(per) == [10 * i for i in range(len(TEXTS))]
    for parts, end in [(p, len(expected[d // 10])) for d, p in per.items()] + [(p, None) for p in seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == end if end is not None else at <= length
    total = sum(map(len, expected))
    assert sorted(seq) == list(range(-(-total // length))) and sum(sum(n for _, n in p) < length for p in seq.values()) <= 1
    made = packing.sequences(pieces, 0, length).collect()
    assert len(made) == len(seq) and all(len(r.ids) == length for r in made) and sum(r.n_tokens for r in made) == total
    assert packing.pack(docs.limit(0), FILE, END_ID).count() == 0


def test_keyed_access_by_ranges(spark, docs, expected):
    """Keys, absent keys, repeated and null ones are found in many files without reading a whole one."""
    twice = docs.unionByName(docs.where("doc_id = 0")).unionByName(spark.createDataFrame([(None, "Hello, world", "", 0)], SCHEMA))
    _, manifest = tokens.write_files(twice, FILE, END_ID, file_tokens=200)
    assert manifest.count() > 3
    keys = spark.createDataFrame([(10 * i,) for i in range(len(TEXTS))] + [(0,), (5,), (-1,), (10**9,), (None,)], "key bigint")
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.look_up(manifest, keys).collect()}
    assert got == {10 * i: x.tolist() for i, x in enumerate(expected)}
    assert tokens.look_up(manifest.limit(0), keys).count() == 0


def test_unlike_tokenizers_are_encoded_directly(tmp_path):
    """Another replacement or another kind of special token: texts aren't cut at blanks, or not where the token may stand."""
    import json

    spec = json.load(open(FILE))
    for change in (lambda d: d["normalizer"]["normalizers"][1].update(content="_"), lambda d: d["added_tokens"][0].update(content="[Start]")):
        new = json.loads(json.dumps(spec))
        change(new)
        (tmp_path / "t.json").write_text(json.dumps(new))
        e = tokens.Encoder(str(tmp_path / "t.json"))
        texts = ["a [start] b [Start] c", "some  plain text <|endoftext|> end", "x"]
        assert e(texts) == e.direct(texts)
