"""Toxicity by a factorization machine over hashed terms (operator 4).

A document's features are the distinct hashed terms of its whole text: its lower-cased words, and the words' first four and five
letters, which carry over to inflected forms that training never saw. The score is the logistic of

    bias + sum of w_i + 1/2 sum over f of ((sum of v_if)^2 - sum of v_if^2)

so that pairs of terms count that an additive model misses. Trained in numpy by AdaGrad on a bounded sample of labelled rows: first the
terms that tell the label by themselves or in pairs - pairs whose documents' labels differ from chance by more than either term's and more
than the best of as many random pairs would - then all terms of the sample on what those leave unexplained, so that every term that the sample
holds has a weight and factors.

Null and empty texts have no terms: their score is the logistic of the bias. Labels that are null or of unknown documents are no
labels. With no labels, or labels of one kind, the bias alone is learned. Several labels of one document: the largest
counts. Equal texts get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import bounded_sample, chunks, give_back, materialize, ship
from spectramesh.llm.langid import held_out

#: The sample's bounds: labelled documents whose terms training reads, terms that training begins with, and most frequent terms whose pairs are looked at.
SAMPLE_ROWS, TERMS, PAIR_TERMS = 12_000, 1 << 14, 2048
HASH, FACTORS, STEPS = 1 << 20, 4, 40_000
#: The phase of all terms: its rounds; a document of more terms shares its step, and one with a smaller gradient is explained already.
LATE, SHARED, LEFT = 6, 2, 0.1
MEMO_WORDS = 200_000
words = re.compile(r"[^\W\d_]+").findall


_caret = zlib.crc32(b"^")


def terms(word: str) -> list[int]:
    """The hashes of a word and, where it is longer, of its first four and five letters."""
    raw = word.encode()
    out = [zlib.crc32(raw) % HASH]
    if len(word) > 4:
        four, fifth = (raw[:4], raw[4:5]) if len(raw) == len(word) else (word[:4].encode(), word[4].encode())
        begin = zlib.crc32(four, _caret)
        out.append(begin % HASH)
        if len(word) > 5:
            out.append(zlib.crc32(fifth, begin) % HASH)
    return out


def term_ids(text: str | None, memo: dict[str, tuple[int, ...]], named=terms) -> np.ndarray:
    """The distinct terms of a text, ascending. named: what a word stands for; memo: of the words seen lately."""
    found = set(words((text or "").lower()))
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in found.difference(memo):
        memo[w] = tuple(named(w))
    every = set().union(*map(memo.__getitem__, found))
    out = np.fromiter(every, np.int64, len(every))
    out.sort()
    return out


@dataclass
class FactorizationMachine:
    """ids: hashes with a weight, ascending; w, v: their linear weights and factors."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    bias: float = 0.0

    def raw(self, columns: np.ndarray) -> float:
        v = self.v[columns]
        return self.bias + self.w[columns].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def scorer(self):
        """text -> score. Words that lead to no weight cost a look-up."""
        place, memo = dict(zip(self.ids.tolist(), range(len(self.ids)))).get, {}

        def known(word: str) -> list[int]:
            return [i for h in terms(word) if (i := place(h)) is not None]

        def score(text: str | None) -> float:
            return float(logistic(self.raw(term_ids(text, memo, known))))

        return score


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, rate: float = 0.1, decay: float = 2e-3, seed: int = 1, first: np.ndarray | None = None) -> FactorizationMachine:
    """docs: hashed terms of each document; labels: 0 or 1. AdaGrad, a document at a time, shuffled by a fixed seed.

    Without a number of epochs: six, or as many as it takes for STEPS steps. first: terms that are trained alone before all are.
    """
    labels = np.asarray(labels, float)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.01
    model = FactorizationMachine(bias=float(np.log(share / (1 - share))))
    if not len(docs) or labels.min() == labels.max():
        return model
    place = np.full(HASH, -1, np.int32)
    for d in docs:
        place[d] = 0
    model.ids = ids = np.flatnonzero(place == 0)
    place[ids] = np.arange(len(ids))
    rows = [place[d] for d in docs]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), FACTORS))
    gw, gv, gb = np.full(len(ids), 1e-8), np.full((len(ids), FACTORS), 1e-8), 1e-8
    bias = model.bias
    phases = [(rows, False)]
    if first is not None:
        early = np.isin(ids, first)
        phases = [([at[early[at]] for at in rows], False), (rows, True)]
    for now, shared in phases:
        for _ in range(epochs or (LATE if shared else max(6, -(-STEPS // len(now))))):
            for i in rng.permutation(len(now)):
                at, y = now[i], labels[i]
                vi = v[at]
                s = vi.sum(0)
                z = bias + w[at].sum() + 0.5 * float((s**2 - (vi**2).sum(0)).sum())
                g = (float(logistic(z)) - y) * (1.0 if y else 0.5)
                if abs(g) < (LEFT if shared else 1e-3):
                    continue
                # Among all its terms a document's step is shared, so that a long document doesn't move the sum more than a short one.
                step = rate * min(1.0, SHARED / len(at)) if shared and len(at) else rate
                own = g + decay * w[at]
                gw[at] += own**2
                w[at] -= step * own / np.sqrt(gw[at])
                own = g * (s - vi) + decay * vi
                gv[at] += own**2 + 1e-6
                v[at] -= 0.05 * step * own / np.sqrt(gv[at])
                gb += g * g
                bias -= rate * g / np.sqrt(gb)
    model.w, model.v, model.bias = w, v, float(bias)
    return model


def telling(rows: DataFrame) -> DataFrame:
    """h: the terms whose likelihood ratio between labels is beyond what the best of as many random terms would have.

    rows: y, ids. At most TERMS, those with the largest ratio.
    """
    total, hits = rows.select(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = rows.select("y", F.explode("ids").alias("h")).groupBy("h").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("k"))

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    p, n, k, t, c = hits / max(1, total), F.col("n"), F.col("k"), F.lit(float(total)), F.lit(float(hits))
    ratio = part(k, n * p) + part(n - k, n * (1 - p)) + part(c - k, (t - n) * p) + part(t - n - c + k, (t - n) * (1 - p))
    ranked = materialize(seen.select("h", ratio.alias("g")), "terms")
    return ranked.where(F.col("g") >= math.log(max(2, ranked.count()))).orderBy(F.desc("g"), "h").limit(TERMS).select("h")


def deviance(n: np.ndarray, k: np.ndarray, total: float, hits: float) -> np.ndarray:
    """How much less likely the labels are if documents with a term (n of them, k labelled) are like all others: a logarithm of a likelihood ratio."""
    n, k, p = n.astype(float), k.astype(float), hits / max(1.0, total)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    return part(k, n * p) + part(n - k, n * (1 - p)) + part(hits - k, (total - n) * p) + part(total - n - hits + k, (total - n) * (1 - p))


def paired(docs: list[np.ndarray], labels: np.ndarray, most: int = PAIR_TERMS) -> np.ndarray:
    """Terms of the pairs that tell the label beyond either of their terms, among the `most` most frequent terms of the sample."""
    labels = np.asarray(labels)
    if not len(docs) or labels.min() == labels.max():
        return np.zeros(0, np.int64)
    ids, n = np.unique(np.concatenate(docs), return_counts=True)
    keep = np.sort(ids[np.lexsort((ids, -n))[:most]])
    both, hits = (np.zeros((len(keep), len(keep)), np.float32) for _ in range(2))
    for c in range(0, len(docs), 1000):
        some = docs[c : c + 1000]
        at = np.searchsorted(keep, every := np.concatenate(some))
        row, known = np.repeat(np.arange(len(some)), [len(d) for d in some]), keep[np.minimum(at, len(keep) - 1)] == every
        x = np.zeros((len(some), len(keep)), np.float32)
        x[row[known], at[known]] = 1
        both += x.T @ x
        x = x[labels[c : c + 1000] > 0]
        hits += x.T @ x
    total, positive = float(len(docs)), float((labels > 0).sum())
    alone = deviance(both.diagonal(), hits.diagonal(), total, positive)
    limit, found = np.log(max(2.0, len(keep) * (len(keep) - 1) / 2)), []
    for i in range(len(keep) - 1):
        ratio = deviance(both[i, i + 1 :], hits[i, i + 1 :], total, positive)
        j = np.flatnonzero(ratio >= limit + np.maximum(alone[i], alone[i + 1 :])) + i + 1
        if len(j):
            found += [i, *j.tolist()]
    return keep[np.unique(np.array(found, np.int64))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Train on a bounded sample of the labelled rows whose crc32(key) mod 5 isn't 0.

    The sample's terms are counted in the executors; the driver gets each sampled document's terms. None is left out.
    """
    ship(docs.sparkSession)
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key, 5, 0)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    some = bounded_sample(rows, "k", sample_rows)
    # At most twice sample_rows keys and labels are sent to the scan of the texts.
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(some), "k").select("k", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in chunks(batches):
            ids = [term_ids(t, memo).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["k", "y", "ids"])

    found = materialize(joined.mapInArrow(run, "k bigint, y int, ids array<int>"), "sample")
    first = np.array([r.h for r in telling(found).collect()], np.int64)
    sample = found.toArrow().combine_chunks()
    order = np.argsort(sample.column("k").to_numpy(), kind="stable")
    # Documents are views of one array of four bytes a term.
    lists = sample.column("ids").chunk(0) if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows, y = [values[ends[i] : ends[i + 1]] for i in order], sample.column("y").to_numpy()[order]
    model = train(rows, y, first=np.union1d(first, paired(rows, y)))
    del sample, lists, values
    give_back()
    return model


def scorer(df: DataFrame, model: FactorizationMachine):
    """A column function: text -> score. The model has a few weights for each term of the bounded sample, HASH terms at most."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = sent.value.scorer()
        for s in parts:
            yield pd.Series([one(t) for t in s], dtype=float)
        give_back()

    return score


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, key, text, label)
    found = docs.select(F.col(key).alias("doc_id"), held_out(key, 5, 0).alias("held_out"), scorer(docs, model)(F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The documents with a score below a half, with their columns as they are."""
    model = fit(docs, labels, key, text, label)
    return docs.where(scorer(docs, model)(F.col(text)) < 0.5)
