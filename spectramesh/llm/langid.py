"""Language identification by averaged hashed subword embeddings with a linear softmax (operator 3).

A text's subwords are the byte n-grams of its lower-cased words, with a mark at either end of a word. Each hashes to a row of an
embedding table; their mean goes through a linear softmax. Table and weights are trained by stochastic gradient descent in
numpy on a bounded sample. As mean and softmax input are both linear, a prediction needs only the table's product with the
weights: a few numbers per bucket.

Probabilities are calibrated by a temperature on held-back documents of the sample. A softmax always prefers some language, so what
rejects is familiarity: the mean log frequency of a text's subwords in the sample. A text is rejected if it has no letter, or if it
is less familiar than the threshold, which lies midway between the `reject_share` quantile of the sample's documents (each
without its own share of the counts, so that all of them count as held back) and the median of the same texts with shuffled letters.

Null, empty and letterless texts: `und`, score 0, rejected. No labelled document at all: `und` and score 0 for every text,
rejected only where it has no letter. A null lang is no label. Equal texts get equal predictions. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectramesh.llm.common import bounded_sample, crc_mod, give_back, ship

#: The sample's bound: labelled documents that training reads, and the bytes that it reads of each (evenly spaced stretches).
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 2000
BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Standard deviations by which a short text may lie below the threshold, and the characters of the short pieces that the temperature is set by.
SLACK, SHORT = 1.0, 40
UND = "und"
_keep = np.zeros(256, bool)
_keep[ord("a") : ord("z") + 1] = True
_keep[0x80:] = True


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams within words, and the byte at which each begins. data: lower-cased UTF-8."""
    inside = np.concatenate([[False], _keep[data], [False]])
    x = np.where(inside, np.concatenate([[0], data, [0]]), 32).astype(np.uint32)
    # A word's marks are the blanks around it; an n-gram may hold a blank only at its ends, and one letter at least.
    buckets, places = [], []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool) if n > 2 else inside[:m] | inside[1 : m + 1]
        h = np.full(m, 2166136261 + n, np.uint32)
        for k in range(n):
            if 0 < k < n - 1:
                ok &= inside[k : k + m]
            h = (h ^ x[k : k + m]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
        at = np.flatnonzero(ok)
        buckets.append((h[at] ^ (h[at] >> np.uint32(16))) & np.uint32(BUCKETS - 1))
        places.append(at)
    return (np.concatenate(buckets), np.concatenate(places)) if buckets else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _lower(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def _parts(data: np.ndarray, most: int) -> list[np.ndarray]:
    """A text cut between words into parts of `most` bytes or little more."""
    if len(data) <= most:
        return [data]
    gaps = np.flatnonzero(~_keep[data])
    cuts = np.unique(gaps[np.minimum(np.searchsorted(gaps, np.arange(most, len(data), most)), len(gaps) - 1)]) if len(gaps) else []
    return np.split(data, cuts)


@dataclass
class LanguageModel:
    """langs: learned values, sorted; table: bucket x language; bias; temperature; familiar: log frequency by bucket; threshold of familiarity for long
    texts, and how far single subwords spread around it: a mean over n of them is allowed to lie SLACK * spread / sqrt(n) lower."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    familiar: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    threshold: float = -np.inf
    spread: float = 0.0

    def logits(self, texts: list[str], most: int = 1 << 18) -> np.ndarray:
        """Mean of the subwords' rows, plus bias; about `most` bytes are worked on at once, however long a text is."""
        return self.measure(texts, most)[0]

    def measure(self, texts: list[str], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits and familiarity of each text (0 without subwords), and its number of subwords."""
        sums, known, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            lengths = np.array([len(d) + 1 for _, d in held])
            joined = np.concatenate([x for _, d in held for x in (d, _blank)])
            b, at = subwords(joined)
            # A place before the shift by the leading mark belongs to the text that holds the n-gram's second byte.
            owner = np.repeat([i for i, _ in held], lengths)[np.minimum(at, len(joined) - 1)]
            counts[:] += np.bincount(owner, minlength=len(texts))
            known[:] += np.bincount(owner, self.familiar[b], minlength=len(texts))
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(owner, self.table[:, c][b], minlength=len(texts))
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            for part in _parts(_lower(t), most):
                if size + len(part) > most and held:
                    add()
                    size = 0
                held.append((i, part))
                size += len(part) + 1
        if held:
            add()
        return sums / np.maximum(counts, 1)[:, None] + self.bias, known / np.maximum(counts, 1), counts

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, rejected of each text."""
        some = [t or "" for t in texts]
        empty = np.array([not _letter(t) for t in some])
        if not self.langs:
            return pd.DataFrame({"lang_pred": UND, "score": 0.0, "rejected": empty}, index=range(len(some)))
        z, known, counts = self.measure(some)
        p = softmax(z / self.temperature) if some else np.zeros((0, len(self.langs)))
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        top = np.where(empty, 0.0, p.max(1) if len(p) else 0.0)
        return pd.DataFrame({"lang_pred": np.where(empty, UND, np.array(self.langs, object)[best]), "score": np.clip(top, 0, 1), "rejected": empty | (known < self.threshold - SLACK * self.spread / np.sqrt(np.maximum(counts, 1)))})


_blank = np.array([32], np.uint8)
_ascii = re.compile("[A-Za-z]")


def _letter(text: str) -> bool:
    return bool(_ascii.search(text)) or any(c.isalpha() for c in text)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def stretches(text: str, most: int = SAMPLE_BYTES, pieces: int = 4) -> list[str]:
    """Evenly spaced stretches of a text, `most` characters together; the whole of a shorter text."""
    if len(text) <= most:
        return [text]
    n = most // pieces
    return [text[i : i + n] for i in np.linspace(0, len(text) - n, pieces).astype(int)]


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters dealt anew over words of the same lengths."""
    found = text.split()
    letters = "".join(found)
    line, cuts = "".join(letters[i] for i in rng.permutation(len(letters))), np.cumsum([0, *map(len, found)]).tolist()
    return " ".join(line[a:b] for a, b in zip(cuts, cuts[1:]))


def familiarity(texts: list[str], reject_share: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """Log frequency of each bucket in the texts, the threshold below which a long text is rejected, and the standard deviation of single subwords.

    Of fewer texts than it takes to hold one beyond the quantile, the least familiar one counts. Where shuffled texts are not below
    that, nothing can be told by familiarity and nothing is rejected for it.
    """
    parts, counts = [], np.zeros(BUCKETS, np.int64)
    for t in texts:
        parts.append(np.concatenate([subwords(_lower(s))[0] for s in stretches(t)]).astype(np.uint16))  # BUCKETS values
        counts += np.bincount(parts[-1], minlength=BUCKETS)
    total = int(counts.sum()) + BUCKETS
    table = (np.log(counts + 1.0) - np.log(total)).astype(np.float32)
    clean = []
    for b in parts:
        if len(b):
            ids, own = np.unique(b, return_counts=True)
            clean.append(float((own * np.log((counts[ids] - own + 1.0) / (total - len(b)))).sum() / len(b)))
    mixed = (subwords(_lower(shuffled(stretches(t)[0], rng)))[0] for t in texts)
    noise = [float(table[b].mean()) for b in mixed if len(b)]
    if not clean or not noise:
        return table, -np.inf, 0.0
    low = float(np.quantile(clean, reject_share)) if len(clean) * reject_share >= 1 else min(clean)
    middle = float(np.median(noise))
    share = counts / max(1, counts.sum())
    spread = float(np.sqrt(max(0.0, (share * table**2).sum() - (share * table).sum() ** 2)))
    return table, (low + middle) / 2 if middle < low else -np.inf, spread


def temperature(model: LanguageModel, held: list[tuple[str, str]], rng: np.random.Generator) -> float:
    """The temperature of least mean loss over held-out texts, a short piece of each, and a short piece with shuffled letters, which is of no language.

    Texts alone would be told so surely that ever lower temperatures seem better.
    """
    y = np.array([model.langs.index(v) for _, v in held])
    begin = [int(rng.integers(0, max(1, len(t) - SHORT))) for t, _ in held]
    pieces = [t[a : a + SHORT] for (t, _), a in zip(held, begin, strict=True)]
    whole, short, noise = (model.logits(x) for x in ([t for t, _ in held], pieces, [shuffled(t, rng) for t in pieces]))

    def loss(t: float) -> float:
        told = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for z in (whole, short)]
        return float(sum(told) - np.log(np.maximum(softmax(noise / t), 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 81))
    return float(min(grid, key=loss))


def train(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 0.5, reject_share: float = 0.0005, seed: int = 1) -> LanguageModel:
    """Fit on four of five documents and calibrate on the fifth. The order of the rows doesn't matter."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    pairs = [(t, y) for t, y in zip(texts, labels, strict=True) if _letter(t)]
    langs = sorted({y for _, y in pairs})
    if not langs:
        return LanguageModel()
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(pairs)) % 5
    held = [pairs[i] for i in range(len(pairs)) if part[i] == 0] if len(pairs) >= 50 else pairs
    fit = [pairs[i] for i in range(len(pairs)) if part[i] != 0] if len(pairs) >= 50 else pairs
    examples = []  # distinct subwords of a stretch, their shares, and its language
    for t, y in fit:
        for s in stretches(t):
            if _letter(s):
                ids, counts = np.unique(subwords(_lower(s))[0], return_counts=True)
                examples.append((ids, counts / counts.sum(), langs.index(y)))
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(examples)):
            ids, shares, y = examples[i]
            rows = e[ids]
            mean = shares @ rows
            g = softmax((mean @ w + bias)[None])[0]
            g[y] -= 1
            back = w @ g
            w -= step * np.outer(mean, g)
            bias -= step * 0.1 * g
            rows -= np.outer((step * 20) * shares, back)
            e[ids] = rows
    del examples
    model = LanguageModel(langs, (e @ w).astype(np.float32), bias)
    model.temperature = temperature(model, held, rng)
    model.familiar, model.threshold, model.spread = familiarity([t for t, _ in pairs], reject_share, rng)
    return model


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, **settings) -> LanguageModel:
    """Train on a bounded sample of the rows with a label."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    some = bounded_sample(rows.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")), "k", sample_rows, rows.select(key).count())
    # Long documents are cut into the stretches that training reads before they leave the executors.
    cut = F.when(F.length("text") > 4 * SAMPLE_BYTES, F.concat_ws(" ", *(F.substr("text", (F.length("text") * i / 4 + 1).cast("int"), F.lit(SAMPLE_BYTES)) for i in range(4)))).otherwise(F.col("text"))
    found = some.select(F.coalesce(cut, F.lit("")).alias("text"), "lang").toPandas()
    model = train(found["text"].tolist(), found["lang"].tolist(), **settings)
    del found
    give_back()
    return model


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predictor(df: DataFrame, model: LanguageModel):
    """A column function: text -> struct(lang_pred, score, rejected). The model is about a megabyte and is sent once per executor."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for s in parts:
            yield m.predict(s.tolist())
        give_back()

    return predict


def held_out(key: str, parts: int, which: int) -> Column:
    return F.coalesce(crc_mod(key, parts) == which, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents whose crc32(key) mod 3 isn't 1 and predict all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(key, 3, 1)), key, text, lang)
    return docs.select(F.col(key).alias("doc_id"), held_out(key, 3, 1).alias("held_out"), predictor(docs, model)(F.col(text)).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the model doesn't reject, with their columns as they are."""
    model = fit(docs.where(~held_out(key, 3, 1)), key, text, lang)
    return docs.where(~predictor(docs, model)(F.col(text))["rejected"])


