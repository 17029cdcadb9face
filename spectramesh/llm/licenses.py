"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies (operator 7).

Words are runs of letters and digits of the lower-cased text, shingles five words (all of a shorter template). Texts of a chunk lie in one line of
words with marks between them that no template holds. For a template of T shingles, windows are two neighbouring blocks of as many
shingles as the next power of two from T - 1 on (four at least), so that any T shingles in a row lie wholly within one. A window's
signature has 64 minima, and each is a band of one row. A window that holds four fifths of the template's shingles has a Jaccard
similarity of 0.19 with it at least, or one in eight for a template of a single shingle, so the chance that no band meets is below
0.81^64 (about one in a million), or 0.875^64 (one in five thousand). Retrieved windows are then verified: the share of the template's
shingles that a stretch as long as the template holds must be `similarity` at least.

Null, empty and short texts hold no license. Repeated passages count once a template, with the best place, the first of equal ones. Equal
documents get equal rows. Documents with a null key come out with a null key. An empty table gives no rows. Other columns are ignored. Notices
of related licenses share most of their words, so a document may get a row for each; the largest containment tells which one it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import chunks, ship

HASHES, WORDS = 64, 5
#: The templates that the scan looks for (names by SPDX), notices in their usual short form.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Templates that a table of them may hold.
MOST_TEMPLATES = 10_000
_words = re.compile(r"[^\W_]+").findall


_odd = [(0x9E3779B97F4A7C15 * (2 * h + 1) ^ 0xBF58476D1CE4E5B9 << h % 7) & 0xFFFFFFFFFFFFFFFF | 1 for h in range(HASHES)]


def permuted(shingles: np.ndarray, h: int) -> np.ndarray:
    """One of HASHES orders of hashed shingles."""
    with np.errstate(over="ignore"):
        return shingles * np.uint64(_odd[h])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from the words' hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ words[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


class Scanner:
    """Templates by the words of a shingle and the size of a block."""

    def __init__(self, templates: Iterable[tuple[str, str]], similarity: float = 0.8):
        self.similarity, self.memo, self.found = similarity, {}, {}
        for i, (name, text) in enumerate(templates):
            w = self.hashed(text)
            if len(w):
                n = min(WORDS, len(w))
                s = np.unique(shingles(w, n))
                step = 1 << max(2, (len(w) - n - 1).bit_length() if len(w) > n + 1 else 0)
                self.found.setdefault(n, {}).setdefault(step, []).append((i, name, len(w) - n + 1, s))
        self.bands = {(n, step, h): self._band(ts, h) for n, c in self.found.items() for step, ts in c.items() for h in range(HASHES)}

    @staticmethod
    def _band(templates: list, h: int) -> tuple[np.ndarray, list[list[int]]]:
        low = [int(permuted(t[3], h).min()) for t in templates]
        keys = sorted(set(low))
        return np.array(keys, np.uint64), [[j for j, v in enumerate(low) if v == k] for k in keys]

    def hashed(self, text: str) -> np.ndarray:
        w, memo = _words(text.lower()), self.memo
        if len(memo) > 200_000:
            memo.clear()
        for x in set(w).difference(memo):
            memo[x] = xxhash.xxh64_intdigest(x, 7)
        return np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, int, float, int]]:
        """(text's number, license, template, containment, first word), best place of each template in each text."""
        gap = np.arange(1, WORDS + 1, dtype=np.uint64)
        words = [self.hashed(t or "") for t in texts]
        starts = np.cumsum([0, *(len(w) + WORDS for w in words)])
        line, best = np.concatenate([x for w in words for x in (w, gap)] or [gap]), {}
        for n, classes in self.found.items():
            s = shingles(line, n)
            if not len(s):
                continue
            windows: dict[tuple[int, int], set[int]] = {}
            for h in range(HASHES):
                low, size = permuted(s, h), 1
                for step in sorted(classes):
                    low, size = np.minimum.reduceat(low, np.arange(0, len(low), step // size)), step
                    pair = np.minimum(low, np.append(low[1:], low[-1]))
                    keys, which = self.bands[n, step, h]
                    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    for k in np.flatnonzero(keys[at] == pair).tolist():
                        for t in which[at[k]]:
                            windows.setdefault((step, t), set()).add(k)
            for (step, t), ks in windows.items():
                i, name, size, mine = classes[step][t]
                for k in sorted(ks):
                    part = s[k * step : (k + 2) * step]
                    got = np.minimum(np.searchsorted(mine, part), len(mine) - 1)
                    got = np.where(mine[got] == part, got, -1)
                    hit = np.flatnonzero(got >= 0) + k * step
                    owner = np.searchsorted(starts, hit, side="right") - 1
                    # Stretches lie within one text and within the window.
                    low = np.maximum(starts[owner], k * step)
                    for a, doc in np.unique(np.stack([np.maximum(hit[:, None] - np.arange(size), low[:, None]), np.broadcast_to(owner[:, None], (len(hit), size))], axis=-1).reshape(-1, 2), axis=0).tolist():
                        inside = got[a - k * step : min(a + size, int(starts[doc + 1])) - k * step]
                        share = len(np.unique(inside[inside >= 0])) / len(mine)
                        if share >= self.similarity and share > best.get((doc, i), ("", 0.0))[1]:
                            best[doc, i] = (name, share, a - int(starts[doc]))
        return [(doc, name, i, share, first) for (doc, i), (name, share, first) in sorted(best.items())]


_scanners: dict[tuple, Scanner] = {}


def listed(templates: DataFrame, license: str = "license", text: str = "text") -> tuple[tuple[str, str], ...]:
    """A table of templates as a list, numbered by name and text. Rows without a name or a text are left out; MOST_TEMPLATES at most."""
    rows = templates.where(F.col(license).isNotNull() & F.col(text).isNotNull()).select(F.col(license).alias("a"), F.col(text).alias("b")).distinct().orderBy("a", "b").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple((r.a, r.b) for r in rows)


def scan_documents(docs: DataFrame, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, template (its number), containment, first_word: a row per document and template that it holds.

    templates: pairs of name and text, or a table of license and text (see `listed`).
    """
    ship(docs.sparkSession)
    known = listed(templates) if isinstance(templates, DataFrame) else templates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (scanner := _scanners.get((known, similarity))) is None:
            scanner = _scanners[known, similarity] = Scanner(known, similarity)
        for b in chunks(batches):
            keys = b.column(0).to_pylist()
            rows = [(keys[x[0]], *x[1:]) for x in scanner.scan(b.column(1).to_pylist())]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "template", "containment", "first_word"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, license string, template int, containment double, first_word bigint")
