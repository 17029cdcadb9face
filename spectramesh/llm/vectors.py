"""Vectors as whole numbers: the columns and arrays that hard negatives (operator 11) and vector codes (operator 12) share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are held to this size. Sums of 2,000 products of two of them, and of 500 squared differences, fit into a long.
LIMIT = 1 << 26


def finite(vector: Column) -> Column:
    """Not null, and neither a null nor a NaN or an infinity among its components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as a double; beyond LIMIT: LIMIT, with its sign."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.transform(whole, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)).cast("int"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have `dim` entries, as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """Arrow batches with a column `dim`, gathered into tables of one dim and at most `rows` rows."""
    held: dict[int, list[pa.Table]] = {}
    for b in batches:
        t = pa.Table.from_batches([b])
        dims = t.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            part = t if (dims == d).all() else t.filter(pa.array(dims == d))
            while part.num_rows:
                have = sum(x.num_rows for x in held.get(d, []))
                held.setdefault(d, []).append(part.slice(0, rows - have))
                part = part.slice(rows - have)
                if sum(x.num_rows for x in held[d]) == rows:
                    yield d, pa.concat_tables(held.pop(d)).combine_chunks()
    for d, some in held.items():
        yield d, pa.concat_tables(some).combine_chunks()
