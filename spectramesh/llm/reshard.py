"""Resharding with the fewest bytes moved, by minimum-cost flow (operator 1).

The old shards are sources, the new ones sinks; an edge's cost is what it takes to move one byte, zero where a shard keeps its
place. The flow is solved exactly on the driver over one number per old and per new shard. Documents aren't divisible, so the
flow's blocks are cut between documents: within each old shard the documents lie on a line of bytes, and a document goes where
its middle lies. To keep that rounding small, documents above a hundredth of a shard are placed first, one by one, largest first: where
the flow over all bytes puts them if they fit, else where most room is left. Less than a hundred of them per shard can exist, so that
list is bounded. A second flow then takes the others' bytes to the room that is left. Sizes differ by about a hundredth of a shard, or by
one document where documents are larger than that. A plan says what the first flow alone would move, which no plan can be below.

Then the affected shards are written: every new shard but those whose rows are those of the old shard of the same number. A block is a
run of rows of its file, so the rows' new shards follow from a broadcast table of runs and large documents, and the scan of the
texts writes them without a shuffle. Rows are told apart by file and place in it, never by their key.

Law: `bytes`. Null texts have the size of the 16-byte header alone. Equal rows are separate rows. Equal texts may part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectramesh.llm.common import RUN_ROWS, free, materialize, new_path, running

HEADER_BYTES = 16
#: A document is large from this part of a mean shard on.
LARGE = 1 / 100


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow (sources x sinks) of least total cost that ships all supply; total demand must be as large at least.

    Successive shortest paths with potentials: each round sends what the cheapest residual path takes.
    """
    supply, demand = np.array(supply, np.int64), np.array(demand, np.int64)
    if supply.sum() > demand.sum():
        raise ValueError("the new capacities are too small")
    n, m = len(supply), len(demand)
    flow, left, room = np.zeros((n, m), np.int64), supply.copy(), demand.copy()
    if cost.size and cost.min() < 0:
        raise ValueError("costs can't be negative")
    u, v = np.zeros(n), np.zeros(m)  # all sinks with room keep one potential, so the nearest by reduced costs is the cheapest
    while left.any():
        # Dijkstra over sources and sinks at once, from all sources with supply left; costs reduced by potentials.
        du, dv = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        pu, pv = np.full(n, -1), np.full(m, -1)
        seen_u, seen_v, end = np.zeros(n, bool), np.zeros(m, bool), -1
        while True:
            i = int(np.argmin(np.where(seen_u, np.inf, du))) if n else -1
            j = int(np.argmin(np.where(seen_v, np.inf, dv)))
            a, b = (np.inf if seen_u[i] else du[i]), (np.inf if seen_v[j] else dv[j])
            if a <= b:
                if not np.isfinite(a):
                    break
                seen_u[i] = True
                near = a + np.maximum(cost[i] + u[i] - v, 0)
                better = near < dv
                dv[better], pv[better] = near[better], i
            else:
                seen_v[j] = True
                if room[j] > 0:
                    end = j
                    break
                back = np.where(flow[:, j] > 0, b + np.maximum(v[j] - u - cost[:, j], 0), np.inf)
                better = back < du
                du[better], pu[better] = back[better], j
        reach = dv[end]
        u += np.minimum(du, reach)
        v += np.minimum(dv, reach)
        path, j = [], end
        while True:
            i = int(pv[j])
            path.append((i, j))
            if pu[i] < 0:
                break
            j = int(pu[i])
        much = min(int(left[i]), int(room[end]), *(int(flow[path[k][0], path[k + 1][1]]) for k in range(len(path) - 1)))
        for k, (a, b) in enumerate(path):
            flow[a, b] += much
            if k + 1 < len(path):
                flow[a, path[k + 1][1]] -= much
        left[i] -= much
        room[end] -= much
    return flow


def level(placed: np.ndarray, rest: int) -> np.ndarray:
    """Whole numbers that add up to `rest` and bring all shards as near to one height as they can be."""
    heights = np.sort(placed)
    for k in range(len(heights), 0, -1):
        top = (rest + heights[:k].sum()) / k
        if top >= heights[k - 1]:
            break
    room = np.maximum(0, np.floor(top - placed)).astype(np.int64)
    short = rest - int(room.sum())
    for i in np.argsort(placed, kind="stable")[: max(0, short)]:
        room[i] += 1
    room[int(np.argmin(placed))] += max(0, rest - int(room.sum()))
    return room


@dataclass
class Plan:
    """blocks: (old shard, first byte, last byte, new shard) of the small documents; large: (old shard, position, new shard).

    least_bytes: what would move if documents were divisible.
    """

    blocks: list[tuple[int, int, int, int]]
    large: list[tuple[int, int, int]]
    moved_bytes: int
    least_bytes: int
    capacities: list[int]


def cut(supply: np.ndarray, room: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The blocks of the cheapest flow: (old shard, first byte, last byte, new shard), what stays first."""
    # Sources with equal costs are one source to the flow; what it sends is then taken from them in their order.
    kinds, kind = np.unique(cost, axis=0, return_inverse=True)
    kind = kind.ravel()
    flow = min_cost_flow([int(supply[kind == k].sum()) for k in range(len(kinds))], room.tolist(), kinds)
    left = [[(t, int(flow[k, t])) for t in range(len(room)) if flow[k, t]] for k in range(len(kinds))]
    blocks = []
    for s in range(len(supply)):
        begin, sends = 0, left[kind[s]]
        sends.sort(key=lambda x: (x[0] != s, x[0]))
        while begin < supply[s]:
            t, much = sends[0]
            part = min(much, int(supply[s]) - begin)
            blocks.append((s, begin, begin + part, t))
            begin += part
            if part == much:
                sends.pop(0)
            else:
                sends[0] = (t, much - part)
    return blocks


def moved(blocks: list[tuple[int, int, int, int]]) -> int:
    return sum(b - a for s, a, b, t in blocks if s != t)


def make_plan(sizes: dict[int, int], large: list[tuple[int, int, int, int]], shards: int, cost: np.ndarray | None = None, capacities: list[int] | None = None) -> Plan:
    """sizes: bytes of the small documents by old shard; large: (size, old shard, position, bytes of all documents before it). Pure, on the driver."""
    old = max([*sizes, *(x[1] for x in large), 0]) + 1
    cost = np.asarray(cost, float) if cost is not None else (1.0 - np.eye(old, shards))
    total = sum(sizes.values()) + sum(x[0] for x in large)
    want = np.array(capacities if capacities is not None else [total / shards] * shards, float)
    nothing = np.zeros(shards, np.int64)
    supply = np.array([sizes.get(s, 0) for s in range(old)], np.int64)
    every = supply + np.bincount([x[1] for x in large], [x[0] for x in large], old).astype(np.int64)
    ideal = cut(every, level(want.min() - want, total) if total else nothing, cost)
    starts: dict[int, list] = {}
    for b in ideal:
        starts.setdefault(b[0], []).append(b)
    placed, put = np.zeros(shards), []
    heap = [(float(-want[t]), t) for t in range(shards)]
    heapq.heapify(heap)
    for size, s, at, before in sorted(large, key=lambda x: (-x[0], x[1], x[2])):
        t = next((b[3] for b in starts[s] if before + size // 2 < b[2]), starts[s][-1][3])
        if placed[t] + size > want[t]:
            while True:
                room, t = heap[0]
                if -room == want[t] - placed[t]:
                    break
                heapq.heapreplace(heap, (float(placed[t] - want[t]), t))  # it was filled meanwhile
        placed[t] += size
        put.append((s, at, t))
    rest = int(supply.sum())
    room = level(placed - (want - want.min()), rest) if total else nothing
    blocks = cut(supply, room, cost)
    sizes_of = {(x[1], x[2]): x[0] for x in large}
    return Plan(blocks, put, moved(blocks) + sum(sizes_of[s, at] for s, at, t in put if s != t), moved(ideal), room.tolist())


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER_BYTES).cast("long")


def read_from(docs: DataFrame) -> tuple[Column, Column]:
    """The file that a row was read from and its place there, for a table read from files; its own columns may have any names."""
    found = docs.metadataColumn("_metadata")
    return found["file_path"], found["row_index"]


def located(docs: DataFrame, file: str = "_file", place: str = "_place") -> DataFrame:
    """Add the old shard's file and the row's place in it, for a table read from files."""
    return docs.select("*", read_from(docs)[0].alias(file), read_from(docs)[1].alias(place))


def file_numbers(rows: DataFrame) -> DataFrame:
    """_file, old_shard: one row per file of the input, numbered by name."""
    files = [(r[0], i) for i, r in enumerate(rows.select("_file").distinct().orderBy("_file").collect())]
    return rows.sparkSession.createDataFrame(files, "_file string, old_shard int")


def reshard(rows: DataFrame, shards: int, cost: np.ndarray | None = None, run_rows: int = RUN_ROWS) -> tuple[DataFrame, Plan]:
    """rows: _file (string), _place (long, distinct in the file), size (long) and any other columns.

    Returns the rows with `old_shard`, `shard`, `slot` (gapless from 0 in each shard) and `_large` (placed one by one), and the plan. Old shards are numbered by
    their file's name; the table of files is on the driver, as it is for any scan. An empty table makes an empty plan.
    """
    spark = rows.sparkSession
    numbers = file_numbers(rows)
    known = rows.join(F.broadcast(numbers), "_file").drop("_file")
    by_shard = known.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    total = sum(r.bytes for r in by_shard)
    limit = total / shards * LARGE
    is_large = F.col("size") > limit
    lines = running(known.withColumn("_large", is_large), "old_shard", "_place", {"_before": F.col("size"), "_begin": F.when(F.col("_large"), F.lit(0)).otherwise(F.col("size"))}, rows=run_rows)
    # Fewer than 100 documents per new shard are larger than a hundredth of a shard.
    big = [(r.size, r.old_shard, r._place, r._before) for r in lines.where("_large").select("size", "old_shard", "_place", "_before").collect()] if total else []
    small = {r.old_shard: r.bytes for r in by_shard}
    for size, s, *_ in big:
        small[s] -= size
    plan = make_plan(small, big, shards, cost)
    # Blocks and large documents: at most (old + new) blocks and 100 documents a shard.
    by_old: dict[int, list[tuple[int, int, int]]] = {}
    for o, a, b, t in plan.blocks:
        by_old.setdefault(o, []).append((a, b, t))
    cuts = spark.createDataFrame(sorted(by_old.items()), "old_shard int, _cuts array<struct<a:bigint,b:bigint,t:int>>")
    large = spark.createDataFrame(plan.large, "old_shard int, _place bigint, _to int")
    middle = F.col("_begin") + F.floor(F.col("size") / 2)
    found = F.expr("filter(_cuts, c -> _middle >= c.a and _middle < c.b)[0].t")
    out = (
        lines.join(F.broadcast(cuts), "old_shard", "left")
        .join(F.broadcast(large), ["old_shard", "_place"], "left")
        .withColumn("_middle", middle)
        .withColumn("shard", F.coalesce("_to", F.when(~F.col("_large"), F.coalesce(found, F.element_at("_cuts", -1)["t"]))))
        .drop("_cuts", "_to", "_middle", "_begin", "_before")
    )
    # A row's order in its new shard: by old shard and place, added up in runs.
    out = out.withColumn("_order", F.col("old_shard").cast("long") * F.lit(1 << 40) + F.col("_place"))
    return running(out, "shard", "_order", F.lit(1), "slot", run_rows).drop("_order"), plan


def untouched(flows: set[tuple[int, int]]) -> set[int]:
    """New shards whose rows are all of the old shard of the same number. flows: (old shard, new shard) that share a row."""
    return {t for s, t in flows if s == t and all((a == t) == (b == t) for a, b in flows)}


def names(columns: list[str]) -> tuple[str, str, str]:
    """What a written shard calls the old shard, the place in it and the new shard: _old, _at and _shard, unless the table has such columns."""
    return free("_old", columns), free("_at", columns), free("_shard", columns)


def numbered(content: DataFrame) -> DataFrame:
    """A table read from files, with each row's old shard and place."""
    old, at, _ = names(content.columns)
    file = free("_file", content.columns)
    rows = located(content, file, at)
    files = file_numbers(content.select(read_from(content)[0].alias("_file"))).toDF(file, old)
    return rows.join(F.broadcast(files), file).drop(file)


def rewrite(resharded: DataFrame, content: DataFrame, keep: set[int] | None = None) -> str:
    """Write the affected shards as one folder each (`_shard=N`) and return the root.

    resharded: old_shard, _place, shard, _large of every row; content: the same table read from its files, with all columns to write. To
    these come _old and _at, the row's old shard and place (see `names`): their order is that of the slots. keep: shards whose content
    stays as it is; without it, those that no row leaves or enters.
    """
    path = new_path(resharded.sparkSession, "shards")
    # A run of rows per block of the plan, at most (old + new) rows, and 100 large documents a shard.
    runs = resharded.where(~F.col("_large")).groupBy("old_shard", "shard").agg(F.min("_place").alias("a"), F.max("_place").alias("b")).collect()
    large = resharded.where("_large").select("old_shard", "_place", "shard").collect()
    if keep is None:
        keep = untouched({(r.old_shard, r.shard) for r in [*runs, *large]})
    by_old: dict[int, list[tuple[int, int, int]]] = {}
    for r in runs:
        by_old.setdefault(r.old_shard, []).append((r.a, r.b, r.shard))
    spark, (old, at, shard) = resharded.sparkSession, names(content.columns)
    taken = [*content.columns, old, at, shard]
    held, to = free("_runs", taken), free("_to", taken)
    cuts = spark.createDataFrame(sorted(by_old.items()), f"`{old}` int, `{held}` array<struct<a:bigint,b:bigint,t:int>>")
    single = spark.createDataFrame([(r.old_shard, r._place, r.shard) for r in large], f"`{old}` int, `{at}` bigint, `{to}` int")
    rows = numbered(content).join(F.broadcast(cuts), old, "left").join(F.broadcast(single), [old, at], "left")
    rows = rows.withColumn(shard, F.coalesce(F.col(to), F.expr(f"filter(`{held}`, r -> `{at}` >= r.a and `{at}` <= r.b)[0].t"))).drop(held, to)
    if keep:
        rows = rows.where(~F.col(shard).isin(sorted(keep)))
    rows.sortWithinPartitions(shard, old, at).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return path


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put the documents of a table read from files into `shards` shards: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The affected shards are written, and what is returned is read from them (from the old files for shards that stay).
    text_crc32 is that of the empty string for null texts. grown_shard is null: the law is `bytes`. The table's other columns go with
    their rows, whatever their names.
    """
    file, place = read_from(docs)
    rows = materialize(docs.select(file.alias("_file"), place.alias("_place"), size_of(F.col(text)).alias("size")), "sizes")
    out = materialize(reshard(rows, shards)[0].select("old_shard", "_place", "shard", "_large"), "assigned")
    keep = untouched({(r.old_shard, r.shard) for r in out.select("old_shard", "shard").distinct().collect()})
    old, at, shard = names(docs.columns)
    held = T.StructType([*docs.schema.fields, T.StructField(old, T.IntegerType()), T.StructField(at, T.LongType()), T.StructField(shard, T.IntegerType())])
    again = docs.sparkSession.read.schema(held).parquet(rewrite(out, docs, keep))
    if keep:
        same = numbered(docs)
        again = again.unionByName(same.withColumn(shard, F.col(old)).where(F.col(shard).isin(sorted(keep))))
    read = again.select(F.col(key).alias("doc_id"), size_of(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.col(shard).alias("shard"), (F.col(old).cast("long") * F.lit(1 << 40) + F.col(at)).alias("_order"))
    found = running(materialize(read, "reread"), "shard", "_order", F.lit(1), "slot")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
