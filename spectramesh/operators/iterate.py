"""Iterations over the tables of many meshes at once: a sparse Dirichlet solve and walks to the highest neighbour.

Every round is a few joins and sums, and its table is written to the folder of spark.checkpoint.dir, so that plans don't grow and a lost
executor repeats one round. No mesh has to fit into a task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.sources.tables import written


def dirichlet(laplacian: DataFrame, fixed: DataFrame, tol: float = 1e-10, rounds: int = 2000, look: int = 5) -> tuple[DataFrame, DataFrame]:
    """Solves sum_j w_ij x_j = 0 at every vertex without a given value: (mesh_id, vid, x; mesh_id, rounds, residual).

    laplacian: mesh_id, i, j, w, symmetric and negative semidefinite, diagonal included. fixed: mesh_id, vid, value. Conjugate
    gradients on the rows scaled to a unit diagonal; meshes go on until their residual has shrunk by `tol`. A vertex that isn't joined to any
    fixed one keeps zero. `residual` is the largest one at the end relative to the start, for each mesh; a mesh that
    needs more than `rounds` rounds keeps a residual above `tol`. Every `look` rounds the driver asks whether any mesh goes on.
    """
    given = fixed.select("mesh_id", "vid", F.col("value").cast("double").alias("value"))
    w = laplacian.where("i <> j").select("mesh_id", "i", "j", (-F.col("w")).alias("w"))
    diagonal = laplacian.where("i = j").select("mesh_id", F.col("i").alias("vid"), (-F.col("w")).alias("d"))
    free = diagonal.join(given, ["mesh_id", "vid"], "left_anti").where("d > 0")
    ends = lambda df, at, *cols: df.select("mesh_id", F.col("vid").alias(at), *cols)
    # Between free vertices, scaled; and what the fixed ones bring.
    a = w.join(ends(free, "i", F.col("d").alias("_di")), ["mesh_id", "i"]).join(ends(free, "j", F.col("d").alias("_dj")), ["mesh_id", "j"])
    a = written(a.select("mesh_id", "i", "j", (F.col("w") / F.sqrt(F.col("_di") * F.col("_dj"))).alias("w")))
    b = w.join(ends(given, "j", F.col("value")), ["mesh_id", "j"]).groupBy("mesh_id", F.col("i").alias("vid")).agg((-F.sum(F.col("w") * F.col("value"))).alias("b"))
    zero = F.lit(0.0)
    start = written(free.join(b, ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.sqrt("d").alias("s"), zero.alias("x"), (F.coalesce("b", zero) / F.sqrt("d")).alias("r"), zero.alias("p"), zero.alias("q")))

    def told(rows: DataFrame) -> DataFrame:
        """Adds A r as `t`, and per mesh the sums r.r and r.t: all that a round needs to know."""
        to = a.join(rows.select("mesh_id", F.col("vid").alias("j"), F.col("r").alias("_r")), ["mesh_id", "j"]).groupBy("mesh_id", F.col("i").alias("vid")).agg(F.sum(F.col("w") * F.col("_r")).alias("_t"))
        rows = rows.join(to, ["mesh_id", "vid"], "left").withColumn("t", F.col("r") + F.coalesce("_t", zero)).drop("_t")
        sums = rows.groupBy("mesh_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("t")).alias("rt"))
        return rows.join(sums, "mesh_id")

    state = written(told(start.withColumns({"beta": zero, "alpha": zero})).withColumns({"rr0": F.col("rr"), "turn": F.lit(0), "alpha": F.try_divide(F.col("rr"), F.col("rt")), "going": F.col("rr") > 0}))
    for turn in range(1, rounds + 1):
        if turn % look == 1 and not state.agg(F.max("going")).first()[0]:
            break  # rounds in between cost a finished mesh nothing
        # One reduction a round: directions p and their images q follow from r and t with the sums of the round before.
        p, q = F.col("r") + F.col("beta") * F.col("p"), F.col("t") + F.col("beta") * F.col("q")
        moved = state.where("going").select("mesh_id", "vid", "s", (F.col("x") + F.col("alpha") * p).alias("x"), (F.col("r") - F.col("alpha") * q).alias("r"), p.alias("p"), q.alias("q"), "rr0", F.col("rr").alias("_rr"), F.col("alpha").alias("_alpha"))
        now = told(moved).withColumn("beta", F.try_divide(F.col("rr"), F.col("_rr")))
        now = now.withColumns({"alpha": F.try_divide(F.col("rr"), F.col("rt") - F.col("beta") * F.try_divide(F.col("rr"), F.col("_alpha"))), "turn": F.lit(turn), "going": F.col("rr") > tol * tol * F.col("rr0")})
        same = state.where("not going").select(*(c for c in state.columns))
        state = written(now.select(*same.columns).unionByName(same))
    x = state.select("mesh_id", "vid", (F.col("x") / F.col("s")).alias("x")).unionByName(given.select("mesh_id", "vid", F.col("value").alias("x")))
    lonely = laplacian.where("i = j").select("mesh_id", F.col("i").alias("vid")).join(x.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti").select("mesh_id", "vid", zero.alias("x"))
    report = state.groupBy("mesh_id").agg(F.max("turn").alias("rounds"), F.coalesce(F.sqrt(F.try_divide(F.max("rr"), F.max("rr0"))), zero).alias("residual"))
    return x.unionByName(lonely), report


def highest_neighbour(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """mesh_id, vid, next: the highest neighbour, the smallest number of equals; a vertex without a higher neighbour is its own.

    edges: mesh_id, i, j, each once. heights: mesh_id, vid, h.
    """
    both = edges.select("mesh_id", F.col("i").alias("vid"), F.col("j").alias("n")).unionByName(edges.select("mesh_id", F.col("j").alias("vid"), F.col("i").alias("n")))
    near = both.join(heights.select("mesh_id", F.col("vid").alias("n"), F.col("h").alias("_h")), ["mesh_id", "n"])
    best = near.groupBy("mesh_id", "vid").agg(F.min(F.struct((-F.col("_h")).alias("k"), "n")).alias("_b"))
    own = heights.join(best, ["mesh_id", "vid"], "left")
    return own.select("mesh_id", "vid", F.when(-F.col("_b.k") > F.col("h"), F.col("_b.n")).otherwise(F.col("vid")).alias("next"))


def walks(nexts: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mesh_id, step, vid of the way from each mesh's start on; mesh_id, vid, top, steps: where each vertex's own way ends, and how far off).

    nexts: mesh_id, vid, next (its own at an end; no cycles). starts: mesh_id, vid, one for each mesh. Pointers double: after round k every
    vertex knows the one 2^k steps on, and the way is marked up to 2^k steps; so a way of n steps takes log2(n) rounds of one join each.
    """
    most = nexts.groupBy("mesh_id").count().agg(F.max("count")).first()[0] or 1
    on = starts.select("mesh_id", "vid", F.lit(0).cast("bigint").alias("at"))
    state = written(nexts.join(on, ["mesh_id", "vid"], "left").select("mesh_id", "vid", "next", F.when(F.col("next") == F.col("vid"), 0).otherwise(1).cast("bigint").alias("steps"), "at"))
    for k in range(max(1, math.ceil(math.log2(most)))):
        # Marks first: whoever is on the way marks the vertex 2^k steps on.
        marks = state.where(F.col("at").isNotNull() & (F.col("steps") == 1 << k)).select("mesh_id", F.col("next").alias("vid"), (F.col("at") + (1 << k)).alias("_at"))
        ahead = state.select("mesh_id", F.col("vid").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        state = written(state.join(marks, ["mesh_id", "vid"], "left").join(ahead, ["mesh_id", "next"]).select("mesh_id", "vid", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), F.coalesce("at", "_at").alias("at")))
        if not state.where(F.col("steps") > 1 << k).limit(1).count():
            break  # all are at their ends
    return state.where(F.col("at").isNotNull()).select("mesh_id", F.col("at").alias("step"), "vid"), state.select("mesh_id", "vid", F.col("next").alias("top"), "steps")
