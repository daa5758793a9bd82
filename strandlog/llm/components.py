"""Connected components of an edge table, as a table. Nothing is gathered on the driver, and a few edges only in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.scratch import drop, saved

#: Edges that one task may hold, whatever the corpus: 4 MB of them.
FEW = 1 << 18


def _hung(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges, and the smallest end that it is connected with."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(u):  # of roots that differ
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return ids, ids[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def make(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            out = _hung(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "component"])

    return edges.select("u", "v").where("u <> v").coalesce(1).mapInArrow(make, "id long, component long")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component) for every end of ``edges(u, v)``; the component is its smallest id. Both ends differ, or don't count.

    Up to ``few`` edges are finished in one task. While there are more, rounds alternate large-star and small-star steps
    (Kiveris et al., 2014): each keeps connectivity and hangs nodes on smaller ones, until only stars are left, after a
    logarithmic number of rounds. Every step is one combinable minimum per node and one join, whose hot side adaptive
    execution splits.
    """
    if edges.count() <= few:
        return _in_one_task(edges)
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    now = saved(edges)
    before = sums(now)
    while before[0] > few:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = (down.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                .union(small.select("u", F.col("m").alias("v"))).distinct())
        after = saved(hung)
        drop(now)
        now, last, before = after, before, sums(after)
        if before == last:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return out.union(out.select(F.col("component").alias("id"), "component").distinct())
    return _in_one_task(now)
