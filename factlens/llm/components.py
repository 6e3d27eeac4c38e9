"""Connected components of a distributed edge table by alternating large and small stars.

A table of at most `AT_ONCE` edges (a few megabytes, counted first) is one task's union-find instead of many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.store import ship, written

AT_ONCE = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small table -> (node, component)."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ends, begin = at.tolist(), 0
    for u, _ in parts:
        n = len(u)
        for i, j in zip(ends[begin : begin + n], ends[begin + n : begin + 2 * n], strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        begin += 2 * n
    roots = nodes[[find(i) for i in range(len(nodes))]]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], ["node", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.filter(F.col("v") > F.col("u"))
    return far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """edges(u, v) -> (node, component): the least node that each node reaches; nodes without an edge are left out.

    Minima are aggregated before rows meet, so a hub costs no more than its edges, which a skewed join splits. Each
    round is written to the shared folder; the loop ends when a round changes nothing.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    if now.count() <= at_once:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    mark = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "stars")
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (got["n"], got["s"]):
            break
        mark = (got["n"], got["s"])
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
