"""Packing by optimal length buckets.

Lengths are counted over all documents in a histogram. Lengths up to `exact` have a cell each; above, cells are
1/256 wide relative to their power of two, so the histogram has a few thousand cells whatever the data. Dynamic
programming over the cells (each with its count, sum and longest length) chooses the bucket boundaries with the least
padding in total, if documents are padded to their bucket's longest.

Inside a bucket, documents go into batches of at most `budget` padded tokens. A bucket is dealt into shards by a hash
of the id, as many as its count and its words need, and each shard numbers its documents by itself: no bucket is sorted in one
task, and only a shard's last batch can be partly filled. A document longer than the budget is a batch of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm import text as T
from factlens.llm.store import written

#: A shard has about so many documents or words, whichever are reached first.
SHARD_ROWS, SHARD_WORDS = 20_000, 4_000_000


def cell(length: Column, exact: int = 1024) -> Column:
    """The histogram cell of a length: itself up to `exact`, then 256 cells for each doubling."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / exact))
    step = F.pow(F.lit(2.0), power) * exact
    return F.when(length <= exact, length).otherwise(exact + 1 + (power * 256 + F.floor((length - step) / step * 256)).cast("long"))


def boundaries(counts: np.ndarray, sums: np.ndarray, longest: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least sum of (upper end - length), exactly.

    cost[k][j]: of the first j cells in k buckets; the last of them begins after cell i, for the best i.
    """
    m = len(counts)
    if not m:
        return []
    c, s = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(sums)].astype(float)
    cost, back = longest * c[1:] - s[1:], []
    for _ in range(1, min(buckets, m)):
        now, at = np.empty(m), np.empty(m, int)
        before = np.r_[0.0, cost]
        for j in range(1, m + 1):
            total = before[:j] + longest[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            at[j - 1] = total.argmin()
            now[j - 1] = total[at[j - 1]]
        back.append(at)
        cost = now
    ends, j = [int(longest[m - 1])], m
    for at in reversed(back):
        j = int(at[j - 1])
        if not j:
            break
        ends.append(int(longest[j - 1]))
    return sorted(set(ends))


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy(cell(F.col("length")).alias("cell")).agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 16_384, seed: int = 5, carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per input row: doc_id, length (words), bucket, bucket_length, shard, batch, slot, batch_id, and the columns
    named in carry (such as the text itself, which then lies with its batch).

    batch_id is bucket:shard:batch. Null and empty texts have length 0. Repeated rows are documents of their own, each in
    a slot. Equal lengths share a bucket; ids break ties. An empty table gives an empty result; other columns are left
    out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), T.n_words(F.col(text_col)).alias("length"), *[F.col(f"`{c}`").alias(f"__{c}") for c in carry])
    # without further columns the lengths are counted once; texts to carry are not written another time for that
    rows = rows if carry else written(rows, "pack-lengths")
    cells = histogram(rows).orderBy("cell").collect()  # a few thousand at most, see cell()
    ends = boundaries(*(np.array([r[k] for r in cells], float) for k in ("n", "total", "longest")), buckets) if cells else []
    if not ends:
        ends = [0]
    counts, words = [0] * len(ends), [0] * len(ends)
    for r in cells:
        i = int(np.searchsorted(ends, r["longest"]))
        counts[i], words[i] = counts[i] + r["n"], words[i] + r["total"]
    shards = [max(1, -(-n // SHARD_ROWS), -(-w // SHARD_WORDS)) for n, w in zip(counts, words, strict=True)]
    per_batch = [max(1, budget // max(1, e)) for e in ends]
    bucket = sum((F.when(F.col("length") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("bucket"))
    rows = rows.withColumn("bucket", bucket).withColumn("shard", (F.floor(T.unit_hash(F.col("doc_id"), seed) * pick(shards))).cast("int"))
    order = Window.partitionBy("bucket", "shard").orderBy("length", F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("__n", F.row_number().over(order) - 1).withColumn("__b", pick(per_batch))
    batch = F.floor(F.col("__n") / F.col("__b")).cast("long")
    return rows.select(
        "doc_id", "length", "bucket", pick(ends).cast("long").alias("bucket_length"), "shard", batch.alias("batch"),
        (F.col("__n") % F.col("__b")).cast("long").alias("slot"), F.concat_ws(":", "bucket", "shard", batch).alias("batch_id"),
        *[F.col(f"__{c}").alias(c) for c in carry],
    )
