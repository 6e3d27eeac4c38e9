"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words (`targets`). A document has a weight (by default 1, 2 or 3 for a text of under 100,
under 1000, or more words: long texts are worth more), and its expected number of copies is its weight times a rate, at
most `max_copies`; the rate of a source is the one with which the expected words are its target. Whole copies are
certain; the fraction left over is the inclusion probability p. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), with u a hash of the id, and the lowest ranks get one copy more until the source's
remaining words are reached: a sample of fixed size with unequal probabilities, the same in every run.

The cut is found without sorting a source: words are summed in 8192 bins of the log rank, which gives the bin with the
cut; that bin is cut into 4096 again, and only the rows of one such piece (about a millionth of a source) are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm import text as T
from factlens.llm.store import written

#: A table of at most so many sources is broadcast; above it, the join is left to the planner.
BROADCAST_SOURCES = 50_000
BINS_PER_UNIT, EDGE, PIECES = 256, 16, 4096


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """sources(source, source_size) with each source's target.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all sizes. A target
    stops at max_copies times its source's size, and the rest is shared by weight among the others: the level c
    with target = least(cap, weight * c) is the largest of (total - caps so far) / (weights left), in order of
    cap / weight.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_copies))
    )
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        weighed.withColumn("level", left / open_weight)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def size_weight(size: Column) -> Column:
    """The default weight of a document by its words: 1, from 100 words on 2, from 1000 on 3."""
    return F.when(size >= 1000, 3.0).when(size >= 100, 2.0).otherwise(1.0)


def rates(masses: DataFrame, per_source: DataFrame, max_copies: float) -> DataFrame:
    """masses(source, weight, words), per_source(source, source_size, target) -> per_source with rate.

    The rate solves sum of words * least(max_copies, rate * weight) = target: as in `targets`, weights from the highest
    down reach the cap, and the rate is the largest of (target - caps so far) / (words * weight left).
    """
    held = masses.filter("weight > 0 AND words > 0").join(per_source, F.col("source").eqNullSafe(F.col("s")))
    source = Window.partitionBy("s")
    before = source.orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(F.col("words") * F.lit(float(max_copies))).over(before), F.lit(0.0))
    pull = F.col("words") * F.col("weight")
    left = F.sum(pull).over(source) - F.coalesce(F.sum(pull).over(before), F.lit(0.0))
    solved = held.withColumn("rate", (F.col("target") - capped) / left).groupBy(F.col("s").alias("s1")).agg(F.max("rate").alias("rate"))
    return per_source.join(solved, F.col("s").eqNullSafe(F.col("s1")), "left").select(F.col("s").alias("source"), "source_size", "target", "rate")


def _ranked(docs: DataFrame, expected: Column, max_copies: float) -> DataFrame:
    """Adds whole copies, inclusion probability p, rank q and its bin, from u and the expected copies."""
    e = F.least(F.coalesce(expected, F.lit(0.0)), F.lit(float(max_copies)))
    whole = F.floor(e + F.lit(1e-9))
    return (
        docs.withColumn("__whole", whole.cast("long"))
        .withColumn("__p", F.greatest(e - whole, F.lit(0.0)))
        .withColumn("__q", F.when(F.col("__p") > 0, (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))))
        .withColumn("__at", F.when(F.col("__p") > 0, F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.log("__q"))) * BINS_PER_UNIT))
        .withColumn("__bin", F.floor("__at").cast("int"))
        .withColumn("__piece", F.least(F.floor((F.col("__at") - F.col("__bin")) * PIECES), F.lit(PIECES - 1)).cast("int"))
    )


def _with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int) -> DataFrame:
    return (
        docs.withColumn("__id", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        .withColumn("__source", F.col(source_col))
        .withColumn("__size", T.n_words(F.col(text_col)))
        .withColumn("__weight", F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else size_weight(F.col("__size")))
        .withColumn("__u", T.unit_hash(F.col(id_col), seed))
    )


def _cut(sums: DataFrame, place: str) -> DataFrame:
    """sums(source, <place>, words, room) -> source, cut (the place whose words reach the room), room (left inside it)."""
    in_order = Window.partitionBy("source").orderBy(place)
    reached = sums.withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    reached = reached.filter((F.col("before") < F.col("room")) & (F.col("before") + F.col("words") >= F.col("room")))
    return reached.groupBy("source").agg(F.min(F.struct(place, "before", "room")).alias("c")).select("source", F.col(f"c.{place}").alias("cut"), (F.col("c.room") - F.col("c.before")).alias("room"))


def plan(keyed: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """One row a source: its size, target, copies per unit of weight, and the cut in rank order."""
    masses = written(keyed.groupBy(F.col("__source").alias("source"), F.col("__weight").alias("weight")).agg(F.sum("__size").alias("words")), "mix-masses")
    totals = targets(masses.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_copies)
    per_source = written(rates(masses, totals.withColumnRenamed("source", "s"), max_copies), "mix-targets")
    ranked = _ranked(_attached(keyed, per_source), F.col("rate") * F.col("__weight"), max_copies)
    bins = ranked.groupBy(F.col("__source").alias("source"), F.col("__bin").alias("bin")).agg(
        F.sum("__size").alias("words"), F.sum(F.col("__size") * F.col("__whole")).alias("certain")
    )
    summed = (
        bins.join(per_source.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("room", F.col("target") - F.sum("certain").over(Window.partitionBy("source")))
        .filter(F.col("bin").isNotNull())
        .select("source", "bin", "words", "room")
    )
    summed = written(summed, "mix-bins")
    cut_bins = written(_cut(summed, "bin").withColumnRenamed("cut", "cut_bin"), "mix-cut-bins")
    # the cut's bin again, in pieces; then the rows of one piece, where equal ranks and ids go together
    bare = ranked.drop("source", "source_size", "target", "rate")
    inner = _attached(bare, cut_bins).filter(F.col("__bin") == F.col("cut_bin")).select("source", "cut_bin", "room", "__piece", "__q", "__id", "__size")
    pieces = inner.groupBy("source", "room", F.col("__piece").alias("piece")).agg(F.sum("__size").alias("words"))
    cut_pieces = written(_cut(pieces, "piece").withColumnRenamed("cut", "cut_piece"), "mix-cut-pieces")
    close = (
        _attached(inner.drop("room").withColumnRenamed("source", "__source"), cut_pieces)
        .filter(F.col("__piece") == F.col("cut_piece"))
        .groupBy("source", "room", "__q", "__id")
        .agg(F.sum("__size").alias("words"))
    )
    in_order = Window.partitionBy("source").orderBy("__q", "__id").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        close.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
        .filter(2 * F.col("before") + F.col("words") <= 2 * F.col("room"))
        .groupBy("source")
        .agg(F.max(F.struct(F.col("__q").alias("q"), F.col("__id").alias("id"))).alias("cut"))
    )
    short = summed.groupBy("source").agg(F.max("room").alias("room"), F.sum("words").alias("w"))
    same = lambda other: F.col("source").eqNullSafe(F.col(other))
    return written(
        per_source.join(cut_bins.select(F.col("source").alias("s1"), "cut_bin"), same("s1"), "left")
        .join(cut_pieces.select(F.col("source").alias("s2"), "cut_piece"), same("s2"), "left")
        .join(cuts.select(F.col("source").alias("s3"), "cut"), same("s3"), "left")
        .join(short.select(F.col("source").alias("s4"), (F.col("room") > F.col("w")).alias("all_in")), same("s4"), "left")
        .select("source", "source_size", "target", "rate", "cut_bin", "cut_piece", "cut", F.coalesce("all_in", F.lit(False)).alias("all_in")),
        "mix-plan",
    )


def _attached(keyed: DataFrame, per_source: DataFrame) -> DataFrame:
    small = per_source.count() <= BROADCAST_SOURCES
    return keyed.join(F.broadcast(per_source) if small else per_source, F.col("__source").eqNullSafe(F.col("source")))


def _copies(keyed: DataFrame, planned: DataFrame, max_copies: float) -> DataFrame:
    ranked = _ranked(_attached(keyed, planned), F.col("rate") * F.col("__weight"), max_copies)
    at_cut = F.struct(F.col("__q").alias("q"), F.col("__id").alias("id")) <= F.col("cut")
    in_bin = (F.col("__piece") < F.col("cut_piece")) | ((F.col("__piece") == F.col("cut_piece")) & F.coalesce(at_cut, F.lit(False)))
    inside = F.col("all_in") | (F.col("__bin") < F.col("cut_bin")) | ((F.col("__bin") == F.col("cut_bin")) & in_bin)
    extra = F.when((F.col("__p") > 0) & F.coalesce(inside, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return ranked.withColumn("__copies", F.col("__whole") + extra)


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weight_col=None,
    weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0, seed: int = 17,
) -> DataFrame:
    """A row per input row: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    A null source is a source of its own, the last. Null and empty texts have size 0. Repeated rows with one id
    share their rank and are taken alike. An empty table gives an empty result; other columns are left out.
    """
    keyed = _with_keys(docs.select(id_col, text_col, source_col, *([weight_col] if weight_col else [])), id_col, text_col, source_col, weight_col, seed)
    sized = written(keyed.select(F.col(id_col).alias("doc_id"), "__id", "__source", "__size", "__weight", "__u"), "mix-sizes")
    return _copies(sized, plan(sized, weights, share, max_copies), max_copies).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies")
    )


def mixed_rows(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weight_col=None,
    weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0, seed: int = 17,
) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, columns as they were."""
    keyed = _with_keys(docs, id_col, text_col, source_col, weight_col, seed)
    sized = written(keyed.select("__id", "__source", "__size", "__weight", "__u"), "mix-sizes")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = _with_keys(inner, f"__row.{id_col}", f"__row.{text_col}", f"__row.{source_col}", f"__row.{weight_col}" if weight_col else None, seed)
    taken = _copies(keyed, plan(sized, weights, share, max_copies), max_copies).filter(F.col("__copies") > 0)
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
