"""Quality rules as a short-circuit cascade.

Every rule rejects some texts at some cost. On a bounded sample each rule's cost (seconds over the sample, less those of
a job without a rule) and selectivity (share of rows rejected) are measured; the rules then run in the order of
rejections per cost, in one CASE expression over words that are cut once a text, so that a text which an early rule
rejects never reaches the dear ones. The order changes only the time: a text is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm import text as T
from factlens.llm.store import bounded_sample, written

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Facts:
    """Expressions on one text; each is evaluated where a rule needs it."""

    text: Column
    words: Column

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return T.count_of(self.text, SYMBOLS)

    @property
    def n_dup_lines(self) -> Column:
        lines = F.filter(F.split(self.text, "\n"), lambda x: F.btrim(x, F.lit(T.SPACES)) != "")
        return T.let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")

    @property
    def n_lines(self) -> Column:
        return F.size(F.filter(F.split(self.text, "\n"), lambda x: F.btrim(x, F.lit(T.SPACES)) != "")).cast("long")

    @property
    def n_letterless(self) -> Column:
        """Words without a letter: the padded text is cut where a gap, such a word and a gap meet."""
        bare = r"[\x20\x09-\x0D][^\p{L}\x20\x09-\x0D]++(?=[\x20\x09-\x0D])"
        return T.count_of(F.concat(F.lit(" "), self.text, F.lit(" ")), bare)

    @property
    def n_repeat_words(self) -> Column:
        """Words inside 3-word windows that the text has twice or more.

        Windows are compared by 64-bit hashes. Without a repeated hash the answer is 0. A few repeated ones are
        looked up for each position; of many, positions sorted by hash put equal windows side by side.
        """
        windows = T.let(
            self.words,
            lambda w: F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
            ),
        )

        def covered(positions: Column) -> Column:
            starts = F.filter(positions, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        def looked_up(g: Column, repeated: Column) -> Column:
            return covered(F.transform(g, lambda x, i: F.when(F.array_contains(repeated, x), i)))

        def side_by_side(g: Column) -> Column:
            def equal(s: Column, k: Column, e: Column) -> Column:
                return F.coalesce(F.get(s, k)["g"] == e["g"], F.lit(False))

            return T.let(
                F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
                lambda s: covered(F.transform(s, lambda e, k: F.when(equal(s, k - 1, e) | equal(s, k + 1, e), e["i"]))),
            )

        def repeats(g: Column) -> Column:
            return T.let(
                T.let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))),
                lambda repeated: F.when(F.size(repeated) <= 32, looked_up(g, repeated)).otherwise(side_by_side(g)),
            )

        return T.let(
            windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeats(g))
        ).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], Column]


#: What a text must have at least; the contract's base.
BASE_RULES = [
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
]
#: The further rules: published heuristics for web text, set so that ordinary prose in any alphabet passes.
EXTRA_RULES = [
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 12 * f.n_words)),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
    Rule("capitals", lambda f: 5 * T.count_of(f.text, r"\p{Lu}") > 2 * f.word_chars),
    Rule("exclamations", lambda f: 10 * T.count_of(f.text, "!") > 3 * f.n_words),
    Rule("letterless_words", lambda f: 5 * f.n_letterless > f.n_words),
]


def _judged(text: Column, body: Callable[[Facts], Column]) -> Column:
    """body of the facts of a text, whose words are cut once."""
    return T.let(T.words(text), lambda w: body(Facts(text, w)))


def sample_of(docs: DataFrame, id_col: str, text_col: str, sample_rows: int, max_bytes: int) -> DataFrame:
    """__text, __words of some sample_rows rows spread over the whole table: those with the lowest hashes of the id.

    Ids are chosen from their column alone; the texts are then read by id. Texts of over max_bytes don't serve.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).filter("id IS NOT NULL")
    picked = [r["id"] for r in bounded_sample(ids, sample_rows, ids.count(), "id").collect()]  # sample_rows ids at most
    text = T.text_of(F.col(f"`{text_col}`"))
    rows = docs.filter(F.col(f"`{id_col}`").isin(picked)).filter(F.octet_length(text) <= max_bytes)
    return written(rows.select(text.alias("__text"), T.words(text).alias("__words")), "quality-sample")


def measure(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = 400, id_col: str = "doc_id", max_bytes: int = 1 << 20) -> dict[str, tuple[float, float]]:
    """For each rule the seconds and the share of rejected rows over a sample (see sample_of).

    Words are cut beforehand, each row is judged eight times over, a first job warms up, the better of two runs counts,
    and what a job without a rule takes is taken off. The sample only sets the order of the rules; which texts are kept
    never depends on it.
    """
    sample = sample_of(docs, id_col, text_col, sample_rows, max_bytes).select("*", F.explode(F.sequence(F.lit(1), F.lit(8))))

    def timed(test: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        got = sample.agg(F.count_if(test).alias("hit"), F.count("*").alias("n")).first()
        return time.perf_counter() - began, got["hit"] or 0, got["n"]

    facts = Facts(F.col("__text"), F.col("__words"))
    nothing = F.size(facts.words) + F.length(facts.text) < 0  # reads both columns
    timed(nothing)
    empty = min(timed(nothing)[0] for _ in range(2))
    found = {}
    for rule in rules:
        (a, hit, n), (b, _, _) = timed(rule.rejects(facts)), timed(rule.rejects(facts))
        found[rule.name] = (max(min(a, b) - empty, 0.0), hit / n if n else 0.0)
    return found


def ordered(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per cost, highest first; ties by name. Costs under a millisecond count as one: they can't be told apart."""
    return sorted(rules, key=lambda r: (-measured[r.name][1] / max(measured[r.name][0], 1e-3), r.name))


def first_rejection(rules: list[Rule], facts: Facts) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated for that row."""
    chain = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(facts), F.lit(False))
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string")) if chain is not None else F.lit(None).cast("string")


def quality_filter(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 400, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that a rule rejects, columns as they were.

    Null and empty texts have no words and are rejected as too short. Repeated rows are judged alike and
    each kept or dropped. Any further columns pass through; an empty table stays empty.
    """
    rules = rules if rules is not None else [*BASE_RULES, *EXTRA_RULES]
    chain = ordered(rules, measure(docs, rules, text_col, sample_rows, id_col))
    return docs.filter(_judged(T.text_of(F.col(f"`{text_col}`")), lambda f: first_rejection(chain, f)).isNull())


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> DataFrame:
    """A row per input row: its id, the base facts, base_failed, kept, and the rule that rejected it (or null).

    The extra rules run only where the base passes. Other input columns are left out.
    """
    chain = ordered(EXTRA_RULES, measure(docs, EXTRA_RULES, text_col, sample_rows, id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = rows.withColumn("__text", T.text_of(F.col("text"))).withColumn("__words", T.words(F.col("__text")))
    f = Facts(F.col("__text"), F.col("__words"))
    base = base.select("doc_id", "__text", "__words", *[getattr(f, k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    why = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(chain, f))
    return (
        base.withColumn("base_failed", failed)
        .withColumn("rejected_by", why)
        .withColumn("kept", F.col("rejected_by").isNull())
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
    )
