"""Personal data: generators propose overlapping spans, boosted trees with a calibrated threshold choose.

Strict patterns with their checks (part ranges, Luhn, digit counts) give base spans, which always stay.
High-recall generators propose any longer run of digits and separators, what base spans leave of such a run, and
masked addresses. Boosted trees learn from a proposal's format and context, not from the checks themselves, on all that
no base span overlaps: equal formats are counted and learnt as one row with their number as weight. Positive examples are proposals with a weak label (a masked
address that is whole when unmasked, a run of 7 to 15 digits right after a word for a phone, a phone left over of a
longer run) and base spans written in forms the strict patterns miss (masked, local, dotted) where they stand; all
others are negative, and so are base spans spoilt in their format (cards with a wrong check digit, addresses with a part
over 255). Scores from models that did not see a row (four folds) are turned into probabilities by isotonic steps, for
each kind by itself where it has enough examples; a kind's threshold is the lowest score with the stated precision. Proposals above
it that no base span overlaps are added; of two that overlap, the one with the higher score.

All scanning and scoring are Column expressions. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm import boosting
from factlens.llm import text as T
from factlens.llm.store import written

KINDS = ("email", "ip", "card", "phone")
# Matches start at the end of the one before or where no character of the run precedes; runs are possessive. That keeps
# every scan linear and matches what the plain patterns match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"[+(]?[0-9][0-9\x20().-]{5,}+"
MASKED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]{1,255}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}){0,5}"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def worth(i: Column) -> Column:
            n = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, n).otherwise(2 * n - F.when(n > 4, F.lit(9)).otherwise(F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0

    return T.let(digits, total)


def _part_ok(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.substr(short, F.lit(1), F.lit(3)).cast("int") <= 255)


_KEEP = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["value"], r"\."), _part_ok),
    "card": lambda s: T.let(_digits(s["value"]), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))),
    "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's spans; the cheap tests in front spare most texts the patterns."""
    tests = {
        "email": (text.contains("@"), EMAIL),
        "ip": (text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), IP),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD),
        "phone": (text.rlike(r"\+[0-9]"), PHONE),
    }
    none = F.array().cast(T.NO_SPANS)
    return {k: F.when(test, F.filter(T.spans(text, p), _KEEP[k])).otherwise(none) for k, (test, p) in tests.items()}


def _trimmed(spans: Column, after: str) -> Column:
    return F.transform(
        spans,
        lambda s: T.let(
            F.regexp_replace(s["value"], after, ""),
            lambda v: F.struct(s["start"].alias("start"), (s["start"] + F.length(v)).alias("end"), v.alias("value")),
        ),
    )


def _left_over(s: Column, base: Column) -> Column:
    """What the base spans leave of a run that some of them overlap: from its start or the end of one to the next."""

    def piece(at: Column, inside: Column) -> Column:
        end = F.coalesce(F.array_min(F.transform(F.filter(inside, lambda b: b["start"] >= at), lambda b: b["start"])), s["end"])
        return T.let(
            F.substr(s["value"], at - s["start"] + 1, F.greatest(end - at, F.lit(0))),
            lambda v: T.let(
                F.regexp_replace(v, r"^[\x20).-]+", ""),
                lambda w: F.struct((at + F.length(v) - F.length(w)).alias("start"), (at + F.length(v)).alias("end"), w.alias("value")),
            ),
        )

    def pieces(inside: Column) -> Column:
        starts = F.array_distinct(F.concat(F.array(s["start"]), F.transform(inside, lambda b: b["end"])))
        free = F.filter(starts, lambda at: (at < s["end"]) & ~F.exists(inside, lambda b: (b["start"] <= at) & (at < b["end"])))
        return F.transform(free, lambda at: piece(at, inside))

    return T.let(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), pieces)


def proposals(text: Column, base: Column) -> Column:
    """Masked addresses, runs of digits and separators, and what base spans leave of these; all end at a letter, digit or bracket."""
    none = F.array().cast(T.NO_SPANS)
    ends = r"[\x20(.-]+$"
    rest = lambda runs: F.filter(
        _trimmed(F.flatten(F.transform(F.filter(runs, lambda s: _overlaps(base, s)), lambda s: _left_over(s, base))), ends),
        lambda s: s["value"].rlike("^" + NUMBER),
    )
    numbers = T.let(_trimmed(T.spans(text, NUMBER), ends), lambda runs: F.concat(runs, rest(runs)))
    return F.concat(
        F.when(text.rlike(r"[\[(]at[\])]"), _trimmed(T.spans(text, MASKED), r"[.-]+$")).otherwise(none),
        F.when(text.rlike(r"[0-9][0-9\x20().-]{5}"), numbers).otherwise(none),
    )


def rendered(text: Column, base: dict[str, Column], good: bool = True) -> Column:
    """Features of base spans in their context as they would be in a masked, local or dotted form, or (not good) spoilt."""

    def pick(s: Column, *forms: Column) -> Column:
        return F.get(F.array(*forms), F.pmod(F.xxhash64(s["value"], s["start"]), F.lit(len(forms))).cast("int"))

    def masked(s: Column) -> Column:
        name, host = F.substring_index(s["value"], "@", 1), F.substring_index(s["value"], "@", -1)
        dots = lambda to: F.regexp_replace(host, r"\.", to)
        return pick(
            s, F.concat(name, F.lit(" (at) "), dots(" (dot) ")), F.concat(name, F.lit("[at]"), dots("[dot]")),
            F.concat(name, F.lit(" [at] "), host), F.concat(name, F.lit("(at)"), host),
        )

    def local(s: Column) -> Column:
        digits = F.right(_digits(s["value"]), F.least(F.length(_digits(s["value"])) - 1, F.lit(10)))
        cut = lambda form: F.regexp_replace(digits, "^([0-9]*)([0-9]{3})([0-9]{4})$", form)
        forms = [F.regexp_replace(cut(form), r"^(?:\(\))?[\x20.-]+", "") for form in ("$1-$2-$3", "$1.$2.$3", "$1 $2 $3", "($1) $2-$3")]
        return pick(s, *forms)

    def dotted(s: Column) -> Column:
        return F.regexp_replace(_digits(s["value"]), "([0-9]{4})(?=[0-9])", "$1.")

    def spoilt_card(s: Column) -> Column:
        last = F.right(s["value"], F.lit(1)).cast("int")
        return F.concat(F.substr(s["value"], F.lit(1), F.length(s["value"]) - 1), ((last + 1 + F.pmod(F.xxhash64(s["value"]), F.lit(9))) % 10).cast("string"))

    def spoilt_ip(s: Column) -> Column:
        return F.regexp_replace(s["value"], "^[0-9]+", "864")

    def one(s: Column, form: Column) -> Column:
        return T.let(
            F.struct(F.substr(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("b"), form.alias("v"), F.substr(text, s["end"] + 1, F.lit(1)).alias("a")),
            lambda x: features(
                F.concat(x["b"], x["v"], x["a"]),
                T.let(F.length(x["b"]), lambda n: F.struct(n.alias("start"), (n + F.length(x["v"])).alias("end"), x["v"].alias("value"))),
            ),
        )

    of = lambda form: lambda s: one(s, form(s))
    forms = (("email", masked), ("phone", local), ("card", dotted)) if good else (("ip", spoilt_ip), ("card", spoilt_card))
    return F.concat(*[F.transform(base[k], of(form)) for k, form in forms])


FEATURES = [
    "n_chars", "n_digits", "n_groups", "longest_group", "n_dots", "n_dashes", "n_spaces", "n_brackets", "plus", "masked", "first_digit",
    "after_letter", "before_letter", "after_mark", "said_phone", "said_card", "said_address", "said_key",
    "asked_phone", "dated", "whole_address",
]


#: Right before a number: a word for a phone, perhaps with such as 'me at' or 'number is' after it.
ASKED = r"(?<![\p{L}0-9])(?:phone|telephone|tel|call|fax|mobile|cell)[^\p{L}0-9]{0,4}(?:(?:me|us|at|on|is|no|number)[^\p{L}0-9]{1,3}){0,2}$"
DATED = r"^(?:19|20)[0-9]{2}[.\x20-][0-9]{1,2}[.\x20-][0-9]{1,2}(?![0-9])"


def _unmasked(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")


def features(text: Column, s: Column) -> Column:
    """Format of the value and context of 24 characters before; one struct<double...>."""
    v = s["value"]

    def number(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    before = F.substr(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    after = F.substr(text, s["end"] + 1, F.lit(1))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    return T.let(
        F.struct(before.alias("b"), F.lower(before).alias("l"), after.alias("a"), groups.alias("g")),
        lambda c: F.struct(
            *[
                x.alias(n)
                for n, x in zip(
                    FEATURES,
                    [
                        number(F.length(v)),
                        number(F.length(_digits(v))),
                        number(F.size(c["g"])),
                        number(F.array_max(F.transform(c["g"], lambda g: F.length(g)))),
                        *[number(F.size(F.split(v, p, -1)) - 1) for p in (r"\.", "-", r"\x20", r"[()]")],
                        number(v.startswith("+")),
                        number(v.rlike(r"[\[(]at[\])]")),
                        number(F.try_to_number(F.substr(_digits(v), F.lit(1), F.lit(1)), F.lit("9"))),
                        number(c["b"].rlike(r"[\p{L}0-9]$")),
                        number(c["a"].rlike(r"^[\p{L}0-9]")),
                        number(c["b"].rlike(r"[\"'=:#]\x20?$")),
                        number(c["l"].rlike(r"phone|tel|call|fax|mobile|cell")),
                        number(c["l"].rlike(r"card|visa|credit|iban|account")),
                        number(c["l"].rlike(r"mail|address|contact|\bip\b|host")),
                        number(c["l"].rlike(r"key|token|secret|passw|id\b|hash")),
                        number(c["l"].rlike(ASKED)),
                        number(v.rlike(DATED)),
                        number(_unmasked(v).rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+$")),
                    ],
                    strict=True,
                )
            ]
        ),
    )


def _overlaps(base: Column, s: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __email, __ip, __card, __phone, __proposed (span, features, whether a base span overlaps), and features of
    base spans rendered (__rendered) and spoilt (__spoilt)."""
    t = docs.withColumn("__text", T.text_of(F.col(text_col)))
    base = base_spans(F.col("__text"))
    every = F.concat(*[F.col(f"__{k}") for k in KINDS])
    t = t.withColumns({f"__{k}": c for k, c in base.items()}).withColumn("__raw", proposals(F.col("__text"), every))
    proposed = F.transform(
        "__raw",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), features(F.col("__text"), s).alias("f"), _overlaps(every, s).alias("known")
        ),
    )
    own = {k: F.col(f"__{k}") for k in KINDS}
    again = {"__rendered": rendered(F.col("__text"), own), "__spoilt": rendered(F.col("__text"), own, good=False)}
    return t.withColumn("__proposed", proposed).withColumns(again).drop("__raw")


#: Trees split at up to so many quantiles of a feature.
CUTS = 16
FOLDS = 4


@dataclass
class Chooser:
    """thresholds: by the number of the kind."""

    model: boosting.Boosted
    thresholds: tuple[float, ...]


def _new(p: Column) -> Column:
    return ~p["known"]


def kind_of(f) -> Column:
    """The kind (its number) that a proposal would have, by its features."""
    chain = F.when(f["masked"] > 0, F.lit(0)).when(f["n_digits"] > 15, F.lit(2))
    return chain.when((f["n_dots"] == 3) & (f["longest_group"] <= 3), F.lit(1)).otherwise(F.lit(3))


def isotonic(scores: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[float, float, float, int]]:
    """Steps (lowest and highest score, share of positives, rows) from the lowest up, with rising shares: neighbours that fall are pooled."""
    steps: list[list[float]] = []
    levels, at = np.unique(scores, return_inverse=True)
    w = np.ones(len(scores)) if weight is None else weight
    for level, tied_hits, tied in zip(levels, np.bincount(at, w * y, len(levels)), np.bincount(at, w, len(levels)), strict=True):
        steps.append([float(level), float(level), float(tied_hits), float(tied)])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            _, high, hits, n = steps.pop()
            steps[-1][1] = high
            steps[-1][2] += hits
            steps[-1][3] += n
    return [(low, high, hits / n, int(n)) for low, high, hits, n in steps]


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float, least: int = 5, weight: np.ndarray | None = None) -> float:
    """The score from which on isotonic steps have `precision`, half way to the step below; above 1 if fewer than `least`
    rows are that high."""
    steps = isotonic(scores, y, weight)
    bad = [high for _, high, share, _ in steps if share < precision]
    good = [(low, n) for low, _, share, n in steps if share >= precision]
    if sum(n for _, n in good) < least:
        return 2.0
    low = min(low for low, _ in good)
    return (low + max(bad)) / 2 if bad else low


def _weak(f) -> Column:
    ran_on = (f["plus"] > 0) & f["n_digits"].between(8, 15)  # a phone that ran into another number
    return ran_on | (f["whole_address"] > 0) | ((f["asked_phone"] > 0) & (f["masked"] == 0) & (f["dated"] == 0) & f["n_digits"].between(7, 15))


def examples(scan: DataFrame) -> DataFrame:
    """FEATURES, y, n: how many examples have these features: proposals that no base span overlaps, rendered and spoilt base spans."""
    one = lambda f, y: F.struct(f.alias("f"), y.alias("y"))
    every = F.concat(
        F.transform(F.filter("__proposed", _new), lambda p: one(p["f"], _weak(p["f"]))),
        F.transform("__rendered", lambda f: one(f, F.lit(True))),
        F.transform("__spoilt", lambda f: one(f, F.lit(False))),
    )
    return scan.select(F.explode(every).alias("e")).select("e.f.*", "e.y").groupBy(*FEATURES, "y").agg(F.count("*").alias("n"))


def _cells(forms: DataFrame, edges: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Columns of FEATURES, kind, y, n, fold, sorted: a feature's value is the next of its edges, or one above the last, so
    that no split at an edge can tell it from the value itself."""

    def up(name: str, at: np.ndarray) -> Column:
        chain = F
        for c in at:
            chain = chain.when(F.col(name) <= float(c), F.lit(float(c)))
        return chain.otherwise(F.lit(float(at[-1]) + 1)).alias(name)

    key = [*FEATURES, "kind", "y"]
    cells = forms.select(*[up(n, at) for n, at in zip(FEATURES, edges, strict=True)], kind_of({n: F.col(n) for n in FEATURES}).alias("kind"), F.col("y").cast("int").alias("y"), "n")
    table = cells.groupBy(*key).agg(F.sum("n").alias("n")).withColumn("fold", F.pmod(F.xxhash64(*key), F.lit(FOLDS))).toArrow()
    found = {n: table[n].to_numpy() for n in table.column_names}
    order = np.lexsort([found[n] for n in key])
    return {n: c[order] for n, c in found.items()}


def fit(scan: DataFrame, sample: int | None = None, precision: float = 0.95) -> Chooser:
    """From all proposals that no base span overlaps and all rendered and spoilt base spans. Only the number of examples
    in each cell between the edges that the trees may split at comes to the driver, which says all about them that the
    trees can use. Thresholds are calibrated on all examples, each scored by trees of the other folds. A kind with under
    ten rows of either class has the threshold of all. sample is without effect; callers may still give it.
    """
    forms = written(examples(scan), "pii-forms")
    quantiles = F.array(*[F.lit(i / CUTS) for i in range(CUTS)])
    edges = forms.agg(*[F.percentile(n, quantiles, F.col("n")).alias(n) for n in FEATURES]).first()
    if edges[0] is None:
        return Chooser(boosting.Boosted(FEATURES), (2.0,) * len(KINDS))
    edges = [np.unique(at) for at in edges]
    cells = _cells(forms, edges)
    x, y, n, kinds = np.stack([cells[f] for f in FEATURES], axis=1), cells["y"].astype(float), cells["n"].astype(float), cells["kind"]
    learn = lambda w: boosting.fit(x[w > 0], y[w > 0], FEATURES, rounds=40, weight=w[w > 0], edges=edges)
    # the n examples of a cell are dealt evenly to the folds
    dealt = [(n + (cells["fold"] + k) % FOLDS) // FOLDS for k in range(FOLDS)]
    scores = [1 / (1 + np.exp(-learn(n - w).margin(x))) for w in dealt]
    scores, dealt, truth, kinds = np.concatenate(scores), np.concatenate(dealt), np.tile(y, FOLDS), np.tile(kinds, FOLDS)

    def threshold(mine: np.ndarray) -> float:
        mine = mine & (dealt > 0)
        return calibrated(scores[mine], truth[mine], precision, weight=dealt[mine])

    of_all = threshold(np.full(len(scores), True))

    def own(k: int) -> float:
        mine = kinds == k
        return threshold(mine) if 10 <= (dealt * truth)[mine].sum() <= dealt[mine].sum() - 10 else of_all

    return Chooser(learn(n), tuple(own(k) for k in range(len(KINDS))))


def chosen(scan: DataFrame, chooser: Chooser) -> DataFrame:
    """Adds __spans: array<struct<kind, start, end>> of base spans and chosen proposals, unsorted."""
    score = lambda p: chooser.model.column(lambda n: p["f"][n])
    thresholds = F.array(*[F.lit(t) for t in chooser.thresholds])
    scored = F.transform(
        F.filter("__proposed", _new),
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), score(p).alias("score"), kind_of(p["f"]).alias("kind")),
    )
    # runs of digits don't overlap one another, nor do masked addresses: in order of start, neighbours settle who stays
    sure = F.sort_array(F.filter(scored, lambda p: p["score"] >= F.get(thresholds, p["kind"])))

    def stays(all_: Column, p: Column, i: Column) -> Column:
        before, after = F.get(all_, i - 1), F.get(all_, i + 1)
        beaten = F.coalesce((before["end"] > p["start"]) & (before["score"] >= p["score"]), F.lit(False))
        return ~beaten & ~F.coalesce((after["start"] < p["end"]) & (after["score"] > p["score"]), F.lit(False))

    one = lambda k, s: F.struct(k.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = T.let(sure, lambda all_: F.transform(F.filter(all_, lambda p, i: stays(all_, p, i)), lambda p: one(p["kind"], p)))
    of_kind = lambda i: lambda s: one(F.lit(i), s)
    base = [F.transform(f"__{k}", of_kind(i)) for i, k in enumerate(KINDS)]
    return scan.withColumn("__spans", F.concat(*base, added))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, precision: float = 0.95) -> DataFrame:
    """A row per input row: doc_id, email, ip, card, phone (base spans with values), spans (all, with kind's number).

    Each text is scanned once; what it yields is written before the model is fitted. Null and empty texts have no
    spans, repeated rows give equal rows, an empty table an empty result; other columns are left out.
    """
    scan = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    scan = written(scan.select("doc_id", *[f"__{k}" for k in KINDS], "__proposed", "__rendered", "__spoilt"), "pii-scan")
    return chosen(scan, fit(scan, sample, precision)).select("doc_id", *[F.col(f"__{k}").alias(k) for k in KINDS], F.col("__spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", sample: int | None = None, precision: float = 0.95) -> DataFrame:
    """docs with each span in text_col replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans by the first's mark.

    Rows and other columns stay as they are; a null text stays null. The model is fitted in a first pass.
    """
    first = scanned(docs.select(F.col(text_col).alias("text")), "text").select("__proposed", "__rendered", "__spoilt").filter("size(__proposed) + size(__rendered) + size(__spoilt) > 0")
    chooser = fit(written(first, "pii-proposals"), sample, precision)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).withColumn("__t", F.col(f"__row.{text_col}"))
    t = chosen(scanned(inner, "__t"), chooser)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            F.concat(acc["out"], F.substr(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"])).alias("out"),
            s["end"].alias("at"),
        ),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("__text"), acc["at"] + 1, F.length("__text"))))
    text = F.when(F.col("__t").isNull() | (F.size("__spans") == 0), F.col("__t")).otherwise(clean)
    return t.withColumn("__new", text).select(*[F.col("__new").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns])
