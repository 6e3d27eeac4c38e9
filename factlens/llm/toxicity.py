"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of its words; a document's is the
noisy-or of its sentences, 1 - prod(1 - p). Weights are learned from document labels alone, through the noisy-or, by
full-batch Adam; afterwards the sentence probabilities locate what offends.

Features are words, and their first four and five letters, lower-cased; those whose document frequencies differ
between the classes (chi-squared) are kept. The fit uses a bounded sample: at most `max_positive` and `max_negative`
labelled documents with the lowest hashes, and at most `max_bytes` of text, where texts of over 1/64 of that come last,
the shorter first, so that a long text can only take the place of longer ones; the toxic
class weighs as its share among all labels, or 0.3 if that is more, so that rare toxic words still count. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factlens.llm.store import bounded_sample, ship, written

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
MAX_FEATURES, CHI2 = 4000, 15.0


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences; each ends at a full stop, question or exclamation mark or newline."""
    return (m.span() for m in _SENTENCE.finditer(text))


def word_features(word: str) -> set[str]:
    return {word, "^" + word[:4], "^" + word[:5]}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


class _WordScores(dict):
    """Word to its total weight, remembered up to a bound."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return total


def sentence_probabilities(model: Model, text: str, scores: _WordScores) -> list[tuple[int, int, float]]:
    out = []
    for a, b in sentences(text):
        total = 0.0
        for w in set(_WORD.findall(text[a:b].lower())):
            total += scores[w]
        if total > -model.bias - 14.0:
            out.append((a, b, float(1 / (1 + np.exp(-(model.bias + total))))))
        else:
            out.append((a, b, 0.0))
    return out


def fit(texts: list[str], toxic: list[int], share: float, rounds: int = 300, rate: float = 0.15, l2: float = 2e-5, least_share: float = 0.3) -> Model:
    """share: of toxic documents among all labelled ones; the classes are weighted to it, or to least_share if that is more."""
    share = max(share, least_share)
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -20.0 if not len(y) or y.max() == 0 else 20.0)
    n1, n0 = y.sum(), (1 - y).sum()
    # words and features as numbers: a sentence is an array of its distinct words
    word_ids: dict[str, int] = {}
    feature_ids: dict[str, int] = {}
    of_word: list[list[int]] = []
    bags: list[list[np.ndarray]] = []
    df = [np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)]
    for text, t in zip(texts, toxic, strict=True):
        bag, found = [], set()
        for a, b in sentences(text):
            ids = set()
            for w in _WORD.findall(text[a:b].lower()):
                i = word_ids.setdefault(w, len(word_ids))
                if i == len(of_word):
                    of_word.append([feature_ids.setdefault(f, len(feature_ids)) for f in word_features(w)])
                ids.add(i)
            if ids:
                bag.append(np.fromiter(ids, np.int32, len(ids)))
                found |= ids
        bags.append(bag)
        while len(feature_ids) > len(df[0]):
            df = [np.concatenate([x, np.zeros_like(x)]) for x in df]
        seen = {f for i in found for f in of_word[i]}
        df[int(t)][np.fromiter(seen, np.int64, len(seen))] += 1
    size = len(feature_ids)
    a1, a0 = df[1][:size].astype(float), df[0][:size].astype(float)
    chi2 = (n1 + n0) * (a1 * (n0 - a0) - a0 * (n1 - a1)) ** 2 / np.maximum((a1 + a0) * (n1 + n0 - a1 - a0) * n1 * n0, 1)
    chi2[a1 + a0 < 4] = 0
    spelled = list(feature_ids)
    best = sorted(np.flatnonzero(chi2 >= CHI2).tolist(), key=lambda i: (-chi2[i], spelled[i]))[:MAX_FEATURES]
    names = [spelled[i] for i in best]
    index = {f: j for j, f in enumerate(best)}
    kept = {i: at for i, fs in enumerate(of_word) if (at := [index[f] for f in fs if f in index])}
    del word_ids, feature_ids, of_word, spelled

    row, col, doc, n = [], [], [], 0
    counts = []
    for d, bag in enumerate(bags):
        plain = 0
        for s in bag:
            at = [j for i in s.tolist() if i in kept for j in kept[i]]
            if at:
                row += [n] * len(at)
                col += at
                doc.append(d)
                n += 1
            else:
                plain += 1
        counts.append(plain)  # sentences without a kept feature share the bias alone
    del bags
    row, col, doc, plain = np.array(row, int), np.array(col, int), np.array(doc, int), np.array(counts, float)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    x = np.r_[np.zeros(len(names)), -6.0]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = np.bincount(row, x[col], n) + x[-1] if n else np.zeros(0)
        # log prod(1 - p) = -sum softplus(z)
        soft = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, x[-1])
        miss = np.exp(-soft)
        hit = np.maximum(1 - miss, 1e-12)
        outer = weight * np.where(y == 1, -miss / hit, 1.0) / len(y)  # dLoss / dsoft
        g = outer[doc] / (1 + np.exp(-z)) if n else np.zeros(0)
        grad = np.r_[np.bincount(col, g[row], len(names)) if n else np.zeros(len(names)), g.sum() + (outer * plain).sum() / (1 + np.exp(-x[-1]))]
        grad[:-1] += l2 * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w) for f, w in zip(names, x[:-1], strict=True) if abs(w) > 1e-3}, float(x[-1]))


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int, max_bytes: int) -> tuple[list[str], list[int], float]:
    """docs(doc_id, text), labels(doc_id, toxic) -> texts, labels, share of toxic ones; folds with crc32 mod 5 = 0 left out."""
    spark = docs.sparkSession
    allowed = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    allowed = allowed.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    n = {r["toxic"]: r["n"] for r in allowed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = n.get(1, 0) / max(sum(n.values()), 1)
    picks = [r for t, k in ((1, max_positive), (0, max_negative)) for r in bounded_sample(allowed.filter(F.col("toxic") == t), k, n.get(t, 0), "doc_id").collect()]
    if not picks:
        return [], [], 0.0
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in picks], "d long, toxic int, h long")
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("d"))
    # sizes alone decide what fits; whole texts are fetched after that
    size = F.octet_length("text").cast("long")
    sizes = rows.select("doc_id", "h", "toxic", size.alias("size")).groupBy("doc_id", "h", "toxic").agg(F.sum("size").alias("size"))
    sizes = sizes.withColumn("long", F.when(F.col("size") > max_bytes // 64, F.col("size")).otherwise(F.lit(0)))
    order = Window.orderBy("long", "h", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a number a picked id
    fits = written(sizes.withColumn("bytes", F.sum("size").over(order)).filter(F.col("bytes") <= max_bytes).select(F.col("doc_id").alias("fit")), "toxic-fits")
    rows = rows.join(F.broadcast(fits), F.col("doc_id") == F.col("fit"), "left_semi").select("toxic", "text").collect()  # max_bytes of text at most
    return [r["text"] for r in rows], [r["toxic"] for r in rows], float(share)


def _scored(model: Model):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]
    )

    def run(batches):
        scores = _WordScores(model.weights)
        for b in batches:
            score, offending = [], []
            for t in b.column(1):
                found = sentence_probabilities(model, t.as_py() or "", scores)
                # sentences near 0 share one term: their bias
                miss = 0.0
                for _, _, p in found:
                    miss += np.log1p(-min(p, 1 - 1e-15)) if p else 0.0
                score.append(float(-np.expm1(miss)))
                offending.append([{"start": a, "end": z, "p": p} for a, z, p in found if p >= 0.5])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(offending, schema.field(2).type)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, score, offending (spans of sentences with p >= 0.5, code points).

    Null and empty texts have no sentence and score 0. Equal texts score alike; other columns are left out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double, offending array<struct<start:int,end:int,p:double>>")


def detect(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_negative: int = 4000, max_bytes: int = 24 << 20) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted, offending.

    Labels of unknown documents and null labels are ignored; of contradicting ones the toxic one counts. Without
    labels of both classes every score is (nearly) 0 or 1 after the one class. Empty tables give empty results.
    """
    docs = docs.select("doc_id", "text")
    model = fit(*training_sample(docs, labels.select("doc_id", "toxic"), max_positive, max_negative, max_bytes))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
