"""The pipeline's stages on a small corpus, each against a plain version of its decisions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from factlens.llm import shingles as S


def _prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice(["ive", "ona", "eld", "urn", "ist"]) + str(rng.randrange(40)) * (rng.random() < 0.2) + rng.choice("qrst") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        rows.append([i, _prose(rng, rng.randrange(60, 200)), "en", f"src{i % 4}", 0])
    rows[10][1] = rows[3][1]
    rows[11][1] = rows[3][1] + " tail"
    rows[20][1] += " write to jo.doe@mail.example.org or +1 (555) 555-0199"
    rows += [[200, "short", "en", "src1", 5], [201, None, "en", None, 0], [202, "", "en", "src0", 0], [203, "spam! " * 80, "en", "src2", 0], [204, _prose(rng, 9000), "en", "src3", 0]]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    return str(d), [tuple(r) for r in rows]


def test_stages(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "near-duplicates", "pii", "mixing", "packing"]
    good = P.STAGES[0][1](spark, docs, d)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r[0] for r in rows} - {200, 201, 202, 203}

    unique = P.STAGES[1][1](spark, good, d)
    memory = S.WordHashes()
    sets = {r[0]: set(S.shingle_set(r[1], 5, memory).tolist()) for r in rows if r[0] in kept}
    drop = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {r["doc_id"] for r in unique.collect()} == kept - drop and drop >= {10, 11}

    clean = P.STAGES[2][1](spark, unique, d)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[20].endswith("write to [EMAIL] or [PHONE]")
    assert all(texts[r[0]] == r[1] for r in rows if r[0] in texts and r[0] != 20)

    mixed = P.STAGES[3][1](spark, clean, d)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for i, t in texts.items():
        size[source[i]] += len(t.split())
        taken[source[i]] += copies[i] * len(t.split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.35)

    packed = P.STAGES[4][1](spark, mixed, d)
    assert Counter(r["doc_id"] for r in packed.collect()) == copies
    assert all(texts[r["doc_id"]] == r["text"] and source[r["doc_id"]] == r["source"] for r in packed.collect())


def test_run(spark, corpus):
    d, rows = corpus
    packed = P.run(spark, d).collect()
    texts = {r[0]: r[1] for r in rows}
    assert packed and all(r["length"] <= r["bucket_length"] and r["length"] == len(r["text"].split()) for r in packed)
    assert all(r["text"] == texts[r["doc_id"]] or r["doc_id"] == 20 for r in packed)
    assert all("jo.doe" not in r["text"] for r in packed)
    assert P.ORACLE_SQL is None


def _table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, batch string, key string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    assert P.run(spark, _table(spark, [], tmp_path / "empty")).count() == 0
    rng = random.Random(3)
    text = _prose(rng, 80)
    odd = [(None, None, None, None, None, 1, "b", "k")] * 2 + [(1, text, None, None, None, 1, "b", "k")] * 2 + [(2, text, "en", "", 0, 1, None, None), (None, _prose(rng, 90), "en", "s", 0, 1, "b", "k"), (3, "", "en", "s", 0, 1, "b", "k")]
    got = P.run(spark, _table(spark, odd, tmp_path / "odd"))
    assert got.columns.count("length") == got.columns.count("batch") == 1
    ids = {r["doc_id"] for r in got.collect()}
    assert ids <= {1, None} and ids
    assert P.STAGES[1][1](spark, spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, length int, batch string, key string"), "").filter("doc_id = 1").count() == 1
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, length int, batch string, key string")
        assert stage(spark, docs, "").columns == docs.columns, name
