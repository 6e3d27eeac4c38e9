"""Chat, packing, toxicity, near-duplicates and media against plain versions and exact round trips."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlens.llm import chat, components, media, neardup, packing, store, toxicity
from factlens.llm import shingles as S

# ---- chat --------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="<|\\ab\n", max_size=12))
def test_escape_round_trip(s):
    assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    assert chat.unescape_header(chat.escape_header(s)) == s and "\n" not in chat.escape_header(s)


def _render(source, turns):
    return list(chat.compile_template(source)(turns))


def test_template_language():
    turns = [{"role": "user", "text": "hi"}, {"role": "bot", "text": " yo "}]
    out = _render("A{% for m in messages %}{% if loop.first %}<{% elif m.role == 'bot' and not loop.first %}[{% else %}?{% endif %}{{ m.text | trim | upper }}{% endfor %}Z", turns)
    assert "".join(t for t, _ in out) == "A<HI[YOZ"
    masked = _render("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}.{% endfor %}", turns)
    assert masked == [("hi", True), (".", False), (" yo ", True), (".", False)]
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% else %}d{% endif %}"))
    assert tree == (chat.Say(chat.Const("abCd")),)
    for bad in ("{{ message.__class__ }}", "{{ x }}", "{% for a in b %}{% endfor %}", "{% if 1 %}", "{{ 'a' | eval }}", "{{ 'a }}", "{% import os %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ loop.first }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def _digests(turns):
    h, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
    for r, t in turns:
        h.update(f"{r}\n{t}\n".encode())
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats(spark):
    rng = random.Random(1)
    parts = ["<|im_end|>", "<|im_start|>assistant ok", "<", "|", "\\", "\n", "é🎉", "word", "<\\|"]
    convs = {i: [(rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 9))] for i in range(60)}
    convs[-1] = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    convs[100] = [("ro\nle\\", "x")]
    convs[101] = [("assistant", "long " * 20_000)] * 3 + [("user", "")]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(200, 0, "user", None), (200, 1, None, "x")]
    convs[200] = [("user", ""), ("", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    for part_chars in (1 << 20, 1000):
        formatted = chat.format_chats(df, part_chars=part_chars)
        got = {r["conv_id"]: r for r in chat.chat_digests(formatted).collect()}
        assert set(got) == set(convs)
        for c, turns in convs.items():
            assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == _digests(turns), c
    whole = {}
    for r in chat.format_chats(df).orderBy("conv_id", "part").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["text"]
    assert {c: len(t) for c, t in whole.items()} == {c: got[c]["formatted_chars"] for c in got}
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------


def _least_padding(lengths, buckets):
    values = sorted(set(lengths))
    from itertools import combinations

    best = None
    for k in range(min(buckets, len(values))):
        for cut in combinations(values[:-1], k):
            ends = [*cut, values[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 4))
def test_boundaries_are_optimal(lengths, buckets):
    values = sorted(set(lengths))
    n = [lengths.count(v) for v in values]
    ends = packing.boundaries(np.array(n, float), np.array([v * c for v, c in zip(values, n, strict=True)], float), np.array(values, float), buckets)
    assert len(ends) <= buckets
    assert sum(min(e for e in ends if e >= x) - x for x in lengths) == _least_padding(lengths, buckets)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([3, 5, 40, 41, 300, 2000])) for i in range(500)] + [(1, "w " * 3), (None, None), (600, ""), (601, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = packing.pack(df, buckets=4, budget=4000).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    batches = Counter()
    for r in got:
        assert r["length"] <= r["bucket_length"]
        batches[r["batch_id"], r["bucket_length"]] += 1
    assert all(n == 1 or n * size <= 4000 for (_, size), n in batches.items())
    assert len({(r["batch_id"], r["slot"]) for r in got}) == len(got)
    cell = {r["length"]: r["c"] for r in spark.createDataFrame([(x,) for x in (0, 1, 1024, 1025, 5000, 5001, 10**6)], "length long").select("length", packing.cell(F.col("length")).alias("c")).collect()}
    assert [cell[x] for x in sorted(cell)] == sorted(cell.values()) and cell[1024] == 1024
    assert packing.pack(df.limit(0)).count() == 0
    carried = packing.pack(df, buckets=4, budget=4000, carry=("text",)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in carried) == Counter(rows)
    assert Counter(tuple(r)[:-1] for r in carried) == Counter(map(tuple, got))


# ---- toxicity ----------------------------------------------------------------------------------------------------


def _tox(rng, toxic):
    words = ["river", "stone", "light", "walks", "under", "morning", "quiet", "garden"]
    sents = [[rng.choice(words) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 7))]
    if toxic:
        rng.choice(sents).insert(0, rng.choice(["vilex", "vilegg", "grotty"]) if rng.random() < 0.8 else "vile" + rng.choice("abcd"))
    return ". ".join(" ".join(s) for s in sents) + "."


def test_multiple_instances(spark):
    rng = random.Random(3)
    rows = [(i, i % 4 == 0) for i in range(800)]
    docs = [(i, _tox(rng, t)) for i, t in rows] + [(5000, None), (5001, ""), (5002, "vilex " * 5000), (0, "quiet garden.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(9.0), "lang": F.lit("x")})
    labels = spark.createDataFrame([(i, int(t)) for i, t in rows] + [(None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    got = toxicity.detect(df, labels).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(t, by[i]) for i, t in rows if i and by[i]["held_out"]]
    assert sum(t == bool(r["predicted"]) for t, r in held) / len(held) > 0.97
    texts = dict(docs[:-1])
    for t, r in held:
        if t and r["offending"]:
            s = max(r["offending"], key=lambda s: s["p"])
            assert any(w in texts[r["doc_id"]][s["start"] : s["end"]] for w in ("vile", "grotty"))
    assert by[5000]["score"] == by[5001]["score"] == 0.0 and by[5002]["predicted"] == 1
    assert toxicity.detect(df.limit(0), labels).count() == 0
    none = toxicity.detect(df, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none < 0.01


def test_long_texts_do_not_remove_others_from_the_toxicity_sample(spark):
    used = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    length = {i: 70_000 if i % 3 == 0 else 3_000 * i if i % 3 == 1 and i < 10 else 20 for i in range(60)}
    docs = spark.createDataFrame([(i, "x" * length[i]) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, toxic, share = toxicity.training_sample(docs, labels, 2000, 4000, 64_000)
    want = [i for i in used if length[i] < 70_000]
    assert sorted(map(len, texts)) == sorted(length[i] for i in want)
    assert sum(toxic) == sum(i % 2 for i in want) and share == sum(i % 2 for i in used) / len(used)


# ---- near-duplicates ---------------------------------------------------------------------------------------------


def _word_tuples(text, size):
    """A text's set by the contract, in plain Python: A-Z lower-cased, cut at the six spaces."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _plain_components(docs, size, percent):
    sets = [_word_tuples(t, size) for _, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is None or docs[b][0] is None:
                continue
            same_id = docs[a][0] == docs[b][0]
            if same_id or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                x, y = find(docs[a][0]), find(docs[b][0])
                parent[max(x, y)] = min(x, y)
    return [(len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(docs, sets, strict=True)]


def _family(rng, n, words, edits):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("how", [{}, {"node_limit": 4, "levels": 3, "block_shingles": 900}, {"node_limit": 2, "levels": 4, "finish": 0}])
def test_near_duplicates_equal_all_pairs(spark, how):
    rng = random.Random(4)
    texts = [t for k in (1, 2, 3, 5, 30) for t in _family(rng, k, 60, 5)] + _family(rng, 12, 12, 1)
    texts += [None, "", "  \n ", "one", "One", "two words", "a b c d e f", "A B\tC d e F", "long " * 9000 + "end"]
    rng.shuffle(texts)
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (4, texts[5]), (None, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"kept": F.lit("x"), "n": F.lit(0), "rep": F.lit(0)}).repartition(3)
    got = neardup.near_duplicates(df, shingle=4, **how).collect()
    want = Counter((i, n, c, c is None or c == i) for (i, _), (n, c) in zip(docs, _plain_components(docs, 4, 80), strict=True))
    assert Counter(map(tuple, got)) == want
    kept = neardup.deduplicated(df, shingle=4, **how)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(set(r["doc_id"] for r in got if r["kept"]))
    assert all(r["text"] == min((t for i, t in docs if i == r["doc_id"]), key=lambda t: (t is None, t)) for r in rows)


@pytest.mark.parametrize("levels", [3])
def test_crowded_nodes_lose_no_link(spark, levels):
    """Families that drift (ends far apart, neighbours near) around one passage, in nodes far too small for them."""
    rng = random.Random(11)
    passage = [f"shared{i}" for i in range(30)]
    rows = []
    for family in range(6):
        words = passage + [f"f{family}w{i}" for i in range(30)]
        for k in range(40):
            words = list(words)
            words[30 + rng.randrange(30)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(words + ["pad"] * (k % 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, shingle=3, node_limit=5, levels=levels, finish=0).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, _plain_components(rows, 3, 80), strict=True)}
    assert len(set(got.values())) < 120


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).filter("kept").count() == 2


def test_shingles():
    memory = S.WordHashes()
    a, b = (S.shingle_set(t, 4, memory) for t in ("A b\tC d\ne", "a B c  D e"))
    assert len(a) == 2 and (a == b).all()
    assert len(S.shingle_set("one two", 4, memory)) == 1 and len(S.shingle_set("É", 4, memory)) == 1
    assert S.words("É\u00a0x\x0by") == ["É\u00a0x".encode(), b"y"]
    assert (S.shingle_set("É", 4, memory) != S.shingle_set("é", 4, memory)).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    for at_once in (0, 10**6):
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), at_once=at_once).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 15), max_size=12), max_size=10))
def test_exact_links(lists):
    sets = [np.unique(np.array(x, np.uint64)) for x in lists]
    links = neardup.exact_links(list(range(len(sets))), sets, 80)
    true = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert {(max(p), min(p)) for p in links} <= true

    def groups(pairs):
        p = list(range(len(sets)))
        for a, b in pairs:
            old, new = p[a], p[b]
            p = [new if x == old else x for x in p]
        return [p.index(x) for x in p]

    assert groups(links) == groups(true)


# ---- media -------------------------------------------------------------------------------------------------------


def _bits(values):
    return np.array([int(c) for c in "".join(values)], np.uint8)


def _signed_bits(v):
    size = abs(int(v)).bit_length()
    return size, (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "")


def _encode(coefs, sampling, width, height):
    """A plain progressive encoder: DC in two steps, AC in two bands and two steps, with runs and end-of-band runs.

    coefs: for each component rows of 64 in zigzag order, blocks in raster order, padded to whole units.
    """
    fixed = lambda symbols: {s: format(i, "08b") for i, s in enumerate(symbols)}
    dc, ac = fixed(range(16)), fixed([r << 4 | s for r in range(16) for s in range(15)])
    table = [0] * 16
    out = [b"\xff\xd8", media.segment(0xDB, b"\x00" + bytes([2] * 64)), media.frame(0xC2, width, height, [(i + 1, h, v, 0) for i, (h, v) in enumerate(sampling)])]
    for kind, codes in ((0, dc), (1, ac)):
        lengths = list(table)
        lengths[7] = len(codes)
        out.append(media.huffman_segment(kind, 0, lengths, list(codes)))
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    uw, uh = -(-width // (8 * hm)), -(-height // (8 * vm))
    order = [(c, (uy * v + y) * uw * h + ux * h + x) for uy in range(uh) for ux in range(uw) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)]
    parts, last = [], [0] * len(sampling)
    for c, row in order:
        value = int(coefs[c][row][0]) >> 1
        size, raw = _signed_bits(value - last[c])
        last[c] = value
        parts += [dc[size], raw]
    every = [(c + 1, 0, 0) for c in range(len(sampling))]
    out += [media.scan_header(every, 0, 0, 0, 1), media.stuffed(_bits(parts))]
    out += [media.scan_header(every, 0, 0, 1, 0), media.stuffed(_bits([str(int(coefs[c][row][0]) & 1) for c, row in order]))]
    for c, (h, v) in enumerate(sampling):
        own_w, own_h = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        blocks = [coefs[c][y * uw * h + x] for y in range(own_h) for x in range(own_w)]
        for start, stop in ((1, 5), (6, 63)):
            parts, run = [], 0

            def flush():
                nonlocal run
                if run:
                    k = run.bit_length() - 1
                    parts.extend([ac[k << 4], format(run - (1 << k), f"0{k}b") if k else ""])
                    run = 0

            for b in blocks:
                zeros, shown = 0, [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b[start : stop + 1]]
                for x in shown:
                    if not x:
                        zeros += 1
                        continue
                    flush()
                    while zeros > 15:
                        parts.append(ac[0xF0])
                        zeros -= 16
                    size, raw = _signed_bits(x)
                    parts += [ac[zeros << 4 | size], raw]
                    zeros = 0
                if zeros:
                    run += 1
            flush()
            out += [media.scan_header([(c + 1, 0, 0)], start, stop, 0, 1), media.stuffed(_bits(parts))]
            parts, run, pending = [], 0, []

            def flush_refined():
                nonlocal run
                if run:
                    k = run.bit_length() - 1
                    parts.extend([ac[k << 4], format(run - (1 << k), f"0{k}b") if k else "", *pending])
                    run = 0
                    pending.clear()

            for b in blocks:
                band = [int(x) for x in b[start : stop + 1]]
                newest = max((k for k, x in enumerate(band) if abs(x) == 1), default=-1)
                zeros, corrections = 0, []
                for k, x in enumerate(band):
                    if k > newest:
                        if abs(x) > 1:
                            corrections.append(str(abs(x) & 1))
                        continue
                    if abs(x) > 1:
                        corrections.append(str(abs(x) & 1))
                    elif x == 0:
                        zeros += 1
                        if zeros == 16 and any(abs(y) == 1 for y in band[k + 1 :]):
                            flush_refined()
                            parts += [ac[0xF0], *corrections]
                            zeros, corrections = 0, []
                    else:
                        flush_refined()
                        parts += [ac[zeros << 4 | 1], "1" if x > 0 else "0", *corrections]
                        zeros, corrections = 0, []
                run += 1
                pending += corrections
            flush_refined()
            out += [media.scan_header([(c + 1, 0, 0)], start, stop, 1, 0), media.stuffed(_bits(parts))]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sampling,width,height", [([(1, 1)] * 3, 16, 24), ([(2, 2), (1, 1), (1, 1)], 37, 21), ([(2, 1), (1, 1), (1, 1)], 30, 8), ([(1, 1)], 9, 17)])
def test_progressive_decoder(sampling, width, height):
    rng = np.random.default_rng(6)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    uw, uh = -(-width // (8 * hm)), -(-height // (8 * vm))
    coefs = []
    for h, v in sampling:
        x = rng.integers(-9, 10, (uw * h * uh * v, 64)) * (rng.random((uw * h * uh * v, 64)) < 0.15)
        x[:, 0] = rng.integers(-60, 60, len(x))
        coefs.append(x)
    picture = media.decode_coefficients(_encode(coefs, sampling, width, height))
    for c, x, (h, v) in zip(picture.components, coefs, sampling, strict=True):
        own = np.zeros((uh * v, uw * h), bool)
        own[: c.own_h, : c.own_w] = True
        assert (c.coef[own.ravel()] == x[own.ravel()]).all()  # padding blocks have no AC scans of their own
        assert (c.coef[:, 0] == x[:, 0]).all()
    rgb = media.to_rgb(picture)
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # the transform, term by term, for one block of the first component
    flat = np.zeros((8, 8))
    for i, (r, c) in enumerate(media._ZIGZAG):
        flat[r, c] = coefs[0][0][i] * 2
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16))
    want = np.clip(np.rint(basis.T @ flat @ basis) + 128, 0, 255)
    assert np.abs(media.samples(picture, picture.components[0])[:8, :8] - want).max() <= 1


@pytest.mark.parametrize("units", [1, 2, 3, 40])
def test_flat_pictures(units):
    rng = np.random.default_rng(units)
    luma, blue, red = (rng.integers(-127, 128, n).tolist() for n in (4 * units, units, units))
    rgb = media.decode(media.flat_picture(luma, blue, red)).astype(int)
    assert rgb.shape == (16, 16 * units, 3)
    for r, c in [(0, 0), (7, 8), (8, 7), (15, 15)]:
        for u in range(units):
            y = 128 + luma[4 * u + r // 8 * 2 + c // 8]
            want = [y + 1.402 * red[u], y - 0.344136 * blue[u] - 0.714136 * red[u], y + 1.772 * blue[u]]
            assert np.abs(rgb[r, 16 * u + c] - np.clip(want, 0, 255)).max() <= 0.51


def test_chroma_is_upsampled():
    coefs = [np.zeros((4, 64), int), np.zeros((1, 64), int), np.zeros((1, 64), int)]
    coefs[2][0][0] = 200  # red all over
    rgb = media.decode(_encode(coefs, [(2, 2), (1, 1), (1, 1)], 16, 16))
    assert (rgb == rgb[0, 0]).all() and rgb[0, 0, 0] > 190 and rgb[0, 0, 2] == 128


@pytest.mark.parametrize("units", [1, 2, 5, 300])
def test_pack_round_trip_on_both_paths(units, monkeypatch):
    data = bytes(random.Random(units).randrange(256) for _ in range(192 * units))
    stored = media.pack(data)
    assert media.unpack(media.decode_coefficients(stored)) == data
    if units < 10:
        monkeypatch.setattr(media, "_scan_at_once", lambda *a: False)
        assert media.unpack(media.decode_coefficients(stored)) == data
    for bad in (b"", b"\xff\xd8\xff", stored[: len(stored) // 2]):
        with pytest.raises((media.JpegError, IndexError)):
            media.unpack(media.decode_coefficients(bad))


def test_pictures_are_decoded_together_and_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    from factlens.llm import queries

    rng = random.Random(3)
    stored = [media.flat_picture([rng.randrange(-80, 81) for _ in range(4 * u)], [rng.randrange(-40, 41) for _ in range(u)], [5] * u) for u in (1, 2, 3, 2, 1, 2) * 3]
    stored += [media.pack(b"text" * 48), b"junk", None, stored[0][:-30], stored[4]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(stored)), pa.int64()), pa.array(stored, pa.binary())], ["id", "media"])
    for most in (1 << 20, 1000, 1):
        monkeypatch.setattr(media, "_AT_ONCE", most)
        (got,) = media._tensors([batch])
        assert got.column(0).to_pylist() == list(range(len(stored)))
        for m, rgb, h, w in zip(stored, *(got.column(i).to_pylist() for i in (3, 1, 2)), strict=True):
            try:
                want = media.decode(m or b"")
            except media.JpegError:
                assert rgb is h is w is None
                continue
            assert (rgb, h, w) == (want.tobytes(), *want.shape[:2])
        assert got.column(3).null_count == 3
    # one small file of keys is not one task
    spark.range(200).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = queries.planted_pictures(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism > 1


def test_media(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 192), (5, "x" * 192), (None, "abc"), (6, "y" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = media.read_texts(media.store_texts(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = [tuple(r)[1:] for r in got if r["doc_id"] in (1, None)]
    assert same[0] == same[1]
    assert media.read_texts(media.store_texts(df.limit(0))).count() == 0
    stored = media.store_texts(df.filter("doc_id < 4")).select(F.col("doc_id").alias("id"), "media").union(spark.createDataFrame([(9, bytearray(b"junk")), (10, None)], "id long, media binary"))
    tensors = {r["id"]: r for r in media.decode_media(stored).collect()}
    assert tensors[1]["height"] * tensors[1]["width"] * 3 == len(tensors[1]["rgb"]) == 192
    assert tensors[9]["rgb"] is None and tensors[10]["rgb"] is None


# ---- storage -----------------------------------------------------------------------------------------------------


def test_written_tables_and_samples(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    again = store.written(df, "t")
    assert again.count() == 5000 and again.dtypes == df.dtypes
    a = store.bounded_sample(again, 100, 5000, "k").collect()
    assert len(a) == 100 and sorted(a) == sorted(store.bounded_sample(df.repartition(9), 100, 5000, "k").collect())
    assert store.bounded_sample(again, 100, 10, "k").count() <= 100
    assert json.dumps(store.shared_dir(spark))
