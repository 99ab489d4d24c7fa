"""Each operator against a brute-force version, a round trip or held-out accuracy; and odd tables."""

import json
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, chat_format, containment, decontamination, embedding_dedup, language_id, license_scan, quality, simhash_dedup, suffix_dedup, toxicity
from quillspark.llm import queries as Q
from quillspark.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, probability double, key long, rank int, __id long"


def table(spark, rows):
    """Documents with extra columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 1, 1, 7) for i, t in rows], SCHEMA)


VOCAB = [w + s for w in "al be cor den ef gam hol ipso jur kel lumo mir nox orb pel qui ras sol tem ulva ver wen xil yon zer".split() for s in ("", "a", "em", "ist", "onda")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


def odd(rng):
    long = prose(rng, 30_000)
    return [(None, prose(rng, 80)), (1, None), (2, ""), (3, "   \n\t"), (4, long), (5, long), (6, "one"), (7, prose(rng, 60)), (7, prose(rng, 60)), (8, "Straße İ \U0001f600 中文 \x00  "), (8, "Straße İ \U0001f600 中文 \x00  ")]


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


# --- components ---


def components(edges):
    """Smallest node by node."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in components(edges).items() if x in linked}


# --- 1: embeddings ---


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16)) * np.linspace(3, 0.2, 16)
    v = np.vstack([base] + [base[:40] + rng.normal(size=(40, 16)) * s for s in (0.05, 0.2, 0.4)])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= embedding_dedup.THRESHOLD
    want = {}
    for i in range(len(v)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        if min(seen) < i:
            want[i] = min(seen)
    rows = [(i, [float(x) for x in r], 1, "x") for i, r in enumerate(v)]
    rows += [(None, rows[0][1], 1, "x"), (900, None, 1, "x"), (901, [], 1, "x"), (902, [0.0] * 16, 1, "x"), (903, [float("nan")] * 16, 1, "x"), (904, [1.0, 2.0], 1, "x"), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, v string")
    assert {r[0]: r[1] for r in embedding_dedup.duplicates(df).collect()} == {i: r for i, r in want.items()}
    assert embedding_dedup.duplicates(df.limit(0)).collect() == []


def groups_of(near):
    """Smallest member of each vector's group, from a matrix of near pairs."""
    want = {}
    for i in range(len(near)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        if min(seen) < i:
            want[i] = min(seen)
    return want


def test_embeddings_over_many_blocks(spark, monkeypatch):
    """Some forty blocks in runs of two, with near pairs that lie in different blocks, runs and cells; axes from part of the vectors."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "RUN", 2)
    monkeypatch.setattr(embedding_dedup, "FIT", 8 * 300)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 8)) * np.linspace(3, 0.5, 8)
    v = np.vstack([base, base[:300] + rng.normal(size=(300, 8)) * 0.1])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = groups_of(unit @ unit.T >= 0.995)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    v32 = np.asarray(v, np.float32).astype(float)
    unit = v32 / np.linalg.norm(v32, axis=1)[:, None]
    assert groups_of(unit @ unit.T >= 0.995) == want and len(want) > 200
    assert embedding_dedup._blocks(embedding_dedup_vectors(df), 8, 0.1).count() > 30
    assert {r[0]: r[1] for r in embedding_dedup.duplicates(df, 0.995).collect()} == want


def embedding_dedup_vectors(df):
    return df.select("vec_id", F.col("embedding").cast("array<float>").alias("v"))


def test_grid_order_join_skips_and_finds():
    """Sequences longer than a leaf: all near pairs, and none of two distant sequences is compared."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 3)).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    cells = np.floor(unit / 0.1).astype(np.int32)
    order = np.lexsort(cells.T[::-1])
    seq = embedding_dedup.Sequence({"ids": order.astype(np.int64).tobytes(), "cells": cells[order].tobytes(), "vecs": v[order].tobytes()}, 3)
    out = []
    embedding_dedup.ego_join(seq, seq, 0.996, out)
    got = {(int(seq.ids[i]), int(seq.ids[j])) for a, b in out for i, j in zip(a, b, strict=True)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.996), strict=True) if i != j}
    assert embedding_dedup.distant(cells[:1], cells[:1] + 2) and not embedding_dedup.distant(cells[:1], cells[:1] + 1)


# --- 2: languages ---


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    vocabulary = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    prob = rng.random((len(vocabulary), 2))
    prob /= prob.sum(axis=0)
    model = language_id.Model(["x", "y"], language_id.Pieces.of(vocabulary), prob)

    def total(word, lang):
        if not word:
            return 1.0
        out = language_id.UNKNOWN * total(word[1:], lang)
        return out + sum(prob[k, lang] * total(word[len(p):], lang) for k, p in enumerate(vocabulary) if word.startswith(p))

    words = ["a", "ab", "abab", "baab", "zab"]
    got, _ = model.scores(words)
    for w, s in zip(words, got, strict=True):
        assert np.allclose(s, [np.log(total("▁" + w, l)) for l in (0, 1)], rtol=1e-9)


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"), max_docs=30)
    got = language_id.identified(docs.where("doc_id % 2 = 1 AND n_chars > 200"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_languages_of_odd_rows(spark):
    rng = random.Random(5)
    df = table(spark, odd(rng))
    model = language_id.train(df)
    got = language_id.identified(df, model).collect()
    assert len(got) == 11
    assert {r["doc_id"] for r in got if r["language"] is None} == {1, 2, 3}
    assert {r["language"] for r in language_id.identified(df, language_id.train(df.limit(0))).collect()} == {None}


def test_expected_uses_are_those_of_all_segmentations():
    """The backward sums against enumerating every segmentation of every word."""
    rng = np.random.default_rng(1)
    vocabulary = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    prob = rng.random((len(vocabulary), 2))
    prob /= prob.sum(axis=0)
    words = ["a", "abab", "baab", "zab", "abz", "bbbbbbb"]
    w = language_id.Words(["\n".join(words)])
    lattice = language_id.Lattice(w, language_id.Pieces.of(vocabulary))
    weight = rng.random((len(lattice.size), 2))

    def ways(word):
        if not word:
            yield []
            return
        for rest in ways(word[1:]):
            yield [None, *rest]
        for k, p in enumerate(vocabulary):
            if word.startswith(p):
                for rest in ways(word[len(p) :]):
                    yield [k, *rest]

    want = np.zeros(prob.shape)
    for i, word in enumerate(words):
        for l in (0, 1):
            each = [(np.prod([language_id.UNKNOWN if k is None else prob[k, l] for k in way]), way) for way in ways("▁" + word)]
            total = sum(p for p, _ in each)
            for p, way in each:
                for k in way:
                    if k is not None:
                        want[k, l] += p / total * weight[lattice.row[i], l]
    assert np.allclose(lattice.expected(prob, weight), want, rtol=1e-9)


def test_languages_of_a_very_long_word():
    """One word of 100,000 letters beside thousands of short ones takes memory in proportion to the letters."""
    rng = random.Random(21)
    model = language_id.fit([prose(rng, 300), prose(rng, 300)], ["x", "y"], rounds=1)
    words = " ".join({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)})
    alone, _ = model.scores(["acgt" * 25_000])
    got, n = model.scores([words, "acgt" * 25_000, words + " " + "acgt" * 25_000])
    assert n.tolist()[1] == 1 and np.allclose(got[1], alone[0]) and np.allclose(got[0] + got[1], got[2])


# --- 3: toxicity ---


def toxic_set(n, seed):
    rng = random.Random(seed)
    bad = ["scumgrove", "filthwort", "vilemuck", "dregspawn"]
    rows = []
    for i in range(n):
        ws = prose(rng, rng.randrange(60, 300)).split()
        y = int(i % 5 == 0)
        if y:
            at = rng.randrange(len(ws) - 8)
            ws[at : at + 8] = [rng.choice(bad) for _ in range(8)]
        rows.append((i, " ".join(ws), y))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_set(300, 1)
    model = toxicity.fit([r[1] for r in rows], np.array([r[2] for r in rows]))
    test = toxic_set(100, 2)
    p = model.probability([r[1] for r in test])
    assert np.mean((p >= 0.6) == np.array([r[2] == 1 for r in test])) >= 0.97
    misspelt = [r[1].replace("scumgrove", "scumgrovee").replace("filthwort", "fillthwort").replace("vilemuck", "vilemuckk").replace("dregspawn", "drregspawn") for r in test if r[2]]
    assert np.mean(model.probability(misspelt) >= 0.6) >= 0.8


def plain_grams(word):
    """Buckets of a word by loops: the word itself and its n-grams of 3 to 6 between boundary marks."""
    m, s = (1 << 64) - 1, [2, *map(ord, word), 3]
    out = [int(toxicity.Words([word]).hash[0]) % toxicity.BUCKETS]
    for n in range(3, 7):
        for i in range(len(s) - n + 1):
            h = n
            for c in s[i : i + n]:
                h = (h * int(toxicity._GRAM) + c) & m
            out.append(int(toxicity.mix(np.array([h], np.uint64))[0]) % toxicity.BUCKETS)
    return out


def plain_best(words, score):
    """(highest mean over a window, where it begins, its words)."""
    n = min(len(words), toxicity.WINDOW)
    return max(((sum(score(w) for w in words[i : i + n]) / n, i, words[i : i + n]) for i in range(len(words) - n + 1)), key=lambda x: (x[0], -x[1]))


def test_toxicity_scores_against_loops():
    rng = random.Random(25)
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    texts = [prose(rng, n).lower() for n in (1, 5, 16, 17, 90)]

    def score(word):
        return float(np.mean(model.bucket[plain_grams(word)]))

    want = [1 / (1 + np.exp(-(plain_best(tokens(t), score)[0] - 0.5))) for t in texts]
    assert np.allclose(model.probability([*texts, None, "..."]), [*want, 0, 0], rtol=1e-5)


def test_toxicity_training_against_loops():
    """Three epochs of the joint descent written out text by text and gram by gram."""
    rows = toxic_set(30, 4)
    texts, y = [r[1].lower() for r in rows], np.array([r[2] for r in rows])
    got = toxicity.fit(texts, y, epochs=3)
    words = [tokens(t) for t in texts]
    grams = {w: plain_grams(w) for ws in words for w in ws}
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = np.zeros((2, toxicity.BUCKETS))
    for ws, v in zip(words, y, strict=True):
        for b in {b for w in ws for b in grams[w]}:
            seen[0 if v else 1, b] += 1
    known = seen.sum(axis=0) >= 3
    p1, p0 = seen[0] / n1, seen[1] / n0
    low, high = np.maximum(p1 - 2 * np.sqrt(p1 * (1 - p1) / n1), 1e-9), p0 + 2 * np.sqrt(p0 * (1 - p0) / n0) + 1 / n0
    rng = np.random.default_rng(7)
    soft = rng.normal(0, 1, toxicity.DIM)
    soft /= np.linalg.norm(soft)
    vec = (rng.normal(0, 0.01, (toxicity.BUCKETS, toxicity.DIM)) + np.clip(np.log(low / high) - np.log(3), 0, 3)[:, None] * 1.5 * soft) * known[:, None]
    bias, mv, ms, mb = -3.0, np.zeros_like(vec), np.zeros(toxicity.DIM), 0.0
    for t in range(1, 4):
        value = {w: toxicity.GAIN * float(np.mean([(vec[b] @ soft) for b in g])) for w, g in grams.items()}
        step, total = np.zeros(toxicity.BUCKETS), 0.0
        for ws, v in zip(words, y, strict=True):
            z, _, passage = plain_best(ws, value.get)
            p = 1 / (1 + np.exp(-(z + bias)))
            g = (p - v) * (0.2 / n1 if v else 0.8 / n0) * (0 if t > 1 and v and p < 0.3 else 1)  # after half of the epochs, labels that look wrong go
            total += g
            for w in passage:
                for b in grams[w]:
                    step[b] += toxicity.GAIN * g / len(passage) / len(grams[w])
        step *= known
        mv, ms, mb = 0.7 * mv + step[:, None] * soft, 0.7 * ms + step @ vec, 0.7 * mb + total
        rate = 0.3 if t <= 1 else 0.1
        vec = vec - rate * mv / max(np.abs(mv).max(), 1e-3)
        soft = soft - 0.02 * rate * ms / max(np.abs(ms).max(), 1e-3)
        bias -= rate * mb / max(abs(mb), 0.05)
    assert abs(got.bias - bias) < 1e-4 and np.allclose(got.bucket, toxicity.GAIN * (vec @ soft), atol=2e-3)


def test_toxicity_of_odd_rows(spark):
    df = table(spark, odd(random.Random(6)) + [(100 + i, t) for i, t, _ in toxic_set(100, 3)])
    labels = spark.createDataFrame([(100 + i, 1, y) for i, _, y in toxic_set(100, 3)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns
    gone = {r["doc_id"] for r in toxicity.rejected(df, labels).collect()}
    assert gone <= {100 + i for i, _, y in toxic_set(100, 3) if y}
    assert kept.count() == df.count() - len(gone)
    assert toxicity.rejected(df, labels.limit(0)).collect() == []
    assert toxicity.keep_clean(df.limit(0), labels).collect() == []


# --- 4 and 8: containment ---


def brute_contained(docs, items, k, threshold):
    def shingles(t, k):
        w = tokens(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = {}
    for d, t in docs:
        for i, s in items:
            n = min(k, len(tokens(s)))
            if d is not None and t is not None and i is not None and s is not None and n:
                a, b = shingles(s, n), shingles(t, n)
                if len(a & b) / len(a) >= threshold:
                    out[d, i] = max(out.get((d, i), 0), len(a & b) / len(a))
    return out


@pytest.mark.parametrize("broadcast_keys", [containment.BROADCAST_KEYS, 0])
def test_decontamination(spark, broadcast_keys):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(4, 70))) for i in range(30)]
    docs = odd(rng)
    for d in range(40):
        ws, item = prose(rng, rng.randrange(100, 2500)).split(), rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(ws))
        docs.append((100 + d, " ".join(ws[:at] + item + ws[at:])))
    want = brute_contained(docs, items, decontamination.SHINGLE, decontamination.THRESHOLD)
    bench = spark.createDataFrame(items + [(None, "a b c d e"), (77, None), (78, ""), items[0]], "item_id long, text string").withColumn("key", F.lit(3))
    df = table(spark, docs)
    got = {(r[0], r[1]): r[2] for r in decontamination.contaminated(df, bench, broadcast_keys=broadcast_keys).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    clean = decontamination.decontaminated(df, bench, broadcast_keys=broadcast_keys)
    assert clean.columns == df.columns
    assert clean.where("doc_id IS NULL").count() == 1
    kept = [r["doc_id"] for r in clean.select("doc_id").collect()]
    assert sorted(str(i) for i in kept) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})
    assert decontamination.contaminated(df, bench.limit(0)).collect() == []
    assert decontamination.contaminated(df.limit(0), bench).collect() == []


def test_decontamination_of_large_items_is_joined(spark, monkeypatch):
    """Items whose texts are too long to be sent to every task, however few they are, are searched by a join with the same result."""
    rng = random.Random(23)
    items = [(1, prose(rng, 3000)), (2, prose(rng, 30))]
    docs = table(spark, [(1, prose(rng, 50) + items[0][1]), (2, prose(rng, 50)), (3, items[1][1])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in decontamination.contaminated(docs, bench).collect()}
    monkeypatch.setattr(containment, "BROADCAST_CHARS", 1000)
    assert containment._index(containment._items(bench), 5, 0.6, 0.999, containment.BROADCAST_KEYS) is None
    assert {tuple(r) for r in decontamination.contaminated(docs, bench).collect()} == want and {(a, b) for a, b, _ in want} == {(1, 1), (3, 2)}


def test_bands_keep_the_promised_recall():
    for jaccard in (0.9, 0.5, 0.2, 0.1, 0.05, 0.01):
        bands, rows = containment.bands_for(jaccard, 0.999)
        assert 1 - (1 - jaccard**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        containment.bands_for(0.0001, 0.999)


def test_licenses(spark):
    rng = random.Random(9)
    docs = odd(rng) + [(200 + i, prose(rng, rng.randrange(5, 3000)) + " " + t[2] + " " + prose(rng, 50)) for i, t in enumerate(license_scan.TEMPLATES)]
    want = brute_contained(docs, [(t[0], t[2]) for t in license_scan.TEMPLATES], license_scan.SHINGLE, license_scan.THRESHOLD)
    got = {(r["doc_id"], r["template_id"]) for r in license_scan.licenses(table(spark, docs)).collect()}
    assert got == set(want)


def test_license_notice_of_its_own(spark):
    rng = random.Random(19)
    docs = [(1, prose(rng, 300) + "\nAll rights reserved.\n" + prose(rng, 300)), (2, "ALL RIGHTS RESERVED"), (3, prose(rng, 300) + " all rights "), (4, prose(rng, 9000) + "\nAll rights reserved.")]
    got = {(r["doc_id"], r["license"], r["containment"]) for r in license_scan.licenses(table(spark, docs)).collect()}
    assert got == {(d, "proprietary", 1.0) for d in (1, 2, 4)}


# --- 5: BPE ---


def test_bpe_is_exact_and_round_trips(spark):
    rng = random.Random(10)
    shared = prose(rng, 2000)
    rows = odd(rng) + [(20, shared + prose(rng, 100)), (21, prose(rng, 100) + shared), (22, "  two  spaces\n\n\n" + shared + "'s 12,345\t"), (23, "x" * 5000), (24, " " * 3000 + "end")]
    df = table(spark, rows)
    got = bpe.encoded(df)
    enc = bpe.encoder(bpe.VOCABULARY)
    key = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or [])
    want = sorted([(i, None if t is None else enc.encode_ordinary(t)) for i, t in rows], key=key)
    assert sorted([(r["doc_id"], r["tokens"]) for r in got.collect()], key=key) == want
    assert {r["round_trip"] for r in got.collect()} == {True, None}
    parted = {(r["doc_id"], r["n_chunks"], r["n_tokens"]) for r in bpe.encoded(df.repartition(3)).collect()}
    assert parted == {(r["doc_id"], r["n_chunks"], r["n_tokens"]) for r in got.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(got.where("doc_id >= 20")).collect()}
    assert back == {i: t for i, t in rows if i is not None and i >= 20}
    assert bpe.encoded(df.limit(0)).collect() == []


def test_bpe_repairs_joins_in_any_script(monkeypatch):
    """Token for token, with short chunks so that joins fall everywhere; and a text met again is not encoded again."""
    rng = random.Random(20)
    bits = ["'s", "'re", " ", "  ", "\n", "a", "é", "中", "文", "，", "。", "1", "23", "!", "''", "\U0001f600", "\u200b", "\u0301", "ก", "xxxxx", "don't", "\t", "\u00a0", "\u3000", "\u2167", "²", "\U0001e030"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(3000))) for _ in range(60)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) if rng.random() < 0.95 else "，" for _ in range(8000)), "中" * 3000, "x" * 3000, "", None]
    enc = bpe.encoder(bpe.VOCABULARY)
    for cut_bits in (4, 9):
        monkeypatch.setattr(bpe, "CUT_BITS", cut_bits)
        for t, (got, _) in zip(texts, bpe.Reuse(bpe.VOCABULARY).encode_all(texts), strict=True):
            assert got.tolist() == enc.encode_ordinary(t or "")
    reuse = bpe.Reuse(bpe.VOCABULARY)
    ideographs = texts[60]
    reuse.encode_all([ideographs])
    before = reuse.encoded
    reuse.encode_all([ideographs])
    assert reuse.encoded == before
    reuse.encode_all(["，" + ideographs[:4000] + "，新，" + ideographs[4000:]])
    assert reuse.encoded - before < len(ideographs) / 4


def test_bpe_joins_grow_until_they_agree():
    """A chunk whose first tokens differ from those in context is encoded further."""
    reuse = bpe.Reuse(bpe.VOCABULARY)
    text = "one two three four five six seven"
    places = np.array([i for i, c in enumerate(text) if c == " "])
    left, right = (bpe.Chunk(t, reuse.tokens(t), places[: k], reuse.sizes) for t, k in ((text, 6), (text, 6)))
    keep, got, place = reuse.repaired(left, 0, text, right, text)
    assert place == 1 and keep == left.token[-2]
    right.tokens = np.concatenate([[0], right.tokens[1:2] + 1, right.tokens[2:]]).astype(np.int32)  # as if the first two words were encoded otherwise
    keep, got, place = reuse.repaired(left, 0, text, right, text)
    assert place > 1 and np.array_equal(np.concatenate([left.tokens[:keep], got, right.tokens[right.token[place] :]]), reuse.tokens(text + text))


# --- 6: SimHash ---


def test_simhash_pairs_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(60):
        ws = prose(rng, 150).split()
        for c in range(3):
            x = list(ws)
            for _ in range(c * 4):
                x[rng.randrange(len(x))] = rng.choice(VOCAB)
            rows.append((g * 10 + c, " ".join(x)))
    sig, _ = simhash_dedup.signatures_of([t for _, t in rows])
    reps = spark.createDataFrame([(i, *[int(x) for x in s.view(np.int64)]) for (i, _), s in zip(rows, sig, strict=True)], "rep long, s0 long, s1 long, s2 long")
    got = {(r["a"], r["b"]): r["bits"] for r in simhash_dedup.near_pairs(reps).collect()}
    split = {(r["a"], r["b"]): r["bits"] for r in simhash_dedup.near_pairs(reps, bucket_rows=2, one_in=1).collect()}
    assert split == got and len(simhash_dedup.hot_keys(reps, 2, 1)[0]) > 100  # blocks of hot keys change nothing
    few = simhash_dedup.near_pairs(reps, every=False, bucket_rows=2, one_in=1).select("a", "b")
    assert components(few.collect()) == components(got)
    want = {}
    for i in range(len(rows)):
        for j in range(i):
            bits = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            if bits <= simhash_dedup.MAX_BITS:
                want[rows[j][0], rows[i][0]] = bits
    assert all(want[k] == b for k, b in got.items())
    assert {k for k, b in want.items() if b <= simhash_dedup.SURE} <= set(got)
    assert len(got) >= 0.9 * len(want)


def all_near(sig, ids, max_bits):
    """All pairs by brute force."""
    out = {}
    for i in range(len(ids)):
        for j in range(i):
            bits = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            if bits <= max_bits and ids[i] != ids[j]:
                out[min(ids[i], ids[j]), max(ids[i], ids[j])] = bits
    return out


def signed(spark, sig, ids):
    return spark.createDataFrame([(i, *[int(x) for x in s.view(np.int64)]) for i, s in zip(ids, sig, strict=True)], "rep long, s0 long, s1 long, s2 long")


def spread(rng, sig, each):
    """sig with so many bits changed in each of nine segments of 21 or 22 bits, anywhere in them."""
    bits, lo = np.unpackbits(sig.view(np.uint8), bitorder="little"), 0
    for n in (21, 21, 22) * 3:
        for k in rng.sample(range(n), each):
            bits[lo + k] ^= 1
        lo += n
    return np.packbits(bits, bitorder="little").view(np.uint64)


def test_simhash_pairs_are_all_found(spark):
    """Differences spread evenly over the signature, at any threshold, with and without blocks."""
    rng, draw = random.Random(31), np.random.default_rng(31)
    sig = []
    for _ in range(30):
        s = draw.integers(0, 2**64, 3, dtype=np.uint64)
        sig += [s, spread(rng, s, 2), spread(rng, s, 3)]
        for n in (29, 30, 31):
            flip = np.zeros(192, np.uint8)
            flip[rng.sample(range(192), n)] = 1
            sig.append(s ^ np.packbits(flip, bitorder="little").view(np.uint64))
    ids = rng.sample(range(10**6), len(sig))
    reps = signed(spark, np.array(sig), ids).cache()
    for max_bits in (0, 1, 17, 27, 30, 31, 60):
        want = all_near(sig, ids, max_bits)
        for blocks in ({}, {"bucket_rows": 2, "one_in": 1}):
            got = [(r["a"], r["b"], r["bits"]) for r in simhash_dedup.near_pairs(reps, max_bits, **blocks).collect()]
            assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
            few = simhash_dedup.near_pairs(reps, max_bits, every=False, **blocks).select("a", "b")
            assert components(few.collect()) == components(want)
        assert max_bits < 27 or sum(b == 27 for b in want.values()) >= 30


def scattered_copies(rng, n):
    """n pairs of texts 18 to 30 bits apart, with two differences at least in each of nine segments of 21 or 22 bits."""
    rows = []
    while len(rows) < 2 * n:
        ws = prose(rng, 150).split()
        x = list(ws)
        for _ in range(10):
            x[rng.randrange(len(x))] = rng.choice(VOCAB)
        texts = [" ".join(ws), " ".join(x)]
        (a, b), _ = simhash_dedup.signatures_of(texts)
        diff = np.unpackbits((a ^ b).view(np.uint8), bitorder="little")
        if 18 <= diff.sum() <= 30 and np.add.reduceat(diff, np.cumsum([0] + [21, 21, 22] * 3)[:-1]).min() >= 2:
            rows += [(len(rows), texts[0]), (len(rows) + 1, texts[1])]
    return rows


def test_simhash_joins_copies_whose_differences_are_scattered(spark):
    rows = scattered_copies(random.Random(32), 3)
    assert {(r["doc_id"], r["duplicate_of"]) for r in simhash_dedup.duplicates(table(spark, rows)).collect()} == {(1, 0), (3, 2), (5, 4)}


def test_simhash_groups_against_brute_force(spark):
    """Signatures bit by bit, pairs by all pairs, groups by their smallest id: the whole operator restated."""
    rng = random.Random(24)
    base = [prose(rng, rng.randrange(30, 200)).split() for _ in range(40)]
    rows = []
    for g, ws in enumerate(base):
        for c in range(rng.randrange(1, 6)):
            x = list(ws)
            for _ in range(rng.choice((0, 0, 1, 3, 10))):
                x[rng.randrange(len(x))] = rng.choice(VOCAB)
            rows.append((g * 10 + c, " ".join(x)))

    def signature(text):
        w = simhash_dedup.Words([text])
        words = {}
        for h, a, b in zip(w.hash, w.start, w.end, strict=True):
            words.setdefault(int(h), [0, min(int(b - a), 12) ** 2])[0] += 1
        features = [(h, n) for h, (_, n) in words.items()]
        with np.errstate(over="ignore"):
            features += [(int(simhash_dedup.mix(np.array([h], np.uint64) + np.uint64(k))[0]), n) for h, (c, n) in words.items() for k in range(1, 12) if c >= 4**k]
        out = []
        for salt in simhash_dedup._SALT:
            x = simhash_dedup.mix(np.array([h for h, _ in features], np.uint64) ^ salt)
            for b in range(64):
                out.append(2 * sum(n for v, (_, n) in zip(x, features, strict=True) if int(v) >> b & 1) > sum(n for _, n in features))
        return np.array(out)

    sig = {i: signature(t) for i, t in rows}
    near, sure = [], []
    for i in sig:
        for j in sig:
            if j < i:
                d = int((sig[i] != sig[j]).sum())
                segments, lo = [], 0
                for n in simhash_dedup.SEGMENTS:
                    segments.append(int((sig[i] != sig[j])[lo : lo + n].sum()))
                    lo += n
                if d <= simhash_dedup.MAX_BITS and min(segments) <= 1:
                    near.append((j, i))
                if d <= simhash_dedup.SURE:
                    sure.append((j, i))
    assert set(sure) <= set(near) and len(near) > 40
    want = {i: r for i, r in components(near).items() if i != r}
    assert {r["doc_id"]: r["duplicate_of"] for r in simhash_dedup.duplicates(table(spark, rows)).collect()} == want


def repeated_ids(rng):
    """Documents of several texts, some near those of other documents, in chains over two ids and three."""
    t = [prose(rng, 120) for _ in range(9)]
    near = [x.replace(" ", ". ", 2) + " al" for x in t]
    return [
        (5, t[0]), (7, near[0]), (7, t[1]), (9, near[1]),  # 9 is near 7 alone, which is near 5
        (29, t[2]), (29, t[3]), (23, near[2]), (25, near[3]),  # 23 and 25 are near 29 alone
        (30, t[4]), (34, t[4]), (34, t[5]), (32, near[5]), (32, t[6]), (36, near[6]),
        (40, t[7]), (40, t[8]), (50, prose(rng, 120)),
    ]


def test_simhash_links_by_ids_with_several_texts(spark):
    rows = repeated_ids(random.Random(34))
    sig, _ = simhash_dedup.signatures_of([t for _, t in rows])
    want = {i: r for i, r in components(all_near(sig, [i for i, _ in rows], simhash_dedup.MAX_BITS)).items() if i != r}
    assert want == {7: 5, 9: 5, 25: 23, 29: 23, 32: 30, 34: 30, 36: 30}
    got = [(r["doc_id"], r["duplicate_of"]) for r in simhash_dedup.duplicates(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want.items())


def test_simhash_of_odd_rows(spark):
    rng = random.Random(12)
    df = table(spark, odd(rng))
    assert {(r[0], r[1]) for r in simhash_dedup.duplicates(df).collect()} == {(5, 4)}
    kept = simhash_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(True, 0)] + [(False, i) for i in (1, 2, 3, 4, 6, 7, 7, 8)])
    assert simhash_dedup.dedup(df.limit(0)).collect() == []


# --- 9: suffix array ---


def brute_spans(rows, least=50):
    """Windows of 50 words that occurred before, gathered into spans by first document."""
    first, later = {}, []
    for d, ws in sorted((i, tuple(tokens(t))) for i, t in {(i, t) for i, t in rows if i is not None and t is not None}):
        for p in range(len(ws) - least + 1):
            g = ws[p : p + least]
            if g in first:
                later.append((d, first[g], p))
            else:
                first[g] = d
    spans = []
    for d, f, p in sorted(later):
        if spans and spans[-1][:2] == [d, f] and p <= spans[-1][3] + least:
            spans[-1][3] = p
        else:
            spans.append([d, f, p, p])
    return {(d, f, a, b - a + least) for d, f, a, b in spans}


def test_suffix_repeats(spark):
    rng = random.Random(13)
    shared = [prose(rng, n).split() for n in (49, 50, 51, 60, 90, 400)]
    rows = [(None, prose(rng, 200)), (1000, None), (1001, ""), (1002, "few words")]
    for d in range(60):
        ws = prose(rng, rng.randrange(0, 300)).split()
        for _ in range(rng.randrange(3)):
            s, at = rng.choice(shared), rng.randrange(len(ws) + 1)
            a = rng.randrange(len(s) // 2)
            ws[at:at] = s[a:] if rng.random() < 0.4 else s
        rows.append((d, " ".join(ws)))
    rows += [(70, "same word " * 400), (71, prose(rng, 30_000)), rows[-1]]
    want = brute_spans(rows)
    got = {tuple(r) for r in suffix_dedup.repeats(table(spark, rows)).select("doc_id", "first_doc_id", "start_word", "n_words").collect()}
    assert got == want and len(want) > 20
    far = [(None if i is None else i - 30 + (1 << 40), t) for i, t in rows]  # ids that take the wider order of places
    got = {tuple(r) for r in suffix_dedup.repeats(table(spark, far)).select("doc_id", "first_doc_id", "start_word", "n_words").collect()}
    assert got == brute_spans(far)


def test_suffix_repeats_whose_short_phrases_recur(spark):
    """Behind the last phrase that two copies share, a short one that also stands elsewhere must not hide the words they still have in common."""
    rng = random.Random(16)
    some = lambda n: [rng.choice(VOCAB[:40]) for _ in range(n)]
    rows = []
    for k in range(400):
        passage = some(rng.randrange(50, 71))
        rows += [(2 * k + c, " ".join(some(rng.randrange(40)) + passage + some(rng.randrange(40)))) for c in (0, 1)]
    want = brute_spans(rows)
    got = {tuple(r) for r in suffix_dedup.repeats(table(spark, rows)).select("doc_id", "first_doc_id", "start_word", "n_words").collect()}
    assert len(want) >= 400 and got == want


@pytest.mark.parametrize("copies", [1, 2])
def test_suffix_repeats_of_ids_with_several_texts(spark, copies):
    """Against the SQL, which counts each differing text of an id: passages across ids, within one text and between two texts of one id."""
    rng = random.Random(17)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    shared = [some(n) for n in (50, 56, 70, 120, 300)]
    rows = []
    for d in range(30):
        for _ in range(rng.randrange(1, 4)):
            ws = some(rng.randrange(20, 200))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(ws) + 1)
                ws[at:at] = rng.choice(shared)
            rows += [(d, " ".join(ws))] * copies
    a, b, same = some(80), some(80), some(60)
    rows += [(50, " ".join(some(10) + a + some(10))), (50, " ".join(some(10) + b + some(10))), (51, " ".join(a)), (52, " ".join(b))]
    rows += [(60, " ".join(same + some(30))), (60, " ".join(same + some(30)))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = set(con.execute(suffix_dedup.ORACLE_SQL).fetchall())
    got = {tuple(r) for r in suffix_dedup.repeats(table(spark, rows)).select("doc_id", "first_doc_id", "start_word", "n_words").collect()}
    assert got == want and {50, 51, 52, 60} & {r[0] for r in want} == {51, 52, 60}


def test_minima_of_a_text_of_over_16_million_words():
    class Long:
        def __init__(self, h):
            self.hash = h

        def __len__(self):
            return len(self.hash)

    h = np.random.default_rng(18).integers(0, 2**64, (1 << 24) + 500, dtype=np.uint64)
    h[(1 << 24) - 200 : (1 << 24) + 200] = h[0]  # equal shingles across the end of the first piece
    got, a = suffix_dedup.minima(Long(h)), (1 << 24) - 1000
    assert (got[a:] == suffix_dedup.minima(Long(h[a:])) + a).all()
    assert (got[:1000] == suffix_dedup.minima(Long(h[:1100]))[:1000]).all()


def test_suffix_cut(spark):
    rng = random.Random(14)
    p, a, b = prose(rng, 80)[:-1], prose(rng, 30), prose(rng, 30)
    df = table(spark, [(1, f"{a} {p} {b}"), (2, f"{b} | {p} | {a}"), (3, p), (4, None), (5, "")])
    cut = suffix_dedup.cut(df)
    assert cut.columns == df.columns
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[2]["text"] == f"{b} |  | {a}" and got[2]["n_chars"] == len(got[2]["text"])
    assert suffix_dedup.cut(df.limit(0)).collect() == []


# --- 7: chats ---


def test_chat(spark):
    parts = json.dumps([{"type": "text", "text": "look"}, {"type": "image", "url": "u1", "width": 1024, "height": 512}, {"type": "audio", "path": "p", "seconds": 2.5}, {"type": "document", "id": "d", "pages": 3}, {"type": "video"}])
    df = spark.createDataFrame([(1, 1, "user", parts, 0), (1, 2, "assistant", "fine <|end|>", 0), (1, 2, "assistant", "fine <|end|>", 1), (2, None, None, None, 0), (None, 1, "user", "x", 0), (3, 1, "user", "[1, 2", 0)], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["text"] == "<|user|>\nlook<|image_1|><|audio_1|><|document_1|><|unknown_1|><|end|>\n<|assistant|>\nfine < |end|><|end|>\n"
    assert [(a["kind"], a["ref"], a["turn"], a["part"], a["n_tokens"]) for a in one["attachments"]] == [("image", "u1", 0, 1, 425), ("audio", "p", 0, 2, 75), ("document", "d", 0, 3, 1800), ("unknown", None, 0, 4, 0)]
    assert one["n_tokens"] == one["n_text_tokens"] + 4 + 425 + 75 + 1800
    assert got[2]["text"] == "<|unknown|>\n<|end|>\n" and got[3]["text"].startswith("<|user|>\n[1, 2")
    assert chat_format.formatted(df.limit(0)).collect() == []


def hostile():
    return [
        "[" * 200_000, '[{"type": "text", "text": "\\ud800x"}, {"type": "image", "url": "\\udc00"}]', '[{"type": "image", "url": "u", "width": 1' + "0" * 400 + ', "height": 5}]',
        '[{"type": "image", "url": "u", "width": 1e300, "height": 1e300}, {"type": "document", "pages": 1e30}, {"type": "audio", "seconds": NaN}]',
        '[{"type": "audio", "seconds": 1' + "0" * 5000 + "}]", '[{"type": "text"}, {"type": "text", "text": 5}, {"type": "other"}, {"type": "init__"}]', "[]", "[1]", '[{"type": 3}]', '{"type": "text", "text": "x"}', " [ ", "\x00[",
    ]


def test_chat_of_hostile_content(spark):
    long = "word " * 200_000
    rows = [(i, 1, "user", t, "k", 9) for i, t in enumerate([*hostile(), long])] + [(50, 1, "user", "tie b", "k", 9), (50, 1, "user", "tie a", "k", 9), (50, 1, "agent", "tie c", "k", 9), (50, 1, "user", "tie a", "k", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, n_tokens long")
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    assert len(got) == len(hostile()) + 2
    assert got[0]["n_parts"] == 1 and got[0]["text"] == "<|user|>\n" + "[" * 200_000 + "<|end|>\n"
    assert "\ufffdx<|image_1|>" in got[1]["text"] and got[1]["attachments"][0]["ref"] == "\ufffd"
    assert [a["n_tokens"] for a in got[2]["attachments"]] == [255] and [a["n_tokens"] for a in got[3]["attachments"]] == [255, 600, 25]
    assert got[4]["n_parts"] == 1 and [a["kind"] for a in got[5]["attachments"]] == ["unknown", "unknown"]
    assert all(got[k]["attachments"] == [] for k in range(6, 12))
    assert got[len(hostile())]["text"] == f"<|user|>\n{long}<|end|>\n"
    assert got[50]["text"] == "<|agent|>\ntie c<|end|>\n<|user|>\ntie a<|end|>\n<|user|>\ntie b<|end|>\n" and got[50]["n_turns"] == 3


def test_chat_against_a_plain_version(spark):
    """Random conversations of typed parts against a straightforward loop."""
    rng = random.Random(22)
    enc = bpe.encoder(bpe.VOCABULARY)
    count = lambda t: len(enc.encode_ordinary(t))

    def part():
        kind = rng.choice(["text", "text", "image", "audio", "document", "video"])
        p = {"type": kind}
        if kind == "text":
            p["text"] = rng.choice(["hello there", "<|end|> mark", "", "中文 text"])
        if rng.random() < 0.7 and kind != "text":
            p[rng.choice(["url", "path", "id"])] = f"ref{rng.randrange(99)}"
        for key in ("width", "height", "seconds", "pages"):
            if rng.random() < 0.6:
                p[key] = rng.choice([1, 512, 513, 3000, 2.5, -4, 0, "7", True, None])
        if kind == "document" and rng.random() < 0.4:
            p["text"] = "a document of its own"
        return p

    def size(p, key):
        v = p.get(key)
        return v if type(v) in (int, float) and v > 0 else None

    rows, want = [], {}
    for conv in range(60):
        out, files, tokens, numbers, parts_n = "", [], 0, {}, 0
        n = rng.randrange(1, 6)
        for turn in range(n):
            parts = [part() for _ in range(rng.randrange(1, 5))]
            rows.append((conv, turn, "user", json.dumps(parts)))
            out += "<|user|>\n"
            for k, p in enumerate(parts):
                parts_n += 1
                if p["type"] == "text":
                    t = p["text"].replace("<|", "< |")
                    out, tokens = out + t, tokens + count(t)
                    continue
                kind = p["type"] if p["type"] != "video" else "unknown"
                numbers[kind] = numbers.get(kind, 0) + 1
                out += f"<|{kind}_{numbers[kind]}|>"
                w, h = size(p, "width"), size(p, "height")
                cost = {
                    "image": 85 + 170 * (-(-w // 512) * -(-h // 512) if w and h else 1), "audio": 25 * -(-(size(p, "seconds") or 1) // 1),
                    "document": count(p["text"]) if "text" in p else 600 * -(-(size(p, "pages") or 1) // 1), "unknown": 0,
                }[kind]
                files.append((kind, p.get("url", p.get("path", p.get("id"))), turn, k, int(cost)))
            out += "<|end|>\n"
        want[conv] = (n, parts_n, out, files, tokens, tokens + 2 * n + sum(f[4] for f in files))
    rng.shuffle(rows)
    got = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"]: (r["n_turns"], r["n_parts"], r["text"], [tuple(a) for a in r["attachments"]], r["n_text_tokens"], r["n_tokens"]) for r in got} == want


# --- 10: quality ---


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    n, acc = 20_000, np.array([[0.99, 0.7], [0.985, 0.6], [0.99, 0.8]])  # right votes on good and on bad texts
    y = rng.random(n) < 0.8
    v = np.stack([np.where(rng.random(n) < np.where(y, a[0], a[1]), y, ~y) for a in acc], axis=1).astype(int)
    v[rng.random(v.shape) < 0.2] = -1
    p, c = np.unique(quality.pattern_number(v), return_counts=True)
    weak = quality.expectation_maximisation(quality.pattern_votes(p, 3), c.astype(float), odds=4.0)
    assert np.abs(weak.accuracy[:, 0, 1] - acc[:, 1]).max() < 0.15
    assert np.mean((weak.posterior[quality.pattern_number(v)] > 0.5) == y) > 0.9


def test_expectation_maximisation_at_the_shipped_odds():
    """Good texts prevail and few labellers see each kind of bad text, as in the query; the classes come out right."""
    rng = np.random.default_rng(4)
    n, m = 30_000, len(quality.LABELLERS)
    good, kind = rng.random(n) < 0.85, rng.integers(0, m // 2, n)
    v = np.where(rng.random((n, m)) < 0.01, 0, 1)  # of good texts a labeller calls one in a hundred bad, so some 7 in 100 have a bad vote
    for l in range(m):  # each kind of bad text is seen by two labellers
        hit = ~good & (kind == l // 2)
        v[hit, l] = (rng.random(hit.sum()) > 0.9).astype(int)
    v[rng.random(v.shape) < 0.1] = -1
    p, c = np.unique(quality.pattern_number(v), return_counts=True)
    weak = quality.expectation_maximisation(quality.pattern_votes(p), c.astype(float))
    found = weak.posterior[quality.pattern_number(v)] > 0.5
    assert found[good].mean() > 0.9 and (~found)[~good].mean() > 0.85


def test_votes_against_loops():
    rng = random.Random(26)
    pieces = ["word ", "WORD ", "Sentence ends. ", "! ", "| ", "line\n", "same line here\n", "$$$ ", "x", "\t", "longerwordthanusual" * 2 + " ", "\n", "é ", "5 "]
    texts = ["".join(rng.choice(pieces[: rng.randrange(2, len(pieces))]) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    got = quality.View(texts).votes()

    def vote(good, bad):
        return 0 if bad else 1 if good else -1

    for text, row in zip(texts, got, strict=True):
        ws, n = tokens(text), max(len(tokens(text)), 1)
        letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
        symbols = sum(c in "#$%&*+<=>@[]^_`{|}~\\/" for c in text) / max(len(text), 1)
        lines, seen, again = [l for l in text.split("\n") if tokens(l)], set(), 0
        for l in lines:
            key = l.lower()[re.search(r"[^\W_]", l).start() : len(l) - re.search(r"[^\W_]", l[::-1]).start()]
            again += key in seen
            seen.add(key)
        ends, shouts, bars = sum(c in ".?!" for c in text), text.count("!"), text.count("|") + text.count("\t")
        distinct, low = len(set(ws)) / n, min(0.4, 4 / n**0.5)
        want = [
            vote(symbols < 0.01, symbols > 0.04), vote(capitals < 0.2 * letters, capitals > 0.5 * letters),
            -1 if len(ws) < 20 else vote(distinct > low, distinct < low / 2), -1 if len(lines) < 3 else vote(again < 0.1 * len(lines), again > 0.3 * len(lines)),
            -1 if len(ws) < 20 else vote(ends * 40 > n and ends < n, ends * 80 < n or ends > n), vote(bars < 0.02 * n, bars > 0.2 * n),
            -1 if len(ws) < 5 else vote(2 * n < letters < 10 * n, letters > 20 * n or letters < n), vote(shouts < 0.05 * n, shouts > 0.3 * n),
        ]
        assert row.tolist() == want, text


def test_quality_against_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judged(docs).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    good = [r for r in got if r["quality"] == 1]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["keep"] for r in good) >= 0.9 * len(good)
    assert bad and sum(not r["keep"] for r in bad) >= 0.8 * len(bad)  # one that keeps everything fails


def test_quality_of_odd_rows(spark):
    df = table(spark, odd(random.Random(15)))
    got = quality.judged(df).collect()
    assert len(got) == 11 and all(not r["keep"] and r["score"] is None for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.judged(df.limit(0)).collect() == []


# --- queries and the pipeline ---


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    got = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in got.fetchall())


def test_pipeline_is_its_stages(spark, sf, tmp_path):
    import shutil

    shutil.copytree(sf, tmp_path / "t")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = {r[0]: r[1] for r in out.select("doc_id", "text").collect()} if k < 4 else before
        f(spark, out, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
            after = {r[0]: r[1] for r in out.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
            if k == 2:  # what the brute-force version cuts, and nothing else
                gone = {}
                for d, _, a, n in brute_spans(list(before.items())):
                    gone.setdefault(d, set()).update(range(a, a + n))
                for d, t in before.items():
                    left = [w for i, w in enumerate(tokens(t)) if i not in gone.get(d, ())]
                    assert tokens(after.get(d)) == left if d in gone else after[d] == t
            if k == 3:
                bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
                bad = {d for d, _ in brute_contained(list(before.items()), bench, decontamination.SHINGLE, decontamination.THRESHOLD)}
                assert set(before) - set(after) == bad
            last = after
    assert {r["doc_id"] for r in out.collect()} == set(last)
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r["doc_id"]: r["tokens"] for r in out.collect()}


def test_pipeline_drops_all_near_copies(spark, tmp_path):
    """Copies whose differences are scattered over the signature: the stage against all pairs, then the whole pipeline."""
    rng = random.Random(33)
    rows = [(1000 + i, t) for i, t in scattered_copies(rng, 4)] + [(100 + i, t) for i, t, _ in toxic_set(100, 3)]
    labels = spark.createDataFrame([(100 + i, 1, y) for i, _, y in toxic_set(100, 3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sig, _ = simhash_dedup.signatures_of([t for _, t in rows])
    gone = {i for i, r in components(all_near(sig, [i for i, _ in rows], simhash_dedup.MAX_BITS)).items() if i != r}
    assert {1001, 1003, 1005, 1007} <= gone
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, _ in rows} - gone
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i in left if i >= 1000} == {1000, 1002, 1004, 1006}


def test_pipeline_links_by_ids_with_several_texts(spark, tmp_path):
    rows = [(1000 + i, t) for i, t in repeated_ids(random.Random(35))]
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1005, 1023, 1030, 1040, 1040, 1050]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and extra columns go through all stages, and an empty table gives none."""
    rng = random.Random(27)
    bench = spark.createDataFrame([(1, prose(rng, 30)), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1, y) for i, _, y in toxic_set(100, 3)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    item = bench.where("item_id = 1").first()["text"]
    rows = odd(rng) + [(100 + i, t) for i, t, _ in toxic_set(100, 3)] + [(300, prose(rng, 50) + " " + item), (301, prose(rng, 120)), (301, prose(rng, 120)), (None, None)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), table(spark, rows).columns
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, str(tmp_path))
        if k < 4:
            assert out.columns == columns
            assert out.where("doc_id IS NULL").count() == 2  # rows without an id belong to no group and stay
            out.write.parquet(f"{tmp_path}/{k}")
            before = spark.read.parquet(f"{tmp_path}/{k}")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    assert 300 not in ids and 5 not in ids and ids.count(7) == 2 and ids.count(8) == 1 and ids.count(301) == 2 and {1, 2, 3, 4, 6, 8} <= set(ids)
    assert {r["doc_id"] for r in got if r["tokens"] is None} == {1, None} and all(r["round_trip"] is not False for r in got)
    table(spark, rows).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
