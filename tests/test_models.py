"""Drivers and methods that take a model, with deterministic stand-ins registered; and classifiers against plain formulas or held-out data."""

import hashlib
import json
import math

import numpy as np
import pytest

from quillspark.functions import events
from quillspark.functions.events import ENCODERS, LANGUAGE_MODELS, PARSERS
from quillspark.operators import methods, solvers
from quillspark.operators.blocks import blocked, compiled
from quillspark.plans.model import DISTANCES, METHODS, BadPipeline, Config, LoadError, Spec
from quillspark.plans.pipeline import Pipeline, featured


def parser():
    """A function of its own, so that workers need not import this module."""
    def parse(text):
        """A stand-in for a parser: capitals are names, words in -s verbs; each token hangs on the one before."""
        words = text.split()
        tokens = [
            {"text": w, "pos": "PROPN" if w[0].isupper() else "VERB" if w.endswith("s") else "NOUN", "dep": "root" if i == 0 else "dep", "head": max(i - 1, 0), "vector": [float(len(w)), 1.0]}
            for i, w in enumerate(words)
        ]
        return tokens, [("NAME", w, i, i + 1) for i, w in enumerate(words) if w[0].isupper()]

    return parse


@pytest.fixture(autouse=True)
def stand_ins(monkeypatch):
    monkeypatch.setitem(PARSERS, "fake", parser())
    monkeypatch.setitem(ENCODERS, "fake", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    monkeypatch.setitem(LANGUAGE_MODELS, "fake", lambda t: [float(len(w)) for w in t.split()])


def run(spark, text, spec):
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    return {r["doc_id"]: r["events"] for r in featured(df, Config((spec,)))[0].select("doc_id", "events").collect()}


TEXT = "Anna sees Bob near home"


@pytest.mark.parametrize(
    "spec, expected",
    [
        (Spec("pos_tags", {"model": "fake"}), ["PROPN", "VERB", "PROPN", "NOUN", "NOUN"]),
        (Spec("coarse_pos_tags", {"model": "fake"}), ["N", "V", "N", "N", "N"]),
        (Spec("pos_ngram", {"model": "fake", "n": 3}), ["PROPN VERB PROPN", "VERB PROPN NOUN", "PROPN NOUN NOUN"]),
        (Spec("named_entities", {"model": "fake"}), ["NAME", "NAME"]),
        (Spec("entity_text", {"model": "fake"}), ["Anna", "Bob"]),
        (Spec("entity_context", {"model": "fake"}), ["AFTER:sees", "BEFORE:sees", "AFTER:near"]),
    ],
)
def test_parsed_events(spark, spec, expected):
    assert run(spark, TEXT, spec)[1] == expected


def test_missing_models_say_so(spark):
    for name, key in (("pos_tags", "model"), ("transformer_embeddings", "model_name"), ("selma_embeddings", "model_name"), ("perplexity", "model_name")):
        with pytest.raises(Exception, match="register one"):
            run(spark, TEXT, Spec(name, {key: "nowhere"}))


def test_definitions(spark, tmp_path):
    glossary = tmp_path / "g.tsv"
    glossary.write_text("home\tthe place where one lives (at 5)\nbob\ta short-haired dog\n")
    assert run(spark, TEXT, Spec("definitions", {"glossary": str(glossary)}))[1] == ["shorthaired", "dog", "place", "where", "one", "lives"]


def test_function_words_from_a_file(spark, tmp_path):
    words = tmp_path / "w.txt"
    words.write_text("near\nANNA\n\n")
    assert run(spark, TEXT, Spec("function_words", {"words": str(words)}))[1] == ["anna", "near"]


def test_vectors(spark):
    assert run(spark, "seen here", Spec("transformer_embeddings", {"model_name": "fake"}))[1] == [9.0, 4.0]
    prompt = "Instruct: say\nQuery: seen here"
    v = np.array([len(prompt), prompt.count("e")], float)
    assert np.allclose(run(spark, "seen here", Spec("selma_embeddings", {"model_name": "fake", "instruction": "say"}))[1], v / np.linalg.norm(v))
    got = run(spark, "a bbb cc", Spec("perplexity", {"model_name": "fake"}))
    x = np.array([1, 3, 2], float)
    z = (x - x.mean()) / x.std()
    assert np.allclose(got[1], [2, x.var(), (z**3).mean(), (z**4).mean() - 3]) and all(v is None or math.isnan(v) for v in got[2])


def test_graph_network(spark):
    """Two layers written out with loops."""
    tokens, _ = parser()(TEXT)
    pos, dep = sorted({t["pos"] for t in tokens}), sorted({t["dep"] for t in tokens})
    x = [[*t["vector"], *[float(t["pos"] == p) for p in pos], *[float(t["dep"] == d) for d in dep]] for t in tokens]
    for layer in range(2):
        rows, new = len(x[0]), []
        w = [[(int(hashlib.md5(f"42:{layer}:{i}:{j}".encode()).hexdigest()[:16], 16) / 2**63 - 1) / math.sqrt(rows) for j in range(4)] for i in range(rows)]
        for i in range(len(tokens)):
            near = {i} | {j for j in range(len(tokens)) if tokens[i]["head"] == j or tokens[j]["head"] == i}
            mean = [sum(x[j][k] for j in near) / len(near) for k in range(rows)]
            new.append([max(0.0, sum(mean[k] * w[k][c] for k in range(rows))) for c in range(4)])
        x = new
    got = run(spark, TEXT, Spec("gnn_embeddings", {"spacy_model": "fake", "hidden_dim": 4}))
    assert np.allclose(got[1], np.mean(x, axis=0))


def test_chinese_tokenizer(spark, tmp_path):
    (tmp_path / "jieba.py").write_text("def cut(s, cut_all=False):\n    return [s[i : i + 2] for i in range(0, len(s), 1 if cut_all else 2)]\n\n\ndef cut_for_search(s):\n    return list(s)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "jieba.py"))
    assert run(spark, "中文分词 好", Spec("word_events", {"tokenizer": "jieba"})) == {1: ["中文", "分词", " 好"], 2: None} or run(spark, "中文分词", Spec("word_events", {"tokenizer": "jieba"}))[1] == ["中文", "分词"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, a, a is not None) for i, (t, a) in enumerate(rows)], "doc_id long, text string, author string, known boolean")


def test_prompting(spark, monkeypatch):
    docs = docs_of(spark, [("the cat sat", "Cat"), ("a cat purrs", "Cat"), ("the dog ran", "Dog"), ("dog dog park", None), ("cat nap", None)])

    def answer(prompt):
        text = prompt.split("Unknown text:\n")[1].split("\n")[0]
        assert "Author Cat:\nthe cat sat\n\na cat purrs" in prompt and "Author Dog:\nthe dog ran" in prompt
        return f"I think so. {json.dumps({'ranking': ['Dog', 'Cat'] if 'dog' in text else ['Cat']})}"

    monkeypatch.setitem(methods.PROVIDERS, "fake", answer)
    got = Pipeline(Config(("word_events",), (), (), None, Spec("llm_prompting", {"provider": "fake"}))).run(docs).collect()
    assert {(r["doc_id"], r["author"]): (r["rank"], r["score"]) for r in got} == {(3, "Dog"): (1, 1.0), (3, "Cat"): (2, 0.5), (4, "Cat"): (1, 1.0), (4, "Dog"): (2, 0.5)}
    with pytest.raises(BadPipeline):
        Pipeline(Config(("word_events",), (), (), None, Spec("llm_prompting", {"provider": "nowhere"}))).run(docs)


def test_unmasking(spark):
    """The method's matrix, targets and order against loops; what the classifier loses is that of the solver on them."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(18):
        a = d % 3
        weights = np.ones(30)
        weights[a * 5 : a * 5 + 5] = 6
        rows.append((" ".join(rng.choice(words, 120, p=weights / weights.sum())), None if d >= 15 else "ABC"[a]))
    config = Config(("word_events",), (), (), None, Spec("unmasking", {"n_features": 20, "n_eliminate": 2, "n_iterations": 4, "n_folds": 3}))
    got = {(r["doc_id"], r["author"]): r["score"] for r in Pipeline(config).run(docs_of(spark, rows)).collect()}
    total = {}
    for t, a in rows:
        for w in t.split() if a else ():
            total[w] = total.get(w, 0) + 1
    top = sorted(sorted(total, key=lambda w: (-total[w], w))[:20])
    x = np.array([[t.split().count(w) / len(t.split()) for w in top] for t, _ in rows])
    for u in range(15, 18):
        for a in "ABC":
            y = np.array([int(b == a) for _, b in rows[:15]] + [1])
            assert abs(got[u, a] - solvers.unmask(np.vstack([x[:15], x[u]]), y, 2, 4, 3)) < 1e-9
    assert len(got) == 9


def test_unmasking_loses_what_its_strongest_features_carry():
    rng = np.random.default_rng(6)
    y = np.repeat([0, 1], 30)
    x = rng.normal(size=(60, 8)) * 0.1
    x[:, 3] += 2 * y  # all that tells the classes apart
    assert solvers.unmask(x, y, 1, 3, 5) > 0.3
    assert solvers.unmask(x + 2 * y[:, None], y, 1, 3, 5) < 0.05


def vectors(spark, seed=7, n=90):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4)) + np.array([[3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 3, 0]])[y]
    known = np.arange(n) % 5 != 0
    docs = spark.createDataFrame([(i, "ABC"[y[i]], bool(known[i])) for i in range(n)], "doc_id long, author string, known boolean")
    return x, y, known, methods.Corpus(docs, vectors=spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, features array<double>"))


def scores(corpus, name, **params):
    out = {}
    for r in METHODS.create(name, params)(corpus).collect():
        out.setdefault(r["u"], {})[r["author"]] = r["score"]
    return out


@pytest.mark.parametrize("name, params", [("svm", {"kernel": "linear"}), ("svm", {"kernel": "rbf"}), ("svm", {"kernel": "poly"}), ("mlp", {"hidden_size": 16, "max_iter": 200}), ("random_forest", {"n_estimators": 20}), ("decision_tree", {}), ("logistic_regression", {}), ("lda", {})])
def test_classifiers_on_held_out_vectors(spark, name, params):
    x, y, known, corpus = vectors(spark)
    got = scores(corpus, name, **params)
    assert set(got) == set(np.flatnonzero(~known)) and all(abs(sum(s.values()) - 1) < 1e-6 for s in got.values())
    assert np.mean([max(s, key=s.get) == "ABC"[y[u]] for u, s in got.items()]) >= (0.75 if name == "decision_tree" else 0.85)


def test_discriminant_is_the_gaussian_posterior(spark):
    x, y, known, corpus = vectors(spark)
    xs, ys = x[known], y[known]
    mean = np.stack([xs[ys == k].mean(axis=0) for k in range(3)])
    within = sum((xs[ys == k] - mean[k]).T @ (xs[ys == k] - mean[k]) for k in range(3))
    prior = np.bincount(ys) / len(ys)
    for scale in (len(xs), len(xs) - 3):  # either estimate of the covariance
        inv = np.linalg.inv(within / scale)
        z = x[~known] @ inv @ mean.T - 0.5 * np.einsum("kf,fg,kg->k", mean, inv, mean) + np.log(prior)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        got = scores(corpus, "lda")
        if np.allclose([[got[u]["ABC"[k]] for k in range(3)] for u in np.flatnonzero(~known)], p, atol=1e-6):
            return
    raise AssertionError("neither estimate")


def test_logistic_regression_minimises_its_loss(spark):
    x, y, known, corpus = vectors(spark)
    xs, ys = x[known], np.eye(3)[y[known]]
    w, b = np.zeros((4, 3)), np.zeros(3)
    for _ in range(20_000):
        z = xs @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.01 * (xs.T @ (p - ys) + w)
        b -= 0.01 * (p - ys).sum(axis=0)
    z = x[~known] @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got = scores(corpus, "logistic_regression")
    assert np.allclose([[got[u]["ABC"[k]] for k in range(3)] for u in np.flatnonzero(~known)], p, atol=2e-3)


def test_mahalanobis(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(6)]
    rows = [(" ".join(rng.choice(words, 60, p=np.roll([0.4, 0.2, 0.1, 0.1, 0.1, 0.1], d % 2))), None if d >= 12 else "AB"[d % 2]) for d in range(15)]
    got = {(r["doc_id"], r["author"]): r["score"] for r in Pipeline(Config(("word_events",), (), (), None, "mahalanobis")).run(docs_of(spark, rows)).collect()}
    x = np.array([[t.split().count(w) / 60 for w in words] for t, _ in rows])
    inverse = np.linalg.pinv(np.cov(x[:12].T), hermitian=True, rcond=1e-10)
    for u in range(12, 15):
        for k, a in enumerate("AB"):
            d = x[u] - x[k:12:2].mean(axis=0)
            assert abs(got[u, a] - math.sqrt(max(d @ inverse @ d, 0))) < 1e-6


def test_blocks_are_all_pairs(spark):
    """Every distance in small blocks against the plan that joins on events; nearest of each author, k nearest and leaving out equal ids."""
    rng = np.random.default_rng(9)
    hist = [{f"e{j}": int(rng.integers(1, 9)) for j in rng.choice(12, rng.integers(0, 8), replace=False)} for _ in range(23)]
    from quillspark.operators.distance import distances

    left = spark.createDataFrame([(i, e, c) for i, h in enumerate(hist) for e, c in h.items()], "u long, event string, cnt long")
    ids = spark.createDataFrame([(i,) for i in range(len(hist))], "u long")
    right, known = left.withColumnRenamed("u", "k"), spark.createDataFrame([(i, "AB"[i % 2]) for i in range(len(hist))], "k long, author string")
    for name in DISTANCES.names():
        d = DISTANCES.create(name)
        want = {(r["u"], r["k"]): r["dist"] for r in distances(left, right, ids, known.select("k"), d).collect()}
        got = {(r["u"], r["k"]): r["dist"] for r in blocked(left, right, ids, known, d, block=7).collect()}
        assert set(got) == set(want) and len(got) == 23 * 23, name
        assert all(abs(got[k] - v) < 1e-6 or got[k] == v for k, v in want.items()), name
    best = {(r["u"], r["author"]): r["score"] for r in blocked(left, right, ids, known, DISTANCES.create("manhattan"), "authors", apart=True, block=100).collect()}
    every = {(r["u"], r["k"]): r["dist"] for r in blocked(left, right, ids, known, DISTANCES.create("manhattan"), block=5).collect()}
    assert best == {(u, a): min(every[u, k] for k in range(23) if k != u and "AB"[k % 2] == a) for u in range(23) for a in "AB"}
    near = blocked(left, right, ids, known, DISTANCES.create("manhattan"), "nearest", k=4, block=100).collect()
    assert {(r["u"], r["k"]) for r in near} == {(u, k) for u in range(23) for k in sorted(range(23), key=lambda k: (round(every[u, k], 10), k))[:4]}


def test_expressions_in_numpy():
    assert compiled("CASE WHEN ((t1 = 0) OR (t2 = 0)) THEN 1D ELSE x0 / least(t1, 2e-1D) END")({"t1": np.array([0.0, 4.0]), "t2": np.array([1.0, 1.0]), "x0": np.array([5.0, 1.0])}).tolist() == [1.0, 5.0]
    assert compiled("CASE WHEN x0 <= 0 THEN double('Infinity') ELSE -ln(x0) END")({"x0": np.array([0.0, 1.0])}).tolist() == [math.inf, 0.0]
    assert issubclass(LoadError, Exception) and events.surprisal_profile([2.0])[0] == 2.0
