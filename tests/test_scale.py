"""Steps that were cut to size, against the plans and loops they stand for."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dense, distance, evaluate
from quillspark.plans.model import DISTANCES, Config, Spec
from quillspark.plans.pipeline import counts, featured, histogram

TEXTS = ["the cat_ _ sat on the\x1c mat the", "", None, "_", "a b", "\U0001f600x\U0001f600 _x a B b", "Relational relating RELATES the The  end", "\t\n", "a b c d e f g a b c"]
FORMS = [
    "character_ngram", "character_ngram:n=9", "character_events", "word_events", "word_ngram", "word_ngram:n=7", "sorted_word_ngram", "sorted_character_ngram", "k_skip_word_ngram", "k_skip_character_ngram:k=2",
    "leave_k_out_word_ngram", "leave_k_out_character_ngram", "leave_k_out_character_ngram:n=4,k=2", "leave_k_out_word_ngram:n=2,k=3", "function_words", "mw_function_words", "porter_stemmer", "suffix",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("spec", FORMS)
def test_counted_where_the_texts_lie(spark, spec):
    """Numbers counted from texts are those of the driver's events, and no event crosses the network for a histogram."""
    docs, config = docs_of(spark, TEXTS), Config((spec,), ("normalize_whitespace",) if "function" in spec else ())
    want = {(r[0], r[1]): r[2] for r in histogram(featured(docs, config)[0]).collect()}
    got = counts(docs, config).histogram()
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    totals = {r[0]: (r[1], r[2]) for r in counts(docs, config).totals().collect()}
    assert totals == {e: (sum(c for (_, x), c in want.items() if x == e), sum(x == e for _, x in want)) for e in {x for _, x in want}}


def test_an_id_on_several_rows_is_one_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    source = counts(docs, Config(("word_events",)))
    assert {(r[0], r[1]): r[2] for r in source.histogram().collect()} == {(1, "a"): 3, (1, "b"): 1, (1, "c"): 1, (2, "a"): 1, (None, "a"): 1, (None, "b"): 1}
    assert {r[0]: (r[1], r[2]) for r in source.totals().collect()} == {"a": (5, 3), "b": (2, 2), "c": (1, 1)}


def table(spark, n, width, seed, of="k"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h = {e: rng.randrange(1, 5) for e in rng.sample(range(width), rng.randrange(0, width))} if i % 9 else {}
        rows.append((i, "ABC"[i % 3 if i else 0], sorted(h), [h[e] for e in sorted(h)]))
    return rows, spark.createDataFrame(rows, f"{of} long, author string, e array<int>, n array<long>")


@pytest.mark.parametrize("name", ["cosine", "manhattan"])
@pytest.mark.parametrize("apart", [False, True])
def test_blocks_as_matrices(spark, monkeypatch, name, apart):
    """Each author's nearest and the k nearest, over many small parts, against every pair."""
    for x, v in (("ROWS", 7), ("PART", 11), ("CELLS", 1)):
        monkeypatch.setattr(dense, x, v)
    a, b = (table(spark, 150, 9, 3 if apart else s) for s in (1, 2))
    fn = DISTANCES.create(name)
    long = lambda rows, k: spark.createDataFrame([(i, str(e), c) for i, _, es, ns in rows for e, c in zip(es, ns)], f"{k} long, event string, cnt long")
    ids = lambda t, k: t[1].select(F.col("k").alias(k))
    every = {(r["u"], r["k"]): r["dist"] for r in distance.distances(long(a[0], "u"), long(b[0], "k"), ids(a, "u"), ids(b, "k"), fn).collect() if not apart or r["u"] != r["k"]}
    left = a[1].withColumnRenamed("k", "u")
    best = {(r["u"], r["author"]): r["score"] for r in dense.nearest(left, b[1], dense.kernel(fn), 9, apart=apart).collect()}
    author = {r[0]: r[1] for r in b[0]}
    want = {}
    for (u, k), d in every.items():
        want[u, author[k]] = min(d, want.get((u, author[k]), 9))
    assert set(best) == set(want) and all(abs(best[x] - want[x]) < 1e-12 for x in want)
    near = {}
    for r in dense.nearest(left, b[1], dense.kernel(fn), 9, "nearest", 4, apart).collect():
        near.setdefault(r["u"], []).append((round(r["dist"], 10), r["k"], r["author"]))
    for u in range(150):
        first = sorted((round(d, 10), k) for (x, k), d in every.items() if x == u)[:4]
        got = sorted(near[u])[:4]
        assert [x[1] for x in got] == [x[1] for x in first] and all(author[x[1]] == x[2] for x in got)


def test_groups_have_a_partition_each(spark):
    got = dense.placed(spark.range(500), F.col("id") % 37, 37).select("g", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["g"] for r in got}) == len({r["p"] for r in got}) == 37


@pytest.mark.parametrize("tau", ["kendall_correlation", "kendall_tau_b"])
def test_tau_of_many_pairs(tau):
    """The products against the merge sort, with empty documents, ties and events that neither has."""
    import pyarrow as pa

    from quillspark.operators.blocks import Side

    rng, width, fn = np.random.default_rng(4), 12, DISTANCES.create(tau)
    m = [rng.integers(0, 4, (k, width)) * (rng.random((k, width)) < 0.6) for k in (40, 9)]
    m[0][0] = m[1][0] = 0
    m[0][1, :] = m[1][1, :] = [1] + [0] * (width - 1)
    sides = [Side.of(pa.array(range(len(x))), (x > 0).sum(axis=1), np.nonzero(x)[1], x[x > 0].astype(float)) for x in m]
    got = distance.tau_matrix(*sides, width, fn.tau)
    h = [[{f"{e:02}": int(c) for e, c in enumerate(row) if c} for row in x] for x in m]
    for i, j in itertools.product(range(40), range(9)):
        assert abs(got[i, j] - fn.fn(h[0][i], h[1][j])) < 1e-9, (i, j)


def test_linear_support_vectors_by_features():
    """Weights of features give the margins that weights of documents gave."""
    from quillspark.operators import solvers

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), np.array(list("ABC"))[rng.integers(0, 3, 80)]
    x[:, 0] += y == "A"
    new, k = solvers.KernelSvm(x, y, "linear"), x @ x.T
    assert new.x.size == 0
    for c, (w, bias, *_) in zip(new.classes, new.parts):
        alpha, b = solvers.KernelSvm._solve(k, np.where(y == c, 1.0, -1.0))
        assert np.allclose(x @ w + bias, k @ alpha + b, atol=1e-8)


def test_topics_at_once_are_the_protocols_one_by_one(spark, monkeypatch):
    rng = random.Random(8)
    words = "the of and to a in that is was it for with".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice("ABC"), rng.choice(["1", "2", "2", None])) for i in range(40)] + [(90, "the of", "D", "3"), (91, "the", "A", "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, author string, topic string")
    config = Config(("function_words",), (), (), "cosine", "nearest_neighbor")
    get = lambda: sorted((r["protocol"], r["fold"], r["doc_id"], r["rank"], r["author"], round(r["score"], 9)) for r in evaluate.topic_controlled(config, docs).collect())
    ranks = lambda rows: {(p, f, d, a): s for p, f, d, _, a, s in rows}
    once = get()
    monkeypatch.setattr(evaluate, "_topics_at_once", lambda *a: None)
    assert ranks(once) == ranks(get())


def test_folds_by_their_first_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i * 7 % 31, f"{'x y' if i % 2 else 'y z'} w{i % 5}", "AB"[i % 2]) for i in range(20)], "doc_id long, text string, author string")
    config = Config(("word_events",), (), (), "cosine", "centroid")
    get = lambda: {(r["fold"], r["doc_id"], r["author"]): round(r["score"], 9) for r in evaluate.k_fold(config, docs, 3, shuffle=False).collect()}
    sent = []
    monkeypatch.setattr(evaluate, "by_folds", lambda *a, f=evaluate.by_folds: sent.append(1) or f(*a))
    got = get()
    assert not sent and {d: f for f, d, _ in got} == evaluate.folds_for(sorted(r[0] for r in docs.collect()), 3, False)


def test_equal_neighbours_change_nothing(spark):
    """Paragraphs A, B, A: both boundaries are equally far, to the last bit and in whatever order events are summed."""
    from quillspark.operators.style import style_changes

    rng = random.Random(1)
    docs = []
    for i in range(300):
        a, b = (" ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(20, 90))) for _ in "ab")
        docs.append((i, "\n\n".join([a, b, " ".join(rng.sample(a.split(), len(a.split())))])))
    got = style_changes(spark.createDataFrame(docs, "doc_id long, text string"), Config(("word_events",), (), (), "cosine")).collect()
    assert len(got) == 600 and all(r["score"] == 0 for r in got)
