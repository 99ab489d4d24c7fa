import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions.porter import stem
from quillspark.operators import distance, evaluate
from quillspark.plans.model import CULLERS, DISTANCES, DRIVERS, METHODS, BadParameter, BadPipeline, Config, Registry, Spec, UnknownComponent
from quillspark.plans.pipeline import Pipeline, featured, verdicts
from quillspark.plans.presets import PRESETS
from quillspark.sources import documents, segments, sinks


def events(spark, text, spec):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return featured(df, Config((spec,)))[0].first()["events"]


@pytest.mark.parametrize(
    "text, spec, expected",
    [
        ("abcd", "leave_k_out_character_ngram", ["_ b c", "a _ c", "a b _", "_ c d", "b _ d", "b c _"]),
        ("abcdef", "leave_k_out_character_ngram:n=3,k=3", []),
        ("the the the the fox", "truncated_frequency", ["2", "2", "2", "2", "0"]),
        ("hello world", "syllables_per_word", ["2", "1"]),
        ("ab", "character_ngram", []),
        ("", "word_ngram", []),
        (None, "word_events", []),
        ("a b c d", "k_skip_word_ngram", ["a c", "b d"]),
        ("bca", "sorted_character_ngram", ["abc"]),
        ("One two. Three!", "first_word_in_sentence", ["One", "Three"]),
        ("x\U0001f600y", "character_ngram:n=2", ["x\U0001f600", "\U0001f600y"]),
    ],
)
def test_events(spark, text, spec, expected):
    assert events(spark, text, spec) == expected


@pytest.mark.parametrize("word, expected", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("adjustable", "adjust"), ("is", "is"), ("controll", "control")])
def test_porter(word, expected):
    assert stem(word) == expected


def test_ascii(spark):
    from quillspark.plans.model import CANONICIZERS

    df = spark.createDataFrame([("café “naïve” — … 中",), (None,)], "t string")
    assert [r[0] for r in df.select(CANONICIZERS.create("normalize_ascii")(F.col("t"))).collect()] == ['cafe "naive" - ... ', None]


H = [{"a": 3, "b": 1}, {"a": 1, "b": 3}, {"a": 1, "b": 1, "c": 1}, {"x": 10}, {"a": 1}, {"a": 5, "b": 2, "c": 3}, {c: 1 for c in "abcde"}, {}]


def test_distance_properties(spark):
    left = spark.createDataFrame([(i, e, c) for i, h in enumerate(H) for e, c in h.items()], "u long, event string, cnt long")
    ids = spark.createDataFrame([(i,) for i in range(len(H))], "u long")
    k = lambda df: df.withColumnRenamed("u", "k")
    symmetric = "cosine manhattan euclidean hellinger bhattacharyya bray_curtis canberra intersection angular_separation chord matusita soergel wave_hedges nominal_ks".split()
    for name in DISTANCES.names():
        d = {(r["u"], r["k"]): r["dist"] for r in distance.distances(left, k(left), ids, k(ids), DISTANCES.create(name)).collect()}
        assert len(d) == 64
        if name in symmetric:
            assert all(abs(d[i, j] - d[j, i]) < 1e-9 or d[i, j] == d[j, i] for i, j in d)
        if name not in ("kendall_correlation", "kendall_tau_b", "pearson_correlation", "cross_entropy", "ppm", "ncd"):
            assert all(abs(d[i, i]) < 1e-6 for i in range(7)), name
    assert {(r["u"], r["k"]): r["dist"] for r in distance.distances(left, k(left), ids, k(ids), DISTANCES.create("angular_separation")).collect()}[0, 7] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=2, max_size=30))
def test_concordance_is_that_of_all_pairs(points):
    import numpy as np

    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    pairs = [(i, j) for i in range(len(x)) for j in range(i)]
    s = sum(int(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i, j in pairs)
    assert distance.concordance(x, y) == (s, sum(x[i] == x[j] for i, j in pairs), sum(y[i] == y[j] for i, j in pairs), sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, a, a is not None) for i, (t, a) in enumerate(rows)], "doc_id long, text string, author string, known boolean")


def test_cats_and_dogs(spark):
    docs = docs_of(spark, [("the cat sat on the cat mat", "Cat"), ("a cat and a cat purr", "Cat"), ("the dog ran to the dog park", "Dog"), ("my cat and your cat", None)])
    top = Pipeline(Config(("word_events",), (), (), "manhattan")).run(docs).where("rank = 1").first()
    assert (top["doc_id"], top["author"]) == (3, "Cat")
    knn = Pipeline(Config((Spec("character_ngram"),), (), (Spec("most_common"),), "cosine", Spec("knn", {"k": 99}))).run(docs).collect()
    assert abs(sum(r["score"] for r in knn) - 1) < 1e-12


def test_cullers_look_at_known_documents_only(spark):
    docs = docs_of(spark, [("a a a b c", "A"), ("a a b b c", "B"), ("z " * 10 + "a", None)])
    c = Pipeline(Config(("word_events",), (), (Spec("most_common", {"n": 2}),), "cosine")).prepare(docs)
    assert {r["event"] for r in c.hist.collect()} == {"a", "b"}


def test_methods_on_empty_and_zero_overlap(spark):
    docs = docs_of(spark, [("a b", "A"), ("", "A"), ("c d", "B"), ("x y", None), ("", None), (None, None)])
    for method in ("nearest_neighbor", "centroid", "markov_chain", "naive_bayes", "contrastive", "thin_xent", "eders_delta", "lda"):
        got = Pipeline(Config(("word_events",), (), (), "cosine", method)).run(docs).collect()
        assert len(got) == 6, method


def test_preset_configs_are_valid():
    assert len(PRESETS) == 15
    for c in PRESETS.values():
        Pipeline(c)
    assert (len(DRIVERS.items), len(CULLERS.items), len(DISTANCES.items), len(METHODS.items)) == (41, 15, 26, 21)


def test_errors():
    with pytest.raises(UnknownComponent):
        Pipeline(Config(("nothing",)))
    with pytest.raises(BadParameter):
        DRIVERS.create("character_ngram", {"n": 99})
    with pytest.raises(BadPipeline):
        Pipeline(Config(("word_events", "perplexity"), method="svm"))
    with pytest.raises(BadPipeline):
        Pipeline(Config(("word_events",)))
    with pytest.raises(BadParameter):
        Spec.parse("x:y")
    r = Registry("thing")
    r.register("a")(lambda: 1)
    assert r.create("a") == 1


def test_metrics(spark):
    p = spark.createDataFrame([(0, 1, "A", "A", 0.9), (1, 2, "A", "A", 0.8), (2, 3, "B", "A", 0.5)], "fold int, doc_id long, true_author string, predicted_author string, top double")
    s = evaluate.summary(p).first()
    assert (s["correct"], s["unanswered"]) == (2, 1)
    assert abs(s["c_at_1"] - 8 / 9) < 1e-12
    assert {r["author"]: r["f1"] for r in evaluate.by_author(p).collect()} == {"A": 0.8, "B": 0.0}
    text = sinks.results_csv(p)
    assert text.count("\n\n") == 3 and "accuracy,0.666667" in text
    assert json.loads(sinks.results_json(p))["summary"]["n"] == 3


def test_no_answer_needs_a_threshold(spark):
    schema = "fold int, doc_id long, true_author string, predicted_author string, top double, threshold double"
    rows = [(0, 1, "A", "A", 0.9, 0.5), (0, 2, "A", "B", 0.5, 0.5), (0, 3, "B", "B", 0.5, None), (0, 4, "B", "A", 0.8, None)]
    get = lambda r: evaluate.f05u_by_threshold(spark.createDataFrame(r, schema)).first()[0]
    f05 = 1.25 * (2 / 3) * (2 / 4) / (0.25 * (2 / 3) + 2 / 4)  # two of three answers are right
    assert abs(get(rows) - (3 * f05 + 2 / 3) / 4) < 1e-12
    assert get(rows[1:2]) == 0.0 and get([]) is None
    assert get(rows[2:3]) == 1.0


def test_brier_of_distances_that_are_all_zero(spark):
    docs = spark.createDataFrame([(1, "A")], "doc_id long, author string")
    s = spark.createDataFrame([(1, 1, "A", 0.0), (1, 2, "B", 0.0)], "doc_id long, rank int, author string, score double")
    assert evaluate.brier_by_distance(s, docs, False).first()[0] == 0.0


def test_verdicts(spark):
    r = spark.createDataFrame([(1, 1, "A", 0.5), (2, 1, "A", 0.6), (3, 1, "A", 0.4)], "doc_id long, rank int, author string, score double")
    assert {x["doc_id"]: x["verdict"] for x in verdicts(r).collect()} == {1: "INCONCLUSIVE", 2: "VERIFIED", 3: "REJECTED"}


def test_folds_cover_all():
    f = evaluate.folds_for(range(10), 3)
    assert sorted(f) == list(range(10)) and set(f.values()) == {0, 1, 2}
    with pytest.raises(BadPipeline):
        evaluate.folds_for(range(3), 1)


def test_html():
    assert documents.text_of_html("<p>One &amp; <b>two</b></p><!-- no --><p> three</p>") == "One &\ntwo\nthree"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.html").write_text("<h1>Head</h1><p>Body</p>")
    buf = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    (tmp_path / "m.csv").write_text("a.txt,A\n\nb.html,B,news\nc.docx,\n")
    got = {r["title"]: r for r in documents.load_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert {k: (r["text"], r["author"], r["genre"], r["known"]) for k, r in got.items()} == {
        "a": ("café", "A", None, True), "b": ("Head\nBody", "B", "news", True), "c": ("One\nTwo", None, None, False),
    }


def test_corpora(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(f"text {name}")
    (tmp_path / "m.json").write_text(json.dumps([{"id": "x", "name": "X", "description": "", "known": [{"file": "a.txt", "author": "A"}],
        "unknown": [{"file": "b.txt", "true_author": "A"}, {"file": "c.txt", "true_author": "NONE"}]}]))
    known, unknown = documents.import_sample_corpus(spark, str(tmp_path / "m.json"), "x", str(tmp_path / "copy"))
    with pytest.raises(Exception, match="(?i)exists"):
        documents.import_sample_corpus(spark, str(tmp_path / "m.json"), "x", str(tmp_path / "copy"))
    for name in "abc":
        (tmp_path / f"{name}.txt").unlink()  # the copy stands alone
    assert [(r["text"], r["author"]) for r in known.collect()] == [("text a", "A")]
    assert {r["text"]: r["true_author"] for r in unknown.collect()} == {"text b": "A", "text c": None}


def test_counts_and_pages(spark):
    corpora = spark.createDataFrame([("a", "one"), ("b", "two")], "corpus_id string, name string")
    members = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "corpus_id string, doc_id long")
    assert {r["corpus_id"]: r["document_count"] for r in documents.corpus_counts(corpora, members).collect()} == {"a": 2, "b": 0}
    page = lambda limit, offset: [r[0] for r in documents.page(spark.range(10), [F.desc("id")], limit, offset).collect()]
    assert page(3, 2) == [7, 6, 5] and page(5, 9) == [0] and page(5, 10) == [] and page(0, 0) == []


def test_command_line(spark, tmp_path, capsys):
    for n, t in (("a", "the cat sat here with the cat"), ("b", "a dog ran far and a dog bit"), ("u", "my cat sat with your cat")):
        (tmp_path / f"{n}.txt").write_text(t)
    m = tmp_path / "m.csv"
    m.write_text("a.txt,A\nb.txt,B\nu.txt\n")
    assert cli.main(["run", str(m), "-e", "word_events", "-d", "cosine", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["rankings"][0]["author"] == "A"
    assert cli.main(["list-components", "distance", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 26
    assert cli.main(["run", str(m), "-e", "nothing"], spark) == 1
    (tmp_path / "d.txt").write_text("one two three\n\none two four\n\nfive six seven")
    assert cli.main(["detect-changes", str(tmp_path / "d.txt"), "--json"], spark) == 0
    assert [b["is_change"] for b in json.loads(capsys.readouterr().out)["boundaries"]] == [False, True]


def test_roman_and_chapters(spark):
    df = spark.createDataFrame([("XIV",), ("mcmxc",), ("abc",)], "s string")
    assert [r[0] for r in df.select(segments.roman(F.col("s"))).collect()] == [14, 1990, None]
    book = spark.createDataFrame([(1, "CHAPTER I\nfirst words here\nCHAPTER II\nsecond words here")], "doc_id long, text string")
    assert [r["body"] for r in segments.split_chapters(book, 2).orderBy("part").collect()] == ["first words here", "second words here"]
