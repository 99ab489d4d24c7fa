"""The queries of the engine's own operators, each over a whole table.

A corpus is the documents table with author = source, genre = lang, topic = labels.quality and, as unknown documents, every fifth run of
20 ids. Scores are rounded before they are ranked, so that the last bits of a sum do not decide a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import events, text  # noqa: F401  (registers components)
from ..operators import cull, distance, evaluate, methods, style  # noqa: F401
from .model import CANONICIZERS, CULLERS, DISTANCES, Config, Spec
from .pipeline import Pipeline, canonical, counts, verdicts
from .presets import PRESETS

Query = Callable[[SparkSession, str], DataFrame]
LOW = ("unify_case", "normalize_whitespace")
TOP = Spec("most_common", {"n": 300})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, author, genre, known)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("source").alias("author"), F.col("lang").alias("genre"), (F.floor(F.col("doc_id") / 20) % 5 != 0).alias("known"))


def word_config(method: str | Spec, distance: str | Spec | None = None, cullers=(TOP,)) -> Config:
    return Config(("word_events",), LOW, cullers, distance, method)


def settled(rankings: DataFrame, higher: bool, digits: int = 8) -> DataFrame:
    """(doc_id, rank, author, score): scores rounded, then ranked again, ties by author."""
    s = rankings.select("doc_id", "author", F.round("score", digits).alias("score"))
    order = F.col("score").desc() if higher else F.col("score").asc()
    return s.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy(order, "author")).alias("rank"), "author", "score")


def ranked(config: Config) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Pipeline(config)
        return settled(p.run(corpus(spark, sf_dir)), p.higher_is_better)

    return run


# --- text ---


def _canon(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        return d.select("doc_id", CANONICIZERS.create(name)(F.col("text")).alias("text"))

    return run


def _events(spec: str | Spec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts(table(spark, sf_dir, "documents"), Config((spec,))).totals()

    return run


# --- selection ---


def _kept(spec: Spec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark, sf_dir)
        known = docs.where("known").select("doc_id", "author")
        source = counts(docs, word_config("nearest_neighbor"), ("known",))
        hist = source.histogram().join(known.select("doc_id"), "doc_id", "left_semi") if source.repeated else source.where("known").histogram()
        return CULLERS.create(spec.name, spec.params)(hist, known)

    return run


def culler_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word once a document: documents by word."""
    return CULLERS.create("set_culler")(counts(corpus(spark, sf_dir), word_config("nearest_neighbor")).histogram()).groupBy("event").agg(F.sum("cnt").alias("n"))


def culler_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cullers, each looking at the known documents as they came; totals of what is left."""
    docs = corpus(spark, sf_dir)
    hist = cull.cull(counts(docs, word_config("nearest_neighbor")).histogram(), docs.select("doc_id", "author", "known"), [Spec("most_common", {"n": 500}), Spec("range", {"min_count": 5, "max_count": 400})])
    return hist.groupBy("event").agg(F.sum("cnt").alias("n"), F.count("*").alias("df"))


# --- distances: every unknown document against every author's profile ---


def _distance(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = Pipeline(word_config("centroid", name)).run(corpus(spark, sf_dir))
        return got.select("doc_id", "author", F.round("score", 7).alias("score"))

    return run


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as paragraphs."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))["text"]
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda t: F.regexp_replace(t, "\n+", " ")), "\n\n").alias("text"))


def _changes(dist: str, drivers=("word_events",)) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = style.style_changes(_turns(spark, sf_dir), Config(drivers, LOW, (), dist))
        return got.select("doc_id", "boundary_index", F.round("score", 7).alias("score"), (F.round("score", 7) >= 0.5).alias("is_change"))

    return run


# --- evaluation ---


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One fold: the unknown documents by cosine to profiles; and the documents."""
    docs = corpus(spark, sf_dir)
    return settled(Pipeline(word_config("centroid", "cosine")).run(docs), False).withColumn("fold", F.lit(0)), docs


def evaluate_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, docs = _predicted(spark, sf_dir)
    return evaluate.by_author(evaluate.predictions(s, docs)).select("author", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def evaluate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, docs = _predicted(spark, sf_dir)
    return evaluate.confusion(evaluate.predictions(s, docs))


def evaluate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, c@1, F0.5u, Brier, macro means, error rate, area, reciprocal rank: one row."""
    s, docs = _predicted(spark, sf_dir)
    p = evaluate.predictions(s, docs)
    one = evaluate.summary(p)
    for more in (evaluate.macro(p), evaluate.eer(s, docs), evaluate.auroc(s, docs, False), evaluate.mrr(s, docs), evaluate.brier_by_distance(s, docs, False).withColumnRenamed("brier", "brier_by_distance")):
        one = one.crossJoin(more)
    return one.select(*[F.round(F.col(c).cast("double"), 7).alias(c) for c in one.columns])


def evaluate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F0.5u where only documents with a threshold (here even ids) can go unanswered; distances rounded to a tenth."""
    p = evaluate.predictions(*_predicted(spark, sf_dir)).withColumn("top", F.round("top", 1)).withColumn("threshold", F.when(F.col("doc_id") % 2 == 0, F.lit(0.5)))
    return evaluate.f05u_by_threshold(p).select(F.round("f05u", 7).alias("f05u"))


def evaluate_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words, cosine, nearest neighbour: each document against all others, as one pair join."""
    docs = corpus(spark, sf_dir)
    got = evaluate.leave_one_out(Config(("function_words",), LOW, (), "cosine", "nearest_neighbor"), docs)
    return settled(got.select("doc_id", "author", "score"), False).where("rank = 1").select("doc_id", "author", "score")


def evaluate_k_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of documents in the order of their ids, each against the profiles of the others."""
    docs = corpus(spark, sf_dir)
    got = evaluate.k_fold(word_config("centroid", "cosine"), docs, k=3, shuffle=False)
    top = settled(got, False).join(got.select("doc_id", "fold").distinct(), "doc_id")
    return evaluate.accuracy_by_fold(evaluate.predictions(top, docs))


def evaluate_cross_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of English documents, tested on French ones."""
    got = evaluate.cross_genre(word_config("centroid", "cosine"), corpus(spark, sf_dir).drop("known"), "en", "fr")
    return settled(got, False)


def evaluate_topic_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("topic"))
    docs = corpus(spark, sf_dir).drop("known").join(labels, "doc_id")
    s = evaluate.topic_controlled(Config(("function_words",), LOW, (), "cosine", "nearest_neighbor"), docs)
    true = docs.select("doc_id", F.col("author").alias("true_author"))
    s = s.select("protocol", "doc_id", "author", F.round("score", 8).alias("score"))
    order = W.partitionBy("protocol", "doc_id").orderBy("score", "author")
    top = s.withColumn("rank", F.row_number().over(order)).where("rank = 1").join(true, "doc_id")
    return top.groupBy("protocol").agg(F.count("*").alias("n"), F.avg((F.col("author") == F.col("true_author")).cast("double")).alias("accuracy"))


def evaluate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the first-ranked author of the General Imposters."""
    config = word_config(Spec("imposters", {"n_iterations": 10, "random_seed": 42, "calibration_low": 0.35, "calibration_high": 0.65}), "cosine", (Spec("most_common", {"n": 100}),))
    return verdicts(Pipeline(config).run(corpus(spark, sf_dir)))


# --- vectors ---


def _vectors(name: str, **params) -> Query:
    """A method over the embeddings table, author = label, unknown = every fifth id."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        docs = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("author"), (F.col("vec_id") % 5 != 0).alias("known"))
        vectors = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("features"))
        p = Pipeline(Config(("transformer_embeddings",), (), (), None, Spec(name, params)))
        return settled(p.attribute(methods.Corpus(docs, vectors=vectors)), p.higher_is_better, 6)

    return run


# --- sources and streams ---


def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the pages table's HTML."""
    from ..sources.documents import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def source_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by author, and a 60-character preview of the first."""
    from ..sources.documents import summary

    return summary(corpus(spark, sf_dir))


def source_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source's corpus; the source that no document names has none."""
    from ..sources.documents import corpus_counts

    members = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), "doc_id")
    named = members.select("corpus_id").where("corpus_id IS NOT NULL").distinct().union(spark.createDataFrame([("(empty)",)], "corpus_id string"))
    return corpus_counts(named, members)


def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's third page of 50 documents, newest id first."""
    from ..sources.documents import page

    return page(table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_chars")), [F.desc("doc_id"), F.asc("n_chars")], 50, 100)


def source_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at lines that end a sentence, parts of at least 20 words."""
    from ..sources.segments import split_parts

    return split_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), r"\n", 20)


def streaming_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown documents as a stream of files, scored against fixed profiles; what the sink holds when all is read."""
    from ..streaming.score import score_files

    got = score_files(spark, f"{sf_dir}/documents.parquet", corpus(spark, sf_dir).where("known"), word_config("centroid", "cosine"), lambda d: d.select(
        "doc_id", "text", (F.floor(F.col("doc_id") / 20) % 5 != 0).alias("known")).where("NOT known"))
    return settled(got, False)


def entry_cosine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: 300 commonest words, cosine, each author's nearest document."""
    return ranked(PRESETS["cosine-delta"])(spark, sf_dir)


DRIVER_SPECS: dict[str, Spec] = {
    n: Spec(n)
    for n in (
        "character_ngram word_events word_ngram function_words word_length sentence_length character_events punctuation punctuation_ngram mw_function_words"
        " leave_k_out_character_ngram leave_k_out_word_ngram sorted_character_ngram sorted_word_ngram k_skip_character_ngram k_skip_word_ngram suffix porter_stemmer"
        " rare_words vowel_initial_words first_word_in_sentence sentence_events line_length new_lines mn_letter_words vowel_mn_letter_words syllables_per_word"
        " syllable_transitions truncated_frequency reaction_time"
    ).split()
}
CULLER_SPECS: dict[str, Spec] = {
    "most_common": Spec("most_common"), "least_common": Spec("least_common"), "percentage_range": Spec("percentage_range", {"min_percent": 0.01, "max_percent": 1.0}),
    "information_gain": Spec("information_gain"), "zeta": Spec("zeta", {"threshold": 0.1}), "iqr": Spec("iqr"), "std_deviation": Spec("std_deviation"), "extreme": Spec("extreme"),
    "variance": Spec("variance", {"min_variance": 0.5}), "range": Spec("range", {"min_count": 5, "max_count": 100}),
    "coefficient_of_variation": Spec("coefficient_of_variation", {"min_cv": 2.0}), "mean_absolute_deviation": Spec("mean_absolute_deviation"),
    "index_of_dispersion": Spec("index_of_dispersion"), "weighted_variance": Spec("weighted_variance"),
}
PAIRWISE = [n for n in DISTANCES.names() if n not in ("ncd", "ppm")]
METHOD_CONFIGS: dict[str, Config] = {
    "nearest_neighbor": word_config("nearest_neighbor", "manhattan"),
    "knn": word_config(Spec("knn", {"k": 5}), "manhattan"),
    "centroid": word_config("centroid", "cosine"),
    "absolute_centroid": word_config("absolute_centroid", "cosine"),
    "burrows_delta": PRESETS["burrows-delta"],
    "eders_delta": PRESETS["eders-delta"],
    "markov_chain": word_config("markov_chain"),
    "thin_xent": word_config("thin_xent"),
    "naive_bayes": word_config("naive_bayes"),
    "contrastive": word_config("contrastive"),
    "mahalanobis": word_config("mahalanobis", None, (Spec("most_common", {"n": 60}),)),
    "bagging_nn": word_config(Spec("bagging_nn", {"random_seed": 42}), "cosine"),
    "imposters": word_config(Spec("imposters", {"n_iterations": 10, "random_seed": 42}), "cosine", (Spec("most_common", {"n": 100}),)),
    "random_forest": word_config(Spec("random_forest", {"n_estimators": 20}), None, (Spec("most_common", {"n": 60}),)),
    "decision_tree": word_config("decision_tree", None, (Spec("most_common", {"n": 60}),)),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"entry_cosine_delta": entry_cosine_delta}
    out |= {f"canon_{n}": _canon(n) for n in CANONICIZERS.names()}
    out |= {f"event_{n}": _events(s) for n, s in DRIVER_SPECS.items()}
    out |= {f"culler_{n}": _kept(s) for n, s in CULLER_SPECS.items()}
    out |= {"culler_set": culler_set, "culler_chain": culler_chain}
    out |= {f"distance_{n}": _distance(n) for n in PAIRWISE}
    out |= {"distance_ncd": _changes("ncd"), "distance_ppm": _changes("ppm", (Spec("word_length"),)), "style_change": _changes("cosine")}
    out |= {f"method_{n}": ranked(c) for n, c in METHOD_CONFIGS.items()}
    out |= {
        "method_lda": _vectors("lda"), "method_svm": _vectors("svm", kernel="linear"), "method_mlp": _vectors("mlp", hidden_size=32, max_iter=100),
        "method_logistic_regression": _vectors("logistic_regression"), "method_contrastive_vectors": _vectors("contrastive"),
    }
    out |= {f.__name__: f for f in (
        evaluate_by_author, evaluate_confusion, evaluate_summary, evaluate_thresholds, evaluate_leave_one_out, evaluate_k_fold, evaluate_cross_genre, evaluate_topic_controlled,
        evaluate_verdicts, source_html, source_manifest_summary, source_corpus_counts, source_page, source_segments, streaming_score,
    )}
    return out


__all__ = ["canonical", "corpus", "queries", "settled"]
