"""Evaluation: folds, protocols and metrics, as relations with a fold column.

predictions: (fold, doc_id, true_author, predicted_author, top); scores: (fold, doc_id, rank, author, score).
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.model import METHODS, BadPipeline
from ..plans.pipeline import Pipeline
from . import dense, methods
from .cull import CULLERS
from .store import written


def predictions(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """The first-ranked author of each tested document beside the true one."""
    top = scores.where("rank = 1").select("fold", "doc_id", F.col("author").alias("predicted_author"), F.col("score").alias("top"))
    return top.join(docs.select("doc_id", F.coalesce("author", F.lit("")).alias("true_author")), "doc_id")


def authors_of(p: DataFrame) -> DataFrame:
    return p.select(F.col("true_author").alias("author")).union(p.select("predicted_author")).distinct()


def confusion(p: DataFrame) -> DataFrame:
    """(true_author, predicted_author, n) over all authors seen, zeros too."""
    a = authors_of(p)
    grid = a.select(F.col("author").alias("true_author")).crossJoin(a.select(F.col("author").alias("predicted_author")))
    return grid.join(p.groupBy("true_author", "predicted_author").agg(F.count("*").alias("n")), ["true_author", "predicted_author"], "left").fillna(0, ["n"])


def by_author(p: DataFrame) -> DataFrame:
    """(author, precision, recall, f1, support); nothing over nothing is 0."""
    c = confusion(p)
    t = c.groupBy(F.col("true_author").alias("author")).agg(F.sum("n").alias("support"), F.sum(F.expr("if(true_author = predicted_author, n, 0)")).alias("tp"))
    g = c.groupBy(F.col("predicted_author").alias("author")).agg(F.sum("n").alias("given"))
    precision = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = t.join(g, "author").withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("author", "precision", "recall", "f1", "support")


def accuracy_by_fold(p: DataFrame) -> DataFrame:
    return p.groupBy("fold").agg(F.avg((F.col("true_author") == F.col("predicted_author")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def summary(p: DataFrame) -> DataFrame:
    """One row: n, correct, unanswered, accuracy, c_at_1, f05u, brier (complement). A top score of exactly 0.5 is no answer."""
    right = F.col("true_author") == F.col("predicted_author")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top")))
    one = p.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(right.cast("int")), F.lit(0)).alias("correct"), F.coalesce(F.sum((F.col("top") == 0.5).cast("int")), F.lit(0)).alias("unanswered"),
        (1 - F.avg(F.pow(conf - right.cast("double"), 2))).alias("brier"),
    )
    n, nc, nu = F.col("n"), F.col("correct"), F.col("unanswered")
    one = one.withColumn("accuracy", F.when(n > 0, nc / n).otherwise(0.0)).withColumn("c_at_1", F.when(n > 0, (nc + nu * nc / n) / n))
    answered = n - nu
    precision, recall = nc / answered, nc / n
    f05 = F.when(precision + recall > 0, 1.25 * precision * recall / (0.25 * precision + recall)).otherwise(0.0)
    f05u = F.when(n == 0, None).when(answered == 0, nc / n).when(nu > 0, (answered * f05 + nu * precision) / n).otherwise(f05)
    return one.withColumn("f05u", f05u).select("n", "correct", "unanswered", "accuracy", "c_at_1", "f05u", "brier")


def f05u_by_threshold(p: DataFrame, threshold: str = "threshold") -> DataFrame:
    """One row (f05u): as in ``summary``, but a top score of 0.5 is no answer only in rows that carry a threshold. Null without rows."""
    withheld = F.col(threshold).isNotNull() & (F.col("top") == 0.5)
    one = p.agg(
        F.count("*").alias("n"), F.coalesce(F.sum((F.col("true_author") == F.col("predicted_author")).cast("int")), F.lit(0)).alias("nc"),
        F.coalesce(F.sum(withheld.cast("int")), F.lit(0)).alias("nu"),
    )
    n, nc, nu = F.col("n"), F.col("nc"), F.col("nu")
    precision, recall = F.when(n > nu, nc / (n - nu)), F.when(n > 0, nc / n)
    f05 = F.when(nc > 0, 1.25 * precision * recall / (0.25 * precision + recall)).otherwise(0.0)
    f05u = F.when(n == 0, None).when(n == nu, recall).otherwise(((n - nu) * f05 + nu * precision) / n)
    return one.select(f05u.alias("f05u"))


def macro(p: DataFrame) -> DataFrame:
    """Means of precision, recall and F1 over authors."""
    return by_author(p).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def _target_scores(scores: DataFrame, docs: DataFrame, sign: int) -> DataFrame:
    true = docs.select("doc_id", F.coalesce("author", F.lit("")).alias("true_author"))
    tested = scores.select("doc_id").distinct().join(true, "doc_id")
    wanted = tested.select(F.col("true_author").alias("author")).distinct()
    s = scores.join(true, "doc_id").join(wanted, "author", "left_semi")
    s = s.select("author", "doc_id", (F.col("score") * sign).alias("score"), (F.col("author") == F.col("true_author")).cast("int").alias("pos"))
    w = W.partitionBy("author")
    return s.withColumn("np", F.sum("pos").over(w)).withColumn("nn", F.count("*").over(w) - F.col("np")).where("np > 0 AND nn > 0")


def eer(scores: DataFrame, docs: DataFrame, orient: bool = False, higher: bool = True) -> DataFrame:
    """One row (eer): macro mean of the authors' equal error rates; null with fewer than two authors.

    Scores count as confidence as they are; ``orient`` turns those of distances round first.
    """
    s = _target_scores(scores, docs, -1 if orient and not higher else 1)
    w = W.partitionBy("author").orderBy(F.desc("score"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("fnr", 1 - F.sum("pos").over(w) / F.col("np")).withColumn("fpr", F.sum(1 - F.col("pos")).over(w) / F.col("nn"))
    s = s.withColumn("crossed", (F.col("fpr") >= F.col("fnr")).cast("int")).withColumn("before", F.sum("crossed").over(w) - F.col("crossed"))
    walked = s.where("before = 0")  # up to the first crossing
    at = F.least(
        F.when(F.abs(F.col("fpr") - F.col("fnr")) < 0.5, F.greatest("fpr", "fnr")).otherwise(1.0),
        F.when(F.col("crossed") == 1, (F.col("fpr") + F.col("fnr")) / 2).otherwise(1.0),
    )
    each = walked.groupBy("author").agg(F.min(at).alias("e"))
    enough = scores.select("doc_id").distinct().join(docs, "doc_id").agg((F.countDistinct(F.coalesce("author", F.lit(""))) >= 2).alias("ok"))
    return each.agg(F.avg("e").alias("e")).crossJoin(enough).select(F.when(F.col("ok"), F.col("e")).alias("eer"))


def auroc(scores: DataFrame, docs: DataFrame, higher: bool) -> DataFrame:
    """One row (auroc): macro mean over authors of the area under the curve, by trapezoids over documents in order of score."""
    s = _target_scores(scores, docs, 1 if higher else -1)
    w = W.partitionBy("author").orderBy(F.desc("score"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("tpr", F.sum("pos").over(w) / F.col("np"))  # each negative adds a column as high as the positives before it
    return s.groupBy("author").agg((F.sum((1 - F.col("pos")) * F.col("tpr") / F.col("nn"))).alias("a")).agg(F.avg("a").alias("auroc"))


def mrr(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (mrr): mean of one over the true author's rank, 0 where it is not ranked."""
    true = docs.select("doc_id", F.coalesce("author", F.lit("")).alias("author"))
    tested = scores.select("doc_id").distinct().join(true, "doc_id")
    return tested.join(scores.select("doc_id", "author", "rank"), ["doc_id", "author"], "left").agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def brier_by_distance(scores: DataFrame, docs: DataFrame, higher: bool) -> DataFrame:
    """One row (brier): complement of the Brier score of the top author; distances become 1 - d / largest of the document, 0 where that is 0."""
    w = W.partitionBy("doc_id")
    conf = F.col("score") if higher else F.when(F.max("score").over(w) > 0, 1 - F.col("score") / F.max("score").over(w)).otherwise(0.0)
    s = scores.withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))).where("rank = 1")
    hit = (F.col("author") == F.col("true_author")).cast("double")
    true = docs.select("doc_id", F.coalesce("author", F.lit("")).alias("true_author"))
    return s.join(true, "doc_id").agg((1 - F.avg(F.pow(F.col("conf") - hit, 2))).alias("brier"))


# --- protocols: each gives scores with a fold column ---


def _labelled(docs: DataFrame) -> DataFrame:
    docs = docs.where("author IS NOT NULL")
    n, a = docs.agg(F.count("*"), F.countDistinct("author")).first()
    if n < 2 or a < 2:
        raise BadPipeline("evaluation needs two documents and two authors at least")
    return docs


def folds_for(ids: Iterable, k: int, shuffle: bool = True, seed: int = 42) -> dict:
    """fold by id: the ids in order, shuffled by the seeded generator, cut into k nearly equal runs."""
    ids = list(ids)
    if k < 2:
        raise BadPipeline("at least two folds")
    k = min(k, len(ids))
    if shuffle:
        random.Random(seed).shuffle(ids)
    return {x: i for i in range(k) for x in ids[i * len(ids) // k : (i + 1) * len(ids) // k]}


def by_folds(config, docs: DataFrame, folds: dict) -> DataFrame:
    """Scores of each fold's documents when all others are known. Folds whose training documents have fewer than two authors are skipped."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _by_fold(config, docs.join(F.broadcast(spark.createDataFrame(list(folds.items()), f"doc_id {kind}, fold int")), "doc_id"), sorted(set(folds.values())))


def _by_fold(config, placed: DataFrame, folds: Iterable[int]) -> DataFrame:
    out = None
    for f in folds:
        train = placed.where(F.col("fold") != f)
        if train.agg(F.countDistinct("author")).first()[0] < 2:
            continue
        s = Pipeline(config).run(placed.withColumn("known", F.col("fold") != f)).withColumn("fold", F.lit(f))
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise BadPipeline("no fold leaves two authors to choose from")
    return out


def k_fold(config, docs: DataFrame, k: int = 10, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Runs of ids in order are told by their first ids alone, so no table of ids is sent out; shuffled folds need one."""
    docs = _labelled(docs)
    if not shuffle and docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and k >= 2:
        column = docs.select("doc_id").toArrow().column("doc_id")
        ids = np.sort(column.to_numpy()) if not column.null_count else np.zeros(0)
        if len(ids) and (np.diff(ids) > 0).all():
            k = min(k, len(ids))
            later = [(F.col("doc_id") >= F.lit(int(ids[i * len(ids) // k]))).cast("int") for i in range(1, k)]
            return _by_fold(config, docs.withColumn("fold", sum(later, F.lit(0))), range(k))
    return by_folds(config, docs, folds_for([r[0] for r in docs.select("doc_id").orderBy("doc_id").collect()], k, shuffle, seed))


def leave_one_out(config, docs: DataFrame) -> DataFrame:
    """Every document against all others.

    For neighbour methods without cullers that look at the known documents, all folds are one pair join with u <> k, and features
    are made once, as blocks of documents. Other configurations run fold by fold.
    """
    docs = _labelled(docs)
    shared = config.method.name in ("nearest_neighbor", "knn") and all("per_document" in CULLERS.get(s.name).traits for s in config.event_cullers)
    if not shared:
        ids = [r[0] for r in docs.select("doc_id").orderBy("doc_id").collect()]
        return by_folds(config, docs, {x: i for i, x in enumerate(ids)})
    p = Pipeline(config)
    c = p.prepare(docs.withColumn("known", F.lit(True)))
    # an author's only document leaves the others; two authors must remain
    sizes = c.authors
    many = sizes.count()
    c = methods.Corpus(c.docs, hist=c.hist, distance=c.distance, rows=c.rows, listed=c.listed)
    c.__dict__["unknown"] = c.known.select(F.col("k").alias("u"))
    c.__dict__["unknown_hist"] = c.known_hist.select(F.col("k").alias("u"), "event", "cnt")
    params = METHODS.get(config.method.name)
    if config.method.name == "knn":
        k = {q.name: q for q in params.params}["k"]
        k = k.parse(config.method.params.get("k", k.default))
        scores = methods.votes(c.nearest("nearest", k, apart=True), k)
    else:
        scores = c.nearest("authors", apart=True)
    if many == 2:
        alone = c.known.join(sizes.where("n_docs = 1"), "author").select(F.col("k").alias("u"))
        scores = scores.join(alone, "u", "left_anti")
    return methods.rank(scores, p.higher_is_better).select(F.col("u").alias("fold"), F.col("u").alias("doc_id"), "rank", "author", "score")


def cross_genre(config, docs: DataFrame, train: str, test: str) -> DataFrame:
    """Train on one genre, test on another, both cut down to the authors they share. docs has a column genre."""
    a, b = docs.where(F.col("genre") == train), docs.where(F.col("genre") == test)
    both = a.select("author").where("author IS NOT NULL").intersect(b.select("author"))
    if both.limit(2).count() < 2:
        raise BadPipeline("the genres share fewer than two authors")
    some = a.withColumn("known", F.lit(True)).unionByName(b.withColumn("known", F.lit(False))).join(both, "author", "left_semi")
    return Pipeline(config).run(some).withColumn("fold", F.lit(0))


def topic_controlled(config, docs: DataFrame) -> DataFrame:
    """Scores with a column protocol: within (leave one out in each topic), across (each topic against the others), overall. docs has a column topic."""
    docs = _labelled(docs)
    if (once := _topics_at_once(config, docs)) is not None:
        return once
    out = leave_one_out(config, docs).withColumn("protocol", F.lit("overall")).withColumn("fold", F.col("fold").cast("string"))
    topics = [r[0] for r in docs.select("topic").distinct().where("topic IS NOT NULL").orderBy("topic").collect()]
    for t in topics:
        here = docs.where(F.col("topic") == t)
        n, a = here.agg(F.count("*"), F.countDistinct("author")).first()
        if n >= 2 and a >= 2:
            s = leave_one_out(config, here).withColumn("protocol", F.lit("within"))
            out = out.unionByName(s.withColumn("fold", F.concat(F.lit(f"{t}:"), F.col("fold").cast("string"))))
        train = docs.where(F.col("topic") != t)
        if train.agg(F.countDistinct("author")).first()[0] >= 2:
            s = Pipeline(config).run(docs.where("topic IS NOT NULL").withColumn("known", F.col("topic") != t)).withColumn("fold", F.lit(str(t))).withColumn("protocol", F.lit("across"))
            out = out.unionByName(s)
    return out


def _topics_at_once(config, docs: DataFrame) -> DataFrame | None:
    """All three protocols from one comparison of all documents: the nearest of each author and topic. For nearest neighbours without cullers that look at the known documents."""
    if config.method.name != "nearest_neighbor" or not all("per_document" in CULLERS.get(s.name).traits for s in config.event_cullers):
        return None
    c = Pipeline(config).prepare(docs.withColumn("known", F.lit(True)))
    how = dense.kernel(c.distance)
    if c.rows is None or not how:
        return None
    rows = written(c.rows.select("doc_id", "author", "e", "n").join(docs.select("doc_id", F.col("topic").cast("string").alias("topic")), "doc_id"))
    left, right = rows.select(F.col("doc_id").alias("u"), "e", "n"), rows.select(F.col("doc_id").alias("k"), "author", "topic", "e", "n")
    near = written(dense.nearest(left, right, how, len(c.listed), apart=True, more=("topic",)))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("topic", "author").count().collect()}
    topics = sorted({t for t, _ in sizes if t is not None})

    def authors(keep) -> dict[str, int]:
        out: dict[str, int] = {}
        for (t, a), n in sizes.items():
            if keep(t):
                out[a] = out.get(a, 0) + n
        return out

    def alone(of: dict[str, int]) -> list[str]:  # of two authors one whose only document is tested leaves no choice
        return [a for a, n in of.items() if n == 1] if len(of) == 2 else []

    s = near.join(rows.select(F.col("doc_id").alias("u"), F.col("topic").alias("own"), F.col("author").alias("true")), "u")
    ranked = lambda x: methods.rank(x.groupBy("u", "author").agg(F.min("score").alias("score")), False)
    own = rows.select(F.col("doc_id").alias("u"), F.col("topic").alias("own"))
    overall = ranked(s.where(~F.col("true").isin(alone(authors(lambda t: True)))))
    out = overall.withColumn("fold", F.col("u").cast("string")).withColumn("protocol", F.lit("overall"))
    for t in topics:
        here = authors(lambda x: x == t)
        if len(here) >= 2:
            w = ranked(s.where((F.col("own") == t) & (F.col("topic") == t) & ~F.col("true").isin(alone(here))))
            out = out.unionByName(w.withColumn("fold", F.concat(F.lit(f"{t}:"), F.col("u").cast("string"))).withColumn("protocol", F.lit("within")))
    across = [t for t in topics if len(authors(lambda x: x is not None and x != t)) >= 2]
    a = ranked(s.where(F.col("own").isin(across) & (F.col("topic") != F.col("own")))).join(own, "u").withColumnRenamed("own", "fold")
    out = out.unionByName(a.withColumn("protocol", F.lit("across")))
    return out.select("fold", F.col("u").alias("doc_id"), "rank", "author", "score", "protocol")
