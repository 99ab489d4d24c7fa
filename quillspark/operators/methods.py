"""Attribution methods: from the histograms (or vectors) of known and unknown documents to authors ranked for each unknown one.

A method is a function of a ``Corpus`` that returns (u, author, score); ``rank`` orders them, ties by author. Missing authors are
the empty string. What has to be whole in one place (matrices for classifiers) is bounded by the culled vocabulary, which
``Corpus.vocabulary`` checks.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.counting import flat
from ..plans.model import METHODS, BadParameter, BadPipeline, Param
from . import dense, solvers
from .blocks import blocked
from .distance import Aligned, Pair, distances

MAX_VOCABULARY = 20_000
MAX_LISTED = 8192  # events up to which documents are rows over a vocabulary


def listed(kept: DataFrame, most: int) -> list[str] | None:
    """The events in order, if there are no more than that."""
    got = [r[0] for r in kept.distinct().limit(most + 1).collect()]
    return sorted(got) if len(got) <= most else None


@dataclass
class Corpus:
    """hist: (doc_id, event, cnt) of all documents, or vectors: (doc_id, features); docs: (doc_id, author, known).

    rows, where there are any, are the same histograms as one row a document: (doc_id, author, known, e, n), places in ``listed`` and counts; ids do not repeat.
    """

    docs: DataFrame
    hist: DataFrame | None = None
    vectors: DataFrame | None = None
    distance: Pair | Aligned | None = None
    rows: DataFrame | None = None
    listed: list[str] | None = None

    def __post_init__(self):
        if self.rows is not None and "text" not in self.docs.columns:
            self.docs = self.rows.select("doc_id", "author", "known")

    @cached_property
    def known(self) -> DataFrame:
        return self.docs.where("known").select(F.col("doc_id").alias("k"), F.coalesce("author", F.lit("")).alias("author"))

    @cached_property
    def unknown(self) -> DataFrame:
        return self.docs.where("NOT known").select(F.col("doc_id").alias("u"))

    @cached_property
    def known_hist(self) -> DataFrame:
        if self.rows is not None:
            own = self.rows.where("known").select(F.col("doc_id").alias("k"), F.coalesce("author", F.lit("")).alias("author"), "e", "n")
            return flat(own, self.listed, ["k", "author"])
        return self.hist.withColumnRenamed("doc_id", "k").join(self.known, "k").select("k", "author", "event", "cnt")

    @cached_property
    def unknown_hist(self) -> DataFrame:
        if self.rows is not None:
            return flat(self.rows.where("NOT known").withColumnRenamed("doc_id", "u"), self.listed, ["u"])
        return self.hist.withColumnRenamed("doc_id", "u").join(self.unknown, "u", "left_semi").select("u", "event", "cnt")

    @cached_property
    def authors(self) -> DataFrame:
        return self.known.groupBy("author").agg(F.count("*").alias("n_docs"))

    @cached_property
    def grid(self) -> DataFrame:
        return self.unknown.crossJoin(F.broadcast(self.authors.select("author")))

    def vocabulary(self) -> list[str]:
        got = [r[0] for r in self.known_hist.select("event").distinct().orderBy("event").limit(MAX_VOCABULARY + 1).collect()]
        if len(got) > MAX_VOCABULARY:
            raise BadPipeline(f"this method needs at most {MAX_VOCABULARY} distinct events; add a culler")
        return got

    def dense(self, counts: bool = False) -> tuple[DataFrame, DataFrame]:
        """(k, author, x) and (u, x): arrays over the known events (relative frequencies, or counts), or the vectors as they are."""
        if self.vectors is not None:
            v = self.vectors.select("doc_id", F.col("features").alias("x"))
            return self.known.join(v.withColumnRenamed("doc_id", "k"), "k"), self.unknown.join(v.withColumnRenamed("doc_id", "u"), "u")
        vocab = self.vocabulary()
        if self.rows is not None:
            place = {e: i for i, e in enumerate(vocab)}
            full = dense.filled(self.rows, np.array([place.get(e, -1) for e in self.listed], np.int64), len(vocab), counts)
            known = full.where("known").select(F.col("doc_id").alias("k"), F.coalesce("author", F.lit("")).alias("author"), "x")
            return known, full.where("NOT known").select(F.col("doc_id").alias("u"), "x")

        @F.pandas_udf("array<double>")
        def fill(m: pd.Series) -> pd.Series:
            place = {e: i for i, e in enumerate(vocab)}
            out = []
            for h in m:
                x, h = np.zeros(len(vocab)), dict(h or {})
                total = 1 if counts else sum(h.values()) or 1
                for e, c in h.items():
                    if e in place:
                        x[place[e]] = c / total
                out.append(x.tolist())
            return pd.Series(out, dtype=object)

        m = self.hist.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("event", "cnt"))).alias("m"))
        full = self.docs.select("doc_id").join(m, "doc_id", "left").select("doc_id", fill("m").alias("x"))
        return self.known.join(full.withColumnRenamed("doc_id", "k"), "k"), self.unknown.join(full.withColumnRenamed("doc_id", "u"), "u")

    def pairs(self, right: DataFrame, ids: DataFrame) -> DataFrame:
        """(u, k, dist) of all unknown documents and some histograms, such as the authors' profiles."""
        if self.distance is None:
            raise BadPipeline("this method needs a distance")
        if self.rows is not None:
            got = dense.profiled(self.rows.where("NOT known").withColumnRenamed("doc_id", "u"), right, ids, self.distance, self.listed)
            if got is not None:
                return got
        return distances(self.unknown_hist, right, self.unknown, ids, self.distance)

    def sides(self, *more: str) -> tuple[DataFrame, DataFrame]:
        """The rows of the unknown documents (u, more.., e, n) and of the known ones (k, author, more.., e, n)."""
        r = self.rows
        return r.where("NOT known").select(F.col("doc_id").alias("u"), *more, "e", "n"), r.where("known").select(F.col("doc_id").alias("k"), F.coalesce("author", F.lit("")).alias("author"), *more, "e", "n")

    def nearest(self, keep: str, k: int = 0, apart: bool = False) -> DataFrame:
        """All unknown documents by all known ones, in blocks: each author's nearest (u, author, score) or the k nearest (u, k, author, dist)."""
        if self.distance is None:
            raise BadPipeline("this method needs a distance")
        if self.rows is not None and (how := dense.kernel(self.distance)):
            left, right = self.sides()
            return dense.nearest(right.withColumnRenamed("k", "u") if apart else left, right, how, len(self.listed), keep, k, apart)
        got = blocked(self.unknown_hist, self.known_hist.select("k", "event", "cnt"), self.unknown, self.known, self.distance, keep, k, apart)
        return got.groupBy("u", "author").agg(F.min("score").alias("score")) if keep == "authors" else got


Method = Callable[[Corpus], DataFrame]


def rank(scores: DataFrame, higher: bool) -> DataFrame:
    """(u, rank, author, score), best first, ties by author."""
    order = F.col("score").desc() if higher else F.col("score").asc()
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(order, "author"))).select("u", "rank", "author", "score")


@METHODS.register("nearest_neighbor", traits=("distance",))
def nearest_neighbor() -> Method:
    """Each author's nearest document."""
    return lambda c: c.nearest("authors")


def votes(pairs: DataFrame, k: int) -> DataFrame:
    """(u, author, score): shares of the k nearest, ties (to ten digits) by id; pairs (u, k, author, dist)."""
    near = pairs.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.round("dist", 10), "k"))).where(F.col("r") <= k)
    return near.groupBy("u", "author").agg(F.count("*").alias("v")).withColumn("score", F.col("v") / F.sum("v").over(W.partitionBy("u"))).drop("v")


@METHODS.register("knn", Param("k", 5, 1), traits=("distance", "higher"))
def knn(k: int) -> Method:
    """Votes of the k nearest documents; only authors with votes."""
    return lambda c: votes(c.nearest("nearest", k), k)


@METHODS.register("centroid", traits=("distance",))
def centroid() -> Method:
    """Distance to each author's summed counts."""
    def run(c: Corpus) -> DataFrame:
        profile = c.known_hist.groupBy(F.col("author").alias("k"), "event").agg(F.sum("cnt").alias("cnt"))
        return c.pairs(profile, c.authors.select(F.col("author").alias("k"))).select("u", F.col("k").alias("author"), F.col("dist").alias("score"))

    return run


@METHODS.register("absolute_centroid", traits=("distance",))
def absolute_centroid() -> Method:
    """Distance to each author's mean counts, rounded to even."""
    def run(c: Corpus) -> DataFrame:
        mean = F.bround(F.sum("cnt") / F.first("n_docs")).cast("long").alias("cnt")
        profile = c.known_hist.join(F.broadcast(c.authors), "author").groupBy(F.col("author").alias("k"), "event").agg(mean)
        return c.pairs(profile, c.authors.select(F.col("author").alias("k"))).select("u", F.col("k").alias("author"), F.col("dist").alias("score"))

    return run


def _relative(hist: DataFrame, key: str) -> DataFrame:
    total = hist.groupBy(key).agg(F.sum("cnt").cast("double").alias("t"))
    return hist.join(total, key).withColumn("f", F.col("cnt") / F.col("t")).drop("t")


@METHODS.register("burrows_delta", Param("n_features", 100, 1))
def burrows_delta(n_features: int) -> Method:
    """Burrows' Delta: mean absolute difference of z-scores to each author's mean."""
    def run(c: Corpus) -> DataFrame:
        f, n = _relative(c.known_hist, "k"), c.known.agg(F.count("*").cast("double").alias("n"))
        s = f.groupBy("event").agg(F.sum("f").alias("s"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.count("*").alias("df"))
        s = s.orderBy(F.round("s", 12).desc(), "event").limit(n_features).crossJoin(F.broadcast(n))
        s = s.where(~((F.col("lo") == F.col("hi")) & (F.col("df") == F.col("n")))).select("event", "n", "df", (F.col("s") / F.col("n")).alias("mean"))
        dev = f.join(F.broadcast(s), "event").groupBy("event", "n", "df", "mean").agg(F.sum(F.pow(F.col("f") - F.col("mean"), 2)).alias("q"))
        features = dev.select("event", F.sqrt((F.col("q") + (F.col("n") - F.col("df")) * F.col("mean") * F.col("mean")) / F.col("n")).alias("sd"))
        mean = f.join(F.broadcast(features), "event", "left_semi").groupBy("author", "event").agg(F.sum("f").alias("s"))
        profile = c.authors.crossJoin(F.broadcast(features)).join(mean, ["author", "event"], "left").select("author", "event", "sd", (F.coalesce("s", F.lit(0.0)) / F.col("n_docs")).alias("a"))
        own = c.unknown.crossJoin(F.broadcast(features.select("event"))).join(_relative(c.unknown_hist, "u").select("u", "event", "f"), ["u", "event"], "left").fillna(0.0, ["f"])
        return own.join(F.broadcast(profile), "event").groupBy("u", "author").agg(F.avg(F.abs(F.col("f") - F.col("a")) / F.col("sd")).alias("score"))

    return run


@METHODS.register("eders_delta", Param("top_n", 100, 0, 10000))
def eders_delta(top_n: int) -> Method:
    """Eder's Delta: z-scores of square roots of frequencies over the commonest events of the known documents and the unknown one."""
    def run(c: Corpus) -> DataFrame:
        total = c.known_hist.groupBy("event").agg(F.sum("cnt").alias("known_total"))
        own = _relative(c.unknown_hist, "u").select("u", "event", "cnt", F.sqrt("f").alias("f"))
        if top_n:  # an event outside the commonest of the known ones counts only where the document itself has it
            common = total.orderBy(F.desc("known_total"), "event").limit(top_n)
        else:
            common = total
        cand = c.unknown.crossJoin(F.broadcast(common)).select("u", "event").union(own.select("u", "event")).distinct()
        cand = cand.join(own, ["u", "event"], "left").join(total, "event", "left").fillna(0, ["cnt", "known_total", "f"])
        if top_n:
            order = W.partitionBy("u").orderBy((F.col("cnt") + F.col("known_total")).desc(), "event")
            cand = cand.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_n)
        cand = cand.select("u", "event", "f").withColumn("nf", F.count("*").over(W.partitionBy("u")))
        n = c.known.agg(F.count("*").cast("double").alias("n"))
        r = _relative(c.known_hist, "k").withColumn("f", F.sqrt("f")).select("author", "event", "f")
        used = r.join(cand.select("event").distinct(), "event", "left_semi")
        mean = used.groupBy("event").agg(F.sum("f").alias("s"), F.count("*").alias("df"), F.min("f").alias("lo"), F.max("f").alias("hi")).crossJoin(F.broadcast(n)).withColumn("mean", F.col("s") / F.col("n"))
        dev = used.join(mean, "event").groupBy("event", "n", "df", "mean", "lo", "hi").agg(F.sum(F.pow(F.col("f") - F.col("mean"), 2)).alias("q"))
        var = (F.col("q") + (F.col("n") - F.col("df")) * F.col("mean") * F.col("mean")) / F.greatest(F.col("n") - 1, F.lit(1.0))
        sd = F.when((F.col("lo") == F.col("hi")) & (F.col("df") == F.col("n")), 0.0).otherwise(F.sqrt(var))
        stats = dev.select("event", sd.alias("sd"))
        profile = used.groupBy("author", "event").agg(F.sum("f").alias("s")).join(F.broadcast(c.authors), "author").select("author", "event", (F.col("s") / F.col("n_docs")).alias("a"))
        z = cand.join(stats, "event", "left").where("sd > 0")
        grid = z.crossJoin(F.broadcast(c.authors.select("author"))).join(profile, ["author", "event"], "left").fillna(0.0, ["a"])
        sums = grid.groupBy("u", "author", "nf").agg(F.sum(F.abs(F.col("f") - F.col("a")) / F.col("sd")).alias("s"))
        sizes = cand.select("u", "nf").distinct().crossJoin(F.broadcast(c.authors.select("author")))
        return sizes.join(sums.drop("nf"), ["u", "author"], "left").select("u", "author", (F.coalesce("s", F.lit(0.0)) / F.col("nf")).alias("score"))

    return run


def _scores(unknown: DataFrame, authors: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(u, author, score) by a function from a matrix of vectors to scores by author."""
    @F.pandas_udf("array<double>")
    def udf(x: pd.Series) -> pd.Series:
        return pd.Series(fn(np.array(x.tolist(), float)).tolist() if len(x) else [], dtype=object)

    scored = unknown.select("u", udf("x").alias("s"))
    return scored.select("u", F.posexplode("s").alias("i", "score")).select("u", F.element_at(F.array(*[F.lit(a) for a in authors]), F.col("i") + 1).alias("author"), "score")


def _matrix(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The known documents' vectors in order of their ids, and their authors; eight bytes a number."""
    t = known.select("k", "author", "x").toArrow()
    if not t.num_rows:
        raise BadPipeline("no known documents")
    t = t.sort_by("k")
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("x").chunks])
    return x.reshape(t.num_rows, -1).astype(float, copy=False), t.column("author").to_numpy().astype(str)


@METHODS.register("mahalanobis")
def mahalanobis() -> Method:
    """Mahalanobis distance to each author's mean under the known documents' covariance (pseudo-inverse where singular).

    Events that no known document has carry no covariance and do not count.
    """
    def run(c: Corpus) -> DataFrame:
        known, unknown = c.dense()
        names, n, total = dense.sums(known)  # means, then products round the mean: no vector leaves the cluster
        if not names:
            raise BadPipeline("no known documents")
        mean = total / n[:, None]
        _, _, products = dense.sums(known, total.sum(axis=0) / n.sum())
        width = total.shape[1]
        inverse = np.linalg.pinv(products.reshape(width, width) / max(n.sum() - 1, 1), hermitian=True, rcond=1e-12)

        def fn(v: np.ndarray) -> np.ndarray:
            d = v[:, None, :] - mean[None]
            return np.sqrt(np.maximum(np.einsum("uaf,fg,uag->ua", d, inverse, d, optimize=True), 0))

        return _scores(unknown, names, fn)

    return run


@METHODS.register("markov_chain", traits=("higher",))
def markov_chain() -> Method:
    """Log-likelihood under each author's add-one smoothed event frequencies."""
    def run(c: Corpus) -> DataFrame:
        size = c.known_hist.agg(F.countDistinct("event").alias("v"))
        by = c.known_hist.groupBy("author", "event").agg(F.sum("cnt").alias("a"))
        total = by.groupBy("author").agg(F.sum("a").alias("t"))
        total = c.authors.select("author").join(total, "author", "left").fillna(0, ["t"]).crossJoin(F.broadcast(size))
        grid = c.unknown_hist.crossJoin(F.broadcast(total)).join(by, ["author", "event"], "left")
        ll = F.col("cnt") * F.ln((F.coalesce("a", F.lit(0)) + 1) / (F.col("t") + F.col("v")))
        got = grid.groupBy("u", "author").agg(F.sum(ll).alias("score"))
        return c.grid.join(got, ["u", "author"], "left").fillna(0.0, ["score"])

    return run


@METHODS.register("thin_xent", Param("window", 15, 1))
def thin_xent(window: int) -> Method:
    """Cross-entropy of successive events, documents read as their sorted events, under each author's add-one smoothed transitions.

    In a sorted document event e is followed by itself (count - 1) times and once by the next event, so transitions
    come from histograms; an author's documents follow each other by id. ``window`` has no effect.
    """
    def transitions(hist: DataFrame, key: str, order: list[str]) -> DataFrame:
        nxt = F.lead("event").over(W.partitionBy(key).orderBy(*order))
        steps = hist.withColumn("to", nxt)
        same = steps.where("cnt > 1").select(key, F.col("event").alias("from"), F.col("event").alias("to"), (F.col("cnt") - 1).alias("n"))
        return same.unionByName(steps.where("to IS NOT NULL").select(key, F.col("event").alias("from"), "to", F.lit(1).cast("long").alias("n"))).groupBy(key, "from", "to").agg(F.sum("n").alias("n"))

    def run(c: Corpus) -> DataFrame:
        v = c.known_hist.agg(F.countDistinct("event").alias("v"))
        vocab = c.known_hist.select(F.col("event").alias("to")).distinct().withColumn("listed", F.lit(True))
        model = transitions(c.known_hist, "author", ["k", "event"])
        out = model.groupBy("author", "from").agg(F.sum("n").alias("total"))
        own = transitions(c.unknown_hist, "u", ["event"]).withColumnRenamed("n", "m")
        grid = own.join(vocab, "to", "left").crossJoin(F.broadcast(c.authors.select("author"))).crossJoin(F.broadcast(v))
        grid = grid.join(out, ["author", "from"], "left").join(model, ["author", "from", "to"], "left")
        seen = F.col("total").isNotNull() & F.col("listed").isNotNull()
        p = F.when(seen, (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("v"))).otherwise(1 / (F.col("v") + 1))
        got = grid.groupBy("u", "author").agg((-F.sum(F.col("m") * F.log2(p)) / F.sum("m")).alias("score"))
        return c.grid.join(got, ["u", "author"], "left").fillna(0.0, ["score"])

    return run


@METHODS.register("bagging_nn", Param("n_samples", 5, 1), Param("sample_size", 500, 1), Param("random_seed", 0), traits=("distance", "higher"))
def bagging_nn(n_samples: int, sample_size: int, random_seed: int) -> Method:
    """Votes of the n_samples nearest bootstrap samples of the authors' events; all authors are listed.

    Draws are numbers from a hash of seed, author, sample and draw, looked up in the running totals of the author's events where they lie.
    """
    def run(c: Corpus) -> DataFrame:
        seed = random_seed or random.randrange(1, 1 << 31)
        total = c.known_hist.groupBy("author", "event").agg(F.sum("cnt").alias("n"))
        upto = F.sum("n").over(W.partitionBy("author").orderBy("event"))
        pool = total.select("author", "event", (upto - F.col("n")).alias("at"), F.lit(None).cast("string").alias("k"), F.lit(0).alias("drawn"))
        mass = total.groupBy("author").agg(F.sum("n").alias("mass"))
        draws = mass.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(sample_size - 1))))
        draws = draws.select("author", F.lit(None).cast("string").alias("event"), (number(seed, "author", "s", "t") % F.col("mass")).alias("at"), F.concat_ws("\t", "s", "author").alias("k"), F.lit(1).alias("drawn"))
        found = F.last("event", ignorenulls=True).over(W.partitionBy("author").orderBy("at", "drawn"))
        samples = pool.unionByName(draws).withColumn("event", found).where("drawn = 1").groupBy("k", "event").agg(F.count("*").alias("cnt"))
        owner = mass.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).select(F.concat_ws("\t", "s", "author").alias("k"), "author")
        got = votes(c.pairs(samples, owner.select("k")).join(owner, "k"), n_samples)
        return c.grid.join(got, ["u", "author"], "left").fillna(0.0, ["score"])

    return run


def digest(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def number(seed: int, *cols: str) -> Column:
    """A number below 2**60 that looks random, by seed and columns."""
    return F.conv(F.substring(digest(seed, *cols), 1, 15), 16, 10).cast("long")


CALIBRATION = (Param("calibration_low", 0.0, 0, 1), Param("calibration_high", 0.0, 0, 1))


def calibrated(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Scores within the band become 0.5, which means no answer."""
    if low <= 0 and high <= 0:
        return scores
    return scores.withColumn("score", F.when(F.col("score").between(low, high), 0.5).otherwise(F.col("score")))


def _contested(c: Corpus, features: DataFrame, imposters: DataFrame, n_iterations: int) -> DataFrame:
    """(u, author, score) of the General Imposters by cosine: each candidate's documents in blocks of matrices, the few imposters sent to the unknown documents."""
    left, right = c.sides()
    width, place = len(c.listed), {e: i for i, e in enumerate(c.listed)}
    chosen: dict[str, list[list[int]]] = {}
    for cand, i, event in features.collect():
        chosen.setdefault(cand, [[] for _ in range(n_iterations)])[i].append(place[event])
    against = {cand: [[] for _ in range(n_iterations)] for cand in chosen}
    for cand, i, e, n in imposters.join(right.select("k", "e", "n"), "k").select("cand", "iter", "e", "n").collect():
        x = np.zeros(width)
        x[e] = n
        against[cand][i].append(x)
    if not chosen:
        return c.unknown.select("u", F.lit("").alias("author"), F.lit(0.0).alias("score")).limit(0)
    got = dense.contests(left, right, {k: [np.array(sorted(f), np.int64) for f in v] for k, v in chosen.items()}, {k: [np.array(x) for x in v] for k, v in against.items()}, width)
    nearer = [(F.round(1 - F.least(f"a{i}", F.lit(1.0)), 10) < F.round(1 - F.least(f"b{i}", F.lit(1.0)), 10)).cast("int") for i in range(n_iterations)]
    return got.select("u", F.col("cand").alias("author"), (sum(nearer, F.lit(0)) / F.lit(float(n_iterations))).alias("score"))


@METHODS.register(
    "imposters", Param("n_iterations", 100, 1), Param("feature_subset_ratio", 0.5, 0, 1), Param("n_imposters", 10, 1), Param("random_seed", 0), *CALIBRATION,
    traits=("distance", "higher", "verification"),
)
def imposters(n_iterations: int, feature_subset_ratio: float, n_imposters: int, random_seed: int, calibration_low: float, calibration_high: float) -> Method:
    """General Imposters: how often a candidate is nearer than sampled imposters (to ten digits), on sampled features.

    Draws are hashes of seed, candidate, iteration and what is drawn, so they are made where the data is and do not depend on the unknown document.
    Imposters are drawn by their position in the order of (author, id), with repetition.
    """
    def run(c: Corpus) -> DataFrame:
        seed = random_seed or random.randrange(1, 1 << 31)
        vocab = c.known_hist.select("event").distinct()
        size = vocab.count()
        take = min(max(1, int(size * feature_subset_ratio)), size)
        upto = F.sum("n_docs").over(W.orderBy("author"))  # one row an author
        authors = c.authors.select("author", "n_docs", (upto - F.col("n_docs")).alias("first"), F.sum("n_docs").over(W.partitionBy()).alias("all"))
        rounds = authors.where("n_docs < all").withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iterations - 1)))).withColumnRenamed("author", "cand")
        drawn = rounds.select("cand", "iter").crossJoin(vocab)
        drawn = drawn.withColumn("r", F.row_number().over(W.partitionBy("cand", "iter").orderBy(digest(seed, "cand", "iter", "event"), "event")))
        features = drawn.where(F.col("r") <= take).select("cand", "iter", "event")
        others = F.col("all") - F.col("n_docs")
        draws = rounds.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n_imposters), others) - 1)))
        draws = draws.withColumn("at", number(seed, "cand", "iter", "t") % others)
        draws = draws.select("cand", "iter", F.when(F.col("at") < F.col("first"), F.col("at")).otherwise(F.col("at") + F.col("n_docs")).alias("at")).distinct()
        placed = c.known.join(authors.select("author", "first"), "author").select("k", (F.row_number().over(W.partitionBy("author").orderBy("k")) - 1 + F.col("first")).alias("at"))
        own = rounds.select("cand", "iter").join(c.known.withColumnRenamed("author", "cand"), "cand").select("cand", "iter", "k", F.lit(True).alias("own"))
        who = own.unionByName(draws.join(placed, "at").select("cand", "iter", "k", F.lit(False).alias("own")))
        by = ["cand", "iter"]
        alone = authors.where("n_docs = all").select("author")
        if c.rows is not None and dense.kernel(c.distance) == "dot" and size * n_iterations * c.authors.count() <= 1 << 22:
            score = _contested(c, features, draws.join(placed, "at").select("cand", "iter", "k"), n_iterations)
            score = score.unionByName(c.unknown.crossJoin(F.broadcast(alone)).withColumn("score", F.lit(1.0)))
            return calibrated(score, calibration_low, calibration_high)
        left = c.unknown_hist.join(features, "event").select(*by, "u", "event", "cnt")
        right = c.known_hist.select("k", "event", "cnt").join(who, "k").join(features, [*by, "event"]).select(*by, "k", "event", "cnt")
        pairs = distances(left, right, c.unknown.crossJoin(F.broadcast(rounds.select(*by))), who.select(*by, "k"), c.distance, by)
        best = pairs.join(who, [*by, "k"]).groupBy(*by, "u").agg(F.min(F.when(F.col("own"), F.col("dist"))).alias("a"), F.min(F.when(~F.col("own"), F.col("dist"))).alias("b"))
        nearer = (F.round("a", 10) < F.round("b", 10)).cast("int")
        score = best.groupBy("u", F.col("cand").alias("author")).agg((F.sum(nearer) / F.lit(float(n_iterations))).alias("score"))
        score = score.unionByName(c.unknown.crossJoin(F.broadcast(alone)).withColumn("score", F.lit(1.0)))
        return calibrated(score, calibration_low, calibration_high)

    return run


@METHODS.register(
    "unmasking", Param("n_features", 250, 1), Param("n_eliminate", 6, 1), Param("n_iterations", 10, 1), Param("n_folds", 10, 2, 50), Param("random_seed", 0), *CALIBRATION,
    traits=("higher", "verification"),
)
def unmasking(n_features: int, n_eliminate: int, n_iterations: int, n_folds: int, random_seed: int, calibration_low: float, calibration_high: float) -> Method:
    """Unmasking: how much a linear classifier of candidate and unknown against the rest loses as its strongest features go."""
    def run(c: Corpus) -> DataFrame:
        top = c.known_hist.groupBy("event").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "event").limit(n_features)
        total = c.hist.groupBy("doc_id").agg(F.sum("cnt").alias("t"))
        cut = c.hist.join(F.broadcast(top.select("event")), "event").join(total, "doc_id").withColumn("f", F.col("cnt") / F.col("t"))
        events = sorted(r[0] for r in top.collect())
        m = cut.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("event", "f"))).alias("m"))
        values = F.transform(F.array(*[F.lit(e) for e in events]) if events else F.array().cast("array<string>"), lambda e: F.coalesce(F.element_at("m", e), F.lit(0.0)))
        full = c.docs.select("doc_id").join(m, "doc_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,double>"))).select("doc_id", values.alias("x"))
        x, y = _matrix(c.known.join(full.withColumnRenamed("doc_id", "k"), "k"))
        names = sorted(set(y))

        def fn(v: np.ndarray) -> np.ndarray:
            out = np.zeros((len(v), len(names)))
            for i, one in enumerate(v):
                for j, a in enumerate(names):
                    out[i, j] = solvers.unmask(np.vstack([x, one]), np.append((y == a).astype(int), 1), n_eliminate, n_iterations, n_folds)
            return out

        scored = _scores(c.unknown.join(full.withColumnRenamed("doc_id", "u"), "u").repartition("u"), names, fn)
        return calibrated(scored, calibration_low, calibration_high)

    return run


@METHODS.register("contrastive", Param("projection_dim", 0, 0), Param("n_epochs", 50, 0), Param("learning_rate", 0.01, 0), Param("random_seed", 0), traits=("higher", "numeric"))
def contrastive(projection_dim: int, n_epochs: int, learning_rate: float, random_seed: int) -> Method:
    """Cosine to each author's mean vector, after a learned linear projection if one is asked for."""
    def run(c: Corpus) -> DataFrame:
        known, unknown = c.dense()
        if not projection_dim:  # the means are all that leaves the cluster
            names, n, total = dense.sums(known)
            centre, w = total / n[:, None], None
        else:
            x, y = _matrix(known)
            if projection_dim > x.shape[1]:
                raise BadParameter(f"projection_dim {projection_dim} is more than the {x.shape[1]} features")
            w = solvers.learn_projection(x.astype(np.float32), y, projection_dim, n_epochs, learning_rate, random_seed)
            names = sorted(set(y))
            centre = np.stack([(x[y == a] @ w).mean(axis=0) for a in names])

        def fn(v: np.ndarray) -> np.ndarray:
            v = v if w is None else v @ w
            norm = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(centre, axis=1)
            return np.where(norm > 1e-12, v @ centre.T / np.maximum(norm, 1e-12), 0.0)

        return _scores(unknown, names, fn)

    return run


# --- prompting a language model ---

#: Callables prompt -> answer by provider name. None is bundled: calls leave the cluster only where one is registered.
PROVIDERS: dict[str, Callable[[str], str]] = {}
STYLES = {
    "no_guidance": "Decide who wrote the text.",
    "style": "Decide who wrote the text by its style: word choice, rhythm and punctuation, not by its topic.",
    "grammar": "Decide who wrote the text by its grammar: sentence structure, tense, voice and function words.",
    "lip": "Analyse modal verbs, punctuation, rare words, affixes, quantities, humour, errors and register, and not topics; then decide who wrote the text.",
}


def parse_answer(answer: str, authors: list[str]) -> list[str]:
    """Authors from first to last: from a JSON ranking or author, else the only name near the end, else names by their last mention; others follow."""
    ranked: list[str] = []
    for m in re.finditer(r"\{[^{}]*\}", answer):
        try:
            got = json.loads(m[0])
        except ValueError:
            continue
        listed = got.get("ranking") if isinstance(got.get("ranking"), list) else [got["author"]] if isinstance(got.get("author"), str) else []
        listed = [a for a in dict.fromkeys(x for x in listed if isinstance(x, str)) if a in authors]
        if listed:
            ranked = listed
            break
    if not ranked:
        near = [a for a in authors if a and a in answer[-200:]]
        ranked = near if len(near) == 1 else sorted((a for a in authors if a and a in answer), key=lambda a: -answer.rfind(a))
    return ranked + [a for a in authors if a not in ranked]


@METHODS.register(
    "llm_prompting", Param("provider", "offline"), Param("model_name", ""), Param("prompt_style", "no_guidance", choices=tuple(STYLES)), Param("max_known_chars", 2000, 1),
    traits=("higher", "text"),
)
def llm_prompting(provider: str, model_name: str, prompt_style: str, max_known_chars: int) -> Method:
    """Ask a registered language model to rank the authors, given excerpts; the unknown text is rebuilt from its histogram."""
    def run(c: Corpus) -> DataFrame:
        ask = PROVIDERS.get(provider)
        if ask is None:
            raise BadPipeline(f"no provider named {provider}; register a callable in PROVIDERS")
        texts = c.docs.select(F.col("doc_id").alias("k"), "text").join(c.known, "k")
        excerpts = texts.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("k", "text")))["text"].alias("t"))
        rows = excerpts.select("author", F.substring(F.array_join("t", "\n\n"), 1, max_known_chars)).orderBy("author").collect()
        names = [r[0] for r in rows]
        head = STYLES[prompt_style] + "\n\n" + "\n\n".join(f"Author {a}:\n{t}" for a, t in rows)
        rebuilt = c.unknown_hist.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("event", "cnt"))).alias("h"))
        rebuilt = c.unknown.join(rebuilt, "u", "left").withColumn("text", F.array_join(F.flatten(F.transform("h", lambda x: F.array_repeat(x["event"], x["cnt"].cast("int")))), " "))

        @F.pandas_udf("array<double>")
        def udf(text: pd.Series) -> pd.Series:
            out = []
            for t in text:
                order = parse_answer(ask(f"{head}\n\nUnknown text:\n{t or ''}\n\nAnswer with JSON: {{\"ranking\": [...]}}"), names)
                out.append([(len(names) - order.index(a)) / len(names) for a in names])
            return pd.Series(out, dtype=object)

        got = rebuilt.select("u", udf("text").alias("s")).select("u", F.posexplode("s").alias("i", "score"))
        return got.select("u", F.element_at(F.array(*[F.lit(a) for a in names]), F.col("i") + 1).alias("author"), "score")

    return run


# --- classifiers ---


def _numpy_classifier(make: Callable[[np.ndarray, np.ndarray], object]) -> Method:
    def run(c: Corpus) -> DataFrame:
        known, unknown = c.dense()
        x, y = _matrix(known)
        if len(set(y)) < 2:
            return c.grid.withColumn("score", F.lit(1.0))
        model = make(x, y)
        return _scores(unknown, [str(a) for a in model.classes], model.probability)

    return run


def _spark_classifier(make: Callable[[int, int], object]) -> Method:
    """A classifier of Spark's library, which trains where the data is."""
    def run(c: Corpus) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        known, unknown = c.dense()
        names = [r[0] for r in c.authors.orderBy("author").collect()]
        if len(names) < 2:
            return c.grid.withColumn("score", F.lit(1.0))
        label = F.array_position(F.array(*[F.lit(a) for a in names]), F.col("author")) - 1
        train = known.select(array_to_vector("x").alias("features"), label.cast("double").alias("label")).cache()
        n = train.count()
        model = make(n, len(names)).fit(train)
        got = model.transform(unknown.select("u", array_to_vector("x").alias("features"))).select("u", F.posexplode(vector_to_array("probability")).alias("i", "score"))
        train.unpersist()
        return got.where(F.col("i") < len(names)).select("u", F.element_at(F.array(*[F.lit(a) for a in names]), F.col("i") + 1).alias("author"), "score")

    return run


@METHODS.register("svm", Param("kernel", "linear", choices=("linear", "rbf", "poly")), traits=("higher", "numeric", "classifier"))
def svm(kernel: str) -> Method:
    """Support vectors, one author against the rest, with Platt's probabilities."""
    return _numpy_classifier(lambda x, y: solvers.KernelSvm(x, y, kernel))


@METHODS.register("lda", traits=("higher", "numeric", "classifier"))
def lda() -> Method:
    """Linear discriminant analysis."""
    return _numpy_classifier(solvers.Discriminant)


@METHODS.register(
    "mlp", Param("hidden_size", 100, 1), Param("max_iter", 500, 1), Param("r_drop", False), Param("r_drop_alpha", 1.0, 0), Param("dropout", 0.3, 0, 0.9),
    Param("learning_rate", 0.001, 0), Param("device", "auto"), traits=("higher", "numeric", "classifier"),
)
def mlp(hidden_size: int, max_iter: int, r_drop: bool, r_drop_alpha: float, dropout: float, learning_rate: float, device: str) -> Method:
    """A network with one hidden layer, with R-Drop if asked for."""
    return _numpy_classifier(lambda x, y: solvers.Perceptron(x, y, hidden_size, max_iter, learning_rate, r_drop, r_drop_alpha, dropout))


@METHODS.register("random_forest", Param("n_estimators", 100, 1), Param("max_depth", 0, 0), traits=("higher", "numeric", "classifier"))
def random_forest(n_estimators: int, max_depth: int) -> Method:
    """Random forest; depth 0 is the library's limit of 30."""
    from pyspark.ml.classification import RandomForestClassifier

    return _spark_classifier(lambda n, k: RandomForestClassifier(numTrees=n_estimators, maxDepth=min(max_depth or 30, 30), seed=0))


@METHODS.register("decision_tree", Param("max_depth", 10, 1, 100), traits=("higher", "numeric", "classifier"))
def decision_tree(max_depth: int) -> Method:
    """Decision tree (at most 30 deep)."""
    from pyspark.ml.classification import DecisionTreeClassifier

    return _spark_classifier(lambda n, k: DecisionTreeClassifier(maxDepth=min(max_depth, 30), seed=0))


@METHODS.register("logistic_regression", traits=("higher", "numeric", "classifier"))
def logistic_regression() -> Method:
    """Multinomial logistic regression with a unit quadratic penalty."""
    from pyspark.ml.classification import LogisticRegression

    return _spark_classifier(lambda n, k: LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), standardization=False, maxIter=1000))


@METHODS.register("naive_bayes", traits=("higher", "classifier"))
def naive_bayes() -> Method:
    """Multinomial naive Bayes on counts with add-one smoothing; events no known document has are ignored."""
    def run(c: Corpus) -> DataFrame:
        vocab = c.known_hist.select("event").distinct()
        v = vocab.agg(F.count("*").alias("v"))
        by = c.known_hist.groupBy("author", "event").agg(F.sum("cnt").alias("a"))
        total = c.authors.join(by.groupBy("author").agg(F.sum("a").alias("t")), "author", "left").fillna(0, ["t"]).crossJoin(F.broadcast(v))
        total = total.withColumn("prior", F.ln(F.col("n_docs") / F.sum("n_docs").over(W.partitionBy())))
        grid = c.unknown_hist.join(vocab, "event", "left_semi").crossJoin(F.broadcast(total)).join(by, ["author", "event"], "left")
        ll = grid.groupBy("u", "author").agg(F.sum(F.col("cnt") * F.ln((F.coalesce("a", F.lit(0)) + 1) / (F.col("t") + F.col("v")))).alias("ll"))
        full = c.unknown.crossJoin(F.broadcast(total.select("author", "prior"))).join(ll, ["u", "author"], "left").withColumn("z", F.col("prior") + F.coalesce("ll", F.lit(0.0)))
        w = W.partitionBy("u")
        e = F.exp(F.col("z") - F.max("z").over(w))
        return full.withColumn("e", e).select("u", "author", (F.col("e") / F.sum("e").over(w)).alias("score"))

    return run
