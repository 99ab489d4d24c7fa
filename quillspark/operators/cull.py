"""Event cullers: which events to keep, from the histograms of the known documents.

A culler is a function (hist, docs) -> DataFrame of kept events, where hist has (doc_id, event, cnt) of the known documents and docs
their (doc_id, author). Documents that lack an event count as zeros: means and variances use the number of documents and closed
forms. Ties are broken by the event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import CULLERS, Param

Culler = Callable[[DataFrame, DataFrame], DataFrame]
N = Param("n", 50, 1)


def _totals(hist: DataFrame) -> DataFrame:
    return hist.groupBy("event").agg(F.sum("cnt").alias("total"))


def _top(scored: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return scored.orderBy(order, "event").limit(n).select("event")


def moments(hist: DataFrame, docs: DataFrame) -> DataFrame:
    """(event, n, df, total, mean, var): over all documents, absent ones as zeros."""
    n = docs.agg(F.count("*").cast("double").alias("n"))
    one = hist.groupBy("event").agg(F.sum("cnt").cast("double").alias("total"), F.count("*").alias("df"), F.sum(F.col("cnt") * F.col("cnt")).cast("double").alias("squares"))
    one = one.crossJoin(F.broadcast(n)).withColumn("mean", F.col("total") / F.col("n"))
    # counts are whole numbers, so n * squares - total**2 is exact and a constant event has variance 0
    return one.withColumn("var", (F.col("n") * F.col("squares") - F.col("total") * F.col("total")) / (F.col("n") * F.col("n")))


@CULLERS.register("most_common", N)
def most_common(n: int) -> Culler:
    """The n most frequent events."""
    return lambda hist, docs: _top(_totals(hist).withColumnRenamed("total", "score"), n)


@CULLERS.register("least_common", N)
def least_common(n: int) -> Culler:
    """The n least frequent events."""
    return lambda hist, docs: _top(_totals(hist).withColumnRenamed("total", "score"), n, ascending=True)


@CULLERS.register("percentage_range", Param("min_percent", 0.0, 0, 100), Param("max_percent", 100.0, 0, 100))
def percentage_range(min_percent: float, max_percent: float) -> Culler:
    """Events whose share of all occurrences is within a range."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        t = _totals(hist)
        all_ = t.agg(F.sum("total").alias("grand"))
        share = F.col("total") / F.col("grand")
        return t.crossJoin(F.broadcast(all_)).where((share >= min_percent / 100) & (share <= max_percent / 100)).select("event")

    return keep


@CULLERS.register("information_gain", N)
def information_gain(n: int) -> Culler:
    """The n events whose occurrences are spread most evenly over documents (entropy in bits)."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        c = F.col("cnt").cast("double")
        h = hist.groupBy("event").agg(F.sum(c).alias("t"), F.sum(c * F.log2(c)).alias("s"))
        return _top(h.select("event", F.round(F.log2("t") - F.col("s") / F.col("t"), 10).alias("score")), n)

    return keep


@CULLERS.register("zeta", Param("threshold", 0.3, 0, 1), Param("primary_author", ""))
def zeta(threshold: float, primary_author: str) -> Culler:
    """Events whose share of one author's documents differs from their share of the others' (Burrows and Craig)."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        labelled = docs.select("doc_id", F.coalesce("author", F.lit("")).alias("author"))
        first = labelled.groupBy("author").count().orderBy(F.desc("count"), "author").limit(1).select(F.col("author").alias("primary"))
        if primary_author:
            first = docs.sparkSession.createDataFrame([(primary_author,)], "primary string")
        mine = labelled.crossJoin(F.broadcast(first)).select("doc_id", (F.col("author") == F.col("primary")).alias("mine"))
        sizes = mine.agg(F.sum(F.col("mine").cast("int")).alias("n1"), F.sum((~F.col("mine")).cast("int")).alias("n2"))
        df = hist.join(mine, "doc_id").groupBy("event").agg(F.sum(F.col("mine").cast("int")).alias("d1"), F.sum((~F.col("mine")).cast("int")).alias("d2"))
        gap = F.abs(F.col("d1") / F.col("n1") - F.col("d2") / F.col("n2"))
        one_group = (F.col("n1") == 0) | (F.col("n2") == 0)
        return df.crossJoin(F.broadcast(sizes)).where(one_group | F.coalesce(gap >= threshold, F.lit(False))).select("event")

    return keep


@CULLERS.register("iqr", Param("factor", 1.5, 0))
def iqr(factor: float) -> Culler:
    """Events whose total is within the quartiles widened by factor times their distance."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        t = _totals(hist)
        q = t.agg(F.percentile("total", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        low, high = F.col("q")[0], F.col("q")[1]
        return t.crossJoin(F.broadcast(q)).where(F.col("total").between(low - factor * (high - low), high + factor * (high - low))).select("event")

    return keep


@CULLERS.register("std_deviation", Param("n", 1.0, 0))
def std_deviation(n: float) -> Culler:
    """Events whose total is within n standard deviations of the mean total."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        t = _totals(hist)
        s = t.agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("s"))
        return t.crossJoin(F.broadcast(s)).where(F.abs(F.col("total") - F.col("m")) <= n * F.col("s")).select("event")

    return keep


@CULLERS.register("extreme")
def extreme() -> Culler:
    """Events of every known document."""
    return lambda hist, docs: moments(hist, docs).where("df = n").select("event")


@CULLERS.register("variance", Param("min_variance", 0.0, 0))
def variance(min_variance: float) -> Culler:
    """Events whose variance over documents is above a bound."""
    return lambda hist, docs: moments(hist, docs).where(F.col("var") > min_variance).select("event")


@CULLERS.register("range", Param("min_count", 2, 0), Param("max_count", 100, 0))
def range_culler(min_count: int, max_count: int) -> Culler:
    """Events that a number of documents within a range have."""
    return lambda hist, docs: hist.groupBy("event").count().where(F.col("count").between(min_count, max_count)).select("event")


@CULLERS.register("coefficient_of_variation", Param("min_cv", 0.0, 0))
def coefficient_of_variation(min_cv: float) -> Culler:
    """Events whose standard deviation over the mean is above a bound."""
    return lambda hist, docs: moments(hist, docs).where((F.col("mean") > 0) & (F.sqrt("var") / F.col("mean") > min_cv)).select("event")


@CULLERS.register("mean_absolute_deviation", N)
def mean_absolute_deviation(n: int) -> Culler:
    """The n events with the largest mean absolute deviation over documents."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        m = moments(hist, docs).select("event", "n", "df", "mean")
        dev = hist.join(m, "event").groupBy("event", "n", "df", "mean").agg(F.sum(F.abs(F.col("cnt") - F.col("mean"))).alias("s"))
        return _top(dev.select("event", F.round((F.col("s") + (F.col("n") - F.col("df")) * F.col("mean")) / F.col("n"), 10).alias("score")), n)

    return keep


@CULLERS.register("index_of_dispersion", N)
def index_of_dispersion(n: int) -> Culler:
    """The n events with the largest variance over the mean."""
    return lambda hist, docs: _top(moments(hist, docs).select("event", F.round(F.when(F.col("mean") > 0, F.col("var") / F.col("mean")).otherwise(0.0), 10).alias("score")), n)


@CULLERS.register("weighted_variance", N)
def weighted_variance(n: int) -> Culler:
    """The n events with the largest variance weighted by their share of all occurrences."""
    def keep(hist: DataFrame, docs: DataFrame) -> DataFrame:
        m = moments(hist, docs)
        grand = m.agg(F.sum("total").alias("grand"))
        p = F.col("total") / F.col("grand")
        mw = p * F.col("mean")
        score = p * (F.col("squares") - 2 * mw * F.col("total") + F.col("n") * mw * mw)
        return _top(m.crossJoin(F.broadcast(grand)).select("event", F.round(score, 10).alias("score")), n)

    return keep


@CULLERS.register("set_culler", traits=("per_document",))
def set_culler() -> Callable[[DataFrame], DataFrame]:
    """Every event once in a document."""
    return lambda hist: hist.withColumn("cnt", F.lit(1).cast("long"))


def once(specs: list) -> bool:
    """Whether a culler counts each event of a document once."""
    return any("per_document" in CULLERS.get(s.name).traits for s in specs)


def kept(hist: Callable[[], DataFrame], totals: Callable[[], DataFrame], known: DataFrame, specs: list) -> DataFrame | None:
    """The events that every culler keeps, from the known documents' histograms or, where they suffice, totals (event, n, df); None if all are kept."""
    out = None
    for s in specs:
        if "per_document" in CULLERS.get(s.name).traits:
            continue
        made = CULLERS.create(s.name, s.params)
        if s.name in ("most_common", "least_common"):
            n = {p.name: p for p in CULLERS.get(s.name).params}["n"]
            one = _top(totals().withColumnRenamed("n", "score"), n.parse(s.params.get("n", n.default)), s.name == "least_common")
        else:
            one = made(hist(), known)
        out = one if out is None else out.join(one, "event", "left_semi")
    return out


def cull(hist: DataFrame, docs: DataFrame, specs: list) -> DataFrame:
    """hist of all documents (docs: doc_id, author, known) cut down to what every culler keeps; each looks at the known documents as they came."""
    if not specs:
        return hist
    known = docs.where("known").select("doc_id", "author")
    known_hist = hist.join(known.select("doc_id"), "doc_id", "left_semi")
    for s in specs:
        if "per_document" in CULLERS.get(s.name).traits:
            hist = CULLERS.create(s.name, s.params)(hist)
        else:
            hist = hist.join(CULLERS.create(s.name, s.params)(known_hist, known), "event", "left_semi")
    return hist.select("doc_id", "event", "cnt")
