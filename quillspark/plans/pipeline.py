"""From a Config and documents to ranked authors: one lazy plan until the method needs something whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import counting, events, text
from ..operators import cull as culling
from ..operators import distance, methods
from ..operators.store import written
from .model import CANONICIZERS, DISTANCES, DRIVERS, METHODS, BadPipeline, Config

_ = (text, distance)  # importing them registers their components


def check(config: Config) -> None:
    """Names and parameters exist, and the parts fit together; says so before any data is read."""
    if not config.event_drivers:
        raise BadPipeline("no event driver")
    if config.method is None:
        raise BadPipeline("no method")
    for registry, specs in ((CANONICIZERS, config.canonicizers), (DRIVERS, config.event_drivers), (culling.CULLERS, config.event_cullers)):
        for s in specs:
            registry.create(s.name, s.params)
    METHODS.create(config.method.name, config.method.params)
    traits = METHODS.get(config.method.name).traits
    numeric = {events.is_numeric(s.name) for s in config.event_drivers}
    if len(numeric) > 1:
        raise BadPipeline("numeric and discrete event drivers do not mix")
    if numeric == {True} and "numeric" not in traits:
        raise BadPipeline(f"{config.method.name} does not take vectors")
    if "distance" in traits and config.distance is None:
        raise BadPipeline(f"{config.method.name} needs a distance")
    if config.distance is not None:
        DISTANCES.create(config.distance.name, config.distance.params)


def canonical(df: DataFrame, config: Config, column: str = "text") -> DataFrame:
    """Apply the canonicizers from left to right to one column, as one expression."""
    e = F.col(column)
    for s in config.canonicizers:
        e = CANONICIZERS.create(s.name, s.params)(e)
    return df.withColumn(column, e)


def featured(docs: DataFrame, config: Config) -> tuple[DataFrame, bool]:
    """docs (doc_id, text) with ``events``, and whether they are numbers."""
    return events.extract(canonical(docs, config), "text", list(config.event_drivers))


def histogram(featured_docs: DataFrame) -> DataFrame:
    """(doc_id, event, cnt).

    The outer form keeps the optimizer from copying the event expression into a filter on its size below the generator, where the
    arrays that its lambdas read would be inlined and split again for every element.
    """
    rows = featured_docs.select("doc_id", F.explode_outer("events").alias("event")).where("event IS NOT NULL")
    return rows.groupBy("doc_id", "event").agg(F.count("*").alias("cnt"))


def counts(docs: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> counting.Source:
    """The documents (doc_id, text, and columns to keep), ready to be counted."""
    docs = docs.select("doc_id", *keep, "text")
    if len(config.event_drivers) == 1:
        s = config.event_drivers[0]
        component = DRIVERS.get(s.name)
        component.create(s.params)
        params = {p.name: p.parse(s.params.get(p.name, p.default)) for p in component.params}
        if form := counting.form_of(s.name, params, lambda p: events.words_among(s.name, p)):
            steps = list(config.canonicizers)
            while form.words and steps and steps[-1].name == "normalize_whitespace":  # words are the same without it
                steps.pop()
            text = canonical(docs, Config(canonicizers=tuple(steps)))
            return counting.Source(text.withColumn("text", F.lower("text")) if form.lower and "unify_case" not in {x.name for x in steps[-1:]} else text, form)
    return counting.Source(featured(docs, config)[0].drop("text"), None)


@dataclass
class Pipeline:
    """``run(docs)`` ranks the authors for each document that isn't known. docs: doc_id, text, author, known (boolean)."""

    config: Config
    progress: Callable[[float, str], None] | None = None

    def __post_init__(self):
        check(self.config)

    @property
    def higher_is_better(self) -> bool:
        return "higher" in METHODS.get(self.config.method.name).traits

    @property
    def threshold(self) -> float | None:
        """Scores from here on verify an author; None where the method does not verify."""
        return 0.5 if "verification" in METHODS.get(self.config.method.name).traits else None

    def _say(self, share: float, what: str) -> None:
        if self.progress:
            self.progress(share, what)

    def prepare(self, docs: DataFrame) -> methods.Corpus:
        """Features, culled histograms and the distance, all lazy."""
        self._say(0.0, "plan")
        cols = ["doc_id", "author", "known"]
        labels = docs.select(*cols, *(["text"] if "text" in METHODS.get(self.config.method.name).traits else []))
        full, numeric = featured(docs.select("doc_id", "text"), self.config)
        d = None if self.config.distance is None else DISTANCES.create(self.config.distance.name, self.config.distance.params)
        self._say(0.3, "features")
        if numeric:
            return methods.Corpus(labels, vectors=full.select("doc_id", F.col("events").alias("features")), distance=d)
        source = counts(docs, self.config, ("author", "known"))
        if not source.repeated:
            specs = list(self.config.event_cullers)
            known = source.where("known")
            kept = culling.kept(known.histogram, known.totals, docs.where("known").select("doc_id", "author"), specs)
            vocabulary = methods.listed(source.totals().select("event") if kept is None else kept, methods.MAX_LISTED)
            if vocabulary is not None:
                rows = written(source.rows(vocabulary, ["author", "known"], once=culling.once(specs)))
                return methods.Corpus(labels, hist=counting.flat(rows, vocabulary, ["doc_id"]), distance=d, rows=rows, listed=vocabulary)
        return methods.Corpus(labels, hist=culling.cull(source.histogram(), labels, list(self.config.event_cullers)), distance=d)

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, rank, author, score), best first."""
        return self.attribute(self.prepare(docs))

    def attribute(self, corpus: methods.Corpus) -> DataFrame:
        scores = METHODS.create(self.config.method.name, self.config.method.params)(corpus)
        self._say(0.8, "scores")
        out = methods.rank(scores, self.higher_is_better).withColumnRenamed("u", "doc_id")
        self._say(1.0, "ranked")
        return out


def verdicts(rankings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, author, score, verdict) of the first-ranked author: INCONCLUSIVE at exactly 0.5, VERIFIED from the threshold on, else REJECTED."""
    v = F.when(F.col("score") == 0.5, "INCONCLUSIVE").when(F.col("score") >= threshold, "VERIFIED").otherwise("REJECTED")
    return rankings.where("rank = 1").select("doc_id", "author", "score", v.alias("verdict"))
