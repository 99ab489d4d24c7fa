"""Style changes between the paragraphs of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.model import DISTANCES, Config, Spec
from ..plans.pipeline import featured, histogram
from .distance import distances


def style_changes(docs: DataFrame, config: Config, threshold: float = 0.5, separator: str = "\n\n") -> DataFrame:
    """(doc_id, boundary_index, score, is_change) for each boundary between the paragraphs of docs (doc_id, text).

    Distances of neighbours are scaled to 0..1 within a document (all equal: 0); cullers do not apply. Cosine unless the config has a distance.
    """
    parts = F.filter(F.transform(F.split("text", F.lit("\\Q" + separator + "\\E")), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), lambda x: x != "")
    paras = docs.select(F.col("doc_id").alias("__doc"), F.posexplode(parts).alias("i", "text")).select(F.struct(F.col("__doc").alias("doc"), "i").alias("doc_id"), "text")
    full, _ = featured(paras, config)
    hist = histogram(full)
    spec = config.distance or Spec("cosine")
    near = paras.select(F.col("doc_id").alias("u"), F.struct(F.col("doc_id.doc").alias("doc"), (F.col("doc_id.i") + 1).alias("i")).alias("k"))
    near = near.join(paras.select(F.col("doc_id").alias("k")), "k", "left_semi")
    # a pair is a group of its own: both sides are keyed by it
    pair = near.withColumn("pair", F.struct("u.doc", "u.i"))
    left = hist.withColumnRenamed("doc_id", "u").join(pair.select("u", "pair"), "u")
    right = hist.withColumnRenamed("doc_id", "k").join(pair.select("k", "pair"), "k")
    d = distances(left.select("pair", "u", "event", "cnt"), right.select("pair", "k", "event", "cnt"), pair.select("pair", "u"), pair.select("pair", "k"), DISTANCES.create(spec.name, spec.params), ["pair"])
    w = W.partitionBy("doc_id")
    raw = d.select(F.col("u.doc").alias("doc_id"), F.col("u.i").alias("boundary_index"), "dist")
    low, high = F.min("dist").over(w), F.max("dist").over(w)
    score = F.when(high > low, (F.col("dist") - low) / (high - low)).otherwise(0.0)
    return raw.select("doc_id", "boundary_index", score.alias("score")).withColumn("is_change", F.col("score") >= threshold)
