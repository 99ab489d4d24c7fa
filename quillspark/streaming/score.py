"""Scoring a stream of documents against a fixed corpus.

Each micro-batch is the unknown side of a pipeline whose known side is static. Results go to Parquet, one folder for each batch number,
overwritten if a batch is run again, so a restarted stream holds each batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import folder
from ..plans.model import Config
from ..plans.pipeline import Pipeline


def score_stream(stream: DataFrame, known: DataFrame, config: Config, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Rank the authors of known (doc_id, text, author) for each document of the stream (doc_id, text); (doc_id, rank, author, score) to ``out``."""
    fixed = known.select("doc_id", "text", "author", F.lit(True).alias("known"))
    pipeline = Pipeline(config)

    def batch(df: DataFrame, number: int) -> None:
        unknown = df.select("doc_id", "text", F.lit(None).cast("string").alias("author"), F.lit(False).alias("known"))
        pipeline.run(fixed.unionByName(unknown)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_files(spark: SparkSession, path: str, known: DataFrame, config: Config, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that is in a Parquet folder (or one file), as a stream, scored; the results when it has been read."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    stream = prepare(reader.parquet(path))
    out, checkpoint = folder(spark), folder(spark)
    score_stream(stream, known, config, out, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "rank", "author", "score")
