"""Shared plumbing: cut lineage into the cluster's shared folder, typed mapInArrow, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one when running in one local process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage; a lost one would be made again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[int, list] = {}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread of this session writes; the last one out puts back what was there."""
    key = id(spark._jsparkSession)
    with _lock:
        state = _writing.setdefault(key, [0, spark.conf.get(_CLEANUP, None)])
        state[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                del _writing[key]
                spark.conf.unset(_CLEANUP) if state[1] is None else spark.conf.set(_CLEANUP, state[1])


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables once all that was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table has."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def distinct_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df, of rows that repeat an id and text one only; rows without an id stay as they are.

    Ids that stand on several rows are looked for first, without the texts; where there are none df is returned as it is.
    """
    again = stored(df.groupBy(F.col(id_col).alias("__again")).count().where("count > 1 AND __again IS NOT NULL").select("__again"))
    if not again.limit(1).count():
        release(again)
        return df
    once = df.join(again, df[id_col] == again["__again"], "left_anti")
    return once.unionByName(df.join(again, df[id_col] == again["__again"], "left_semi").dropDuplicates([id_col, text_col]))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function gets one batch at a time and yields dicts of numpy arrays or lists."""
    target = pa.schema(
        [pa.field(f.name, _arrow(f.dataType.simpleString())) for f in _parse(schema)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for cols in fn(batch):
                    yield to_batch(cols, target)
                give_back()

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, fn: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """As map_arrow, for functions that need a whole (bounded) shuffle partition at once."""
    target = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in _parse(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            del got
            for cols in fn(table):
                yield to_batch(cols, target)
            del table
            give_back()

    return df.mapInArrow(run, schema)


def to_batch(cols: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in target:
        v = cols[f.name]
        if isinstance(v, np.ndarray) and v.dtype == np.uint64:
            v = v.view(np.int64)
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v, type=f.type, from_pandas=False))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def _parse(schema: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    t = _parse_datatype_string(schema)
    assert isinstance(t, StructType)
    return t.fields


def _arrow(name: str) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(),
        "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }
    if name.startswith("array<"):
        return pa.list_(_arrow(name[6:-1]))
    if name.startswith("decimal("):
        return pa.decimal128(*map(int, name[8:-1].split(",")))
    return simple[name]


def numpy_column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    col = table.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.to_numpy(zero_copy_only=False)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) of the components of the pairs."""
    nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = place[: len(x)], place[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edge list; root is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round keeps at
    most as many edges as there were, and the number of rounds is logarithmic in practice. Every
    round is written to the shared folder.
    """
    def star(df: DataFrame) -> DataFrame:
        both = df.union(df.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every node's smaller neighbours and itself point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        return least.select("u", F.col("m").alias("v")).union(moved).distinct()

    cur = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    last = None
    while True:
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
        if not mark[0]:
            break
        new = stored(star(cur))
        release(cur)
        cur = new
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
