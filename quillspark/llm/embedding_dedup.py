"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). A rotation onto the principal
axes of the vectors keeps distances and puts the spread first; cells of width eps on the leading axes give the epsilon grid order, by
which the vectors are sorted over all partitions and cut into blocks. The axes are fitted on a bounded sample (``FIT`` numbers); every vector is joined. Blocks whose cell ranges are more than one cell apart on any axis are
provably distant and never meet. Blocks that may be near are joined by recursion over their sequences: intervals that are distant are skipped,
short ones are compared by a matrix product, others are halved.

A task reads its own run of blocks and streams the others past it. It reports a spanning forest of the near pairs it finds, so a group
of n near copies costs n edges, not n squared; connected components of the edges are the groups, of which the smallest id stays.

Cases: null ids, null vectors, vectors that hold nulls, NaN or infinities, zero and empty vectors are never near to any. Vectors of different
lengths are never near each other. Repeated vectors are near copies (ties: smallest id stays); rows that repeat an id and vector are one.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, map_arrow, numpy_column, stored, to_batch

THRESHOLD, AXES, BLOCK, LEAF, RUN = 0.95, 6, 512, 128, 16
FIT = 1 << 22

ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT a AS vec_id, min(b) AS duplicate_of FROM r GROUP BY a HAVING min(b) < a
"""


def _unit(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return flat, flat / np.sqrt((flat.astype(np.float64) ** 2).sum(axis=1))[:, None]


def _axes(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of about ``FIT`` / d vectors, chosen by hash of the id (all if there are no more).

    Any rotation keeps distances, so the sample decides how well blocks are skipped and never what is found.
    """
    n, most = vectors.count(), max(FIT // d, 1)
    some = vectors.select("v") if n <= most else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * most / n) + 1).select("v").limit(2 * most)
    flat = some.toArrow().column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    u = flat / np.sqrt((flat * flat).sum(axis=1))[:, None]
    mean = u.mean(axis=0) if len(u) else np.zeros(d)
    values, axes = np.linalg.eigh((u - mean).T @ (u - mean))
    return mean, axes[:, np.argsort(-values)]


def _blocks(vectors: DataFrame, d: int, eps: float) -> DataFrame:
    """The vectors in epsilon grid order, a row a block: (block, run, lo, hi, ids, cells, vecs)."""
    mean, axes = _axes(vectors, d)
    m = min(AXES, d)
    lead = axes[:, :m]

    def cells(batch: pa.RecordBatch) -> Iterator[dict]:
        _, u = _unit(batch, d)
        c = np.floor((u - mean) @ lead / eps).astype(np.int32)
        yield {"vec_id": batch.column("vec_id"), "v": batch.column("v")} | {f"c{k}": c[:, k] for k in range(m)}

    names = [f"c{k}" for k in range(m)]
    placed = stored(map_arrow(vectors, cells, "vec_id long, v array<float>, " + ", ".join(f"{c} int" for c in names)))
    ordered = placed.repartitionByRange(*names).sortWithinPartitions(*names, "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("block", pa.int64()), ("run", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("ids", pa.binary()), ("cells", pa.binary()), ("vecs", pa.binary())])
        part, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                c = np.stack([numpy_column(s, n) for n in names], axis=1)
                vec, _ = _unit(s, d)
                yield to_batch(
                    {
                        "block": [part + k], "run": [part + k // RUN], "lo": [c.min(axis=0).tolist()], "hi": [c.max(axis=0).tolist()],
                        "ids": [numpy_column(s, "vec_id").astype(np.int64).tobytes()], "cells": [c.astype(np.int32).tobytes()], "vecs": [vec.astype(np.float32).tobytes()],
                    },
                    target,
                )
                k += 1

    return stored(ordered.mapInArrow(pack, "block long, run long, lo array<int>, hi array<int>, ids binary, cells binary, vecs binary"))


class Sequence:
    """Vectors of a block in grid order."""

    def __init__(self, row: dict, d: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.int32).reshape(len(self.ids), -1)
        self.vecs = np.frombuffer(row["vecs"], np.float32).reshape(-1, d)
        v = self.vecs.astype(np.float64)
        self.unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
        self.small = self.unit.astype(np.float32)


def distant(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two intervals' cells are more than one cell apart on some axis."""
    return bool(((a.min(axis=0) > b.max(axis=0) + 1) | (b.min(axis=0) > a.max(axis=0) + 1)).any())


def ego_join(a: Sequence, b: Sequence, threshold: float, out: list, ra: tuple[int, int] | None = None, rb: tuple[int, int] | None = None) -> None:
    """Collect (places in a, places in b) of pairs whose cosine reaches the threshold."""
    (a0, a1), (b0, b1) = ra or (0, len(a.ids)), rb or (0, len(b.ids))
    if distant(a.cells[a0:a1], b.cells[b0:b1]):
        return
    if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
        i, j = np.nonzero(a.small[a0:a1] @ b.small[b0:b1].T >= threshold - 1e-5)
        if len(i):
            i, j = i + a0, j + b0
            ok = ((a.unit[i] * b.unit[j]).sum(axis=1) >= threshold) & (a.ids[i] != b.ids[j])
            out.append((i[ok], j[ok]))
    elif a1 - a0 >= b1 - b0:
        mid = (a0 + a1) // 2
        ego_join(a, b, threshold, out, (a0, mid), (b0, b1))
        ego_join(a, b, threshold, out, (mid, a1), (b0, b1))
    else:
        mid = (b0 + b1) // 2
        ego_join(a, b, threshold, out, (a0, a1), (b0, mid))
        ego_join(a, b, threshold, out, (a0, a1), (mid, b1))


def near_edges(vectors: DataFrame, d: int, threshold: float) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of vectors of length d with a cosine of at least threshold."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-5) + 1e-6)
    blocks = _blocks(vectors, d, eps)
    m = min(AXES, d)
    wide = min(2, m)
    box = blocks.select("block", "run", "lo", "hi")
    left, right = box, box.select(F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    for k in range(wide):  # blocks meet by the cells they cover on the first axes, the right ones with their neighbours
        left = left.withColumn(f"g{k}", F.explode(F.sequence(F.col("lo")[k], F.col("hi")[k])))
        right = right.withColumn(f"g{k}", F.explode(F.sequence(F.col("lo_b")[k] - 1, F.col("hi_b")[k] + 1)))
    near = F.lit(True)
    for k in range(m):
        near &= (F.col("lo")[k] <= F.col("hi_b")[k] + 1) & (F.col("lo_b")[k] <= F.col("hi")[k] + 1)
    pairs = left.join(right, [f"g{k}" for k in range(wide)]).where(near & (F.col("block") <= F.col("b"))).select("run", "b").distinct()
    payload = ["block", "ids", "cells", "vecs"]
    own = blocks.select("run", F.lit(0).alias("side"), *payload)
    other = pairs.join(blocks.drop("run"), pairs["b"] == blocks["block"]).select("run", F.lit(1).alias("side"), *payload)
    rows = own.union(other).repartition("run").sortWithinPartitions("run", "side", "block")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        run, held = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if row["run"] != run:
                    run, held = row["run"], []
                seq = Sequence(row, d)
                if row["side"] == 0:
                    held.append((row["block"], seq))
                    continue
                found: list = []
                for block, mine in held:
                    if block <= row["block"]:
                        out: list = []
                        ego_join(mine, seq, threshold, out)
                        found += [(mine.ids[i], seq.ids[j]) for i, j in out]
                if found:
                    x, y = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                    yield to_batch({"a": x, "b": y}, target)

    return rows.mapInArrow(join, "a long, b long").distinct()


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, duplicate_of): each vector that a group of near copies drops, and the smallest id of its group, which stays."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    reps = stored(v.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.collect_set("vec_id").alias("same")))
    same = reps.where(F.size("same") > 1).select(F.explode("same").alias("a"), F.col("vec_id").alias("b")).where("a <> b")
    edges = same
    for (d,) in sorted(map(tuple, reps.select(F.size("v")).distinct().collect())):  # lengths, not rows
        edges = edges.union(near_edges(reps.where(F.size("v") == d).select("vec_id", "v"), d, threshold))
    roots = connected_components(edges)
    return roots.where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("duplicate_of")).distinct()
