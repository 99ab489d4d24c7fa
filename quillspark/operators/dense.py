"""Distances of documents that are rows over a listed vocabulary (places e, counts n): to profiles where the documents lie, to all known documents in blocks.

Blocks travel as they are stored, a few hundred bytes a document, and become matrices a part at a time, so a block can hold many documents and each
is sent to few others. Cosines are matrix products. Manhattan is what both have less twice what they share, and only the document's own events share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import DISTANCES
from .blocks import Side, pair_matrix
from .distance import Aligned, Pair, tau_matrix

MOST, ROWS, PART, CELLS, LABELS, PROFILED = 1 << 16, 512, 4096, 1 << 21, 4096, 1 << 20


def kernel(distance: Pair | Aligned | None) -> str | None:
    """"dot" or "least" where documents can be compared as matrices."""
    return {DISTANCES.create("cosine"): "dot", DISTANCES.create("manhattan"): "least"}.get(distance) if isinstance(distance, Pair) else None


class Rows:
    """Documents one behind the other: sizes, places and values."""

    def __init__(self, e: pa.ListArray, n: pa.ListArray, how: str, order: np.ndarray | None = None):
        if order is not None:
            e, n = e.take(pa.array(order)), n.take(pa.array(order))
        self.size = pc.list_value_length(e).to_numpy().astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.e, cnt = e.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float)
        self.cnt = cnt
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        mass = np.bincount(self.doc, cnt * cnt if how == "dot" else cnt, len(self.size))
        self.some = mass > 0
        self.value = cnt / (np.sqrt(mass) if how == "dot" else mass)[self.doc]

    def matrix(self, a: int, b: int, width: int, turned: bool = False) -> np.ndarray:
        s = slice(self.first[a], self.first[b])
        m = np.zeros((width, b - a) if turned else (b - a, width))
        if turned:
            m[self.e[s], self.doc[s] - a] = self.value[s]
        else:
            m[self.doc[s] - a, self.e[s]] = self.value[s]
        return m


def _whole(x: pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _shared(left: Rows, right: Rows, a: int, b: int, c: int, d: int, width: int, how: str, other: np.ndarray) -> np.ndarray:
    """Cosines of rows a..b of left to rows c..d of right; or twice the common mass less that of the right."""
    if how == "dot":
        return left.matrix(a, b, width) @ other
    out, tmp = np.zeros((b - a, d - c)), np.empty(d - c)
    for i in range(a, b):
        row = out[i - a]
        for at in range(left.first[i], left.first[i + 1]):
            np.minimum(other[left.e[at]], left.value[at], out=tmp)
            row += tmp
    out *= 2
    out -= right.some[c:d]
    return out


def _block(a: pa.Table, b: pa.Table, width: int, how: str, keys: list[str], k: int, apart: bool) -> pa.Table:
    us, ks = _whole(a.column("u")), _whole(b.column("k"))
    code = np.zeros(len(ks), np.int64)
    for c in keys:
        x = _whole(b.column(c)).dictionary_encode("encode")
        code = code * max(len(x.dictionary), 1) + x.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ks, code = ks.take(pa.array(order)), code[order]
    left, right = Rows(_whole(a.column("e")), _whole(a.column("n")), how), Rows(_whole(b.column("e")), _whole(b.column("n")), how, order)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    group = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
    own = pc.fill_null(pc.index_in(us, value_set=ks), -1).to_numpy() if apart else np.full(len(us), -1)
    mass = left.some.astype(float) if how == "least" else np.ones(len(us))
    best = np.full((len(us), len(starts)), -np.inf)
    near: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(us) if k else []
    rank = _ranks(ks) if k else None
    bound = np.full(len(us), np.inf)
    part = max(min(PART, CELLS // max(width, 1)), 128)
    for c in range(0, len(ks), part):
        d = min(c + part, len(ks))
        other = right.matrix(c, d, width, turned=True)
        cuts = [c, *[s for s in starts if c < s < d], d]
        for i in range(0, len(us), ROWS):
            j = min(i + ROWS, len(us))
            sim = _shared(left, right, i, j, c, d, width, how, other)
            at = np.flatnonzero((own[i:j] >= c) & (own[i:j] < d))
            sim[at, own[i:j][at] - c] = -np.inf
            if not k:
                for x, y in zip(cuts, cuts[1:]):
                    g = group[x]
                    np.maximum(best[i:j, g], sim[:, x - c : y - c].max(axis=1), out=best[i:j, g])
                continue
            dist = np.maximum(mass[i:j, None] - (np.clip(sim, -1, 1) if how == "dot" else sim), 0)
            dist[at, own[i:j][at] - c] = np.inf
            if d - c > k:
                np.minimum(bound[i:j], np.partition(dist, k - 1, axis=1)[:, k - 1], out=bound[i:j])
            for u in range(i, j):
                got = np.flatnonzero(dist[u - i] <= bound[u] + 2e-10)
                got = got[dist[u - i][got] < np.inf]
                if len(got):
                    v, w = np.append(near[u][0], dist[u - i][got]), np.append(near[u][1], got + c)
                    first = np.lexsort((rank[w], np.round(v, 10)))[:k]
                    near[u] = v[first], w[first]
                    if len(first) == k:
                        bound[u] = min(bound[u], v[first].max())
    if k:
        at = np.repeat(np.arange(len(us)), [len(v) for v, _ in near])
        v, w = (np.concatenate([x[i] for x in near]) if near else np.zeros(0) for i in (0, 1))
        w = pa.array(w.astype(np.int64))
        return pa.table([us.take(pa.array(at)), ks.take(w), _whole(b.column("author")).take(pa.array(order)).take(w), pa.array(v)], names=["u", "k", "author", "dist"])
    i, g = np.nonzero(best > -np.inf)
    score = mass[i] - np.clip(best[i, g], -1, 1) if how == "dot" else mass[i] - best[i, g]
    row = pa.array(order[starts[g]])
    return pa.table([us.take(pa.array(i)), *[_whole(b.column(c)).take(row) for c in keys], pa.array(np.maximum(score, 0))], names=["u", *keys, "score"])


def _ranks(ids: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def placed(df: DataFrame, group: Column, groups: int) -> DataFrame:
    """df in as many partitions as there are groups, each group in one of its own: Spark hashes what it partitions by, so groups get labels that hash apart."""
    if groups > LABELS:
        return df.withColumn("g", group).repartition(groups, "g")
    spark, label = df.sparkSession, {}
    n = int(groups * (math.log(groups + 1) + 12))
    for i, p in spark.range(n).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(groups))).collect():
        label.setdefault(p, i)
    free = iter(i for i in range(n) if i not in set(label.values()))
    labels = [label[p] if p in label else next(free) for p in range(groups)]
    return df.withColumn("g", F.element_at(F.array(*[F.lit(x) for x in labels]), group.cast("int") + 1)).repartition(groups, "g")


def blocks(n_left: int, n_right: int, tasks: int, most: int = MOST) -> tuple[int, int]:
    """Blocks of either side: no more than ``most`` documents each, and work for all tasks."""
    a, b = max(-(-n_left // most), 1), max(-(-n_right // most), 1)
    while a * b < 3 * tasks and max(n_left // a, n_right // b) > ROWS:
        if n_left // a > n_right // b:
            a += 1
        else:
            b += 1
    return a, b


def crossed(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run of every block of left (u, ..) with every block of right (k, ..)."""
    spark = left.sparkSession
    a, b = blocks(left.count(), right.count(), max(spark.sparkContext.defaultParallelism, 1))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    l = left.withColumn("i", F.pmod(F.xxhash64("u"), F.lit(a))).withColumn("j", all_(b))
    r = right.withColumn("j", F.pmod(F.xxhash64("k"), F.lit(b))).withColumn("i", all_(a))
    group = F.col("i") * b + F.col("j")
    l, r = placed(l, group, a * b).drop("i", "j"), placed(r, group, a * b).drop("i", "j")
    # both may be of one table: columns of their own, or Spark takes those of one side for the other's
    l, r = (x.select(*[F.col(c).alias(f"{side}{c}") for c in x.columns]) for side, x in (("l_", l), ("r_", r)))

    def named(x: pa.Table, y: pa.Table) -> pa.Table:
        return run(*[t.rename_columns([c[2:] for c in t.column_names]) for t in (x, y)])

    return l.groupBy("l_g").cogroup(r.groupBy("r_g")).applyInArrow(named, schema)


def nearest(left: DataFrame, right: DataFrame, how: str, width: int, keep: str = "authors", k: int = 0, apart: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """left (u, e, n) by right (k, author, more.., e, n), ids without repetition: (u, author, more.., score), the nearest of each author (and more), or the k nearest (u, k, author, dist) of each block."""
    keys = ["author", *more]
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    names = ["u", *keys, "score"] if keep == "authors" else ["u", "k", "author", "dist"]
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)
    k = k if keep == "nearest" else 0

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            types = {f.name: f.type for t in (a, b) for f in t.schema}
            return pa.table({c: pa.array([], types.get(c, pa.float64())) for c in names})
        return _block(a, b, width, how, keys, k, apart)

    got = crossed(left.select("u", "e", "n"), right.select("k", *keys, "e", "n"), run, schema)
    return got.groupBy("u", *keys).agg(F.min("score").alias("score")) if keep == "authors" else got


def profiled(rows: DataFrame, right: DataFrame, ids: DataFrame, distance: Pair | Aligned, listed: list[str]) -> DataFrame | None:
    """(u, k, dist) of all rows (u, e, n) and a few histograms (k, event, cnt), made where the rows lie; None if these are too many to be sent there."""
    got = right.where("cnt > 0").select("k", "event", "cnt").limit(PROFILED + 1).collect()
    names = [r[0] for r in ids.select("k").distinct().orderBy("k").limit(PROFILED + 1).collect()]
    if len(got) > PROFILED or len(names) > PROFILED:
        return None
    place, row = {e: i for i, e in enumerate(listed)}, {k: i for i, k in enumerate(names)}
    got = sorted((row[k], place[e], c) for k, e, c in got if k in row)
    who, e, c = (np.array([x[i] for x in got], np.int64) for i in range(3))
    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema, *ids.schema]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Side.of(pa.array(names), np.bincount(who, minlength=len(names)), e, c.astype(float))
        for batch in batches:
            for a in range(0, batch.num_rows if names else 0, 2048):
                b = batch.slice(a, 2048)
                l = Side.of(b.column("u"), pc.list_value_length(b.column("e")).to_numpy().astype(np.int64), b.column("e").flatten().to_numpy().astype(np.int64), b.column("n").flatten().to_numpy().astype(float))
                if isinstance(distance, Pair):
                    dist = pair_matrix(l, r, distance)
                elif distance.tau and tau_matrix.fits(len(listed), len(names)):
                    dist = tau_matrix(l, r, len(listed), distance.tau)
                else:
                    x, y = ([{listed[f]: int(m) for f, m in zip(s.event[s.doc == i], s.cnt[s.doc == i])} for i in range(len(s.ids))] for s in (l, r))
                    dist = np.array([[distance.fn(p, q) for q in y] for p in x], float).reshape(len(x), len(y))
                i, j = np.divmod(np.arange(dist.size), len(names))
                yield pa.RecordBatch.from_arrays([l.ids.take(pa.array(i)), r.ids.take(pa.array(j)), pa.array(dist.ravel())], ["u", "k", "dist"])

    return rows.select("u", "e", "n").mapInArrow(run, f"u {kind['u']}, k {kind['k']}, dist double")


def _counts(e: pa.ListArray, n: pa.ListArray, width: int) -> np.ndarray:
    size = pc.list_value_length(e).to_numpy()
    m = np.zeros((len(e), width))
    m[np.repeat(np.arange(len(e)), size), e.flatten().to_numpy()] = n.flatten().to_numpy()
    return m


def _units(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1)[:, None]


def contests(left: DataFrame, right: DataFrame, features: dict[str, list[np.ndarray]], against: dict[str, list[np.ndarray]], width: int) -> DataFrame:
    """(u, cand, a0, .., b0, ..): cosines of left (u, e, n) to the nearest of right's (k, author, e, n) documents of each candidate, and to the nearest of ``against``
    (counts), on each round's features of the candidate."""
    rounds = len(next(iter(features.values())))
    kind = {f.name: f.dataType.simpleString() for f in left.schema}["u"]
    names = {x: ["u", "cand", *[f"{x}{i}" for i in range(rounds)]] for x in "ab"}
    schema = {x: f"u {kind}, cand string, " + ", ".join(f"{c} double" for c in names[x][2:]) for x in "ab"}

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        us, author = _whole(a.column("u")), _whole(b.column("author"))
        code = author.dictionary_encode("encode")
        out = []
        for c, cand in enumerate(code.dictionary.to_pylist()):
            if cand not in features:
                continue
            at = np.flatnonzero(code.indices.to_numpy() == c)
            best = np.zeros((len(us), rounds))
            for p in range(0, len(at), PART):
                take = pa.array(at[p : p + PART])
                y = _counts(_whole(b.column("e")).take(take), _whole(b.column("n")).take(take), width)
                for r, f in enumerate(features[cand]):
                    other = _units(y[:, f]).T.copy()
                    for i in range(0, len(us), ROWS):
                        x = _counts(_whole(a.column("e").slice(i, ROWS)), _whole(a.column("n").slice(i, ROWS)), width)
                        np.maximum(best[i : i + ROWS, r], (_units(x[:, f]) @ other).max(axis=1), out=best[i : i + ROWS, r])
            out.append(pa.table([us, pa.array([cand] * len(us), pa.string()), *best.T], names=names["a"]))
        return pa.concat_tables(out) if out else pa.table([us.slice(0, 0), pa.array([], pa.string()), *[pa.array([], pa.float64())] * rounds], names=names["a"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _counts(part.column("e"), part.column("n"), width)
                for cand, fs in features.items():
                    best = [(_units(x[:, f]) @ _units(y[:, f]).T).max(axis=1) for f, y in zip(fs, against[cand])]
                    yield pa.RecordBatch.from_arrays([part.column("u"), pa.array([cand] * len(x), pa.string()), *map(pa.array, best)], names["b"])

    near = crossed(left.select("u", "e", "n"), right.select("k", "author", "e", "n"), run, schema["a"])
    far = left.select("u", "e", "n").mapInArrow(others, schema["b"])
    return near.unionByName(far, allowMissingColumns=True).groupBy("u", "cand").agg(*[F.max(c).alias(c) for x in "ab" for c in names[x][2:]])


def filled(rows: DataFrame, places: np.ndarray, width: int, counts: bool) -> DataFrame:
    """(doc_id, author, known, x): relative frequencies (or counts) over ``width`` events; places has the event's place there for each listed one, or -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                m = _counts(part.column("e"), part.column("n"), len(places))
                if not counts:
                    m /= np.maximum(m.sum(axis=1), 1)[:, None]
                x = np.zeros((len(m), width))
                x[:, places[places >= 0]] = m[:, places >= 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "author", "known")], lists], ["doc_id", "author", "known", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "author", "known", "e", "n").mapInArrow(run, f"doc_id {kind}, author string, known boolean, x array<double>")


def sums(known: DataFrame, centre: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Authors, documents and sums of x by author of known (author, x); with a centre the sum of outer products of x - centre instead of the latter two's second."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if centre is not None:
                d = x - centre
                one = got.setdefault("", [0, np.zeros(d.shape[1] ** 2)])
                one[0], one[1] = one[0] + len(d), one[1] + (d.T @ d).ravel()
                continue
            code = batch.column("author").dictionary_encode()
            for c, a in enumerate(code.dictionary.to_pylist()):
                part = x[code.indices.to_numpy() == c]
                one = got.setdefault(a, [0, np.zeros(x.shape[1])])
                one[0], one[1] = one[0] + len(part), one[1] + part.sum(axis=0)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.list_(pa.float64()))], ["author", "n", "s"])

    total: dict[str, list] = {}
    for a, n, s in known.select("author", "x").mapInArrow(run, "author string, n bigint, s array<double>").collect():
        one = total.setdefault(a, [0, 0.0])
        one[0], one[1] = one[0] + n, one[1] + np.array(s)
    names = sorted(total)
    return names, np.array([total[a][0] for a in names], float), np.array([total[a][1] for a in names], float)
