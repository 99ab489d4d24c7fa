"""Distances of a query set to all known documents, block by block.

Both sides are cut into blocks of documents by hash of the id, and each pair of blocks is one group: histograms travel as arrays, once for
each block of the other side, and no row is made for an event that two documents share. Within a group the shared events are found
by sorted event hashes (64 bits) and summed in numpy; what leaves it is what the method needs: each author's nearest, the k nearest, or all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distance import Aligned, Pair

BLOCK, LEAST_BLOCK, CELLS = 2048, 128, 1 << 22
_NAMES = {
    "ln": np.log, "abs": np.abs, "sqrt": np.sqrt, "pow": np.power, "least": np.minimum, "greatest": np.maximum, "acos": np.arccos, "pi": lambda: np.pi,
    "double": float, "where": np.where, "np": np,
}


def compiled(sql: str) -> Callable[[dict], np.ndarray]:
    """The expressions of ``Pair`` (arithmetic, comparisons, one CASE) as a numpy function of their variables."""
    m = re.fullmatch(r"CASE WHEN (.+?) THEN (.+?) ELSE (.+) END", sql)
    text = f"where({m[1]}, {m[2]}, {m[3]})" if m else sql
    text = re.sub(r"\b(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1", text).replace("'Infinity'", "'inf'")
    text = re.sub(r"(\w+) (<=|=) (\w+)", lambda t: f"({t[1]} {'==' if t[2] == '=' else t[2]} {t[3]})", text)
    code = compile(text.replace(" OR ", " | ").replace(" AND ", " & "), sql, "eval")

    def run(values: dict) -> np.ndarray:
        with np.errstate(all="ignore"):
            return eval(code, {"__builtins__": {}}, _NAMES | values)

    return run


class Side:
    """The histograms of a block: documents one behind the other, events sorted by hash over the block on request."""

    def __init__(self, table: pa.Table, id_name: str, arrays: bool = True):
        self.ids = table.column(id_name).combine_chunks()
        lists = table.column("h").combine_chunks()
        self.size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        flat = pa.concat_arrays([x.values for x in lists if x.is_valid and len(x)]) if self.size.sum() else None
        self.doc = np.repeat(np.arange(len(self.ids)), self.size)
        if arrays:
            self.event = flat.field("event").to_numpy(zero_copy_only=False).astype(np.int64) if flat is not None else np.zeros(0, np.int64)
            self.cnt = flat.field("cnt").to_numpy(zero_copy_only=False).astype(float) if flat is not None else np.zeros(0)
            self.total = np.bincount(self.doc, self.cnt, len(self.ids))
            self.f = self.cnt / self.total[self.doc]
        else:
            pairs = [{} if not x.is_valid else {e["event"]: e["cnt"] for e in x.as_py()} for x in lists]
            self.dicts: list[dict[str, int]] = pairs

    @classmethod
    def of(cls, ids: pa.Array, size: np.ndarray, event: np.ndarray, cnt: np.ndarray) -> Side:
        """Documents one behind the other, as arrays."""
        out = cls.__new__(cls)
        out.ids, out.size, out.event, out.cnt = ids, size, event, cnt
        out.doc = np.repeat(np.arange(len(ids)), size)
        out.total = np.bincount(out.doc, cnt, len(ids))
        out.f = cnt / out.total[out.doc]
        return out

    def marginals(self, terms: list[str], names: tuple[str, str]) -> dict[str, np.ndarray]:
        """By document: total, events, sum of squares, least and largest count, and the sums of terms over all own events."""
        n, p, c = len(self.ids), *names
        out = {"t": self.total, "n": self.size.astype(float), "s": np.bincount(self.doc, self.f * self.f, n), "lo": np.zeros(n), "hi": np.zeros(n)}
        full = self.size > 0
        if full.any():
            first = (np.cumsum(self.size) - self.size)[full]
            out["lo"][full], out["hi"][full] = np.minimum.reduceat(self.cnt, first), np.maximum.reduceat(self.cnt, first)
        for i, term in enumerate(terms):
            x = np.broadcast_to(np.asarray(compiled(term)({p: self.f, c: self.cnt}), float), self.f.shape)
            out[f"m{i}"] = np.bincount(self.doc, x, n)
        return out


def pair_matrix(left: Side, right: Side, pair: Pair) -> np.ndarray:
    """Distances of all documents of left to all of right."""
    lm, rm = left.marginals([t[0] for t in pair.terms], ("p", "c1")), right.marginals([t[1] for t in pair.terms], ("q", "c2"))
    order = np.argsort(right.event, kind="stable")
    event, rdoc, q, c2 = right.event[order], right.doc[order], right.f[order], right.cnt[order]
    lo, hi = np.searchsorted(event, left.event, "left"), np.searchsorted(event, left.event, "right")
    k = len(right.ids)
    deltas = [compiled(f"({s}) - ({l}) - ({r})") for l, r, s in pair.terms]
    shared, sums = np.zeros((len(left.ids), k)), [np.zeros((len(left.ids), k)) for _ in pair.terms]
    ends, a = np.cumsum(hi - lo), 0
    while a < len(lo):  # so many shared events at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
        n = (hi - lo)[a:b]
        src = np.repeat(np.arange(a, b), n)
        at = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n) + lo[src]
        d0, d1 = left.doc[a], left.doc[b - 1] + 1
        cell = (left.doc[src] - d0) * k + rdoc[at]
        values = {"p": left.f[src], "q": q[at], "c1": left.cnt[src], "c2": c2[at]}
        shared[d0:d1] += np.bincount(cell, minlength=(d1 - d0) * k).reshape(d1 - d0, k)
        for i, delta in enumerate(deltas):
            sums[i][d0:d1] += np.bincount(cell, np.broadcast_to(delta(values), cell.shape), (d1 - d0) * k).reshape(d1 - d0, k)
        a = b
    values = {f"{x}{s}": (m[x][:, None] if s == 1 else m[x][None]) for s, m in ((1, lm), (2, rm)) for x in ("t", "n", "s", "lo", "hi")}
    values["n"] = values["n1"] + values["n2"] - shared
    for i in range(len(pair.terms)):
        values[f"x{i}"] = lm[f"m{i}"][:, None] + rm[f"m{i}"][None] + sums[i]
    return np.broadcast_to(np.asarray(compiled(pair.final)(values), float), shared.shape)


def matrix(left: pa.Table, right: pa.Table, distance: Pair | Aligned) -> tuple[pa.Array, pa.Array, np.ndarray]:
    whole = isinstance(distance, Aligned)
    l, r = Side(left, "u", not whole), Side(right, "k", not whole)
    if whole:
        return l.ids, r.ids, np.array([[distance.fn(a, b) for b in r.dicts] for a in l.dicts], float).reshape(len(l.ids), len(r.ids))
    return l.ids, r.ids, pair_matrix(l, r, distance)


def _arrays(ids: DataFrame, hist: DataFrame, key: str, hashed: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each id: (id, ..., h), h an array of (event, cnt)."""
    e = F.xxhash64("event") if hashed else F.col("event")
    h = hist.where("cnt > 0").groupBy(key).agg(F.collect_list(F.struct(e.alias("event"), F.col("cnt").cast("long").alias("cnt"))).alias("h"))
    return ids.select(key, *more).distinct().join(h, key, "left")


def blocked(
    left: DataFrame, right: DataFrame, left_ids: DataFrame, right_ids: DataFrame, distance: Pair | Aligned,
    keep: str = "pairs", k: int = 0, apart: bool = False, block: int = BLOCK,
) -> DataFrame:
    """Distances of all left_ids (u) to all right_ids (k, and author unless all pairs are asked for); left is (u, event, cnt), right (k, event, cnt).

    ``keep``: "pairs" gives (u, k, dist); "authors" (u, author, score), each author's nearest; "nearest" (u, k, author, dist), the k
    nearest of each block at least, ties to ten digits by id. ``apart`` leaves out pairs of equal ids.
    """
    spark = left.sparkSession
    hashed, tasks = isinstance(distance, Pair), max(spark.sparkContext.defaultParallelism, 1)
    nu, nk = left_ids.select("u").distinct().count(), right_ids.select("k").distinct().count()
    bu = max(-(-nu // block), 1)
    bk = max(-(-nk // block), min(-(-tasks // bu), -(-nk // min(LEAST_BLOCK, block))), 1)
    more = ("author",) if keep != "pairs" else ()
    l, r = _arrays(left_ids, left, "u", hashed), _arrays(right_ids, right, "k", hashed, more)
    l = l.withColumn("bu", F.pmod(F.xxhash64("u"), F.lit(bu))).withColumn("bk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bk - 1).cast("long"))))
    r = r.withColumn("bk", F.pmod(F.xxhash64("k"), F.lit(bk))).withColumn("bu", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bu - 1).cast("long"))))
    ku, kk = left_ids.schema["u"].dataType.simpleString(), right_ids.schema["k"].dataType.simpleString()
    schema = {"pairs": f"u {ku}, k {kk}, dist double", "authors": f"u {ku}, author string, score double", "nearest": f"u {ku}, k {kk}, author string, dist double"}[keep]
    names = {"pairs": ["u", "k", "dist"], "authors": ["u", "author", "score"], "nearest": ["u", "k", "author", "dist"]}[keep]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            empty = {"u": a.schema.field("u").type, "k": b.schema.field("k").type, "author": pa.string(), "dist": pa.float64(), "score": pa.float64()}
            return pa.table({c: pa.array([], empty[c]) for c in names})
        us, ks, dist = matrix(a, b, distance)
        i, j = np.divmod(np.arange(dist.size), dist.shape[1])
        flat = dist.ravel()
        if apart:
            both = pa.concat_arrays([us, ks]).dictionary_encode().indices.to_numpy()
            some = np.flatnonzero(both[: len(us)][i] != both[len(us) :][j])
            i, j, flat = i[some], j[some], flat[some]
        if keep == "pairs":
            return pa.table([us.take(pa.array(i)), ks.take(pa.array(j)), pa.array(flat)], names=names)
        author = b.column("author").combine_chunks()
        if keep == "authors":
            codes = author.dictionary_encode()
            own, n = codes.indices.to_numpy(zero_copy_only=False)[j], len(codes.dictionary)
            best = np.full(len(us) * n, np.inf)
            seen = np.zeros(len(us) * n, bool)
            np.minimum.at(best, i * n + own, flat)
            seen[i * n + own] = True
            at = np.flatnonzero(seen)
            return pa.table([us.take(pa.array(at // n)), codes.dictionary.take(pa.array(at % n)), pa.array(best[at])], names=names)
        rank_k = np.argsort(np.argsort(np.array(ks.to_pylist(), object), kind="stable"), kind="stable")
        order = np.lexsort((rank_k[j], np.round(flat, 10), i))
        i, j, flat = i[order], j[order], flat[order]
        at = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) < k)
        return pa.table([us.take(pa.array(i[at])), ks.take(pa.array(j[at])), author.take(pa.array(j[at])), pa.array(flat[at])], names=names)

    return l.groupBy("bu", "bk").cogroup(r.groupBy("bu", "bk")).applyInArrow(run, schema)
