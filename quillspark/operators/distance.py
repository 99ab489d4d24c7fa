"""Distances between event histograms, for many pairs at once.

Most distances sum something over the union of two histograms' events. With marginals of each document for the events
that only one side has, an inner join on the event is enough: sum over the union = L(left) + R(right) + sum over shared
events of (S - L - R). A ``Pair`` holds these terms; documents without a shared event survive through the grid of ids.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import DISTANCES, Param

TINY = "1e-10D"
HIST = "doc_id, event, cnt"


@dataclass(frozen=True)
class Pair:
    """SQL over p, q (relative frequencies) and c1, c2 (counts): ``terms`` are (left only, right only, shared); ``final`` reads
    their sums x0, x1, ... and the marginals t1 t2 (totals), n1 n2 (events), s1 s2 (sums of squares), n (events of the union)."""

    terms: tuple[tuple[str, str, str], ...]
    final: str


@dataclass(frozen=True)
class Aligned:
    """A function of two histograms (dicts of counts) for distances that do not decompose; ``tau`` names Kendall's, which ``tau_matrix`` has for many pairs."""

    fn: Callable[[dict[str, int], dict[str, int]], float]
    tau: str = ""


_NONE = "((t1 = 0) OR (t2 = 0))"
_COS = "greatest(-1D, least(1D, x0 / sqrt(s1 * s2)))"


def _pair(name: str, terms: list[tuple[str, str, str]], final: str, about: str) -> None:
    DISTANCES.register(name, about=about)(lambda: Pair(tuple(terms), final))


# of counts: sums of whole numbers do not depend on their order, so equal pairs have equal distances to the last bit
_pair(
    "cosine", [("0", "0", "c1*c2"), ("c1*c1", "0", "c1*c1"), ("0", "c2*c2", "c2*c2")],
    f"CASE WHEN {_NONE} THEN 1D ELSE 1 - greatest(-1D, least(1D, x0 / (sqrt(x1) * sqrt(x2)))) END", "One minus the cosine.",
)
_pair("manhattan", [("p", "q", "abs(p-q)")], "greatest(x0, 0D)", "Sum of absolute differences.")
_pair("euclidean", [("p*p", "q*q", "(p-q)*(p-q)")], "sqrt(greatest(x0, 0D))", "Root of the sum of squared differences.")
_pair("chi_square", [("0", "q", "(p-q)*(p-q)/q")], "greatest(x0, 0D)", "Squared differences over the right frequency.")
_pair("kl_divergence", [(f"p*ln(p/{TINY})", "0", "p*ln(p/q)")], "x0", "Kullback-Leibler divergence.")
_pair("cross_entropy", [(f"-p*ln({TINY})", "0", "-p*ln(q)")], "x0", "Cross entropy in nats.")
_pair("hellinger", [("p", "q", "pow(sqrt(p)-sqrt(q), 2)")], "sqrt(greatest(x0, 0D)) / sqrt(2D)", "Hellinger distance.")
_pair("bhattacharyya", [("0", "0", "sqrt(p*q)")], "CASE WHEN x0 <= 0 THEN double('Infinity') ELSE greatest(0D, -ln(least(x0, 1D))) END", "Minus the logarithm of the Bhattacharyya coefficient.")
_pair("bray_curtis", [("p", "q", "abs(p-q)"), ("p", "q", "p+q")], "CASE WHEN x1 = 0 THEN 0D ELSE greatest(x0, 0D) / x1 END", "Differences over sums.")
_pair("canberra", [("1", "1", "abs(p-q)/(p+q)")], "greatest(x0, 0D)", "Sum of relative differences.")
_pair("intersection", [("0", "0", "least(p,q)")], "1 - x0", "One minus the common mass.")
_pair("histogram_intersection", [("0", "0", "least(c1,c2)")], f"CASE WHEN {_NONE} THEN 1D ELSE 1 - x0 / least(t1, t2) END", "One minus the common counts over the smaller total.")
_pair(
    "pearson_correlation", [("0", "0", "p*q"), ("p", "q", "p+q")],
    # a vector is constant over the union if it covers it with equal counts, or has nothing
    "CASE WHEN n = 0 OR t1 = 0 OR t2 = 0 OR (n1 = n AND lo1 = hi1) OR (n2 = n AND lo2 = hi2) THEN 1D"
    " ELSE 1 - (n * x0 - 1) / sqrt((n * s1 - 1) * (n * s2 - 1)) END",
    "One minus the correlation.",
)
_pair("keselj_weighted", [("1", "1", "pow((p-q)/(p+q), 2)")], "greatest(x0, 0D)", "Sum of squared relative differences.")
_pair("stamatatos", [("4", "4", "pow(2*(p-q)/(p+q), 2)")], "greatest(x0, 0D)", "Squared differences over means.")
_pair("angular_separation", [("0", "0", "p*q")], f"CASE WHEN {_NONE} THEN 1D ELSE acos({_COS}) / pi() END", "Angle over pi.")
_pair("chord", [("0", "0", "p*q")], f"CASE WHEN {_NONE} THEN sqrt(2D) ELSE sqrt(greatest(0D, 2 * (1 - {_COS}))) END", "Chord between unit vectors.")
_pair("matusita", [("p", "q", "pow(sqrt(p)-sqrt(q), 2)")], "sqrt(greatest(x0, 0D))", "Distance of the square roots.")
_pair("soergel", [("p", "q", "abs(p-q)"), ("p", "q", "greatest(p,q)")], "CASE WHEN x1 = 0 THEN 0D ELSE greatest(x0, 0D) / x1 END", "Differences over maxima.")
_pair("wave_hedges", [("1", "1", "1 - least(p,q)/greatest(p,q)")], "greatest(x0, 0D)", "Sum of one minus minimum over maximum.")
_pair("wed", [("p*p*p", "q*q", "p*(p-q)*(p-q)")], "sqrt(greatest(x0, 0D))", "Euclidean, weighted by the left frequency.")
_pair("nominal_ks", [("p/2", "q/2", "abs(p-q)/2")], "greatest(x0, 0D)", "Half the absolute differences.")


def _ranks(h1: dict[str, int], h2: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    t1, t2 = max(sum(h1.values()), 1), max(sum(h2.values()), 1)
    keys = sorted(set(h1) | set(h2))
    return np.array([h1.get(k, 0) / t1 for k in keys]), np.array([h2.get(k, 0) / t2 for k in keys])


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """(concordant minus discordant pairs, pairs tied in x, tied in y, tied in both), counted by merge sort in n log n."""
    def tied(*cols: np.ndarray) -> int:
        _, c = np.unique(np.stack(cols, axis=1), axis=0, return_counts=True)
        return int((c * (c - 1) // 2).sum())

    n = len(x)
    tx, ty, both = tied(x), tied(y), tied(x, y)
    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1]
    discordant, width = 0, 1
    while width < n:  # inversions between neighbouring sorted runs
        for lo in range(0, n - width, 2 * width):
            a, b = rank[lo : lo + width], rank[lo + width : lo + 2 * width]
            discordant += int((len(a) - np.searchsorted(a, b, "right")).sum())
        for lo in range(0, n, 2 * width):
            rank[lo : lo + 2 * width] = np.sort(rank[lo : lo + 2 * width], kind="stable")
        width *= 2
    total = n * (n - 1) // 2
    return total - tx - ty + both - 2 * discordant, tx, ty, both


@DISTANCES.register("kendall_correlation")
def kendall_correlation() -> Aligned:
    """One minus Kendall's tau-a, halved."""
    def fn(h1: dict[str, int], h2: dict[str, int]) -> float:
        x, y = _ranks(h1, h2)
        if len(x) < 2:
            return 0.0
        return (1 - concordance(x, y)[0] / (len(x) * (len(x) - 1) / 2)) / 2

    return Aligned(fn, "a")


@DISTANCES.register("kendall_tau_b")
def kendall_tau_b() -> Aligned:
    """One minus Kendall's tau-b, halved; pairs tied on both sides do not count."""
    def fn(h1: dict[str, int], h2: dict[str, int]) -> float:
        x, y = _ranks(h1, h2)
        if len(x) < 2:
            return 0.0
        s, tx, ty, both = concordance(x, y)
        total = len(x) * (len(x) - 1) // 2
        # without the pairs tied on one side only, and those tied on both
        a, b = total - both - (tx - both), total - both - (ty - both)
        return (1 - s / math.sqrt(a * b)) / 2 if a * b > 0 else 0.0

    return Aligned(fn, "b")


def tau_matrix(left, right, width: int, tau: str) -> np.ndarray:
    """Kendall distances of all left to all right documents (``blocks.Side`` over ``width`` places), pairs of events as columns of a matrix product.

    Products run over the whole vocabulary. An event that neither document has is no pair's part: with one that both have it counts as concordant, with one
    that neither has as tied, and both are taken off again.
    """
    i, j = np.triu_indices(width, 1)

    def counts(s) -> np.ndarray:
        m = np.zeros((len(s.ids), width))
        m[s.doc, s.event] = s.cnt
        return m

    def sign(m: np.ndarray) -> np.ndarray:
        return np.sign(m[:, i] - m[:, j]).astype(np.float32)

    def tied(m: np.ndarray) -> np.ndarray:  # pairs of equal counts among the events a document has
        s = np.sort(m, axis=1)
        run = np.ones(s.shape)
        for k in range(1, width):
            run[:, k] = np.where(s[:, k] == s[:, k - 1], run[:, k - 1] + 1, 1)
        return np.where(s > 0, run - 1, 0).sum(axis=1)

    two = lambda n: n * (n - 1) / 2
    q = counts(right)
    sq, hq, tq = sign(q), (q > 0).astype(float), tied(q)
    flat_q = (sq == 0).astype(np.float32)
    out = np.zeros((len(left.ids), len(q)))
    p_all = counts(left)
    step = max(1, (1 << 23) // max(len(i), 1))
    for a in range(0, len(p_all), step):
        p = p_all[a : a + step]
        sp, hp = sign(p), (p > 0).astype(float)
        common = hp @ hq.T
        n = hp.sum(axis=1)[:, None] + hq.sum(axis=1)[None] - common
        neither = width - n
        s = (sp @ sq.T).astype(float) - neither * common
        if tau == "a":
            with np.errstate(all="ignore"):
                out[a : a + step] = np.where(n < 2, 0.0, (1 - s / (n * (n - 1) / 2)) / 2)
            continue
        tx = tied(p)[:, None] + two(n - hp.sum(axis=1)[:, None])
        ty = tq[None] + two(n - hq.sum(axis=1)[None])
        both = ((sp == 0).astype(np.float32) @ flat_q.T).astype(float) - two(neither) - neither * (n - hp.sum(axis=1)[:, None] - hq.sum(axis=1)[None] + common)
        total = n * (n - 1) / 2
        x, y = total - both - (tx - both), total - both - (ty - both)
        with np.errstate(all="ignore"):
            out[a : a + step] = np.where((n >= 2) & (x * y > 0), (1 - s / np.sqrt(x * y)) / 2, 0.0)
    return out


#: Sums of up to 2**24 ones are exact in single precision, and the signs of all profiles lie in memory.
tau_matrix.fits = lambda width, profiles: width * (width - 1) // 2 <= 1 << 24 and width * width * profiles <= 1 << 26


def sequence(h: dict[str, int]) -> str:
    """Events in order, each as often as it occurs."""
    return " ".join(" ".join([e] * h[e]) for e in sorted(h) if h[e] > 0)


@DISTANCES.register("ncd")
def ncd() -> Aligned:
    """Normalised compression distance (gzip) of the sorted events."""
    def size(s: bytes) -> int:
        return len(gzip.compress(s, 9))

    def fn(h1: dict[str, int], h2: dict[str, int]) -> float:
        a, b = sequence(h1).encode(), sequence(h2).encode()
        if not a or not b:
            return 1.0
        x, y = size(a), size(b)
        return (size(a + b" " + b) - min(x, y)) / max(x, y)

    return Aligned(fn)


class ContextModel:
    """Counts of characters behind contexts of up to ``order`` characters.

    Training files a context under its latest character first, looking up follows it from its earliest on; so contexts of two
    characters and more match when read backwards. Results depend on this, so it stays.
    """

    def __init__(self, order: int, text: str):
        self.order = order
        self.letters = max(len(set(text)), 1)
        self.total: dict[str, int] = {"": len(text)}
        self.count: dict[str, int] = {}
        for i, c in enumerate(text):
            path = ""
            self._add(path + c)
            for d in range(1, min(order, i) + 1):
                # a path is the start character of each longer context, one below the other
                path += text[i - d]
                self.total[path] = self.total.get(path, 0) + 1
                self._add(path + c)

    def _add(self, path: str) -> None:
        self.count[path] = self.count.get(path, 0) + 1

    def bits(self, text: str) -> float:
        out = 0.0
        for i, c in enumerate(text):
            p = 1 / self.letters
            for d in range(min(self.order, i), -1, -1):
                path = text[i - d : i]
                if (n := self.count.get(path + c)) and (t := self.total.get(path)):
                    p = n / t
                    break
            out -= math.log2(max(p, 1e-10))
        return out / len(text) if text else 0.0


@DISTANCES.register("ppm", Param("order", 5, 1, 16))
def ppm(order: int) -> Aligned:
    """Mean cross-entropy in bits of either text under a context model of the other."""
    models: dict[str, ContextModel] = {}

    def model(text: str) -> ContextModel:
        if text not in models:
            if len(models) > 64:
                models.clear()
            models[text] = ContextModel(order, text)
        return models[text]

    def fn(h1: dict[str, int], h2: dict[str, int]) -> float:
        a, b = sequence(h1), sequence(h2)
        return (model(a).bits(b) + model(b).bits(a)) / 2 if a and b else 1.0

    return Aligned(fn)


# --- evaluating a distance for all pairs of two sets of histograms ---


def marginals(hist: DataFrame, ids: DataFrame, side: str, terms: list[str], keys: list[str], id_col: str) -> DataFrame:
    """One row for each id (also without events): totals and sums over its own events."""
    f, c, t, n, s = ("p", "c1", "t1", "n1", "s1") if side == "left" else ("q", "c2", "t2", "n2", "s2")
    k = t[1]
    own = hist.groupBy(*keys).agg(
        F.count("*").alias(n), F.sum(f"{f}f").alias("_one"), F.sum(F.col(f) * F.col(f)).alias(s), F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}"),
        F.max(t).alias(t), *[F.sum(F.expr(x)).alias(f"{'l' if k == '1' else 'r'}{i}") for i, x in enumerate(terms)],
    ).drop("_one")
    return ids.join(own, keys, "left").fillna(0)


def _frequencies(hist: DataFrame, keys: list[str], left: bool) -> DataFrame:
    f, c, t = ("p", "c1", "t1") if left else ("q", "c2", "t2")
    hist = hist.where("cnt > 0")
    total = hist.groupBy(*keys).agg(F.sum("cnt").cast("double").alias(t))
    out = hist.join(total, keys).withColumn(c, F.col("cnt").cast("double")).withColumn(f, F.col(c) / F.col(t))
    return out.withColumn(f"{f}f", F.col(f)).drop("cnt")


def distances(left: DataFrame, right: DataFrame, left_ids: DataFrame, right_ids: DataFrame, distance: Pair | Aligned, by: list[str] | None = None) -> DataFrame:
    """(by..., u, k, dist) for every pair of left_ids (by..., u) and right_ids (by..., k); left is (by..., u, event, cnt), right (by..., k, event, cnt).

    ``by`` are columns on which both sides must agree (say, an iteration); without them all pairs are made.
    """
    by = by or []
    if isinstance(distance, Aligned):
        return _aligned(left, right, left_ids, right_ids, distance, by)
    p, q = _frequencies(left, [*by, "u"], True), _frequencies(right, [*by, "k"], False)
    lm = marginals(p, left_ids.select(*by, "u").distinct(), "left", [t[0] for t in distance.terms], [*by, "u"], "u")
    rm = marginals(q, right_ids.select(*by, "k").distinct(), "right", [t[1] for t in distance.terms], [*by, "k"], "k")
    shared = p.drop("t1").join(q.drop("t2"), [*by, "event"]).groupBy(*by, "u", "k").agg(
        F.count("*").alias("ns"), *[F.sum(F.expr(f"({s}) - ({l}) - ({r})")).alias(f"d{i}") for i, (l, r, s) in enumerate(distance.terms)]
    )
    grid = lm.join(rm, by) if by else lm.crossJoin(rm)
    both = grid.join(shared, [*by, "u", "k"], "left").fillna(0, ["ns", *[f"d{i}" for i in range(len(distance.terms))]])
    both = both.withColumn("n", F.col("n1") + F.col("n2") - F.col("ns"))
    for i in range(len(distance.terms)):
        both = both.withColumn(f"x{i}", F.col(f"l{i}").cast("double") + F.col(f"r{i}") + F.col(f"d{i}"))
    return both.select(*by, "u", "k", F.expr(distance.final).cast("double").alias("dist"))


def _aligned(left: DataFrame, right: DataFrame, left_ids: DataFrame, right_ids: DataFrame, distance: Aligned, by: list[str]) -> DataFrame:
    """Distances that need both histograms whole: each is one map, pairs are made of maps, Arrow batches go to Python."""
    def maps(h: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
        m = h.where("cnt > 0").groupBy(*by, key).agg(F.map_from_entries(F.collect_list(F.struct("event", "cnt"))).alias(name))
        return ids.select(*by, key).distinct().join(m, [*by, key], "left")

    fn = distance.fn

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(dict(x or {}), dict(y or {})) for x, y in zip(a, b, strict=True)], dtype=float)

    l, r = maps(left, left_ids, "u", "h1"), maps(right, right_ids, "k", "h2")
    both = l.join(r, by) if by else l.crossJoin(r)
    return both.select(*by, "u", "k", udf("h1", "h2").alias("dist"))


