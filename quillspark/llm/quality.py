"""Quality: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer.

Eight labellers each call a text good (1), bad (0) or abstain (-1): symbols, capitals, repeated words, repeated lines, sentence ends,
separators, word length, exclamation marks. Votes of all documents are counted by pattern (at most 3**8 patterns, whatever
the size of the table), and expectation-maximisation estimates from these counts how often each labeller gives each vote to good and to bad
texts, and so the posterior of each pattern. A logistic scorer over hashed character-shape n-grams and word-repetition
features is then fitted to the posteriors of at most ``max_docs`` whole documents (chosen by hash of the id), and scores every document.

Cases: a null text, or one without words, has a null posterior and score and is not kept. A null id is scored. Repeated rows are
scored alike. With no documents nothing is fitted and the result is empty; if all documents have one pattern, its majority vote decides.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow
from .textcore import Words, mix, segment_sum, slices, text_slices

LABELLERS = ("symbols", "capitals", "words", "lines", "sentences", "separators", "word_length", "exclamations")
BUCKETS = 1 << 14
_STEP = np.uint64(0x9FB21C651E98DF25)


def _classes() -> np.ndarray:
    """Shape of a code point: 1 lower-case or other letter, 2 capital, 3 digit, 4 space, 5 line end, 6 other, and each ASCII mark by itself."""
    shape = np.full(0x600, 6, np.uint8)
    for c in range(0x600):
        s = chr(c)
        if s == "\n":
            shape[c] = 5
        elif s.isspace():
            shape[c] = 4
        elif s.isdigit():
            shape[c] = 3
        elif s.isalpha():
            shape[c] = 2 if s.isupper() else 1
        elif c < 128:
            shape[c] = 10 + c
    return shape


_SHAPE = _classes()


class View:
    """Shapes, lines and word counts of some texts, and from them votes and hashed features."""

    def __init__(self, texts: list[str | None]):
        w = self.w = Words(texts)
        self.base = w.base
        self.shape = _SHAPE[np.minimum(w.raw, 0x5FF)]
        self.n_words = w.counts
        doc = w.doc_of_word()
        order = np.lexsort((w.hash, doc))
        h, d = w.hash[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        self.distinct = np.bincount(d[at], minlength=len(texts))
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(np.diff(np.append(at, len(h))), np.diff(np.append(at, len(h))))
        self.count = count

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return segment_sum(flags.astype(np.int64), self.base)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that hold a word, and those of them that stood before, by text."""
        w = self.w
        line = np.concatenate([[0], np.cumsum(self.shape == 5)])[w.start]
        doc = w.doc_of_word()
        if not len(line):
            zero = np.zeros(len(self.n_words), np.int64)
            return zero, zero
        first = np.ones(len(line), bool)
        first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        end = w.end[np.append(at[1:], len(line)) - 1]
        h, d = w.span_hash(w.start[at], end), doc[at]
        order = np.lexsort((h, d))
        again = np.zeros(len(h), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
        return np.bincount(d, minlength=len(self.n_words)), np.bincount(d[order], again, len(self.n_words)).astype(np.int64)

    def votes(self) -> np.ndarray:
        """(texts, labellers) of 1, 0 and -1."""
        s, n = self.shape, np.maximum(self.n_words, 1)
        letters, capitals = self.per_text((s == 1) | (s == 2)), self.per_text(s == 2)
        ends = self.per_text((s == 10 + ord(".")) | (s == 10 + ord("?")) | (s == 10 + ord("!")))
        shouts, bars = self.per_text(s == 10 + ord("!")), self.per_text((s == 10 + ord("|")) | (self.w.raw == 9))
        odd = np.isin(s, [10 + ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\/"]) | (s == 6)
        symbols = self.per_text(odd)
        chars = np.maximum(np.diff(self.base) - 1, 1)
        n_lines, again = self.lines()

        def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
            return np.where(bad, 0, np.where(good, 1, -1))

        share_distinct = self.distinct / n
        # long texts repeat more words by nature: compared with the square root of their length
        low = np.minimum(0.4, 4 / np.sqrt(n))
        return np.stack(
            [
                vote(symbols / chars < 0.01, symbols / chars > 0.04),
                vote(capitals < 0.2 * letters, capitals > 0.5 * letters),
                np.where(self.n_words < 20, -1, vote(share_distinct > low, share_distinct < low / 2)),
                np.where(n_lines < 3, -1, vote(again < 0.1 * n_lines, again > 0.3 * n_lines)),
                np.where(self.n_words < 20, -1, vote((ends * 40 > n) & (ends < n), (ends * 80 < n) | (ends > n))),
                vote(bars < 0.02 * n, bars > 0.2 * n),
                np.where(self.n_words < 5, -1, vote((letters < 10 * n) & (letters > 2 * n), (letters > 20 * n) | (letters < n))),
                vote(shouts < 0.05 * n, shouts > 0.3 * n),
            ],
            axis=1,
        )

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features in text order, and their offsets by text: shape n-grams of 1 to 4, and how often each word stands in its text."""
        s = self.shape.astype(np.uint64)
        doc = np.repeat(np.arange(len(self.n_words)), np.diff(self.base))
        parts, docs = [], []
        h = np.zeros(len(s), np.uint64)
        for n in range(1, 5):
            h = h[: len(s) - n + 1] * _STEP + s[n - 1 :]
            inside = doc[: len(h)] == doc[n - 1 :]
            parts.append((mix(h + np.uint64(n)) % np.uint64(BUCKETS))[inside])
            docs.append(doc[: len(h)][inside])
        wdoc = self.w.doc_of_word()
        share = np.minimum(np.log2(self.count).astype(np.uint64), np.uint64(12)) * np.uint64(16) + np.log2(np.maximum(self.n_words[wdoc], 1)).astype(np.uint64) // np.uint64(2)
        parts.append(mix(share + np.uint64(0xABCDEF)) % np.uint64(BUCKETS))
        docs.append(wdoc)
        return parts, docs

    def means(self, weight: np.ndarray) -> np.ndarray:
        """Sum over feature families of the mean weight of the family's features, by text."""
        out = np.zeros(len(self.n_words))
        for f, d in zip(*self.features(), strict=True):
            n = np.bincount(d, minlength=len(out))
            out += np.bincount(d, weight[f.astype(np.int64)], len(out)) / np.maximum(n, 1)
        return out


def pattern_number(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def pattern_votes(number: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return (number[:, None] // 3 ** np.arange(labellers)) % 3 - 1


@dataclass(frozen=True)
class Weak:
    """Posterior of being good by pattern number, and each labeller's vote shares: accuracy[l, class, vote + 1] (1 for abstentions)."""

    posterior: np.ndarray
    accuracy: np.ndarray
    prior: float


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 1.0, odds: float = 1.0, most: float = 0.02) -> Weak:
    """Estimate labeller accuracies from distinct vote patterns and their counts.

    Two assumptions keep the classes what they are called: a labeller calls at most ``most`` of the good texts bad, and the prior odds of
    the classes are ``odds`` (each kind of bad text is rare and seen by few labellers, so the estimated share would outvote them).
    """
    m = votes.shape[1]
    total = counts.sum()
    post = np.where((votes == 0).any(axis=1), 0.1, np.where((votes == 1).any(axis=1), 0.95, 0.5))
    for _ in range(rounds):
        acc = np.ones((m, 2, 3))  # an abstention tells nothing
        for l in range(m):
            for v in (0, 1):
                at = votes[:, l] == v
                acc[l, 1, v + 1] = (post[at] * counts[at]).sum() + smooth
                acc[l, 0, v + 1] = ((1 - post[at]) * counts[at]).sum() + smooth
        acc[:, :, 1:] /= acc[:, :, 1:].sum(axis=2, keepdims=True)
        acc[:, 1, 1] = np.minimum(acc[:, 1, 1], most)
        acc[:, 1, 2] = 1 - acc[:, 1, 1]
        ratio = np.log(odds) + sum(np.log(acc[l, 1, votes[:, l] + 1] / acc[l, 0, votes[:, l] + 1]) for l in range(m))
        new = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    share = np.clip(counts[post > 0.5].sum() / total, 0.02, 0.98)  # with the classes found, their share counts
    prior = float(share)
    post = 1 / (1 + np.exp(-np.clip(ratio - np.log(odds) + np.log(share / (1 - share)), -30, 30)))
    full = np.full(3**m, np.nan)
    full[pattern_number(votes)] = post
    return Weak(full, acc, prior)


def vote_counts(docs: DataFrame) -> DataFrame:
    """(pattern, n) over all documents that have words."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, texts in text_slices(batch.column(1)):
            v = View(texts)
            p, n = np.unique(pattern_number(v.votes())[v.n_words > 0], return_counts=True)
            yield {"pattern": p.astype(np.int32), "n": n}

    return map_arrow(docs, run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    weak: Weak
    weight: np.ndarray
    bias: float

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of the labellers, score of the linear scorer, and whether there is anything to judge."""
        v = View(texts)
        post = self.weak.posterior[pattern_number(v.votes())]
        z = v.means(self.weight) + self.bias
        return post, 1 / (1 + np.exp(-np.clip(z, -30, 30))), v.n_words > 0


def fit_scorer(texts: list[str], target: np.ndarray, rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on family means of hashed features, by gradient descent with momentum."""
    rows, cols, vals = [], [], []
    for lo, hi in slices(texts):
        v = View(texts[lo:hi])
        for f, d in zip(*v.features(), strict=True):
            key, n = np.unique(d * BUCKETS + f.astype(np.int64), return_counts=True)
            size = np.bincount(d, minlength=hi - lo)
            rows.append(key // BUCKETS + lo)
            cols.append(key % BUCKETS)
            vals.append(n / size[key // BUCKETS])
    weight, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weight, bias
    r, c, x = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    scale = 1 / np.sqrt(np.bincount(c, x * x, BUCKETS) / len(texts) + 1e-4)  # diagonal preconditioning
    mom, mb = np.zeros(BUCKETS), 0.0
    share = np.clip(target.mean(), 0.02, 0.98)
    balance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weight[c] * x, len(texts)) + bias, -30, 30)))
        g = (p - target) * balance / len(texts)
        mom = 0.9 * mom + np.bincount(c, g[r] * x, BUCKETS) * scale**2 * 0.02 + l2 * weight
        mb = 0.9 * mb + g.sum()
        weight = weight - rate * mom
        bias -= rate * mb
    return weight.astype(np.float32), float(bias)


def train(docs: DataFrame, max_docs: int = 2000) -> Model:
    docs = id_text(docs)
    rows = vote_counts(docs).collect()
    if not rows:
        return Model(Weak(np.full(3 ** len(LABELLERS), np.nan), np.zeros((len(LABELLERS), 2, 3)), 0.5), np.zeros(BUCKETS), 0.0)
    rows.sort()
    weak = expectation_maximisation(pattern_votes(np.array([r[0] for r in rows])), np.array([r[1] for r in rows], float))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct()
    ids = [r[0] for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    texts = sorted((r[0], r[1]) for r in docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).collect())
    texts = [t for _, t in texts]
    posts = [weak.posterior[pattern_number(View(texts[lo:hi]).votes())] for lo, hi in slices(texts)]
    target = np.nan_to_num(np.concatenate(posts), nan=0.0) if posts else np.zeros(0)
    return Model(weak, *fit_scorer(texts, target))


def judged(docs: DataFrame, model: Model | None = None, threshold: float = 0.5, max_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, posterior, score, keep) for every row: posterior of the labellers, score of the linear scorer, whether it reaches the threshold."""
    rows = id_text(docs, id_col, text_col)
    model = train(rows, max_docs) if model is None else model

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, texts in text_slices(batch.column(1)):
            post, score, some = model.judge(texts)
            yield {
                "doc_id": batch.column(0)[lo:hi], "posterior": pa.array(post, mask=~some | np.isnan(post)), "score": pa.array(score, mask=~some),
                "keep": some & (score >= threshold),
            }

    return map_arrow(rows, run, "doc_id long, posterior double, score double, keep boolean")
