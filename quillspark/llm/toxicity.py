"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with boundary marks) and itself, hashed into
buckets; each bucket has a vector. A passage of ``window`` words is the mean of its words'
vectors and goes through a two-class linear softmax (with a fixed gain); a document's probability is that of its most toxic
passage, so a long text does not dilute a short insult, and a misspelling shares
most n-grams with the word it hides. Vectors and softmax are fitted together by gradient descent with momentum on whole texts
of at most ``max_labelled`` labelled documents (chosen by hash of the id, half of each class); gradients go through
each document's most toxic passage. After a warm-up, toxic-labelled documents in which
nothing looks toxic are taken for wrong labels and no longer counted.

Cases: a null or wordless text has probability 0 and is kept, as is a null id (it is scored
but never fitted on). Labels that are null are ignored; an id with differing labels takes the larger.
With no labelled documents of both classes nothing is toxic. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow
from .textcore import Words, give_back, mix, slices, text_slices

BUCKETS, WINDOW, DIM = 1 << 17, 16, 8
GAIN = WINDOW
LEAST_LIFT = np.log(3)
_GRAM = np.uint64(0x9FB21C651E98DF25)


def word_grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: (row by word, bucket by gram, row by gram)."""
    _, first, row = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], (w.end - w.start)[first] + 2
    off = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    src = np.arange(off[-1]) - off[owner] + start[owner] - 1
    cp = w.cp[np.clip(src, 0, len(w.cp) - 1)].astype(np.uint64)
    cp[off[:-1]], cp[off[1:] - 1] = 2, 3
    buckets, rows = [w.hash[first] % np.uint64(BUCKETS)], [np.arange(len(size))]
    for n in range(3, 7):
        m = len(cp) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * _GRAM + cp[j : j + m]
        at = np.flatnonzero(owner[:m] == owner[n - 1 :])
        buckets.append(mix(h[at]) % np.uint64(BUCKETS))
        rows.append(owner[at])
    return row, np.concatenate(buckets).astype(np.int32), np.concatenate(rows).astype(np.int32)


def passages(score: np.ndarray, offset: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Highest mean over ``window`` successive words of each text (over all of a shorter one), where it begins, its words."""
    counts = np.diff(offset)
    size = np.minimum(counts, window)
    c = np.concatenate([[0.0], np.cumsum(score)])
    n = np.where(counts > 0, counts - size + 1, 0)
    off = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(off[-1]) - off[doc] + offset[doc]
    mean = (c[at + size[doc]] - c[at]) / np.maximum(size[doc], 1)
    best, where = np.full(len(counts), -np.inf), np.zeros(len(counts), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        best[full] = np.maximum.reduceat(mean, off[full])
        hit = np.flatnonzero(mean >= best[doc])[::-1]
        where[doc[hit]] = at[hit]
    return best, where, size


@dataclass(frozen=True)
class Model:
    """Score of each bucket (its vector times the softmax's difference row), and the bias."""

    bucket: np.ndarray
    bias: float

    def probability(self, texts: list[str | None]) -> np.ndarray:
        w = Words(texts)
        if not len(w):
            return np.zeros(len(texts))
        row, bucket, rows = word_grams(w)
        score = np.bincount(rows, self.bucket[bucket]) / np.bincount(rows)
        z = passages(score[row], w.offset)[0] + self.bias
        return np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


class Bag:
    """The words of a sample as rows of distinct words, and these as buckets; built slice by slice to stay small.

    ``row``: distinct word by word; ``offset``: first word of each text; the buckets of distinct word r are ``bucket[begin[r]:begin[r + 1]]``.
    """

    def __init__(self, texts: list[str]):
        hashes, counts, known, buckets, sizes = [], [], np.zeros(0, np.uint64), [], []
        for lo, hi in slices(texts):
            w = Words(texts[lo:hi])
            hashes.append(w.hash)
            counts.append(w.counts)
            if not len(w):
                continue
            _, bucket, rows = word_grams(w)
            distinct = np.unique(w.hash)
            fresh = ~np.isin(distinct, known)
            pick = fresh[rows]
            order = np.argsort(rows[pick], kind="stable")
            buckets.append(bucket[pick][order])
            sizes.append(np.bincount(rows, minlength=len(distinct))[fresh])
            known = np.concatenate([known, distinct[fresh]])
        self.offset = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        self.bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        order = np.argsort(known)
        self.row = order[np.searchsorted(known[order], np.concatenate(hashes))].astype(np.int32) if len(known) else np.zeros(0, np.int32)

    def documents(self, toxic: np.ndarray) -> np.ndarray:
        """How many toxic and how many other texts each bucket occurs in."""
        seen, flag = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, bool)
        for d in range(len(toxic)):
            ws = np.unique(self.row[self.offset[d] : self.offset[d + 1]])
            n = self.begin[ws + 1] - self.begin[ws]
            b = self.bucket[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[ws], n)]
            flag[b] = True
            seen[0 if toxic[d] else 1] += flag
            flag[b] = False
        return seen


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 60, seed: int = 7, min_docs: int = 3) -> Model:
    """Jointly fit bucket vectors and softmax on whole texts with 0/1 labels.

    The vectors start along the softmax row by one preconditioned step from zero (how many times, in logarithms and
    less two standard errors, each bucket's share of toxic texts is above its share of the others, from three times on),
    which tells where the first passages lie; then each epoch follows the gradient through every text's most toxic passage.
    Buckets seen in fewer than ``min_docs`` texts keep a zero vector.
    """
    y = np.asarray(toxic, float)
    bag = Bag(texts)
    if not len(bag.row) or not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), -50.0)
    row, bucket, begin, offset = bag.row, bag.bucket, bag.begin, bag.offset
    grams = np.diff(begin)
    in_toxic, in_other = bag.documents(y > 0)
    n1, n0 = y.sum(), (1 - y).sum()
    known = in_toxic + in_other >= min_docs
    p1, p0 = in_toxic / n1, in_other / n0
    low = np.maximum(p1 - 2 * np.sqrt(p1 * (1 - p1) / n1), 1e-9)
    high = p0 + 2 * np.sqrt(p0 * (1 - p0) / n0) + 1 / n0
    lift = np.clip(np.log(low / high) - LEAST_LIFT, 0, 3)
    rng = np.random.default_rng(seed)
    soft = rng.normal(0, 1, DIM)
    soft /= np.linalg.norm(soft)
    vec = (rng.normal(0, 0.01, (BUCKETS, DIM)) + lift[:, None] * 1.5 * soft) * known[:, None]
    bias, mv, ms, mb = -3.0, np.zeros((BUCKETS, DIM)), np.zeros(DIM), 0.0
    has = np.diff(offset) > 0
    balance = np.where(y > 0, 0.2 / n1, 0.8 / n0) * has  # about one labelled document in five or fewer is toxic
    for t in range(1, epochs + 1):
        score = np.add.reduceat((vec @ soft).astype(np.float32)[bucket], begin[:-1]) / grams
        z, where, size = passages(GAIN * score[row], offset)
        p = 1 / (1 + np.exp(-np.clip(np.where(has, z, -50) + bias, -50, 50)))
        g = (p - y) * balance * np.where((t > epochs // 2) & (y > 0) & (p < 0.3), 0.0, 1.0)
        doc = np.repeat(np.arange(len(y)), size)
        words = row[np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + where[doc]]
        per_word = np.bincount(words, (GAIN * g / np.maximum(size, 1))[doc], len(grams)) / grams
        used = np.flatnonzero(per_word)
        spread = np.repeat(used, grams[used])
        src = np.arange(len(spread)) - np.repeat(np.cumsum(grams[used]) - grams[used], grams[used]) + begin[spread]
        per_bucket = np.bincount(bucket[src], per_word[spread], BUCKETS) * known
        mv = 0.7 * mv + per_bucket[:, None] * soft
        ms = 0.7 * ms + per_bucket @ vec
        mb = 0.7 * mb + g.sum()
        rate = 0.3 if t <= epochs // 2 else 0.1
        vec -= rate * mv / max(np.abs(mv).max(), 1e-3)
        soft -= 0.02 * rate * ms / max(np.abs(ms).max(), 1e-3)
        bias -= rate * mb / max(abs(mb), 0.05)
    return Model((GAIN * (vec @ soft)).astype(np.float32), float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> tuple[list[str], np.ndarray]:
    """Whole texts of at most max_labelled labelled documents, half of each class, chosen by hash of the id."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    lab = lab.where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    half = max(1, max_labelled // 2)
    mark = F.xxhash64("doc_id")
    pick = lab.where("y = 1").orderBy(mark, "doc_id").limit(half).unionByName(lab.where("y = 0").orderBy(mark, "doc_id").limit(half))
    ids = {r[0]: r[1] for r in pick.toLocalIterator()}
    if not ids:
        return [], np.zeros(0)
    rows = docs.where(F.col("doc_id").isin(list(ids)) & F.col("text").isNotNull()).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return [r[1] for r in rows], np.array([ids[r[0]] for r in rows])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 2000) -> Model:
    return fit(*labelled_sample(id_text(docs), labels, "toxic", max_labelled))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability) for every row."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        p = [model.probability(texts) for _, _, texts in text_slices(batch.column(1))]
        yield {"doc_id": batch.column(0), "probability": np.concatenate(p)}

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, probability double")


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, max_labelled: int = 2000) -> DataFrame:
    """(doc_id, probability, toxic) for each row at or above the threshold: what a filter takes out."""
    return scored(docs, train(docs, labels, max_labelled)).where(F.col("probability") >= threshold).withColumn("toxic", F.lit(True))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.6, max_labelled: int = 2000) -> DataFrame:
    """The rows of docs below the threshold, all columns as they are, judged in one pass over the text."""
    model = train(docs, labels, max_labelled)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        p = [model.probability(texts) < threshold for _, _, texts in text_slices(text)]
        give_back()
        return pa.array(np.concatenate(p) if p else np.zeros(0, bool))

    return docs.where(clean(F.col("text").cast("string")))
