"""Size-partitioned MinHash containment search: short items inside long texts, verified by exact shingle containment.

Items are partitioned by size (number of word shingles, in powers of two, and shingle length where an item is
shorter than one shingle). For a partition whose items have up to L shingles, a text is read in windows of
2 L shingles that begin every L, so any passage as long as an item lies whole in some window, however long the text is, and
the Jaccard similarity of a window that contains an item to the degree ``threshold`` has a known lower bound. Bands and
rows follow from this bound so that such a window meets the item with probability ``recall`` at least. What is met
is verified exactly on the strings: the share of the item's distinct shingles that the text has.

Band keys of the items are sent to the executors while they are at most ``BROADCAST_KEYS`` and the items' texts at most ``BROADCAST_CHARS``;
more items are searched by a shuffled equality join on the same keys, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, stored
from .textcore import Words, give_back, mix, text_slices

BROADCAST_KEYS, BROADCAST_CHARS = 1 << 20, 4 << 20
MAX_HASHES = 96  # while a band of two rows or more can do with them; low thresholds take bands of one row and as many hashes as they need
_A = (np.random.default_rng(20240607).integers(0, 2**63, 1 << 12, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


@dataclass(frozen=True)
class Part:
    """One partition of the items: shingle length, largest number of shingles, bands and rows."""

    k: int
    size: int
    bands: int
    rows: int


def bands_for(jaccard: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows (at most 4), then the fewest bands, that meet a pair of this similarity with this probability."""
    for rows in (4, 3, 2, 1):
        p = jaccard**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes or rows == 1 and bands <= len(_A):
            return bands, rows
    raise ValueError(f"a similarity of {jaccard:.4f} takes over {len(_A)} hashes for a recall of {recall}; the threshold is too low")


def part_of(n_words: int, k: int, threshold: float, recall: float) -> Part | None:
    if n_words <= 0:
        return None
    k = min(k, n_words)
    shingles = n_words - k + 1
    size = 1 << max(2, (shingles - 1).bit_length())
    least = size // 2 + 1 if size > 4 else 1
    shared = max(1, math.ceil(threshold * least))
    return Part(k, size, *bands_for(shared / (2 * size + least - shared), recall))


def band_keys(hashes: np.ndarray, starts: np.ndarray, part: Part, tag: int) -> Iterator[np.ndarray]:
    """By band, one key for each segment of hashes that begins at ``starts`` (no segment may be empty)."""
    key = None
    for j in range(part.bands * part.rows):
        low = np.minimum.reduceat(hashes * _A[j], starts)
        key = low if j % part.rows == 0 else mix(key) + low
        if j % part.rows == part.rows - 1:
            yield mix(key ^ np.uint64((tag << 8) + j // part.rows + 1))


def window_minima(hashes: np.ndarray, offset: np.ndarray, part: Part, tag: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The text of each window, and by band the windows' keys. A window is two neighbouring blocks of ``size`` shingles."""
    counts = np.diff(offset)
    blocks = -(-counts // part.size)
    first = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(counts)), blocks)
    starts = offset[doc] + (np.arange(len(doc)) - first[doc]) * part.size
    last = np.zeros(len(doc), bool)
    last[first[1:][blocks > 0] - 1] = True

    def keys() -> Iterator[np.ndarray]:
        key = None
        for j in range(part.bands * part.rows):
            low = np.minimum.reduceat(hashes * _A[j], starts)
            joined = low.copy()
            joined[:-1] = np.where(last[:-1], low[:-1], np.minimum(low[:-1], low[1:]))
            key = joined if j % part.rows == 0 else mix(key) + joined
            if j % part.rows == part.rows - 1:
                yield mix(key ^ np.uint64((tag << 8) + j // part.rows + 1))

    return doc, keys()


class Index:
    """The items: partitions, band keys and shingle sets. ``tag`` keeps the keys of partitions apart."""

    def __init__(self, ids: list, texts: list[str | None], k: int, threshold: float, recall: float):
        self.k, self.threshold = k, threshold
        w = Words(texts)
        self.ids = ids
        self.parts: dict[Part, int] = {}
        keys, owner = [], []
        grams: list[frozenset | None] = []
        for i in range(len(texts)):
            part = part_of(int(w.counts[i]), k, threshold, recall)
            words = word_list(w, i)
            grams.append(None if part is None else frozenset(tuple(words[j : j + part.k]) for j in range(len(words) - part.k + 1)))
            if part is None:
                continue
            tag = self.parts.setdefault(part, len(self.parts))
            one = Words([texts[i]])
            h, _ = one.shingles(part.k)
            for key in band_keys(h, np.zeros(1, np.int64), part, tag):
                keys.append(key[0])
                owner.append(i)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.owner = np.array(owner, np.int64)[order]
        self.grams = grams
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, w: Words) -> set[tuple[int, int]]:
        """(text, item) pairs that share a band key."""
        found: set[tuple[int, int]] = set()
        for part, tag in self.parts.items():
            h, offset = w.shingles(part.k)
            if not len(h):
                continue
            doc, keys = window_minima(h, offset, part, tag)
            for key in keys:
                at = np.flatnonzero(self.sieve[(key >> np.uint64(48)).astype(np.int64)])
                if not len(at):
                    continue
                lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
                for a, l, r in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    found.update((int(doc[a]), int(self.owner[x])) for x in range(l, r))
        return found

    def verified(self, w: Words, found: set[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """(text, item, containment) of the pairs that reach the threshold, by the strings."""
        out = []
        by_doc: dict[int, list[int]] = {}
        for d, i in found:
            by_doc.setdefault(d, []).append(i)
        for d in sorted(by_doc):
            words = word_list(w, d)
            sets: dict[int, set] = {}
            for i in sorted(by_doc[d]):
                k = len(next(iter(self.grams[i])))
                if k not in sets:
                    sets[k] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
                c = len(self.grams[i] & sets[k]) / len(self.grams[i])
                if c >= self.threshold:
                    out.append((d, i, c))
        return out


def word_list(w: Words, d: int) -> list[str]:
    a, b = w.offset[d], w.offset[d + 1]
    text = w.cp[w.base[d] : w.base[d + 1]].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[s:e] for s, e in zip(w.start[a:b] - w.base[d], w.end[a:b] - w.base[d], strict=True)]


def contained(
    docs: DataFrame, items: DataFrame, k: int, threshold: float, recall: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """(doc_id, item_id, containment) for each document and item (item_id, text) it contains to the threshold."""
    docs = id_text(docs, id_col, text_col)
    items = _items(items)
    index = _index(items, k, threshold, recall, broadcast_keys)
    if index is None:
        found = _joined(docs, items, k, threshold, recall)
    else:
        def search(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = batch.column(0).to_pylist()
            got: list[tuple] = []
            for lo, _, texts in text_slices(batch.column(1)):
                w = Words(texts)
                pairs = {(d, i) for d, i in index.candidates(w) if ids[lo + d] is not None}
                got += [(ids[lo + d], index.ids[i], c) for d, i, c in index.verified(w, pairs)]
            if got:
                yield dict(zip(("doc_id", "item_id", "containment"), map(list, zip(*got, strict=True)), strict=True))

        found = map_arrow(docs, search, "doc_id long, item_id long, containment double")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _items(items: DataFrame) -> DataFrame:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"])


def _index(items: DataFrame, k: int, threshold: float, recall: float, broadcast_keys: int) -> Index | None:
    """The index of the items if it is small enough to be sent to every task, by their number and by their texts."""
    each = max(p.bands * p.rows for n in range(1, k + 8) if (p := part_of(n, k, threshold, recall)))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n * each > broadcast_keys or chars > BROADCAST_CHARS:
        return None
    rows = sorted((r[0], r[1]) for r in items.collect())
    return Index([r[0] for r in rows], [r[1] for r in rows], k, threshold, recall)


def without(
    docs: DataFrame, items: DataFrame, k: int, threshold: float, recall: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """docs, in their own columns, without the rows whose text contains an item; each row is judged by its own text, and one without an id stays.

    With a small index this is a filter and moves no row.
    """
    items = _items(items)
    index = _index(items, k, threshold, recall, broadcast_keys)
    if index is not None:
        @F.arrow_udf("boolean")
        def holds(text: pa.Array) -> pa.Array:
            out = np.zeros(len(text), bool)
            for lo, _, texts in text_slices(text):
                w = Words(texts)
                out[[lo + d for d, _, _ in index.verified(w, index.candidates(w))]] = True
            give_back()
            return pa.array(out)

        return docs.where(F.col(id_col).cast("long").isNull() | ~holds(F.col(text_col).cast("string")))
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    some = docs.where(F.col(id_col).cast("long").isNotNull() & F.col(text_col).isNotNull()).select(row.alias("doc_id"), F.col(text_col).cast("string").alias("text")).distinct()
    bad = _joined(some, items, k, threshold, recall).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, (row == bad["__bad"]) & F.col(id_col).cast("long").isNotNull(), "left_anti")


def _joined(docs: DataFrame, items: DataFrame, k: int, threshold: float, recall: float) -> DataFrame:
    """The search for any number of items: keys of windows and of items meet in a shuffled join, then the texts of the pairs."""
    counted = stored(map_arrow(items.select("item_id", "text"), _count_words, "item_id long, text string, n int"))
    sizes = [r[0] for r in counted.where("n > 0").select(F.least("n", F.lit(1 << 30)).alias("n")).distinct().collect()]
    parts = {p: t for t, p in enumerate(sorted({part_of(n, k, threshold, recall) for n in sizes}, key=lambda p: (p.k, p.size)))}

    def item_keys(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, t in zip(ids, texts, strict=True):
            w = Words([t])
            part = part_of(len(w), k, threshold, recall)
            if part:
                keys = np.concatenate(list(band_keys(w.shingles(part.k)[0], np.zeros(1, np.int64), part, parts[part])))
                yield {"key": keys, "item_id": [i] * len(keys)}

    def doc_keys(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0).to_pylist()
        for lo, hi, texts in text_slices(batch.column(1)):
            w = Words(texts)
            own = np.array([i if i is not None else 0 for i in ids[lo:hi]], np.int64)
            null = np.array([i is None for i in ids[lo:hi]])
            for part, tag in parts.items():
                h, offset = w.shingles(part.k)
                if len(h):
                    doc, keys = window_minima(h, offset, part, tag)
                    for key in keys:
                        yield {"key": key[~null[doc]], "doc_id": own[doc][~null[doc]]}

    pairs = (
        map_arrow(docs, doc_keys, "key long, doc_id long")
        .join(map_arrow(items, item_keys, "key long, item_id long"), "key")
        .select("doc_id", "item_id").distinct()
    )

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")]
        got = []
        for d, i, text, item in zip(*cols, strict=True):
            index = Index([i], [item], k, threshold, recall)
            got += [(d, i, c) for _, _, c in index.verified(Words([text]), {(0, 0)})]
        if got:
            yield dict(zip(("doc_id", "item_id", "containment"), map(list, zip(*got, strict=True)), strict=True))

    both = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    return map_arrow(both.select("doc_id", "item_id", "text", "item"), verify, "doc_id long, item_id long, containment double")


def _count_words(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = batch.column(1).to_pylist()
    yield {"item_id": batch.column(0), "text": batch.column(1), "n": Words(texts, hashed=False).counts.astype(np.int32)}
