"""SimHash near-duplicates: all pairs of signatures within a Hamming distance, by segments that differ in at most one bit.

A signature has 192 bits: three 64-bit SimHashes of the distinct words of a text, a word
voting with the square of its length (12 at most), so that common short words, which make
unrelated texts look alike, hardly count. For a threshold of ``max_bits`` it is cut into ``max_bits // 2 + 1`` segments (16 of
12 bits for 30). Two signatures that differ in at most ``max_bits`` bits have a segment that differs in at most one bit, so one half of that
segment is equal. Each half of each segment is an index row (32 a signature), an equality join on it brings
together all rows that can be near, those whose other half differs in at most one bit are compared, and the Hamming distance
verifies them. All pairs of up to ``max_bits`` differing bits are found, whatever the threshold.

Index rows carry the signature, so a bucket's pairs are verified where they meet, and of a group of near copies a bucket reports
as many edges as connect it. A key that a sample shows to be shared by ``BUCKET_ROWS`` rows or more is cut into blocks, each pair of which is
compared in a task of its own; the other buckets hold N / 2**6 rows on average. Some 5 % of all pairs of signatures are compared (16 x 13 / 2**12),
so the comparisons grow with the square of the signatures.

Cases: a null id, a null text or a text without words is never a duplicate and never reported.
Rows with equal word sets have equal signatures and are duplicates (of ties the smallest id stays). Rows that
repeat an id are one document: what is near any of its texts is in its group. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, distinct_rows, forest, id_text, map_arrow, map_partition, numpy_column, release, stored
from .textcore import Words, mix, segment_reduce, text_slices

BITS = 192
MAX_BITS = 30


def segment_starts(max_bits: int) -> list[int]:
    """Where the segments begin, and the end of the last: so many that max_bits differences leave one with at most one, and 8 at least."""
    n = max(min(max_bits, BITS) // 2 + 1, 8)
    return [k * BITS // n for k in range(n + 1)]


SEGMENTS = np.diff(segment_starts(MAX_BITS)).tolist()
SURE = MAX_BITS
BUCKET_ROWS = 1 << 18
CELLS = 1 << 15
_SALT = [np.uint64(0x1234567 + 7919 * k) for k in range(3)]


def signatures_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) uint64 signatures and the number of words of each text."""
    w = Words(texts)
    doc = w.doc_of_word()
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    length = (w.end - w.start)[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(h)))
    h, d, weight = h[at], d[at], np.minimum(length[at], 12).astype(np.int64) ** 2
    # a word seen 4, 16, 64 ... times is a further feature: a text of one repeated word is no copy of that word
    extra = [np.flatnonzero(count >= 4**k) for k in range(1, 12)]
    extra = [(k, e) for k, e in enumerate(extra, 1) if len(e)]
    if extra:
        h = np.concatenate([h] + [mix(h[e] + np.uint64(k)) for k, e in extra])
        weight = np.concatenate([weight] + [weight[e] for _, e in extra])
        d = np.concatenate([d] + [d[e] for _, e in extra])
        order = np.argsort(d, kind="stable")
        h, d, weight = h[order], d[order], weight[order]
    offset = np.searchsorted(d, np.arange(len(texts) + 1))
    total = segment_reduce(np.add, weight, offset, 0)
    out = np.zeros((len(texts), 3), np.uint64)
    for k in range(3):
        x = mix(h ^ _SALT[k])
        bits = np.zeros((len(texts), 64), bool)
        for b in range(64):
            vote = segment_reduce(np.add, weight * ((x >> np.uint64(b)) & np.uint64(1)).view(np.int64), offset, 0)
            bits[:, b] = 2 * vote > total
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, w.counts


def _sign(batch: pa.RecordBatch) -> Iterator[dict]:
    ids = batch.column(0)
    for lo, hi, texts in text_slices(batch.column(1)):
        sig, n = signatures_of(texts)
        ok = (n > 0) & np.array([i.is_valid for i in ids[lo:hi]])
        if ok.any():
            at = np.flatnonzero(ok)
            yield {"doc_id": ids[lo:hi].take(pa.array(at))} | {f"s{k}": sig[at, k] for k in range(3)}


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s0, s1, s2) for every document that has words."""
    return map_arrow(id_text(docs, id_col, text_col), _sign, "doc_id long, s0 long, s1 long, s2 long")


def _cut(sig: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo to hi of each signature as a number; 32 bits at most."""
    k, shift = divmod(lo, 64)
    if hi == lo:
        return np.zeros(len(sig), np.uint64)
    value = sig[:, k] >> np.uint64(shift)
    if shift + hi - lo > 64:
        value = value | (sig[:, k + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << (hi - lo)) - 1)


def _halves(max_bits: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Of each segment in turn: the half that is equal and the half that may differ in a bit, then the other way round."""
    starts = segment_starts(max_bits)
    for lo, hi in zip(starts, starts[1:]):
        mid = (lo + hi) // 2
        yield (lo, mid), (mid, hi)
        yield (mid, hi), (lo, mid)


def keys(sig: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """The keys of each half segment in turn: its place in the high half, its bits in the low one."""
    for place, (equal, _) in enumerate(_halves(max_bits)):
        yield (np.uint64(place) << np.uint64(32)) | _cut(sig, *equal)


def _signature(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(np.stack([numpy_column(table, f"s{k}").view(np.uint64) for k in range(3)], axis=1))


def _expand(batch: pa.RecordBatch, hot: np.ndarray, blocks: np.ndarray, max_bits: int) -> Iterator[dict]:
    """The index rows. A key of ``hot`` is cut into blocks by hash of the representative, and a row goes to each pair of blocks that has its own.

    ``pair`` ends in two bits: whether the two blocks differ, and if so whether the row is of the second.
    """
    ids, sig = numpy_column(batch, "rep"), _signature(batch)
    for lo in range(0, len(ids), 8192):
        part, rep = np.ascontiguousarray(sig[lo : lo + 8192]), ids[lo : lo + 8192]
        key = np.concatenate(list(keys(part, max_bits)))
        at = np.tile(np.arange(len(rep)), len(key) // len(rep))
        pair = np.zeros(len(key), np.int64)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            n = np.where(hot[place] == key, blocks[place], 1)
            own = (mix(rep.view(np.uint64)[at] + np.uint64(5)) % n.astype(np.uint64)).astype(np.int64)
            src = np.repeat(np.arange(len(key)), n)
            other = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
            own = own[src]
            pair = (np.minimum(own, other) * n[src] + np.maximum(own, other)) * 4 + (own != other) * 2 + (own > other)
            key, at = key[src], at[src]
        yield {"key": key, "pair": pair, "rep": rep[at]} | {f"s{k}": part[at, k] for k in range(3)}


INDEX = "key long, pair long, rep long, s0 long, s1 long, s2 long"


def _meetings(key: np.ndarray, pair: np.ndarray, rest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups to compare, by the first: those of a bucket whose other halves, ``rest``, differ in at most one bit.

    The groups are in the order of key, pair and rest. Two blocks are compared with each other, a block with itself once. Equal
    segments meet in the first half only.
    """
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
    bucket = np.cumsum(new) - 1
    ident = (bucket.astype(np.uint64) << np.uint64(32)) | rest
    left = np.flatnonzero(pair & 1 == 0)
    two = pair[left] & 2 > 0
    begin = np.append(np.flatnonzero(new), len(key))
    follow = np.minimum(begin[bucket[left] + 1], len(key) - 1)  # the first group of the next bucket
    left_of = ~two | ((key[follow] == key[left]) & (pair[follow] == pair[left] + 1))
    left, two = left[left_of], two[left_of]
    base = (bucket[left] + two).astype(np.uint64) << np.uint64(32)
    even = (key[left] >> np.uint64(32)) & np.uint64(1) == 0
    first, second = [], []
    for bit in [0] + [1 << k for k in range(width)]:
        other = rest[left] ^ np.uint64(bit)
        place = np.minimum(np.searchsorted(ident, base | other), len(key) - 1)
        ok = (ident[place] == base | other) & (two | (other > rest[left]) if bit else even)
        first.append(left[ok])
        second.append(place[ok])
    first, second = np.concatenate(first), np.concatenate(second)
    order = np.argsort(first, kind="stable")
    return first[order], second[order]


def _pairs(table: pa.Table, max_bits: int, every: bool) -> Iterator[dict]:
    """Pairs of the buckets at most max_bits apart: all, or as few as connect the same representatives."""
    key, pair, rep, sig = numpy_column(table, "key").view(np.uint64), numpy_column(table, "pair"), numpy_column(table, "rep"), _signature(table)
    halves, rest, width = list(_halves(max_bits)), np.zeros(len(key), np.uint64), 0
    place = (key >> np.uint64(32)).astype(np.int64)
    for p in np.unique(place).tolist():
        at, (lo, hi) = np.flatnonzero(place == p), halves[p][1]
        rest[at], width = _cut(sig[at], lo, hi), max(width, hi - lo)
    order = np.lexsort((rest, pair, key))
    key, pair, rest, rep, sig = key[order], pair[order], rest[order], rep[order], [np.ascontiguousarray(sig[order, k]) for k in range(3)]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]) | (rest[1:] != rest[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(key))
    first, second = _meetings(key[start], pair[start], rest[start], width)
    cut = np.flatnonzero(np.diff(first, prepend=-1, append=-1)).tolist()
    found, size = [], 0
    for lo, hi in zip(cut, cut[1:]):
        group = first[lo]
        right = np.concatenate([np.arange(start[g], end[g]) for g in second[lo:hi].tolist()])
        words = [s[right] for s in sig]
        step = max(1, CELLS // len(right))
        for at in range(start[group], end[group], step):
            to = min(at + step, end[group])
            bits = np.bitwise_count(sig[0][at:to, None] ^ words[0])
            bits += np.bitwise_count(sig[1][at:to, None] ^ words[1])
            bits += np.bitwise_count(sig[2][at:to, None] ^ words[2])
            hit = np.flatnonzero(bits <= max_bits)
            if not len(hit):
                continue
            i, j = hit // len(right) + at, right[hit % len(right)]
            ok = (i < j) & (rep[i] != rep[j])  # a group also meets itself; the second of two blocks lies behind the first
            a, b = rep[i[ok]], rep[j[ok]]
            found.append((np.minimum(a, b), np.maximum(a, b), bits.ravel()[hit[ok]].astype(np.int32)))
            size += len(a)
            if size > 1 << 20:
                a, b, n = (np.concatenate([f[k] for f in found]) for k in range(3))
                found, size = [], 0
                if every:
                    yield {"a": a, "b": b, "bits": n}
                else:
                    b, a = forest(a, b)
                    found, size = [(a, b, np.zeros(len(a), np.int32))], len(a)
    if size:
        a, b, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        if not every:
            b, a = forest(a, b)
            n = np.zeros(len(a), np.int32)
        yield {"a": a, "b": b, "bits": n}


def hot_keys(reps: DataFrame, bucket_rows: int = BUCKET_ROWS, one_in: int = 64, most: int = 1 << 16, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Keys that some ``bucket_rows`` rows or more share, estimated from one representative in ``one_in``, and the blocks each is cut into.

    They only decide how rows are spread, not what is compared. Of more than ``most`` keys those with the most rows are taken.
    """
    if reps.limit(bucket_rows).count() < bucket_rows:  # no key can have so many
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(one_in)) == 0)

    def sampled(batch: pa.RecordBatch) -> Iterator[dict]:
        for key in keys(_signature(batch), max_bits):
            yield {"key": key}

    counts = map_arrow(some, sampled, "key long").groupBy("key").count().where(F.col("count") * one_in >= bucket_rows)
    rows = sorted((r[0] & (2**64 - 1), r[1]) for r in counts.orderBy(F.desc("count"), "key").limit(most).collect())
    return np.array([k for k, _ in rows], np.uint64), np.array([-(-n * one_in // bucket_rows) + 1 for _, n in rows], np.int64)


def near_pairs(reps: DataFrame, max_bits: int = MAX_BITS, every: bool = True, bucket_rows: int = BUCKET_ROWS, one_in: int = 64) -> DataFrame:
    """(a, b, bits) with a < b for all pairs of distinct signatures (rep, s0, s1, s2) at most max_bits apart.

    Unless ``every`` pair is asked for, a bucket gives as few as connect the same signatures (bits are 0 then), so a group of n near
    copies costs n rows and not n squared.
    """
    hot, blocks = hot_keys(reps, bucket_rows, one_in, max_bits=max_bits)
    rows = map_arrow(reps.select("rep", "s0", "s1", "s2"), lambda batch: _expand(batch, hot, blocks, max_bits), INDEX)
    # both sides of a pair of blocks meet
    met = rows.repartition("key", F.shiftright("pair", 1))
    return map_partition(met, lambda t: _pairs(t, max_bits, every), "a long, b long, bits int").distinct()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, duplicate_of): each document that a group drops, and the smallest id of its group, which stays."""
    sigs = stored(signatures(docs, id_col, text_col).dropDuplicates(["doc_id", "s0", "s1", "s2"]))
    reps = stored(sigs.groupBy("s0", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    near = near_pairs(reps, max_bits, every=False).select("a", "b")
    again = stored(sigs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.limit(1).count():  # an id with several texts links the representatives of its signatures
        several = sigs.join(again, "doc_id", "left_semi").join(reps, ["s0", "s1", "s2"])
        near = near.union(several.where("rep < doc_id").select("rep", "doc_id"))
    roots = connected_components(near)
    release(again)
    member = sigs.join(reps, ["s0", "s1", "s2"]).select("doc_id", "rep")
    to_root = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("duplicate_of")
    )
    return to_root.where("doc_id <> duplicate_of").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the documents that duplicates() names, in their own columns; of rows that repeat an id and text one stays."""
    gone = duplicates(docs, id_col, text_col, max_bits).select(F.col("doc_id").alias("__gone"))
    return distinct_rows(docs, id_col, text_col).join(gone, F.col(id_col).cast("long") == gone["__gone"], "left_anti")
