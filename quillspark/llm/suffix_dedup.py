"""Exact repeated passages by a distributed difference-cover suffix array.

A passage of ``least`` (50) words that stands somewhere earlier, in the order of (doc_id, position), is a repeat. The
suffix array is built over locally consistent phrases instead of words: a text is cut at the winnowing minima of its 3-word
shingles (one in any 24 successive), so two equal passages of 50 words hold at least one whole phrase in common at the
same place, and the string to sort is some twelve times shorter. Its symbols are 64-bit phrase hashes; phrases that occur
once end a string, since no suffix needs comparing beyond them.

1. Difference cover modulo 3: the suffixes at positions 1 and 2 mod 3 are sorted by their first three symbols (range
   partitions) and named; while a name that is not unique covers fewer than ``least`` words, the names are sorted by recursion.
2. The suffixes at 0 mod 3 are sorted by their first symbol and the rank behind it, and all three are merged.
3. Adjacent suffixes are compared. Those that share no phrase with a neighbour are dropped: any 50-word repeat holds its first
   phrase whole and the 27 words from there on, while the phrases behind may differ in where they end. Among the others, places
   whose whole surroundings are equal form one family, of which only the first is looked at further;
   where families differ but those 27 words agree, at the edges of repeats, 50-word windows are compared.

Copies do not gather in a task. What is sorted, named, merged and compared is each distinct triple, suffix, family and window once,
counted by aggregates that combine before they shuffle; results go back to the places by joins, whose hot keys the adaptive plan
splits. Sorting ranges over the first three symbols, so one frequent phrase is spread by what follows it. Only the
phrases of one text, and the spans of one pair of documents, meet in a task as they are. Ranks and names never pass through the driver.

The result is exact (up to collisions of 64-bit hashes): a word belongs to a span if a 50-word window that covers it occurs
earlier. Words are lower-cased runs of letters and digits.

Cases: null ids, null texts and texts of fewer than ``least`` words have no repeats. Rows that repeat an id and text are one
document; of rows with one id and differing texts each is read for itself, and they share the spans of that id. A passage repeated within one document is a repeat. Empty
tables give empty results. Extra columns are ignored by ``repeats`` and kept by ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_rows, id_text, map_arrow, map_partition, numpy_column, release, stored
from .textcore import Words, give_back, mix, powers, text_slices

LEAST, K, WINDOW = 50, 3, 24
NEAR = LEAST - WINDOW + 1  # a window's first minimum is among its first 24 shingles, so it covers as many words from there on
PIECE = (1 << 24) - WINDOW
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_END = np.int64(-(2**63))  # stands for the end of a string, below every symbol and rank

ORACLE_SQL = rf"""
WITH w AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {LEAST - 1})) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + {LEAST}], ' ')) AS g FROM p),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS first_doc_id, row_number() OVER o AS n FROM g WINDOW o AS (PARTITION BY g ORDER BY doc_id, i)),
r AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, first_doc_id ORDER BY i) + {LEAST} THEN 1 ELSE 0 END AS new FROM f WHERE n > 1),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first_doc_id ORDER BY i) AS span FROM r)
SELECT doc_id, first_doc_id, min(i)::BIGINT AS start_word, (max(i) - min(i) + {LEAST})::BIGINT AS n_words
FROM s GROUP BY doc_id, first_doc_id, span
"""


class Spans:
    """Hashes of word ranges [a, b) by prefix sums; the same words give the same hash anywhere."""

    def __init__(self, w: Words):
        n = len(w) + 1
        up, down = powers(n)
        self.down = down
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * up[: len(w)], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _C)


def minima(w: Words) -> np.ndarray:
    """For each word of the slice, the position of the least of the 24 shingles from there on (the leftmost of equals)."""
    n = len(w)
    h = np.full(n + WINDOW, np.iinfo(np.uint64).max)
    if n > 2:
        h[: n - 2] = mix((w.hash[: n - 2] * _C + w.hash[1 : n - 1]) * _C + w.hash[2:])
    low = np.uint64((1 << 24) - 1)
    out = np.empty(n, np.int64)
    for a in range(0, n, PIECE):  # positions within a piece fit the low 24 bits
        piece = h[a : a + PIECE + WINDOW]
        m = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:-8], m[8:])
        out[a : a + PIECE] = (m[: len(piece) - WINDOW] & low).astype(np.int64) + a
    return out


def _text_hash(w: Words, span: Spans) -> np.ndarray:
    return span(w.offset[:-1], w.offset[1:])


def _phrases(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row for each phrase: (doc_id, txt, idx, sym, n, at, lo, hi, fam, near).

    ``txt``: hash of all words of its text, as an id may have several; ``at``: its first word; ``lo``..``hi``: the 50-word windows (by first word) whose first minimum it is (none: lo > hi); ``fam``: hash of all they cover;
    ``near``: hash of the words from ``at`` on that all of them cover.
    """
    ids = batch.column(0)
    valid, doc_ids = np.array(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi, texts in text_slices(batch.column(1)):
        w = Words(texts)
        low, span = minima(w), Spans(w)
        doc = w.doc_of_word()
        ends, word = w.offset[1:][doc], np.arange(len(w))
        big = (w.counts >= LEAST)[doc] & valid[lo:hi][doc]
        x = word[(word + WINDOW + K - 1 <= ends) & big]  # all windows of 24 shingles
        if not len(x):
            continue
        at = low[x]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(new)
        at, win_lo = at[begin], x[begin]
        win_hi = np.minimum(x[np.append(begin[1:], len(x)) - 1], w.offset[1:][doc[at]] - LEAST)
        d = doc[at]
        phrase = np.flatnonzero(d[:-1] == d[1:])  # the last minimum of a text only ends a phrase
        end, at, win_lo, win_hi, d = at[phrase + 1], at[phrase], win_lo[phrase], win_hi[phrase], d[phrase]
        covered = np.maximum(win_hi + LEAST, win_lo)
        fam = mix(span(win_lo, covered) ^ mix(((at - win_lo) * 64 + (at - win_hi)).astype(np.uint64)))
        near = span(at, np.minimum(at + NEAR, w.offset[1:][d]))
        base = w.offset[d]
        yield {
            "doc_id": doc_ids[lo:hi][d], "txt": _text_hash(w, span)[d], "idx": (np.arange(len(at)) - np.searchsorted(d, d)).astype(np.int32), "sym": span(at, end),
            "n": (end - at).astype(np.int32), "at": (at - base).astype(np.int32), "lo": (win_lo - base).astype(np.int32), "hi": (win_hi - base).astype(np.int32), "fam": fam, "near": near,
        }


PHRASES = "doc_id long, txt long, idx int, sym long, n int, at int, lo int, hi int, fam long, near long"


#: Order of the places of the corpus, as one number that aggregates can compare: id, position, and part of the hash of the text for ids with several.
WIDE = "(CAST(doc_id AS DECIMAL(20,0)) * 4611686018427387904 + CAST({at} AS BIGINT) * 2147483648 + (txt & 2147483647))"
#: The same order where ids are between 0 and 2**32 and each has one text.
NARROW = "(doc_id * 2147483648 + {at})"


def _place(docs: DataFrame) -> str:
    """The narrower number where the ids allow it; it is read from the ids alone and changes nothing else."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low < 0 or high >= 1 << 32 or docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return WIDE
    return NARROW


def _repeated(phrases: DataFrame) -> DataFrame:
    """The phrases that stand in two places at least."""
    seen = F.xxhash64("doc_id", "txt", "idx")
    twice = phrases.groupBy("sym").agg(F.min(seen).alias("a"), F.max(seen).alias("b")).where("a <> b").select("sym")
    return phrases.join(twice.hint("shuffle_hash"), "sym", "left_semi")


# The string table of a level has (seg, i, sym, cover): symbol i of string seg, and how many words it covers.
# pseg, pi name the suffix one level up that a row stands for.
PLACE = ("txt", "at", "lo", "hi", "fam", "near")
STRING = "seg long, i int, sym long, cover int, pseg long, pi int"


def _runs(table: pa.Table) -> Iterator[dict]:
    """The strings: runs of phrases that follow each other in a text and occur more than once."""
    doc, txt, idx = (numpy_column(table, k) for k in ("doc_id", "txt", "idx"))
    order = np.lexsort((idx, txt, doc))
    doc, txt, idx = doc[order], txt[order], idx[order]
    once = np.ones(len(doc), bool)  # texts of one id whose words are the same count once
    once[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1]) | (idx[1:] != idx[:-1])
    order, doc, txt, idx = order[once], doc[once], txt[once], idx[once]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1]) | (idx[1:] != idx[:-1] + 1)
    run = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    seg = mix(mix(mix(doc.view(np.uint64)) + txt.view(np.uint64)) + idx[run].astype(np.uint64))
    yield {
        "seg": seg, "i": (np.arange(len(doc)) - run).astype(np.int32), "sym": numpy_column(table, "sym")[order],
        "cover": numpy_column(table, "n")[order], "pseg": doc, "pi": idx,
    } | {k: numpy_column(table, k)[order] for k in PLACE}


def _by_string(table: pa.Table, keep: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The partition's strings laid out one behind the other, and where each position's string ends. Repeated positions count once."""
    seg, i = numpy_column(table, "seg"), numpy_column(table, "i")
    order = np.lexsort((i, seg))
    seg, i = seg[order], i[order]
    first = np.ones(len(seg), bool)
    first[1:] = (seg[1:] != seg[:-1]) | (i[1:] != i[:-1])
    order, seg, i = order[first], seg[first], i[first]
    end = np.searchsorted(seg, seg, "right")
    return {"seg": seg, "i": i} | {c: numpy_column(table, c)[order] for c in keep}, end


def _ahead(v: np.ndarray, end: np.ndarray, k: int, empty) -> np.ndarray:
    at = np.arange(len(v)) + k
    return np.where(at < end, v[np.minimum(at, len(v) - 1)], empty)


def _triples(table: pa.Table) -> Iterator[dict]:
    """First three symbols of the sampled suffixes (positions 1 and 2 mod 3), in the strings of the next level."""
    c, end = _by_string(table, ("sym", "cover"))
    pick = np.flatnonzero(c["i"] % 3)
    if len(pick):
        s1, s2 = _ahead(c["sym"], end, 1, _END), _ahead(c["sym"], end, 2, _END)
        cover = c["cover"] + _ahead(c["cover"], end, 1, 0) + _ahead(c["cover"], end, 2, 0)
        cover = np.where(s2 == _END, LEAST, np.minimum(cover, LEAST))  # up to its end a suffix is compared whole
        cls = c["i"] % 3
        seg = mix(c["seg"].view(np.uint64) * np.uint64(3) + cls.astype(np.uint64))
        yield {
            "seg": seg[pick], "i": ((c["i"] - cls) // 3)[pick].astype(np.int32), "s0": c["sym"][pick], "s1": s1[pick], "s2": s2[pick],
            "cover": cover[pick].astype(np.int32), "pseg": c["seg"][pick], "pi": c["i"][pick],
        }


def _ordered_ids(new: np.ndarray) -> np.ndarray:
    """Ids of the groups of a sorted range partition, in the order of all partitions. ``new`` marks where a group begins."""
    return (np.int64(TaskContext.get().partitionId()) << 36) + np.cumsum(new)


def _names(table: pa.Table) -> Iterator[dict]:
    """Names of distinct triples in their order; open: it stands for several places that it does not tell apart far enough."""
    c = {k: numpy_column(table, k) for k in table.column_names}
    order = np.lexsort((c["s2"], c["s1"], c["s0"]))
    c = {k: v[order] for k, v in c.items()}
    yield {"s0": c["s0"], "s1": c["s1"], "s2": c["s2"], "name": _ordered_ids(np.ones(len(order), bool)), "open": (c["n"] > 1) & (c["cover"] < LEAST)}


def _merged(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of rows (cls, s0, s1, r0, r1, r2) that have all suffixes of their first symbols; where two are not the same."""
    zero, n = c["cls"] == 0, len(c["cls"])
    behind = np.full(n, -1, np.int64)
    for cls, keys in ((1, ("r1", "s0")), (2, ("r2", "s1", "s0"))):
        some = np.flatnonzero(zero | (c["cls"] == cls))
        order = some[np.lexsort((zero[some], *[c[k][some] for k in keys]))]
        last = np.maximum.accumulate(np.where(zero[order], -1, c["r0"][order]))
        # a suffix of another first symbol may stand in front; it is smaller, and so is its rank
        at = zero[order]
        behind[order[at]] = np.maximum(behind[order[at]], last[at])
    major = np.where(zero, behind, c["r0"])
    order = np.lexsort((c["r1"], c["s0"], zero, major))
    return order, major


TUPLE = ("cls", "s0", "s1", "s2", "r0", "r1", "r2")
SUFFIX = "pseg long, pi int, cls int, s0 long, s1 long, s2 long, r0 long, r1 long, r2 long, h long"


def _suffixes(table: pa.Table, carried: tuple[str, ...] = ()) -> Iterator[dict]:
    """Each suffix with what merging compares: its first symbols and the ranks of the sampled suffixes from it on (``h``: hash of these)."""
    sampled = numpy_column(table, "sampled")
    ranks = table.filter(pa.array(sampled))
    c, end = _by_string(table.filter(pa.array(~sampled)), ("sym", "pseg", "pi", *carried))
    rank = np.full(len(c["i"]), _END, np.int64)
    if ranks.num_rows:
        r, _ = _by_string(ranks, ("sym",))
        place = np.searchsorted(c["seg"], r["seg"]) + r["i"]
        rank[place] = r["sym"]
    out = {
        "cls": (c["i"] % 3).astype(np.int32), "s0": c["sym"], "s1": _ahead(c["sym"], end, 1, _END), "s2": _ahead(c["sym"], end, 2, _END),
        "r0": rank, "r1": _ahead(rank, end, 1, _END), "r2": _ahead(rank, end, 2, _END),
    }
    h = np.zeros(len(rank), np.uint64)
    for k in TUPLE:
        h = mix(h * _C + out[k].astype(np.int64).view(np.uint64) + np.uint64(1))
    out |= {"pseg": c["pseg"], "pi": c["pi"], "h": h}
    if carried:
        q = mix(c["sym"].view(np.uint64) * _C ^ c["near"].view(np.uint64))
        out |= {"q": q, "g": mix(q * _C ^ c["fam"].view(np.uint64))} | {k: c[k] for k in ("txt", "at", "lo", "hi")}
    yield out


def _firsts(df: DataFrame, *keys: str, **more) -> DataFrame:
    """One row for each tuple."""
    return df.groupBy(*keys).agg(*[F.first(k).alias(k) for k in TUPLE], *[v.alias(k) for k, v in more.items()])


def _ranked(table: pa.Table) -> Iterator[dict]:
    c = {k: numpy_column(table, k) for k in table.column_names}
    order, major = _merged(c)
    c, major = {k: v[order] for k, v in c.items()}, major[order]
    new = np.ones(len(order), bool)
    both = (c["cls"][1:] == 0) & (c["cls"][:-1] == 0)
    new[1:] = np.where(both, (c["s0"][1:] != c["s0"][:-1]) | (c["r1"][1:] != c["r1"][:-1]), (c["cls"][1:] == 0) | (c["cls"][:-1] == 0) | (c["r0"][1:] != c["r0"][:-1]))
    yield {"h": c["h"], "rank": _ordered_ids(new)}


def _sampled_ranks(strings: DataFrame) -> DataFrame:
    """(seg, i, rank) of the sampled suffixes of the strings, by naming their triples and, where names tie too early, recursion; a stored table."""
    triples = stored(map_partition(strings.select("seg", "i", "sym", "cover").repartition("seg"), _triples, "seg long, i int, s0 long, s1 long, s2 long, cover int, pseg long, pi int"))
    kinds = triples.groupBy("s0", "s1", "s2").agg(F.count("*").alias("n"), F.max("cover").alias("cover"))
    named = stored(map_partition(kinds.repartitionByRange("s0", "s1", "s2"), _names, "s0 long, s1 long, s2 long, name long, open boolean"))
    names = stored(triples.join(named.hint("shuffle_hash"), ["s0", "s1", "s2"]).select("seg", "i", F.col("name").alias("sym"), "cover", "pseg", "pi"))
    release(triples)
    tied = named.where("open").limit(1).count() > 0
    release(named)
    if not tied:
        out = names.select(F.col("pseg").alias("seg"), F.col("pi").alias("i"), F.col("sym").alias("rank"))
        out._stored_at = names._stored_at
        return out
    rows, ranks = _with_ranks(names)
    suffixes = stored(rows)
    release(names, ranks)
    ranked = map_partition(_firsts(suffixes, "h").repartitionByRange("s0", "s1", "s2"), _ranked, "h long, rank long")
    out = stored(suffixes.join(ranked.hint("shuffle_hash"), "h").select(F.col("pseg").alias("seg"), F.col("pi").alias("i"), "rank"))
    release(suffixes)
    return out


def _with_ranks(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffixes of the strings (SUFFIX), ready to be merged by their first symbols; and the stored ranks that they read."""
    carried = PLACE if "fam" in strings.columns else ()
    ranks = _sampled_ranks(strings)
    rows = strings.select("seg", "i", "sym", "pseg", "pi", *carried, F.lit(False).alias("sampled")).unionByName(
        ranks.select("seg", "i", F.col("rank").alias("sym"), F.lit(True).alias("sampled")), allowMissingColumns=True
    )
    extra = ", q long, g long, txt long, at int, lo int, hi int" if carried else ""
    return map_partition(rows.repartition("seg"), lambda t: _suffixes(t, carried), SUFFIX + extra), ranks


KIND = "g long, q long, n long, head {place}, head_doc long"


def _adjacent(table: pa.Table) -> Iterator[dict]:
    """Merge the distinct suffixes and compare adjacent ones: those stay that share their first phrase with a neighbour, or stand for several places.

    The first and last of a range have neighbours elsewhere and stay, too.
    """
    c = {k: numpy_column(table, k) for k in (*TUPLE, "n")}
    order, _ = _merged(c)
    one = c["s0"][order][1:] == c["s0"][order][:-1]
    may = np.append(one, True) | np.insert(one, 0, True) | (c["n"][order] > 1)
    kept = table.take(pa.array(np.sort(order[may])))
    yield {k: kept.column(k).combine_chunks() for k in ("g", "q", "n", "head", "head_doc")}


def _families(suffixes: DataFrame) -> DataFrame:
    """(g, head, head_doc, edge): families of places with equal surroundings that repeat something, and their first places.

    ``edge``: others agree with it in the words that all windows cover, and differ around them.
    """
    places = suffixes.where("lo <= hi")
    kinds = _firsts(places, "h", "g", q=F.first("q"), n=F.count("*"), head=F.min("place"), head_doc=F.min("doc_id"))
    near = map_partition(kinds.repartitionByRange("s0", "s1", "s2"), _adjacent, KIND.format(place=kinds.schema["head"].dataType.simpleString()))
    each = stored(near.groupBy("g").agg(F.first("q").alias("q"), F.sum("n").alias("n"), F.min("head").alias("head"), F.min("head_doc").alias("head_doc")))
    several = each.groupBy("q").agg(F.count("*").alias("m")).where("m > 1").select("q", F.lit(True).alias("edge"))
    out = each.join(several.hint("shuffle_hash"), "q", "left").select("g", "n", "head", "head_doc", F.coalesce("edge", F.lit(False)).alias("edge"))
    done = stored(out.where("n > 1 OR edge").drop("n"))
    release(each)
    return done


def _windows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The 50-word windows of the families at the edges of repeats, from the text of their first place."""
    ids = numpy_column(batch, "doc_id")
    lists = [batch.column(k).to_pylist() for k in ("txt", "g", "at", "lo", "hi")]
    for a, b, texts in text_slices(batch.column("text")):
        w = Words(texts)
        span = Spans(w)
        own = _text_hash(w, span).view(np.int64)
        for d in range(a, b):
            txt, fam, at, lo, hi = (np.array(x[d], np.int64) for x in lists)
            base, ok = w.offset[d - a], txt == own[d - a]  # an id may have several texts
            fam, at, lo, hi = fam[ok], at[ok], lo[ok], hi[ok]
            size = hi - lo + 1
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            if len(pos):
                yield {
                    "hash": span(base + pos, base + pos + LEAST), "g": np.repeat(fam, size), "l": (np.repeat(at, size) - pos).astype(np.int32),
                    "doc_id": np.full(len(pos), ids[d]), "txt": np.full(len(pos), own[d - a]), "pos": pos.astype(np.int32),
                }


def _first_windows(windows: DataFrame, place: str) -> DataFrame:
    """(g, ls, firsts): the windows of a family that stand before in another, by their distance from its place, and the documents where."""
    windows = windows.withColumn("place", F.expr(place.format(at="pos")))
    first = windows.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min("doc_id").alias("first_doc"))
    later = windows.join(first.where("first < last").drop("last").hint("shuffle_hash"), "hash").where("place > first")
    return later.groupBy("g").agg(F.collect_list("l").alias("ls"), F.collect_list("first_doc").alias("firsts"))


def _stretches(batch: pa.RecordBatch) -> Iterator[dict]:
    """Runs of windows with one first document, for places some of whose windows stand in another family too."""
    rows = []
    cols = [batch.column(k).to_pylist() for k in ("doc_id", "at", "lo", "hi", "head_doc", "is_head", "ls", "firsts")]
    for doc, at, lo, hi, head, is_head, ls, firsts in zip(*cols, strict=True):
        known = dict(zip(ls, firsts, strict=True))
        prev = None
        for pos in range(lo, hi + 1):
            first = known.get(at - pos, None if is_head else head)
            if first is not None:
                if prev and prev[1] == first and prev[3] == pos - 1:
                    prev[3] = pos
                else:
                    prev = [doc, first, pos, pos]
                    rows.append(prev)
    if rows:
        yield dict(zip(("doc_id", "first_doc_id", "lo", "hi"), map(list, zip(*rows, strict=True)), strict=True))


def _spans(table: pa.Table) -> Iterator[dict]:
    c = {k: numpy_column(table, k) for k in table.column_names}
    order = np.lexsort((c["lo"], c["first_doc_id"], c["doc_id"]))
    c = {k: v[order] for k, v in c.items()}
    other = np.ones(len(order), bool)
    other[1:] = (c["doc_id"][1:] != c["doc_id"][:-1]) | (c["first_doc_id"][1:] != c["first_doc_id"][:-1])
    group = np.cumsum(other).astype(np.int64)
    reach = np.maximum.accumulate(c["hi"] + (group << 32)) - (group << 32)  # the last window so far of the same pair
    new = other.copy()
    new[1:] |= c["lo"][1:] > reach[:-1] + LEAST
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    yield {
        "doc_id": c["doc_id"][first], "first_doc_id": c["first_doc_id"][first], "start_word": c["lo"][first].astype(np.int64),
        "n_words": (reach[last] - c["lo"][first] + LEAST).astype(np.int64),
    }


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_doc_id, start_word, n_words): each stretch of words that repeats an earlier one, by the document where it first stands."""
    docs = distinct_rows(id_text(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id", "text")
    place = _place(docs)
    found = stored(map_arrow(docs, _phrases, PHRASES))
    phrases = stored(_repeated(found))
    release(found)
    strings = stored(map_partition(phrases.repartition("doc_id", "txt"), _runs, STRING + ", txt long, at int, lo int, hi int, fam long, near long"))
    release(phrases)
    rows, ranks = _with_ranks(strings)
    suffixes = stored(rows.withColumnRenamed("pseg", "doc_id").withColumn("place", F.expr(place.format(at="at"))).drop("pi"))
    release(strings, ranks)
    heads = _families(suffixes)
    families = stored(
        suffixes.where("lo <= hi").join(heads.hint("shuffle_hash"), "g").select("doc_id", "txt", "at", "lo", "hi", "g", "head_doc", "edge", (F.col("place") == F.col("head")).alias("is_head"))
    )
    release(suffixes, heads)
    edges = families.where("edge AND is_head").groupBy("doc_id").agg(*[F.collect_list(k).alias(k) for k in ("txt", "g", "at", "lo", "hi")])
    texts = docs.join(edges, "doc_id").select("doc_id", "text", "txt", "g", "at", "lo", "hi")
    windows = stored(map_arrow(texts, _windows, "hash long, g long, l int, doc_id long, txt long, pos int"))
    known = families.join(_first_windows(windows, place).hint("shuffle_hash"), "g", "left").where("ls IS NOT NULL OR NOT is_head")
    known = stored(known.select("doc_id", "at", "lo", "hi", "head_doc", "is_head", "ls", "firsts"))
    release(families, windows)
    whole = known.where("ls IS NULL").select("doc_id", F.col("head_doc").alias("first_doc_id"), "lo", "hi")
    part = map_arrow(known.where("ls IS NOT NULL"), _stretches, "doc_id long, first_doc_id long, lo int, hi int")
    return map_partition(
        whole.union(part).repartition("doc_id", "first_doc_id"), _spans, "doc_id long, first_doc_id long, start_word long, n_words long"
    )


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs, in their own columns, without the words of repeats; the character count, if there is one, follows the text.

    What stands between cut words goes with them; other text stays as it is. A document of which no word is left goes.
    """
    own = "__cut"  # a prefix that no column of docs has
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    at, starts, sizes, text = (f"{own}{k}" for k in "iant")
    spans = repeats(docs, id_col, text_col).groupBy(F.col("doc_id").alias(at)).agg(
        F.collect_list("start_word").alias(starts), F.collect_list("n_words").alias(sizes)
    )

    @F.arrow_udf("string")
    def without(text: pa.Array, a: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for k in range(len(text)):
            t, starts, sizes = text[k].as_py(), a[k].as_py(), n[k].as_py()
            if t is None or starts is None:
                out.append(t)
                continue
            w = Words([t], hashed=False)
            gone = np.zeros(len(w) + 1, np.int64)
            for s, size in zip(starts, sizes, strict=True):
                gone[min(s, len(w))] += 1
                gone[min(s + size, len(w))] -= 1
            inside = np.cumsum(gone)[:-1] > 0
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            pieces, at = [], 0
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                pieces.append(t[at : w.start[s]])
                at = w.end[e - 1]
            pieces.append(t[at:])
            out.append(None if inside.all() else "".join(pieces))
        give_back()
        return pa.array(out, pa.string())

    without = without.asNondeterministic()  # else the filter below would run it a second time

    joined = docs.join(spans, docs[id_col].cast("long") == spans[at], "left")
    whole = F.col(at).isNull()
    new = F.when(whole, docs[text_col]).otherwise(without(docs[text_col].cast("string"), starts, sizes))
    joined = joined.withColumn(text, new).where(whole | F.col(text).isNotNull())
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(text).alias(c))
        elif c == n_chars_col:
            cols.append(F.when(whole, docs[c]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(docs[c])
    return joined.select(*cols)
