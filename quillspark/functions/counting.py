"""Counting events where the documents lie: histograms, totals and rows over a vocabulary, without an event crossing the network.

A document is one row, so its histogram needs no shuffle. The common drivers are counted from the text itself, as numbers of characters
or words; all others from their arrays of events. Where an id stands on several rows its counts are added up behind.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .porter import stem

SLICE = 1 << 20  # elements counted at a time


@dataclass(frozen=True)
class Form:
    """Runs of n characters or words, ``step`` apart, sorted or with every choice of ``masked`` places left out; single words only if ``among``, or stemmed."""

    words: bool
    n: int
    sep: str
    step: int = 1
    ordered: bool = False
    masked: int = 0
    lower: bool = False  # the text is lower-cased first
    among: frozenset[str] | None = None
    stems: bool = False


def form_of(name: str, p: dict, among: Callable[[dict], frozenset[str]]) -> Form | None:
    """The form of a driver with these (complete) parameters; None for drivers that are counted from their events."""
    if p.get("tokenizer", "whitespace") != "whitespace":
        return None
    words = name.endswith("word_ngram") or name == "word_events"
    sep = " " if words else ""
    if name == "porter_stemmer":
        return Form(True, 1, " ", lower=True, stems=True)
    if name in ("function_words", "mw_function_words"):
        return Form(True, 1, " ", lower=True, among=frozenset(among(p)))
    if name in ("character_events", "word_events"):
        return Form(words, 1, sep)
    if name in ("character_ngram", "word_ngram"):
        return Form(words, p["n"], sep)
    if name in ("sorted_character_ngram", "sorted_word_ngram"):
        return Form(words, p["n"], sep, ordered=True)
    if name in ("k_skip_character_ngram", "k_skip_word_ngram"):
        return Form(words, p["n"], sep, step=p["k"] + 1)
    if name in ("leave_k_out_character_ngram", "leave_k_out_word_ngram") and p["k"] < p["n"]:
        return Form(words, p["n"], " ", masked=p["k"])
    return None


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with so many elements at most, one row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _elements(texts: list[str], words: bool, ordered: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(elements of each text, all their numbers, the elements by number, in order if asked for)."""
    if words:
        lists = [t.split() for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = pa.array(list(itertools.chain.from_iterable(lists)), pa.string()).dictionary_encode()
        if not ordered:
            return sizes, flat.indices.to_numpy().astype(np.int64), flat.dictionary
        order = pc.array_sort_indices(flat.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        return sizes, place[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64), flat.dictionary.take(order)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    return sizes, place[points], pa.array([chr(x) for x in letters], pa.string())


class Keys:
    """Rows of small numbers as single numbers below 2**40, and back."""

    def __init__(self, columns: list[np.ndarray], base: int):
        self.base, self.steps = max(base, 1), []
        key, space = columns[0].astype(np.int64), self.base
        for c in columns[1:]:
            table = None
            if space * self.base >= 1 << 40:
                table, key = np.unique(key, return_inverse=True)
                space = max(len(table), 1)
            self.steps.append(table)
            key, space = key * self.base + c, space * self.base
        self.key, self.space = key, space
        if space >= 1 << 40:
            self.last, self.key = np.unique(key, return_inverse=True)
            self.space = max(len(self.last), 1)
        else:
            self.last = None

    def columns(self, key: np.ndarray) -> list[np.ndarray]:
        key, out = key if self.last is None else self.last[key], []
        for table in reversed(self.steps):
            key, c = np.divmod(key, self.base)
            out.append(c)
            key = key if table is None else table[key]
        return [key, *reversed(out)]


def _runs(texts: list[str], form: Form) -> tuple[np.ndarray, np.ndarray, int, Callable[[np.ndarray], pa.Array]]:
    """(document, event's number) of each event, the bound of the numbers, and the events by number."""
    sizes, code, names = _elements(texts, form.words, form.ordered)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(code)) + (form.n - 1) * form.step < end)
    doc = np.repeat(np.arange(len(texts)), sizes)[at]
    columns = [code[at + j * form.step] for j in range(form.n)]
    if form.ordered:
        columns = list(np.sort(np.stack(columns, axis=1), axis=1).T)
    if form.masked:
        blank = pc.index(names, "_").as_py()
        if blank < 0:
            blank, names = len(names), pa.concat_arrays([names, pa.array(["_"])])
        gap = np.full(len(at), blank)
        masks = list(itertools.combinations(range(form.n), form.masked))
        columns = [np.concatenate([gap if j in m else columns[j] for m in masks]) for j in range(form.n)]
        doc = np.tile(doc, len(masks))
    if form.among is not None:
        listed = pc.is_in(names, value_set=pa.array(sorted(form.among), pa.string())).to_numpy(zero_copy_only=False)
        some = listed[columns[0]] if len(names) else np.zeros(0, bool)
        doc, columns = doc[some], [columns[0][some]]
    if form.stems and len(names):
        new = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        columns, names = [new.indices.to_numpy().astype(np.int64)[columns[0]]], new.dictionary
    keys = Keys(columns, len(names))

    def events(key: np.ndarray) -> pa.Array:
        parts = [names.take(pa.array(c)) for c in keys.columns(key)]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, form.sep)

    return doc, keys.key, keys.space, events


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int, Callable[[np.ndarray], pa.Array]]:
    """As ``_runs`` for arrays of events."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lists)), sizes)
    code, names = pc.fill_null(flat.indices, -1).to_numpy(), flat.dictionary
    some = code >= 0
    return doc[some], code[some].astype(np.int64), max(len(names), 1), lambda key: names.take(pa.array(key))


def counted(batch: pa.RecordBatch, form: Form | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, end, document, event's number, count, events by number) for some rows of (.., text or events) at a time."""
    column = batch.column("text" if form else "events")
    if form:
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    else:
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    for a, b in slices(size.astype(np.int64)):
        part = column.slice(a, b - a)
        doc, key, space, events = _runs([t or "" for t in part.to_pylist()], form) if form else _listed(part)
        both = np.sort(doc * space + key)
        first = np.flatnonzero(np.diff(both, prepend=-1))
        doc, key = np.divmod(both[first], space)
        cnt = np.diff(first, append=len(both))
        used, code = np.unique(key, return_inverse=True)
        yield a, b, doc, code, cnt, events(used)


class Source:
    """Documents ready to be counted: doc_id, columns that are kept, and the text or the events."""

    def __init__(self, df: DataFrame, form: Form | None):
        self.df, self.form = df, form
        self.kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        self._repeated: bool | None = None

    @property
    def repeated(self) -> bool:
        """Whether an id stands on several rows."""
        if self._repeated is None:
            self._repeated = bool(self.df.groupBy("doc_id").count().where("count > 1").limit(1).count())
        return self._repeated

    def where(self, condition: str) -> Source:
        out = Source(self.df.where(condition), self.form)
        out._repeated = False if self._repeated is False else None
        return out

    def histogram(self) -> DataFrame:
        """(doc_id, event, cnt)."""
        form = self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, _, doc, code, cnt, events in counted(batch, form):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + a)), events.take(pa.array(code)), pa.array(cnt, pa.int64())], ["doc_id", "event", "cnt"])

        out = self._input("doc_id").mapInArrow(run, f"doc_id {self.kinds['doc_id']}, event string, cnt bigint")
        return out.groupBy("doc_id", "event").agg(F.sum("cnt").alias("cnt")) if self.repeated else out

    def totals(self) -> DataFrame:
        """(event, n, df): occurrences and documents."""
        if self.repeated:
            return self.histogram().groupBy("event").agg(F.sum("cnt").alias("n"), F.count("*").alias("df"))
        form = self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, _, code, cnt, events in counted(batch, form):
                    n = np.bincount(code, cnt, len(events)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([events, pa.array(n), pa.array(np.bincount(code, minlength=len(events)).astype(np.int64))], ["event", "n", "df"])

        return self._input().mapInArrow(run, "event string, n bigint, df bigint").groupBy("event").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))

    def rows(self, vocabulary: list[str], keep: list[str], once: bool = False) -> DataFrame:
        """(doc_id, keep.., e, n): a row a document, its events as places in the vocabulary, and their counts (1 each with ``once``). Ids must not repeat."""
        form, names = self.form, pa.array(vocabulary, pa.string())
        cols = ["doc_id", *keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, doc, code, cnt, events in counted(batch, form):
                    place = pc.fill_null(pc.index_in(events, value_set=names), -1).to_numpy()[code] if len(code) else np.zeros(0, np.int32)
                    some = place >= 0
                    doc, place, cnt = doc[some], place[some], cnt[some]
                    ends = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place.astype(np.int32), np.ones(len(cnt), np.int64) if once else cnt.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in cols], *lists], [*cols, "e", "n"])

        schema = ", ".join(f"{c} {self.kinds[c]}" for c in cols)
        return self._input(*cols).mapInArrow(run, f"{schema}, e array<int>, n array<bigint>")

    def _input(self, *cols: str) -> DataFrame:
        return self.df.select(*cols, "text" if self.form else "events")


def flat(rows: DataFrame, vocabulary: list[str], cols: list[str]) -> DataFrame:
    """(cols.., event, cnt) of ``Source.rows``."""
    names = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("e")).to_numpy()
            doc = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(doc) for c in cols], names.take(batch.column("e").flatten()), batch.column("n").flatten()], [*cols, "event", "cnt"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*cols, "e", "n").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", event string, cnt bigint")
