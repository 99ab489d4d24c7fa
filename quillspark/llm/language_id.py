"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary. The probability of a word (with the
vocabulary's mark in front) in a language is the sum over all its segmentations into pieces of the product of their
probabilities, by the forward algorithm; a text's is the product over its words. Piece probabilities are fitted by
expectation-maximisation (forward and backward sums) on whole texts of at most ``max_docs`` documents of each labelled language,
chosen by hash of the id; scoring covers every document and every word.

Forward sums run on all distinct words of a slice at once, position by position; a character that no piece begins with is passed at a fixed
small probability, so every word has a score.

Cases: a null text, or one without words, has a null language and score. A null id is scored. Texts of equal score for two languages get
the first in alphabetical order. Repeated rows are scored alike. Without labelled texts every language is null. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textcore import Words, mix, segment_sum, slices, text_slices

VOCABULARY = os.environ.get("QUILLSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK, LONGEST, TABLE = "▁", 16, 1 << 17
UNKNOWN = 1e-7
_STEP = np.uint64(0x9FB21C651E98DF25)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[str]:
    """The vocabulary's pieces that a lower-cased word can hold, at most LONGEST characters each."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).lower()
        if 0 < len(p) <= LONGEST and p.lstrip(MARK).isalnum() and MARK not in p[1:]:
            out.add(p)
    return sorted(out)


def _hash(text: str) -> int:
    h = len(text)
    for c in text:
        h = (h * int(_STEP) + ord(c) + 1) & (2**64 - 1)
    return int(mix(np.array([h], np.uint64))[0])


@dataclass(frozen=True)
class Pieces:
    """Open-addressing table from the hash of a piece to its number."""

    keys: np.ndarray
    values: np.ndarray
    count: int
    lengths: tuple[int, ...]

    @staticmethod
    def of(vocabulary: list[str]) -> Pieces:
        keys, values = np.zeros(TABLE, np.uint64), np.full(TABLE, -1, np.int32)
        for n, p in enumerate(vocabulary):
            h = _hash(p)
            at = h % TABLE
            while values[at] >= 0:
                at = (at + 1) % TABLE
            keys[at], values[at] = h, n
        return Pieces(keys, values, len(vocabulary), tuple(sorted({len(p) for p in vocabulary})))

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h % np.uint64(TABLE)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            v = self.values[at[todo]]
            hit = (v >= 0) & (self.keys[at[todo]] == h[todo])
            out[todo[hit]] = v[hit]
            todo = todo[(v >= 0) & ~hit]
            at[todo] = (at[todo] + 1) % TABLE
        return out


class Lattice:
    """The pieces that end at each position of some distinct words, words sorted by length, the longest first.

    ``arcs``: for each piece length (length, words, piece numbers, where the pieces that end at each position begin). All is in
    proportion to the words' characters, so one word of a million letters costs what as many short ones do in memory (in time it is
    slower, as it is walked letter by letter).
    """

    def __init__(self, w: Words, table: Pieces):
        _, first, self.row = np.unique(w.hash, return_index=True, return_inverse=True)
        size = (w.end - w.start)[first] + 1
        order = np.argsort(-size, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.row = back[self.row]
        start, self.size = w.start[first][order], size[order]
        off = np.concatenate([[0], np.cumsum(self.size)])
        owner = np.repeat(np.arange(len(self.size)), self.size)
        inner = np.arange(off[-1]) - off[owner]
        cp = w.cp[np.maximum(inner + start[owner] - 1, 0)].astype(np.uint64)
        cp[off[:-1]] = ord(MARK)
        self.longest = int(self.size[0]) if len(self.size) else 0
        self.arcs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in table.lengths:
            m = len(cp) - n + 1
            if m <= 0:
                continue
            v = np.full(m, n, np.uint64)
            for j in range(n):
                v = v * _STEP + cp[j : j + m] + np.uint64(1)
            inside = np.flatnonzero(inner[:m] + n <= self.size[owner[:m]])
            piece = table.find(mix(v[inside]))
            ok = piece >= 0
            at, piece = inside[ok], piece[ok]
            ends = inner[at] + n
            by = np.argsort(ends, kind="stable")
            at, piece, ends = at[by], piece[by], ends[by]
            self.arcs.append((n, owner[at], piece, np.searchsorted(ends, np.arange(self.longest + 2))))
        self.alive = np.searchsorted(-self.size, -np.arange(self.longest + 1), "right")  # words at least t long

    def ending(self, t: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, piece numbers) of the pieces that end at t; a word has one piece of a length there at most."""
        for n, word, piece, edge in self.arcs:
            if edge[t] < edge[t + 1]:
                yield n, word[edge[t] : edge[t + 1]], piece[edge[t] : edge[t + 1]]

    def forward(self, prob: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Log probability by word and language; also the scaled sums at each position and the log scales of the words that reach it
        (only the last ``LONGEST`` positions unless all are to be kept)."""
        words, langs = len(self.size), prob.shape[1]
        sums, scale = {0: np.ones((words, langs))}, {0: np.zeros(words)}
        out = np.zeros((words, langs))
        for t in range(1, self.longest + 1):
            n_alive = self.alive[t]
            new, last = sums[t - 1][:n_alive] * UNKNOWN, scale[t - 1][:n_alive]
            for n, word, piece in self.ending(t):
                shift = np.exp(scale[t - n][word] - last[word])[:, None]
                new[word] += sums[t - n][word] * prob[piece] * shift
            top = new.max(axis=1)
            new /= top[:, None]
            sums[t], scale[t] = new, last + np.log(top)
            done = slice(self.alive[t + 1] if t < self.longest else 0, n_alive)
            out[done] = np.log(np.maximum(new[done], 1e-300)) + scale[t][done][:, None]
            if not keep and t >= LONGEST:
                del sums[t - LONGEST], scale[t - LONGEST]
        return out, sums, scale

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece by language, words weighted by ``weight`` (words by languages)."""
        total, sums, scale = self.forward(prob, keep=True)
        langs = prob.shape[1]
        counts = np.zeros(prob.shape)
        behind = [np.zeros((n, langs)) for n in self.alive]
        for t in range(self.longest, 0, -1):
            ended = slice(self.alive[t + 1] if t < self.longest else 0, self.alive[t])
            here = behind[t]
            here[ended] = np.exp(scale[t][ended][:, None] - total[ended])  # scaled so that sums * behind is a posterior
            n_alive = self.alive[t]
            behind[t - 1][:n_alive] += here * UNKNOWN * np.exp(scale[t - 1][:n_alive] - scale[t])[:, None]
            for n, word, piece in self.ending(t):
                back = here[word] * prob[piece] * np.exp(scale[t - n][word] - scale[t][word])[:, None]
                post = sums[t - n][word] * back * weight[word]
                for l in range(langs):
                    counts[:, l] += np.bincount(piece, post[:, l], len(prob))
                behind[t - n][word] += back
        return counts


@dataclass(frozen=True)
class Model:
    """Languages, the piece table and the probabilities (pieces by languages)."""

    languages: list[str]
    table: Pieces
    prob: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and its number of words."""
        w = Words(texts)
        if not len(w):
            return np.zeros((len(texts), len(self.languages))), w.counts
        lattice = Lattice(w, self.table)
        return segment_sum(lattice.forward(self.prob)[0][lattice.row], w.offset), w.counts


def fit(texts: list[str], languages: list[str], vocabulary: str = VOCABULARY, rounds: int = 4, smooth: float = 0.1) -> Model:
    """Piece probabilities by language from whole labelled texts, by expectation-maximisation."""
    table = Pieces.of(pieces(vocabulary))
    names = sorted(set(languages))
    prob = np.full((table.count, len(names)), 1 / table.count)
    if not names:
        return Model(names, table, prob)
    parts = []
    lang = np.searchsorted(names, languages)
    for lo, hi in slices(texts):
        w = Words(texts[lo:hi])
        if len(w):
            lattice = Lattice(w, table)
            weight = np.zeros((len(lattice.size), len(names)))
            np.add.at(weight, (lattice.row, np.repeat(lang[lo:hi], w.counts)), 1)
            parts.append((lattice, weight))
    for _ in range(rounds if parts else 0):
        counts = sum(lattice.expected(prob, weight) for lattice, weight in parts) + smooth / table.count * 100
        prob = counts / counts.sum(axis=0)
    return Model(names, table, prob)


def train(docs: DataFrame, max_docs: int = 200, vocabulary: str = VOCABULARY) -> Model:
    """Fit on at most max_docs whole documents of each language in the table's lang column."""
    from pyspark.sql import Window as W

    some = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r[0] for r in some.select("doc_id", "lang").withColumn("__r", rank).where(F.col("__r") <= max_docs).select("doc_id").collect()]
    rows = some.select("doc_id", "lang", "text").where(F.col("doc_id").isin(ids)).collect() if ids else []
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([r[2] for r in rows], [r[1] for r in rows], vocabulary)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, per_word, margin): the likeliest language, its log probability a word, and how far the next lies behind a word."""
    names = np.array(model.languages or [None], object)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, texts in text_slices(batch.column(1)):
            s, n = model.scores(texts) if model.languages else (np.zeros((hi - lo, 1)), np.zeros(hi - lo, np.int64))
            none = n == 0
            each = s / np.maximum(n, 1)[:, None]
            best = s.argmax(axis=1)
            top = each[np.arange(len(s)), best]
            rest = np.sort(each, axis=1)[:, -2] if s.shape[1] > 1 else top
            yield {
                "doc_id": batch.column(0)[lo:hi], "language": [None if z else names[b] for z, b in zip(none, best, strict=True)],
                "per_word": pa.array(top, mask=none), "margin": pa.array(top - rest, mask=none),
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, language string, per_word double, margin double")
