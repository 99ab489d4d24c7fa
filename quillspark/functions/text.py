"""Canonicizers (text to text) and tokenizers (text to words) as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import CANONICIZERS, TOKENIZERS, LoadError, Param

#: What Python takes for white space.
WS = r"(?U)[\s\x1c-\x1f]+"
_WS_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"


def nothing() -> Column:
    """An array of no strings."""
    return F.array().cast("array<string>")


def words(t: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(t, WS), lambda x: x != "")


def chars(t: Column) -> Column:
    """Characters (code points)."""
    return F.filter(F.split(t, ""), lambda x: x != "")


@CANONICIZERS.register("unify_case")
def unify_case():
    """Lower-case everything."""
    return F.lower


@CANONICIZERS.register("normalize_whitespace")
def normalize_whitespace():
    """Runs of white space become one space; none at the ends."""
    return lambda t: F.trim(F.regexp_replace(t, WS, " "))


@CANONICIZERS.register("strip_punctuation")
def strip_punctuation():
    """Delete ASCII punctuation."""
    return lambda t: F.regexp_replace(t, r"\p{Punct}", "")


@CANONICIZERS.register("strip_numbers")
def strip_numbers():
    """Delete ASCII digits."""
    return lambda t: F.translate(t, "0123456789", "")


@F.pandas_udf(T.StringType())
def _ascii(t: pd.Series) -> pd.Series:
    return t.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


@CANONICIZERS.register("normalize_ascii")
def normalize_ascii():
    """Curly quotes and dashes to ASCII, then compatibility decomposition, then drop what isn't ASCII."""
    return lambda t: _ascii(F.replace(F.translate(t, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("...")))


@CANONICIZERS.register("smash_i")
def smash_i():
    """The word I in lower case."""
    return lambda t: F.regexp_replace(t, r"(?U)(?<!\w)I(?!\w)", "i")


@CANONICIZERS.register("punctuation_separator")
def punctuation_separator():
    """Spaces around each ASCII punctuation mark."""
    return lambda t: F.regexp_replace(t, r"(\p{Punct})", " $1 ")


_COMMENTS = {"c": [r"(?s)/\*.*?\*/", r"//[^\n]*"], "python": [r"#[^\n]*"], "html": [r"(?s)<!--.*?-->"]}


@CANONICIZERS.register("strip_comments", Param("style", "auto", choices=("auto", "c", "python", "html")))
def strip_comments(style: str):
    """Delete comments of C, Python or HTML, or all of these."""
    patterns = sum(_COMMENTS.values(), []) if style == "auto" else _COMMENTS[style]

    def strip(t: Column) -> Column:
        for p in patterns:
            t = F.regexp_replace(t, p, "")
        return t

    return strip


@CANONICIZERS.register("strip_null_chars")
def strip_null_chars():
    """Delete control characters but tab and line ends."""
    return lambda t: F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


@CANONICIZERS.register("strip_non_punctuation")
def strip_non_punctuation():
    """Keep ASCII punctuation and white space alone."""
    return lambda t: F.regexp_replace(t, r"[^\p{Punct}" + _WS_CLASS + "]", "")


@TOKENIZERS.register("whitespace")
def whitespace():
    """Words between white space."""
    return words


@TOKENIZERS.register("jieba", Param("mode", "accurate", choices=("accurate", "full", "search")))
def jieba_tokenizer(mode: str):
    """Chinese word segmentation; needs the jieba library."""
    def cut(series: pd.Series) -> pd.Series:
        try:
            import jieba
        except ImportError as e:
            raise LoadError("the jieba tokenizer needs the jieba library") from e
        how = {"accurate": lambda s: jieba.cut(s), "full": lambda s: jieba.cut(s, cut_all=True), "search": jieba.cut_for_search}[mode]
        return series.map(lambda s: None if s is None else [w for w in how(s) if w.strip()])

    return F.pandas_udf(cut, "array<string>")


def run_of(a: Column, i: Column, n: int, step: int = 1) -> list[Column]:
    """The n elements from the i-th on. ``slice`` would copy the whole array for every i."""
    return [F.element_at(a, (i + j * step).cast("int")) for j in range(n)]


def ngrams(a: Column, n: int, sep: str) -> Column:
    """Runs of n successive elements, joined. ``a`` must be a bound column."""
    return F.when(
        F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.concat_ws(sep, *run_of(a, i, n)))
    ).otherwise(nothing())
