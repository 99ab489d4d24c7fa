"""Cutting long works into documents: without e-book front matter, at headings or chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
CHAPTER = r"(?m)^[ \t]*(?:CHAPTER|Chapter)[ \t]+(?:[IVXLCDM]+|[0-9]+)\b[^\n]*$"
NUMERAL = r"(?m)^[ \t]*[IVXLCDM]+\.?[ \t]*$"


def strip_gutenberg(t: Column) -> Column:
    """What stands between the lines that begin and end an e-book, where it has them."""
    body = F.regexp_replace(t, r"(?s)\A.*?\*\*\* ?START OF (?:THE|THIS) PROJECT [^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)\n[^\n]*\*\*\* ?END OF (?:THE|THIS) PROJECT .*\z", ""), _EDGE, "")


def split_parts(docs: DataFrame, pattern: str, min_words: int = 1) -> DataFrame:
    """(doc_id, part, n_words, body): the parts of each text between matches of a pattern that have at least min_words words."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("part", "body")).withColumn("body", F.regexp_replace("body", _EDGE, ""))
    return parts.withColumn("n_words", F.size(words(F.col("body")))).where(F.col("n_words") >= min_words).select("doc_id", "part", "n_words", "body")


def split_chapters(docs: DataFrame, min_words: int = 100) -> DataFrame:
    """As split_parts, at chapter headings, or at lines of a Roman numeral where headings give fewer than three parts."""
    by_heading = F.size(F.split("text", CHAPTER)) >= 3
    return split_parts(docs.where(by_heading), CHAPTER, min_words).unionByName(split_parts(docs.where(~by_heading), NUMERAL, min_words))


def roman(s: Column) -> Column:
    """Value of a Roman numeral; null for what is none."""
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    look = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    digits = F.transform(F.filter(F.split(F.upper(s), ""), lambda x: x != ""), lambda x: look[x])
    # from the right: a digit below the largest so far counts against
    total = F.aggregate(
        F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), F.greatest(a["last"], d).alias("last")), lambda a: a["sum"],
    )
    return F.when(F.upper(s).rlike("^[IVXLCDM]+$"), total)
