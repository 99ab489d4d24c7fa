"""Benchmark decontamination: documents that hold benchmark items, by size-partitioned MinHash containment search.

A document is contaminated by an item if it has at least ``THRESHOLD`` of the item's distinct shingles of
``SHINGLE`` words (lower-cased letters and digits; an item of fewer words is one shingle). See ``containment``.

Cases: null ids, null texts and texts without words match nothing; so do items that are null or wordless. Rows
that repeat an id give the largest containment once. An empty table of items leaves every document. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .containment import contained, without

SHINGLE, THRESHOLD = 5, 0.6

ORACLE_SQL = rf"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT kind, id, unnest([array_to_string(ws[i:i+{SHINGLE - 1}], ' ') for i in range(1, len(ws) - {SHINGLE - 2})]) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY 1),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM s b JOIN s d ON d.g = b.g AND d.kind = 'd' WHERE b.kind = 'b' GROUP BY 1, 2)
SELECT doc_id, item_id, c::DOUBLE / n AS containment FROM m JOIN n ON m.item_id = n.id WHERE c::DOUBLE / n >= {THRESHOLD}
"""


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, containment) of the documents that hold benchmark items."""
    return contained(docs, benchmark, options.pop("k", SHINGLE), options.pop("threshold", THRESHOLD), id_col=id_col, text_col=text_col, **options)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, in their own columns, without the contaminated ones: each row is judged by its own text, and one without an id stays."""
    return without(docs, benchmark, options.pop("k", SHINGLE), options.pop("threshold", THRESHOLD), id_col=id_col, text_col=text_col, **options)
