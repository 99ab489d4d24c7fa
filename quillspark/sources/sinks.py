"""Results as CSV and JSON. What is written is small (metrics, predictions of one evaluation) or goes out as Spark's own files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

from ..operators import evaluate


def _table(out: csv.writer, df: DataFrame, order: list[str]) -> None:
    out.writerow(df.columns)
    for row in df.orderBy(*order).toLocalIterator():
        out.writerow([f"{v:.6f}" if isinstance(v, float) else "" if v is None else v for v in row])


def results_csv(predictions: DataFrame) -> str:
    """Four sections with a blank line between: summary, authors, confusion, predictions; numbers with six digits."""
    buffer = io.StringIO()
    out = csv.writer(buffer, lineterminator="\n")
    one = evaluate.summary(predictions).crossJoin(evaluate.macro(predictions)).first().asDict()
    out.writerow(["metric", "value"])
    for k, v in one.items():
        out.writerow([k, "" if v is None else f"{float(v):.6f}"])
    for df, order in (
        (evaluate.by_author(predictions), ["author"]),
        (evaluate.confusion(predictions), ["true_author", "predicted_author"]),
        (predictions.select("fold", "doc_id", "true_author", "predicted_author", "top"), ["fold", "doc_id"]),
    ):
        buffer.write("\n")
        _table(out, df, order)
    return buffer.getvalue()


def write_results_csv(predictions: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(results_csv(predictions))


def results_json(predictions: DataFrame) -> str:
    one = evaluate.summary(predictions).crossJoin(evaluate.macro(predictions)).first().asDict()
    authors = [r.asDict() for r in evaluate.by_author(predictions).orderBy("author").collect()]
    return json.dumps({"summary": one, "authors": authors}, ensure_ascii=False)


def rankings_json(rankings: DataFrame) -> DataFrame:
    """(doc_id, json): one JSON list of {author, score} for each document, best first."""
    from pyspark.sql import functions as F

    got = F.array_sort(F.collect_list(F.struct("rank", "author", "score")))
    return rankings.groupBy("doc_id").agg(F.to_json(F.transform(got, lambda x: F.struct(x["author"].alias("author"), x["score"].alias("score")))).alias("json"))
