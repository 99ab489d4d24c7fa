"""Command line: run, evaluate, detect-changes, list-components, manifest."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, style
from .plans.model import REGISTRIES, Config, QuillError, Spec
from .plans.pipeline import Pipeline, verdicts
from .plans.presets import PRESETS
from .sources import sinks
from .sources.documents import load_documents, load_manifest, summary


def _config(a: argparse.Namespace) -> Config:
    base = PRESETS[a.preset] if a.preset else Config()
    given = {"event_drivers": a.event, "canonicizers": a.canonicizer, "event_cullers": a.culler, "distance": a.distance, "method": a.method}
    return replace(base, **{k: v for k, v in given.items() if v})


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "evaluate", "detect-changes"):
        c = sub.add_parser(name)
        c.add_argument("path", help="a manifest file,author[,genre]; for detect-changes, a document")
        c.add_argument("--preset", choices=sorted(PRESETS))
        for flag in ("event", "canonicizer", "culler"):
            c.add_argument(f"-{flag[0]}" if flag != "culler" else "--culler", *([f"--{flag}"] if flag != "culler" else []), action="append", help="name or name:key=value,...")
        c.add_argument("-d", "--distance")
        c.add_argument("-m", "--method")
        c.add_argument("--json", action="store_true")
        c.add_argument("--base-dir")
        if name == "evaluate":
            c.add_argument("--mode", choices=("loo", "kfold", "cross-genre", "topic-controlled"), default="loo")
            c.add_argument("--folds", type=int, default=10)
            c.add_argument("--seed", type=int, default=42)
            c.add_argument("--train-genre")
            c.add_argument("--test-genre")
            c.add_argument("--csv")
        if name == "detect-changes":
            c.add_argument("--threshold", type=float, default=0.5)
            c.add_argument("--separator", default="\n\n")
    c = sub.add_parser("list-components")
    c.add_argument("kind", nargs="?", choices=sorted(REGISTRIES))
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("manifest")
    c.add_argument("path")
    c.add_argument("--base-dir")
    return p


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, pipeline = load_manifest(spark, a.path, a.base_dir), Pipeline(_config(a))
    ranked = pipeline.run(docs).cache()
    verdict = {r["doc_id"]: r["verdict"] for r in verdicts(ranked, pipeline.threshold).collect()} if pipeline.threshold is not None else {}
    titles = {r[0]: r[1] for r in docs.select("doc_id", "title").collect()}
    rows = ranked.orderBy("doc_id", "rank").collect()
    if a.json:
        out: dict = {}
        for r in rows:
            one = out.setdefault(r["doc_id"], {"document": titles[r["doc_id"]], "rankings": []} | ({"verdict": verdict[r["doc_id"]]} if verdict else {}))
            one["rankings"].append({"author": r["author"], "score": r["score"]})
        print(json.dumps({"lower_is_better": not pipeline.higher_is_better, "results": list(out.values())}, ensure_ascii=False))
        return
    for r in rows:
        if r["rank"] == 1:
            print(f"{titles[r['doc_id']]}" + (f" [{verdict[r['doc_id']]}]" if verdict else ""))
        print(f"  {r['rank']}. {r['author']}  {r['score']:.6f}")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    config = _config(a)
    docs = load_manifest(spark, a.path, a.base_dir).where("author IS NOT NULL").drop("known")
    if a.mode == "loo":
        scores = evaluate.leave_one_out(config, docs)
    elif a.mode == "kfold":
        scores = evaluate.k_fold(config, docs, a.folds, seed=a.seed)
    elif a.mode == "cross-genre":
        scores = evaluate.cross_genre(config, docs, a.train_genre, a.test_genre)
    else:
        scores = evaluate.topic_controlled(config, docs.withColumnRenamed("genre", "topic")).where("protocol = 'overall'")
    p = evaluate.predictions(scores, docs).cache()
    if a.csv:
        sinks.write_results_csv(p, a.csv)
    print(sinks.results_json(p) if a.json else sinks.results_csv(p))


def _changes(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = load_documents(spark, a.path).select(F.lit(0).cast("long").alias("doc_id"), "text")
    config = _config(a)
    got = style.style_changes(docs, config if config.event_drivers else replace(config, event_drivers=("word_events",)), a.threshold, a.separator)
    rows = [r.asDict() for r in got.orderBy("boundary_index").collect()]
    if a.json:
        print(json.dumps({"boundaries": [{k: r[k] for k in ("boundary_index", "score", "is_change")} for r in rows]}))
        return
    for r in rows:
        print(f"{r['boundary_index']} -> {r['boundary_index'] + 1}: {r['score']:.4f}" + (" change" if r["is_change"] else ""))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "list-components":
        got = [c for k, r in REGISTRIES.items() if a.kind in (None, k) for c in r.describe()]
        print(json.dumps(got) if a.json else "\n".join(f"{c['kind']:13} {c['name']:30} {c['about']}" for c in got))
        return 0
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        if a.command == "manifest":
            for r in summary(load_manifest(spark, a.path, a.base_dir)).orderBy("author").collect():
                print(f"{r['author'] or '(unknown)'}: {r['n_docs']}  {r['preview']!r}")
        else:
            {"run": _run, "evaluate": _evaluate, "detect-changes": _changes}[a.command](spark, a)
    except QuillError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
