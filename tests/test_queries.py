"""Every query of the engine's own operators against its SQL on DuckDB."""

import math
import os
import re

import duckdb
import pytest

from quillspark.plans import oracle, queries

Q, O = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: ("nan" if math.isnan(v) else f"{v + 0.0:.6f}") if isinstance(v, float) else str(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, sf, con, name):
    df = Q[name](spark, sf)
    got = con.execute(O[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, got.fetchall())


@pytest.mark.parametrize("name", ["event_porter_stemmer", "canon_normalize_ascii", "distance_ppm", "distance_ncd", "method_lda", "method_svm", "source_html"])
def test_rows(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_no_filter_is_copied_below_the_generator(spark, sf):
    """The optimizer must not repeat the splitting of a text inside a lambda."""
    from quillspark.plans.model import Config
    from quillspark.plans.pipeline import featured, histogram

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = histogram(featured(docs, Config(("character_ngram",)))[0])._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 1
