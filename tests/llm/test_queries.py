"""Queries of the corpus operators against their SQL."""

import os

import pytest

from tests.test_twins import TABLES, ordered, plain
from tidewatch.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    out = con.sql(queries.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert ordered(got) == ordered([tuple(plain(r[k]) for k in at) for r in out.fetchall()])


def test_base_scores_count_no_contexts(spark, sf, monkeypatch):
    """language_model_base has op4's own columns and makes none of its contexts."""
    from pyspark.sql import functions as F

    from tidewatch.llm import suffixlm

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    want = sorted(map(tuple, suffixlm.query(spark, sf).select(*names, F.round("base_score", 4)).collect()))

    def counted(*args, **more):
        raise AssertionError("contexts were counted")

    monkeypatch.setattr(suffixlm, "_frequent", counted)
    assert sorted(map(tuple, suffixlm.base(spark, sf).collect())) == want
