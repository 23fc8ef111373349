"""Queries against their SQL on the smallest tables; the driver does the same on larger ones."""

import os

import duckdb
import pytest

import __spark_entry__ as e

QUICK = ("dedup_by_text", "edge_fusion", "jaccard_pairs", "cosine_top", "eval_completeness", "eval_score", "eval_summary", "eval_consecutive", "denoise_markdown", "denoise_gate", "modality_route", "structured_records", "qa_pairs", "synthesis_gate")


def plain(rows, cols):
    number = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(str(sorted((c, number(v)) for c, v in zip(cols, r))) for r in rows)


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.exists(e.SMOKE_DIR), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(e.SMOKE_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{e.SMOKE_DIR}/{f}'")
    got = e.queries()[name](spark, e.SMOKE_DIR)
    want = con.execute(e.oracle_sql()[name])
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), [d[0] for d in want.description])
