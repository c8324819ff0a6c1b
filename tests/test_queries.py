"""Queries against their SQL on the smallest tables, in another engine."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["edges_updist_afv", "obs_pairs", "obs_pred_pairs", "kernel_tailup_epa", "kernel_taildown_mariah", "cov_with_euclid", "torgegram_flowuncon", "torgegram_robust", "auroc", "design_matrix", "folder_distances", "avg_cov_topk", "closed_tidy_local_adjusted", "closed_glance", "closed_varcomp", "closed_loocv", "closed_predict_block", "blup_by_level", "blup_by_level_local"]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, engine, name):
    ours = __spark_entry__.queries()[name](spark, SF).toPandas()
    theirs = engine.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    cols = sorted(ours.columns)
    text = [sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))) for d in (ours, theirs)]
    for a, b in zip(*text, strict=True):
        assert a == b or [pytest.approx(float(x), rel=1e-6) == float(y) for x, y in zip(_numbers(a), _numbers(b), strict=True)]


def _numbers(text):
    import re

    return re.findall(r"-?\d+\.?\d*(?:e-?\d+)?", text)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15


def test_all_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
