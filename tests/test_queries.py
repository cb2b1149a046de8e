"""Every registered query outside the text operators against its SQL, and the rules for the registry."""

import duckdb
import pytest

from loomwork.plans import ORACLES, QUERIES
from loomwork.plans.similarity import QUERIES as SCORING

TABLES = "embeddings documents labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, oracle, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = oracle.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_queries_without_sql(spark, small):
    assert set(QUERIES) - set(ORACLES) == {"kmeans_prototype", "silhouette", "greedy_near_dup", "picture_near_dup", "adapter_epochs"}
    assert QUERIES["kmeans_prototype"](spark, small).count() == 16


def test_no_row_at_a_time_python(spark, small):
    for name in ("cosine_scores", "softmax_probs", "cache_logits"):
        plan = SCORING[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
