"""The chain of a reply on messages with words of the keyword rules, which its SQL does not have."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.operators import policy
from threadloom.plans import catalog, derived  # noqa: F401


@pytest.fixture
def worded(spark, small, tmp_path):
    """The small tables; each item names a topic of the keyword rules, or asks for a change to an account."""
    for t in ("documents", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    said = F.concat("text", F.when(F.col("item_id") % 2 == 0, " the court heard it").otherwise(" please refund me"))
    rows = spark.read.parquet(f"{small}/benchmark.parquet").withColumn("text", said).toPandas()
    rows.to_parquet(tmp_path / "benchmark.parquet")
    return str(tmp_path)


def sql_rows(path, sql, columns):
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
        return sorted((tuple(map(str, r)) for r in c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("name", ["agent_chain", "agent_run"])
def test_replies_to_worded_items_equal_sql(spark, worded, name):
    got = catalog.QUERIES[name](spark, worded)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sql_rows(worded, catalog.ORACLE[name], got.columns)


def test_policy_without_a_rule(spark):
    row = spark.createDataFrame([("they lost in court, refund me now", "good", 0.9, True, [9.0], False, True, 0, False)], "text string, intent string, conf double, agrees boolean, scores array<double>, conflict boolean, sufficient boolean, unsupported int, multi boolean")
    codes = lambda *rules: policy.decide(row, 0.5, 5.0, 1, ["good"], *rules).first()["reason_codes"]
    assert codes() == "sensitive_topic,account_action_required" and codes(None) == "account_action_required" and codes(None, None) == ",".join(policy.HANDLED)
