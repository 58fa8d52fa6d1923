"""Rows dropped by a bitmap of keys."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_jobs import rows
from vitaeflow import session
from vitaeflow.operators import listing, prefilter


def test_bits():
    assert prefilter.bits_for(0) == prefilter.bits_for(2048) == 32_768
    assert prefilter.bits_for(2049) == 65_536 and prefilter.bits_for(10**12) == prefilter.MOST_BITS


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1-", max_size=3) | st.none(), max_size=30), st.lists(st.text("ab1-", max_size=3) | st.none(), max_size=10))
def test_no_row_is_lost(spark, held, wanted):
    stored = spark.createDataFrame([(k, i) for i, k in enumerate(held)], "`a.key` string, n int")
    keys = spark.createDataFrame([(k,) for k in wanted], "`a.key` string")
    near = {r.n for r in prefilter.may_match(stored, keys, "a.key").collect()}
    assert {i for i, k in enumerate(held) if k is not None and k in wanted} <= near


def test_few_others_pass(spark):
    stored = spark.range(200_000).select(F.col("id").cast("string").alias("k"), "id")
    keys = spark.range(0, 200_000, 20).select(F.col("id").cast("string").alias("k"))
    near = prefilter.may_match(stored, keys, "k")
    assert near.columns == ["k", "id"]
    passed = {r.id for r in near.collect()}
    assert set(range(0, 200_000, 20)) <= passed
    assert len(passed) < 10_000 + 0.07 * 190_000
    # a bitmap that is too small for its keys lets more pass, and loses none
    few = {r.id for r in prefilter.may_match(stored, keys, "k", n_keys=1).collect()}
    assert set(range(0, 200_000, 20)) <= few and len(few) > len(passed)


def shuffled_bytes(df):
    """Bytes that the exchanges of an executed plan moved."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.finalPhysicalPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += plan.metrics().get("dataSize").get().value()
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_long_lists_move_fewer_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    stored = spark.range(20_000).select(F.col("id").cast("string").alias("run_norm"), F.repeat(F.lit("x"), 500).cast("binary").alias("content"))
    keys = spark.range(0, 20_000, 10).select(F.col("id").cast("string").alias("RUN del postulante"))

    def fetched():
        return listing.fetch_documents(keys, stored)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, found = shuffled_bytes(fetched()), rows(fetched(), "run_norm", "content")
        monkeypatch.setattr(listing, "may_match", lambda rows, keys, key: rows)
        all_, same = shuffled_bytes(fetched()), rows(fetched(), "run_norm", "content")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == same and len(found) == 2000 and all(content is not None for _, content in found)
    assert few < all_ / 4
