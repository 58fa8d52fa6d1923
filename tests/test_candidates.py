from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaeflow import session
from vitaeflow.operators import candidates as C
from vitaeflow.operators import chunks as K
from vitaeflow.operators import listing

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
TARGET = "run STRING, a STRING, pdf_name STRING"
STAGED = TARGET + ", ingest_ts TIMESTAMP"
DAY = [datetime(2024, 1, d) for d in range(1, 10)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(params=["broadcast", "shuffle"])
def side(request, monkeypatch):
    """Both ways to join a staged or key side."""
    if request.param == "shuffle":
        monkeypatch.setattr(session, "measured_bytes", lambda df: session.BROADCAST_BYTES + 1)
    return request.param


def test_merge(spark, side):
    target = spark.createDataFrame([("1", "x", "f1"), ("2", "y", "f2"), ("3", None, "f3")], TARGET)
    staged = spark.createDataFrame(
        [("2", "old", "f7", DAY[0]), ("2", "new", "f6", DAY[1]), ("4", "n", "a", DAY[0]), ("4", "m", "b", DAY[0]),
         ("3", None, "f3", DAY[0]), (None, "lost", "f", DAY[0])], STAGED)
    merged = C.merge(target, staged, "run")
    assert rows(merged, "run", "a", "pdf_name", "action") == [
        ("1", "x", "f1", "KEPT"), ("2", "new", "f6", "UPDATED"), ("3", None, "f3", "UPDATED"), ("4", "m", "b", "NEW")]
    assert rows(C.changes(merged, "run"), "RUN", "action") == [("2", "UPDATED"), ("3", "UPDATED"), ("4", "NEW")]
    assert rows(C.inserted(C.changes(merged, "run")), "RUN") == [("4",)]
    assert rows(C.updated(C.changes(merged, "run")), "RUN") == [("2",), ("3",)]
    careful = C.merge(target, staged, "run", only_changed=True)
    assert dict(rows(careful, "run", "action")) == {"1": "KEPT", "2": "UPDATED", "3": "KEPT", "4": "NEW"}


keys = st.sampled_from(["1", "2", "3", "hot"])
staged_rows = st.lists(st.tuples(keys, st.sampled_from("xyz"), st.sampled_from("fgh"), st.sampled_from(DAY)), max_size=12)


@SLOW
@given(held=st.dictionaries(keys, st.sampled_from("xyz"), max_size=4), staged=staged_rows)
def test_merge_twice_is_merge_once(spark, held, staged):
    target = spark.createDataFrame([(k, v, "old") for k, v in held.items()], TARGET)
    incoming = spark.createDataFrame(staged, STAGED)
    once = C.merge(target, incoming, "run")
    twice = C.merge(once.drop("action"), incoming, "run")
    assert rows(once.drop("action"), "run", "a", "pdf_name") == rows(twice.drop("action"), "run", "a", "pdf_name")
    want = {k: (v, "old") for k, v in held.items()}
    for key, a, name, _ in sorted(staged, key=lambda r: (r[3], r[2], r[1])):
        want[key] = (a, name)
    assert {r[0]: (r[1], r[2]) for r in rows(once, "run", "a", "pdf_name")} == want


def test_split_keeps_every_row(spark):
    made = spark.createDataFrame([(k,) for k in ["1", "", None, " no especificado", "2 "]], "run STRING")
    valid, invalid = C.split_by_key(made, "run")
    assert rows(valid, "run") == [("1",), ("2 ",)]
    assert invalid.count() == 3


def test_corrections(spark, side):
    made = spark.createDataFrame([("1", "a", "p"), ("2", "b", "q")], "file STRING, x STRING, run STRING")
    fixes = spark.createDataFrame([("1", None, "R"), ("9", "z", "z")], "file STRING, x STRING, run STRING")
    assert rows(C.apply_corrections(made, fixes, "file"), "file", "x", "run") == [("1", "a", "R"), ("2", "b", "q")]
    rekeyed = spark.createDataFrame([("1", "7"), ("2", None)], "file STRING, new_file STRING")
    assert rows(C.apply_corrections(made, rekeyed, "file"), "file", "x") == [("2", "b"), ("7", "a")]


def test_changed_key_rows(spark, side):
    made = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1)], "RUN STRING, n INT")
    changed = spark.createDataFrame([("hot", "NEW"), ("gone", "UPDATED")], "RUN STRING, action STRING")
    assert C.with_changed_key(made, changed).count() == 50


def test_refresh_leaves_other_keys(spark, side):
    old = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("c", 0, "4")], "RUN STRING, chunk_no INT, text STRING")
    fresh = spark.createDataFrame([("x", 0, "a"), ("y", 0, "b"), ("z", 0, "d")], "text STRING, chunk_no INT, RUN STRING")
    keys = spark.createDataFrame([("a",), ("a",), ("c",), ("d",)], "RUN STRING")
    assert rows(K.refresh(old, fresh, keys), "RUN", "chunk_no", "text") == [("a", 0, "x"), ("b", 0, "3"), ("d", 0, "z")]
    assert rows(K.without_keys(old, keys), "RUN") == [("b",)]


@pytest.mark.parametrize("join", ["semi", "anti", "refresh", "listing"])
def test_hot_keys_are_split(spark, monkeypatch, join):
    """A third of the rows on one key, no broadcasts: the final plan splits that key."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        number = F.col("id").cast("string")
        made = spark.range(0, 300_000, 1, 4).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), number)).alias("RUN"), F.sha2(number, 256).alias("text"))
        keys = spark.range(1000).select(F.concat(F.lit("k"), number).alias("RUN")).unionByName(
            spark.createDataFrame([("hot",)], "RUN STRING")).withColumn("action", F.lit("NEW"))
        result = {
            "semi": lambda: C.with_changed_key(made, keys),
            "anti": lambda: K.without_keys(made, keys),
            "refresh": lambda: K.refresh(made, made, keys),
            "listing": lambda: listing.candidate_listing(
                made, keys.select(F.col("RUN").alias("run_norm"), F.encode("RUN", "utf-8").alias("content")), "RUN", "data_uri"),
        }[join]()
        rows = result.toArrow().num_rows
        assert rows == {"semi": 100_666, "anti": 199_334, "refresh": 300_000, "listing": 300_000}[join]
        plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("skew=true") == (2 if join == "refresh" else 1)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_keys(spark):
    held = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "RUN STRING")
    assert rows(K.keys_of(held), "RUN") == [("a",), ("b",), ("c",)]
    assert rows(K.keys_of(held, limit=2), "RUN") == [("a",), ("b",)]
    quoted = spark.createDataFrame([("x' or 'a'='a",), ("b",)], "RUN STRING")
    assert K.rows_of_key(quoted, "x' or 'a'='a").count() == 1


def test_grid(spark):
    made = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "n INT, s STRING")
    assert [r["n"] for r in C.grid(made, F.col("s") == "a", [F.desc("n")]).collect()] == [3, 2]
    assert [r["n"] for r in C.grid(made, order_by=["n"], limit=1).collect()] == [1]
    assert C.row_count(made).first()["n_rows"] == 3
