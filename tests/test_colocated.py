"""Tables that lie by key against plain joins, and their plans."""

import pytest
from pyspark.sql import functions as F

from vitaeflow.sources.colocated import ColocatedTable

LEFT = "k STRING, a INT"
RIGHT = "k2 STRING, b INT"


@pytest.fixture
def laid(spark):
    made = []

    def lay(name, key, rows, schema, buckets=4, hot_rows=20):
        table = ColocatedTable(spark, f"colocated_{name}", key, buckets)
        made.append(table)
        return table.write(spark.createDataFrame(rows, schema), hot_rows)

    yield lay
    for table in made:
        table.drop()


def sides():
    """Hot here, hot there, hot in both, in one only, null, repeated."""
    left = [("here", i) for i in range(60)] + [("both", i) for i in range(50)] + [(None, i) for i in range(40)]
    left += [("there", 1), ("there", 2), ("there", 2)] + [(f"k{i}", i) for i in range(20)] + [("only", 1), ("", 3)]
    right = [("there", i) for i in range(70)] + [("both", i) for i in range(45)] + [(None, i) for i in range(5)]
    right += [("here", 7), ("here", 8)] + [(f"k{i}", -i) for i in range(0, 20, 2)] + [("k2", 5), ("absent", 1), ("", 4)]
    right += [("unmet", i) for i in range(60)]
    return left, right


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [20, 1000])
def test_same_rows_as_a_plain_join(spark, laid, how, hot_rows):
    left, right = sides()
    mine, theirs = laid("left", "k", left, LEFT, hot_rows=hot_rows), laid("right", "k2", right, RIGHT, hot_rows=hot_rows)
    if hot_rows == 20:
        assert rows(mine.hot_keys()) == [("both",), ("here",)] and rows(theirs.hot_keys()) == [("there",), ("unmet",)]
    plain = spark.createDataFrame(left, LEFT).join(
        spark.createDataFrame(right, RIGHT).withColumnRenamed("k2", "k"), "k", how)
    got = mine.joined(theirs, how)
    assert got.columns == plain.columns and rows(got) == rows(plain)
    assert rows(mine.read()) == sorted(left, key=str) and rows(theirs.read()) == sorted(right, key=str)


def test_hot_on_both_sides(spark, laid):
    left = [("x", i) for i in range(40)] + [("y", 1)]
    right = [("x", i) for i in range(30)] + [("z", 1)]
    mine, theirs = laid("left", "k", left, LEFT), laid("right", "k2", right, RIGHT)
    assert rows(mine.hot_keys()) == rows(theirs.hot_keys()) == [("x",)]
    assert mine.joined(theirs).count() == 1200 and mine.joined(theirs, "left").count() == 1201
    assert rows(mine.joined(theirs, "left_anti")) == [("y", 1)] and mine.joined(theirs, "left_semi").count() == 40


def test_nothing_moves(spark, laid):
    left, right = [(f"k{i}", i) for i in range(200)], [(f"k{i}", i) for i in range(0, 400, 2)]
    mine, theirs = laid("left", "k", left, LEFT), laid("right", "k2", right, RIGHT)
    joined = mine.joined(theirs, "left")
    assert joined.count() == 200
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan and "SinglePartition" not in plan
    assert plan.count("Bucketed: true") >= 2
    # every bucket is one task
    assert spark.table(mine.name).join(spark.table(theirs.name).hint("merge"), F.col("k") == F.col("k2")).rdd.getNumPartitions() == 4


def test_buckets_of_a_table_with_hot_keys_stay_where_they_are(spark, laid):
    left, right = sides()
    mine, theirs = laid("left", "k", left, LEFT), laid("right", "k2", right, RIGHT)
    plan = mine.joined(theirs, "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan


def test_appended_rows_lie_with_the_others(spark, laid):
    mine, theirs = laid("left", "k", [("x", i) for i in range(40)] + [("y", 1)], LEFT), laid("right", "k2", [("x", 1), ("w", 2)], RIGHT)
    added = [("x", 100), ("w", 5), (None, 6)]
    mine.append(spark.createDataFrame([(a, k) for k, a in added], "a INT, k STRING"))
    assert ("x", 100) in rows(mine._apart()) and ("w", 5) in rows(spark.table(mine.name))
    assert rows(mine.joined(theirs)) == sorted([("w", 5, 2), ("x", 100, 1), *(("x", i, 1) for i in range(40))], key=str)
    plan = mine.joined(theirs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_empty_tables_and_refusals(spark, laid):
    none, some = laid("left", "k", [], LEFT), laid("right", "k2", [("x", 1)], RIGHT)
    assert none.joined(some, "left").collect() == [] and rows(some.joined(none, "left")) == [("x", 1, None)]
    assert rows(some.joined(none, "left_anti")) == [("x", 1)]
    with pytest.raises(ValueError, match="buckets"):
        none.joined(laid("other", "k2", [("x", 1)], RIGHT, buckets=8))
    with pytest.raises(ValueError, match="clash"):
        none.joined(laid("clash", "k2", [("x", 1)], "k2 STRING, a INT"))
    with pytest.raises(ValueError, match="keys are"):
        none.joined(laid("typed", "k2", [(1, 1)], "k2 INT, b INT"))
    with pytest.raises(ValueError, match="unknown join"):
        none.joined(some, "cross")
