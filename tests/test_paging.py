"""Pages of a table that is laid out in its order."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaeflow.operators import candidates, paging
from vitaeflow.session import new_folder


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3) | st.none()), max_size=40),
       st.integers(1, 15), st.integers(1, 9))
def test_pages_joined_are_the_sorted_table(spark, made, part_rows, size):
    rows = spark.createDataFrame(made, "s string, n int")
    held = paging.lay_out(rows, ["s", "n desc"], new_folder(spark, "laid"), part_rows)
    pages = held.pages(size)
    assert [n for _, n in pages] == [size] * (len(made) // size) + ([len(made) % size] if len(made) % size else [])
    found, after = [], None
    for expected, n in pages:
        assert after == expected
        page = held.page(size, after).collect()
        assert len(page) == n
        after = page[-1]["_place"]
        found += [(r.s, r.n) for r in page]
    assert held.page(size, after).collect() == [] or not made
    assert found == [tuple(r) for r in candidates.grid(rows, order_by=["s", F.desc("n")]).collect()]


def test_a_page_reads_its_part_alone(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    held = paging.lay_out(rows, ["n"], new_folder(spark, "laid"), part_rows=100)
    after = held.pages(50)[10][0]
    page = held.page(50, after)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place," in plan and "LessThanOrEqual(_place," in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.n for r in page.collect()] == list(range(500, 550))
    assert len(page.inputFiles()) > 1  # the table's; those that are read are fewer
    assert page.select(F.input_file_name().alias("f")).distinct().count() <= 2


def test_a_page_from_a_key_on(spark):
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("c", 2), ("e", 3)], "s string, n int")
    held = paging.lay_out(rows, ["s"], new_folder(spark, "laid"), part_rows=2)
    assert [r.s for r in held.after_key("b", "s", 2).collect()] == ["c", "c"]
    assert [r.s for r in held.after_key("d", "s", 9).collect()] == ["e"]
    assert held.after_key("f", "s", 2).collect() == []
    down = paging.lay_out(rows, ["s desc"], new_folder(spark, "laid"), part_rows=2)
    assert [r.s for r in down.after_key("d", "s desc", 9).collect()] == ["c", "c", "a"]
    with pytest.raises(ValueError, match="positive"):
        held.page(0)
