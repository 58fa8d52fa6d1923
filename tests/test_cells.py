"""The cell index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_similarity import BLOCKS, brute, random_sides
from vitaeflow.operators import similarity as S
from vitaeflow.operators.cells import CellIndex


def sides(spark, queries, chunks):
    return (spark.createDataFrame(queries, "query_id INT, vector ARRAY<FLOAT>"),
            spark.createDataFrame(chunks, "RUN STRING, chunk_no INT, vector ARRAY<FLOAT>").repartition(5))


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["RUN"], r["chunk_no"], round(r["score"], 8)))
    return out


@pytest.mark.parametrize("name", BLOCKS)
@pytest.mark.parametrize("per_candidate", [False, True])
def test_same_rows_as_the_scan(spark, tmp_path, name, per_candidate):
    queries, chunks = random_sides(3, n_queries=12)
    chunks += [("tiny", 1, [1e-30] * 8), ("other length", 1, [2.0]), ("other length", 2, [-2.0])]
    asked, held = sides(spark, queries, chunks)
    index = CellIndex.build(held, str(tmp_path / "index"), cells=12)
    got = found(index.top_k(asked, 4, per_candidate=per_candidate, **BLOCKS[name]))
    assert got == brute(queries, chunks, 4, per_candidate) == found(S.top_k(asked, held, 4, per_candidate=per_candidate))
    # opened again, it is the same index
    again = CellIndex(spark, index.path)
    assert again.cells == index.cells and found(again.top_k(asked, 4, per_candidate=per_candidate)) == got


def test_far_cells_are_not_read(spark, tmp_path):
    made = np.random.default_rng(5)
    centres = made.normal(size=(40, 16)) * 3
    chunks = [(f"r{i % 40}", i, (centres[i % 40] + 0.05 * made.normal(size=16)).tolist()) for i in range(4000)]
    queries = [(i, (centres[i] + 0.05 * made.normal(size=16)).tolist()) for i in range(3)]
    asked, held = sides(spark, queries, chunks)
    index = CellIndex.build(held, str(tmp_path / "index"), cells=60)
    assert len(index.cells) >= 40
    assert found(index.top_k(asked, 5)) == brute(queries, chunks, 5)
    assert sum(index.visits) < len(index.cells) / 3
    some = index.chunks().where(F.col("cell").isin([c[0] for c in index.cells[:3]]))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    total = len(index.chunks().inputFiles())
    scanned = some.select(F.input_file_name()).distinct().count()
    assert scanned < total / 4


def test_lengths_the_sample_lacks_are_searched(spark, tmp_path, monkeypatch):
    from vitaeflow.operators import cells

    monkeypatch.setattr(cells, "SAMPLE", 0)  # nothing is learned: one cell for each length, never ruled out
    queries, chunks = random_sides(7, n_queries=5)
    asked, held = sides(spark, queries, chunks)
    index = CellIndex.build(held, str(tmp_path / "index"), cells=4)
    assert {c[2] for c in index.cells} == {None}
    assert found(index.top_k(asked, 3)) == brute(queries, chunks, 3)


def test_empty_sides(spark, tmp_path):
    queries, chunks = random_sides(8, n_queries=2)
    asked, held = sides(spark, queries, chunks)
    index = CellIndex.build(held, str(tmp_path / "one"), cells=4)
    assert index.top_k(asked.limit(0), 3).collect() == []
    assert index.top_k(asked.limit(0), 3).columns == S.top_k(asked, held, 3).columns
    nothing = CellIndex.build(held.limit(0), str(tmp_path / "two"), cells=4)
    assert nothing.top_k(asked, 3).collect() == []


def test_queries_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    queries, chunks = random_sides(21, n_queries=12)
    asked, held = sides(spark, queries, chunks)
    index = CellIndex.build(held, str(tmp_path / "index"), cells=6)
    monkeypatch.setattr(S, "_query_blocks", lambda *args: pytest.fail("queries are collected"))
    assert found(index.top_k(asked, 3)) == brute(queries, chunks, 3)
