"""Hard-negative mining against all pairs."""

import math

import duckdb
import numpy as np
import pytest

import oracle
from vitaeflow.llm import negative_mining as nm

NAMES = "vec_id bigint, embedding array<float>, label int"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100):
    taken = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
             if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    made = []
    for i, v, label in taken:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in taken if j != i)
        positives = [(j, -s) for s, j, other in scored if other == label][:5]
        for positive, score in positives:
            found = [(j, -s) for s, j, other in scored if other != label and 30 * score <= 100 * -s <= 90 * score][:10]
            made += [(i, positive, rank, j, score, s) for rank, (j, s) in enumerate(found, 1)]
    return sorted(made)


def mined(df, every=100):
    return sorted(tuple(r[c] for c in RESULT) for r in nm.mine(df, every).collect())


def vectors(seed, n, width=24, labels=4):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(labels, width))
    return [(i, (0.4 * centres[i % labels] + chance.normal(size=width)).astype(np.float32).tolist(), int(chance.integers(labels)))
            for i in range(n)]


@pytest.mark.parametrize("blocks", ["one block", "many blocks"])
def test_lists_match_all_pairs(spark, monkeypatch, blocks):
    if blocks == "many blocks":
        monkeypatch.setattr(nm, "ANCHORS", 7)
    rows = vectors(1, 900)
    same = rows[11][1]
    rows += [(i, same, i % 4) for i in range(2000, 2090)]  # ties
    rows += [(40, rows[5][1], 1), (40, rows[5][1], 1), (41, rows[5][1], 1)]  # repeated ids, rows, anchors
    df = spark.createDataFrame(rows, NAMES).repartition(6)
    assert mined(df, 20) == brute(rows, 20)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = vectors(2, 150, width=5, labels=2) + [
        (None, [1.0] * 5, 1), (200, None, 1), (300, [1.0] * 5, None), (400, [1.0, None], 1), (500, [float("nan")] * 5, 0),
        (600, [float("inf")] * 5, 0), (700, [], 0), (701, [], 1), (800, [1.0, 2.0], 1), (801, [1.0] * 9, 0), (900, [0.0] * 5, 0),
        (1000, [3e20] * 5, 0), (1001, [2.5e20] * 5, 0), (1002, [2e20] * 5, 1), (1100, [1e5, 1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, NAMES)
    big = 2**63 - 1
    expected = [(*r[:4], min(r[4], big), min(r[5], big)) for r in brute(rows)]
    got = mined(df.select("*", *(F.lit("own").alias(c) for c in ("anchor", "list", "code", "score", "rank", "copies"))))
    # scores beyond a long are taken as the nearest one, before any comparison
    huge = {1000, 1001, 1002}
    assert [r for r in got if not huge & set(r[:4])] == [r for r in expected if not huge & set(r[:4])]
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 100")) == []


def test_intervals_hold_for_every_pair():
    chance = np.random.default_rng(3)
    for width in (1, 2, 8, 64, 128):
        rotations = nm.Rotations(width)
        rows = np.floor(256 * chance.normal(size=(300, width)))
        rows[:5] = 0
        rows[5:9] = rows[9]
        rows[10:14, 1:] = 0
        codes, facts = nm.coded(rows, rotations)
        lower, upper = nm.Anchors(rows[:60], rotations).intervals(slice(0, 60), codes, facts)
        scores = rows[:60] @ rows.T
        assert (lower <= scores).all() and (scores <= upper).all()
    # and they are narrow enough to tell most pairs from near ones
    close = np.sqrt((rows[:60] ** 2).sum(1))[:, None] * np.sqrt((rows**2).sum(1))
    assert np.median((upper - lower)[20:, 20:] / close[20:, 20:]) < 0.9


def test_rotations_keep_lengths_and_turn_back():
    rows = np.random.default_rng(4).normal(size=(20, 32))
    rotations = nm.Rotations(32)
    turned = rotations.turned(rows)
    for t in range(nm.TURNS):
        assert np.allclose((turned[:, 32 * t : 32 * t + 32] ** 2).sum(1), (rows**2).sum(1))
    assert np.allclose(rotations.summed(turned), nm.TURNS * rows)


def test_most_pairs_are_passed_over(spark, monkeypatch):
    scored, real = [], nm.exact_scores
    rows = vectors(5, 3000, width=64, labels=4)
    block = np.array([r[1] for r in rows])
    whole = np.floor(256 * block)
    rotations = nm.Rotations(64)
    codes, facts = nm.coded(whole, rotations)
    monkeypatch.setattr(nm, "exact_scores", lambda a, b: scored.append(len(a)) or real(a, b))

    class Shared:
        order = np.argsort([r[2] for r in rows[:50]], kind="stable")
        low = np.full((50, 1), 1_600_000, np.int64)
        value = (np.arange(50)[order], np.array([r[2] for r in rows[:50]])[order], whole[:50][order], low, low * 100, low)

    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(3000)), pa.array([r[2] for r in rows], pa.int64()), nm._lists(whole),
                             pa.array([c.tobytes() for c in codes]), nm._lists(facts)], names=["vec_id", "label", "vector", "code", "facts"])
    found = pa.Table.from_batches(list(nm._scan(Shared, False, 10, iter([batch]))))
    assert sum(scored) < 0.5 * 50 * 3000 and found.num_rows
    assert min(found.column("score").to_pylist()) >= 1_600_000


def test_sql_agrees_on_odd_tables(spark, tmp_path):
    from vitaeflow.llm.registered import LLM_ORACLES, LLM_QUERIES

    rows = [(i * 5, v, label) for i, v, label in vectors(6, 400)] + [(None, [1.0], 1), (100, [1.0] * 30, 2), (900, [None], 2), (905, None, 1)]
    spark.createDataFrame(rows, NAMES).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = oracle.from_spark(LLM_QUERIES["op13_hard_negatives"](spark, str(tmp_path)))
    assert got[1] and got == oracle.from_sql(con, LLM_ORACLES["op13_hard_negatives"])
