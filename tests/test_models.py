import json

from pyspark.sql import functions as F

from vitaeflow.fixed_values import SYSTEM_PROMPT
from vitaeflow.functions import prompts as P
from vitaeflow.operators import answers as A
from vitaeflow.operators import models as M


def test_one_bad_input_costs_one_row(spark):
    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("ccc",)], "text STRING").coalesce(1)
    got = [(r["text"], r["vector"], r["error"]) for r in M.embed(rows, embedder).collect()]
    assert got == [("a", [1.0], None), ("bad", None, "model call failed: refused"), (None, None, "no input"), ("ccc", [3.0], None)]


def test_wrong_number_of_results_is_an_error(spark):
    rows = spark.createDataFrame([("a",)], "payload STRING")
    assert M.complete(rows, lambda p: []).first()["error"] == "model call failed: 0 results for 1 inputs"


def test_batches_and_single_use(spark):
    calls = spark.sparkContext.accumulator(0)
    texts = spark.sparkContext.accumulator(0)

    def embedder(batch):
        calls.add(1)
        texts.add(len(batch))
        return [[1.0]] * len(batch)

    rows = spark.range(100).select(F.col("id").cast("string").alias("text")).coalesce(1)
    made = M.embed(rows, embedder, batch_size=30).where("error IS NULL").select("vector", F.size("vector"))
    assert made.count() == 100
    made.collect()
    assert texts.value % 100 == 0 and calls.value == 4 * (texts.value // 100)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_CALLS", 2)
    for n, tasks in ((50, 3), (1000, 50)):
        rows = spark.range(n).select(F.col("id").cast("string").alias("text"))
        assert M.embed(rows, lambda b: [[1.0]] * len(b), batch_size=10, concurrency=3).rdd.getNumPartitions() == tasks


def test_a_call_is_tried_again(spark):
    calls = spark.sparkContext.accumulator(0)
    state = []

    def embedder(texts):
        calls.add(1)
        state.append(1)
        if len(state) == 1:
            raise RuntimeError("busy")
        return [[1.0]] * len(texts)

    rows = spark.range(20).select(F.col("id").cast("string").alias("text")).coalesce(1)
    assert M.embed(rows, embedder, batch_size=20).where("error IS NULL").count() == 20
    assert calls.value == 2


def test_request_shape(spark):
    body = json.loads(spark.range(1).select(P.chat_request(F.lit('say "é"\n'))).first()[0])
    assert body == {
        "messages": [{"role": "system", "content": [{"type": "text", "text": SYSTEM_PROMPT}]},
                     {"role": "user", "content": [{"type": "text", "text": 'say "é"\n'}]}],
        "temperature": 0.2, "top_p": 0.9, "max_tokens": 2000}


def test_prompts_hold_the_text(spark):
    row = spark.range(1).select(P.extraction_prompt(F.lit("CV")), P.summary_prompt(F.lit("CV"))).first()
    assert row[0].endswith("\nCurrículum:\nCV") and "'CV'" in row[1]


def test_replies_from_elsewhere(spark):
    asked = M.requests(spark.createDataFrame([(1, "p"), (2, "q")], "doc INT, payload STRING"), "doc")
    replies = spark.createDataFrame([("1", "b1"), ("1", "b2")], "request_id STRING, body STRING")
    got = sorted(tuple(r) for r in M.join_replies(asked, replies).select("request_id", "body").collect())
    assert got == [("1", "b2"), ("2", None)]


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("a b",), ("B  A\n",), ("",), (None,)], "text STRING")
    first, second, empty, null = [r["vector"] for r in M.hash_embed(rows, dimension=32).collect()]
    assert first == second and abs(sum(x * x for x in first) - 1) < 1e-6
    assert set(empty) == set(null) == {0.0}


def test_answers_in_rank_order(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "query_id INT, rank INT, answer STRING")
    assert sorted(tuple(r) for r in A.join_answers(rows).collect()) == [(1, "a\n\nb\n"), (2, "c\n")]


def test_a_malformed_result_costs_its_row(spark):
    odd = {"type": ["oops"], "cell": [1.0, None], "nan": [float("nan")], "huge": [1e300], "nested": [[1.0]], "text": "12", "empty": [],
           "none": None, "number": 3.0, "list": [1, 2], "good": [0.5]}
    rows = spark.createDataFrame([(name,) for name in odd], "text STRING").coalesce(1)
    got = {r["text"]: (r["vector"], r["error"]) for r in M.embed(rows, lambda texts: [odd[t] for t in texts]).collect()}
    assert got["good"] == ([0.5], None) and got["list"] == ([1.0, 2.0], None) and got["none"] == (None, "empty result")
    bad = [name for name in odd if name not in ("good", "list", "none")]
    assert all(got[name][0] is None and got[name][1].startswith("malformed result: ") for name in bad), got

    replies = {"dict": {"a": 1}, "bytes": b"x", "good": "{}"}
    rows = spark.createDataFrame([(name,) for name in replies], "payload STRING").coalesce(1)
    got = {r["payload"]: (r["body"], r["error"]) for r in M.complete(rows, lambda asked: [replies[p] for p in asked]).collect()}
    assert got == {"dict": (None, "malformed result: dict instead of text"), "bytes": (None, "malformed result: bytes instead of text"),
                   "good": ("{}", None)}


def test_results_that_are_no_list_are_an_error(spark):
    rows = spark.createDataFrame([("ab",)], "text STRING")
    assert M.embed(rows, lambda texts: "xy").first()["error"] == "model call failed: str instead of a list of results"


def test_a_text_instead_of_pages_is_an_error(spark):
    from vitaeflow.operators import documents

    files = spark.createDataFrame([(b"a",), (b"b",)], "content BINARY").coalesce(1)
    read = documents.read_pages(files, lambda data: "page" if data == b"a" else ["page"]).collect()
    assert [(r["pages"], r["error"]) for r in read] == [
        (None, "unreadable document: str instead of a list of pages"), (["page"], None)]


def test_calls_that_fail_share_their_pauses(spark):
    """Many calls fail for one input each: a pause for every one of them would take over a minute."""
    import time

    def refusing(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[1.0] for _ in texts]

    rows = spark.range(0, 2000, 1, 1).select("id", F.when(F.col("id") % 4 == 0, "bad").otherwise("good").alias("text"))
    began = time.time()
    made = M.embed(rows, refusing, batch_size=5).groupBy("text").agg(
        F.count("vector").alias("n"), F.count("error").alias("failed")).orderBy("text").collect()
    assert [tuple(r) for r in made] == [("bad", 0, 500), ("good", 1500, 0)]
    assert time.time() - began < 30
