"""Documents by key with equal contents kept once."""

from pyspark.sql import functions as F

from test_jobs import rows
from vitaeflow.operators.listing import fetch_documents
from vitaeflow.sources.contents import ContentStore

FILES = "path string, t int, content binary"


def files(spark, *made):
    return spark.createDataFrame([(p, t, None if c is None else bytearray(c.encode())) for p, t, c in made], FILES).select(
        "path", F.timestamp_seconds("t").alias("modificationTime"), F.octet_length("content").cast("bigint").alias("length"), "content")


def records(spark, *made):
    return spark.createDataFrame(list(made), "path string, `RUN del postulante` string")


def test_equal_contents_are_kept_once(spark):
    store = ContentStore(spark, "contents_a", buckets=4).create()
    made = files(spark, ("p1", 1, "same"), ("p2", 1, "same"), ("p3", 1, "other"), ("p4", 2, "late"), ("p5", 1, None), ("p6", 1, "same"))
    keys = records(spark, ("p1", "1-1"), ("p2", "2-2"), ("p3", "3-3"), ("p4", "3.3"), ("p5", "5-5"), ("p6", None), ("p1", "7-7"), ("p9", "9-9"))
    left = store.put(made, keys)
    held = [("11", "p1", bytearray(b"same")), ("22", "p2", bytearray(b"same")), ("33", "p4", bytearray(b"late")), ("77", "p1", bytearray(b"same"))]
    assert rows(store.read(), "run_norm", "path", "content") == held
    assert rows(left, "run_norm", "path") == [("55", "p5")]
    assert store.contents.read().count() == 2
    # again: nothing new moves, nothing changes
    store.put(made, keys)
    assert rows(store.read(), "run_norm", "path", "content") == held and store.contents.read().count() == 2


def test_fetch_replace_and_remove(spark):
    store = ContentStore(spark, "contents_b", buckets=2).create()
    store.put(files(spark, ("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y")), records(spark, ("a", "1"), ("b", "2"), ("c", "3")))
    assert store.unreferenced().count() == 0
    store.put(files(spark, ("c", 2, "x"), ("a", 3, "z")), records(spark, ("c", "3"), ("a", "1")))
    wanted = spark.createDataFrame([("1",), ("3",), ("8",), (None,)], "`RUN del postulante` string")
    found = {r[0]: r.content and bytes(r.content) for r in fetch_documents(wanted, store.read()).select("RUN del postulante", "content").collect()}
    assert found == {"1": b"z", "3": b"x", "8": None, None: None}
    assert store.remove_unreferenced() == 1
    store.delete(spark.createDataFrame([("1",), ("unknown",)], "run_norm string"))
    assert store.remove_unreferenced() == 1 and store.remove_unreferenced() == 0
    assert rows(store.read(), "run_norm", "content") == [("2", bytearray(b"x")), ("3", bytearray(b"x"))]
    assert rows(store.contents.read(), "content") == [(bytearray(b"x"),)]


def test_nothing_is_put(spark):
    store = ContentStore(spark, "contents_c", buckets=2).create()
    assert store.put(files(spark), records(spark)).collect() == [] and store.read().collect() == []
