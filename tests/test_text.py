import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaeflow.fixed_values import WHITESPACE
from vitaeflow.functions import text as X
from vitaeflow.operators import documents as D

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TEXTS = st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=40)


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_whitespace_is_what_python_strips():
    assert sorted(WHITESPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


@SLOW
@given(texts=st.lists(st.text(alphabet=WHITESPACE + "ab", max_size=20), min_size=1, max_size=40))
def test_strip_and_blank(spark, texts):
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]
    assert column(spark, texts, X.has_text) == [bool(t.strip()) for t in texts]


def test_null_has_no_text(spark):
    assert column(spark, [None], X.has_text) == [False]


def test_valid_key(spark):
    keys = ["", "  ", " No Especificado ", None, "12.345.678-9", "\tNO ESPECIFICADO\n", "none"]
    assert column(spark, keys, X.valid_key) == [False, False, False, False, True, False, True]


def test_normal_key(spark):
    assert column(spark, ["12.345.678-9 K", "123456789K", None], X.normal_key) == ["123456789K", "123456789K", None]


def test_chunk_edges(spark):
    assert column(spark, [""], lambda c: X.fixed_chunks(c, 5)) == [[]]
    assert column(spark, ["", "abc"], lambda c: X.fixed_chunks(c, None)) == [[], ["abc"]]
    assert column(spark, ["áéíóúñü😀xyz"], lambda c: X.fixed_chunks(c, 4)) == [["áéíó", "úñü😀", "xyz"]]
    for size in (0, -1):
        with pytest.raises(ValueError):
            X.fixed_chunks(F.lit("a"), size)


@SLOW
@given(texts=TEXTS, size=st.integers(1, 9))
def test_chunks_are_slices(spark, texts, size):
    cut = column(spark, texts, lambda c: X.fixed_chunks(c, size))
    assert cut == [[t[i : i + size] for i in range(0, len(t), size)] for t in texts]
    assert ["".join(pieces) for pieces in cut] == texts


def test_long_text_chunks(spark):
    """A long text with a long blank run inside: linear steps only."""
    text = ("x" + " " * 300_000 + "y\n") * 4
    assert column(spark, [text], X.has_text) == [True]
    assert column(spark, [text], X.strip) == [text.strip()]
    pieces = column(spark, [text], lambda c: X.fixed_chunks(c, 1000))[0]
    assert len(pieces) == -(-len(text) // 1000) and "".join(pieces) == text


def test_assemble_orders_pages_and_keeps_empty_ones(spark):
    pages = spark.createDataFrame(
        [("a", 2, "two"), ("a", 0, "zero"), ("a", 1, None), ("b", 0, None)], "doc_key STRING, page_no INT, text STRING"
    )
    made = {r["doc_key"]: (r["text"], r["n_pages"]) for r in D.assemble(pages).collect()}
    assert made == {"a": ("zero\n\ntwo\n", 3), "b": ("\n", 1)}


def test_pages_text_matches_assemble(spark):
    rows = spark.createDataFrame([(["a", None, "c"],), ([],), (None,)], "pages ARRAY<STRING>")
    assert [r[0] for r in rows.select(D.pages_text(F.col("pages"))).collect()] == ["a\n\nc\n", "", None]


def test_split_pages(spark):
    rows = spark.createDataFrame([("d", "a\fb\f")], "doc_key STRING, text STRING")
    assert [tuple(r) for r in D.split_pages(rows, "doc_key").collect()] == [("d", 0, "a"), ("d", 1, "b"), ("d", 2, "")]


def test_read_pages_keeps_unreadable_files(spark):
    def extract(data):
        if data.startswith(b"bad"):
            raise ValueError("broken")
        return data.decode().split("|")

    files = spark.createDataFrame([("a", b"x|y"), ("b", b"bad"), ("c", None)], "name STRING, content BINARY")
    rows = {r["name"]: (r["pages"], r["error"]) for r in D.read_pages(files, extract).collect()}
    assert rows["a"] == (["x", "y"], None)
    assert rows["b"] == (None, "unreadable document: broken")
    assert rows["c"] == (None, "unreadable document: no content")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40), st.text("xy\nñ😀", max_size=12) | st.none()),
             unique_by=lambda row: row[:2], max_size=30),
    st.integers(1, 9), st.integers(0, 4))
def test_chunks_of_pages_are_those_of_documents(spark, pages, size, bits):
    held = spark.createDataFrame(pages, "k string, no int, text string")
    whole = D.chunk(D.assemble(held, "k", "no"), "k", size)
    found = D.chunk_pages(held, "k", size, "no", block_bits=bits)
    assert found.columns == whole.columns and found.dtypes == whole.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_chunks_of_a_hot_document(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("doc_key"), F.col("id").alias("page_no"), F.col("id").cast("string").alias("text"))
    found = D.chunk_pages(rows, size=100)
    hot = sorted((r.chunk_no, r.text) for r in found.where("doc_key = 0").collect())
    text = "".join(f"{i}\n" for i in range(60_000) if i % 3 > 0 or i == 0)
    assert [t for _, t in hot] == [text[i : i + 100] for i in range(0, len(text), 100)]
    assert [n for n, _ in hot] == list(range(len(hot)))
    assert found.where("doc_key > 0").count() == 19_999


def test_chunks_of_pages_refuse_what_has_no_answer(spark):
    pages = spark.createDataFrame([("a", "1", "x")], "doc_key string, page_no string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        D.chunk_pages(pages, size=5)
    for size in (None, 0, -1):
        with pytest.raises(ValueError, match="positive"):
            D.chunk_pages(pages.withColumn("page_no", F.lit(1)), size=size)


def test_a_page_of_many_chunks_and_a_null_number(spark):
    pages = spark.createDataFrame([("a", 5, "b" * 2500), ("a", None, "a" * 7), ("a", 2000, "c"), (None, None, None)],
                                  "doc_key string, page_no int, text string")
    found = sorted((str(r.doc_key), r.chunk_no, r.text) for r in D.chunk_pages(pages, size=1000).collect())
    text = "a" * 7 + "\n" + "b" * 2500 + "\nc\n"
    assert found == [("None", 0, "\n"), *(("a", i // 1000, text[i : i + 1000]) for i in range(0, len(text), 1000))]
