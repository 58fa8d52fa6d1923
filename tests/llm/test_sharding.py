import zlib

import odd_rows
from pyspark.sql import functions as F
from vitaeflow.llm import sharding as S


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for got in by.values():
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    return {s: sum(r["size"] for r in got) for s, got in by.items()}


def test_sizes_are_near_equal_with_a_hot_text(spark):
    texts = [(i, "hot copy of a text " * 3 if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    sizes = check(S.assign(docs, 24).collect(), texts, 24)
    share = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(v - share) <= 600 for v in sizes.values())
    again = S.assign(docs.repartition(3), 24)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, S.assign(docs, 24).collect()))


def test_copies_of_one_row_are_cut(spark, monkeypatch):
    """A third of all rows are one row, another the same without an id: no piece holds more than its share of them."""
    seen = []
    real = S._cut_copies

    def spied(placed, most_bytes, most_rows):
        made = real(placed, most_bytes, most_rows)
        seen.append((max(r["count"] for r in made.groupBy("range", "part", "cut").count().collect()), most_rows))
        return made

    monkeypatch.setattr(S, "_cut_copies", spied)
    texts = [(7, "one row again and again")] * 3000 + [(None, "one row again and again")] * 2000 + [(i, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    sizes = check(S.assign(docs, 4).collect(), texts, 4)
    assert max(sizes.values()) - min(sizes.values()) <= 100
    assert all(largest <= 2 * most for largest, most in seen) and seen
    again = S.assign(docs.repartition(2), 4)
    assert sorted(map(str, again.collect())) == sorted(map(str, S.assign(docs, 4).collect()))


def test_shards_are_equal_cuts_of_the_whole_order(spark, monkeypatch):
    """Against the whole table sorted and cut in one place, where no range is overfull."""
    monkeypatch.setattr(S, "PIECES_PER_SHARD", 2)
    texts = [(i, "é" * (i * 7919 % 211) + "x") for i in range(3000)] + [(i, None) for i in range(3000, 3050)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    for shards in (1, 5, 24):
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.assign(docs, shards, key=(F.col("doc_id") * 7907) % 3001).collect()}
        total, before, expected, slots = sum(len((t or "").encode()) + 8 for _, t in texts), 0, {}, {}
        for i, t in sorted(texts, key=lambda row: (row[0] * 7907 % 3001, row[0])):
            size = len((t or "").encode()) + 8
            shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
            expected[i] = (shard, slots.setdefault(shard, 0))
            slots[shard] += 1
            before += size
        assert got == expected


def test_odd_rows(spark):
    check(S.assign(odd_rows.documents(spark), 3).collect(), odd_rows.TEXTS, 3)
    empty = S.assign(odd_rows.no_documents(spark), 3)
    assert empty.count() == 0 and empty.columns == S.assign(odd_rows.documents(spark), 3).columns


def test_written_shards_hold_every_record(spark, tmp_path):
    docs = odd_rows.documents(spark)
    S.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert key(back.select("record.*")) == key(docs)
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("ok").count() == back.select("shard").distinct().count()
