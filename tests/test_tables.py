import base64

import pytest
from pyspark.sql import functions as F

from vitaeflow.operators import conversation, listing
from vitaeflow.schema import CANDIDATES, CHUNKS
from vitaeflow.sources import files, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def keyed(spark, name, buckets=4):
    return tables.KeyedTable(spark, name, spark.createDataFrame([], "RUN STRING, n INT").schema, "RUN", buckets)


def test_table_life(spark):
    table = keyed(spark, "life").create()
    table.create()
    assert [(r["col_name"], r["data_type"]) for r in table.describe().limit(2).collect()] == [("RUN", "string"), ("n", "int")]
    table.insert(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "RUN STRING, n INT"))
    table.insert(spark.createDataFrame([("a", 4), (None, 5)], "RUN STRING, n INT"))
    assert rows(table.read(), "n", "RUN") == [(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, None)]
    table.delete(spark.createDataFrame([("a",), ("nobody",), (None,)], "RUN STRING"))
    assert rows(table.read(), "n") == [(2,), (3,), (5,)]
    table.refresh(spark.createDataFrame([(None, 7)], "RUN STRING, n INT"), spark.createDataFrame([(None,)], "RUN STRING"))
    assert rows(table.read(), "n") == [(2,), (3,), (5,)]
    kept = table.read().where("RUN IS NOT NULL")
    table.empty()
    table.insert(spark.createDataFrame([("b", 2), ("c", 3)], "RUN STRING, n INT"))
    assert kept.columns == ["RUN", "n"]
    assert rows(table.read(), "RUN", "n") == [("b", 2), ("c", 3)]
    table.refresh(spark.createDataFrame([(9, "b"), (8, "c")], "n INT, RUN STRING"), spark.createDataFrame([("b",)], "RUN STRING"))
    assert rows(table.read(), "RUN", "n") == [("b", 9), ("c", 3)]
    table.delete(table.read())
    assert table.read().count() == 0
    table.insert(spark.createDataFrame([("z", 1)], "RUN STRING, n INT"))
    table.empty()
    assert table.read().count() == 0
    table.insert(spark.createDataFrame([("y", 1)], "RUN STRING, n INT"))
    assert rows(table.read(), "RUN") == [("y",)]
    table.drop()
    table.drop()
    assert not spark.catalog.tableExists("life")
    table.empty()


def test_rewrite_touches_only_its_buckets(spark):
    table = keyed(spark, "touched", 16).create()
    table.insert(spark.range(200).select(F.col("id").cast("string").alias("RUN"), F.col("id").cast("int").alias("n")))
    before = {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}
    table.delete(spark.createDataFrame([("7",)], "RUN STRING"))
    after = {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}
    assert len(after - before) == 1 and table.read().count() == 199


def numbers(spark, low, high):
    return spark.range(low, high).select(F.col("id").cast("string").alias("RUN"), F.col("id").cast("int").alias("n"))


def files_of(table):
    return {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}


def test_new_keys_are_appended(spark):
    schema = spark.createDataFrame([], "RUN STRING, n INT, pdf_name STRING").schema
    table = tables.KeyedTable(spark, "appended", schema, "RUN", 8).create()
    table.insert(numbers(spark, 0, 200).withColumn("pdf_name", F.lit("f")))
    before = files_of(table)
    table.insert(numbers(spark, 200, 240).withColumn("pdf_name", F.lit("f")))
    assert before < files_of(table) and table.read().count() == 240
    before = files_of(table)
    changed = table.merge(numbers(spark, 300, 310).withColumns({"pdf_name": F.lit("g"), "ingest_ts": F.current_timestamp()}))
    assert changed.where("action = 'NEW'").count() == 10
    assert before < files_of(table) and table.read().count() == 250
    table.refresh(numbers(spark, 5, 6).withColumn("pdf_name", F.lit("h")), numbers(spark, 5, 6))
    assert rows(table.read().where("RUN = '5'"), "n", "pdf_name") == [(5, "h")] and table.read().count() == 250
    folder = table._location()
    old = len(list_files(spark, folder))
    table.remove_old()
    assert len(list_files(spark, folder)) < old and table.read().count() == 250
    table.drop()
    assert list_files(spark, folder) == []


def test_merge_keeps_the_files_of_unchanged_buckets(spark):
    schema = spark.createDataFrame([], "RUN STRING, n INT, pdf_name STRING").schema
    table = tables.KeyedTable(spark, "kept_files", schema, "RUN", 16).create()
    table.insert(numbers(spark, 0, 200).withColumn("pdf_name", F.lit("f")))
    before = files_of(table)
    staged = numbers(spark, 7, 8).withColumns({"pdf_name": F.lit("g"), "ingest_ts": F.current_timestamp()})
    assert rows(table.merge(staged), "RUN", "action") == [("7", "UPDATED")]
    after = files_of(table)
    assert len(before) >= 16 and len(before - after) == len(after - before) == 1
    assert rows(table.read().where("RUN = '7'"), "pdf_name") == [("g",)] and table.read().count() == 200
    table.drop()


def list_files(spark, folder):
    import glob

    return glob.glob(folder.removeprefix("file:") + "/**/*.parquet", recursive=True)


def test_buckets_that_hold_all_keys_take_no_insert(spark, monkeypatch):
    table = keyed(spark, "all_held", 2).create()
    added, insert = [], table.insert
    monkeypatch.setattr(table, "insert", lambda rows_: (added.append(1), insert(rows_)))
    table.refresh(numbers(spark, 0, 40), numbers(spark, 0, 40))
    assert len(added) == 1
    twice = numbers(spark, 0, 20).withColumn("n", F.col("n") * 2)
    table.refresh(twice, twice)
    changed = table.merge(spark.createDataFrame([("30", -1), ("31", -1), ("new", -2), ("other", -2), (None, 0)], "RUN string, n int").where("RUN <> 'x'"))
    assert len(added) == 1
    assert rows(changed, "RUN", "action") == [("30", "UPDATED"), ("31", "UPDATED"), ("new", "NEW"), ("other", "NEW")]
    expected = {str(i): i * 2 if i < 20 else i for i in range(40)} | {"30": -1, "31": -1, "new": -2, "other": -2}
    assert {r["RUN"]: r["n"] for r in table.read().collect()} == expected and table.read().count() == 42
    # no keys at all change nothing
    assert table.merge(numbers(spark, 0, 0)).count() == 0
    table.refresh(numbers(spark, 0, 0), numbers(spark, 0, 0))
    assert table.read().count() == 42


def test_another_bucket_count_is_refused(spark):
    table = keyed(spark, "counted", 4).create()
    table.insert(numbers(spark, 0, 9))
    with pytest.raises(ValueError):
        keyed(spark, "counted", 64)
    with pytest.raises(ValueError):
        tables.KeyedTable(spark, "counted", table.schema, "n")
    again = tables.KeyedTable(spark, "counted", table.schema, "RUN")
    again.delete(numbers(spark, 3, 5))
    assert again.buckets == 4 and again.rows_of_key("7").count() == 1 and again.read().count() == 7


def test_scratch_files_are_not_the_tables(spark):
    import shutil

    table = keyed(spark, "own_files").create()
    table.insert(numbers(spark, 0, 9))
    table.delete(numbers(spark, 3, 5))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(not f.removeprefix("file:").startswith(shared) for f in files_of(table))


def test_lookups_read_only_their_buckets(spark):
    table = keyed(spark, "looked_up", 16).create()
    table.insert(spark.range(200).select(F.col("id").cast("string").alias("RUN"), F.col("id").cast("int").alias("n")))
    one = table.rows_of_key("7")
    assert rows(one, "RUN", "n") == [("7", 7)]
    near = table.near(spark.createDataFrame([("7",), ("nobody",)], "RUN STRING"))
    assert near.where("RUN = '7'").count() == 1 and near.count() < 60
    for found, most in ((one, 1), (near, 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert found.select(F.input_file_name()).distinct().count() <= most


def test_same_refresh_twice(spark):
    table = keyed(spark, "twice").create()
    table.insert(spark.createDataFrame([("a", 1), ("b", 2)], "RUN STRING, n INT"))
    fresh = spark.createDataFrame([("a", 5), ("a", 6)], "RUN STRING, n INT")
    for _ in range(2):
        table.refresh(fresh, fresh)
        assert rows(table.read(), "RUN", "n") == [("a", 5), ("a", 6), ("b", 2)]


def test_merge_into_table(spark):
    table = tables.KeyedTable(spark, "merged", spark.createDataFrame([], "RUN STRING, v STRING, pdf_name STRING").schema, "RUN", 4).create()
    staged = "RUN STRING, v STRING, pdf_name STRING, ingest_ts TIMESTAMP"
    first = table.merge(spark.createDataFrame([("a", "1", "f", None), ("b", "1", "f", None)], staged))
    assert rows(first, "RUN", "action") == [("a", "NEW"), ("b", "NEW")]
    second = table.merge(spark.createDataFrame([("a", "2", "g", None), ("c", "1", "f", None)], staged))
    assert rows(second, "RUN", "action") == [("a", "UPDATED"), ("c", "NEW")]
    assert rows(table.read(), "RUN", "v") == [("a", "2"), ("b", "1"), ("c", "1")]
    assert rows(first, "RUN", "action") == [("a", "NEW"), ("b", "NEW")]


def test_staging(spark):
    made = spark.createDataFrame([("a", 1)], "RUN STRING, n INT")
    tables.clear_table(spark, "staged_rows")
    first = tables.stage_rows(made, "staged_rows")
    tables.stage_rows(made, "staged_rows")
    assert spark.table("staged_rows").count() == 2
    tables.drop_load(spark, "staged_rows", first)
    assert spark.table("staged_rows").count() == 1
    tables.clear_table(spark, "staged_rows")
    assert spark.table("staged_rows").count() == 0 and spark.table("staged_rows").columns == ["RUN", "n", "load_id"]


def test_files_are_packed_by_folder(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "cv.pdf").write_bytes(folder.encode())
    for _ in range(2):
        packed = files.pack_documents(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "packed"))
        assert sorted(bytes(r["content"]) for r in packed.collect()) == [b"a", b"b"]
    assert packed.columns == files.document_files(spark, str(tmp_path / "a")).columns


def test_domain_schemas_make_tables(spark):
    for name, schema, key in [("t_candidates", CANDIDATES, "RUN del postulante"), ("t_chunks", CHUNKS, "RUN")]:
        table = tables.KeyedTable(spark, name, schema, key).create()
        assert table.read().columns == schema.names


def test_read_candidates(spark, tmp_path):
    made = spark.createDataFrame([("a", 1)], "RUN STRING, n INT")
    made.write.parquet(str(tmp_path / "p"))
    made.write.saveAsTable("held_rows")
    assert files.read_candidates(spark, "held_rows").count() == 1
    assert files.read_candidates(spark, str(tmp_path / "p"), "parquet").count() == 1


def test_document_files(spark, tmp_path):
    folder = tmp_path / "curriculums"
    folder.mkdir()
    (folder / "123456789K.pdf").write_bytes(b"one")
    (folder / "2.pdf").write_bytes(b"")
    (folder / "4.PDF").write_bytes(b"four")
    (folder / "note.txt").write_bytes(b"no")
    stored = listing.stored_under_key(files.document_files(spark, str(tmp_path)))
    # Spark lists no empty files: like missing ones they have no link
    assert rows(stored, "run_norm", "length") == [("123456789K", 3), ("4", 4)]
    held = spark.createDataFrame([("12.345.678-9 K",), ("2",), ("3",), (None,), ("No especificado",)], "run STRING")
    got = dict(rows(listing.candidate_listing(held.na.drop(), stored, "run", mode="data_uri", link_column="link"), "run", "link"))
    assert got["12.345.678-9 K"] == '<a href="data:application/pdf;base64,b25l" target="_blank">Ver PDF</a>'
    assert {got[k] for k in got if k != "12.345.678-9 K"} == {"No disponible"}
    path = listing.candidate_listing(held, stored, "run", mode="path", link_column="link")
    assert path.count() == 5 and path.where("link LIKE '%123456789K.pdf'").count() == 1
    assert "content" not in path._jdf.queryExecution().executedPlan().toString()
    fetched = {r["run"]: r["content"] for r in listing.fetch_documents(held, stored, "run").collect()}
    assert bytes(fetched["12.345.678-9 K"]) == b"one" and fetched["3"] is None and fetched[None] is None and len(fetched) == 5


def test_a_short_list_moves_few_contents(spark):
    stored = spark.createDataFrame([(str(i), "p", bytearray(b"x")) for i in range(50)], "run_norm STRING, path STRING, content BINARY")
    listed = spark.createDataFrame([("7",), ("8",)], "run STRING")
    for df in (listing.candidate_listing(listed, stored, "run", mode="data_uri"), listing.fetch_documents(listed, stored, "run")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the store meets the wanted keys by a broadcast before any exchange of contents
        assert "BroadcastHashJoin [run_norm" in plan and "LeftSemi" in plan


def test_link_has_no_line_breaks(spark):
    content = bytes(range(256)) + bytes(44)
    stored = spark.createDataFrame([("1", "p", bytearray(content))], "run_norm STRING, path STRING, content BINARY")
    link = listing.candidate_listing(spark.createDataFrame([("1",)], "run STRING"), stored, "run", mode="data_uri").first()["Ver PDF"]
    text = link.split("base64,")[1].split('"')[0]
    assert len(text) == 400 and base64.b64decode(text) == content


def test_put_keeps_the_last_document(spark):
    made = spark.createDataFrame(
        [("1-9", 1, b"a"), ("1.9", 3, b"c"), ("19", 2, b"b"), ("No especificado", 9, b"x"), (None, 9, b"y")],
        "run STRING, at INT, content BINARY")
    got = [(r["run_norm"], r["at"], bytes(r["content"])) for r in listing.put_documents(made, "run", ["at"]).collect()]
    assert got == [("19", 3, b"c")]


def test_conversation(spark):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    log = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")], schema)
    more = spark.createDataFrame([(1, 1, "assistant", "e"), (1, 0, "user", "d"), (3, 0, "user", "f")],
                                 "conv_id BIGINT, seq BIGINT, role STRING, text STRING")
    played = conversation.replay(conversation.append_turns(log, more)).collect()
    assert [(r["conv_id"], r["turn"], r["text"]) for r in played] == [
        (1, 0, "a"), (1, 1, "b"), (1, 2, "d"), (1, 3, "e"), (2, 0, "c"), (3, 0, "f")]
    assert conversation.clear(log).count() == 0
    assert rows(conversation.clear(log, F.col("conv_id") == 1), "text") == [("c",)]
