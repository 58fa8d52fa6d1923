"""Listing by tasks, contents, and an intake that notices replaced files."""

import os
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_jobs import extract_pages, letters, reader_model, rows, stores
from vitaeflow.schema import SEEN_FILES
from vitaeflow.sources import files, folders
from vitaeflow.sources.tables import KeyedTable
from vitaeflow.streaming.intake import start_folder_intake, unseen_files

COLUMNS = ["path", "modificationTime", "length", "content", "pdf_name"]


@pytest.fixture
def inbox(tmp_path):
    top = tmp_path / "in box"
    for name in ("a.pdf", "b/c.PDF", "b/d e+%20.pdf", "b/deep/ñ.pdf", "b/deep/er/f.pdf", "x=1/g.pdf", "_tmp/h.pdf", ".cache/i.pdf",
                 "b/_j.pdf", "b/.k.pdf", "l.txt", "m.pdf._COPYING_", "empty.pdf", "b/deep/empty.pdf"):
        file = top / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if "empty" in name else name.encode() * 3)
    (top / "none").mkdir()
    return top


@pytest.mark.parametrize("levels", [0, 1, 2, 5])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_rows_are_those_of_document_files(spark, inbox, levels, scheme):
    listed = folders.list_files(spark, f"{scheme}{inbox}", levels=levels)
    found = rows(folders.with_contents(listed), *COLUMNS)
    assert len(found) == 6
    assert found == rows(files.document_files(spark, str(inbox)), *COLUMNS)


def test_each_folder_is_a_task(spark, inbox):
    def n(*folders_, **options):
        return folders.list_files(spark, list(folders_), **options).rdd.getNumPartitions()

    assert n(str(inbox)) == 1 and n(f"{inbox}/b", f"{inbox}/x=1") == 2
    # the folder itself, and b, x=1, none
    assert n(str(inbox), levels=1) == 4


def test_contents_are_read_by_many_tasks(spark, inbox):
    listed = folders.list_files(spark, str(inbox))
    read = folders.with_contents(listed, task_bytes=20)
    assert read.rdd.getNumPartitions() == -(-listed.agg(F.sum("length")).first()[0] // 20) > 3
    assert rows(read, *COLUMNS) == rows(files.document_files(spark, str(inbox)), *COLUMNS)


def test_small_batches(spark, inbox, monkeypatch):
    monkeypatch.setattr(folders, "_BATCH_BYTES", 1)
    monkeypatch.setattr(folders, "_BATCH_ROWS", 2)
    read = folders.with_contents(folders.list_files(spark, str(inbox)))
    assert rows(read, *COLUMNS) == rows(files.document_files(spark, str(inbox)), *COLUMNS)


def test_missing_and_vanished(spark, inbox):
    with pytest.raises(Exception, match="FileNotFound|does not exist|not found|No such"):
        folders.list_files(spark, f"{inbox}/nowhere").collect()
    read = folders.with_contents(folders.list_files(spark, f"{inbox}/b"))
    os.remove(inbox / "b" / "c.PDF")
    assert sorted(r.content is None for r in read.collect()) == [False, False, False, True]
    empty = folders.list_files(spark, f"{inbox}/none")
    assert empty.collect() == [] and folders.with_contents(empty).collect() == []


def test_files_are_put(spark, tmp_path):
    made = spark.createDataFrame([("a/x.pdf", bytearray(b"1")), ("y.pdf", bytearray(b"2")), ("z.pdf", None)], "name string, content binary")
    for _ in range(2):
        assert folders.put_files(made, str(tmp_path / "out")) == 3
    read = folders.with_contents(folders.list_files(spark, str(tmp_path / "out")))
    assert rows(read, "pdf_name", "content") == [("x.pdf", bytearray(b"1")), ("y.pdf", bytearray(b"2"))]
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".")]


class Storage:
    """Local storage that answers after a time; it notes the folders that are made and how many files are asked for at a time."""

    def __init__(self, seconds):
        from pyarrow import fs

        self.local, self.seconds, self.made, self.asked, self.most, self.lock = fs.LocalFileSystem(), seconds, [], 0, 0, threading.Lock()

    def create_dir(self, folder, recursive):
        self.made.append(folder)
        self.local.create_dir(folder, recursive=recursive)

    def answered(self, opening, path):
        with self.lock:
            self.asked += 1
            self.most = max(self.most, self.asked)
        time.sleep(self.seconds)
        with self.lock:
            self.asked -= 1
        return opening(path)

    def open_output_stream(self, path):
        return self.answered(self.local.open_output_stream, path)

    def open_input_stream(self, path):
        return self.answered(self.local.open_input_stream, path)

    def move(self, source, target):
        self.local.move(source, target)


@pytest.mark.parametrize("seconds", [0.0, 0.01])
def test_late_files_are_waited_for_together(tmp_path, monkeypatch, seconds):
    storage = Storage(seconds)
    monkeypatch.setattr(folders, "_opened", lambda folder: (storage, folder.removeprefix("file:"), "file:"))
    paths = [f"file:{tmp_path}/{i % 2}/{i}.pdf" for i in range(80)]
    put = pa.record_batch([pa.array(paths), pa.array([f"text {i:02}".encode() for i in range(80)])], ["path", "content"])
    assert sum(b.num_rows for b in folders._write_contents(0, 1)(iter([put]))) == 80
    # once a task, not once a file
    assert sorted(storage.made) == [f"{tmp_path}/0", f"{tmp_path}/1"]
    assert not seconds or storage.most > 4
    storage.most = 0
    listed = pa.record_batch([pa.array(paths), pa.array([7] * 80)], ["path", "length"])
    read = list(folders._read_contents(0, 1)(iter([listed])))
    assert [c for b in read for c in b.column(2).to_pylist()] == put.column(1).to_pylist()
    assert not seconds or storage.most > 4


def test_the_last_of_rows_with_one_name_is_put(tmp_path):
    path = f"file:{tmp_path}/a.pdf"
    put = pa.record_batch([pa.array([path] * 50), pa.array([str(i).encode() for i in range(50)])], ["path", "content"])
    assert sum(b.num_rows for b in folders._write_contents(0, 1)(iter([put]))) == 50
    assert (tmp_path / "a.pdf").read_bytes() == b"49"


def test_windows_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr(folders, "_BATCH_BYTES", 10)
    assert list(folders._windows([4, 6, 1, 30, 0, 10, 11, 3])) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7), (7, 8)]
    assert list(folders._windows([])) == [] and list(folders._windows([99])) == [(0, 1)]


def test_replaced_files_are_taken_in(spark, tmp_path):
    inbox, checkpoint = tmp_path / "inbox", str(tmp_path / "checkpoint")
    held, indexed, staging = stores(spark, "replaced")
    seen = KeyedTable(spark, "replaced_seen", SEEN_FILES, "path", 4).create()
    kept, asked, model = [], spark.sparkContext.accumulator(0), reader_model()

    def counting(payloads):
        asked.add(len(payloads))
        return model(payloads)

    def write(**texts):
        made = [(f"d{len(name)}/{name}.pdf", bytearray(text.encode())) for name, text in texts.items()]
        folders.put_files(spark.createDataFrame(made, "name string, content binary"), str(inbox))

    def run():
        before = asked.value
        stream = folders.listing_stream(spark, str(inbox), levels=1)
        start_folder_intake(stream, seen, extract_pages, checkpoint, counting, letters, held, indexed, staging,
                            lambda batch, _: kept.extend(rows(batch, "pdf_name", "error"))).awaitTermination()
        return rows(held.read(), "`RUN del postulante`", "Nombre"), rows(indexed.read(), "RUN", "text"), asked.value - before

    write(one="ada/1-9", two="bea/2-7", three="plain")
    assert run() == ([("1-9", "ada"), ("2-7", "bea")], [("1-9", "ada/1-9\n"), ("2-7", "bea/2-7\n")], 3)
    assert run()[2] == 0
    write(one="ada maria/1-9", three="eva/3-5")
    after = ([("1-9", "ada maria"), ("2-7", "bea"), ("3-5", "eva")], [("1-9", "ada maria/1-9\n"), ("2-7", "bea/2-7\n"), ("3-5", "eva/3-5\n")])
    assert run() == (*after, 2)
    assert run() == (*after, 0)
    # moved here with a time from long ago, into a folder that is new
    write(fourth="leo/5-1")
    os.utime(inbox / "d6" / "fourth.pdf", (1, 1))
    assert run()[2] == 1 and run()[2] == 0
    assert [reason for _, reason in kept] == ["no JSON object in reply"]
    assert seen.read().count() == 4


def test_unseen_by_version(spark, tmp_path):
    seen = KeyedTable(spark, "unseen_files", SEEN_FILES, "path", 2).create()
    first = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "path string, t int, length bigint").select(
        "path", F.timestamp_seconds("t").alias("modificationTime"), "length")
    seen.refresh(first, first.select("path"))
    again = first.union(first.where("path = 'a'").withColumn("length", F.lit(6).cast("bigint"))).union(
        first.where("path = 'b'").withColumn("modificationTime", F.timestamp_seconds(F.lit(2))))
    assert rows(unseen_files(again, seen), "path", "length") == [("a", 6), ("b", 5)]
