"""Document files listed and read by tasks, for inboxes that one machine cannot list.

``FolderFiles`` is a data source of names: every folder is a partition, listed by the task that has
it. ``with_contents`` then deals the names out by path, so that a folder that holds most files is
still read by many tasks. Files are reached through pyarrow: local and mounted folders, ``s3a``,
``gs`` and ``hdfs`` addresses, with the credentials that the executors' environment has.

Defined cases: hidden names (``_`` or ``.`` in front), unfinished copies and empty files are left out,
as Spark's own sources do. A folder that is not there is an error; one that goes while it is listed is
empty. A file that goes before it is read has a null content. A file that is overwritten meanwhile
is read as it is then, under the time and length that the listing saw.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vitaeflow.session import cut_lineage
from vitaeflow.sources.files import named

# tasks get this module's code by value, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GLOB, _FORMAT = "*.[pP][dD][fF]", "vitaeflow_folders"
#: Bytes that one task reads, and that one batch of contents holds (a larger file is a batch by itself).
TASK_BYTES, _BATCH_BYTES, _BATCH_ROWS = 128 * 1024 * 1024, 16 * 1024 * 1024, 10_000
#: Files that a task opens at a time where one takes longer than so many seconds.
_AT_ONCE, _LATE = 16, 0.002


def _opened(folder: str):
    """The file system of an address, the path there, and what stands before paths in Spark's addresses."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if "/" in scheme or not rest or scheme == "file":
        path = "/" + (rest if scheme == "file" else folder).strip("/")
        return fs.LocalFileSystem(), path, "file:"
    system, path = fs.FileSystem.from_uri(quote(folder.rstrip("/"), safe=":/@").replace("s3a:", "s3:", 1))
    return system, path, folder.rstrip("/").removesuffix(path)


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(system, folder: str, must_be: bool = False) -> list:
    from pyarrow import fs

    return [e for e in system.get_file_info(fs.FileSelector(folder, allow_not_found=not must_be)) if not _hidden(e.base_name)]


def _shares(folders: list[str], levels: int) -> list[tuple[str, bool]]:
    """Folders for the tasks, and whether all below belongs to one; only ``levels`` levels of folders are looked at here."""
    found, todo = [], list(folders)
    for _ in range(levels):
        below = []
        for folder in todo:
            system, path, front = _opened(folder)
            below += [front + e.path for e in _entries(system, path, folder in folders) if e.type.name == "Directory"]
            found.append((folder, False))
        todo = below
    return found + [(folder, True) for folder in todo]


def _listed(folder: str, deep: bool, glob: str, must_be: bool) -> Iterator[tuple[str, int, int]]:
    from fnmatch import fnmatchcase

    system, path, front = _opened(folder)
    todo = [path]
    while todo:
        at = todo.pop()
        for entry in _entries(system, at, must_be and at == path):
            if entry.type.name == "Directory":
                if deep:
                    todo.append(entry.path)
            elif entry.size and fnmatchcase(entry.base_name, glob):
                yield front + entry.path, entry.mtime_ns // 1_000_000 * 1000, entry.size


class _Folders:
    """What the two readers have in common."""

    def __init__(self, options: dict[str, str]):
        self.folders, self.levels = json.loads(options["folders"]), int(options.get("levels", "0"))
        self.glob = options.get("glob", _GLOB)

    def shares(self) -> list[InputPartition]:
        return [InputPartition(share) for share in _shares(self.folders, self.levels)]

    def read(self, partition: InputPartition) -> Iterator:
        from itertools import batched

        import pyarrow as pa

        folder, deep = partition.value
        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64())
        for rows in batched(_listed(folder, deep, self.glob, folder in self.folders), _BATCH_ROWS):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "modificationTime", "length"])


class _Reader(_Folders, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.shares()


class _StreamReader(_Folders, DataSourceStreamReader):
    """Every batch is the listing of its time; ``Seen`` tells what is new in it."""

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        import time

        return {"listed": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.shares()


class FolderFiles(DataSource):
    """``(path, modificationTime, length)`` of the files in ``folders``, a JSON list, by one task a folder.

    With ``levels``, so many levels of folders below are tasks of their own; only those levels are
    listed where the query is planned. By default nothing is.
    """

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def _prepared(reader, folders: str | list[str], glob: str, levels: int):
    folders = [folders] if isinstance(folders, str) else list(folders)
    return reader.format(_FORMAT).options(folders=json.dumps(folders), glob=glob, levels=str(levels)).load()


def list_files(spark: SparkSession, folders: str | list[str], glob: str = _GLOB, levels: int = 0) -> DataFrame:
    """Names, times and sizes of all files below ``folders``, which must not lie in each other."""
    spark.dataSource.register(FolderFiles)
    return named(_prepared(spark.read, folders, glob, levels))


def listing_stream(spark: SparkSession, folders: str | list[str], glob: str = _GLOB, levels: int = 0) -> DataFrame:
    """``list_files`` again and again: each batch is the whole listing. Folders may come and go."""
    spark.dataSource.register(FolderFiles)
    return named(_prepared(spark.readStream, folders, glob, levels))


def _system_of(known: dict, path: str):
    """The file system and path of a file; systems are opened once for each address front."""
    folder = path.rpartition("/")[0]
    front = path[: path.find("/", path.find("://") + 3)] if "://" in path else "file:"
    if front not in known:
        known[front] = _opened(folder)[::2]
    system, before = known[front]
    return system, path.removeprefix(before)


def _in_turn(pool, function):
    """Results of calls in their order: one after another while storage answers at once, as threads then cost more
    than they bring, and side by side from where it does not."""
    late = False

    def run(items: list) -> Iterator:
        import time

        nonlocal late
        for start in range(0, len(items), _AT_ONCE):
            part = items[start : start + _AT_ONCE]
            if late:
                yield from pool.map(function, part)
            else:
                began = time.monotonic()
                done = [function(item) for item in part]
                late = time.monotonic() - began > _LATE * len(part)
                yield from done

    return run


def _windows(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours that have ``_BATCH_BYTES`` at most together (a larger one is alone), as places from and to."""
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + (size or 0) > _BATCH_BYTES:
            yield start, at
            start, held = at, 0
        held += size or 0
    if sizes:
        yield start, len(sizes)


def _read_contents(place: int, length: int):
    def read(where: tuple):
        system, inside = where
        try:
            with system.open_input_stream(inside) as stream:
                return stream.read()
        except FileNotFoundError:
            return None

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        known: dict = {}
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            read_all = _in_turn(pool, read)
            for batch in batches:
                for start, end in _windows(batch.column(length).to_pylist()):
                    rows = batch.slice(start, end - start)
                    places = [_system_of(known, path) for path in rows.column(place).to_pylist()]
                    contents = pa.array(list(read_all(places)), pa.binary())
                    yield pa.record_batch([*rows.columns, contents], [*rows.schema.names, "content"])

    return run


def with_contents(listed: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``listed`` with the bytes of each file, read by as many tasks as their sizes ask for.

    The names are written down once, so that folders are not listed again.
    """
    held = cut_lineage(listed)
    size, n = held.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    # a file takes a request too, whatever its size
    tasks = max(1, -(-size // task_bytes), -(-n // 1000))
    schema = T.StructType([*held.schema.fields, T.StructField("content", T.BinaryType())])
    return held.repartition(tasks, "path").mapInArrow(_read_contents(held.columns.index("path"), held.columns.index("length")), schema)


def _write_contents(path: int, content: int):
    def write(file: tuple) -> None:
        import uuid

        (system, inside), data = file
        # readers never see half a file: its name is hidden until it is whole
        hidden = f"{inside.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as stream:
            stream.write(data or b"")
        system.move(hidden, inside)

    def run(batches: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        known: dict = {}
        made: set = set()
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            write_all = _in_turn(pool, write)
            for batch in batches:
                # of rows that share a name in spite of all, the last one counts
                last = dict(zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()))
                files = [(_system_of(known, name), data) for name, data in last.items()]
                for system, inside in (where for where, _ in files):
                    folder = inside.rpartition("/")[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                for _ in write_all(files):
                    pass
                yield pa.record_batch([batch.column(path)], ["path"])

    return run


def put_files(documents: DataFrame, folder: str) -> int:
    """Write each row's ``content`` to the file ``name`` under ``folder``, replacing what is there; how many there were.

    A task that runs again writes the same files. Names must differ from each other.
    """
    rows = documents.select(F.concat(F.lit(_address(folder) + "/"), F.col("name")).alias("path"), "content")
    return rows.mapInArrow(_write_contents(0, 1), "path string").count()


def _address(folder: str) -> str:
    _, path, front = _opened(folder)
    return (front + path).rstrip("/")
