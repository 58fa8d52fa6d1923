"""Catalog tables that are refreshed by key.

A table is plain parquet, partitioned by a hash bucket of its key. New keys are
appended. Only buckets that hold a key which is replaced or removed are
rewritten: their new rows go to a new folder under the table first, then each
partition is pointed at it, so readers see a bucket's old files or its new
ones. Running the same refresh again gives the same table, so a job that dies
half-way is simply run again. Dropping a table drops all its folders;
``remove_old`` drops the ones that no partition shows any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.functions.text import key_bucket
from vitaeflow.operators import candidates as C
from vitaeflow.operators import chunks as K
from vitaeflow.session import cut_lineage, lookup_side

_BUCKET = "key_bucket"
#: Buckets of a new table, its properties, and the folder its files are in.
_BUCKETS, _PROPERTY, _FOLDERS = 64, "vitaeflow", "_files"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def append_rows(rows: DataFrame, table: str) -> None:
    """Add rows to a table, creating it from their schema if need be."""
    rows.write.mode("append").format("parquet").saveAsTable(table)


def stage_rows(rows: DataFrame, table: str, load_id: str | None = None) -> str:
    """Add the rows of one load to a staging table, under an id that is returned.

    Under an id that is given, what an earlier attempt of that load has left is replaced.
    """
    if load_id is None:
        load_id = uuid.uuid4().hex
    elif rows.sparkSession.catalog.tableExists(table):
        drop_load(rows.sparkSession, table, load_id)
    marked = rows.withColumn("load_id", F.lit(load_id))
    marked.write.mode("append").format("parquet").partitionBy("load_id").saveAsTable(table)
    return load_id


def drop_load(spark: SparkSession, table: str, load_id: str) -> None:
    """Remove the rows of one load from a staging table."""
    spark.sql(f"ALTER TABLE {_quoted(table)} DROP IF EXISTS PARTITION (load_id = '{load_id}')")


def clear_table(spark: SparkSession, table: str) -> None:
    """Empty a table and keep its definition; no error where there is none."""
    if spark.catalog.tableExists(table):
        spark.sql(f"TRUNCATE TABLE {_quoted(table)}")


class KeyedTable:
    """A table whose rows are replaced by key.

    Key and bucket count are kept with the table. Opening one that exists takes them from there; a
    count that is given and differs is an error, since rows would be looked for in the wrong buckets.
    """

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, key: str, buckets: int | None = None):
        self.spark, self.name, self.schema, self.key = spark, name, schema, key
        self.buckets = buckets or _BUCKETS
        if spark.catalog.tableExists(name):
            held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}
            found = held.get(f"{_PROPERTY}.key"), int(held.get(f"{_PROPERTY}.buckets", 0))
            if found != (key, buckets or found[1]):
                raise ValueError(f"table {name} has key and buckets {found}, not {(key, buckets)}")
            self.buckets = found[1]

    def create(self) -> KeyedTable:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_quoted(self.name)} ({columns}, {_BUCKET} INT) "
            f"USING parquet PARTITIONED BY ({_BUCKET}) "
            f"TBLPROPERTIES ('{_PROPERTY}.key' = '{self.key}', '{_PROPERTY}.buckets' = '{self.buckets}')"
        )
        return self

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_quoted(self.name)}")

    def describe(self) -> DataFrame:
        return self.spark.sql(f"DESCRIBE TABLE {_quoted(self.name)}")

    def empty(self) -> None:
        clear_table(self.spark, self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(_BUCKET)

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys`` fall in; other partitions are not read."""
        return self._rows_in(self._buckets_of(keys))

    def rows_of_key(self, value: object) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        bucket = key_bucket(F.lit(value).cast(self.schema[self.key].dataType), self.buckets)
        return K.rows_of_key(self.spark.table(self.name).where(F.col(_BUCKET) == bucket), value, self.key).drop(_BUCKET)

    def insert(self, rows: DataFrame) -> None:
        """Add rows without looking at the ones there are; old files stay as they are."""
        placed = self._placed(rows.select(*self.schema.names))
        known = self._partitions()
        fresh = placed.where(~F.col(_BUCKET).isin(known)) if known else placed
        folder = self._folder()
        fresh.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        if known:
            here = placed.where(F.col(_BUCKET).isin(known)).hint("rebalance", _BUCKET)
            here.write.mode("append").insertInto(_quoted(self.name))
        self._point([], folder, known)

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of ``keys``."""
        self._rewrite(self._holding(keys)[0], lambda old: K.without_keys(old, keys, self.key))

    def refresh(self, fresh: DataFrame, keys: DataFrame) -> None:
        """Replace the rows of ``keys`` by those in ``fresh``."""
        rows, (held, others) = fresh.select(*self.schema.names), self._holding(keys)
        bucket = self._bucket()
        self._rewrite(held, lambda old: K.refresh(old, rows.where(bucket.isin(held)), keys, self.key))
        # what is left falls in buckets without any of the keys
        if others:
            self.insert(K.refresh(rows.limit(0), rows.where(~bucket.isin(held)) if held else rows, keys, self.key))

    def merge(self, staging: DataFrame, only_changed: bool = False) -> DataFrame:
        """Merge staged rows; returns the ``(RUN, action)`` of what changed.

        The changes are written down before the table moves, since they follow
        from the state before the merge.
        """
        (held, others), bucket = self._holding(staging), self._bucket()
        old = self._rows_in(held)
        parts, folder = [], self._folder()
        if others:
            outside = staging.where(~bucket.isin(held)) if held else staging
            added = cut_lineage(C.merge(old.limit(0), outside, self.key, only_changed=only_changed))
            parts.append(C.changes(added, self.key))
        if held:
            inside = staging.where(bucket.isin(held))
            self._write(C.merge(old, inside, self.key, only_changed=only_changed), folder)
            schema = T.StructType([*self.schema.fields, T.StructField("action", T.StringType()),
                                   T.StructField(_BUCKET, T.IntegerType())])
            parts.append(C.changes(self.spark.read.schema(schema).parquet(folder), self.key))
        changed = cut_lineage(reduce(DataFrame.unionByName, parts))
        if held:
            self._point(held, folder, self._partitions())
        if others:
            self.insert(added)
        return changed

    def remove_old(self) -> None:
        """Delete the folders under the table that no partition shows; not while others read it."""
        jvm, location = self.spark._jvm, self._location()
        system = jvm.org.apache.hadoop.fs.Path(location).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        shown = self._shown()
        for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{location}/{_FOLDERS}/*/{_BUCKET}=*")) or []:
            if found.getPath().toString().rpartition(f"{_FOLDERS}/")[2] not in shown:
                system.delete(found.getPath(), True)

    def _location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(self.name)}").where("col_name = 'Location'")
        return rows.first()["data_type"].rstrip("/")

    def _shown(self) -> set[str]:
        """The folders that partitions show, from one listing of the table; none is shown without files."""
        self.spark.catalog.refreshTable(self.name)
        files = self.spark.table(self.name).inputFiles()
        return {file.rpartition(f"{_FOLDERS}/")[2].rpartition("/")[0] for file in files}

    def _folder(self) -> str:
        """A new folder under the table; its name keeps it out of listings of the table itself."""
        return f"{self._location()}/{_FOLDERS}/{uuid.uuid4().hex}"

    def _bucket(self) -> Column:
        return key_bucket(F.col(f"`{self.key}`"), self.buckets)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, self._bucket())

    def _partitions(self) -> list[int]:
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {_quoted(self.name)}").collect())

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets the keys fall in, null keys included; at most ``buckets`` numbers."""
        return sorted(row["b"] for row in rows.select(self._bucket().alias("b")).distinct().collect())

    def _holding(self, keys: DataFrame) -> tuple[list[int], bool]:
        """Buckets that have rows of ``keys``, and whether there may be keys in others.

        Reads the key column of the buckets they fall in; of a table without rows, nothing.
        """
        if not self._partitions():
            return [], True
        wanted = keys.select(F.col(f"`{self.key}`"))
        fallen = self._buckets_of(wanted)
        rows = self.spark.table(self.name).where(F.col(_BUCKET).isin(fallen)).select(F.col(f"`{self.key}`"), _BUCKET)
        found = rows.join(lookup_side(wanted.distinct()), self.key, "left_semi").select(_BUCKET).distinct()
        held = sorted(row[_BUCKET] for row in found.collect())
        return held, not held or held != fallen

    def _rows_in(self, touched: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)

    def _rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not touched:
            return
        folder = self._folder()
        self._write(change(self._rows_in(touched)), folder)
        self._point(touched, folder, self._partitions())

    def _write(self, rows: DataFrame, folder: str) -> None:
        # rebalance splits a bucket that one key fills, and joins small ones
        self._placed(rows).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)

    def _point(self, touched: list[int], folder: str, known: list[int]) -> None:
        """Let each touched partition show its new files.

        Buckets that are new, or have no rows any more, take one statement together; one that is
        replaced takes a statement of its own, as Spark has none for several.
        """
        table = _quoted(self.name)
        schema = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        filled = {r[_BUCKET] for r in self.spark.read.schema(schema).parquet(folder).select(_BUCKET).distinct().collect()}

        def part(bucket: int) -> str:
            return f"PARTITION ({_BUCKET}={bucket})"

        def place(bucket: int) -> str:
            return f"LOCATION '{folder}/{_BUCKET}={bucket}'"

        for bucket in sorted(filled.intersection(known)):
            self.spark.sql(f"ALTER TABLE {table} {part(bucket)} SET {place(bucket)}")
        if added := sorted(filled.difference(known)):
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(f'{part(b)} {place(b)}' for b in added)}")
        if emptied := sorted(set(touched).intersection(known) - filled):
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(part(bucket) for bucket in emptied)}")
        self.spark.catalog.refreshTable(self.name)
