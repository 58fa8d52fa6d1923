"""Tables that lie by their key, so that joins on it move nothing.

A table is written in Spark buckets of its key. Two with the same number of
buckets are joined bucket by bucket, without an exchange on either side. Such
a join cannot be split at run time, so keys with more rows than a bucket's share
are kept apart, in a second table without buckets, and so are null keys. Apart
rows meet what the other table has under their keys by a measured broadcast,
or by a shuffle that adaptive execution can split.

Laying out costs one shuffle and pays where the same tables are joined again
and again, as candidates, chunks and stored documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.session import lookup_side

#: Fewest rows that a key is kept apart for.
HOT_ROWS = 100_000
_JOINS = ("inner", "left", "left_semi", "left_anti")


class ColocatedTable:
    """A table in ``buckets`` of ``key``. About 1 GB a bucket is a good size; tables joined need the same number."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets

    def write(self, rows: DataFrame, hot_rows: int = HOT_ROWS) -> ColocatedTable:
        """Lay out ``rows`` in place of what was there. They are read three times, at first only their keys.

        Fewer than ``buckets`` keys can have more than a bucket's share, so their list is small whatever the rows.
        """
        key = F.col(f"`{self.key}`")
        counts = rows.where(key.isNotNull()).groupBy(key.alias(self.key)).agg(F.count(F.lit(1)).alias("n"))
        total = rows.count()
        hot = counts.where(F.col("n") > max(hot_rows, total / self.buckets)).select(self.key)
        hot.write.mode("overwrite").format("parquet").saveAsTable(f"{self.name}__hot")
        self._put(rows, "overwrite")
        return self

    def append(self, rows: DataFrame) -> None:
        """Add rows where their keys lie; old files stay. Which keys lie apart is settled by ``write`` alone.

        A key that grows hot by appending gives the same results from longer tasks, until the table is written anew.
        """
        self._put(rows.select(*self.spark.table(self.name).columns), "append")

    def _put(self, rows: DataFrame, mode: str) -> None:
        key = F.col(f"`{self.key}`")
        apart = rows.where(key.isNull())
        if self._has_hot():
            hot = F.broadcast(self.hot_keys())
            apart = apart.unionByName(rows.join(hot, self.key, "left_semi").select(*rows.columns))
            rows = rows.join(hot, self.key, "left_anti").select(*rows.columns)
        apart.write.mode(mode).format("parquet").saveAsTable(f"{self.name}__apart")
        # one task a bucket, one file a task
        dealt = rows.where(key.isNotNull()).repartition(self.buckets, key)
        dealt.write.mode(mode).format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)

    def hot_keys(self) -> DataFrame:
        return self.spark.table(f"{self.name}__hot")

    def _has_hot(self) -> bool:
        return not self.hot_keys().isEmpty()

    def read(self) -> DataFrame:
        return self.spark.table(self.name).unionByName(self._apart())

    def _apart(self) -> DataFrame:
        return self.spark.table(f"{self.name}__apart")

    def drop(self) -> None:
        for name in (self.name, f"{self.name}__apart", f"{self.name}__hot"):
            self.spark.sql(f"DROP TABLE IF EXISTS {'.'.join(f'`{part}`' for part in name.split('.'))}")

    def joined(self, other: ColocatedTable, how: str = "inner") -> DataFrame:
        """Join with ``other`` on both keys, as ``how`` says: inner, left, left_semi or left_anti.

        The result has this table's columns and, but for semi and anti joins, the other's without its key; those
        must have other names. Null keys match nothing.
        """
        if how not in _JOINS:
            raise ValueError(f"unknown join: {how}")
        if self.buckets != other.buckets:
            raise ValueError(f"tables lie in {self.buckets} and {other.buckets} buckets")
        key, mine, pairs = self.key, self.spark.table(self.name), how in ("inner", "left")
        theirs = self.spark.table(other.name).withColumnRenamed(other.key, key)
        their_apart = other._apart().withColumnRenamed(other.key, key)
        columns = [*mine.columns, *(c for c in theirs.columns if c != key and pairs)]
        if len(set(columns)) != len(columns):
            raise ValueError(f"columns clash: {sorted(c for c in set(columns) if columns.count(c) > 1)}")
        if mine.schema[key].dataType != theirs.schema[key].dataType:
            # other types hash to other buckets
            raise ValueError(f"keys are {mine.schema[key].dataType} and {theirs.schema[key].dataType}")

        apart, sides = self._apart(), []
        if other._has_hot():
            # Keys that are hot there: every row here that has one finds a match there.
            hot = F.broadcast(other.hot_keys().withColumnRenamed(other.key, key))
            met = mine.unionByName(apart).join(hot, key, "left_semi")
            mine, apart = mine.join(hot, key, "left_anti"), apart.join(hot, key, "left_anti")
            if pairs:
                sides.append(lookup_side(met).join(their_apart, key))
            elif how == "left_semi":
                sides.append(met)
        # Their other rows under keys that are hot here.
        near = theirs.join(F.broadcast(self.hot_keys()), key, "left_semi")
        sides.append(apart.join(lookup_side(near if pairs else near.select(key).distinct()), key, how))
        result = mine.join(theirs.hint("merge"), key, how).select(*columns)
        for side in sides:
            result = result.unionByName(side.select(*columns))
        return result
