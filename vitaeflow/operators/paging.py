"""Pages of a large sorted table, each read by itself.

The table is written once in its order, in parts of bounded size; every row has its ``place``: part and
number in the part. A page is a range of places, so only the parts and row groups that hold it are read,
whatever came before it. Rows that are equal in all columns of the order have places of their own, so
pages neither repeat nor lose any.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACE, _PART, _COUNTS = "_place", "_part", "_counts"
#: Rows of a part (at most about twice as many), bytes of a row group, and the bits of a place that number a part's rows.
PART_ROWS, _GROUP_BYTES, _BITS = 1_000_000, 4 * 1024 * 1024, 33


def _sorted_by(order: list[str]) -> list[Column]:
    return [F.desc(o.removesuffix(" desc")) if o.endswith(" desc") else F.asc(o) for o in order]


def lay_out(rows: DataFrame, order: list[str], folder: str, part_rows: int = PART_ROWS) -> OrderedRows:
    """Write ``rows`` to a new ``folder`` in the order of columns such as ``"name"`` or ``"age desc"``.

    Nulls come first, or last where the order descends, as in Spark's own sorting.
    """
    columns = _sorted_by(order)
    parts = max(1, -(-rows.count() // part_rows))
    placed = rows.repartitionByRange(parts, *columns).withColumn(_PART, F.spark_partition_id())
    # numbered behind the sort: the part, then the row in it
    placed = placed.sortWithinPartitions(_PART, *columns).withColumn(_PLACE, F.monotonically_increasing_id())
    placed.write.partitionBy(_PART).option("parquet.block.size", _GROUP_BYTES).parquet(f"{folder}/rows")
    written = rows.sparkSession.read.schema(placed.schema).parquet(f"{folder}/rows")
    counts = written.groupBy(_PART).count().withColumn("schema", F.lit(placed.schema.json()))
    # a table without rows has a schema too
    none = rows.sparkSession.range(1).select(F.lit(-1).alias(_PART), F.lit(0).cast("bigint").alias("count"), F.lit(placed.schema.json()).alias("schema"))
    counts.unionByName(none).coalesce(1).write.parquet(f"{folder}/{_COUNTS}")
    return OrderedRows(rows.sparkSession, folder)


class OrderedRows:
    """A table that ``lay_out`` wrote; holds one number for each of its parts."""

    def __init__(self, spark: SparkSession, folder: str):
        counts = spark.read.parquet(f"{folder}/{_COUNTS}").collect()
        self.rows = spark.read.schema(T.StructType.fromJson(json.loads(counts[0]["schema"]))).parquet(f"{folder}/rows")
        self.counts = sorted((r[_PART], r["count"]) for r in counts if r["count"])

    def count(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, size: int, after: int | None = None) -> DataFrame:
        """The ``size`` rows behind the one whose ``_place`` is ``after``; the first ones without it."""
        if size <= 0:
            raise ValueError(f"page size must be positive, got {size}")
        return self._between(*self._range(size, -1 if after is None else after))

    def pages(self, size: int) -> list[tuple[int | None, int]]:
        """``after`` and number of rows of every page, from the counts alone."""
        found, after, left = [], None, self.count()
        while left > 0:
            found.append((after, min(size, left)))
            after = self._range(size, -1 if after is None else after)[1]
            left -= size
        return found

    def after_key(self, first: object, order: str, size: int) -> DataFrame:
        """The page that begins with the first row whose leading column comes not before ``first``."""
        name = order.removesuffix(" desc")
        here = F.col(f"`{name}`") <= F.lit(first) if order.endswith(" desc") else F.col(f"`{name}`") >= F.lit(first)
        begins = self.rows.where(here).agg(F.min(_PLACE)).first()[0]
        return self.rows.limit(0).drop(_PART) if begins is None else self.page(size, begins - 1)

    def _range(self, size: int, after: int) -> tuple[int, int]:
        """The places that the next ``size`` rows lie between, both included."""
        last = after
        for part, n in self.counts:
            begin = part << _BITS
            skipped = min(max(after + 1 - begin, 0), n)
            if skipped == n:
                continue
            taken = min(size, n - skipped)
            last, size = begin + skipped + taken - 1, size - taken
            if not size:
                break
        return after + 1, last

    def _between(self, low: int, high: int) -> DataFrame:
        # the place decides; the part, which follows from it, keeps other folders from being opened
        parts = F.col(_PART).between(low >> _BITS, high >> _BITS)
        return self.rows.where(parts & F.col(_PLACE).between(low, high)).drop(_PART).orderBy(_PLACE)
