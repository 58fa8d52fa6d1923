"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key, by default a hash of the text, so that equal
texts stand together and a shard is a fair mix of everything else. Keys drawn
with a chance in proportion to size give quantile boundaries; the ranges
between them are measured exactly, and a range that holds too much (a hot key)
is subdivided by a hash of ``doc_id``, and rows that still are too many because they
are the same row again and again by a number that each got when written down. Running sums inside the pieces, which
are small, place every record at its exact position in the whole order; shards
are equal cuts of that order. Only narrow rows move, never texts.

Defined cases: a null text has no bytes and counts 8; null ``doc_id`` are
records like others; repeated rows each get a slot of their own; an empty
table gives an empty result. Other columns of the input are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, write_down

#: Records that a piece should hold at most, and pieces there are at least for each shard.
PIECE_ROWS = 1_000_000
PIECES_PER_SHARD = 32
#: Keys drawn for each piece.
DRAWN = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def _number(column: Column) -> Column:
    """A number from 0 to 1 that follows from the column's hash."""
    return F.shiftrightunsigned(column, 11) / F.lit(float(1 << 53))


def splitters(records: DataFrame, total: int, pieces: int) -> np.ndarray:
    """Boundaries of ``pieces`` ranges of near equal bytes, from keys drawn by size.

    About ``DRAWN * pieces`` keys come to the driver, whatever the rows; a record larger than
    its share counts several times instead of being drawn several times.
    """
    drawn = DRAWN * pieces
    chance = F.col("size") * F.lit(drawn / total)
    # the hash of the row decides, so that a task that runs again draws the same
    count = F.floor(chance + _number(F.xxhash64(F.col("doc_id"), F.col("key"), F.lit("drawn"))))
    found = records.select("key", count.alias("n")).where("n > 0").toPandas()
    found = found.sort_values("key", kind="stable")
    at = np.searchsorted(np.cumsum(found["n"].to_numpy()), np.arange(1, pieces) * found["n"].sum() / pieces)
    return np.unique(found["key"].to_numpy(np.int64)[at]) if len(found) else np.zeros(0, np.int64)


def _range_of(bounds: np.ndarray):
    def make():
        return lambda keys: pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="left"), pa.int32())

    return array_function(make, "int")


def _cut_copies(placed: DataFrame, most_bytes: int, most_rows: int) -> DataFrame:
    """``placed`` with ``cut``: 0, but from 1 on for the copies of a row that alone is more than a piece may hold.

    Such rows are fewer than pieces. Their copies are alike, so it does not matter which copy gets which number.
    """
    whole = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    over = whole.where((F.col("bytes") > most_bytes) | (F.col("n") > most_rows)).select("range", "part")
    if not (held := over.collect()):
        return placed.withColumn("cut", F.lit(0))
    pieces = placed.sparkSession.createDataFrame(held, "range int, part int")
    alike = ["range", "part", "key", "size", "text_crc32", "doc_id"]
    copies = placed.join(F.broadcast(pieces), ["range", "part"]).groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    pieces_of = F.greatest(F.ceil(F.col("n") * F.col("size") / most_bytes), F.ceil(F.col("n") / most_rows))
    many = copies.withColumn("cuts", pieces_of).where("n > 1 AND cuts > 1").drop("n").collect()
    if not many:
        return placed.withColumn("cut", F.lit(0))
    # a stable number for each kind of row, so that two kinds in a piece are not mixed
    many = sorted(many, key=lambda r: (r["range"], r["part"], r["key"], str(r["doc_id"]), r["size"], r["text_crc32"]))
    first, found = 1, []
    for r in many:
        found.append((r["key"], r["size"], r["text_crc32"], r["doc_id"], int(r["cuts"]), first))
        first += int(r["cuts"])
    kind = placed.schema["doc_id"].dataType.simpleString()
    kinds = placed.sparkSession.createDataFrame(found, f"k bigint, s bigint, c bigint, i {kind}, cuts bigint, first bigint")
    same = (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")) & (F.col("text_crc32") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("i"))
    cut = F.coalesce(F.col("first") + F.pmod(F.xxhash64("written"), F.col("cuts")), F.lit(0)).cast("int")
    return placed.join(F.broadcast(kinds), same, "left").withColumn("cut", cut).drop("k", "s", "c", "i", "cuts", "first")


def assign(docs: DataFrame, shards: int = 24, key: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, key, shard, slot`` of every record.

    ``shard`` runs from 0, ``slot`` is gapless from 0 in each shard, in key order. ``key`` is a
    bigint expression over ``docs``.
    """
    spark = docs.sparkSession
    text = F.col("text")
    records = write_down(docs.select(
        "doc_id", record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.xxhash64(text) if key is None else key, F.lit(0).cast("bigint")).alias("key"),
        F.monotonically_increasing_id().alias("written"),
    ), "records")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return records.drop("written").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("bigint")})
    pieces = max(PIECES_PER_SHARD * shards, -(-rows // PIECE_ROWS))
    bounds = splitters(records, total, pieces)
    ranged = records.withColumn("range", _range_of(bounds)(F.col("key")))
    measured = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    # ranges over twice their share in bytes or rows are subdivided
    parts = {r["range"]: max(-(-r["bytes"] * pieces // total), -(-r["n"] * pieces // rows)) for r in measured}
    over = {k: int(n) for k, n in parts.items() if n > 2}
    part = F.lit(0)
    if over:
        found = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, over)), F.array(*map(F.lit, over.values()))), F.col("range"))
        part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("part")), found), F.lit(0))
    placed = _cut_copies(ranged.withColumn("part", part.cast("int")), 2 * -(-total // pieces), 2 * -(-rows // pieces))
    sums = placed.groupBy("range", "part", "cut").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas()
    sums = sums.sort_values(["range", "part", "cut"])
    sums["bytes_before"] = sums["bytes"].cumsum() - sums["bytes"]
    sums["rows_before"] = sums["n"].cumsum() - sums["n"]
    before = spark.createDataFrame(
        sums[["range", "part", "cut", "bytes_before", "rows_before"]].astype("int64"),
        "range bigint, part bigint, cut bigint, bytes_before bigint, rows_before bigint",
    )
    piece = Window.partitionBy("range", "part", "cut").orderBy("key", "doc_id")
    inside = placed.withColumns({
        "sum": F.sum("size").over(piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "nth": F.row_number().over(piece).cast("bigint"),
    })
    # one row for each piece, so the pieces' number bounds what is broadcast
    ordered = inside.join(F.broadcast(before), ["range", "part", "cut"])
    middle = 2 * (F.col("bytes_before") + F.col("sum")) - F.col("size")
    cut = F.floor(middle * F.lit(shards) / F.lit(2 * total))
    ordered = write_down(ordered.select(
        "doc_id", "size", "text_crc32", "key", F.least(cut, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
    ), "ordered")
    first = ordered.groupBy("shard").agg(F.min("nth").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: Column | None = None) -> None:
    """Write the whole records to ``path``, one folder for each shard, files sorted by slot.

    Records meet their places by ``doc_id``, key and, among rows equal in both, by number.
    """
    own = docs.columns
    full = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("record"), "doc_id",
        F.coalesce(F.xxhash64("text") if key is None else key, F.lit(0).cast("bigint")).alias("key"),
    )
    same = Window.partitionBy("doc_id", "key").orderBy("key")
    full = full.withColumn("copy", F.row_number().over(same))
    places = assign(docs, shards, key).withColumn("copy", F.row_number().over(same))
    places = places.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), F.col("copy").alias("c"), "shard", "slot")
    joined = full.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("copy") == F.col("c")))
    joined.select("shard", "slot", "record").repartitionByRange("shard", "slot").sortWithinPartitions(
        "shard", "slot").write.partitionBy("shard").parquet(path)
