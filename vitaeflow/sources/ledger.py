"""Answers of a model, kept under the digest of what was asked.

Rows with equal inputs cost one call, and an input that was answered once costs
none again: not when a text comes back unchanged, nor when a batch is replayed
or a job runs again after it died. Calls go in parts, and the answers of a part
are in the table before the next one begins, so what a dead job had answered is
lost for at most one part. Failed calls are not kept; they are tried again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.session import cut_lineage, lookup_side
from vitaeflow.sources.tables import KeyedTable

#: Answers of an embedding model, and reply bodies of a chat model.
VECTORS, REPLIES = T.ArrayType(T.FloatType()), T.StringType()


class Ledger:
    """A keyed table ``(digest, value)``.

    ``version`` names the model and whatever else decides its answers; answers of another one are not
    taken. ``part_calls`` is the number of inputs whose answers are written down together.
    """

    def __init__(self, spark: SparkSession, name: str, kind: T.DataType, version: str = "", buckets: int | None = None,
                 part_calls: int = 100_000):
        schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("value", kind)])
        self.table = KeyedTable(spark, name, schema, "digest", buckets).create()
        self.version, self.part_calls = version, part_calls

    def digest(self, source: Column) -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(self.version), source), 256)

    def answered(self, rows: DataFrame, call: Callable[[DataFrame], DataFrame], source: str, output: str) -> DataFrame:
        """``rows`` with ``output`` and ``error``. ``call`` adds ``value`` and ``error`` to ``(digest, <source>)``."""
        digest = F.when(F.col(source).isNotNull(), self.digest(F.col(source)))
        marked = cut_lineage(rows.withColumn("_digest", digest))
        asked = marked.where("_digest IS NOT NULL").select(F.col("_digest").alias("digest"), F.col(source))
        names = cut_lineage(asked.select("digest").distinct())
        known = self._known(names)
        # which inputs are new is settled by digest; of those that are known, no text moves
        unknown = cut_lineage(names.join(lookup_side(known.select("digest")), "digest", "left_anti"))
        failed = None
        if not unknown.isEmpty():
            failed = self._ask(asked.join(lookup_side(unknown), "digest", "left_semi").dropDuplicates(["digest"]), call)
            known = self._known(names)
        answers = known.withColumn("_error", F.lit(None).cast("string"))
        if failed is not None:
            answers = answers.unionByName(failed)
        answers = answers.select(F.col("digest").alias("_digest"), F.col("value").alias(output), "_error")
        found = marked.drop(output).join(lookup_side(answers), "_digest", "left")
        error = F.when(F.col("_digest").isNull(), "no input").otherwise(F.col("_error"))
        if "error" in rows.columns:
            error = F.coalesce(F.col("error"), error)
        return found.withColumn("error", error).drop("_digest", "_error").select(
            *[F.col(f"`{c}`") for c in dict.fromkeys([*rows.columns, output, "error"])])

    def _known(self, names: DataFrame) -> DataFrame:
        """One answer for each of the digests that have any; a part that was written twice counts once."""
        held = self.table.read().join(lookup_side(names), "digest", "left_semi")
        return cut_lineage(held.dropDuplicates(["digest"]))

    def _ask(self, fresh: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """Call for ``fresh`` part by part; returns the failures ``(digest, value, _error)``, if anything was asked."""
        fresh = cut_lineage(fresh)
        parts = math.ceil(fresh.count() / self.part_calls)
        failed = None
        for number in range(parts):
            part = fresh.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == number)
            done = cut_lineage(call(part).select("digest", "value", "error"))
            self.table.insert(done.where("error IS NULL").select("digest", "value"))
            lost = done.where("error IS NOT NULL").select("digest", "value", F.col("error").alias("_error"))
            failed = lost if failed is None else failed.unionByName(lost)
        return failed
