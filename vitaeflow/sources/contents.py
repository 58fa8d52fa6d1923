"""Stored documents whose contents are kept once, however many keys have them.

Two keyed tables: ``references`` says which document a key has and the SHA-256 of its content,
``contents`` has each content under that digest. A content is written before the references to it, so
readers never miss one, and a job that died is run again with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.fixed_values import RECORD_KEY
from vitaeflow.operators.listing import last_documents
from vitaeflow.schema import CONTENTS, REFERENCES, STORED_DOCUMENTS
from vitaeflow.session import cut_lineage, lookup_side
from vitaeflow.sources.tables import KeyedTable


class ContentStore:
    """Documents by normalised key, equal contents once. One writer at a time."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.references = KeyedTable(spark, f"{name}_references", REFERENCES, "run_norm", buckets)
        self.contents = KeyedTable(spark, f"{name}_contents", CONTENTS, "digest", buckets)

    def create(self) -> ContentStore:
        self.references.create()
        self.contents.create()
        return self

    def drop(self) -> None:
        self.references.drop()
        self.contents.drop()

    def put(self, files: DataFrame, records: DataFrame) -> DataFrame:
        """Keep the files of ``records`` (``path`` and key) under their normalised keys, the last one of a key.

        Which file a key keeps, and which contents are new, is settled by names and digests; of equal new contents one file
        moves. A key without a usable name stores nothing. The keys whose file had no content, or another one
        when it was read the second time, keep what they had and are returned, to be put again.
        """
        named = files.select("path", "modificationTime").join(
            lookup_side(records.select("path", F.col(f"`{RECORD_KEY}`"))), "path")
        winners = cut_lineage(last_documents(named, RECORD_KEY, ["modificationTime", "path"]))
        looked = lookup_side(winners)
        found = cut_lineage(files.join(looked, ["modificationTime", "path"]).select(
            "run_norm", "path", "modificationTime", "length", F.sha2("content", 256).alias("digest")))
        new = found.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("modificationTime", "path")).alias("from"))
        new = cut_lineage(new.join(self.contents.read().select("digest"), "digest", "left_anti").select(
            F.col("digest").alias("expected"), "from.*"))
        brought = files.join(lookup_side(new), ["modificationTime", "path"]).withColumn("digest", F.sha2("content", 256))
        self.contents.insert(brought.where("digest = expected").dropDuplicates(["digest"]))
        # a digest that is null, or whose content did not come, is not among those that are held
        held = self.contents.read().select("digest")
        kept = cut_lineage(found.join(held, "digest", "left_semi"))
        self.references.refresh(kept, kept.select("run_norm"))
        return found.join(held, "digest", "left_anti").select("run_norm", "path", "modificationTime")

    def read(self) -> DataFrame:
        """The documents with their contents, as a table of ``STORED_DOCUMENTS`` has them."""
        held = self.contents.read().select("digest", "content")
        return self.references.read().join(held, "digest").select(*STORED_DOCUMENTS.names)

    def delete(self, keys: DataFrame) -> None:
        """Remove the documents of ``keys (run_norm)``; their contents stay until ``remove_unreferenced``."""
        self.references.delete(keys)

    def unreferenced(self) -> DataFrame:
        """Digests of contents that no key has any more."""
        return self.contents.read().select("digest").join(self.references.read().select("digest"), "digest", "left_anti")

    def remove_unreferenced(self) -> int:
        """Remove such contents; how many there were."""
        gone = cut_lineage(self.unreferenced())
        self.contents.delete(gone)
        return gone.count()
