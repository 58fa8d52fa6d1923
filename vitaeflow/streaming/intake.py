"""Documents that keep arriving: extract, load and index them batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaeflow.fixed_values import RECORD_KEY
from vitaeflow.operators import extraction, models
from vitaeflow.operators.documents import PageExtractor
from vitaeflow.plans import jobs
from vitaeflow.session import copies_removed, cut_lineage
from vitaeflow.sources.folders import with_contents
from vitaeflow.sources.ledger import Ledger
from vitaeflow.sources.tables import KeyedTable


def start_intake(
    texts: DataFrame,
    checkpoint: str,
    model: models.ChatModel,
    embedder: models.Embedder,
    candidates_table: KeyedTable,
    chunks_table: KeyedTable,
    staging: str,
    rejects: Callable[[DataFrame, int], None],
    size: int | None = None,
    available_now: bool = True,
    concurrency: int | None = None,
    replies: Ledger | None = None,
    vectors: Ledger | None = None,
) -> StreamingQuery:
    """Run a stream of ``([path,] pdf_name, ingest_ts, text[, error])`` into the tables.

    ``jobs.read_documents`` over ``document_file_stream`` gives such a stream.
    Loads are keyed, so a batch that runs twice after a failure changes
    nothing more, and with ledgers of ``replies`` and ``vectors`` no call that was answered is
    repeated. Staged rows of a batch that died are replaced when it runs again, and the copies that a
    batch writes down are removed when it ends. ``rejects`` gets what a batch could not load, with
    the reason in ``error``: rejected records, records without a usable key, and the keys whose
    chunks could not be embedded, which keep their old ones. It is called before the checkpoint
    moves on. ``checkpoint`` belongs on the folder all executors share.
    """

    spark = texts.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        with copies_removed(spark):
            # A batch's own session runs without adaptive execution. From its copy
            # on, the load runs in the outer session, which splits hot keys.
            _load_batch(cut_lineage(batch, spark), checkpoint, batch_id, model, embedder, candidates_table, chunks_table,
                        staging, rejects, size, concurrency, replies, vectors)

    writer = texts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_folder_intake(
    listing: DataFrame,
    seen: KeyedTable,
    extract: PageExtractor,
    checkpoint: str,
    model: models.ChatModel,
    embedder: models.Embedder,
    candidates_table: KeyedTable,
    chunks_table: KeyedTable,
    staging: str,
    rejects: Callable[[DataFrame, int], None],
    size: int | None = None,
    every: str | None = None,
    concurrency: int | None = None,
    replies: Ledger | None = None,
    vectors: Ledger | None = None,
) -> StreamingQuery:
    """Keep the tables up to date with folders whose files are added and replaced.

    ``listing`` is ``folders.listing_stream``. A file is taken in if ``seen``, a table of
    ``SEEN_FILES`` keyed on ``path``, lacks its path with this time and length: a file that
    is overwritten is read again, one that is moved here with an old time is found too, and a listing without
    changes costs one join of names. Files are noted as seen after their batch is loaded, so a batch that died is
    found again. A replacement under the same time and length goes unnoticed. Rejected files are seen
    as well; a new version of them is tried again. A file that is removed removes nothing.

    The folders are listed once, or again after each interval ``every`` ("10 minutes"). The rest is as
    in ``start_intake``.
    """
    spark = listing.sparkSession

    def load(batch: DataFrame, batch_id: int) -> None:
        with copies_removed(spark):
            fresh = cut_lineage(unseen_files(cut_lineage(batch, spark), seen))
            if fresh.isEmpty():
                return
            # read once: pages, models and rejects all go on from the copy
            texts = cut_lineage(jobs.read_documents(with_contents(fresh), extract))
            _load_batch(texts, checkpoint, batch_id, model, embedder, candidates_table, chunks_table,
                        staging, rejects, size, concurrency, replies, vectors)
            seen.refresh(fresh, fresh.select("path"))

    writer = listing.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def unseen_files(listed: DataFrame, seen: KeyedTable) -> DataFrame:
    """The files of a listing that ``seen`` does not have in this version."""
    return listed.join(seen.read(), ["path", "modificationTime", "length"], "left_anti")


def _load_batch(held: DataFrame, checkpoint: str, batch_id: int, model: models.ChatModel, embedder: models.Embedder,
                candidates_table: KeyedTable, chunks_table: KeyedTable, staging: str,
                rejects: Callable[[DataFrame, int], None], size: int | None, concurrency: int | None,
                replies: Ledger | None, vectors: Ledger | None) -> None:
    """Load one batch of texts; the load goes by the batch's name, so that it can run again."""
    records = jobs.extract_records(held, model, concurrency=concurrency, replies=replies)
    load_id = hashlib.sha256(f"{checkpoint}\n{batch_id}".encode()).hexdigest()[:32]
    result = jobs.load_records(extraction.accepted(records), held, candidates_table, chunks_table, staging,
                               embedder, size=size, concurrency=concurrency, vectors=vectors, load_id=load_id)
    unkeyed = result.invalid.withColumn("error", F.lit("no usable key"))
    stale = result.failed_chunks.groupBy(F.col("RUN").alias(RECORD_KEY)).agg(
        F.concat(F.lit("chunks not embedded: "), F.min("error")).alias("error"))
    lost = extraction.rejected(records).unionByName(unkeyed).unionByName(stale, allowMissingColumns=True)
    rejects(lost, batch_id)
