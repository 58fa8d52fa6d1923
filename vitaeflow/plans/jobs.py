"""The jobs a user runs: extract, load, index, answer, list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.fixed_values import EXTRACTION_PROMPT, HITS_PER_QUESTION, RECORD_KEY, SOURCE_NAME, SUMMARY_PROMPT
from vitaeflow.functions.prompts import chat_request, extraction_prompt, summary_prompt
from vitaeflow.operators import answers, candidates, documents, extraction, listing, models, similarity
from vitaeflow.schema import CHUNKS, STAGING
from vitaeflow.session import cut_lineage, lookup_side
from vitaeflow.sources.ledger import Ledger
from vitaeflow.sources.tables import KeyedTable, drop_load, stage_rows


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``path``, which tells documents apart; names may repeat from folder to folder.

    Rows that never were files have none: theirs is their ``pdf_name``.
    """
    return rows if "path" in rows.columns else rows.withColumn("path", F.col(SOURCE_NAME))


def read_documents(files: DataFrame, extract: documents.PageExtractor) -> DataFrame:
    """``(path, pdf_name, ingest_ts, text, error)`` from document files."""
    read = documents.read_pages(files, extract)
    return read.select(
        "path",
        SOURCE_NAME,
        F.col("modificationTime").alias("ingest_ts"),
        documents.pages_text(F.col("pages")).alias("text"),
        "error",
    )


def store_documents(files: DataFrame, records: DataFrame, stored: KeyedTable) -> None:
    """Keep the files of ``records`` (``path`` and key) under their normalised keys, the last one of a key.

    ``stored`` is keyed on ``run_norm``; what it holds for a key is replaced.
    Records without a usable key store nothing.
    """
    keys = records.select("path", F.col(f"`{RECORD_KEY}`"))
    # which file a key keeps is settled without contents, once
    named = files.select("path", "modificationTime").join(lookup_side(keys), "path")
    winners = cut_lineage(listing.last_documents(named, RECORD_KEY, ["modificationTime", "path"]))
    last = files.join(lookup_side(winners.select("run_norm", "modificationTime", "path")), ["modificationTime", "path"])
    stored.refresh(last, winners.select("run_norm"))


def extract_records(texts: DataFrame, model: models.ChatModel, fence_only: bool = False,
                    batch_size: int = 16, concurrency: int | None = None,
                    template: str = EXTRACTION_PROMPT, replies: Ledger | None = None) -> DataFrame:
    """Records from document texts ``([path,] pdf_name, ingest_ts, text[, error])``.

    Blank documents are not sent to the model. Every document keeps one row:
    the ten fields, or the reason in ``error``. The result is written down
    once, so later steps do not repeat the calls; a ledger of ``replies`` saves them to other jobs too.
    """
    marked = documents.mark_blank(identified(texts))
    earlier = [F.col("error")] if "error" in texts.columns else []
    marked = marked.withColumn("error", F.coalesce(*earlier, F.col("reject_reason")))
    payload = F.when(F.col("error").isNull(), chat_request(extraction_prompt(F.col("text"), template)))
    # the request holds the text; a ledger writes its rows down
    called = models.complete(marked.withColumn("payload", payload).drop("text"), model, batch_size=batch_size,
                             concurrency=concurrency, ledger=replies)
    read = extraction.read_chat_replies(called.withColumnRenamed("error", "_call_error"))
    reason = F.coalesce(F.col("_call_error"), F.col("error"))
    records = extraction.extract_records(read, fence_only=fence_only, earlier_error=reason)
    kept = [F.col(f"`{f.name}`") for f in STAGING.fields]
    return cut_lineage(records.select(*kept, F.col("content").alias("raw"), "total_tokens", "error"))


def index_texts(texts: DataFrame, embedder: models.Embedder, key: str = "RUN", size: int | None = None,
                batch_size: int = 64, concurrency: int | None = None, vectors: Ledger | None = None) -> DataFrame:
    """Chunk rows ``(key, chunk_no, text, vector, error)``, written down once.

    With a ledger of ``vectors``, a chunk whose text was embedded before costs no call. The ledger has written down
    the chunks and their answers, which are joined where they are used; a use without texts moves none.
    """
    pieces = documents.chunk(texts, key, size)
    embedded = models.embed(pieces, embedder, batch_size=batch_size, concurrency=concurrency, ledger=vectors)
    return embedded if vectors is not None else cut_lineage(embedded)


@dataclass
class Load:
    """What a load did: change keys, and the rows left for review."""

    changes: DataFrame
    invalid: DataFrame
    failed_chunks: DataFrame


def load_records(
    reviewed: DataFrame,
    texts: DataFrame,
    candidates_table: KeyedTable,
    chunks_table: KeyedTable,
    staging: str,
    embedder: models.Embedder,
    corrections: DataFrame | None = None,
    size: int | None = None,
    concurrency: int | None = None,
    vectors: Ledger | None = None,
    load_id: str | None = None,
) -> Load:
    """Load reviewed records and refresh the vectors of the keys that changed.

    ``reviewed`` has the record fields, ``pdf_name``, ``ingest_ts`` and the ``path`` of its
    document; ``texts`` gives the text of each ``path``. Corrections apply first, by ``path``,
    and may set the key. A key is refreshed as a whole: where ``texts`` lacks its
    document, or one of its chunks has no vector, its old rows stay and such
    chunks come back as failed. A document whose text is empty now has no chunks any more.

    A load merges the rows it staged itself and then removes them. What a load that died has left
    in staging is neither merged nor removed here; run that load again, or clear the table. A load
    that names itself by ``load_id`` replaces what an earlier attempt has staged under that name.
    """
    spark = reviewed.sparkSession
    reviewed, texts = identified(reviewed), identified(texts)
    if corrections is not None:
        reviewed = candidates.apply_corrections(reviewed, corrections, "path")
    valid, invalid = candidates.split_by_key(reviewed)
    load_id = stage_rows(valid.select(*[F.col(f"`{f.name}`") for f in STAGING.fields]), staging, load_id)
    staged = spark.table(staging).where(F.col("load_id") == load_id).drop("load_id")

    # the document each key's record came from: the row that the merge takes
    source = candidates.latest_rows(
        staged.select(F.col(f"`{RECORD_KEY}`").alias("RUN"), "ingest_ts", SOURCE_NAME, "path"), "RUN",
        ["ingest_ts", SOURCE_NAME, "path"],
    )
    source = cut_lineage(source)
    changed = candidates_table.merge(staged)
    to_index = candidates.with_changed_key(source, changed).select("RUN", "path")
    keyed = texts.where("text IS NOT NULL").select("path", "text").join(lookup_side(to_index), "path")
    pieces = index_texts(keyed, embedder, size=size, concurrency=concurrency, vectors=vectors)
    failed = pieces.where(F.col("error").isNotNull())
    ready = cut_lineage(keyed.select("RUN").distinct().join(failed.select("RUN").distinct(), "RUN", "left_anti"))
    chunks_table.refresh(pieces.select(*CHUNKS.names), ready)
    drop_load(spark, staging, load_id)
    return Load(changed, invalid, failed)


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame | KeyedTable,
    embedder: models.Embedder,
    model: models.ChatModel,
    k: int = HITS_PER_QUESTION,
    keys: list[str] | None = None,
    per_candidate: bool = False,
    concurrency: int | None = None,
    template: tuple[str, str] = SUMMARY_PROMPT,
) -> tuple[DataFrame, DataFrame]:
    """Answers ``(query_id, answer_text, failed_hits)`` and the hits behind them.

    From a keyed table the search reads the vectors, and the texts come only
    from the buckets with hits. ``failed_hits`` counts the hits that an answer lacks because their
    model call failed. A question without hits has no answer, as has one whose calls all failed. The
    hits carry the reasons; a question whose own embedding failed is among them, without a key.
    """
    keys = keys or ["RUN", "chunk_no"]
    asked = cut_lineage(models.embed(questions, embedder, text="question", concurrency=concurrency))
    held = chunks.read() if isinstance(chunks, KeyedTable) else chunks
    hits = cut_lineage(similarity.top_k(asked, held, k, keys=keys, per_candidate=per_candidate))
    texts = chunks.near(hits) if isinstance(chunks, KeyedTable) else chunks
    answered, done = answer_hits(hits, texts, model, keys, concurrency, template)
    refused = asked.where(F.col("error").isNotNull()).select("query_id", "error")
    return answered, done.unionByName(refused, allowMissingColumns=True)


def answer_hits(hits: DataFrame, chunks: DataFrame, model: models.ChatModel, keys: list[str],
                concurrency: int | None = None,
                template: tuple[str, str] = SUMMARY_PROMPT) -> tuple[DataFrame, DataFrame]:
    """The second half of ``answer_questions``: from hits to texts."""
    found = answers.hit_texts(hits, chunks, keys)
    asking = found.withColumn("payload", chat_request(summary_prompt(F.col("text"), template)))
    called = models.complete(asking, model, concurrency=concurrency, expected=hits.count())
    read = extraction.read_chat_replies(called.withColumnRenamed("error", "_call_error"))
    summed = read.withColumn("error", F.coalesce("_call_error", "error")).withColumnRenamed("content", "answer")
    done = cut_lineage(summed.select(*hits.columns, "answer", "total_tokens", "error"))
    lost = done.where(F.col("error").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("failed_hits"))
    answered = answers.join_answers(done.where(F.col("error").isNull())).join(lost, "query_id", "left")
    return answered.withColumn("failed_hits", F.coalesce("failed_hits", F.lit(0).cast("bigint"))), done
