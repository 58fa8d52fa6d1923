"""Model replies to records, with rejects kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.fixed_values import RECORD_FIELDS
from vitaeflow.functions import replies as R
from vitaeflow.schema import CHAT_REPLY, EMBEDDING_REPLY
from vitaeflow.session import configure


def read_chat_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """Add ``content``, ``total_tokens`` and ``error`` from chat reply bodies."""
    parsed = F.from_json(F.col(body), CHAT_REPLY)
    return (
        replies.withColumn("_reply", parsed)
        .withColumn("content", F.get(F.col("_reply.choices"), F.lit(0))["message"]["content"])
        .withColumn("total_tokens", F.col("_reply.usage.total_tokens"))
        .withColumn(
            "error",
            F.when(F.col(body).isNull(), "no reply")
            .when(F.col("content").isNull(), "reply has no content")
            .when(F.col("total_tokens").isNull(), "reply has no token usage"),
        )
        .drop("_reply")
    )


def read_embedding_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """Add ``vector`` and ``error`` from embedding reply bodies."""
    parsed = F.from_json(F.col(body), EMBEDDING_REPLY)
    return (
        replies.withColumn("_reply", parsed)
        .withColumn("vector", F.get(F.col("_reply.data"), F.lit(0))["embedding"])
        .withColumn(
            "error",
            F.when(F.col(body).isNull(), "no reply").when(F.col("vector").isNull(), "reply has no embedding"),
        )
        .drop("_reply")
    )


def token_usage(replies: DataFrame, by: str | list[str]) -> DataFrame:
    """Tokens used per group."""
    keys = [by] if isinstance(by, str) else by
    return replies.groupBy(*keys).agg(F.sum("total_tokens").alias("tokens_used"))


def extract_records(
    replies: DataFrame, reply: str = "content", fence_only: bool = False, earlier_error: Column | None = None
) -> DataFrame:
    """Add the record fields and ``error`` from model replies.

    Rejected rows stay, with null fields, the reason in ``error`` and the
    reply itself untouched. ``earlier_error`` wins over later reasons.
    """
    configure(replies.sparkSession)
    names = [f"_kind{i}" for i in range(len(RECORD_FIELDS))]
    staged = (
        # one projection per step, so that no parse is repeated per field
        replies.withColumn("_clean", R.clean_reply(F.col(reply), fence_only))
        .withColumn("_json", R.braced(F.col("_clean")))
        .withColumn("_doc", R.whole_object(F.col("_json")))
        .withColumns({n: R.field_kind(F.col("_doc"), f) for n, f in zip(names, RECORD_FIELDS)})
        .withColumn("_bad", R.bad_fields([F.col(n) for n in names]))
    )
    reason = (
        F.when(F.col(reply).isNull(), "no reply")
        .when(F.col("_json").isNull(), "no JSON object in reply")
        .when(F.col("_doc").isNull(), "invalid JSON")
        .when(~R.is_object(F.col("_doc")), "JSON is not an object")
        .when(F.col("_bad") != "", F.concat(F.lit("not text: "), F.col("_bad")))
    )
    if earlier_error is not None:
        reason = F.coalesce(earlier_error, reason)
    fields = {f: F.when(F.col("error").isNull(), R.field_text(F.col("_doc"), f)) for f in RECORD_FIELDS}
    return staged.withColumn("error", reason).withColumns(fields).drop("_clean", "_json", "_doc", "_bad", *names)


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNull())


def rejected(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNotNull())
