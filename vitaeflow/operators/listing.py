"""Stored documents and the candidate listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.fixed_values import LINK_MISSING, RECORD_KEY
from vitaeflow.functions.links import data_link, key_in_path, path_link
from vitaeflow.functions.text import normal_key, valid_key
from vitaeflow.operators.prefilter import may_match
from vitaeflow.session import configure, is_small, lookup_side


def stored_under_key(files: DataFrame) -> DataFrame:
    """Add the key each stored file is named after (``run_norm``)."""
    return files.withColumn("run_norm", key_in_path(F.col("path")))


def put_documents(
    documents: DataFrame, key: str, stamp: list[str], content: str = "content"
) -> DataFrame:
    """One document per normalised key, the last one by ``stamp``; unusable keys are left out.

    The winner is picked without its content: only key and stamp take part in
    the aggregation, and contents stay in place until the winners are known.
    ``stamp`` must identify a row within its key.
    """
    usable = documents.where(valid_key(F.col(f"`{key}`"))).withColumn("run_norm", normal_key(F.col(f"`{key}`")))
    winners = last_documents(documents, key, stamp)
    rest = [c for c in documents.columns if c not in (key, content, *stamp)]
    return usable.join(lookup_side(winners), ["run_norm", *stamp], "left_semi").select(
        "run_norm", *stamp, *rest, content
    )


def last_documents(documents: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """``(run_norm, *stamp)`` of the last document of each normalised key."""
    usable = documents.where(valid_key(F.col(f"`{key}`"))).withColumn("run_norm", normal_key(F.col(f"`{key}`")))
    last = usable.groupBy("run_norm").agg(F.max(F.struct(*stamp)).alias("_last"))
    return last.select("run_norm", *[F.col("_last")[c].alias(c) for c in stamp])


def _wanted(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored documents under ``keys (run_norm)``.

    For a list that measures small the others drop out where they are, before contents move. For a long one
    a bitmap of its keys drops nearly all of them there; the few that are left meet the join that follows.
    """
    distinct = keys.distinct()
    if is_small(distinct):
        return stored.join(F.broadcast(distinct), "run_norm", "left_semi")
    return may_match(stored, distinct, "run_norm")


def fetch_documents(keys: DataFrame, stored: DataFrame, key: str = RECORD_KEY) -> DataFrame:
    """Add the stored bytes of each key; null where there is none.

    Null keys, which may be many, stay out of the join.
    """
    wanted = keys.withColumn("run_norm", normal_key(F.col(f"`{key}`")))
    named = wanted.where(F.col("run_norm").isNotNull())
    held = _wanted(stored.select("run_norm", "content"), named.select("run_norm"))
    found = named.join(held, "run_norm", "left")
    without = wanted.where(F.col("run_norm").isNull()).withColumn("content", F.lit(None).cast("binary"))
    return found.unionByName(without)


def candidate_listing(
    candidates: DataFrame,
    stored: DataFrame,
    key: str = RECORD_KEY,
    mode: str = "path",
    link_column: str = "Ver PDF",
) -> DataFrame:
    """Candidates with a link to their document: one join for the whole table.

    ``path`` links the stored path and reads no content; ``data_uri`` inlines the bytes of the listed
    candidates' documents. ``stored`` has one row per ``run_norm`` (see ``put_documents``).
    Rows with unusable keys, which may be many and equal, bypass the join:
    documents are never stored under such keys.
    """
    configure(candidates.sparkSession)
    if mode not in ("data_uri", "path"):
        raise ValueError(f"unknown link mode: {mode}")
    usable = valid_key(F.col(f"`{key}`"))
    listed = candidates.where(usable).withColumn("_norm", normal_key(F.col(f"`{key}`")))
    unlisted = candidates.where(~usable).withColumn(link_column, F.lit(LINK_MISSING))
    if mode == "path":
        documents = stored.select(
            F.col("run_norm").alias("_norm"), F.col("path").alias("_path"), F.col("length").alias("_length")
        )
        link = path_link(F.col("_path"), F.col("_length"))
    else:
        held = _wanted(stored.select("run_norm", "content"), listed.select(F.col("_norm").alias("run_norm")))
        documents = held.select(F.col("run_norm").alias("_norm"), F.col("content").alias("_content"))
        link = data_link(F.col("_content"))
    joined = listed.join(documents, "_norm", "left").withColumn(link_column, link)
    columns = [F.col(f"`{c}`") for c in [*candidates.columns, link_column]]
    return joined.select(*columns).unionByName(unlisted.select(*columns))


def listing_in_place(candidates, stored, link_column: str = "Ver PDF") -> DataFrame:
    """The listing by path of two ``ColocatedTable``, where nothing moves but what hot keys need.

    ``candidates`` is laid out by what ``by_normal_key`` adds, and ``stored`` (``run_norm, path, length``, one row a
    key) by ``run_norm``. Rows with unusable keys, which have a null one there, lie apart.
    """
    joined = candidates.joined(stored, "left").withColumn(link_column, path_link(F.col("path"), F.col("length")))
    return joined.drop(candidates.key, "path", "length")


def by_normal_key(candidates: DataFrame, key: str = RECORD_KEY) -> DataFrame:
    """``candidates`` with ``run_norm``, the normalised key, null where the key is unusable."""
    return candidates.withColumn("run_norm", F.when(valid_key(F.col(f"`{key}`")), normal_key(F.col(f"`{key}`"))))
