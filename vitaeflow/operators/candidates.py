"""Candidate records: review, key checks, merge and change keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.fixed_values import RECORD_KEY
from vitaeflow.functions.text import normal_key, valid_key
from vitaeflow.session import is_small, lookup_side


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def split_by_key(records: DataFrame, key: str = RECORD_KEY) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable key, and the rest."""
    ok = valid_key(_q(key))
    return records.where(ok), records.where(~ok)


def with_normal_key(records: DataFrame, key: str = RECORD_KEY, column: str = "run_norm") -> DataFrame:
    return records.withColumn(column, normal_key(_q(key)))


def grid(
    records: DataFrame,
    where: Column | None = None,
    order_by: list[Column | str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort and page a table for review."""
    if where is not None:
        records = records.where(where)
    if order_by:
        records = records.orderBy(*order_by)
    return records if limit is None else records.limit(limit)


def apply_corrections(records: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Reviewed cells replace extracted ones where they are not null.

    ``corrections`` holds one row per key with any of the record's columns.
    A column ``new_<key>``, if present, corrects the key itself.
    """
    edited = [c for c in records.columns if c in corrections.columns and c != key]
    renamed = corrections.select(
        _q(key).alias("_key"),
        *[_q(c).alias(f"_new_{c}") for c in edited],
        *([_q(f"new_{key}").alias("_new_key")] if f"new_{key}" in corrections.columns else []),
    )
    joined = records.join(lookup_side(renamed), _q(key) == F.col("_key"), "left")

    def cell(name: str) -> Column:
        if name in edited:
            return F.coalesce(_q(f"_new_{name}"), _q(name)).alias(name)
        if name == key and "_new_key" in renamed.columns:
            return F.coalesce(F.col("_new_key"), _q(name)).alias(name)
        return _q(name)

    return joined.select(*[cell(c) for c in records.columns])


def latest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``.

    A maximum over structs, not a window: it combines on the map side, so a
    key with very many rows arrives at its reducer as one row per map task.
    The remaining columns break ties, which makes the choice repeatable.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    last = F.max(F.struct(*[_q(c) for c in [*order, *rest]])).alias("_last")
    return (
        rows.groupBy(_q(key).alias(key))
        .agg(last)
        .select(_q(key), *[F.col("_last")[c].alias(c) for c in rows.columns if c != key])
    )


def merge(
    target: DataFrame,
    staging: DataFrame,
    key: str = RECORD_KEY,
    order: tuple[str, ...] = ("ingest_ts", "pdf_name", "path"),
    only_changed: bool = False,
) -> DataFrame:
    """The target after the merge, with ``action``: NEW, UPDATED or KEPT.

    The last staged row of a key wins and overwrites the target's row; target
    rows without a staged row are kept. With ``only_changed`` an identical
    staged row counts as KEPT. ``target`` has one row per key.

    A staged side that measures small is broadcast twice (lookup and key
    check) and the target is never shuffled; otherwise one full outer join
    shuffles both sides on the key.
    """
    columns = target.columns
    values = [c for c in columns if c != key]
    order_columns = [c for c in order if c in staging.columns]
    last = latest_rows(staging.where(_q(key).isNotNull()), key, order_columns)
    incoming = last.select(
        _q(key).alias("_key"), *[_q(c).alias(f"_in_{c}") for c in values], F.lit(True).alias("_staged")
    )

    differs = F.lit(False)
    for c in values:
        differs = differs | ~_q(c).eqNullSafe(_q(f"_in_{c}"))
    matched = F.lit("UPDATED") if not only_changed else F.when(differs, "UPDATED").otherwise("KEPT")

    # what is staged bounds what is left of it
    if not is_small(staging.select(*[_q(c) for c in columns])):
        # nothing staged has a null key; those of the target may be many and would meet in one task
        named, unnamed = target.where(_q(key).isNotNull()), target.where(_q(key).isNull())
        joined = named.withColumn("_held", F.lit(True)).join(incoming, _q(key) == F.col("_key"), "full_outer")
        staged, held = F.col("_staged").isNotNull(), F.col("_held").isNotNull()
        action = F.when(staged & ~held, "NEW").when(staged, matched).otherwise("KEPT")
        return joined.select(
            F.coalesce(_q(key), F.col("_key")).alias(key),
            *[F.when(staged, _q(f"_in_{c}")).otherwise(_q(c)).alias(c) for c in values],
            action.alias("action"),
        ).select(*[_q(c) for c in columns], "action").unionByName(unnamed.withColumn("action", F.lit("KEPT")))

    looked_up = target.join(F.broadcast(incoming), _q(key) == F.col("_key"), "left")
    staged = F.col("_staged").isNotNull()
    old = looked_up.select(
        _q(key),
        *[F.when(staged, _q(f"_in_{c}")).otherwise(_q(c)).alias(c) for c in values],
        F.when(staged, matched).otherwise("KEPT").alias("action"),
    )
    known = target.select(_q(key).alias("_key")).join(F.broadcast(incoming.select("_key")), "_key", "left_semi")
    new = incoming.join(known, "_key", "left_anti").select(
        F.col("_key").alias(key), *[_q(f"_in_{c}").alias(c) for c in values], F.lit("NEW").alias("action")
    )
    both = [*[_q(c) for c in columns], F.col("action")]
    return old.select(*both).unionByName(new.select(*both))


def changes(merged: DataFrame, key: str = RECORD_KEY) -> DataFrame:
    """``(RUN, action)`` of the keys a merge inserted or updated, one row each, as a merge has."""
    return merged.where(F.col("action").isin("NEW", "UPDATED")).select(_q(key).alias("RUN"), "action")


def inserted(changed: DataFrame) -> DataFrame:
    return changed.where(F.col("action") == "NEW")


def updated(changed: DataFrame) -> DataFrame:
    return changed.where(F.col("action") == "UPDATED")


def with_changed_key(rows: DataFrame, changed: DataFrame, key: str = "RUN") -> DataFrame:
    """Rows whose key a merge inserted or updated."""
    keys = changed.select(F.col("RUN").alias(key)).distinct()
    return rows.join(lookup_side(keys), key, "left_semi")


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))
