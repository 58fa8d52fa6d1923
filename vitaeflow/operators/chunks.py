"""The chunk collection: keys, deletes and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.session import lookup_side


def keys_of(chunks: DataFrame, key: str = "RUN", limit: int | None = None) -> DataFrame:
    """Distinct keys of a collection; all of them unless ``limit`` is given."""
    keys = chunks.select(key).distinct()
    return keys if limit is None else keys.orderBy(key).limit(limit)


def rows_of_key(chunks: DataFrame, value: object, key: str = "RUN") -> DataFrame:
    """Rows of one key; the comparison reaches the scan as a pushed filter."""
    return chunks.where(F.col(key) == F.lit(value))


def without_keys(chunks: DataFrame, keys: DataFrame, key: str = "RUN") -> DataFrame:
    """The collection without the rows of the given keys; unknown keys are no error."""
    gone = keys.select(key).distinct()
    return chunks.join(lookup_side(gone), key, "left_anti")


def refresh(chunks: DataFrame, fresh: DataFrame, keys: DataFrame, key: str = "RUN") -> DataFrame:
    """Replace the rows of ``keys`` by their rows in ``fresh``.

    Rows of other keys stay as they are, whatever ``fresh`` holds for them.
    """
    changed = lookup_side(keys.select(key).distinct())
    kept = chunks.join(changed, key, "left_anti")
    new = fresh.join(changed, key, "left_semi")
    return kept.unionByName(new.select(*chunks.columns))
