"""Text, key and chunk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.fixed_values import KEY_PUNCTUATION, MISSING_KEYS, WHITESPACE


def strip(text: Column) -> Column:
    """Trim what Python trims. ``btrim`` only walks the two ends, so it stays
    linear on texts with long inner runs of blanks, where ``\\s+$`` does not."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """False for null, empty and all-blank texts."""
    return F.coalesce(strip(text) != "", F.lit(False))


def valid_key(key: Column) -> Column:
    """False for null keys and for the ones that mean "not given"."""
    return F.coalesce(~F.lower(strip(key)).isin(*MISSING_KEYS), F.lit(False))


def normal_key(key: Column) -> Column:
    """The key as it appears in the name of a stored document."""
    return F.translate(key, KEY_PUNCTUATION, "")


def fixed_chunks(text: Column, size: int | None) -> Column:
    """Cut ``text`` into pieces of ``size`` code points, the last one shorter.

    ``None`` keeps the text whole; an empty or null text gives no piece. One
    regular-expression pass is linear in the text; a ``substring`` per piece
    would walk from the start of the text every time.
    """
    if size is None:
        return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def key_bucket(key: Column, buckets: int) -> Column:
    """The bucket a key is stored in; the same for every table and job."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
