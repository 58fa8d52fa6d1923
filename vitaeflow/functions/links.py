"""Document link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.fixed_values import (
    DOCUMENT_FOLDER,
    DOCUMENT_SUFFIX,
    LINK_MISSING,
    LINK_PREFIX,
    LINK_SUFFIX,
)
from vitaeflow.functions.text import normal_key


def document_path(key: Column) -> Column:
    """Where the document of a key is stored, relative to the store."""
    return F.concat(F.lit(f"{DOCUMENT_FOLDER}/"), normal_key(key), F.lit(DOCUMENT_SUFFIX))


def key_in_path(path: Column) -> Column:
    """The normalised key a stored path was built from: its file name, unsuffixed."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def base64_text(content: Column) -> Column:
    return F.base64(content)


def data_link(content: Column) -> Column:
    """An anchor with the bytes inlined; the fallback text without bytes."""
    link = F.concat(F.lit(LINK_PREFIX), base64_text(content), F.lit(LINK_SUFFIX))
    return F.when(F.octet_length(content) > 0, link).otherwise(F.lit(LINK_MISSING))


def path_link(path: Column, length: Column) -> Column:
    """The stored path instead of the bytes, so that no content is read."""
    return F.when(length > 0, path).otherwise(F.lit(LINK_MISSING))
