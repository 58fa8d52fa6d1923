"""From a model's reply text to a checked record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.fixed_values import FENCE_CHARACTER, FENCE_TAG, FIELD_DEFAULT, RECORD_FIELDS
from vitaeflow.functions.text import strip


def trim_fence(reply: Column) -> Column:
    """Drop back-ticks from both ends."""
    return F.btrim(reply, F.lit(FENCE_CHARACTER))


def drop_tag(reply: Column, fence_only: bool = False) -> Column:
    """Drop the language tag of a code fence.

    By default every occurrence goes, even inside values; ``fence_only`` drops
    just one that opens the text.
    """
    if fence_only:
        return F.regexp_replace(reply, rf"^\s*{FENCE_TAG}\b", "")
    return F.replace(reply, F.lit(FENCE_TAG), F.lit(""))


def clean_reply(reply: Column, fence_only: bool = False) -> Column:
    return strip(drop_tag(trim_fence(reply), fence_only))


def braced(text: Column) -> Column:
    """The text from its first ``{`` to its last ``}``.

    Null when either is missing, empty when they are in the wrong order. Both
    positions come from one linear scan each.
    """
    first = F.instr(text, "{")
    last = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((first > 0) & (last > 0), F.substring(text, first, last - first + 1))


def whole_object(text: Column) -> Column:
    """``text`` as a variant under the name ``r`` if it is exactly one JSON value.

    JSON parsers on the JVM stop after the first value. Wrapping the text as
    an object member rejects anything that cannot follow a member, wrapping it
    as an array element anything that cannot follow an element; no trailing
    text satisfies both.
    """
    member = F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}")))
    element = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(element.isNotNull(), member)


def is_object(document: Column) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(document, "$.r", "variant"))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def field_kind(document: Column, name: str) -> Column:
    """Type name of a field: null when absent, ``VOID`` for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.r['{name}']", "variant"))


def field_text(document: Column, name: str) -> Column:
    """The field, or the default when it is absent."""
    return F.coalesce(F.try_variant_get(document, f"$.r['{name}']", "string"), F.lit(FIELD_DEFAULT))


def bad_fields(kinds: list[Column]) -> Column:
    """Names of the fields that are present but not text, joined; empty if none."""
    # concat_ws skips nulls and, unlike a filter over an array, is compiled
    wrong = [F.when(kind != "STRING", F.lit(name)) for kind, name in zip(kinds, RECORD_FIELDS)]
    return F.concat_ws(", ", *wrong)
