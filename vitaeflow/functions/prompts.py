"""Prompts and request payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.fixed_values import (
    EXTRACTION_PROMPT,
    MAX_TOKENS,
    SUMMARY_PROMPT,
    SYSTEM_PROMPT,
    TEMPERATURE,
    TOP_P,
)


def extraction_prompt(text: Column, template: str = EXTRACTION_PROMPT) -> Column:
    """The template followed by the whole document text."""
    return F.concat(F.lit(template), text)


def summary_prompt(text: Column, template: tuple[str, str] = SUMMARY_PROMPT) -> Column:
    """The two halves of the template around a hit's text."""
    before, after = template
    return F.concat(F.lit(before), text, F.lit(after))


def _message(role: str, text: Column) -> Column:
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    return F.struct(F.lit(role).alias("role"), F.array(part).alias("content"))


def chat_request(
    prompt: Column,
    system: str = SYSTEM_PROMPT,
    temperature: float = TEMPERATURE,
    top_p: float = TOP_P,
    max_tokens: int = MAX_TOKENS,
) -> Column:
    """The JSON body of one chat request."""
    return F.to_json(
        F.struct(
            F.array(_message("system", F.lit(system)), _message("user", prompt)).alias("messages"),
            F.lit(temperature).alias("temperature"),
            F.lit(top_p).alias("top_p"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    )


def embedding_request(fragment: Column) -> Column:
    """The JSON body of one embedding request."""
    return F.to_json(F.struct(fragment.alias("input")))
