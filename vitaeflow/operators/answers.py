"""Answers to questions from their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.session import lookup_side


def hit_texts(hits: DataFrame, chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Hits with the text of their chunk; texts are read for the hits only."""
    texts = chunks.select(*keys, F.col(text).alias("text"))
    return texts.join(lookup_side(hits), keys)


def join_answers(answers: DataFrame, query_id: str = "query_id", answer: str = "answer",
                 order: str = "rank") -> DataFrame:
    """One text per question: each answer and a newline, joined by newlines in rank order."""
    part = F.expr(f"listagg(concat(`{answer}`, '\\n'), '\\n') WITHIN GROUP (ORDER BY `{order}`)")
    return answers.groupBy(query_id).agg(part.alias("answer_text"))
