"""Rows that every operator must take: nulls, empties, repeats, long texts, and columns named like results."""

CLASHING = ("n_words", "kept", "key", "m", "measured", "failures", "spans", "size", "shard", "slot", "number", "gone", "encoded",
            "ids", "n_pieces", "nbest", "node", "score", "block", "s", "component_id")
LONG = " ".join(f"word{i} né{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "Plain words, a few of them. token = \"0123456789abcdef\" and the rest"),
    (2, None), (3, ""), (4, " \n\t \x0b "), (None, "no id but words"), (None, None),
    (5, "the same row twice in this table"), (5, "the same row twice in this table"), (6, LONG), (7, "éß😀 ▁▁ \x00 \\ <|end|> {{ x }}"),
]


def documents(spark):
    """``doc_id, text`` beside columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.length("text").cast("bigint").alias("n_chars"),
                     *(F.lit("own").alias(name) for name in CLASHING))


def no_documents(spark):
    return documents(spark).limit(0)
