"""From raw documents to training pieces: rules, near-dedup, decontamination, secrets, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again for the next one. All
but the last return the columns of ``docs``; rows without a ``doc_id`` and
columns of any name come along. Empty tables pass through.
"""

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitaeflow.llm import minhash_join, piece_lattice, positional_index, quality_rules, secret_scan  # noqa: E402
from vitaeflow.llm.common import free_name, table, write_down  # noqa: E402
from vitaeflow.llm.registered import piece_model  # noqa: E402
from vitaeflow.session import configure  # noqa: E402

#: Percent of similarity from which the near-dedup stage links texts; the op5 query has its own.
NEAR = 80


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the production policy go."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five words and similarity 0.8 or more, the smallest ``doc_id`` stays."""
    return minhash_join.keep_one(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return positional_index.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; no document goes."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids, with the N best segmentations as edits of them, beside the documents' other columns."""
    shared = piece_lattice.shared_pieces(spark, piece_model())
    name = free_name(docs, "encoded")
    coded = piece_lattice.encode(docs, shared, name=name)
    added = {"n_pieces": F.coalesce(F.size(f"`{name}`.ids"), F.lit(0)).cast("bigint"), "ids": F.col(f"`{name}`.ids"),
             "nbest": F.col(f"`{name}`.nbest")}
    return coded.select(*(F.col(f"`{c}`") for c in docs.columns if c != "text"),
                        *(value.alias(free_name(docs, column)) for column, value in added.items()))


STAGES = [
    ("quality_rules", apply_rules),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode),
]

#: Near copies by MinHash and the N best segmentations are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_down(stage(spark, docs, sf_dir), name)
    return docs
