"""What the operators share: column functions over Arrow arrays, words, written copies."""

from collections.abc import Callable, Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from vitaeflow.session import new_folder


def array_function(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str):
    """A column function computed on Arrow arrays; ``make`` runs once per task.

    Only the argument column goes to Python; Spark bounds its batches by bytes.
    Marked as not deterministic so that Catalyst evaluates it once per row
    instead of copying it into pushed filters.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            yield work(batch)

    return arrow_udf(run, returnType=returns).asNondeterministic()


def utf8(column: Column | str) -> Column:
    """The column's UTF-8 bytes, which Arrow hands over without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def write_down(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back from there."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts(record) -> tuple:
    """A data class's values, to broadcast: broadcasts are pickled plainly, which needs importable classes."""
    return tuple(getattr(record, field.name) for field in fields(record))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes: the bytes that are no continuation."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Numbering(dict):
    """Numbers keys as they come: 0, 1, 2, …"""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number
