"""Document files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.fixed_values import SOURCE_NAME
from vitaeflow.schema import BINARY_FILES

_GLOB = "*.[pP][dD][fF]"


def named(files: DataFrame) -> DataFrame:
    """Add the name of each file as it is; the one in Spark's metadata has blanks and accents escaped."""
    return files.withColumn(SOURCE_NAME, F.substring_index("path", "/", -1))


def document_files(spark: SparkSession, path: str, glob: str = _GLOB, recursive: bool = True) -> DataFrame:
    """All document files under ``path`` with their bytes.

    Contents are read only by jobs that use them: selecting names and sizes
    reads no file.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return named(files)


def pack_documents(spark: SparkSession, folders: list[str], target: str, glob: str = _GLOB) -> DataFrame:
    """Pack the files of ``folders`` into one table of paths and contents, folder by folder.

    Listing happens on the driver, so a very large inbox is packed by its sub-folders (the letters of
    a name, the days of arrival), each of which the driver can list; later jobs read the table and
    list nothing. Each folder fills a part of its own, which packing it again replaces.
    """
    for folder in folders:
        part = hashlib.sha256(folder.encode()).hexdigest()[:32]
        document_files(spark, folder, glob).write.mode("overwrite").parquet(f"{target}/folder={part}")
    return spark.read.parquet(target).drop("folder")


def document_file_stream(spark: SparkSession, path: str, glob: str = _GLOB, files_per_batch: int = 1000,
                         max_file_age: str = "36500d") -> DataFrame:
    """Files that arrive under ``path``, each once.

    A file counts as seen by its path: one that is overwritten is not read again, so an update needs a
    new name or folder. Files older than ``max_file_age`` before the newest are passed over; Spark's
    own default would be a week.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILES)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", max_file_age)
        .load(path)
    )
    return named(files)


def read_candidates(spark: SparkSession, source: str, format: str | None = None, **options: str) -> DataFrame:
    """A candidate table by catalog name, or from any Spark source.

    ``read_candidates(spark, "candidates")`` reads a table,
    ``read_candidates(spark, path, "parquet")`` files, and
    ``read_candidates(spark, "schema.table", "jdbc", url=...)`` a database.
    """
    if format is None:
        return spark.table(source)
    if format == "jdbc":
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    return spark.read.format(format).options(**options).load(source)
