"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Results depend on these two; both are session (runtime) settings.
_RESULT_SETTINGS = {
    # duplicate JSON names: the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # base64 text without line breaks
    "spark.sql.chunkBase64String.enabled": "false",
}

#: Largest measured side that operators put a broadcast hint on.
BROADCAST_BYTES = 64 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on; safe to call repeatedly."""
    for name, value in _RESULT_SETTINGS.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Where it is unset, a cluster takes a folder of the warehouse,
    which all executors see too; a local session, whose executors are this machine, a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="vitaeflow-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vitaeflow"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of copies that are removed when the innermost ``copies_removed`` ends.
_COPIES: ContextVar[list[str] | None] = ContextVar("copies", default=None)


@contextmanager
def copies_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the copies that ``cut_lineage`` makes inside, at the end; results must have been used by then."""
    made: list[str] = []
    token = _COPIES.set(made)
    try:
        yield
    finally:
        _COPIES.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the copy, in ``spark`` if given.

    Used after model calls, so that neither a lost executor nor a second use
    repeats them. A parquet copy keeps column pruning and gives Catalyst sizes. Copies are read few times: they are packed tightly.
    """
    folder = new_folder(df.sparkSession, "copy")
    if (made := _COPIES.get()) is not None:
        made.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(folder)


def measured_bytes(df: DataFrame) -> int:
    """Bytes held by the string, binary and array cells of ``df`` plus 8 per other cell.

    One distributed aggregation with a one-row result.
    """
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind == "array" and field.dataType.elementType.typeName() in ("float", "double", "integer", "long"):
            size = size + 8 * F.coalesce(F.size(column), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + 8
    # 16 bytes per row for the row itself
    return df.agg(F.coalesce(F.sum(size + 16), F.lit(0)).alias("bytes")).first()["bytes"]


def is_small(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_BYTES


def lookup_side(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is looked up.

    Broadcast if it measures at most ``BROADCAST_BYTES``. Else it is written
    down: the join then has a plain shuffle on either side, which is what
    adaptive execution needs to split the other side's hot keys. An aggregate
    or join feeding it directly would prevent that.
    """
    return F.broadcast(df) if is_small(df) else cut_lineage(df)
