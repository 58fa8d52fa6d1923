"""Documents: pages, assembled text, blank documents, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaeflow.functions.text import fixed_chunks, has_text
from vitaeflow.session import cut_lineage, lookup_side

#: ``extract(content) -> page texts``; supplied by the user (any PDF reader).
PageExtractor = Callable[[bytes], list[str]]

#: Bits of a page's number that tell pages of one block apart, in ``chunk_pages``.
BLOCK_BITS = 10

_PAGES = T.StructType(
    [
        T.StructField("pages", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def read_pages(files: DataFrame, extract: PageExtractor, content: str = "content") -> DataFrame:
    """Add ``pages ARRAY<STRING>`` and ``error`` to a table with file contents.

    The extractor sees one file at a time; a file it fails on keeps its row
    with the reason. Only the content column travels to Python, in batches.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas

        for batch in batches:
            pages, errors = [], []
            for data in batch:
                try:
                    if data is None:
                        raise ValueError("no content")
                    found = extract(bytes(data))
                    if isinstance(found, (str, bytes, dict)):
                        raise ValueError(f"{type(found).__name__} instead of a list of pages")
                    pages.append(["" if text is None else str(text) for text in found])
                    errors.append(None)
                except Exception as problem:  # one bad file must not end the job
                    pages.append(None)
                    errors.append(f"unreadable document: {problem}")
            yield pandas.DataFrame({"pages": pages, "error": errors})

    extractor = F.pandas_udf(run, _PAGES).asNondeterministic()
    return (
        files.withColumn("_read", extractor(F.col(content)))
        .withColumn("pages", F.col("_read.pages"))
        .withColumn("error", F.col("_read.error"))
        .drop("_read")
    )


def pages_text(pages: Column) -> Column:
    """The text of a document from its pages in order, each followed by a newline.

    Needs no shuffle: the pages of a file come out of one task.
    """
    texts = F.transform(pages, lambda text: F.coalesce(text, F.lit("")))
    return F.when(F.size(texts) > 0, F.concat(F.array_join(texts, "\n"), F.lit("\n"))).otherwise(
        F.when(pages.isNotNull(), F.lit(""))
    )


def split_pages(documents: DataFrame, key: str, text: str = "text", separator: str = "\f") -> DataFrame:
    """Page rows ``(key, page_no, text)`` of texts that mark their page breaks."""
    parts = F.split(F.col(text), _literal_pattern(separator), -1)
    return documents.select(F.col(key), F.posexplode(parts).alias("page_no", "text"))


def _literal_pattern(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def assemble(
    pages: DataFrame, key: str = "doc_key", order: str = "page_no", text: str = "text"
) -> DataFrame:
    """One row ``(key, text, n_pages)`` per document from page rows.

    ``listagg`` combines on the map side before the one shuffle on the key.
    What a task holds for a document is that document's text, the cell it
    returns. Null page texts count as empty.
    """
    page = F.coalesce(F.col(text), F.lit(""))
    joined = F.expr(f"listagg(_page, '\\n') WITHIN GROUP (ORDER BY `{order}`)")
    return (
        pages.select(key, order, page.alias("_page"))
        .groupBy(key)
        .agg(F.concat(joined, F.lit("\n")).alias("text"), F.count(F.lit(1)).alias("n_pages"))
    )


def mark_blank(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``reject_reason`` for documents without any text."""
    reason = F.when(~has_text(F.col(text)), F.lit("document has no text"))
    return documents.withColumn("reject_reason", reason)


def chunk(documents: DataFrame, key: str, size: int | None = None, text: str = "text") -> DataFrame:
    """Chunk rows ``(key, chunk_no, text)``: fixed size, no overlap."""
    pieces = fixed_chunks(F.col(text), size)
    return documents.select(F.col(key), F.posexplode(pieces).alias("chunk_no", "text"))


def chunk_pages(pages: DataFrame, key: str = "doc_key", size: int | None = None, order: str = "page_no", text: str = "text",
                block_bits: int = BLOCK_BITS) -> DataFrame:
    """``chunk`` of the assembled documents, from page rows, without assembling them.

    Every page is followed by a newline; null page texts count as empty. Where a page begins in its
    document is a prefix sum in two levels: of the pages in a block of consecutive numbers, then of the
    blocks. A document of any number of pages is so spread over tasks, and no cell holds more than a page
    or a chunk. Pages are cut where chunks begin. A chunk that lies inside one page is done; only the
    pieces of the others move once more, to be joined.

    ``order`` is a whole number. Among pages that share one, texts come in their own order; null numbers come
    first (both meet in one task, as they have no order that could divide them). A null key is a key like others. ``size`` must be given, as a whole document is one cell.
    """
    if size is None or size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    if not isinstance(pages.schema[order].dataType, T.IntegralType):
        raise ValueError(f"page numbers must be whole numbers, {order} is not")
    rows = pages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").cast("bigint").alias("number"),
        F.shiftright(F.col(f"`{order}`").cast("bigint"), block_bits).alias("block"),
        F.concat(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("\n")).alias("text"))
    # lengths are summed per block before they move; a document of one block needs no look-up
    blocks = rows.groupBy("key", "block").agg(F.sum(F.length("text")).alias("n"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.withColumn("base", F.sum("n").over(before)).where("base IS NOT NULL").select(
        F.col("key").alias("_key"), F.col("block").alias("_block"), "base")
    inside = Window.partitionBy("key", "block").orderBy("number", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum(F.length("text")).over(inside), F.lit(0)))
    met = F.col("key").eqNullSafe(F.col("_key")) & F.col("block").eqNullSafe(F.col("_block"))
    placed = placed.join(lookup_side(cut_lineage(bases)), met, "left")
    start = F.coalesce("base", F.lit(0)) + F.col("within")
    # the rest of the chunk that is open where the page begins, then whole chunks
    open_ = F.when(start % size > 0, F.lit(size) - start % size).otherwise(0).cast("int")
    head = F.when(open_ > 0, F.array(F.substring(F.col("text"), F.lit(1), open_))).otherwise(F.array().cast("array<string>"))
    cut = placed.select("key", start.alias("start"), F.concat(
        head, fixed_chunks(F.substring(F.col("text"), open_ + 1, F.length("text")), size)).alias("pieces"))
    # of a chunk's pieces, the one that begins it (only a page's first piece can begin elsewhere) comes first
    pieces = cut.select("key", "start", F.posexplode("pieces").alias("at", "piece")).select(
        "key", (F.floor(F.col("start") / size).cast("bigint") + F.col("at")).cast("int").alias("chunk_no"),
        F.when(F.col("at") == 0, F.col("start")).otherwise(-1).alias("start"), "piece")
    pieces = cut_lineage(pieces)
    whole = F.length("piece") == size
    joined = pieces.where(~whole).groupBy("key", "chunk_no").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY start)").alias("text"))
    done = pieces.where(whole).select("key", "chunk_no", F.col("piece").alias("text")).unionByName(joined)
    return done.select(F.col("key").alias(key), "chunk_no", "text")
