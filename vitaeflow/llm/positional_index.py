"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a row of it is a block of whole documents, with
the block's terms and their sorted positions. Building it and searching it
move nothing between tasks, and a frequent term is long only inside blocks of
bounded size. It is written once and serves any number of test sets.

A query is a sequence of terms. In a block that has all of them, the lists are
intersected from the rarest term on, each shifted by the term's place: what is
left are the exact phrases. With ``slop``, a term may stand that many words
away from its place: there is a match where a run of as many words as the query
lies in a document and every term stands in that document within ``slop`` of its
place in the run. Neither blocks nor the order of intersection decide that.

Test items are the stated query set. Equal texts are one query. They are read in
groups of about ``QUERY_BYTES``, each broadcast, run against all blocks and
dropped before the next; what several groups find is written down and joined.

Defined cases: null and empty texts have no words, and are returned with
zeros. An item without words matches nothing; a null ``item_id`` counts as an
item called ``null``; items that share an id are one. Repeated documents are
answered each for itself. Empty tables give no rows or no matches. A document
is never cut, so a block is as long as its longest document at least.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import Numbering, free_name, parts, utf8, write_down
from vitaeflow.session import lookup_side, new_folder

#: Words of a block, unless one document has more.
BLOCK_WORDS = 1 << 18
#: Bytes of item text that are compiled and broadcast at once.
QUERY_BYTES = 8 * 1024 * 1024
WINDOW = 13

_INDEX = ("block bigint, doc_ids array<bigint>, ends array<int>, terms array<binary>, counts array<int>, gaps binary")

# Words are runs of digits, letters a-z and anything beyond ASCII, after A-Z became a-z.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


# --- the index -----------------------------------------------------------------


class _Block:
    """Documents gathered until their words fill a block."""

    def __init__(self):
        self.doc_ids, self.ends, self.numbers, self.codes, self.size = [], [], Numbering(), [], 0

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        words = words_of(data) if data else []
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)
        self.doc_ids.append(doc_id)
        self.ends.append(self.size)

    def row(self, block: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.numbers)).astype(np.int32)
        # one sort of term and position; within a term, positions become gaps
        key = np.sort(codes << 32 | np.arange(self.size))
        gaps = np.diff(key & 0xFFFFFFFF, prepend=0).astype(np.int32)
        first = np.cumsum(counts) - counts
        gaps[first] = (key & 0xFFFFFFFF)[first]
        return pa.record_batch(
            [pa.array([block], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())),
             pa.array([self.ends], pa.list_(pa.int32())), pa.array([list(self.numbers)], pa.list_(pa.binary())),
             pa.array([counts], pa.list_(pa.int32())), pa.array([gaps.tobytes()], pa.binary())],
            names=["block", "doc_ids", "ends", "terms", "counts", "gaps"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block.add(doc_id, data)
            if block.size >= BLOCK_WORDS or len(block.ends) >= BLOCK_WORDS:
                yield block.row(made)
                made, block = made + 1, _Block()
    if block.ends:
        yield block.row(made)


def build(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Write the index of ``docs`` to ``path`` (by default in the shared folder) and return it; no shuffle."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "postings")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(f"`{text}`").alias("text"))
    rows.mapInArrow(_indexed, _INDEX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


# --- queries ---------------------------------------------------------------------


@dataclass(frozen=True)
class Queries:
    """Different term sequences, padded with -1, the length of each, the texts it is from, and the items of each text."""

    terms: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    texts: list[tuple[int, ...]]
    names: list[tuple[str, ...]]


def windows_of(words: list, size: int) -> list[tuple]:
    """All runs of ``size`` words; a shorter sequence is one run, an empty one none."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return list(zip(*(words[k : len(words) - size + 1 + k] for k in range(size))))


def compile_queries(items: list[tuple[tuple[str, ...], bytes]], size: int = WINDOW) -> Queries:
    """From different texts, each with the names of its items."""
    terms: Numbering = Numbering()
    owners: dict[tuple, set[int]] = {}
    for number, (_, data) in enumerate(items):
        for window in windows_of([terms[w] for w in words_of(data)], size):
            owners.setdefault(window, set()).add(number)
    windows = np.full((len(owners), size), -1, np.int64)
    for i, window in enumerate(owners):
        windows[i, : len(window)] = window
    return Queries(dict(terms), windows, (windows >= 0).sum(1), [tuple(o) for o in owners.values()], [names for names, _ in items])


def query_groups(benchmark: DataFrame, size: int = WINDOW) -> tuple[int, Iterator[Queries]]:
    """How many groups there are, and the different texts of ``benchmark`` compiled in groups, dealt by a hash of the text."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), utf8("text").alias("text"))
    rows = write_down(rows.where("text IS NOT NULL").groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items")), "queries")
    held = F.octet_length("text") + F.size("items") * 16
    total = rows.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    groups = max(1, -(-total // QUERY_BYTES))

    def compiled() -> Iterator[Queries]:
        for g in range(groups):
            part = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)
            yield compile_queries([(tuple(r["items"]), bytes(r["text"])) for r in part.toLocalIterator()], size)

    return groups, compiled()


# --- search ------------------------------------------------------------------------


def occurrences(lists: list[np.ndarray], ends: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where a sequence begins, and in which document; ``lists[k]`` has the sorted positions of its ``k``-th term.

    ``ends`` are the documents' ends in the block.
    """
    n, starts = len(lists), np.concatenate([[0], ends[:-1]])
    order = sorted(range(n), key=lambda k: len(lists[k]))
    found = lists[order[0]] - order[0]
    if slop:
        found = np.unique(found[:, None] + np.arange(-slop, slop + 1))
    else:
        for k in order[1:]:
            if not len(found):
                break
            at = np.searchsorted(lists[k], found + k)
            found = found[(at < len(lists[k])) & (lists[k][np.minimum(at, len(lists[k]) - 1)] == found + k)]
    found = found[(found >= 0) & (found + n <= (ends[-1] if len(ends) else 0))]
    doc = np.searchsorted(ends, found, side="right")
    inside = found + n <= ends[doc]
    found, doc = found[inside], doc[inside]
    for k in order if slop else ():
        low, high = np.maximum(found + (k - slop), starts[doc]), np.minimum(found + (k + slop), ends[doc] - 1)
        at = np.searchsorted(lists[k], low)
        near = (at < len(lists[k])) & (lists[k][np.minimum(at, len(lists[k]) - 1)] <= high)
        found, doc = found[near], doc[near]
    return found, doc


def _search_block(queries: Queries, ends: np.ndarray, terms: list[bytes], counts: np.ndarray, gaps: np.ndarray, slop: int):
    """``(document, start, end, query)`` arrays of the matches in a block."""
    here = np.full(len(queries.terms) + 1, -1, np.int64)  # the last stands for the padding
    for place, term in enumerate(terms):
        if (number := queries.terms.get(term)) is not None:
            here[number] = place
    present = (here[queries.windows] >= 0) | (queries.windows < 0)
    candidates = np.flatnonzero(present.all(1))
    first = np.cumsum(counts) - counts
    positions: dict[int, np.ndarray] = {}

    def positions_of(place: int) -> np.ndarray:
        if place not in positions:
            positions[place] = np.cumsum(gaps[first[place] : first[place] + counts[place]], dtype=np.int64)
        return positions[place]

    starts = np.concatenate([[0], ends[:-1]])
    found = []
    for q in candidates:
        length = queries.lengths[q]
        at, doc = occurrences([positions_of(here[t]) for t in queries.windows[q, :length]], ends, slop)
        if len(at):
            at = at - starts[doc]
            found.append((doc, at, at + length, np.full(len(doc), q)))
    return [np.concatenate(c) for c in zip(*found)] if found else None


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined where they touch."""
    made: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if made and a <= made[-1][1]:
            made[-1][1] = max(made[-1][1], b)
        else:
            made.append([a, b])
    return [(a, b) for a, b in made]


_FOUND = ("block bigint, nth int, doc_id bigint, n_words bigint, spans array<struct<start: int, end: int>>, "
          "items array<string>")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(index: DataFrame, shared, slop: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in ("block", "doc_ids", "ends", "terms", "counts", "gaps")}
                ends = cell["ends"].values.to_numpy()
                n = len(ends)
                matches = _search_block(asked, ends, cell["terms"].values.to_pylist(), cell["counts"].values.to_numpy(),
                                        np.frombuffer(cell["gaps"].as_buffer(), np.int32), slop)
                spans: list[list] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                if matches:
                    order = np.argsort(matches[0], kind="stable")
                    doc, start, end, query = (m[order] for m in matches)
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    for d, a, b, q in zip(doc[np.concatenate([[0], cuts])], *(np.split(m, cuts) for m in (start, end, query))):
                        spans[d] = [{"start": x, "end": y} for x, y in _merged(a, b)]
                        texts = {text for k in set(q.tolist()) for text in asked.texts[k]}
                        items[d] = sorted({name for text in texts for name in asked.names[text]})
                yield pa.record_batch(
                    [pa.array([cell["block"].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     cell["doc_ids"].values, pa.array(np.diff(ends, prepend=0), pa.int64()),
                     pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=["block", "nth", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(run, _FOUND)


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """For every indexed document: ``doc_id, n_words``, ``spans`` of hit words, and the ``items`` found, sorted.

    With one group of queries nothing is shuffled. Several are scanned one after another: the matches of each
    are written down, its broadcast is dropped, and in the end they are joined by document.
    """
    context = index.sparkSession.sparkContext
    groups, compiled = query_groups(benchmark, size)
    if groups == 1:
        return _search(index, context.broadcast(parts(next(compiled))), slop).select("doc_id", "n_words", "spans", "items")
    hits = None
    for queries in compiled:
        shared = context.broadcast(parts(queries))
        found = write_down(_search(index, shared, slop).where(F.size("spans") > 0).select("block", "nth", "spans", "items"), "matches")
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("block", "nth").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("nth", "d"), "ends")
    before = F.when(F.col("nth") > 0, F.try_element_at("ends", F.col("nth"))).otherwise(0)
    docs = docs.select("block", "nth", F.col("d.doc_ids").alias("doc_id"), (F.col("d.ends") - before).cast("bigint").alias("n_words"))
    joined = docs.join(lookup_side(write_down(hits, "hits")), ["block", "nth"], "left")
    kinds = dict(hits.dtypes)
    return joined.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("spans", "items")))


def hit_words(spans: str = "spans") -> Column:
    """Words covered by sorted spans that may overlap."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("until"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            (acc.hit + F.greatest(F.lit(0), s.end - F.greatest(s.start, acc.until))).alias("hit"),
            F.greatest(acc.until, s.end).alias("until")),
        lambda acc: acc.hit.cast("bigint"))


def contaminated() -> Column:
    """The rule: some word is hit, and the hit words are a twentieth of all or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def judge(found: DataFrame) -> DataFrame:
    """Search results with ``n_hit`` and ``contaminated``."""
    return found.withColumn("n_hit", hit_words()).withColumn("contaminated", contaminated())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns.

    Rows are told apart by a hash of id and text, so that a clean text under the id of a contaminated one stays. The
    hashes of contaminated ones are written down and looked up, broadcast if they measure small: texts stay where they are.
    """
    key = free_name(docs, "key")
    named = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))
    marked = docs.withColumn(key, named)
    index = build(docs.select(named.alias("doc_id"), "text"))
    bad = write_down(judge(search(index, benchmark)).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "bad")
    return marked.join(lookup_side(bad), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
