"""Near duplicates by an inverted join of MinHash signature coordinates.

A text's set is its distinct 5-word shingles. Equal sets form one class first,
so that copies in any number are one node from there on. A class has a
signature of ``K`` coordinates, and is posted under coordinate-value pairs:

* Two classes are candidates if they agree in enough of ``POSTED``
  coordinates and in enough of all ``K`` (``agreements_for`` a similarity).
* Prefix: pairs that only one class has cannot be shared. Of the others, taken
  from rare to frequent, a class is posted under so few that any partner with
  enough agreements meets it in one of them; a class with too few shared pairs
  is not posted at all. Frequent values, such as those of a passage that a
  third of all texts contain, come last and are mostly skipped.
* First every list links its members to its smallest one only. Candidates are
  confirmed on the full sets and give first components. Lists whose members
  all came together are done.
* In the other lists, members of different components are compared inside the
  tasks, in blocks of bounded bytes that hold signatures and full sets: a long
  list is cut into blocks and pairs of blocks are dealt to tasks. Agreements are
  counted on signature bytes, pairs with enough of them are confirmed on the sets
  in the first list that has both, and what is confirmed joins at once, so that
  further pairs inside a component are passed over. What leaves a task is a
  spanning forest: fewer links than members, however many pairs are near.

Pairs are decided by the full sets, so no pair below the similarity is linked.
A pair at exactly 0.85 is missed if fewer coordinates agree than asked for:
with the thresholds below, about once in 5000; from 0.9 on it does not happen in
practice.

Defined cases: null and empty texts, or texts of white space, have an empty
set and are linked with nothing; fewer than five words are one shingle. A null
``doc_id`` cannot name a group: it is left out of all links. Repeated rows are
a class like other copies. Empty tables give empty results. Extra columns are
not read.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, free_name, parts, utf8, write_down
from vitaeflow.llm.components import components
from vitaeflow.session import lookup_side

SHINGLE = 5
#: Links: 100 * |A and B| >= LEAST * |A or B|, unless another percentage is asked for.
LEAST = 85
K, POSTED = 512, 64
#: Members of a list, and bytes of their signatures and sets, that one task compares with each other or with another block.
BLOCK, BLOCK_BYTES = 4096, 32_000_000
#: Words of one task whose hashes are remembered.
_REMEMBERED = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.random.default_rng(20240517)
_PLACE = _MIX.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _MIX.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64)
_WIDE = _MIX.integers(1, 1 << 63, (2, POSTED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NARROW = _MIX.integers(1, 1 << 31, (2, K - POSTED), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass(frozen=True)
class Agreements:
    """What is asked of pairs, from the percentage ``least`` of their similarity.

    ``matches`` of the posted coordinates and ``confirmed`` of all are about four standard deviations
    below what pairs at ``least`` agree in. Bytes of different coordinates agree once in 256.
    """

    least: int
    matches: int
    confirmed: int


def agreements_for(least: int) -> Agreements:
    share = least / 100
    same = share + (1 - share) / 256
    return Agreements(
        least, max(1, round(POSTED * share - 4 * math.sqrt(POSTED * share * (1 - share)))),
        max(1, math.floor(K * same - 4 * math.sqrt(K * same * (1 - same)))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (wraps round on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(data: bytes | None, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = data.translate(_LOWER).split() if data else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    total = codes[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total += codes[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total + _SHORT[size]))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``POSTED`` wide coordinates, and one byte of each of all ``K``."""
    wide = np.full(POSTED, np.iinfo(np.uint64).max, np.uint64)
    narrow = np.full(K - POSTED, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 256):
        part = found[at : at + 256, None]
        np.minimum(wide, (part * _WIDE[0] + _WIDE[1]).min(0), out=wide)
        np.minimum(narrow, (part.astype(np.uint32) * _NARROW[0] + _NARROW[1]).min(0), out=narrow)
    # the least bits of a minimum are as good as random
    return wide, np.concatenate([_mixed(wide).astype(np.uint8), (_mixed(narrow.astype(np.uint64))).astype(np.uint8)])


def _name(found: np.ndarray) -> bytes:
    """Two independent sums name a set whatever the order."""
    return np.array([found.sum(), _mixed(found + np.uint64(1)).sum()], np.uint64).tobytes()


def _names():
    known = WordHashes()

    def work(texts: pa.Array) -> pa.Array:
        sets = (shingles(data, known) for data in texts.to_pylist())
        return pa.array([_name(found) if len(found) else None for found in sets], pa.binary())

    return work


_SETS = "struct<n: bigint, set_id: binary, wide: binary, bytes: binary>"


def _summary():
    known = WordHashes()

    def work(texts: pa.Array) -> pa.Array:
        rows = []
        for data in texts.to_pylist():
            found = shingles(data, known)
            if not len(found):
                rows.append((0, None, None, None))
                continue
            wide, small = signature(found)
            rows.append((len(found), _name(found), wide.tobytes(), small.tobytes()))
        columns = zip(*rows) if rows else [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "set_id", "wide", "bytes"])

    return work


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the size of each text's set, the set's name and its signature; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), array_function(_summary, _SETS)(utf8("text")).alias("s"))
    return rows.select("doc_id", "s.*")


def classes(signed: DataFrame) -> DataFrame:
    """One row for each different set: ``node``, its smallest document ``rep``, and the signature."""
    rows = signed.where("n > 0 AND doc_id IS NOT NULL")
    return rows.groupBy("set_id").agg(F.min(F.struct("doc_id", "wide", "bytes")).alias("m")).select(
        F.monotonically_increasing_id().alias("node"), "set_id", F.col("m.doc_id").alias("rep"), "m.wide", "m.bytes")


# --- prefix lists -----------------------------------------------------------------


def _pairs_of_signature():
    place = np.arange(POSTED, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def work(wide: pa.Array) -> pa.Array:
        values = np.frombuffer(b"".join(wide.to_pylist()), np.uint64).reshape(-1, POSTED)
        keys = _mixed(values + place).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * POSTED, pa.int32()), pa.array(keys.ravel()))

    return work


def prefix_lists(nodes: DataFrame, matches: int) -> DataFrame:
    """``(key, node, earlier)``: the lists under which each class is posted.

    ``earlier`` are the lists before this one, from rare to frequent, of the same class.
    """
    keys = array_function(_pairs_of_signature, "array<bigint>")(F.col("wide"))
    pairs = nodes.select("node", F.explode(keys).alias("key"))
    # written down, so that adaptive execution can split the rows of a hot pair
    shared = write_down(pairs.groupBy("key").count().where("count > 1"), "shared")
    own = pairs.join(lookup_side(shared), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("own"))
    # all but so many coordinates may differ: of the shared pairs, so many must be looked at
    posted = own.where(F.size("own") >= matches).select("node", F.slice("own.key", F.lit(1), F.size("own") - (matches - 1)).alias("keys"))
    return posted.select("node", "keys", F.posexplode("keys").alias("at", "key")).select(
        "key", "node", F.slice("keys", F.lit(1), F.col("at")).alias("earlier"))


# --- counting agreements --------------------------------------------------------------


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _agree(confirmed: int):
    def work(pairs: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(pairs.field(n).to_pylist()), np.uint8).reshape(-1, K) for n in ("x", "y"))
        return pa.array(agreements(a, b) >= confirmed)

    return work


def star_candidates(lists: DataFrame, nodes: DataFrame, confirmed: int) -> DataFrame:
    """Pairs of each list's smallest member with its others that agree often enough."""
    smallest = lists.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    smallest = lookup_side(write_down(smallest, "smallest"))
    pairs = lists.select("key", F.col("node").alias("b")).join(smallest, "key").where("a < b").select("a", "b").distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("bytes").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("bytes").alias("y"))
    agree = array_function(partial(_agree, confirmed), "boolean")
    return pairs.join(left, "a").join(right, "b").withColumn("ok", agree(F.struct("x", "y"))).where("ok").select("a", "b")


def _compare_blocks(asked: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block pair; holds the at most two blocks of one pair."""
        open_key, rows = None, []

        def linked() -> pa.RecordBatch:
            found = forest(open_key, rows, Agreements(*asked))
            return pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, low, high, *row in zip(*columns):
                if (key, low, high) != open_key:
                    if rows:
                        yield linked()
                    open_key, rows = (key, low, high), []
                rows.append(row)
        if rows:
            yield linked()

    return run


def forest(block: tuple[int, int, int], rows: list, asked: Agreements) -> list[tuple[int, int]]:
    """Links that join the components of a block's members, or of two blocks', as far as their pairs are similar enough.

    ``rows`` are ``(side, node, component, signature bytes, set, earlier lists)``. A pair that an earlier list has is
    left to that list; one whose members have come together is passed over.
    """
    _, low, high = block
    side = np.array([r[0] for r in rows])
    node = [r[1] for r in rows]
    _, part = np.unique([r[2] for r in rows], return_inverse=True)
    marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, K)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(x) for x in sets])
    earlier = [frozenset(r[5]) for r in rows]
    first = np.flatnonzero(side == low)
    second = first if low == high else np.flatnonzero(side == high)
    found = []
    columns = np.ascontiguousarray(marks[second].T)
    for i in first:
        # sets whose sizes differ too much are never similar enough
        fits = (part[second] != part[i]) & (100 * np.minimum(sizes[second], sizes[i]) >= asked.least * np.maximum(sizes[second], sizes[i]))
        near = np.flatnonzero(fits & (second > i) if low == high else fits)
        # after every 64, pairs that cannot reach the threshold any more are skipped
        count = np.zeros(len(near), np.int16)
        for start in range(0, K, 64):
            if not len(near):
                break
            count = count + (columns[start : start + 64, near] == marks[i, start : start + 64, None]).sum(0, dtype=np.int16)
            left = count + (K - start - 64) >= asked.confirmed
            near, count = near[left], count[left]
        near = second[near[np.argsort(-count, kind="stable")]]
        near = [j for j in near if earlier[i].isdisjoint(earlier[j])]
        # the likeliest ones first, as the others may come along with them
        for at in range(0, len(near), 64):
            others = [j for j in near[at : at + 64] if part[j] != part[i]]
            if not others:
                continue
            both = _shared(sets[i], [sets[j] for j in others])
            for j in np.array(others)[100 * both >= asked.least * (sizes[i] + sizes[others] - both)]:
                if part[j] != part[i]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    part[part == part[j]] = part[i]
    return found


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sorted sets shares with ``one``; no set is empty."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return np.add.reduceat((one[at] == every).astype(np.int64), starts)


def _sets():
    known = WordHashes()

    def work(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(data, known).tobytes() for data in texts.to_pylist()], pa.binary())

    return work


def block_links(lists: DataFrame, nodes: DataFrame, label: DataFrame, docs: DataFrame, asked: Agreements, repeated: bool) -> DataFrame:
    """Confirmed links between members of different components, in lists that still have several."""
    placed = lists.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = write_down(placed, "placed")
    # the least and greatest component differ if a list has several
    several = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    members = write_down(placed.join(lookup_side(write_down(several, "several")), "key", "left_semi"), "members")
    texts = texts_of(members.select("node").distinct(), nodes, docs, repeated)
    sets = texts.select("node", array_function(_sets, "binary")(F.col("text")).alias("set"))
    sets = write_down(sets.join(nodes.select("node", "bytes"), "node").withColumn("held", F.octet_length("set") + K), "sets")
    sized = members.join(sets.select("node", "held"), "node")
    weight = F.col("held") + 8 * F.size("earlier")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("int").alias("blocks"))
    # lists of one block, nearly all, need no look-up
    long = lookup_side(write_down(blocks.where("blocks > 1"), "long"))
    members = members.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "component", "earlier")
    marked = dealt.join(sets, "node").select("key", "low", "high", "side", "node", "component", "bytes", "set", "earlier")
    return marked.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side", "node").mapInArrow(
        _compare_blocks(parts(asked)), "a bigint, b bigint").distinct()


# --- confirming on full sets --------------------------------------------------------------


def _same_enough(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = WordHashes(), {}

        def of(node: int, name: bytes, data: bytes) -> np.ndarray | None:
            # partners often come one after another
            if node not in kept:
                if len(kept) >= 8:
                    kept.clear()
                found = shingles(data, known)
                same = _name(found) == name
                kept[node] = found if same else None  # another text under the same doc_id
            return kept[node]

        for batch in batches:
            linked = []
            for a, b, name_a, name_b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(6))):
                x, y = of(a, name_a, text_a), of(b, name_b, text_b)
                if x is not None and y is not None:
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * both >= least * (len(x) + len(y) - both):
                        linked.append((a, b))
            yield pa.record_batch([pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """``node, set_id, text`` of the classes in ``wanted (node)``, written down; only their texts move.

    The ids that are looked up in ``docs`` are broadcast if measured small, so that the other texts stay where
    they are. Where ids are ``repeated``, the text of a class is told from others under its id by the name of its
    set, and taken once.
    """
    wanted = write_down(nodes.select("node", "rep", "set_id").join(wanted, "node", "left_semi"), "wanted")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), utf8("text").alias("text"))
    if repeated:
        ids = write_down(wanted.select("rep").distinct(), "ids")
        rows = rows.join(lookup_side(ids), "rep", "left_semi").withColumn("set_id", array_function(_names, "binary")(F.col("text")))
        found = rows.join(lookup_side(wanted), ["rep", "set_id"]).dropDuplicates(["node"])
    else:
        found = rows.join(lookup_side(wanted), "rep")
    return write_down(found.select("node", "set_id", "text"), "texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, least: int, repeated: bool) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, repeated)
    left = texts.toDF("a", "name_a", "text_a")
    right = texts.toDF("b", "name_b", "text_b")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "name_a", "name_b", "text_a", "text_b")
    return met.mapInArrow(_same_enough(least), "a bigint, b bigint").distinct()


# --- the whole job ----------------------------------------------------------------------------


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")


def _judged(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, n, set_id, component_id`` of every row, and ``chosen``, the set of its group that stays."""
    signed = write_down(signatures(docs), "signed")
    nodes = write_down(classes(signed), "classes")
    repeated = not repeated_ids(signed).isEmpty()
    asked = agreements_for(least)
    lists = write_down(prefix_lists(nodes, asked.matches), "lists")
    links = write_down(confirmed(write_down(star_candidates(lists, nodes, asked.confirmed), "pairs"), nodes, docs, least, repeated), "links")
    label = components(links)
    more = write_down(block_links(lists, nodes, label, docs, asked, repeated), "links")
    if not more.isEmpty():
        label = components(links.union(more))
    rep = nodes.select("node", "set_id", "rep")
    grouped = label.join(rep, "node")
    smallest = grouped.groupBy("component").agg(F.min(F.struct("rep", "set_id")).alias("least"))
    linked = grouped.join(smallest, "component").select("node", "least")
    named = rep.join(linked, "node", "left").select(
        "set_id", F.coalesce("least.rep", "rep").alias("group"), F.coalesce("least.set_id", "set_id").alias("chosen"))
    found = signed.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return found.select("doc_id", "n", "set_id", component.alias("component_id"), "chosen")


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Texts are linked from ``least`` percent similarity on. ``component_id`` is the smallest ``doc_id`` that links lead to, itself included; null where
    ``doc_id`` is.
    """
    return _judged(docs, least).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and all whose ``doc_id`` is null; columns as they were.

    Ids to drop are looked up (broadcast if measured small), so texts stay in place. Rows that
    repeat a ``doc_id`` are told apart by their sets and reduced to one of each, with a shuffle only
    if there are any.
    """
    judged = write_down(_judged(docs, least), "judged")
    stays = F.col("doc_id").isNull() | (
        (F.col("doc_id") == F.col("component_id")) & F.col("set_id").eqNullSafe(F.col("chosen")))
    gone, number = free_name(docs, "gone"), free_name(docs, "number")
    drop = judged.where(~stays).select(F.col("doc_id").alias(gone), "set_id").distinct()
    marked = docs.withColumn(number, F.col("doc_id").cast("bigint"))
    by_id = F.col(f"`{number}`") == F.col(f"`{gone}`")
    repeated = write_down(repeated_ids(judged).select(F.col("doc_id").alias(gone)), "repeated")
    if repeated.isEmpty():
        left = marked.join(lookup_side(drop.select(gone)), by_id, "left_anti")
    else:
        several = lookup_side(repeated)
        once = marked.join(several, by_id, "left_anti").join(lookup_side(drop.select(gone).distinct()), by_id, "left_anti")
        name, other = free_name(docs, "set_name"), free_name(docs, "other_name")
        again = marked.join(several, by_id, "left_semi").withColumn(name, array_function(_names, "binary")(utf8("text")))
        drop = drop.withColumnRenamed("set_id", other)
        again = again.join(lookup_side(drop), by_id & (F.col(f"`{name}`") == F.col(f"`{other}`")), "left_anti")
        left = once.unionByName(again.dropDuplicates([number, name]).drop(name))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
