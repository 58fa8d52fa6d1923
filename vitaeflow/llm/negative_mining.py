"""Hard-negative mining with rotated one-bit codes.

Vectors become whole numbers, ``floor(256 * x)``, and scores are their exact
inner products. A row's code has one bit for each coordinate of ``TURNS`` random
rotations of its vector: the sign. Signs times the rotations' axes add up to the
code vector; stored beside the bits are its length and how much of the row's
vector lies along it (the alignment). What is left stands at a right angle.

An anchor's rotated coordinates are rounded to ``PLANES`` bit planes, so its
product with a code vector is a sum of popcounts, up to an error that is known.
The true score lies within an interval round this estimate: what is left of
either vector beside the code vector can add, by Cauchy and Schwarz, at most the
product of their lengths. The interval holds for every pair, it is not a matter
of chance. Pairs whose interval cannot reach the list are passed over; all
others are scored in whole numbers. So the result is exact.

Anchors are cut into blocks of bounded size; for each block the coded rows are
scanned where they are, once for the positives and once for the negatives, and
at most ``k`` rows a list leave a task. Before each scan, one row in
``DRAWN`` is searched: the worst score of the lists found there is one that the
whole table's lists cannot fall below, so tasks leave out what is worse.

Defined cases: rows with a null id, label or vector, or a component that is null
or not finite, take no part. Vectors of different lengths are compared as if the
shorter one went on with zeros; an empty one has the score 0 with every other.
"Other" rows are those of another id. Repeated rows are candidates each for
itself, and anchors each with rows of their own. Scores beyond a long count as
the nearest one. Empty tables give no rows. Other columns are not read.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import write_down

SCALE = 256
TURNS, PLANES = 4, 6
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
#: Anchors of a block, and bytes of its vectors.
ANCHORS, BLOCK_BYTES = 20_000, 32_000_000
#: One row of so many is searched first.
DRAWN = 64
#: Anchors and rows whose codes are compared at a time, and numbers of pairs that are scored at a time.
_SIDE, _ROWS, _CELLS = 256, 2048, 4_000_000
_LONG = np.iinfo(np.int64)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """``floor(256 * x)`` of each cell, as doubles, rows filled with zeros to ``width``."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    made = np.zeros((len(vectors), width))
    made[np.arange(width) < lengths[:, None]] = flat
    return made


class Rotations:
    """``TURNS`` rotations of vectors with ``width`` cells, a power of two: signs change, then sums and differences."""

    def __init__(self, width: int):
        self.width = width
        self.signs = np.random.default_rng((20240711, width)).choice([-1.0, 1.0], (TURNS, 2, width))

    def _mixed(self, rows: np.ndarray) -> np.ndarray:
        """The Hadamard transform, which is its own inverse."""
        n, step = self.width, 1
        made = rows.copy()
        while step < n:
            pairs = made.reshape(-1, n // (2 * step), 2, step)
            made = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(-1, n)
            step *= 2
        return made / np.sqrt(n)

    def turned(self, rows: np.ndarray) -> np.ndarray:
        """The coordinates of ``rows`` in all rotations, side by side."""
        return np.concatenate([self._mixed(self._mixed(rows * first) * second) for first, second in self.signs], 1)

    def summed(self, coordinates: np.ndarray) -> np.ndarray:
        """The sum of the rotations' axes times ``coordinates``."""
        parts = coordinates.reshape(len(coordinates), TURNS, self.width)
        return sum(self._mixed(self._mixed(parts[:, t]) * self.signs[t, 1]) * self.signs[t, 0] for t in range(TURNS))


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    more = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, more))), axis=1, bitorder="little").view(np.uint64)


def coded(rows: np.ndarray, rotations: Rotations) -> tuple[np.ndarray, np.ndarray]:
    """Codes as words, and of each row: the code vector's length, the alignment with it, what is left, the row's length."""
    turned = rotations.turned(rows)
    signs = np.where(turned > 0, 1.0, -1.0)
    length = np.sqrt((rotations.summed(signs) ** 2).sum(1))
    size = np.sqrt((rows**2).sum(1))
    along = np.abs(turned).sum(1) / np.maximum(length, 1e-300)
    left = np.sqrt(np.maximum(size**2 - along**2, 0))
    return packed(turned > 0), np.stack([np.maximum(length, 1e-300), along, left, size], 1)


class Anchors:
    """One block's anchors, ready to be compared with codes."""

    def __init__(self, rows: np.ndarray, rotations: Rotations):
        turned = rotations.turned(rows)
        self.size = np.sqrt((rows**2).sum(1))
        self.base = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.base) / (2**PLANES - 1), 1e-300)
        levels = np.rint((turned - self.base[:, None]) / self.step[:, None])
        rounded = self.base[:, None] + self.step[:, None] * levels
        self.error = np.abs(turned - rounded).sum(1)
        self.total = rounded.sum(1)
        self.planes = [packed((levels.astype(np.int64) >> p) & 1 == 1) for p in range(PLANES)]

    def intervals(self, side: slice, codes: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each anchor of ``side`` can have with each coded row."""
        count = np.zeros((side.stop - side.start, len(codes)), np.int64)
        for p, plane in enumerate(self.planes):
            ones = np.zeros(count.shape, np.uint32)
            for word in range(codes.shape[1]):
                ones += np.bitwise_count(plane[side, word][:, None] & codes[:, word])
            count += ones.astype(np.int64) << p
        length, along, left, size = facts.T
        set_bits = np.bitwise_count(codes).sum(1, dtype=np.int64)
        # signs are twice the bits, less one
        signed = 2 * (self.step[side, None] * count + self.base[side, None] * set_bits) - self.total[side, None]
        onto, error = signed / length, self.error[side, None] / length
        beside = np.sqrt(np.maximum(self.size[side, None] ** 2 - np.maximum(np.abs(onto) - error, 0) ** 2, 0))
        # roots of differences of doubles are good to far less than this
        width = along * error + beside * left + 1e-6 * (self.size[side, None] * size + 1)
        middle = along * onto
        return middle - width, middle + width


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b))
    return np.array([max(_LONG.min, min(_LONG.max, s)) for s in sums], np.int64)


class Lists:
    """The best ``k`` rows of every list of some anchors, higher scores first, then smaller ids.

    ``low`` and ``high`` are the scores a list takes and ``floor`` one that it cannot fall below, each
    by anchor and list. An anchor that has fewer lists than others has ``low`` above ``high`` there.
    """

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray):
        self.k, self.low, self.high, self.floor = k, low, high, np.maximum(floor, low)
        self.slot = self.score = self.number = np.zeros(0, np.int64)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of interest for each anchor; the ends of the longs stand for all beyond them."""
        open_ = self.low <= self.high
        least, most = (np.where(open_, self.floor, _LONG.max).min(1), np.where(open_, self.high, _LONG.min).max(1))
        return np.where(least == _LONG.min, -np.inf, least), np.where(most == _LONG.max, np.inf, most)

    def fold(self, anchor: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        n = self.low.shape[1]
        found = [(self.slot, self.score, self.number)]
        for at in range(n):
            taken = (score >= self.floor[anchor, at]) & (score <= self.high[anchor, at])
            found.append((anchor[taken] * n + at, score[taken], number[taken]))
        slot, score, number = (np.concatenate(x) for x in zip(*found))
        # a score's complement sorts the other way round, without overflow
        order = np.lexsort((number, ~score, slot))
        slot, score, number = slot[order], score[order], number[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = nth < self.k
        self.slot, self.score, self.number = slot[kept], score[kept], number[kept]
        last = nth[kept] == self.k - 1
        flat = self.floor.reshape(-1)
        flat[self.slot[last]] = np.maximum(flat[self.slot[last]], self.score[last])


_INDEX = "vec_id bigint, label bigint, vector array<double>, code binary, facts array<double>"
_HITS = "anchor bigint, list bigint, score bigint, vec_id bigint"


def _encode(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rotations = Rotations(width)
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            rows = whole_numbers(batch.column("vector"), width)
            codes, facts = coded(rows, rotations)
            yield pa.record_batch([
                batch.column("vec_id"), batch.column("label"), _lists(rows), pa.array([c.tobytes() for c in codes], pa.binary()), _lists(facts),
            ], names=["vec_id", "label", "vector", "code", "facts"])


def _lists(cells: np.ndarray) -> pa.Array:
    ends = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel()))


def _table(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _scan(shared, same: bool, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of this task for every list of the block."""
    ids, labels, rows, low, high, floor = shared.value
    anchors = Anchors(rows, Rotations(rows.shape[1]))
    sides = [slice(at, min(at + _SIDE, len(ids))) for at in range(0, len(ids), _SIDE)]
    lists = [Lists(k, low[side], high[side], floor[side]) for side in sides]
    cells = max(1, _CELLS // rows.shape[1])

    def searched(number: int, picked: np.ndarray, batch_ids, batch_labels, batch_rows, codes, facts) -> None:
        side, kept = sides[number], lists[number]
        least, most = kept.reach()
        lower, upper = anchors.intervals(side, codes[picked], facts[picked])
        i, j = np.nonzero((upper >= least[:, None]) & (lower <= most[:, None]))
        a, j = i + side.start, picked[j]
        fits = ((labels[a] == batch_labels[j]) == same) & (ids[a] != batch_ids[j])
        i, a, j = i[fits], a[fits], j[fits]
        for at in range(0, len(i), cells):
            part = slice(at, at + cells)
            kept.fold(i[part], exact_scores(rows[a[part]], batch_rows[j[part]]), batch_ids[j[part]])

    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            n = batch.num_rows
            batch_ids, batch_labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(n, -1)
            args = (batch_ids, batch_labels, _table(batch.column("vector"), n), codes, _table(batch.column("facts"), n))
            for number, side in enumerate(sides):
                # anchors of a block stand by label: a side asks for few of them
                picked = np.arange(n)
                if same:
                    picked = np.flatnonzero(np.isin(batch_labels, labels[side]))
                if len(picked):
                    searched(number, picked, *args)
    for side, kept in zip(sides, lists):
        n = kept.low.shape[1]
        columns = (side.start + kept.slot // n, kept.slot % n, kept.score, kept.number)
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "list", "score", "vec_id"])


def index(embeddings: DataFrame) -> DataFrame:
    """Every row that takes part, with its code and facts; written down, nothing moves."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                             vector.cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    width = 1 << max(0, longest - 1).bit_length()
    return write_down(rows.mapInArrow(partial(_encode, width), _INDEX), "codes")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(rows: DataFrame, drawn: DataFrame, block: tuple, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """The best ``k`` of every list: first among the rows drawn, whose worst score bounds what the others must reach."""
    context = rows.sparkSession.sparkContext
    floor = np.full(low.shape, _LONG.min, np.int64)
    first = context.broadcast((*block, low, high, floor))
    worst = _best(drawn.mapInArrow(partial(_scan, first, same, k), _HITS), k).where(F.col("rank") == k).toArrow()
    floor[worst.column("anchor").to_numpy(), worst.column("list").to_numpy()] = worst.column("score").to_numpy()
    first.destroy()
    second = context.broadcast((*block, low, high, floor))
    found = write_down(_best(rows.mapInArrow(partial(_scan, second, same, k), _HITS), k), "lists")
    second.destroy()
    return found


def mine(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. An anchor's positives are the best rows of its
    label. Of each positive, the negatives are the best rows of other labels whose score is ``LOW`` to ``HIGH``
    percent of the positive's. ``embeddings`` has ``vec_id, embedding, label``.
    """
    spark = embeddings.sparkSession
    rows = index(embeddings)
    drawn = write_down(rows.where(F.pmod(F.xxhash64("vec_id", "code"), F.lit(DRAWN)) == 0), "drawn")
    # equal anchors have equal lists
    anchors = write_down(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "vector").agg(
        F.count(F.lit(1)).alias("copies")), "anchors")
    n, cells = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n // ANCHORS), -(-8 * cells // BLOCK_BYTES))
    made = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                     "negative_score bigint")
    for number in range(blocks if n else 0):
        block = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == number).toArrow()
        if block.num_rows:
            made = made.unionByName(_mined(rows, drawn, block.combine_chunks()))
    return made


def _mined(rows: DataFrame, drawn: DataFrame, block: pa.Table) -> DataFrame:
    block = block.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    ids, labels, copies = (block.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
    vectors = block.column("vector").combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    side = (ids, labels, _table(vectors, len(ids)))
    any_, all_ = np.full((len(ids), 1), _LONG.min, np.int64), np.full((len(ids), 1), _LONG.max, np.int64)
    # at most so many rows for each anchor of the block
    near = _searched(rows, drawn, side, any_, all_, True, POSITIVES).toArrow()
    anchor, rank, score, number = (near.column(c).to_numpy() for c in ("anchor", "rank", "score", "vec_id"))
    low = np.full((len(ids), POSITIVES), _LONG.max, np.int64)
    high = np.full((len(ids), POSITIVES), _LONG.min, np.int64)
    # in Python's whole numbers, which do not overflow
    low[anchor, rank - 1] = [max(_LONG.min, -(-LOW * s // 100)) for s in score.tolist()]
    high[anchor, rank - 1] = [min(_LONG.max, HIGH * s // 100) for s in score.tolist()]
    found = _searched(rows, drawn, side, low, high, False, NEGATIVES)
    spark = rows.sparkSession
    # a row for each positive of the block
    names = spark.createDataFrame(pa.table({
        "anchor": anchor, "list": (rank - 1).astype(np.int64), "anchor_id": ids[anchor], "positive_id": number, "positive_score": score,
        "copies": copies[anchor]}))
    met = found.join(F.broadcast(names), ["anchor", "list"])
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                       "positive_score", F.col("score").alias("negative_score"))
