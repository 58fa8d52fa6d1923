"""A quality classifier with supervised subword embeddings.

Every word stands for itself, its character n-grams and a mark if it repeats
the word before it. All of these are hashed to rows of one table of vectors; a
word's vector is the mean over its parts, a document's the mean over its
words, and a softmax layer gives the class. Table and layer are learned
together by stochastic gradient descent in numpy.

The output is linear in the words up to the softmax, so scoring needs one
number for each word: words of a batch are worked out together and remembered.

Training uses at most ``PER_CLASS`` labelled documents of each class, chosen by
a hash of the id, as bags of hashed parts made in the tasks; of those, in the
same order, as many as have ``PER_CLASS_PARTS`` parts in all. Of texts that share
an id, the one whose hash is smallest is taken. A document's step on the table
is its gradient divided by its largest share, so that long texts, whose shares
are small, move it as far as short ones.

Defined cases: null and empty texts, or texts of white space, have no words and
get the score of the learned constant. Without labels of both classes every
score is one half or the constant's. Repeated labels count once. Extra columns
are not read.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, parts, utf8, write_down

PER_CLASS = 1000
#: Parts with shares, of 8 bytes, that come to the driver for each class.
PER_CLASS_PARTS = 2_500_000
#: Rows of the table, numbers in a vector, lengths of n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (3, 4, 5)
EPOCHS, RATE = 12, 0.5
_REMEMBERED = 500_000
#: Bytes of a word that n-grams are taken from are bounded by nothing; words are worked out in groups of this many bytes.
_GROUP = 1 << 20
_SAME = zlib.crc32(b"\x00same") % BUCKETS


def parts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all parts of all words, and the number of the word each belongs to."""
    joined = b"".join(b"<" + w + b">" for w in words)
    c = np.frombuffer(joined, np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets = [np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(BUCKETS)]
    owners = [np.arange(len(words))]
    code = np.zeros(len(c), np.uint32)
    for k in range(max(GRAMS)):
        if len(c) <= k:
            break
        code[: len(c) - k] = code[: len(c) - k] * np.uint32(0x01000193) + c[k:] + np.uint32(1)
        if k + 1 in GRAMS:
            inside = owner[: len(c) - k] == owner[k:]
            spread = (code[: len(c) - k][inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)
            buckets.append(spread)
            owners.append(owner[: len(c) - k][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def repeats(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words[1:], words))


def bag(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares, which add up to 1; both empty without words."""
    words = data.split() if data else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    same = repeats(words)
    total = np.zeros(BUCKETS)
    for at in range(0, len(words), _GROUP // 8):
        some = words[at : at + _GROUP // 8]
        buckets, owner = parts_of(some)
        total += np.bincount(buckets, 1.0 / np.bincount(owner)[owner], minlength=BUCKETS)
    total[_SAME] += same
    total /= len(words) + same
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``gain[bucket]`` is what a part adds to the log-odds of class 1; ``constant`` stands for no words."""

    gain: np.ndarray
    constant: float


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn vectors and softmax layer by stochastic gradient descent, and fold them to log-odds."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, constant = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    if not len(labels):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    steps, total = 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            rate = RATE * (1 - steps / total)
            steps += 1
            buckets, share = bags[i]
            hidden = share @ table[buckets] if len(buckets) else np.zeros(WIDTH, np.float32)
            logit = layer @ hidden + constant
            error = np.exp(logit - logit.max())
            error /= error.sum()
            error[labels[i]] -= 1.0
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            constant -= 0.1 * rate * error
            if len(buckets):
                # shares are small: a bag moves its parts as one word would
                table[buckets] -= rate * np.outer(share / share.max(), back)
    weight = layer[1] - layer[0]
    return Model((table @ weight).astype(np.float32), float(constant[1] - constant[0]))


class Scorer:
    """Scores texts, remembering what each word adds."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), _GROUP // 8):
            some = words[at : at + _GROUP // 8]
            buckets, owner = parts_of(some)
            sums = np.bincount(owner, self.model.gain[buckets], minlength=len(some)) / np.bincount(owner, minlength=len(some))
            self.known.update(zip(some, sums.tolist()))

    def scores(self, texts: list[bytes | None]) -> list[float]:
        split = [data.split() if data else [] for data in texts]
        made: list[float] = []
        at = 0
        while at < len(split):  # groups of texts whose words are learned together
            group, size = [], 0
            while at < len(split) and (not group or size < _GROUP):
                group.append(split[at])
                size += len(split[at])
                at += 1
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            new = set().union(*group).difference(self.known)
            if new:
                self.learn(sorted(new))
            made += [self._score(words) for words in group]
        return made

    def _score(self, words: list[bytes]) -> float:
        logit = self.model.constant
        if words:
            same = repeats(words)
            total = sum(map(self.known.__getitem__, words)) + same * float(self.model.gain[_SAME])
            logit += total / (len(words) + same)
        return 1.0 / (1.0 + float(np.exp(-np.clip(logit, -30, 30))))


_BAG = "struct<buckets: array<int>, shares: array<float>>"


def _bags():
    def work(texts: pa.Array) -> pa.Array:
        rows = [bag(data) for data in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
            ["buckets", "shares"])

    return work


def train(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Model:
    """Learn ``quality`` from labelled rows for which ``learn_from`` (over ``doc_id``) holds."""
    known = labels.where(learn_from & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    # a hash lets about four times as many ids through, so that no task orders more than that
    share = F.lit(0.0)
    for quality, n in counts.items():
        share = F.when(F.col("quality") == quality, min(1.0, 4 * PER_CLASS / n)).otherwise(share)
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) <= share * 2.0**53)
    in_order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= PER_CLASS).drop("nth")
    # at most 2 * PER_CLASS rows
    picked = docs.select("doc_id", "text").join(F.broadcast(write_down(chosen, "chosen")), "doc_id")
    picked = picked.withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    least = write_down(picked.groupBy("doc_id").agg(F.min("h").alias("h")), "least")
    once = picked.join(F.broadcast(least), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    bags = write_down(once.select("doc_id", "quality", array_function(_bags, _BAG)(utf8("text")).alias("b")).select("doc_id", "quality", "b.*"), "bags")
    size = F.sum(F.size("buckets")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sized = bags.select("doc_id", "quality", F.size("buckets").alias("n"), size.alias("size"))
    fits = sized.where((F.col("size") <= PER_CLASS_PARTS) | (F.col("size") == F.col("n"))).select("doc_id")
    # the first document of a class is taken whatever its size
    found = bags.join(F.broadcast(fits), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    texts = [(b.values.to_numpy().astype(np.int64), s.values.to_numpy()) for b, s in zip(found.column("buckets"), found.column("shares"))]
    return fit(texts, found.column("quality").to_numpy().astype(np.int64))


def _score(shared):
    def make():
        scorer = Scorer(Model(*shared.value))
        return lambda texts: pa.array(scorer.scores(texts.to_pylist()), pa.float64())

    return array_function(make, "double")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from ``text`` alone; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(parts(model))
    return docs.select("doc_id", _score(shared)(utf8("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
