"""Language identification in two levels.

A text is a vector of hashed byte n-grams (1 to 3) over its whole length. One
linear machine for each family says which family it belongs to; inside the
family, a machine for every pair of languages decides between the two, and the
language with most wins is taken. Closely related languages are thus only ever
told apart by machines that have seen nothing but those two.

The machines are trained on the driver from vectors of at most
``PER_LANGUAGE`` documents of each language, chosen by a hash of the id; the
texts stay in the tasks. Every language has its machine, however many there
are: if they are many, each is learned from fewer documents, but not from
fewer than ``LEAST`` where it has them. Everything else covers all rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0,
as is every text if there was nothing to learn from. A language outside the
table of families is a family of its own. Repeated rows count as often as they
come, up to the bound. Extra columns are not read.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import array_function, parts, utf8
from vitaeflow.llm.svm import train_svm, train_svms

#: Documents of each language that are learned from, at most; so many of each in any case; and documents in all otherwise.
PER_LANGUAGE, LEAST, DOCUMENTS = 400, 20, 6400
#: Ids of a language that are put in order, as a multiple of those that are taken.
DRAWN = 4
#: Buckets of the n-grams of one, two and three bytes.
_WIDTHS = (256, 1024, 4096)
WIDTH = sum(_WIDTHS)
UNKNOWN = "und"

# Families of common languages by ISO 639-1 code.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "cs": "slavic", "pl": "slavic", "sk": "slavic", "sl": "slavic", "hr": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
# letters become small, other ASCII becomes one mark, bytes beyond ASCII stay
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes looked at in one go, so that a very long text needs no more memory.
_PART = 1 << 20


def has_letter(data: bytes) -> bool:
    if len(data.translate(None, _LETTERS)) < len(data):
        return True
    return not data.isascii() and any(map(str.isalpha, data.decode("utf-8", "replace")))


def vector(data: bytes) -> np.ndarray:
    """Counts of the n-grams' buckets, as square roots, scaled to length 1."""
    total = np.zeros(WIDTH)
    folded = b" " + data.translate(_FOLD) + b" "
    for at in range(0, len(folded), _PART):
        c = np.frombuffer(folded, np.uint8)[at : at + _PART + 2].astype(np.uint32)
        last = min(_PART, len(folded) - at)  # n-grams that begin in this part
        total[: _WIDTHS[0]] += np.bincount(c[:last], minlength=_WIDTHS[0])
        two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B))[:last] >> np.uint32(22)
        total[_WIDTHS[0] : _WIDTHS[0] + _WIDTHS[1]] += np.bincount(two, minlength=_WIDTHS[1])
        if len(c) > 2:
            three = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
            total[-_WIDTHS[2] :] += np.bincount((three[:last] * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=_WIDTHS[2])
    total[32] = 0.0  # what is no letter
    total = np.sqrt(total)
    return (total / max(np.sqrt((total * total).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``family`` has a row of weights for each family; ``pairs[f]`` one for each pair of its languages."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    family: np.ndarray
    pairs: tuple[np.ndarray, ...]

    def predict(self, data: bytes | None) -> tuple[str, float]:
        if not data or not self.families or not has_letter(data):
            return UNKNOWN, 0.0
        x = np.append(vector(data), np.float32(1))
        margins = self.family @ x
        f = int(margins.argmax())
        names = self.languages[f]
        sure = 1.0 if len(margins) == 1 else _chance(margins[f] - np.partition(margins, -2)[-2])
        if len(names) == 1:
            return names[0], sure
        decided = self.pairs[f] @ x
        wins, gain = np.zeros(len(names)), np.zeros(len(names))
        for (a, b), margin in zip(combinations(range(len(names)), 2), decided):
            wins[a if margin >= 0 else b] += 1
            gain[a] += margin
            gain[b] -= margin
        best = int(np.lexsort((gain, wins))[-1])
        own = [m if a == best else -m for (a, b), m in zip(combinations(range(len(names)), 2), decided) if best in (a, b)]
        return names[best], sure * _chance(2 * min(own))


def _chance(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-2.0 * float(np.clip(margin, -20, 20)))))


def fit(vectors: np.ndarray, langs: list[str]) -> Model:
    """Train the machines from rows of ``vector`` and their languages."""
    label = np.array(langs, dtype=object)
    by_family: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by_family.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    families = tuple(sorted(by_family))
    family_of = np.array([FAMILIES.get(lang, lang) for lang in langs], dtype=object)
    top = train_svms(vectors, np.where(family_of[:, None] == np.array(families, dtype=object), 1.0, -1.0).astype(np.float32))
    pairs = []
    for f in families:
        made = []
        for a, b in combinations(by_family[f], 2):
            of_two = (label == a) | (label == b)
            made.append(train_svm(vectors[of_two], np.where(label[of_two] == a, 1.0, -1.0).astype(np.float32)))
        pairs.append(np.array(made))
    return Model(families, tuple(tuple(by_family[f]) for f in families), top, tuple(pairs))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _vectors():
    def work(texts: pa.Array) -> pa.Array:
        return pa.array([vector(data or b"").tobytes() for data in texts.to_pylist()], pa.binary())

    return work


def quota(counts: list[int]) -> int:
    """Documents of each language to learn from: as many as fit ``DOCUMENTS`` in all, but ``LEAST`` in any case."""
    fits = (each for each in range(PER_LANGUAGE, LEAST, -1) if sum(min(n, each) for n in counts) <= DOCUMENTS)
    return next(fits, LEAST)


def _low(share: float) -> int:
    """The highest of the lowest ``share`` of all 64-bit hashes."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def train(docs: DataFrame, learn_from: Column) -> Model:
    """Learn from the rows for which ``learn_from`` holds and ``lang`` is not null.

    Which rows is settled on ids alone; only their vectors, of some 20 KB, come to the driver: at most
    ``DOCUMENTS``, or ``LEAST`` of each language if those are more.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()
    each = quota([r["n"] for r in counts])
    # only ids whose hash is low enough are put in order, so that one language's are few whatever the table
    bounds = docs.sparkSession.createDataFrame([(r["lang"], _low(DRAWN * each / max(1, r["ids"]))) for r in counts], "lang string, bound bigint")
    low = rows.select("doc_id", "lang").join(F.broadcast(bounds), "lang").where(F.xxhash64("doc_id") <= F.col("bound"))
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = low.select("doc_id", "lang").distinct().withColumn("nth", F.row_number().over(nth)).where(
        F.col("nth") <= each).select("doc_id", "lang")
    picked = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    vectors = picked.select("doc_id", "lang", array_function(_vectors, "binary")(utf8("text")).alias("x"))
    # rows that repeat an id may be more; each language is cut for itself, so that none is crowded out
    vectors = vectors.withColumn("nth", F.row_number().over(nth.orderBy(F.xxhash64("doc_id"), "doc_id", "x")))
    found = vectors.where(F.col("nth") <= each).select("lang", "x").toPandas()
    if found.empty:
        return Model((), (), np.zeros((0, WIDTH + 1)), ())
    order = found.sort_values(["lang", "x"], kind="stable")  # the same model whatever the tasks' order
    vectors = np.frombuffer(b"".join(order["x"]), np.float32).reshape(-1, WIDTH)
    return fit(vectors, order["lang"].tolist())


def _predict(shared):
    def make():
        model = Model(*shared.value)

        def work(texts: pa.Array) -> pa.Array:
            rows = [model.predict(data) for data in texts.to_pylist()]
            return pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "score"])

        return work

    return array_function(make, "struct<lang: string, score: double>")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from ``text`` alone; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(parts(model))
    return docs.select("doc_id", _predict(shared)(utf8("text")).alias("p")).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
