"""Language identification and the quality classifier: held-out accuracy, odd rows."""

import numpy as np
import pytest

import odd_rows
from pyspark.sql import functions as F
from vitaeflow.llm import language_id as L
from vitaeflow.llm import quality_classifier as C
from vitaeflow.llm.registered import LLM_QUERIES
from vitaeflow.llm.svm import train_svm, train_svms

SF = "/root/testdata/sf0.01"


def test_machines_separate():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(200, 5)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    sign = np.where(rows[:, 0] > 0.1, 1.0, -1.0).astype(np.float32)
    weight = train_svm(rows, sign)
    assert (np.sign(rows @ weight[:-1] + weight[-1]) == sign).mean() > 0.97
    assert train_svm(rows, np.ones(200, np.float32))[-1] == 1.0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = LLM_QUERIES["op6_language_id"](spark, SF)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_vectors_cover_whole_texts():
    text = b"abc " * 400_000
    assert np.allclose(L.vector(text), L.vector(b"abc " * 20_000), atol=0.01)
    assert not np.allclose(L.vector(text + b"zzz " * 400_000), L.vector(text), atol=0.01)


@pytest.mark.parametrize("text, letters", [("", False), ("12 !", False), ("1a", True), ("é", True), ("日本", True), ("\U0001f600 ٣", False)])
def test_letters(text, letters):
    assert L.has_letter(text.encode()) == letters


def test_language_odd_rows(spark):
    docs = odd_rows.documents(spark)
    mixed = docs.unionByName(docs.withColumn("lang", F.lit(None).cast("string"))).unionByName(docs.withColumn("lang", F.lit("xx")))
    model = L.train(mixed, F.lit(True))
    rows = L.identify(docs, model).collect()
    assert len(rows) == len(odd_rows.TEXTS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (2, 3, 4))
    nothing = L.train(odd_rows.no_documents(spark), F.lit(True))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(odd_rows.no_documents(spark), model).count() == 0


def plain_vector(text):
    """The vector by its definition, one n-gram at a time."""
    total = [0] * L.WIDTH
    folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in b" " + text.encode() + b" "]
    word = (1 << 32) - 1
    for at, a in enumerate(folded):
        total[a] += 1
        if at + 1 < len(folded):
            total[256 + (((a * 0x9E3779B1 + folded[at + 1] * 0x85EBCA6B) & word) >> 22)] += 1
        if at + 2 < len(folded):
            three = (a * 0x9E3779B1 + folded[at + 1] * 0x85EBCA6B + folded[at + 2] * 0xC2B2AE35) & word
            total[1280 + (((three * 0x27D4EB2F) & word) >> 20)] += 1
    total[32] = 0
    size = sum(total) ** 0.5
    return [n**0.5 / max(size, 1e-12) for n in total]


def plain_prediction(model, text):
    """Best family, then votes of all pairs of its languages, one product at a time."""
    x = [*plain_vector(text), 1.0]
    product = lambda weights: sum(float(w) * v for w, v in zip(weights, x) if v)
    margins = [product(weights) for weights in model.family]
    f = margins.index(max(margins))
    votes = dict.fromkeys(model.languages[f], 0)
    gains = dict.fromkeys(model.languages[f], 0.0)
    pairs = [(a, b) for i, a in enumerate(model.languages[f]) for b in model.languages[f][i + 1 :]]
    for (a, b), weights in zip(pairs, model.pairs[f]):
        margin = product(weights)
        votes[a if margin >= 0 else b] += 1
        gains[a] += margin
        gains[b] -= margin
    return max(model.languages[f], key=lambda name: (votes[name], gains[name]))


def test_predictions_are_those_of_families_and_votes(spark):
    """Random machines, so that families and languages of all kinds win, and no language wins all its pairs at times."""
    rng = np.random.default_rng(6)
    languages = (("ca", "es", "fr", "it"), ("en",), ("cs", "pl", "sk"))
    letters = list("abcdefgéñžß ABC.,1")
    rows = [(i, "a" + "".join(rng.choice(rng.choice(letters, 3), rng.integers(1, 60)))) for i in range(250)]
    middle = np.mean([L.vector(text.encode()) for _, text in rows], axis=0)

    def machines(n):
        weights = rng.normal(size=(n, L.WIDTH + 1)).astype(np.float32)
        weights[:, -1] = -weights[:, :-1] @ middle  # so that both sides of each machine occur
        return weights

    model = L.Model(("romance", "germanic", "slavic"), languages, machines(3),
                    tuple(machines(len(names) * (len(names) - 1) // 2) for names in languages))
    assert np.allclose(L.vector(rows[0][1].encode()), plain_vector(rows[0][1]), atol=1e-6)
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    expected = {i: plain_prediction(model, text) for i, text in rows}
    assert got == expected and len(set(expected.values())) == 8


def test_language_sample_is_the_first_ids_by_hash(spark, monkeypatch):
    """The bound on hashes lets through what the whole order would have taken; copies and partitions change nothing."""
    taken = []
    monkeypatch.setattr(L, "PER_LANGUAGE", 25)
    monkeypatch.setattr(L, "fit", lambda vectors, langs: taken.append((vectors.tobytes(), langs)))
    rows = [(i, f"text number {i} of it", "en" if i % 3 else "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    L.train(docs, F.lit(True))
    first = docs.orderBy(F.xxhash64("doc_id")).collect()
    expected = sorted((lang, L.vector(r["text"].encode()).tobytes())
                      for lang in ("en", "fr") for r in [r for r in first if r["lang"] == lang][:25])
    assert taken[0] == (b"".join(x for _, x in expected), [lang for lang, _ in expected])
    L.train(docs.repartition(5).unionByName(docs.where("doc_id % 50 = 0").limit(0)), F.lit(True))
    assert taken[1] == taken[0]


def test_every_language_has_its_machine(spark):
    """More languages than any fixed number of classes, the last ones rare; one id in thousands of rows crowds none out."""
    rng = np.random.default_rng(3)
    words = {f"q{k:03}": [bytes(rng.integers(97, 123, 5)).decode() for _ in range(4)] for k in range(90)}
    rows = [(100 * k + i, " ".join(rng.choice(own, 40)), lang)
            for k, (lang, own) in enumerate(words.items()) for i in range(2 if k >= 60 else 4)]
    rows += [(0, rows[0][1], "q000")] * 20_000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(docs, F.lit(True))
    assert {lang for family in model.languages for lang in family} == set(words)
    found = L.identify(docs.dropDuplicates(["doc_id"]), model).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert len(found) == 300 and all(r["lang_pred"] == r["lang"] for r in found)


def test_languages_share_the_sample():
    assert L.quota([10**9] * 4) == 400 and L.quota([]) == 400
    assert L.quota([10**9] * 10 + [5] * 300) == 400  # rare languages leave their part to the others
    assert L.quota([10**9] * 64) == 100
    assert L.quota([10**9] * 5000) == L.LEAST


def test_machines_trained_together_are_those_trained_alone():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60, 7)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    signs = np.stack([np.sign(rows[:, 0]), np.sign(rows[:, 1] - 0.1), np.ones(60)], axis=1).astype(np.float32)
    assert np.allclose(train_svms(rows, signs), [train_svm(rows, sign) for sign in signs.T], atol=1e-3)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = LLM_QUERIES["op7_quality_classifier"](spark, SF)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").toPandas()
    ranks = rows["score"].rank()
    good = rows["quality"] == 1
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.97 and (rows["predicted"] == rows["quality"]).mean() > 0.95


def test_copies_and_partitions_do_not_change_the_model(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    monkeypatch.setattr(C, "PER_CLASS", 20)
    alone = C.train(docs, labels, F.lit(True))
    other = docs.limit(1).crossJoin(spark.range(500)).select("doc_id", "text")
    for rows in (docs.repartition(9), docs.unionByName(docs).unionByName(other).repartition(4)):
        again = C.train(rows, labels.unionByName(labels), F.lit(True))
        assert np.array_equal(again.gain, alone.gain) and again.constant == alone.constant
    monkeypatch.setattr(C, "PER_CLASS_PARTS", 3000)
    fewer = C.train(docs, labels, F.lit(True))
    assert not np.array_equal(fewer.gain, alone.gain)


def test_scores_are_those_of_the_whole_bag():
    rng = np.random.default_rng(2)
    model = C.Model(rng.normal(size=C.BUCKETS).astype(np.float32), 0.3)
    texts = [b"a a a b", b"", None, "é word word".encode(), b"x" * 5000, b" \n"]
    for text, score in zip(texts, C.Scorer(model).scores(texts)):
        buckets, share = C.bag(text)
        assert score == pytest.approx(1 / (1 + np.exp(-(0.3 + (share * model.gain[buckets]).sum()))), abs=1e-5)


def test_classifier_odd_rows(spark):
    docs = odd_rows.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (2, 1, 0), (9, 1, 1), (None, 1, 0), (6, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = C.train(docs, known, F.lit(True))
        rows = C.classify(docs, model).collect()
        assert len(rows) == len(odd_rows.TEXTS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    assert C.classify(odd_rows.no_documents(spark), model).count() == 0
