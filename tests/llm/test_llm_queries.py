"""Registered queries against their SQL, and the pipeline against brute force."""

import numpy as np
import pytest

import corpus_pipeline
import odd_rows
import oracle
import test_minhash_join
import test_positional_index
import test_quality_rules
import test_secret_scan
from vitaeflow.llm import piece_lattice, secret_scan
from vitaeflow.llm.registered import LLM_ORACLES, LLM_QUERIES, piece_model

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    got = oracle.from_spark(LLM_QUERIES[name](spark, SF))
    assert got[1] and got == oracle.from_sql(oracle.connect(SF), LLM_ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES) == [*range(1, 14)]


def test_secret_query_matches_regular_expressions(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in LLM_QUERIES["op8_secret_scans"](spark, SF).collect():
        spans = test_secret_scan.brute(docs[r["doc_id"]])
        kinds = ["assign", "access", "hex"]
        shown = ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, _, k in spans) for i in range(3)]


def test_shards_and_pieces_of_all_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    shards = LLM_QUERIES["op9_sharding"](spark, SF).toPandas()
    assert len(shards) == n and set(shards["shard"]) == set(range(24))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in shards.groupby("shard"))
    pieces = LLM_QUERIES["op10_sentencepiece"](spark, SF)
    assert pieces.count() == n == pieces.where("decodes").count()


def brute_pipeline(docs, bench):
    """The stages over Python rows: ids with their final text."""
    rows = {}
    for i, text in docs:
        n, _, symbols, _, _, repeated, upper, letters = test_quality_rules.brute(text or "")
        if n >= 50 and 100 * repeated <= 50 * n and 5 * symbols <= n and 10 * upper <= 6 * letters:
            rows[i] = text
    groups = test_minhash_join.brute(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i][2]}
    hits = test_positional_index.brute(list(rows.items()), bench)
    rows = {i: t for i, t in rows.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    made = {}
    for i, text in rows.items():
        for a, b, _ in reversed(_merged(test_secret_scan.brute(text))):
            text = text[:a] + secret_scan.MARK + text[b:]
        made[i] = text
    return made


def _merged(spans):
    made = []
    for a, b, k in spans:
        if made and a < made[-1][1]:
            made[-1] = (made[-1][0], max(b, made[-1][1]), k)
        else:
            made.append((a, b, k))
    return made


def test_pipeline_matches_brute_force(spark, tmp_path):
    # a subset keeps the brute force short; its passages are those of the whole benchmark
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute_pipeline([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert 0 < len(expected) < docs.count()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = piece_lattice.load_pieces(piece_model())
    assert {r["doc_id"]: piece_lattice.decode_ids(pieces, r["ids"]) for r in rows} == expected
    assert all(r["n_chars"] == len(expected[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in rows)
    encoder = piece_lattice.Encoder(pieces)
    for r in rows[:5]:
        ids, best = encoder.encode(expected[r["doc_id"]])
        assert np.frombuffer(ids, np.int32).tolist() == r["ids"] and [b["score"] for b in best] == [b["score"] for b in r["nbest"]]


def test_pipeline_takes_odd_rows(spark, tmp_path):
    docs = odd_rows.documents(spark)
    bench = spark.createDataFrame([(1, "nothing like it")], "item_id bigint, text string")
    for number, frame in enumerate((docs, docs.limit(0))):
        folder = tmp_path / str(number)
        frame.write.parquet(str(folder / "documents.parquet"))
        bench.write.parquet(str(folder / "benchmark.parquet"))
        made = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, made, str(folder))
            assert made.columns == frame.columns, name
        result = corpus_pipeline.run(spark, str(folder))
        assert result.count() == (1 if number == 0 else 0)  # only the long text has 50 words
