import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaeflow.functions import vectors as V
from vitaeflow.operators import similarity as S


def brute(queries, chunks, k, per_candidate=False):
    """``{query: [(keys..., score)]}`` by scoring every pair."""
    out = {}
    for q, a in queries:
        scored = []
        for *key, b in chunks:
            if a is None or b is None or len(a) != len(b) or None in b:
                continue
            x, y = np.float32(a).astype(float), np.float32(b).astype(float)
            size = np.sqrt(x @ x) * np.sqrt(y @ y)
            if size > 0 and np.isfinite(size):
                scored.append((-round(float(x @ y / size), 9), tuple(key)))
        scored.sort()
        if per_candidate:
            seen, kept = set(), []
            for score, key in scored:
                if key[0] not in seen:
                    seen.add(key[0])
                    kept.append((score, key))
            scored = kept
        out[q] = [(*key, round(-score, 8)) for score, key in scored[:k]]
    return {q: hits for q, hits in out.items() if hits}


def run(search, spark, queries, chunks, k, **options):
    asked = spark.createDataFrame(queries, "query_id INT, vector ARRAY<FLOAT>")
    held = spark.createDataFrame(chunks, "RUN STRING, chunk_no INT, vector ARRAY<FLOAT>").repartition(5)
    out = {}
    for r in search(asked, held, k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["RUN"], r["chunk_no"], round(r["score"], 8)))
    return out


def random_sides(seed, n_queries=20, n_chunks=300, dimension=8):
    """Clustered vectors; a third of the chunks are copies of one vector, and odd ones are mixed in."""
    made = np.random.default_rng(seed)
    centres = made.normal(size=(6, dimension))
    near = lambda: (centres[made.integers(6)] + 0.3 * made.normal(size=dimension)).round(3).tolist()
    copy = near()
    chunks = [(f"r{made.integers(40):02d}", i, copy if i % 3 == 0 else near()) for i in range(n_chunks)]
    chunks += [("zero", 1, [0.0] * dimension), ("null", 1, None), ("short", 1, [1.0]), ("hole", 1, [None] + [1.0] * (dimension - 1)),
               ("nan", 1, [float("nan")] * dimension), ("inf", 1, [float("inf")] * dimension)]
    queries = [(i, near()) for i in range(n_queries)]
    queries += [(900, copy), (901, copy), (902, [0.0] * dimension), (903, None), (904, [2.0])]
    return queries, chunks


#: One block of queries, and many small ones.
BLOCKS = {"one block": {}, "many blocks": {"block_bytes": 100}}


@pytest.mark.parametrize("name", BLOCKS)
@pytest.mark.parametrize("per_candidate", [False, True])
def test_exact_search_matches_brute_force(spark, name, per_candidate):
    queries, chunks = random_sides(7)
    for k in (1, 2, 20) if name == "one block" else (2,):
        got = run(S.top_k, spark, queries, chunks, k, per_candidate=per_candidate, **BLOCKS[name])
        assert got == brute(queries, chunks, k, per_candidate)


def near_copies(kind, seed):
    """Chunks that differ from a query by 1e-6 to 1e-4, beside tiny, null and odd ones."""
    made = np.random.default_rng(seed)
    base = made.normal(size=6)
    chunks = [(f"r{i % 7}", i, (base + 10.0 ** made.uniform(-6, -4) * made.normal(size=6)).tolist()) for i in range(120)]
    chunks += [("a", 500, [1.0, 2e-5] + [0.0] * 4), ("b", 500, [1.0] + [0.0] * 5), ("null", 1, None), ("hole", 1, [None] * 6),
               ("tiny", 1, [1e-200 if kind == "DOUBLE" else 1e-30] + [0.0] * 5), ("short", 1, [1.0])]
    queries = [(i, (base + 10.0 ** made.uniform(-6, -4) * made.normal(size=6)).tolist()) for i in range(12)]
    return queries + [(100, [1.0] + [0.0] * 5), (101, [1e-200] + [0.0] * 5), (102, None)], chunks


@pytest.mark.parametrize("kind", ["FLOAT", "DOUBLE"])
@pytest.mark.parametrize("name", BLOCKS)
@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_rank_alike_on_every_path(spark, kind, name, seed):
    width = np.float32 if kind == "FLOAT" else np.float64
    queries, chunks = near_copies(kind, seed)
    asked = spark.createDataFrame(queries, f"query_id INT, vector ARRAY<{kind}>")
    held = spark.createDataFrame(chunks, f"RUN STRING, chunk_no INT, vector ARRAY<{kind}>").repartition(4)
    got = {}
    for r in S.top_k(asked, held, 3, **BLOCKS[name]).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["RUN"], r["chunk_no"], r["score"])
    for q, vector in queries:
        a = np.array(vector or [], width).astype(float)
        scored = []
        for *key, b in chunks:
            if b is not None and None not in b and len(b) == len(a):
                b = np.array(b, width).astype(float)
                lengths = np.sqrt(a @ a), np.sqrt(b @ b)
                if min(lengths) > 0:
                    scored.append((-round(float((a / lengths[0]) @ (b / lengths[1])), 9), *key))
        best = sorted(scored)[:3]
        hits = [got[q][i + 1] for i in range(len(best))] if best else []
        assert len(got.get(q, {})) == len(best)
        # a product may differ in its last bit from one library call to the next, hence by one unit after rounding
        assert all(abs(-b[0] - h[2]) <= 1.1e-9 for b, h in zip(best, hits))
        if q == 100:
            assert [(h[0], h[1]) for h in hits[:2]] == [("a", 500), ("b", 500)]


def test_ties_go_to_the_lower_key(spark):
    queries = [(1, [1.0, 0.0])]
    chunks = [("b", 0, [2.0, 0.0]), ("a", 5, [3.0, 0.0]), ("a", 2, [1.0, 0.0]), ("c", 0, [0.0, 1.0])]
    assert run(S.top_k, spark, queries, chunks, 2) == {1: [("a", 2, 1.0), ("a", 5, 1.0)]}
    assert run(S.top_k, spark, queries, chunks, 2, per_candidate=True) == {1: [("a", 2, 1.0), ("b", 0, 1.0)]}


def test_empty_sides(spark):
    queries, chunks = random_sides(5, 3, 10)
    for search in (S.top_k, S.top_k_hashed):
        assert run(search, spark, [(1, None)], chunks, 2) == {}
        assert run(search, spark, queries, [("r", 0, None)], 2) == {}


@pytest.mark.parametrize("per_candidate", [False, True])
def test_hashed_search(spark, per_candidate):
    """Found hits carry exact scores, every query gets its k, most are the true ones."""
    queries, chunks = random_sides(11, n_queries=30)
    got = run(S.top_k_hashed, spark, queries, chunks, 2, per_candidate=per_candidate)
    want = brute(queries, chunks, 2, per_candidate)
    assert got.keys() == want.keys()
    every = brute(queries, chunks, len(chunks))
    assert all(set(hits) <= set(every[q]) and len(hits) == len(want[q]) for q, hits in got.items())
    same = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert same >= 0.8 * sum(len(hits) for hits in want.values())


def test_hashed_search_falls_back_to_exact(spark):
    """With buckets this fine nothing but copies collides."""
    queries, chunks = random_sides(13, n_queries=10)
    assert run(S.top_k_hashed, spark, queries, chunks, 2, tables=1, width=62) == brute(queries, chunks, 2)


def test_chunk_vectors_are_not_shuffled(spark):
    queries, chunks = random_sides(5, 5, 20)
    asked = spark.createDataFrame(queries, "query_id INT, vector ARRAY<FLOAT>")
    held = spark.createDataFrame(chunks, "RUN STRING, chunk_no INT, vector ARRAY<FLOAT>")
    plan = S.top_k(asked, held, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :]


def test_cosine_of_a_pair(spark):
    pairs = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    made = spark.createDataFrame(list(enumerate(pairs)), "i INT, p STRUCT<a: ARRAY<FLOAT>, b: ARRAY<FLOAT>>")
    got = [r[0] for r in made.orderBy("i").select(F.round(V.cosine(F.col("p.a"), F.col("p.b")), 9)).collect()]
    assert got == [1.0, 0.0, None, None, None]


@pytest.mark.parametrize("search", [S.top_k, S.top_k_hashed])
def test_large_query_sides_do_not_pass_the_driver(spark, monkeypatch, search):
    queries, chunks = random_sides(17, n_queries=30)
    want = run(search, spark, queries, chunks, 2)
    # the hashed search sends its few queries without hits through the exact one, whose side is small
    monkeypatch.setattr(S, "_scan", lambda *args: pytest.fail("queries are collected"))
    assert run(search, spark, queries, chunks, 2, block_bytes=1) == want


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("tables", [0, 3])
def test_blocks_keep_the_best_of_all(monkeypatch, grouped, tables):
    """Many blocks, ties, and owners that span blocks, against sorting every pair."""
    monkeypatch.setattr(S, "FIRST_ROWS", 3)
    monkeypatch.setattr(S, "CHUNK_ROWS", 7)
    made = np.random.default_rng(3)
    matrix, unit = made.integers(-2, 3, (90, 4)).astype(float), made.integers(-2, 3, (20, 4)).astype(float)
    owners = np.sort(made.integers(0, 9, 90))
    held, asked = made.integers(0, 4, (90, 3)), made.integers(0, 4, (20, 3))
    for k in (1, 4, 30):
        row, column, score = S._searcher(k, grouped, tables)(unit, matrix, owners, asked, held)
        for q in range(len(unit)):
            pairs = sorted((-round(float(unit[q] @ matrix[c]), 9), c) for c in range(90) if not tables or (asked[q] == held[c]).any())
            if grouped:
                first = {}
                for pair in pairs:
                    first.setdefault(owners[pair[1]], pair)
                pairs = sorted(first.values())
            assert [(-s, c) for s, c in zip(score[row == q], column[row == q])] == pairs[:k]


def test_null_keys_come_first_among_ties(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id INT, vector ARRAY<FLOAT>")
    held = spark.createDataFrame([("a", 1, [1.0, 0.0]), (None, 2, [2.0, 0.0]), ("b", None, [3.0, 0.0])], "RUN STRING, chunk_no INT, vector ARRAY<FLOAT>")
    for size in (1, 100):
        hits = S.top_k(asked, held.coalesce(1), 2, block_bytes=size).orderBy("rank").collect()
        assert [(r["RUN"], r["chunk_no"]) for r in hits] == [(None, 2), ("a", 1)]


def test_products_in_single_precision_only_screen(monkeypatch):
    """Scores that single precision cannot tell apart are ranked by their doubles, among copies and many blocks."""
    monkeypatch.setattr(S, "FIRST_ROWS", 8)
    monkeypatch.setattr(S, "SINGLE_ROWS", 16)
    made, products = np.random.default_rng(5), []
    base = made.normal(size=26)
    matrix = base + 1e-5 * made.normal(size=(900, 26))
    matrix[300:340] = matrix[7]
    unit = np.concatenate((base + 1e-5 * made.normal(size=(30, 26)), made.normal(size=(30, 26))))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **given):
            plain = [np.asarray(x) for x in inputs]
            if ufunc is np.matmul:
                products.append(plain[0].dtype)
            return getattr(ufunc, method)(*plain, **given)

    for k in (1, 4, 50):
        row, column, score = S._searcher(k, False)(unit, matrix)
        exact = np.round(unit @ matrix.T, 9)
        for q in range(len(unit)):
            order = np.lexsort((np.arange(900), -exact[q]))[:k]
            assert column[row == q].tolist() == order.tolist()
            assert np.allclose(score[row == q], exact[q][order], atol=1.5e-9, rtol=0)
    # vectors that lie all round are multiplied in single precision only
    monkeypatch.setattr(S, "FIRST_ROWS", 1024)
    far = made.normal(size=(8000, 26))
    S._searcher(2, False)(unit[30:].view(Seen), far / np.linalg.norm(far, axis=1)[:, None])
    assert np.float64 not in products
