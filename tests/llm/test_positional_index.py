import random

import pytest

import odd_rows
from vitaeflow.llm import positional_index as P


def brute(docs, items, size=P.WINDOW, slop=0):
    """Every run of words of every document, looked up among the windows or, with slop, compared one by one."""
    windows = {}
    for name, item in items:
        for window in P.windows_of(P.words_of((item or "").encode()), size):
            windows.setdefault(window, set()).add("null" if name is None else str(name))
    found = {}
    for i, text in docs:
        words = P.words_of((text or "").encode())
        hit, items_of = set(), set()
        if slop:
            pairs = [(w, s) for w in windows for s in range(len(words) - len(w) + 1) if near(words, w, s, slop)]
        else:
            runs = ((tuple(words[s : s + n]), s) for n in {len(w) for w in windows} for s in range(len(words) - n + 1))
            pairs = [(w, s) for w, s in runs if w in windows]
        for window, s in pairs:
            hit |= set(range(s, s + len(window)))
            items_of |= windows[window]
        found[i] = (len(words), len(hit), sorted(items_of))
    return found


def near(words, window, s, slop):
    """By the definition alone: every term stands in the document within ``slop`` of its place in the run from ``s``."""
    return all(any(0 <= s + k + d < len(words) and words[s + k + d] == w for d in range(-slop, slop + 1)) for k, w in enumerate(window))


def tables(spark, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("aa bb cc Dd éé ff7 g".split())
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "a-b_c")]
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 7)))) for k in range(12)] + [(12, None), (None, "aa bb cc"), (3, "ff7 g g")]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def answers(found):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in P.judge(found).collect()}


def test_phrases_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_WORDS", 100)
    docs, items, d, b = tables(spark)
    index = P.build(d.repartition(3))
    assert index.count() > 3
    expected = brute(docs, items, 4)
    assert answers(P.search(index, b, size=4)) == expected
    monkeypatch.setattr(P, "QUERY_BYTES", 40)  # several groups of queries
    assert answers(P.search(index, b, size=4)) == expected


@pytest.mark.parametrize("words,tasks", [(1 << 18, 1), (100, 1), (30, 3), (1, 4)])
def test_proximity_matches_brute_force(spark, monkeypatch, words, tasks):
    monkeypatch.setattr(P, "BLOCK_WORDS", words)
    docs, items, d, b = tables(spark, 5)
    for slop in (1, 2):
        assert answers(P.search(P.build(d.repartition(tasks)), b, size=3, slop=slop)) == brute(docs, items, 3, slop=slop)


def test_blocks_do_not_decide_matches(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    docs = spark.createDataFrame([(0, "a x b x c"), (1, "a a c c"), (2, "a b y"), (3, "c z z"), (4, "c b a")], "doc_id bigint, text string")
    for n in (1, 2, 5):
        got = answers(P.search(P.build(docs.repartition(n)), bench, slop=1))
        assert {i: v[1] for i, v in got.items()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0}


def test_fifty_groups_of_queries_and_equal_texts(spark, monkeypatch):
    docs, items, d, b = tables(spark, 8)
    items += [(100 + k, f"aa bb w{k}") for k in range(150)] + [(300 + k, "aa bb cc Dd") for k in range(40)]
    docs += [(200 + k, f"x aa bb w{k} y") for k in range(0, 150, 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    whole = answers(P.search(P.build(d), b, size=4))
    assert whole == brute(docs, items, 4)
    monkeypatch.setattr(P, "QUERY_BYTES", 100)
    groups, _ = P.query_groups(b, 4)
    assert groups >= 40 and answers(P.search(P.build(d), b, size=4)) == whole


def test_a_clean_text_stays_beside_a_contaminated_one(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "one two three"), (7, "clean"), (None, "one two three"), (None, "fine"), (8, None)], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in P.clean(docs, bench).collect()), key=str) == [(7, "clean"), (8, None), (None, "fine")]


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    bench = spark.createDataFrame([(1, "the same row twice in this table"), (2, None), (3, "")], "item_id bigint, text string")
    found = P.judge(P.search(P.build(docs), bench))
    rows = found.collect()
    assert len(rows) == len(odd_rows.TEXTS)
    assert sorted(r["doc_id"] for r in rows if r["contaminated"]) == [5, 5]
    left = P.clean(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 0
    assert left.count() == len(odd_rows.TEXTS) - 2
    assert P.search(P.build(odd_rows.no_documents(spark)), bench).count() == 0
    assert P.clean(docs, bench.limit(0)).count() == docs.count()


def test_nothing_is_shuffled(spark):
    _, _, d, b = tables(spark)
    plan = P.search(P.build(d), b)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
