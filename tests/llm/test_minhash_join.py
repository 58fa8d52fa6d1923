import random

import odd_rows
from vitaeflow.llm import minhash_join as M
from vitaeflow.llm.components import components


def sets_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute(texts):
    sets = {i: sets_of(t) for i, t in texts}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def near_copies(seed=1):
    """A hot group of near copies that shade into each other, exact copies, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = []
    for i in range(150):
        edited = list(base)
        for _ in range(rng.randint(0, 9)):
            edited[rng.randrange(200)] = word()
        texts.append(" ".join(edited))
    texts += [" ".join(base).upper()] * 30
    texts += [" ".join([word() for _ in range(100)] + passage) for _ in range(60)]
    texts += [" ".join(word() for _ in range(n)) for n in (1, 4, 5, 6)] * 2
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def result(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_groups_match_brute_force(spark, monkeypatch):
    texts = near_copies()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    expected = brute(texts)
    assert len({v[1] for v in expected.values()}) < len(texts) - 60
    assert result(M.near_duplicates(docs)) == expected
    monkeypatch.setattr(M, "BLOCK", 16)  # long lists are cut into pairs of blocks
    assert result(M.near_duplicates(docs)) == expected


def test_rows_that_share_an_id_are_told_apart(spark):
    """Whatever the order: links of a text are found under an id that others have too, and no clean text goes with it."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    bases = [[word() for _ in range(200)] for _ in range(8)]
    near = [" ".join(["x", *base[1:]]) for base in bases]
    texts = [" ".join(base) for base in bases]
    clean = [" ".join(word() for _ in range(50)) for _ in range(8)]
    rows = [(k, t) for k in range(8) for t in (clean[k], texts[k])[:: 1 if k % 2 else -1]]  # an id for two texts
    rows += [(100 + k, near[k]) for k in range(8)] + [(200, near[0]), (200, clean[0] + " more"), (300, texts[1]), (300, near[1]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {(r["doc_id"], r["component_id"]) for r in M.near_duplicates(docs).collect()}
    assert {(100 + k, k) for k in range(8)} <= found and (300, 1) in found
    kept = sorted(tuple(r) for r in M.keep_one(docs).collect())
    groups = [{texts[k], near[k]} for k in range(8)] + [{clean[0], clean[0] + " more"}] + [{t} for t in clean[1:]]
    assert len(kept) == len(groups) and all(sum(t in group for _, t in kept) == 1 for group in groups)
    assert all(i < 8 for i, _ in kept)


def test_similarity_is_a_parameter(spark):
    """Pairs between 0.80 and 0.85 are linked at 80 and not at 85."""
    import corpus_pipeline

    rng = random.Random(7)
    texts = []
    for k in range(0, 40, 2):
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        edited = list(base)
        for at in range(20, 20 + 30 * 6, 30):  # 6 edits touch 30 of 296 shingles: 266 / 326 = 0.816
            edited[at] = "x"
        texts += [(k, " ".join(base)), (k + 1, " ".join(edited))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert all(r["kept"] for r in M.near_duplicates(docs).collect())
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in M.near_duplicates(docs, 80).collect())
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(range(0, 40, 2))


def test_asked_agreements_follow_the_similarity():
    assert M.agreements_for(85) == M.Agreements(85, 43, 403)
    assert M.agreements_for(80) == M.Agreements(80, 38, 373)


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    a = [str(rng.random()) for _ in range(400)]
    b = a[:360] + [str(rng.random()) for _ in range(40)]
    x, y = (M.shingles(" ".join(t).encode(), M.WordHashes()) for t in (a, b))
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    (wide_x, all_x), (wide_y, all_y) = M.signature(x), M.signature(y)
    assert abs((all_x == all_y).mean() - true) < 0.08 and abs((wide_x == wide_y).mean() - true) < 0.2


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    rows = M.near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows.TEXTS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
    assert all(r["component_id"] == i and r["kept"] for i, r in by.items())
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert kept.count() == len(odd_rows.TEXTS) - 1
    assert M.near_duplicates(odd_rows.no_documents(spark)).count() == 0
    assert M.keep_one(odd_rows.no_documents(spark)).count() == 0


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 209)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def variants(n, words=200, changed=3, seed=12):
    """Texts that differ from one text in some words each: pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    texts = []
    for i in range(n):
        edited = list(base)
        for at in rng.sample(range(words), changed):
            edited[at] = f"x{rng.randrange(10**9)}"
        texts.append((i, " ".join(edited)))
    return texts


def rows_into_joins(spark, monkeypatch, n):
    """Rows of every table that the job writes down, largest of each name."""
    from vitaeflow.llm import common

    made, real = {}, common.write_down

    def counted(df, name):
        written = real(df, name)
        made[name] = max(made.get(name, 0), written.count())
        return written

    monkeypatch.setattr(M, "write_down", counted)
    docs = spark.createDataFrame(variants(n), "doc_id bigint, text string").repartition(4)
    found = result(M.near_duplicates(docs))
    monkeypatch.setattr(M, "write_down", real)
    return made, found


def test_rows_grow_linearly_with_a_group_of_near_copies(spark, monkeypatch):
    for n in (200, 800):
        made, found = rows_into_joins(spark, monkeypatch, n)
        assert {"pairs", "links", "members", "sets"} <= made.keys()
        # a text is posted under 22 pairs at most; what becomes rows is far from the group's n * n pairs
        assert all(rows <= 22 * n for rows in made.values()) and max(made["pairs"], made["links"]) <= 4 * n, made
        if n == 200:
            assert found == brute(variants(n))


def test_pairs_just_above_the_similarity_are_found(spark):
    """300 pairs between 0.85 and 0.87."""
    rng = random.Random(13)
    texts = []
    for k in range(0, 600, 2):
        base = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        edited = list(base)
        for at in range(10, 10 + 40 * 6, 40):  # 6 edits touch 30 of 400 shingles: 370 / 430 = 0.860
            edited[at] = "x"
        texts += [(k, " ".join(base)), (k + 1, " ".join(edited))]
    assert all(0.85 <= len(sets_of(a) & sets_of(b)) / len(sets_of(a) | sets_of(b)) <= 0.87 for (_, a), (_, b) in zip(texts[::2], texts[1::2]))
    found = result(M.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert sum(found[k + 1][1] == k for k in range(0, 600, 2)) >= 297
