from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import odd_rows
from vitaeflow.llm import quality_rules as Q


def brute(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    upper = sum("A" <= c <= "Z" for c in text)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)),
            len(covered), upper, upper + sum("a" <= c <= "z" for c in text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "Ä", "x#", " ", "\n", "\t", "\x0c", "\x1f", "\xa0", "a b c ", "|"]), max_size=60))
def test_measures(parts):
    text = "".join(parts)
    assert Q.measure_text(text.encode()) == brute(text)


def test_odd_rows(spark):
    rows = Q.ledger(odd_rows.documents(spark)).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in rows) == sorted(
        (i or -1, len((t or "").split())) for i, t in odd_rows.TEXTS)
    assert all(r["failures"] & 1 for r in rows if r["n_words"] < 50)
    docs = odd_rows.documents(spark)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert Q.keep_good(docs, Q.Policy("all", ())).count() == docs.count()
    assert Q.ledger(odd_rows.no_documents(spark)).count() == 0


def test_ablations_follow_from_the_bits(spark):
    rows = Q.ledger(odd_rows.documents(spark))
    bits = [r["failures"] for r in rows.collect()]
    names = {rule.name: 1 << rule.bit for rule in Q.RULES}
    for r in Q.ablations(rows).collect():
        mask = next(p for p in Q.POLICIES if p.version == r["version"]).mask(Q.RULES)
        bit = names[r["rule"]]
        assert r["failing"] == sum(bool(b & bit) for b in bits)
        assert r["failing_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept_without"] == sum(b & (mask & ~bit) == 0 for b in bits)
    empty = Q.ablations(Q.ledger(odd_rows.no_documents(spark))).collect()
    assert empty and all(r["failing"] == r["kept_without"] == 0 for r in empty)
