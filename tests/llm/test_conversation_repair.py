"""Conversation repair against an enumeration of all repairs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import oracle
from vitaeflow.llm import conversation_repair as cr

SPACE = " \t\n\v\f\r"


def faults(rows):
    said, made = set(), []
    for _, role, text in rows:
        content = text.strip(SPACE)
        if not content:
            made.append("blank")
        elif (role, text) in said:
            made.append("duplicate")
        else:
            said.add((role, text))
            made.append("" if content[-1] in ".!?" else "truncated")
    return made


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def brute(rows):
    """The best of all repairs with at most two insertions before each row and at the end."""
    found = faults(rows)
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, found):
        more = 5 if fault == "truncated" else 0
        options = [("D", 2, None)]
        if fault in ("", "truncated"):
            options += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(options)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for plan in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(p[1] for p in plan) + 5 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            audit, made = "", []
            for (letter, _, kept), extra in zip(plan, added):
                audit += "I" * len(extra) + letter
                made += [(r, "") for r in extra] + ([kept] if kept else [])
            audit += "I" * len(added[-1])
            made += [(r, "") for r in added[-1]]
            if legal("".join(r[:1] or "?" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def report(rows):
    """What ``reports`` has to say of rows in order."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, made = brute(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def conversation(chance, length):
    rows = []
    for turn in range(length):
        role = chance.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
        text = chance.choice(["Yes.", "No!", "well", " ", "", "Why?\n", "Yes."])
        rows.append((None if chance.random() < 0.1 else turn * chance.choice([1, 2]), role, text))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repairs_match_enumeration(spark):
    chance = random.Random(3)
    made = {n: conversation(chance, n % 4) for n in range(60)}
    rows = [(n, *row) for n, all_rows in made.items() for row in all_rows]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in cr.reports(cr.repair(df)).collect()}
    assert got == {n: report(ordered(all_rows)) for n, all_rows in made.items() if all_rows}


def test_repaired_rows_read_as_asked(spark):
    chance = random.Random(4)
    rows = [(n, *row) for n in range(300) for row in conversation(chance, 25)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    edits = cr.repair(df)
    said = {}
    for r in sorted(cr.repaired(edits).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        said.setdefault(r["conv_id"], []).append(r)
    assert all(legal("".join(r["role"][0] for r in found)) for found in said.values())
    assert all([r["turn"] for r in found] == list(range(len(found))) for found in said.values())
    for r in cr.reports(edits).collect():
        whole = "\n".join(f"{x['role']}:{x['text']}" for x in said.get(r["conv_id"], []))
        assert r["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_giant_conversation_in_files_is_repaired_alike(monkeypatch):
    chance = random.Random(5)
    rows = [(t, role.encode(), b"%d " % chance.randrange(400) + text.encode()) for t, role, text in conversation(chance, 3000)]

    def run():
        conversation = cr.Conversation(1, cr.Steps())
        for row in rows:
            conversation.add(*row)
        return list(conversation.edits())

    whole = run()
    for name, value in (("HELD_BYTES", 2000), ("RECENT", 50), ("_BLOCK", 64), ("_LONGEST", 200)):
        monkeypatch.setattr(cr, name, value)
    assert run() == whole
    assert len(whole) >= 3000 and {e[2] for e in whole} >= {"K", "R", "D"}


def test_tables_of_best_repairs_are_few():
    steps, chance, table = cr.Steps(), random.Random(6), 0
    for _ in range(20_000):
        table, _, _ = steps.step(table, chance.randrange(4), chance.choice([-1, 1, 2, 3]))
    assert len(steps.tables) < 500


def test_digests_in_runs_are_found():
    said = cr.Said()
    digests = [hashlib.blake2b(b"%d" % n, digest_size=16).digest() for n in range(250_000)] + [b"a" * 15 + b"\0"]
    assert not any(map(said.again, digests)) and said.runs
    assert all(map(said.again, digests[::997])) and said.again(digests[-1])


def test_damage_follows_the_rule(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(8) for t in range(25)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {0: "", 1: "", 2: (text or " ").translate(str.maketrans("", "", ".!?"))}.get(kind, text or " ")
        row = (c, t, "user" if kind == 4 else role or " ", text, kind != 0)
        expected += [row] * (2 if kind == 3 else 1)
    key = str
    assert sorted((tuple(r) for r in cr.damaged(df).collect()), key=key) == sorted(expected, key=key)


def test_odd_rows(spark):
    names = "conv_id bigint, turn bigint, role string, text string, edit string, place string, present boolean, cost string"
    long = "x" * 3_000_000 + "."
    rows = [
        (1, None, None, None), (1, 1, "user", long), (1, 1, "user", long), (1, 2, "assistant", "fine."),
        (None, 5, "user", "hello."), (None, 6, "assistant", "yes."), (None, 6, "assistant", "yes."), (2, 1, "", "\x00é😀."),
    ]
    df = spark.createDataFrame([(*r, "own", "own", True, "own") for r in rows] + [(9, 1, "user", "gone.", "own", "own", False, "own")], names)
    got = {r["conv_id"]: r for r in cr.reports(cr.repair(df, "present")).collect()}
    assert got[1]["audit"] == "DKDK" and got[1]["duplicate"] == 1 and got[1]["blank"] == 1 and got[1]["gaps"] == 0
    assert got[None]["audit"] == "KKD" and got[2]["audit"] == "D"
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2]["repaired_sha256"] == empty and tuple(got[9])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert cr.reports(cr.repair(df.limit(0))).collect() == []


@pytest.mark.parametrize("nulls", [False, True])
def test_sql_agrees_on_odd_tables(spark, tmp_path, nulls):
    from vitaeflow.llm.registered import LLM_ORACLES, LLM_QUERIES

    chance = random.Random(7)
    rows = [(None if nulls and n % 9 == 0 else n, *(row if not nulls or chance.random() < 0.9 else (row[0], None, None)))
            for n in range(80) for row in conversation(chance, n % 12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = oracle.from_spark(LLM_QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == oracle.from_sql(con, LLM_ORACLES["op11_conversation_repair"])
