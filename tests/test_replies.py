import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vitaeflow.fixed_values import FIELD_DEFAULT, RECORD_FIELDS
from vitaeflow.operators import extraction as E

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
KEY = "RUN del postulante"


def check(spark, replies, **options):
    rows = spark.createDataFrame(list(enumerate(replies)), "i INT, content STRING")
    made = E.extract_records(rows, **options).orderBy("i").collect()
    return [(r["error"], {f: r[f] for f in RECORD_FIELDS}) for r in made]


def expected(reply):
    """Accepted record, or None, by brute force."""
    if reply is None:
        return None
    text = reply.strip("`").replace("json", "").strip()
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last < 0:
        return None

    def no_constant(_):
        raise ValueError

    try:
        found = json.loads(text[first : last + 1], parse_constant=no_constant)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    record = {f: found.get(f, FIELD_DEFAULT) for f in RECORD_FIELDS}
    return record if all(isinstance(v, str) for v in record.values()) else None


def test_fixture_rows(spark):
    rejected = [
        ('{"Nombre":null}', "not text: Nombre"), ('{"Nombre":5}', "not text: Nombre"),
        ('{"Nombre":true,"Correo":["a"]}', "not text: Nombre, Correo"), ("[1]", "no JSON object in reply"),
        ("{bad", "no JSON object in reply"), ("{bad}", "invalid JSON"), ('{"Nombre":"a"} x {"b":2}', "invalid JSON"),
        ('{"Nombre":"a"},{"b":2}', "invalid JSON"), ('{"Nombre":"a"}] {}', "invalid JSON"),
        ('{"Nombre":"a"}} {}', "invalid JSON"), ('{"Nombre":"a"},"b":{}', "invalid JSON"), ("} {", "invalid JSON"),
        ("no braces", "no JSON object in reply"), ("", "no JSON object in reply"), (None, "no reply"),
        ('{"Nombre":"a",}', "invalid JSON"), ("{'Nombre':'a'}", "invalid JSON"),
    ]
    got = check(spark, [reply for reply, _ in rejected])
    assert [error for error, _ in got] == [error for _, error in rejected]
    assert all(set(record.values()) == {None} for _, record in got)


def test_accepted_rows(spark):
    default = dict.fromkeys(RECORD_FIELDS, FIELD_DEFAULT)
    accepted = [
        ("{}", {}), ('{"Nombre":"a","Nombre":"b"}', {"Nombre": "b"}), ('{"Nombre":"","otro":1}', {"Nombre": ""}),
        ('{"País":"CL"}', {"País": "CL"}), ('{"RUN":"1-9"}', {}), (f'{{"{KEY}":"1-9"}}', {KEY: "1-9"}),
        ('```json\n{"Nombre":"a"}\n```', {"Nombre": "a"}), ('x {"Nombre":"a","z":{"b":1}} y', {"Nombre": "a"}),
        ('{"Nombre":"experto json"}', {"Nombre": "experto "}), ('{"Nombre":"a\\u00e9\\n"}', {"Nombre": "aé\n"}),
    ]
    got = check(spark, [reply for reply, _ in accepted])
    assert got == [(None, {**default, **fields}) for _, fields in accepted]


def test_fence_only_keeps_the_word_in_values(spark):
    replies = ['```json\n{"Nombre":"experto json"}\n```', 'json {"Nombre":"json"}', '{"Nombre":"jsonl"}']
    assert [r["Nombre"] for _, r in check(spark, replies, fence_only=True)] == ["experto json", "json", "jsonl"]


values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab{}[]\"\\,:`é\n", max_size=6),
    lambda inner: st.lists(inner, max_size=2) | st.dictionaries(st.sampled_from(["a", "Nombre", "Correo"]), inner, max_size=2),
    max_leaves=4,
)
objects = st.dictionaries(st.sampled_from([*RECORD_FIELDS, "RUN", "x"]), values, max_size=4).map(json.dumps)
noise = st.text("ab{}[],:\"` \n1", max_size=6)
replies = st.one_of(objects, st.tuples(noise, objects, noise).map("".join), st.tuples(objects, noise, objects).map("".join),
                    st.text("{}[]\"a:,1 \n`", max_size=14))


@SLOW
@given(batch=st.lists(replies, min_size=50, max_size=120))
def test_matches_brute_force(spark, batch):
    for reply, (error, record) in zip(batch, check(spark, batch)):
        want = expected(reply)
        assert (error is None) == (want is not None), reply
        if want is not None:
            assert record == want, reply


def test_chat_replies(spark):
    bodies = [
        '{"choices":[{"message":{"content":"hola"}}],"usage":{"total_tokens":7}}', '{"choices":[],"usage":{"total_tokens":7}}',
        '{"choices":[{"message":{"content":"hola"}}]}', "not json", None,
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING")
    got = [(r["content"], r["total_tokens"], r["error"]) for r in E.read_chat_replies(rows).orderBy("i").collect()]
    assert got == [("hola", 7, None), (None, 7, "reply has no content"), ("hola", None, "reply has no token usage"),
                   (None, None, "reply has no content"), (None, None, "no reply")]


def test_embedding_replies(spark):
    bodies = ['{"data":[{"embedding":[1.5,-2]}],"usage":{}}', '{"data":[]}', None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING")
    got = [(r["vector"], r["error"]) for r in E.read_embedding_replies(rows).orderBy("i").collect()]
    assert got == [([1.5, -2.0], None), (None, "reply has no embedding"), (None, "no reply")]


def test_rejects_keep_the_reply(spark):
    rows = spark.createDataFrame([("x",), ('{"Nombre":"a"}',)], "content STRING")
    made = E.extract_records(rows)
    assert [r["content"] for r in E.rejected(made).collect()] == ["x"]
    assert [r["Nombre"] for r in E.accepted(made).collect()] == ["a"]
