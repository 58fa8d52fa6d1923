import random

import numpy as np
import pytest

import odd_rows
from pyspark.sql import functions as F
from vitaeflow.llm import piece_lattice as P
from vitaeflow.llm.registered import piece_model

TEXTS = ["", "a", " ", "  a  b", "é😀", "\n\n", "foo\tbar", "Hello world  again", "▁ ▁", "Die Straße\nist naß.", "x" * 60, "aaaaaaaa bbbb aaaa"]


@pytest.fixture(scope="module")
def pieces():
    return P.load_pieces(piece_model())


def choices(encoder, text):
    ids, best = encoder.encode(text)
    ids = np.frombuffer(ids, np.int32).tolist()
    return [(b["score"], P.apply_edits(ids, b["edits"])) for b in best]


def small(words):
    """A vocabulary of a few pieces with given scores."""
    tree = P.piece_tree({text: (score, i + 256) for i, (text, score) in enumerate(words.items())})
    return P.Pieces(tree, tuple(range(256)), -20.0, tuple(bytes([i]) for i in range(256)) + tuple(t.encode() for t in words))


def node_of(pieces, text):
    """Score and id of a piece, if there is one."""
    branches, found = pieces.tree, None
    for character in reversed(text):
        if character not in branches:
            return None
        branches, *found = branches[character]
    return found if found[1] >= 0 else None


def every(pieces, text):
    """All segmentations with their scores."""
    if not text:
        return [(0.0, [])]
    found = []
    for k in range(1, len(text) + 1):
        entry = node_of(pieces, text[:k])
        if entry:
            found += [(entry[0] + s, [entry[1], *ids]) for s, ids in every(pieces, text[k:])]
        elif k == 1:
            found += [(pieces.unknown + s, [*text[0].encode(), *ids]) for s, ids in every(pieces, text[1:])]
    return found


def test_best_segmentations_match_enumeration():
    pieces = small({" ": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "aba": -4.2, " a": -3.5, " ab": -4.0, "ba": -3.3, "bb": -5.5})
    rng = random.Random(2)
    for n in (1, 2, 5, 40):
        encoder = P.Encoder(pieces, n)
        for _ in range(60):
            text = "".join(rng.choice("aab bz") for _ in range(rng.randint(0, 7)))
            scores = sorted((round(s, 9) for s, _ in every(pieces, " " + text) if text), reverse=True)[:n] or [0.0]
            got = choices(encoder, text)
            assert [round(s, 9) for s, _ in got] == scores
            assert [round(s, 9) for s, _ in P.nbest(pieces, " " + text if text else "", n)] == scores
            assert len({tuple(ids) for _, ids in got}) == len(got)
            assert all(P.decode_ids(pieces, ids) == text for _, ids in got)


def test_words_give_what_the_whole_lattice_gives(pieces):
    encoder = P.Encoder(pieces, 4)
    for text in TEXTS:
        whole = P.nbest(pieces, " " + text if text else "", 4)
        got = choices(encoder, text)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in whole]
        assert all(P.decode_ids(pieces, ids) == text for _, ids in got)


def test_library_gives_the_same(pieces):
    """The library's own search, over the same vocabulary made a unigram model with the same scores."""
    sentencepiece = pytest.importorskip("sentencepiece")
    format_of = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = format_of.ModelProto()
    with open(piece_model(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = node_of(pieces, piece.piece.replace("▁", " "))[0]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: round(sum(model.pieces[i].score for i in ids if model.pieces[i].type == 1), 3)
    encoder = P.Encoder(pieces, 4)
    for text in TEXTS[1:]:
        if "▁" in text or " " == text or "x" * 9 in text:
            continue  # the library takes that mark for a space
        ours = [ids for _, ids in choices(encoder, text)]
        theirs = library.nbest_encode_as_ids(text, 4)
        assert [score(i) for i in theirs] == [score(i) for i in ours]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "_HELD_BYTES", 5000)
    monkeypatch.setattr(P, "_LIST_BYTES", 5000)
    docs = odd_rows.documents(spark)
    shared = P.shared_pieces(spark, piece_model())
    rows = P.encode(docs, shared, name="coded").select("doc_id", "text", F.col("coded.ids").alias("i"), "coded.nbest")
    back = P.decode(rows, shared, "i", "back")
    got = back.collect()
    assert len(got) == len(odd_rows.TEXTS)
    assert all(r["back"] == r["text"] and (r["i"] is None) == (r["text"] is None) for r in got)
    assert P.encode(odd_rows.no_documents(spark), shared).count() == 0
    monkeypatch.setattr(P, "_SLICE", 100)
    checked = P.encode(docs, shared, name="coded", checked=True).select("doc_id", "text", "coded.*").collect()
    assert sorted((str(r["text"]), r["ids"] or [], r["decodes"]) for r in checked) == sorted((str(r["text"]), r["i"] or [], True) for r in got)


def test_words_side_by_side_give_what_each_gives_alone(pieces):
    rng = random.Random(8)
    words = {"".join(rng.choice("abceilnorst é😀ß\u07ff\u0800中\n") for _ in range(rng.randint(1, P._SHORT))) for _ in range(400)}
    words |= {" the", " of", "x", " " * P._SHORT, "\U0010ffff", "\x7f\x80"}
    words = list(words)
    scores, extra, counts, ids = P.many_first_choices(P.Nodes(pieces), words)
    ends = counts.cumsum().tolist()
    alone = dict(zip(sorted(words), P.first_choices(pieces, sorted(words))))
    for k, word in enumerate(words):
        assert (scores[k], extra[k], ids[ends[k] - counts[k] : ends[k]].tolist()) == alone[word], word


def test_remembered_words_are_bounded_by_bytes(pieces, monkeypatch):
    monkeypatch.setattr(P, "_HELD_BYTES", 200_000)
    monkeypatch.setattr(P, "_LIST_BYTES", 50_000)
    monkeypatch.setattr(P, "_GROUP", 2000)
    rng, encoder, most = random.Random(9), P.Encoder(pieces), [0, 0]
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(8)) for _ in range(100)) for _ in range(100)]
    for text, (ids, _) in zip(texts, encoder.encode_all(texts)):
        assert P.decode_ids(pieces, np.frombuffer(ids, np.int32).tolist()) == text
        most = [max(most[0], encoder.held), max(most[1], encoder.held_lists)]
    # beyond the bound by what one group of texts adds at most
    assert 100_000 < most[0] < 400_000 and most[1] < 100_000


def test_ids_that_are_no_text_decode_with_marks(spark, pieces):
    shared = P.shared_pieces(spark, piece_model())
    ids = [[pieces.byte_ids[b] for b in data] for data in (b" \xff\xfe", b" a\xc3", b" ok")]
    df = spark.createDataFrame([(0, None), (1, []), *((k, x) for k, x in enumerate(ids, 2))], "k int, ids array<int>").coalesce(1)
    got = {r["k"]: r["text"] for r in P.decode(df, shared).collect()}
    assert got == {0: None, 1: "", 2: "\ufffd\ufffd", 3: "a\ufffd", 4: "ok"}
