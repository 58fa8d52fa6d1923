import itertools
import re

import numpy as np
import pytest

from vitaeflow.llm import dom
from vitaeflow.llm import html_extraction as H


def runs(source):
    page = dom.read_page(source)
    return [text for _, text in sorted(page.texts.items())]


@pytest.mark.parametrize("source, expected", [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b", ["a", "b"]), ("<b>x<i>y</b>z</i>", ["xyz"]),
    ("<p>a<br>b  \n c</p>", ["a b c"]), ("<script>var t='</p>';<p></script>k", ["k"]), ("<style>p{}</style><!-- <p>n --><p>y", ["y"]),
    ("<head><title>t</title><meta x></head><p>y", ["y"]), ("<head><meta x><body><p>y", ["y"]), ("<p title='a>b'>q</p>", ["q"]),
    ("<a href='x>y</a>z", ["yz"]), ("1 < 2 <", ["1 < 2 <"]), ("<p", []), ("</p></div>a", ["a"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<svg><text>n</text></svg>y<textarea>n", ["y"]),
    ("first line<br>second<BR/>line", ["first line second line"]), ("<p>a <math><mi>x</mi>=1</math> b", ["a x=1 b"]),
    ("<p>a<svg><path d=1>x<p>rest", ["a", "rest"]), ("a<svg>x</svg>b<svg>y<div>c", ["ab", "c"]), ("a<svg>x", ["a"]),
    ("&#233;&eacute;&copy &bogus;", ["éé© &bogus;"]), ("<!DOCTYPE html><?x ?>a", ["a"]), ("<div" * 3, []),
])
def test_reading(source, expected):
    assert runs(source) == expected


def test_long_and_deep_pages_are_read():
    assert len(runs("<p>word</p>" * 20_000)) == 20_000
    assert runs("<div>" * 3000 + "x") == ["x"]
    assert runs("<a href='" * 3000) == []
    assert runs("<svg>x<p>y" * 5000) == ["y"] * 5000


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    pages = [dom.read_page("<div><p>a b<a>c</a></p><ul><li>d</li></ul></div>"), dom.read_page("<p>x"), dom.read_page("")]
    model = H.Model(rng.normal(size=len(dom.FEATURES)), rng.normal(size=(2, 2, 2)))
    trees = H.forest(pages)
    got, joint, total = H.marginals(trees, model)
    alone = trees.features @ model.weight
    n = len(alone)
    weights, chances = [], np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        value = sum(alone[i] for i in range(n) if labels[i])
        value += sum(model.fit[trees.edge[i], labels[trees.parent[i]], labels[i]] for i in range(n) if trees.parent[i] >= 0)
        weights.append(np.exp(value))
        chances += weights[-1] * np.array(labels)
    assert np.allclose(got, chances / sum(weights)) and np.isclose(total, np.log(sum(weights)))
    assert np.allclose(joint[trees.parent >= 0].sum((1, 2)), 1) and np.allclose(joint[trees.parent >= 0][:, :, 1].sum(1), got[trees.parent >= 0])


def article(source):
    """The text of the pages' article by their own plain markup."""
    import html

    found = re.search(r"<article>(.*?)(?:</article>|$)", source, re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)[^>]*>", found[1]) if found else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_articles_are_extracted(spark, pages):
    model = H.train(pages.where("page_id % 2 = 0"))
    rows = H.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    assert sum(r["text"] == article(r["html"]) for r in rows) >= 0.98 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    unseen = """<html><body><header><a href=/>Home</a></header><div class="content"><h2>Head</h2><p>This is a long paragraph of
    the story, and it goes on.</p><div class="comments"><p>Nice post, thanks a lot for it!</p></div><aside><p>Related stories to read
    today.</p></aside><p>Second paragraph of text.</p><form><p>Sign up here</p></form></div><div class="cookie-notice">We use cookies.
    </div><footer>c 2024</footer></body></html>"""
    kept = [t.split()[0] for t, chance in H.chances([dom.read_page(unseen)], model)[0] if chance > 0.5]
    assert kept == ["Head", "This", "Second"]


def test_copies_do_not_change_what_is_learned(spark, pages, monkeypatch):
    some = pages.limit(60).cache()
    alone = H.train(some)
    copies = some.crossJoin(spark.range(40)).repartition(7)
    for model in (H.train(copies), H.train(some.unionByName(pages.limit(1).crossJoin(spark.range(3000)).drop("id")).repartition(3))):
        assert np.allclose(model.weight, alone.weight) and np.allclose(model.fit, alone.fit)
    assert not np.allclose(alone.weight, H.built_in().weight)


def test_a_very_long_page_comes_through_spark(spark):
    body = "".join(f"<p>Paragraph {i} of the long article goes on and on, as it has much to say.</p>" for i in range(30_000))
    page = spark.createDataFrame([(1, "u", f"<html><body><nav>Menu</nav><article>{body}</article></body></html>")], "page_id bigint, url string, html string")
    text = H.extract(page, H.built_in()).first()["text"]
    assert text.count("\n") == 29_999 and text.endswith("Paragraph 29999 of the long article goes on and on, as it has much to say.")


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "u", "<p>y"), (3, "u", "<p>y")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("own").alias("text"), F.lit(1).alias("x"))
    for model in (H.train(pages), H.train(pages.limit(0)), H.train(pages.where("page_id = 3"))):
        got = H.extract(pages, model).collect()
        assert len(got) == 5 and all(r["text"] is not None for r in got)
        assert all(r["text"] == "" for r in got if r["page_id"] in (1, 2))
    assert H.extract(pages.limit(0), H.built_in()).count() == 0
