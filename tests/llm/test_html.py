import itertools
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from gridcast.llm import html, pages
from gridcast.llm.catalog import op1_html


@pytest.fixture(scope="module")
def model():
    return html.train(pages.labelled_pages(400))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    parents = [-1, 0, 0, 1, 1, 2, 5]
    depths = [0, 1, 1, 2, 2, 2, 3]
    tree = html.Tree(parents, depths, [0, 1, 2, 0, 1, 2, 0], [[f"tag:{i}"] for i in range(7)], [0] * 7, [])
    net = html.Model(rng.normal(0, 1, html.BUCKETS), rng.normal(0, 1, (3, 2, 2)))
    node, pair = html._Forest([tree, tree], {}).beliefs(net)
    weight = {}
    for x in itertools.product((0, 1), repeat=7):
        s = sum(net.weights[html.bucket(f"tag:{i}")] * x[i] for i in range(7))
        weight[x] = np.exp(s + sum(net.ties[tree.groups[i], x[parents[i]], x[i]] for i in range(1, 7)))
    total = sum(weight.values())
    for i in range(7):
        want = sum(w for x, w in weight.items() if x[i]) / total
        assert node[i] == pytest.approx(want) == pytest.approx(node[7 + i])
        if i:
            for a, b in itertools.product((0, 1), repeat=2):
                assert pair[i, a, b] == pytest.approx(sum(w for x, w in weight.items() if (x[parents[i]], x[i]) == (a, b)) / total)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<body><nav><ul><li><a href='/'>Home</a></ul></nav><main><h1>T</h1>Lead<p>one<p>two &lt;b&gt; &amp; &eacute;</main><footer>f</footer>", "T Lead one two <b> & é"),
        ("<header><h1>Site</h1></header><article><h2>A</h2><p>x <a href=y>link</a> <b>y</b>z<script>if (a<b) '</p>'</script></p><!-- <p>no</p> --><style>p{}</style></article><aside class='sidebar'><p>side</p></aside>", "A x link yz"),
        ("<div class='cookie-notice'><p>We use cookies</p></div><article><p>a\n\t b</p><div class='ad-box'><p>Buy</p></div><form><label>Mail</label><button>Go</button></form><p>c<br>d</p></article><section id='comments'><h3>Comments</h3><div class='comment'><p>Nice</p></div></section>", "a b c d"),
    ],
)
def test_regions(model, page, text):
    assert list(html.main_texts(model, [page])) == [text]


def test_unseen_labelled_pages(model):
    held = pages.labelled_pages(100, seed=77)
    exact = 0
    for page in held:
        tree = html.parse(page)
        exact += list(html.main_texts(model, [page])) == [" ".join(run for at, run in tree.runs if tree.labels[at])]
    assert exact >= 85


def test_batches_change_nothing(model, monkeypatch):
    held = pages.labelled_pages(30, seed=8)
    want = list(html.main_texts(model, held))
    monkeypatch.setattr(html, "AT_ONCE", 10)
    assert list(html.main_texts(model, held)) == want


@pytest.mark.parametrize("page", ["<" * 5000, "<p " + "a='" * 2000, "<div>" * 3000 + "x", "</p></div></x>y", "<!-- open", "<script>never closed", "&#xfffff; &#0; &bogus;", "\x00<p>\x00"])
def test_broken_markup_does_not_crash(model, page):
    assert len(list(html.main_texts(model, [page]))) == 1


def test_given_pages(spark, sf_dir, given):
    got = {r["page_id"]: r for r in op1_html(spark, sf_dir).collect()}
    rows = given("pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        bare = re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(a|b|i)\b", m[0]) else " ", inner)
        assert got[r["page_id"]]["text"] == " ".join(unescape(bare).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark, model):
    from pyspark.sql import functions as F

    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "u", long), (4, "u", "<p>a"), (4, "u", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "u", "h", "text", "n_chars"):
        df = df.withColumn(c, F.lit(0))
    got = sorted(map(tuple, html.extract(df, model).collect()), key=str)
    assert len(got) == 6 and (1, "u", "", 0) in got and (2, None, "", 0) in got and (None, "u", "x", 1) in got
    assert (3, "u", " ".join(["word word"] * 30_000), 30_000 * 10 - 1) in got
    assert html.extract(df.limit(0), model).count() == 0


TEXT = "The grey heron carried a long reed over the frozen river, and nobody in the village saw it leave at dawn that day."


@pytest.fixture(scope="module")
def trained():
    return html.train(pages.labelled_pages())


@pytest.mark.parametrize(
    "page, text",
    [
        (TEXT, TEXT),
        ("short text", "short text"),
        ("<p>one</p><p>two</p>", "one two"),
        (f"<body><p>{TEXT}</p><p>Second one.</p></body>", f"{TEXT} Second one."),
        (f'<div class="css-1x9"><div class="r2"><p>{TEXT}</p><p>And more of it.</p></div></div>', f"{TEXT} And more of it."),
        (f"<html><body><div><a href='/'>Home</a> <a href='/x'>News</a></div><div><div><p>{TEXT}</p><p>{TEXT}</p></div></div><div>&copy; 2024 <a href='/'>Site</a></div></body></html>", f"{TEXT} {TEXT}"),
        (f"<article><p>{TEXT}<script src=a.js/>var x = '<p>no</p>';</script></p></article>", TEXT),
        (f'<article><h1>T</h1><p>{TEXT}</p><ul class="comments"><li>Nice one</li><li>I disagree with this, it is wrong.</li></ul></article>', f"T {TEXT}"),
        (f'<article><p>{TEXT}</p><svg width=1/><p>after</p></article>', f"{TEXT} after"),
    ],
)
def test_pages_without_names_and_listed_comments(trained, page, text):
    assert list(html.main_texts(trained, [page])) == [text]


def test_unseen_nameless_pages(trained):
    """Held-out layouts without names: words found and words right, over all pages."""
    both = found = wanted = 0
    for page in pages.labelled_pages(150, seed=78, nameless=1.0):
        tree = html.parse(page)
        want, got = " ".join(run for at, run in tree.runs if tree.labels[at]).split(), next(html.main_texts(trained, [page])).split()
        shared = sum((Counter(want) & Counter(got)).values())
        both, found, wanted = both + shared, found + len(got), wanted + len(want)
    assert both / found > 0.97 and both / wanted > 0.97


def test_deep_trees_have_the_same_marginals(trained, monkeypatch):
    held = pages.labelled_pages(20, seed=9) + ["<div>" * 400 + TEXT]
    deep = list(html.main_texts(trained, held))
    monkeypatch.setattr(html, "DEEP", 1)
    assert list(html.main_texts(trained, held)) == deep and deep[-1] == TEXT
    monkeypatch.setattr(html, "DEEP", 10**9)
    assert list(html.main_texts(trained, held)) == deep
