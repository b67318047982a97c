"""HTML extraction: the reader on odd markup, the model against enumeration,
the texts against a plain reader of the test pages and on held-out layouts."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from quire.llm import html_text as ht
from quire.llm.dom import TEXT, parse
from quire.llm.queries import op11_html
from quire.llm.tree_model import Forest, Model, likelihood, marginals

SCHEMA = "page_id long, url string, html string, text string, `a.b` int"


def runs(source):
    page = parse(source)
    return [(page.tags[page.parents[i]], t) for i, t in enumerate(page.texts) if t is not None]


@pytest.mark.parametrize("source,want", [
    ("", []), ("plain &amp; simple", [("html", "plain & simple")]), ("a < b <3 &lt;p&gt;", [("html", "a < b <3 <p>")]),
    ("<p>one<p>two", [("p", "one"), ("p", "two")]), ("<p>a<br>b\n\t c&nbsp;d</p>", [("p", "a b c d")]),
    ("<p>b<b>ol</b>d</p>x", [("p", "bold"), ("html", "x")]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>",
                                                             [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [("td", "a"), ("td", "b"), ("td", "c")]),
    ("<script>var a='</p><p>no';</script><style>x</style><p>yes<script>if(a<b){}", [("p", "yes")]),
    ("<title>t</title><!-- <p>no</p> --><p>yes<!-- never ends <p>no", [("p", "yes")]),
    ("<!doctype html><?xml?><p a='>' b=\">\">x</p></p></div>y", [("p", "x"), ("html", "y")]),
    ("<p title='never ends>x</p><p>y</p>", [("p", "x"), ("p", "y")]), ("<p>x</p><p class=", [("p", "x")]),
    ("<P CLASS=A>x</P>", [("p", "x")]), ("<p>&#65;&#x42;&am &amp</p>", [("p", "AB&am &")]),
    ("<my-box>a</my-box><svg><text>no</text></svg><select><option>no</select>b", [("my-box", "a"), ("html", "b")]),
    ("<div>a<p>b</div>c", [("div", "a"), ("p", "b"), ("html", "c")]), ("<div/>a", [("html", "a")]),
    ("<!-->a<!--->b", [("html", "ab")]), ("</>a</ b>c", [("html", "ac")])])
def test_reader(source, want):
    assert runs(source) == want


def test_reader_on_long_and_deep_pages():
    assert len(parse("<div>" * 50_000 + "x").tags) == 50_002
    assert len(runs("<p a='" * 20_000)) <= 1 and len(runs("<a " * 200_000)) <= 1
    assert runs("<" * 100_000) == [("html", "<" * 100_000)]
    page = parse('<div class="mainMenu top_nav" id=Side hidden><a href=x>ab</a> cd</div>')
    assert page.names[1] == ("main", "menu", "top", "nav", "side", "hidden") and page.linked[2] == 2


def random_forest(rng, n, kinds, features):
    parent = np.array([-1 if i == 0 or rng.random() < 0.1 else rng.integers(0, i) for i in range(n)])
    rows, feats = np.nonzero(rng.random((n, features)) < 0.4)
    return Forest(parent, rng.integers(0, kinds, n), rows, feats, rng.random(len(rows)) + 0.1)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 9):
        forest = random_forest(rng, n, 3, 4)
        model = Model(rng.standard_normal(4), rng.standard_normal((3, 2, 2)))
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product([0, 1], repeat=n):
            y = np.array(y)
            s = (model.weights[forest.features] * forest.values * y[forest.rows]).sum()
            s += sum(model.edges[forest.kind[i], y[p], y[i]] for i, p in enumerate(forest.parent) if p >= 0)
            w = np.exp(s)
            total += w
            one += w * y
            for i, p in enumerate(forest.parent):
                if p >= 0:
                    both[i, y[p], y[i]] += w
        p, joint, log_z = marginals(forest, model)
        assert np.allclose(p, one / total) and np.allclose(joint, both / total) and np.isclose(log_z, np.log(total))


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    forest = random_forest(rng, 12, 2, 5)
    labels = rng.integers(0, 2, 12)
    w, e = rng.standard_normal(5), rng.standard_normal((2, 2, 2))
    _, gw, ge = likelihood(forest, labels, Model(w, e))
    for grad, x in ((gw, w), (ge, e)):
        for at in np.ndindex(x.shape):
            step = np.zeros_like(x)
            step[at] = 1e-6
            up, down = (likelihood(forest, labels, Model(w + s * step, e) if x is w else Model(w, e + s * step))[0]
                        for s in (1, -1))
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


@pytest.fixture(scope="module")
def from_layouts():
    return ht.fit()


def test_held_out_layouts(from_layouts):
    rng = random.Random(1234)
    right = total = 0
    for _ in range(200):
        source, written = ht.laid_out_page(rng)
        page = parse(source)
        want = ht.layout_labels(page, written)
        p = marginals(ht.forest_of([page], from_layouts[1]), from_layouts[0])[0]
        at = [i for i, t in enumerate(page.tags) if t == TEXT]
        assert len(at) and sum(c for _, c in written) >= want[at].sum() > 0
        right += ((p[at] >= 0.5) == want[at]).sum()
        total += len(at)
    assert right / total > 0.99


def test_a_page_of_its_own_kind(from_layouts):
    source = """<html><body><div id="cookieBanner"><p>We use cookies to make this site better for all.</p></div>
    <div class="topbar"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>
    <div class="story-body"><h1>A bridge opens</h1><p>The bridge over the river opened today, after three years
    of work &amp; delay.<p>It carries <a href=/t>trams</a>, bicycles and people on foot across the water.</div>
    <form class="newsletter"><p>Sign up for our letter, every week.</p><input></form>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I walked over it this morning, lovely.</p></div>
    </section><div class="sidebar"><h3>Popular</h3><ul><li><a href=/x>Ten walks</a></ul></div>
    <footer>© The paper</footer></body></html>"""
    assert ht.texts_of([parse(source)], *from_layouts)[0].split("\n") == [
        "A bridge opens", "The bridge over the river opened today, after three years of work & delay.",
        "It carries trams, bicycles and people on foot across the water."]


def plain_reader(source):
    """The test pages' article, cut at its p and h1 tags."""
    out = []
    for part in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", source, re.S)[1]):
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", part)).split())
        out += [text] if text else []
    return "\n".join(out)


def test_query_equals_plain_reader(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = sorted((r.page_id, r.url, t := plain_reader(r.html), len(t)) for r in rows)
    out = op11_html(spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r) for r in out.collect()) == want


def test_extract_edges(spark, monkeypatch):
    monkeypatch.setattr(ht, "LAYOUT_PAGES", 60)
    long = "<article><h1>Long</h1>" + "<p>words of a very long page that goes on.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "t", 1), (2, "u", "", "t", 1), (None, "u", "<p>", None, None), (3, "u", long, "t", 1),
            (3, "u", long, "t", 1), (4, "u", "<script>x", "t", 1), (5, "u", "\x00￾ &#0; <p>&#xD800;", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ht.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, None, 4)] == [""] * 4
    assert sorted(r.text.count("\n") for r in got if r.page_id == 3) == [20_000] * 2
    assert ht.extract(df.limit(0)).count() == 0
