"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves
(:mod:`quire.llm.dom`). Every node is content or not; potentials of nodes come
from tag, names, link density and lengths, potentials of edges join parent and
child; sum-product messages upward and downward give each run's content
marginal (:mod:`quire.llm.tree_model`). Runs of 0.5 or more are the text.

The model is trained from two kinds of labelled pages:

* pages of the corpus that mark up their main text themselves with exactly
  one ``article`` or ``main``: a sample of ``SAMPLE_PAGES`` of them (those with
  the smallest hashes, of at most ``SAMPLE_CHARS`` characters each);
* ``LAYOUT_PAGES`` pages laid out by rule (:func:`laid_out_page`) with menus,
  sidebars, notices, adverts, forms and reader comments.

The second kind and some of the first are also learned with semantic tags as
plain ``div`` and with names removed, so that no single hint decides.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.dom import TEXT, Page, parse
from quire.llm.tree_model import Forest, Model, marginals, train

SAMPLE_PAGES = 800
SAMPLE_CHARS = 100_000
LAYOUT_PAGES = 200
FULL_WEIGHT = 3
BATCH_CHARS = 1 << 22      # of pages scored as one forest
SEMANTIC = frozenset("article main nav aside header footer".split())


# ---------------------------------------------------------------- features --

def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value > e for e in edges)


_DENSITY = (0.02, 0.2, 0.5, 0.8)
_SHARE = (0.03, 0.15, 0.4, 0.75)


def features(page: Page) -> tuple[list[list[str]], list[float]]:
    """(names of the features that are set, their weight) of each node. Where an
    element has more than ``FULL_WEIGHT`` children of one run or none, these
    share that weight: a hundred small paragraphs are one hint, not a hundred."""
    n = len(page.tags)
    chars = [len(t) if t else 0 for t in page.texts]
    linked, runs = list(page.linked), [int(t is not None) for t in page.texts]
    titled = [t == "h1" for t in page.tags]
    times = Counter(page.tags)
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        titled[up] |= titled[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        runs[up] += runs[i]
    whole = max(chars[0], 1)
    small = Counter(page.parents[i] for i in range(1, n) if runs[i] <= 1)
    out, weights, before = [], [], 0
    for i in range(n):
        weight = 1.0
        if i and runs[i] <= 1:
            up = page.parents[i]
            weight = weights[up] if runs[up] <= 1 else min(1.0, FULL_WEIGHT / small[up])
        weights.append(weight)
        tag, size = page.tags[i], chars[i]
        density = _bin(linked[i] / size, _DENSITY) if size else 0
        length = min(size.bit_length(), 14)
        if tag == TEXT:
            text = page.texts[i]
            up = page.tags[page.parents[i]]
            end = text[-1]
            sentence = "s" if end in ".!?…\"”»)" else ":" if end in ":," else "n"
            words = min(text.count(" ") + 1, 12)
            own = [f"x {up}", f"x length {length}", f"x density {density}", f"x {up} density {density}",
                   f"x end {sentence}", f"x words {words}", f"x place {_bin(before / whole, (0.02, 0.2, 0.8, 0.98))}"]
            if "©" in text:
                own.append("x ©")
            before += size
        else:
            mean = (size // runs[i]).bit_length() if runs[i] else 0
            up = page.tags[page.parents[i]] if i else ""
            own = [f"e {tag}", f"e {tag} in {up}", f"e {tag} density {density}", *(f"n {w}" for w in page.names[i])]
            if runs[i] > 1:      # of a lone run the run itself tells the rest
                own += [f"e density {density}", f"e mean {mean}", f"e share {_bin(size / whole, _SHARE)}",
                        f"e runs {min(runs[i].bit_length(), 6)}"]
            if tag in SEMANTIC:
                own.append(f"e {tag} times {min(times[tag], 4)}")
            if titled[i]:
                own += ["e h1", f"e h1 {tag}"]
        out.append(own)
    return out, weights


def _kind(tag: str) -> str:
    return tag if tag == TEXT or tag in SEMANTIC else "list" if tag in ("ul", "ol", "li", "dl", "dd", "dt") else \
        "heading" if tag[0] == "h" and tag[1:].isdigit() else "p" if tag in ("p", "blockquote", "pre") else \
        "form" if tag in ("form", "fieldset", "label", "legend") else "other"


KINDS = {k: i for i, k in enumerate(["other", TEXT, "list", "heading", "p", "form", *sorted(SEMANTIC)])}


def forest_of(pages: list[Page], vocabulary: dict[str, int], grow: bool = False) -> Forest:
    """The pages as one forest; features outside the vocabulary are left out,
    or added to it if it is to ``grow``."""
    parent, kind, rows, feats, values, at = [], [], [], [], [], 0
    for page in pages:
        parent += [p + at if p >= 0 else -1 for p in page.parents]
        kind += [KINDS[_kind(t)] for t in page.tags]
        for i, (own, weight) in enumerate(zip(*features(page)), at):
            for name in own:
                f = vocabulary.setdefault(name, len(vocabulary)) if grow else vocabulary.get(name)
                if f is not None:
                    rows.append(i)
                    feats.append(f)
                    values.append(weight)
        at += len(page.tags)
    return Forest(*(np.array(v, dtype=np.int64) for v in (parent, kind, rows, feats)), np.array(values))


# ---------------------------------------------------------- labelled pages --

# fixed values: words of class names and ids, by what their elements hold
CONTENT_NAMES = ("article content post entry main story text body page article-body post-content entry-content "
                 "main-content story-body blog-post news-text").split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation top-nav main-menu breadcrumb breadcrumbs links site-nav topbar".split(),
    "header": "header masthead site-header branding logo banner page-header tagline".split(),
    "footer": "footer site-footer copyright legal bottom colophon imprint credits".split(),
    "side": "sidebar side widget related recommended popular trending tags archive more-stories teaser rail".split(),
    "notice": "notice cookie cookies consent alert popup modal overlay gdpr privacy-notice message warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox".split(),
    "form": "form search login signup subscribe newsletter contact-form poll".split(),
    "share": "share social sharing follow tools print buttons".split(),
    "comments": "comments comment reply replies discussion disqus respond comment-list feedback reader-comments".split(),
    "pager": "pager pagination pages next prev paging".split()}


def laid_out_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """(HTML, (text of each run, whether it is content)) of one page laid out
    at random: a main text of headings, paragraphs, lists, quotes and tables,
    among parts that are not."""
    runs: list[tuple[str, bool]] = []
    syllables = ["".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiouéöü") for _ in range(rng.randrange(1, 3)))
                 for _ in range(90)]

    def words(low: int, high: int, stop: str = "") -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
                        for _ in range(rng.randrange(low, high + 1))).capitalize() + stop

    def run(text: str, content: bool, inner: str | None = None) -> str:
        runs.append((text, content))
        return inner or text

    def link(low: int, high: int, content: bool = False) -> str:
        text = words(low, high)
        return run(text, content, f'<a href="/{rng.randrange(999)}">{text}</a>')

    def named(tag: str, names: list[str], inner: str) -> str:
        if rng.random() < (0.4 if names is CONTENT_NAMES else 0.2):
            return f"<{tag}>{inner}</{tag}>"
        attribute = rng.choice(["class", "class", "id"])
        more = " " + rng.choice(["clearfix", "row", "col", "wide", "box", "block"]) if rng.random() < 0.3 else ""
        return f'<{tag} {attribute}="{rng.choice(names)}{more}">{inner}</{tag}>'

    def paragraph(content: bool, low: int = 8, high: int = 90) -> str:
        text = words(low, high, rng.choice(".....!?"))
        parts = text.split(" ")
        inner = list(parts)
        if len(parts) > 6 and rng.random() < 0.3:
            k = rng.randrange(len(parts) - 2)
            mark = rng.choice(["b", "i", "em", "a"])
            inner[k] = f"<{mark}>{inner[k]}"
            inner[k + 1] += f"</{mark}>"
        return "<p>" + run(text, content, " ".join(inner)) + rng.choice(["</p>", "</p>", ""])

    def items(k: int, content: bool) -> str:
        rows = "".join("<li>" + (link(1, 4) if not content else run(t := words(3, 25, "."), True, t)) + "</li>"
                       for _ in range(k))
        return f"<ul>{rows}</ul>"

    def main() -> str:
        out = [f"<h1>{run(words(3, 10), True)}</h1>"]
        if rng.random() < 0.1:      # dialogue, verse
            out += [paragraph(True, 1, 6) for _ in range(rng.randrange(10, 60))]
        for _ in range(rng.randrange(1, 12)):
            roll = rng.random()
            if roll < 0.72:
                out.append(paragraph(True, rng.choice([2, 8, 20]), rng.choice([30, 90, 160])))
            elif roll < 0.8:
                out.append(f"<h2>{run(words(2, 8), True)}</h2>")
            elif roll < 0.87:
                out.append(items(rng.randrange(2, 6), True))
            elif roll < 0.92:
                out.append(f"<blockquote>{run(words(8, 40, '.'), True)}</blockquote>")
            elif roll < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{run(words(1, 4), True)}</td>" for _ in range(3))
                           + "</tr></table>")
            elif roll < 0.98:
                out.append(other("advert"))
            else:
                out.append(other("share"))
        return "".join(out)

    def other(what: str) -> str:
        tag, names = "div", OTHER_NAMES[what]
        if what == "menu":
            tag, inner = rng.choice(["nav", "nav", "div", "div"]), items(rng.randrange(2, 9), False)
        elif what == "header":
            tag = rng.choice(["header", "div"])
            inner = rng.choice([f"<h2>{link(1, 3)}</h2>", run(words(1, 6), False), paragraph(False, 3, 10)])
        elif what == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            inner = rng.choice([run("© " + words(2, 12, "."), False), paragraph(False, 4, 25),
                                items(rng.randrange(2, 6), False)])
        elif what == "side":
            tag = rng.choice(["aside", "div", "section"])
            inner = f"<h3>{run(words(1, 3), False)}</h3>" + rng.choice(
                [items(rng.randrange(3, 8), False), paragraph(False, 6, 30), f"<p>{link(4, 12)}</p>"])
        elif what == "notice":
            tag, inner = rng.choice(["div", "section", "dialog"]), paragraph(False, 8, 40)
        elif what == "advert":
            tag, inner = rng.choice(["div", "aside"]), rng.choice([paragraph(False, 3, 25), run(words(3, 20, "."), False)])
        elif what == "form":
            tag, inner = "form", f"<label>{run(words(1, 4), False)}</label><input name='q'>" + rng.choice(
                ["", paragraph(False, 4, 18)])
        elif what == "share":
            inner = items(rng.randrange(2, 5), False)
        elif what == "comments":
            tag = rng.choice(["section", "div", "ol"])
            inner = f"<h3>{run(words(1, 3), False)}</h3>" + "".join(
                named(rng.choice(["div", "article", "li"]), OTHER_NAMES[what],
                      rng.choice([f"<p>{run(words(1, 2), False)}</p>", ""]) + paragraph(False, 4, 70))
                for _ in range(rng.randrange(1, 6)))
        else:
            inner = link(1, 2) + " " if rng.random() < 0.5 else f"<span>{run(words(1, 3), False)}</span>"
        return named(tag, names, inner)

    parts = [other(w) for w in ("notice", "header", "menu", "advert", "form") if rng.random() < 0.55]
    body = named(rng.choice(["article", "article", "main", "div", "div", "section"]), CONTENT_NAMES, main())
    if rng.random() < 0.4:
        body = named(rng.choice(["div", "section", "main"]), ["wrapper", "container", "content", "page", "layout"], body)
    parts.append(body)
    parts += [other(w) for w in ("share", "pager", "comments", "side", "advert", "form", "notice", "footer")
              if rng.random() < 0.45]
    inner = "".join(parts)
    if rng.random() < 0.2:
        inner = named("div", ["wrapper", "container", "site", "outer"], inner)
    if rng.random() < 0.05:
        inner = f"<form>{inner}</form>"
    title = words(2, 8)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{inner}"
            f"<script>var a='<p>';</script></body></html>"), runs


def layout_labels(page: Page, runs: list[tuple[str, bool]]) -> np.ndarray:
    """Labels of a laid-out page's nodes: its runs come in the order written."""
    wanted = iter(runs)
    found = {}
    for i, text in enumerate(page.texts):
        if text is not None:
            for written, content in wanted:
                if written == text:
                    found[i] = content
                    break
                if text.startswith(written):      # neighbours read as one run
                    found[i] = content
    return spread_labels(page, found)


def markup_labels(page: Page) -> np.ndarray | None:
    """Labels from a page's own markup, none unless exactly one ``article`` or
    ``main`` holds text: runs inside are content, but for those in a nested
    ``nav``, ``aside``, ``footer`` or ``form``."""
    inside, tops = [], []
    for i, tag in enumerate(page.tags):
        up = page.parents[i]
        state = inside[up] if up >= 0 else 0
        if tag in ("article", "main"):
            if not state:
                tops.append(i)
            state = max(state, 1)
        elif tag in ("nav", "aside", "footer", "form") and state:
            state = 2
        inside.append(state)
    found = {i: inside[i] == 1 for i, t in enumerate(page.texts) if t is not None}
    if len(tops) != 1 or not any(found.values()) or all(found.values()):
        return None
    return spread_labels(page, found)


def spread_labels(page: Page, runs: dict[int, bool]) -> np.ndarray:
    """Labels of all nodes: an element is content if most of its characters are."""
    balance = [0] * len(page.tags)
    for i, content in runs.items():
        balance[i] = len(page.texts[i]) if content else -len(page.texts[i])
    for i in range(len(page.tags) - 1, 0, -1):
        balance[page.parents[i]] += balance[i]
    return np.array([b > 0 for b in balance], dtype=np.int64)


def _same(page: Page) -> Page:
    return page


def _plain(page: Page) -> Page:
    return Page(["div" if t in SEMANTIC else t for t in page.tags], page.parents, page.names, page.texts, page.linked)


def _nameless(page: Page) -> Page:
    return Page(page.tags, page.parents, [()] * len(page.tags), page.texts, page.linked)


def fit(marked_up: Iterable[str] = (), layouts: int | None = None, seed: int = 0) -> tuple[Model, dict[str, int]]:
    """(model, vocabulary) from pages that mark up their main text and from
    laid-out pages."""
    rng = random.Random(seed)
    pages, labels = [], []

    def add(page: Page, y: np.ndarray, *variants) -> None:
        for variant in variants:
            pages.append(variant(page))
            labels.append(y)

    for source in marked_up:
        page = parse(source)
        y = markup_labels(page)
        if y is not None:
            add(page, y, _same, *([_plain, _nameless] if len(pages) % 8 == 0 else []))
    for _ in range(LAYOUT_PAGES if layouts is None else layouts):
        source, runs = laid_out_page(rng)
        page = parse(source)
        add(page, layout_labels(page, runs), _same, _plain, _nameless)
    vocabulary: dict[str, int] = {}
    forest = forest_of(pages, vocabulary, grow=True)
    return train(forest, np.concatenate(labels), len(vocabulary), len(KINDS)), vocabulary


# ---------------------------------------------------------------- operator --

def texts_of(pages: list[Page], model: Model, vocabulary: dict[str, int], least: float = 0.5) -> list[str]:
    """Main texts: runs whose content marginal is ``least`` or more."""
    p = marginals(forest_of(pages, vocabulary), model)[0]
    out, at = [], 0
    for page in pages:
        out.append("\n".join(t for i, t in enumerate(page.texts) if t is not None and p[at + i] >= least))
        at += len(page.tags)
    return out


def training_sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """A bounded sample of the pages that hold an ``article`` or ``main``: those
    with the smallest hashes, equal pages once. The hashes are chosen first, so
    tasks send numbers to the driver, and pages only when they are chosen."""
    fit_for_it = pages.select(F.col(html_col).cast("string").alias("html")) \
        .where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS)) \
        .select("html", F.xxhash64("html").alias("h"))
    last = fit_for_it.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r[0] for r in fit_for_it.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html"))
            .orderBy("h").select("html").collect()]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the runs of the main text,
    white space collapsed, one a line.

    Edge cases: a null or empty page, and one without main text, has the empty
    text; page_id and url may be null; repeated rows stay repeated; an empty
    table gives an empty result; other columns are not read. Broken markup is
    read as :func:`quire.llm.dom.parse` says; a page is always read whole."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(training_sample(pages, html_col)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value
        for b in batches:
            texts: list[str] = []
            some, held = [], 0
            for source in b.column("html").to_pylist():
                some.append(parse(source))
                held += len(source)
                if held >= BATCH_CHARS:
                    texts += texts_of(some, model, vocabulary)
                    some, held = [], 0
            if some:
                texts += texts_of(some, model, vocabulary)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
