"""Line-block extraction: the curve against a plain version, parts of pages, and whole tables with and without article marks."""

import html as entities
import itertools
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import op06_extract as extract
from quernstone.llm.op06_extract import extract_main, main_text, text_stretches
from quernstone.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = " ".join(["word"] * 60)
MENU = "<p><a href=x>menu item</a></p>" * 40
SHORT = "".join(f"<p>line {i} ok</p>" for i in range(8))


def plain_stretches(weights, window):
    """The rule of text_stretches, by the definition."""
    n = len(weights)
    windows = [set(range(i, i + window)) for i in range(n - window + 1)] or [set(range(n))]
    total = lambda w: sum(weights[i] for i in w)
    low = set().union(*(w for w in windows if not total(w)))
    found = []
    for high, group in itertools.groupby(range(n), key=lambda i: i not in low):
        own = list(group)
        heavy = [i for i in own if weights[i]]
        if high and heavy:
            found.append((heavy[0], heavy[-1] + 1, max(total(w) for w in windows if w & set(own))))
    return found


def test_the_curve_against_a_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        weights = [int(x) for x in rng.choice([0, 3, 60, 200], int(rng.integers(0, 16)), p=[0.6, 0.2, 0.1, 0.1])]
        window = int(rng.integers(1, 5))
        assert text_stretches(weights, window) == plain_stretches(weights, window)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>T &amp; x</h1><p><b>One<br><p>two\n three</article><footer>f</footer>', "T & x One two three"),
        ('<div class="menu"><a href=x>Home</a> <a href=y>About</a></div><div id=content><p>First text.</p><p>Second &lt;b&gt;</p></div><div class="comments"><p>nice</p></div>', "First text. Second <b>"),
        ("<div><nav>menu <article><p>kept</p></article></div>", "kept"),
        ('<article>a<script>if (a<b) "</p>"</script><aside>no</aside><form>f</form>b</article>', "a b"),
        ('<p>c <a href="x>y">z</a><script>cut off', "c z"),
        ("<nav><a>x</a></nav>", ""),
        ("a < b", "a < b"),
        ("", ""),
        # Nothing inside an article goes for being short, for part of a class name, or for standing apart.
        ('<article><div class="related-work">Old</div><p class="lead-header">Lead</p><div class="ad-slot">Buy</div><ul><li>a<li>b<li>c<li>d<li>e</ul></article>', "Old Lead a b c d e"),
        ('<article><p>Text</p><section id="comments"><article class="comment">nice</article></section></article>', "Text"),
        (f"<p>{LONG}</p><nav>n</nav><p>The end.</p>", f"{LONG} The end."),
        (f'<div><h2>Head</h2><div class="ad">Buy</div><p>{LONG}</p><div class=ad>Buy</div><p>Last.</p></div>', f"Head {LONG} Last."),
        # Short lines stay, wherever they are.
        (f"<div>{SHORT}</div>", " ".join(f"line {i} ok" for i in range(8))),
        (f"<h1>Title</h1><p>{LONG}</p>{''.join(f'<p>line {i} ok</p>' for i in range(5))}", f"Title {LONG} line 0 ok line 1 ok line 2 ok line 3 ok line 4 ok"),
        (f"<p>{LONG}</p>{'<p>- Yes.</p><p>- No?</p>' * 3}<p>final line.</p>", f"{LONG} {'- Yes. - No? ' * 3}final line."),
        # Within articles only the parts themselves go, by their whole names; an unclosed one ends with its parent.
        ('<article><p class="share-price">1</p><p class="nav-note">2</p><p class="ad-hoc">3</p><p class="social-policy">4</p><p id=banner>5</p><p class=related>6</p><p class="ad">no</p><p>7</p></article>', "1 2 3 4 5 6 7"),
        ("<article><p>a</p><div><nav>menu</div><p>b</p><section><aside>side</section><p>c</article>", "a b c"),
        ("<article><p>a<nav>menu <b>x</b></article><article><p>b</article>", "a b"),
        # Main surges by itself, but the curve cuts within it, and keeps text beside it.
        (f"<main><p>Short.</p>{MENU}<p>Last.</p></main>", "Short. Last."),
        (f"<p>{LONG}</p><main><p>In.</p></main><p>Out.</p>", f"{LONG} In."),
        (f"<article><p>See</p>{'<p><a href=x>menu item</a></p>' * 3}</article>", "See menu item menu item menu item"),
        # Without tags the curve decides.
        (MENU, ""),
        (f"{MENU}<h2>Head</h2><p>{LONG}</p><p>A last paragraph of some length.</p>{MENU}", f"Head {LONG} A last paragraph of some length."),
        (f"<p>{LONG}</p>{'<li>pear</li>' * 6}<p>{LONG}</p>", f"{LONG} pear pear pear pear pear pear {LONG}"),
        (f"<ul>{'<li><a href=x>A long name of a section</a></li>' * 9}</ul><p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p>{'<div><a href=x>One more page</a></div>' * 5}<p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<p>{LONG}</p><div><a href=x>One page</a></div><p>{LONG}</p>", f"{LONG} One page {LONG}"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_surge_and_dive_decide(monkeypatch, spark):
    page = f"{MENU}<h2>Head</h2><p>{LONG}</p>{MENU}"
    assert main_text(page) == f"Head {LONG}"
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    with_curve = [main_text(x) for x in pages]
    # Without dives, all of the pages' lines that aren't marked are kept; without surges, nothing is.
    bare = [re.sub(r"</?(?:nav|article)>", "", x) for x in pages]
    assert [main_text(x) for x in bare] == with_curve
    monkeypatch.setattr(extract, "text_stretches", lambda weights, window=4: [(0, len(weights), 10**9)])
    assert all(main_text(x) != y for x, y in zip(bare, with_curve))
    assert len(main_text(page)) > 2 * len(LONG)


def article_of(html):
    """The fixture's articles by their one known layout."""
    body = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.S)[1])
    blocks = re.split(r"</?(?:h1|p|br)[^>]*>", body)
    return " ".join(x for x in (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_on_whole_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_extract"](spark, DATA).collect()}
    assert got == want
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    assert {r["page_id"]: r["text"] for r in extract_main(bare).collect()} == want


def test_extract_main(spark):
    long = "<article>" + "<p>é " * 60_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<article>é</article>", "y"), (3, "v", long, None)], "page_id long, url string, html string, text string")
    got = extract_main(rows, also=("url", "text"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(got.fillna({"url": "-"}).collect())
    assert [tuple(r) for r in found[:3]] == [(1, "u", "", 0), (1, "u", "", 0), (2, "-", "é", 1)]
    assert found[3]["n_chars"] == 2 * 60_000 - 1
