import random
import time

import pytest

from keyloom.llm import html_text
from keyloom.llm.html_text import extract, extract_pages

LONG = "A paragraph, with commas, that is long enough to earn some points for its container"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<script>x", ""),
        ("a < b &amp; c &lt;", "a < b & c <"),
        (f"<p>{LONG} <b>x<br><p>{LONG} &quot;q&quot;&nbsp; y", f"{LONG} x\n\n{LONG} \"q\" y"),
        (f"<body><nav><p>{LONG}</p></nav><div class=ad>{LONG}</div><article><h1>T &amp; t</h1><p>{LONG}</p><p>ok</p></article><footer>{LONG}</footer>", f"T & t\n\n{LONG}\n\nok"),
        (f'<div id="comments"><p>{LONG}</p><p>{LONG}</p></div><div class="body"><h2>H</h2><p>{LONG}</p><ul><li>one<li>two</ul></div>', f"H\n\n{LONG}\n\none\n\ntwo"),
        (f"<article><p>{LONG}<script>var t='</p>';</script></p><aside>{LONG}</aside><form><p>{LONG}</p></form><p>end</article>", f"{LONG}\n\nend"),
        (f"<main><!-- <p>no</p> --><p hidden>{LONG}</p><p>{LONG}<p title='>'>x <a hre", f"{LONG}\n\nx"),
        (f"<div><p><a href=x>{LONG}</a></p><p><a href=x>{LONG}</a></p></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_extract(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="layout has-sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<div class="no-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<div id="content with-banner"><p>{LONG}</p></div>', LONG),
        (f'<div class="sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<div class="widget"><p>{LONG}</p><p>{LONG}</p></div><p>short</p>', f"{LONG}\n\n{LONG}\n\nshort"),
        (f'<div id="comments"><p>{LONG}</p></div>', LONG),
        (f'<div class="comments"><article><p>{LONG}</p><p>{LONG}</p></article></div><article><p>{LONG} x</p></article>', f"{LONG} x"),
        (f'<article><p>{LONG} x</p></article><div class="cookie"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG} x"),
        (f'<form id="page"><nav>{LONG}</nav><div class="ad"><p>{LONG}</p></div><div><p>{LONG} x</p><p>{LONG} y</p></div></form>', f"{LONG} x\n\n{LONG} y"),
        (f'<form><main><p>{LONG}</p></main></form>', LONG),
        (f"<article><p>{LONG}</p><figure><img src=a><figcaption>The caption</figcaption></figure></article>", f"{LONG}\n\nThe caption"),
        (f'<div hidden><article><p>{LONG}</p></article></div><p>{LONG} x</p>', f"{LONG} x"),
    ],
)
def test_wrappers_and_captions_stay(page, text):
    assert extract(page) == text


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = extract_pages(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    assert not any("<" in r["text"] and "</p>" in r["text"] or "©" in r["text"] for r in got)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", f"<p>{LONG}", 1), (1, "u", f"<p>{LONG}", 1)], "page_id long, url string, html string, n_chars int")
    assert sorted(r["n_chars"] for r in extract_pages(odd).collect()) == [0, 0, len(LONG), len(LONG)]
    assert extract_pages(odd.limit(0)).collect() == []


def test_weights_against_climbing():
    """Points, characters and links of random trees, each run climbing to all its ancestors by itself."""
    rng = random.Random(4)
    for _ in range(60):
        parts, depth = [], 0
        for _ in range(rng.randrange(40)):
            kind = rng.choice(["div", "p", "section", "ul", "li", "close", "text", "text", "link"])
            parts.append({"close": "</div>", "text": f"{LONG}, {rng.randrange(9)}", "link": f"<a href=x>{LONG}</a>"}.get(kind, f"<{kind}>"))
        page = html_text.parse("".join(parts))
        n = len(page.tag)
        points, chars, links = [0.0] * n, [0] * n, [0] * n
        for e, text, linked in page.runs:
            up, share = (page.parent[e] if page.tag[e] in html_text.OWN_TEXT else e), 1.0
            for share in [1, 1 / 2, 1 / 6, *(1 / 6 / 2**i for i in range(1, n))]:
                if up < 0:
                    break
                points[up] += share * html_text._earned(page.tag[e], text)
                up = page.parent[up]
            up = e
            while up >= 0:
                chars[up] += len(text)
                links[up] += linked
                up = page.parent[up]
        got = html_text.weighed(page)
        assert got[0] == pytest.approx(points) and got[1:] == (chars, links)


@pytest.mark.parametrize("page", ["<div>" * 30_000 + LONG, "<div><b>" * 30_000 + "</section>" * 30_000 + f"<p>{LONG}", "<ul><li>" * 30_000 + LONG])
def test_deep_pages_take_no_longer_than_others(page):
    began = time.process_time()
    assert extract(page) == LONG
    assert time.process_time() - began < 5


def test_sibling_articles_stay():
    assert extract(f"<main><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG} x</p></article></main>").endswith("x")


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(3000)) + "</article>"
    assert extract(page).count("\n\n") == 2999
