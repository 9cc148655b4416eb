"""Main text of hand-made pages: what the lines' scores decide, and what structure does."""

import math
import time

import numpy as np

from colloquy.llm import html_text
from colloquy.llm.html_text import main_text

LONG = "Long text of the article that goes on for quite a while, as articles do."


def scores_by_hand(values, sigma=html_text.SIGMA):
    reach = max(1, round(3 * sigma))
    out = []
    for i in range(len(values)):
        near = [(math.exp(-0.5 * (d / sigma) ** 2), values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def test_smoothing_and_clusters():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 6, 7, 40):
        values = r.random(n) * 100
        assert np.allclose(html_text.smoothed(values), scores_by_hand(values))
    assert 3 < html_text.threshold(np.array([1.0, 2.0, 3.0, 50.0, 60.0])) < 50 and html_text.threshold(np.array([4.0, 4.0])) < 4


def test_scores_choose_the_region():
    """No element has a name here: only the text-to-tag ratio tells the link list from the text."""
    links = "".join(f"<p><a href='#'>Go {i}</a> <b>x</b></p>" for i in range(8))
    text = "".join(f"<p>{i} {LONG}</p>" for i in range(5))
    page = f"<html><body><div>{links}</div><div><h1>T</h1>{text}<p>Short.</p></div><div>{links}</div></body></html>"
    assert main_text(page) == "\n\n".join(["T", *(f"{i} {LONG}" for i in range(5)), "Short."])


def test_the_threshold_decides(monkeypatch):
    page = f"<div><p>a</p></div><div><p>{LONG}</p></div><article><p>{LONG}</p></article>"
    assert main_text(page) == LONG
    monkeypatch.setattr(html_text, "threshold", lambda values: math.inf)
    assert main_text(page) == ""
    page = f"<div><p>a</p></div><div><p>{LONG}</p></div>"
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert main_text(page) == f"a\n\n{LONG}"


def test_names_of_pages_mark_nothing():
    for page in (f'<body class="single has-sidebar"><article><p>{LONG}</p></article>', f'<article class="post comments-open"><p>{LONG}</p></article>', f'<main id="search-results-page"><p>{LONG}</p></main>',
                 f'<div class="no-sidebar"><p>{LONG}</p></div>', f'<div class="sidebar"><p>{LONG}</p></div><p>x</p>'):
        assert main_text(page) == LONG


def test_marked_elements_go():
    for mark in ('div class="cookie-notice"', 'div id="comments"', 'section class="comment-list"', "aside", "nav", "form", "footer", 'div class="ad"', 'ul class="main-menu"', 'div role="navigation"'):
        tag = mark.split()[0]
        page = f"<body><article><p>{LONG}</p><{mark}><p>gone</p></{tag}><p>After it, {LONG}</p></article><{mark}>also</{tag}></body>"
        assert main_text(page) == f"{LONG}\n\nAfter it, {LONG}"
    assert main_text(f"<article><p>{LONG}</p></article><div class='comments'><p>{'A comment that is very long. ' * 40}</p></div>") == LONG
    assert main_text("<div class='comments'><p>only comments</p></div>") == ""


def test_all_articles_stay():
    page = f"<article><h2>A</h2><p>{LONG}</p></article><aside>no</aside><article><h2>B</h2><p>{LONG} Really.</p></article>"
    assert main_text(page) == f"A\n\n{LONG}\n\nB\n\n{LONG} Really."


def test_odd_pages():
    began = time.perf_counter()
    main_text("<div>" * 20000 + "x" + "</b>" * 20000 + "</span></p>" * 20000)
    assert time.perf_counter() - began < 3
    whole = "word &amp; word " * 200_000
    assert len(main_text(f"<article><p>{whole}</p></article>")) == len("word & word " * 200_000) - 1
    assert main_text("<p>a<br>b &copy;\u00a0 c") == "a b © c" and main_text("<p>") == "" and main_text(None) == ""


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (1, "u", f"<p>{LONG}", "x"), (2, None, None, "y"), (None, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "v", "", 0)], key=str)


def planted(html, where):
    """A list of links without names, before the first, after the last or between the middle paragraphs of the article."""
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Weather", "Archive", "Contact")) + "</ul>"
    cuts = [i for i in range(len(html)) if html.startswith("<p>", i)]
    at = {"first": cuts[0], "middle": cuts[len(cuts) // 2], "last": html.index("</article>")}[where]
    return html[:at] + menu + html[at:]


def test_scores_decide_within_articles(spark, small, monkeypatch):
    """Menus without names, planted in the articles of the given pages, go by their scores; without a threshold they stay. So on pages without articles."""
    pages = [p.html for p in spark.read.parquet(f"{small}/pages.parquet").collect()]
    pages = [p for p in pages if p.count("<p>") > 4 and "</article>" in p][:60]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>") for p in pages]
    want, plain = [main_text(p) for p in pages], [main_text(p) for p in bare]
    for where in ("first", "middle", "last"):
        assert [main_text(planted(p, where)) for p in pages] == want
    assert len(want) > 20 and sum(a == b for a, b in zip(plain, want)) > 0.9 * len(want)
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert all(main_text(planted(p, "middle")) != w for p, w in zip(pages, want))
    assert all(main_text(p) != w for p, w in zip(bare, plain))


def test_links_in_text_stay():
    """A linked paragraph, a text with links and a long list of sources are no menus."""
    source = "<li><a href='x'>" + LONG * 2 + "</a></li>"
    page = f"<nav><a>x</a></nav><article><p>{LONG}<p><a>Read this.</a><p>{LONG} <a>And</a> more.<ul>{source * 3}</ul><a>never closed<p>Short.<p>{LONG}</article>"
    text = main_text(page)
    assert "Read this." in text and "And more." in text and text.count(LONG * 2) == 3 and "Short." in text
