"""Extraction on small pages, and against a direct reading of simple ones."""

import html
import re

import pytest

from quern.llm import html_extraction as h

PAGES = [
    (None, ""),
    ("", ""),
    ("<article><p>a &amp; b&nbsp; c<p>d <b>e</b>f<br>g</article>", "a & b c\n\nd ef g"),
    ("<nav>menu</nav><div class='ad'>buy</div><article><h1>T</h1><p>One.<script>x<p></script><p>1 < 2</p></article><footer>f</footer>", "T\n\nOne.\n\n1 < 2"),
    ("<article><p>x</p><aside>y</aside><section class=comments><p>c</p></section><p>z</p><footer>s</footer></article><p>out", "x\n\nz"),
    ("<body><header><h1>Site</h1></header><main><p>body</p><form><p>f</p></form></main></body>", "body"),
    ("<p class=ad>buy<p>" + "word " * 40 + "<p>short</p><ul><li><a href=x>l</a><li><a>m</a></ul>", ("word " * 40).strip() + "\n\nshort"),
    ("<article><p hidden>no</p><p>yes<!-- <p>no --></p>", "yes"),
    ("<script>never closed", ""),
    ("<article><div class='ad'><div>n</div>m</div>t</article>", "t"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert h.main_text(page) == want


def test_between():
    assert h.between([0, 0, 0, 0, 50, 60, 0, 10, 0, 0, 0, 5], 86) == [4, 5, 7]
    assert h.between([], 1) == []


def test_long_page():
    page = "<div>" * 20_000 + "<article>" + "<p>w</p>" * 20_000
    assert h.main_text(page) == "\n\n".join(["w"] * 20_000)
    assert h.main_text('<a b="' * 20_000) != None  # noqa: E711


def test_table(spark):
    rows = [(i, None, p, 1) for i, (p, _) in enumerate(PAGES)] + [(None, "u", PAGES[2][0], 2)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = h.extract(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted((w, len(w)) for w in [*(w for _, w in PAGES), *[PAGES[2][1]] * 2])
    assert h.extract(pages.limit(0)).count() == 0


def test_simple_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        want[r.page_id] = "\n\n".join(t for t in texts if t)
    assert {r.page_id: r.text for r in h.extract(pages).collect()} == want


LONG = "word " * 40


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>" + "a" * 40 + "<p>" + "b" * 40, "a" * 40 + "\n\n" + "b" * 40),
        (f"<h1>T</h1><p>by A<p>1 May<p>{LONG}", f"T\n\nby A\n\n1 May\n\n{LONG.strip()}"),
        (f"<p>{LONG}<div class=ad>x</div><div class=ad>y</div><div class=ad>z</div><p>The end.", f"{LONG.strip()}\n\nThe end."),
        ("<p>See <a href=x>this long account of it</a>.<p>More", "See this long account of it.\n\nMore"),
        ("<h1><a href=x>T</a></h1><p>text", "T\n\ntext"),
        (f"<main><p>{LONG}</p><article>teaser</article></main>", f"{LONG.strip()}\n\nteaser"),
        (f"<div><p>{LONG}</p></div><article>teaser</article>", f"{LONG.strip()}\n\nteaser"),
    ],
)
def test_short_blocks_and_containers(page, want):
    """Nothing is dropped but boilerplate."""
    assert h.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article class='post no-sidebar'><p>a</article>", "a"),
        ("<article class='post comments-open'><p>a</article>", "a"),
        ("<main id=has-header><p>a</main>", "a"),
        ("<div class='page with-sidebar'><p>a</div>", "a"),
        ("<main class=search><p>a<div class='search-form'>s</div></main>", "a\n\ns"),
        ("<div class=sidebar>s</div><div class=banner>m<article><p>a</article></div>", "a"),
        ("<article><p>a</article><div class=sidebar><article>teaser</article></div>", "a"),
        ("<article><p>a<article class=comment><p>c</article></article>", "a"),
        ("<p>area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object>o</object><canvas>c</canvas>", "area x=2\n\no\n\nc"),
    ],
)
def test_boilerplate_names(page, want):
    assert h.main_text(page) == want


@pytest.mark.parametrize("name", ["class=ad-hoc", "class=promo-free", "class=post-share-price", "class=comment-on-policy", "class=menu-planning", "id=social-impact"])
@pytest.mark.parametrize("text", ["A short account.", LONG.strip()])
def test_ambiguous_names(name, text):
    assert h.main_text(f"<article><h1>T</h1><section {name}><p>{text}</p></section></article>") == f"T\n\n{text}"
    assert h.main_text(f"<div {name}><h1>T</h1><p>{text}</p></div>") == f"T\n\n{text}"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "ad-300x250", "adSlot", "cookie_banner", "site-footer", "comment-list", "share-buttons", "related-posts", "newsletter-signup", "sidebar-left", "mainMenu", "notice", "post big sidebar"])
def test_boilerplate_parts(name):
    page = f"<body><div class='{name}'><p>{LONG}</p></div><div class=text><h1>T</h1><p>{LONG}</p></div></body>"
    if "post" in name.split():
        assert h.main_text(page) == f"{LONG.strip()}\n\nT\n\n{LONG.strip()}"
    else:
        assert h.main_text(page) == f"T\n\n{LONG.strip()}"


SITE = "<div><p>Site</p><p>Tagline</p></div>"
LINKS = "<div>" + "<p><a href=x>Item</a></p>" * 5 + "</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # without <article>: what precedes and follows the menus doesn't surge and lies elsewhere
        (f"{SITE}{LINKS}<div><h1>T</h1><p>by A</p><p>{LONG}</p><p>End.</p></div>{LINKS}<div><p>2024 Site</p></div>", f"T\n\nby A\n\n{LONG.strip()}\n\nEnd."),
        # the end of the text after a menu in it
        (f"<div><p>{LONG}</p>{LINKS}<p>End.</p></div>{LINKS}<div><p>2024 Site</p></div>", f"{LONG.strip()}\n\nEnd."),
        # nothing surges: all lines but menus
        (f"{SITE}{LINKS}<div><p>One.</p></div>", "Site\n\nTagline\n\nOne."),
        # in <article>: a menu's windows are low, a list of sources' are high, two links are no menu
        (f"<article><p>{LONG}</p>{LINKS}<p>End.</p></article>", f"{LONG.strip()}\n\nEnd."),
        (f"<article><p>{LONG}</p>" + f"<p><a href=x>{LONG}</a></p>" * 3 + "</article>", "\n\n".join([LONG.strip()] * 4)),
        ("<article><p>a</p><p><a href=x>b</a></p><p><a href=x>c</a></p></article>", "a\n\nb\n\nc"),
        # under an ambiguous name links decide
        ("<article><p>a</p><div class=social-impact><a href=x>Link text</a> b</div></article>", "a"),
        # a link that is never closed
        (f"<div><p><a href=x>Top<p>{LONG}<p>{LONG}</div>", f"Top\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    ],
)
def test_windows(page, want):
    assert h.main_text(page) == want


def test_windows_decide(monkeypatch):
    """The stretches and menus above follow from the windows: without them the results differ."""
    page = f"{SITE}{LINKS}<div><p>{LONG}</p></div>"
    inside = f"<article><p>{LONG}</p>{LINKS}</article>"
    assert h.main_text(page) == h.main_text(inside) == LONG.strip()
    monkeypatch.setattr(h, "SURGE", 1)
    assert h.main_text(page) != LONG.strip()
    assert h.main_text(inside) != LONG.strip()


@pytest.mark.parametrize("part", ["<a ", '<a "x>y" ', "<a b='>", "<!-- ", "<svg>", "<div>", "</div>", "<p", "<script>", "<a href=x>", "<", "<select>", "<td>", "&lt;"])
def test_time_grows_with_length(part):
    import time

    began = time.process_time()
    h.main_text(part * (2_000_000 // len(part)))
    h.main_text(part * (200_000 // len(part)) + "<article><p>x</p>" + '">\'>' * 1000)
    assert time.process_time() - began < 20


def test_unclosed_parts():
    assert h.main_text("<p>a<svg><p>b") == "a\n\nb"
    assert h.main_text("<!--><p>a<!-- x --!><p>b<!---><p>c") == "a\n\nb\n\nc"
    assert h.main_text("<p>a <a title='x") == "a <a title='x"
    assert h.main_text("<p>a <b title='>b</b> c") == "a b c"
