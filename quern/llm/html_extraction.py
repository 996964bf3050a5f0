"""Main text of web pages by their line-block distribution.

Markup is stripped into lines, one a block element; lines in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments go with the markup.  What is left is ambiguous in two ways, and lengths of lines summed over
windows of WINDOW lines decide:

* which stretches are text.  A stretch begins where a window rises to SURGE characters, with the lines before it since
  the last dive, and dives where a window has none; a line that is a link as a whole has no characters, nor has one that
  is mostly links under an ambiguous name.  Stretches that never surge go, but for those in <article> or <main>, those
  with the same parent element as one that surges, and all of them where nothing surges.
* whether links in <article> or <main> are a menu: three or more lines in a row that are links as a whole go if no
  window of them rises to SURGE characters.  Elsewhere two such lines in a row are a menu.

Lines outside <article> and <main> are none of the text unless they hold more of it than those inside, and surge.

An element is boilerplate by its tag, or by a whole name of its class, id or role that is made of words of NAMES and
PLACES ("ad", "site-footer"); a name with other words beside ("ad-hoc", "menu-planning") is only ambiguous, and one that
says whether a page has such a part ("no-sidebar", "comments-open") means nothing.  An <article> (within no other) or
<main> is never boilerplate by class, nor is the element around it, if the page has none elsewhere.

Text: character references are decoded, white space in a line becomes one space, lines are joined by a blank line.

Defined results: a null, empty or textless page has the text "" and 0 characters; elements left open end with their
parent or the page; a "<" that begins no tag is text; a ">" in quotes doesn't end a tag, but from a tag on that would
never end it does; repeated rows repeat; only the columns named are read.  Time grows with the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86

OPENING = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*))", re.S)
QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
UNQUOTED = re.compile(r"([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A word of a class name: a hump, or letters between other characters.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms mtext msub msup msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded mspace semantics".split())
SPACE = frozenset("br td th img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset("article main body div section center table".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd".split())
RAW = frozenset("script style noscript iframe textarea title".split())
SKIPPED = RAW | frozenset("template svg annotation annotation-xml audio video select".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head".split())
#: Words of class, id and role that name boilerplate.
NAMES = frozenset(
    "ad ads adsense adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments reply replies disqus respond share sharing social related recommended recommendations "
    "contentinfo complementary search".split()
)
#: Words that such a name may hold beside, for where or of what kind the part is.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer sticky fixed mobile desktop list lists item items box boxes bar bars block blocks area areas section container wrapper wrap "
    "holder slot slots unit unit widget widgets panel overlay strip row column col group button buttons link links icon icons form field thread threads body text content author user reader post article entry blog news posts articles stories view mod module region tools toolbar rail".split()
)
#: Of NAMES, the ones that an article's own parts may carry.
OWN = frozenset("header banner search related".split())
#: Words of a name that only says whether or how a page has such a part.
MODIFIERS = frozenset("no not non without with has have is".split())
STATES = frozenset("open opened closed enabled disabled on off".split())
#: Whole class names of an element that holds the text, which makes another name beside it ambiguous.
TEXT_HOLDERS = frozenset("layout page wrapper content main article post entry story".split())


class Line(NamedTuple):
    text: str
    skipped: bool
    #: Whether it lies in <article> or <main>, its characters in links, whether a name above it is ambiguous, its parent.
    held: bool
    linked: int
    soft: bool
    parent: int


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _boilerplate(tag: str, text: str, inside: bool) -> str:
    """What makes an element boilerplate: "tag", "class", or "soft" where that is ambiguous; or nothing."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return "tag"
    if not text or tag in ("html", "body"):
        return ""
    a = _attributes(text)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "tag"
    found = ""
    names = " ".join(a.get(k, "") for k in ("class", "id", "role")).split()
    for name in names:
        words = [w.lower() for w in WORD.findall(name) if not w.isdigit() and len(w) > 1]
        hits = NAMES.difference(OWN if inside else ()).intersection(words)
        if not hits or not MODIFIERS.isdisjoint(words) or words[-1] in STATES:
            continue
        found = "soft"
        if hits.union(PLACES).issuperset(words) and TEXT_HOLDERS.isdisjoint(names):
            return "class"
    return found


def lines_of(page: str, unmask: bool = False) -> list[Line]:
    """The lines in page order.

    unmask: an article or main ends what is boilerplate by class around it.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    skip, depth, why = "", 0, ""  # the element that is skipped, how many of its name are open, and what makes it boilerplate
    held = {"article": 0, "main": 0}
    link = False
    soft, soft_depth = "", 0  # the same for an ambiguous element
    above, open_, made = [("", 0)], Counter(), 0  # the elements that hold others, and how many of each name
    endless: set[str] = set()  # elements that nothing closes from here on
    at, end, last, tail = 0, len(page), page.rfind(">"), QUOTED

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, bool(skip), any(held.values()), linked, bool(soft), above[-1][1]))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            linked += len(text) if link else 0

    while at < end:
        m = OPENING.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        rest = tail.match(page, at) if at <= last else None
        if not rest and at <= last and tail is QUOTED:
            tail = UNQUOTED
            rest = tail.match(page, at)
        if not rest:  # no tag ends from here on
            add(page[m.start() :])
            break
        at = rest.end()
        tag, closing, inner = m[2].lower(), bool(m[1]), rest[1]
        if tag in SKIPPED and not closing:
            if not inner.endswith("/") and tag not in endless:
                stop = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in RAW:
                    at = end
                else:
                    endless.add(tag)
            continue
        if tag in SPACE:
            parts.append(" ")
            continue
        if tag == "a":
            link = not closing and ("href" in inner.lower() or not inner.strip())  # else a mere anchor
        elif link and tag in LEAVES and (closing or linked):  # a link that nothing closes ends with its line
            link = False
        inline = tag in INLINE
        if not inline:
            close()
        if skip and unmask and why == "class" and tag in held and not closing and _boilerplate(tag, inner, False) in ("", "soft"):
            skip, depth = "", 0
        if skip:
            if tag == skip:
                depth += -1 if closing else 1
            if depth == 0 or (closing and tag in ("article", "main", "body", "html") and tag != skip) or (skip == "p" and not inline and tag != "p") or (skip == "p" and tag == "p" and not closing):
                if inline:
                    close()
                skip, depth = "", 0
                if closing and tag not in held:
                    continue
            else:
                continue
        if soft and tag == soft:
            soft_depth += -1 if closing else 1
        if soft and (soft_depth == 0 or (closing and tag in ("article", "main", "body", "html")) or (soft == "p" and not inline)):
            soft = ""
        if closing:
            if tag in held:
                held[tag] = max(0, held[tag] - 1)
            if open_[tag]:
                while above[-1][0] != tag:
                    open_[above.pop()[0]] -= 1
                open_[above.pop()[0]] -= 1
        elif tag not in VOID and not inner.endswith("/"):
            found = _boilerplate(tag, inner, any(held.values()))
            if found == "class" and (tag == "main" or (tag == "article" and not held["article"])):
                found = ""
            if found == "soft":
                if not soft:
                    soft, soft_depth = tag, 1
                found = ""
            if found:
                if inline:
                    close()
                skip, depth, why = tag, 1, found
                continue
            if tag in held:
                held[tag] += 1
            if tag in HOLDERS:
                made += 1
                above.append((tag, made))
                open_[tag] += 1
    close()
    return lines


def main_text(page: str | None) -> str:
    page = page or ""
    lines = lines_of(page)
    if not any(x.held and not x.skipped for x in lines) and re.search(r"<(?:article|main)[\s>]", page, re.I):
        lines = lines_of(page, True)
    if not any(x.held and not x.skipped for x in lines):
        lines = [x._replace(held=False) for x in lines]
    lines = [x for x in lines if not x.skipped]
    length = _lengths(lines)
    outside = [0 if x.held else n for x, n in zip(lines, length, strict=True)]
    inside = sum(len(x.text) for x in lines if x.held)
    if inside and not (sum(outside) > inside and _surges(outside)):
        kept = [i for i, x in enumerate(lines) if x.held]
        lines, length = [lines[i] for i in kept], [length[i] for i in kept]
    text = set(between(length, SURGE))
    parents = {lines[i].parent for i in text}
    kept = [i for i, x in enumerate(lines) if i in text or (length[i] and (not text or x.held or x.parent in parents))]
    return "\n\n".join(lines[i].text for i in kept)


def _surges(length: list[int]) -> bool:
    return any(sum(length[i : i + WINDOW]) >= SURGE for i in range(len(length)))


def _lengths(lines: list[Line]) -> list[int]:
    """Characters that count of each line: none of a menu's, or of mostly links under an ambiguous name."""
    length = [0 if x.soft and 2 * x.linked > len(x.text) else len(x.text) for x in lines]
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j].linked >= len(lines[j].text) and lines[j].held == lines[i].held:
            j += 1
        if (j - i >= WINDOW and not _surges([len(x.text) for x in lines[i:j]])) if lines[i].held else j - i > 1:
            length[i:j] = [0] * (j - i)
        i = max(j, i + 1)
    return length


def between(length: list[int], surge: int) -> list[int]:
    """Numbers of the lines that count in stretches between two dives of which a window rises to surge."""
    kept: list[int] = []
    stretch: list[int] = []
    on = False
    for i, n in enumerate(length):
        total = sum(length[i : i + WINDOW])
        on = on or total >= surge
        if n:
            stretch.append(i)
        if total == 0:
            kept += stretch if on else []
            stretch, on = [], False
    return kept + (stretch if on else [])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in slim.schema]
    out = slim.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
