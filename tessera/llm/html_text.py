"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, and one linear scan finds the contiguous
stretch with the highest sum: the content. Weights come from labelled pages (``labelled_pages``, or pages of your own), on
which the content is marked. A word weighs the log odds of standing in content, a tag how often it stands outside of it for
each time inside: tags of paragraphs and lists cost little, tags that never stand inside content (those of an article
itself, say) part stretches. Names of elements, and the parts of class, id and role names, have learned weights too. The
mean over the parts of a name decides whether an element is noise: ``cookie-notice`` is, ``side-effects``, with a part
that no labelled page holds, is not. Words of noise score nothing, and noise inside the stretch is left out of the text.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space. Rows are independent: one pass, no shuffle.

Defined results: null and empty html give an empty text; a page without words in content gives an empty text; broken
markup (unclosed elements, stray ends, unfinished comments) is read as browsers read it as far as this needs; of equal
stretches the first is taken; repeated rows give a row each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_TOKEN = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.S,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SECTIONS = frozenset(["article", "main"])
_NONE: frozenset[str] = frozenset()


@lru_cache(8192)
def features(name: str, attrs: str, in_section: bool) -> tuple[tuple[str, ...], ...]:
    """What may tell that an element is noise: its name, and the parts of each of its class, id and role names."""
    found = [(f"<{name}{' inside' if in_section else ''}",)]
    if attrs and name not in ("html", "body", "h1"):
        for key, value in _MARK.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                found.append(("hidden!",))
            elif key in ("class", "id", "role", "aria-label"):
                found += [tuple(x.lower() for x in _SPLIT.split(part) if x) for part in value.split()]
    return tuple(f for f in found if f)


def events(page: str, mark: Callable, none) -> Iterator[tuple[str, str, object]]:
    """(kind, text, marked) in page order. kind: word or link (a run of text), or a tag's class.

    ``mark`` makes what is given as marked, from that of the element around (``none`` at first) and an element's features.
    """
    stack: list[tuple[str, object, bool, bool]] = []  # name, marked, whether in an article or main element, in a link
    bottom = top = ("", none, False, False)
    at, last = 0, page.rfind(">")
    begun = 0  # where the pending run of text begins
    size, find, match = len(page), page.find, _TOKEN.match
    while True:
        at = find("<", at)
        m = match(page, at) if 0 <= at <= last or page.startswith("<!--", max(at, 0)) else None
        if at >= 0 and not m:
            at += 1
            continue
        text = page[begun : at if m else size]
        if text:
            yield "link" if top[3] else "word", text, top[1]
        if not m:
            return
        begun = at = m.end()
        name = m["name"]
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "word", entities.escape(m[0][9:-3]), top[1]
            continue
        name = name.lower()
        inline = name in INLINE
        if m["end"]:
            marked = top[1]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    marked = stack[i][1]
                    del stack[i:]
                    top = stack[-1] if stack else bottom
                    break
            yield _kind(inline, "/" + name), "", marked
            continue
        attrs = m["attrs"]
        if name in RAW:
            if not attrs.endswith("/") or name in ("script", "style", "title"):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                begun = at = close.end() if close else size
            yield _kind(True, name), "", top[1]
            continue
        if not inline and name not in VOID:  # a block ends an open paragraph, an item ends its like
            ends, limit = _CLOSES.get(name, _NONE), _LIMITS.get(name, _NONE)
            for i in range(len(stack) - 1, -1, -1):
                open_name = stack[i][0]
                if open_name == "p" or open_name in ends:
                    del stack[i:]
                    top = stack[-1] if stack else bottom
                    break
                if open_name in limit or (open_name not in INLINE and not ends):
                    break
        marked = mark(top[1], features(name, attrs, top[2]))
        if name not in VOID and not (inline and attrs.endswith("/")):
            top = (name, marked, top[2] or name in _SECTIONS, name == "a" or (inline and top[3]))
            stack.append(top)
        yield _kind(inline, name), "", marked


@lru_cache(4096)
def _kind(inline: bool, name: str) -> str:
    return f"{'tag' if inline else 'break'} {name}"


#: Names, in whole or in part, of elements that hold noise, of elements that hold content, and of either.
NOISE_TAGS = "nav footer aside form menu dialog button fieldset datalist label option header"
NOISE_NAMES = (
    "nav navbar navigation menu submenu menubar breadcrumb breadcrumbs header masthead topbar footer colophon sidebar side aside rail widget widgets"
    " complementary contentinfo banner notice notices alert cookie cookies consent gdpr privacy ad ads adv advert adverts advertisement advertising adsense"
    " sponsor sponsored promo promotion promoted form search searchbox login signin signup subscribe subscription newsletter popup modal overlay"
    " comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations pagination pager skip"
    " toolbar tags taglist metadata copyright legal disclaimer hidden!"
)
CONTENT_NAMES = "content body text story entry article post hentry prose markdown chapter lead paragraph"
EITHER_NAMES = "site page main wrapper wrap container box block section area region row col column inner outer left right top bottom primary secondary global list item items link links posts articles buttons icons title slot unit bar module group holder panel"
_WORDS = "the river was wide and slow that year so boats came up from the coast with salt and left again with wool".split()


def labelled_pages(n: int = 400) -> Iterator[str]:
    """Pages by rule, with content between U+0002 and U+0003: containers, names, menus, adverts and notes of many shapes."""
    noise, content, either = NOISE_NAMES.split(), CONTENT_NAMES.split(), EITHER_NAMES.split()
    for i in range(n):
        r = random.Random(i)
        said = lambda k: " ".join(r.choices(_WORDS, k=k))
        links = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{said(r.randrange(1, 3))}</a></li>" for k in range(r.randrange(3, 8))) + "</ul>"

        def block() -> str:
            if r.random() < 0.3:
                tag = r.choice(NOISE_TAGS.split())
                return f"<{tag}>{r.choice((links(), f'<p>{said(r.randrange(3, 15))}</p>'))}</{tag}>"
            parts = [noise[(i + r.randrange(3) * 29) % len(noise)], *r.sample(either, r.randrange(2))]
            name = "hidden" if "hidden!" in parts else f'class="{"-".join(r.sample(parts, len(parts)))}"'
            return f"<div {name}>{r.choice((links(), f'<p>{said(r.randrange(3, 20))}</p>', said(r.randrange(2, 9))))}</div>"

        kinds = (
            lambda: f"<p>{said(r.randrange(5, 60))} <a href=/x>{said(2)}</a> {said(5)} <b>{said(2)}</b>.</p>",
            lambda: f"<p>{said(r.randrange(5, 60))}</p>",
            lambda: f"<h2>{said(3)}</h2><p>{said(r.randrange(5, 30))}<br>{said(5)}</p>",
            lambda: "<ul>" + "".join(f"<li>{said(r.randrange(2, 9))}</li>" for _ in range(4)) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{said(r.randrange(2, 9))}</li>" for _ in range(3)) + "</ol>",
            lambda: "<table>" + "".join(f"<tr><td>{said(1)}</td><td>{said(2)}</td></tr>" for _ in range(3)) + "</table>",
            lambda: f"<blockquote><p>{said(12)}</p></blockquote>",
            lambda: f"<figure><img src=x><figcaption>{said(5)}</figcaption></figure>",
            lambda: f"<pre>{said(8)}</pre><dl><dt>{said(1)}</dt><dd>{said(6)}</dd></dl>",
            lambda: f'<div class="{r.choice(either)}"><p>{said(20)}</p></div>',
        )
        body = f"<h1>{said(4)}</h1>" + "".join(block() if r.random() < 0.15 else r.choice(kinds)() for _ in range(r.randrange(3, 12)))
        tag = r.choice(("article", "main", "div", "div", "section"))
        names = [r.choice(content), *r.sample(either, r.randrange(2))]
        open_tag = f'{tag} class="{"-".join(r.sample(names, len(names)))}"' if tag == "div" and r.random() < 0.7 else tag
        before, after = ("".join(block() for _ in range(r.randrange(1, 4))) for _ in range(2))
        plain = "".join(f"<div>{r.choice((links(), said(r.randrange(2, 12))))}</div>" for _ in range(r.randrange(3)))
        yield f"<html><head><title>T</title></head><body>{before}{plain}<{open_tag}>\x02{body}\x03</{tag}>{after}</body></html>"


def fit_weights(pages: Iterable[str] | None = None) -> dict[str, float]:
    """Weights of words, tags, and names of elements (tags in ``<``), from pages with their content marked."""
    pages = list(labelled_pages() if pages is None else pages)
    inside, outside = Counter(), Counter()
    for page in pages:  # names first: an element is noise by what its own words are
        within = False
        for _, text, marked in events(page, lambda around, found: (*around, *found), ()):
            # Inside the content too, words of noise speak against the name of the noise, and for or against no other.
            root = next((name for name in marked if {*name} & _NOISE), None)
            for piece in re.split("([\x02\x03])", text):
                within = piece == "\x02" or (within and piece != "\x03")
                if piece.strip("\x02\x03 "):
                    if root:
                        outside.update({*root})
                    elif within:
                        inside.update({part for name in marked for part in name})
    weights = {part: max(-4.0, min(0.0, math.log((inside[part] + 0.5) / (outside[part] + 0.5)))) for part in {*inside, *outside}}
    either = {*EITHER_NAMES.split()}
    weights |= {part: 0.0 for part in weights if part in either}
    inside, outside = Counter(), Counter()
    for page in pages:
        within = False
        for kind, text, out in events(page, _marker(weights), False):
            if not text:
                if not out:
                    (inside if within else outside)[kind] += 1
                continue
            for piece in re.split("([\x02\x03])", text):
                within = piece == "\x02" or (within and piece != "\x03")
                if not out:
                    (inside if within else outside)[kind] += len(piece.strip("\x02\x03").split())
    for kind in {*inside, *outside}:
        odds = (inside[kind] + 0.05) / (outside[kind] + 0.5)
        weights[kind] = max(0.1, math.log(odds)) if kind in ("word", "link") else -max(0.05, 0.5 / odds)
    return weights


_NOISE = {*NOISE_NAMES.split(), *(f"<{t}" for t in NOISE_TAGS.split()), *(f"<{t} inside" for t in NOISE_TAGS.split() if t != "header")}
_UNSEEN = 4.0  # the weight of a part of a name that no labelled page holds: content goes by names of its own


def _marker(weights: dict[str, float]) -> Callable[[bool, tuple], bool]:
    known: dict[tuple, bool] = {}

    def noise(name: tuple[str, ...]) -> bool:
        if name not in known:
            if len(known) > 8192:
                known.clear()
            default = 0.0 if name[0].startswith("<") else _UNSEEN
            known[name] = sum(weights.get(p, default) for p in name) / len(name) < -1.0
        return known[name]

    return lambda around, found: around or any(map(noise, found))


@lru_cache(1)
def default_weights() -> dict[str, float]:
    return fit_weights()


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    w = weights or default_weights()
    found = list(events(page, _default_marker() if weights is None else _marker(w), False))
    word, link = w.get("word", 1.0), w.get("link", 0.1)
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, (kind, text, out) in enumerate(found):
        if text:
            score = 0.0 if out else len(text.split()) * (word if kind == "word" else link)
        else:
            score = -0.05 if out else w.get(kind, -0.5)  # noise does not part the content around it
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best[0]:
            best = (total, start, i + 1)
    _, lo, hi = best
    blocks, held = [], []
    for kind, text, out in found[lo:hi]:
        if text:
            if not out:
                held.append(text)
        elif kind.startswith("break") and held:
            blocks.append(" ".join(entities.unescape("".join(held)).split()))
            held = []
    blocks.append(" ".join(entities.unescape("".join(held)).split()))
    return " ".join(b for b in blocks if b)


@lru_cache(1)
def _default_marker() -> Callable[[bool, tuple], bool]:
    return _marker(default_weights())


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """The columns ``keep``, text (empty if the page has none), n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py(), weights) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_html").schema)
    return map_arrow(rows, run, f"{fields}, text string, n_chars long")
