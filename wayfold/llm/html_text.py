"""Main text of web pages: the maximum-scoring contiguous part of a page's words and tags.

Every word scores by what labelled pages teach about its place: the tags and names around it, how much
of its block is link text, how long the block is. In an article's blocks words score up to +1,
in menus, notices or adverts down to -1, and each tag costs a little. One linear scan finds the
contiguous run of words and tags with the highest sum. Within that run, elements whose own tags and names
speak against them (an advert between two paragraphs) are left out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SPACED = frozenset(("td", "th"))
RAW = frozenset("script style title textarea noscript template iframe svg".split())
NEVER_TEXT = frozenset("button select option datalist audio video canvas object head".split())
#: Text-level elements, whose names say what they are called, not what they are for.
TEXT_LEVEL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr table thead tbody tfoot caption pre blockquote figure figcaption address center hr br".split())
#: Elements that say nothing but by their names.
PLAIN = TEXT_LEVEL | INLINE | frozenset("div html body".split())
LISTS = frozenset("ul ol dl".split())
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

#: Labelled pages that are made, at most; what a tag costs in words: at most, at most if articles use it too, at least.
LABELLED_PAGES, MOST_COST, USED_COST, LEAST_COST = 700, 2.0, 0.25, 0.02

_START = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)|[!?/])")
_IN_TAG = re.compile(r">|=\s*([\"'])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """Yield (kind, value, attributes) in page order: text, comment, open or close; in time linear in the page, however broken.

    A tag ends at the first > outside of quoted values; a quote that never closes is an ordinary
    character, and where no > follows any more all is text. Scripts and the like are left out; those
    that never end are searched for their end once, not at each start.
    """
    pos = at = 0
    size, lone, endless = len(source), set(), set()
    while m := _START.search(source, pos):
        start = m.start()
        if m["comment"]:
            end = source.find("-->", start + 2)
            end = size if end < 0 else end
            yield "text", source[at:start], ""
            yield "comment", source[m.end() : end], ""
            pos = at = min(size, end + 3)
            continue
        end = m.end()
        while hit := _IN_TAG.search(source, end):
            quote = hit[1]
            if not quote:
                break
            end = hit.end()
            if quote not in lone:
                close = source.find(quote, end)
                if close < 0:
                    lone.add(quote)
                else:
                    end = close + 1
        if not hit:
            break
        yield "text", source[at:start], ""
        attrs, pos = source[m.end() : hit.start()], hit.end()
        at = pos
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            yield "close", tag, ""
            continue
        if tag in RAW and not attrs.endswith("/"):
            over = None if tag in endless else _RAW_END[tag].search(source, pos)
            if not over:
                endless.add(tag)
            if over or tag in ("script", "style"):
                pos = at = over.start() if over else size
                continue
        yield "open", tag, attrs
    yield "text", source[at:], ""


@dataclass(slots=True)
class Element:
    """An element that is more than a text's markup: what speaks for or against its words. words: in it and below."""

    tag: str
    names: tuple[str, ...]
    parent: int
    in_article: bool
    hidden: bool
    words: int = 0


@dataclass(slots=True)
class Part:
    """A run of text (kind "") or a tag, in page order. block: the number of the block its text belongs to."""

    kind: str
    element: int
    block: int
    words: int = 0
    linked: bool = False
    text: str = ""


@dataclass
class Page:
    parts: list[Part] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", (), -1, False, False)])
    blocks: dict[int, str] = field(default_factory=dict)  # the tag that a block began with
    marks: list[tuple[str, int]] = field(default_factory=list)


def _names(tag: str, attrs: dict[str, str]) -> tuple[str, ...]:
    """Return an element's class, id and role names as features: whole ones, and the parts of class names."""
    out = {f"role:{r}" for r in attrs.get("role", "").lower().split()}
    if tag in TEXT_LEVEL or tag in INLINE:
        return tuple(sorted(out))
    for kind in ("class", "id"):
        for name in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", attrs.get(kind, "")).lower().split():
            out.add(f"is:{name}")
            if kind == "class" or tag != "section":
                out |= {f"has:{p}" for p in re.split(r"[-_]+", name) if p}
    return tuple(sorted(out))


def read_page(source: str) -> Page:
    """Split a page into text runs, tags and elements. Never fails on broken markup."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    heights: dict[str, list[int]] = {}  # where in the stack a tag is open
    block, link = 0, None

    def pop(height: int) -> None:
        nonlocal link
        while len(stack) > height:
            heights[stack.pop()[0]].pop()
        if link is not None and link > len(stack):
            link = None

    for kind, value, raw in tokens(source):
        element = stack[-1][1]
        if kind == "text":
            if value:
                run = html.unescape(value)
                words = len(run.split())
                page.parts.append(Part("", element, block, words, link is not None, run))
                page.elements[element].words += words
            continue
        if kind == "comment":
            page.marks.append((value.strip(), len(page.parts)))
            continue
        if kind == "open" and value not in INLINE:
            # A start tag ends what cannot hold it.
            if stack[-1][0] == "p" and value not in VOID or value == "p" and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if value in SCOPES:
                limit = max((heights[s][-1] for s in SCOPES[value] if heights.get(s)), default=0)
                mine = [heights[t][-1] for t in (("td", "th") if value in SPACED else ("dt", "dd") if value in ("dt", "dd") else (value,)) if heights.get(t)]
                if mine and max(mine) > limit:
                    pop(max(mine))
            element = stack[-1][1]
        if value in SPACED:
            page.parts.append(Part("", element, block, 0, False, " "))
        elif value not in INLINE:
            block += 1
            page.blocks[block] = value if kind == "open" else ""
        if kind == "close":
            if value == "a":
                link = None
            if heights.get(value):
                pop(heights[value][-1])
            page.parts.append(Part(value, stack[-1][1], block))
            continue
        if value == "a":
            link = len(stack)
        attrs = {n.lower(): html.unescape("".join(v)) for n, *v in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
        hidden = bool(attrs) and (attrs.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(attrs.get("style", "")))) or bool(raw) and bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", raw)))
        hidden = hidden or value in NEVER_TEXT
        if value not in VOID and not raw.endswith("/") and (value not in INLINE or hidden):
            names = _names(value, attrs)
            if hidden or names or value not in PLAIN:
                within = page.elements[element].in_article or page.elements[element].tag in ("article", "main")
                page.elements.append(Element(value, names, element, within, hidden))
                element = len(page.elements) - 1
            heights.setdefault(value, []).append(len(stack))
            stack.append((value, element))
        page.parts.append(Part(value, element, block))
    for i in range(len(page.elements) - 1, 0, -1):
        page.elements[page.elements[i].parent].words += page.elements[i].words
    return page


def is_bare(page: Page) -> bool:
    """Tell whether no element but text's markup and lists without names is shown: nothing on the page says what its parts are for."""
    return all(e.hidden or e.tag in LISTS and not e.names for e in page.elements[1:])


def element_features(page: Page) -> list[list[str]]:
    """Return each element's own features: its tag, within an article or not, and its names; those of elements with over half of the page's words apart."""
    half = page.elements[0].words / 2
    out = []
    for e in page.elements:
        big = "+" if e.words > half else ""
        at = "@in" if e.in_article and e.tag != "section" else ""
        own = [] if e.tag in PLAIN or not e.tag else [f"<{e.tag}>{at}{big}"]
        out.append([*own, *[n + big for n in e.names]])
    return out


def block_features(page: Page, under_article: list[bool]) -> dict[int, list[tuple[str, float]]]:
    """Return each block's features: kind of tag, share of link words, length, sentence end, and whether it is outside of the page's article."""
    some = any(under_article)
    count: dict[int, list] = {}
    for p in page.parts:
        if not p.kind and (p.words or p.text.strip()):
            c = count.setdefault(p.block, [0, 0, False, ""])
            c[0] += p.words
            c[1] += p.words if p.linked else 0
            c[2] = c[2] or under_article[p.element]
            c[3] = p.text
    out = {}
    for block, (words, linked, inside, last) in count.items():
        tag = page.blocks.get(block, "")
        kind = "h" if re.fullmatch("h[1-6]", tag) else tag if tag in ("p", "li", "tr", "blockquote", "pre") else "other"
        share = linked / max(words, 1)
        place = [("inside" if inside else "outside", 1.0)] if some else []
        out[block] = [(f"block:{kind}", 1.0), ("links", share), ("only links", float(share > 0.9)), ("short", float(words < 5)), ("length", min(1.0, math.log1p(words) / 5)), ("sentence", float(last.rstrip()[-1:] in ".!?…。")), *place]
    return out


@dataclass(frozen=True)
class Weights:
    """Log-odds of being article text: by the features of the elements around, and added to that by those of the block. cost: of each tag, in words.

    bare: the log-odds by the features of a block alone, on bare pages.
    """

    around: dict[str, float]
    block: dict[str, float]
    cost: dict[str, float]
    bare: dict[str, float] = field(default_factory=dict)


def evidence(page: Page, weights: Weights) -> list[float]:
    """Return the sum of the weights of an element and all around it: below 0, they speak against its words."""
    out: list[float] = []
    bare = bool(weights.bare) and is_bare(page)
    for e, own in zip(page.elements, element_features(page), strict=True):
        if bare:
            out.append(-math.inf if e.hidden or out and out[e.parent] == -math.inf else 0.0)
            continue
        up = out[e.parent] if out else weights.around.get("", 0.0)
        out.append(-math.inf if e.hidden else up + sum(weights.around.get(f, weights.around.get(f.rstrip("+"), 0.0)) for f in own))
    return out


def _under_article(page: Page, against: list[float]) -> list[bool]:
    out: list[bool] = []
    for i, e in enumerate(page.elements):
        out.append(i > 0 and (out[e.parent] or e.tag in ("article", "main")) and against[i] >= 0)
    return out


def word_scores(page: Page, weights: Weights, against: list[float]) -> list[float]:
    """Return every part's score: a run's words times their weight between -1 and 1, or what a tag costs.

    What speaks against itself inside of what is known as the article (by tag or name) is a gap in it, and costs nothing.
    """
    holds = [False]
    for e, own in zip(page.elements[1:], [against[i] - against[e.parent] for i, e in enumerate(page.elements) if i], strict=True):
        holds.append(holds[e.parent] or (own > 1 and against[len(holds)] > 1))
    blocks = block_features(page, _under_article(page, against))
    own_weights = weights.bare if weights.bare and is_bare(page) else weights.block
    of_block = {b: own_weights.get("", 0.0) + sum(own_weights.get(f, 0.0) * v for f, v in fs) for b, fs in blocks.items()}
    out = []
    for p in page.parts:
        if against[p.element] == -math.inf or against[p.element] < 0 and holds[p.element]:
            out.append(0.0)
        elif p.kind:
            out.append(-weights.cost.get(p.kind, LEAST_COST))
        elif p.block in of_block:
            out.append(max(p.words, 1) * math.tanh((of_block[p.block] + against[p.element]) / 2))
        else:
            out.append(0.0)
    return out


def best_part(scores: list[float]) -> tuple[int, int]:
    """Return first and last part (end not included) of the contiguous run with the highest sum; (0, 0) if none is above 0."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(source: str | None, weights: Weights) -> str:
    """Return a page's main text: blocks in page order joined by line feeds, white space in a block made one space; empty if there is none."""
    page = read_page(source or "")
    against = evidence(page, weights)
    start, end = best_part(word_scores(page, weights, against))
    blocks: dict[int, list[str]] = {}
    for part in page.parts[start:end]:
        if not part.kind and against[part.element] >= 0:
            blocks.setdefault(part.block, []).append(part.text)
    return "\n".join(line for runs in blocks.values() if (line := " ".join("".join(runs).split())))


def _fit(rows: list[dict[str, float]], labels: np.ndarray, offset: np.ndarray, strength: float = 0.3, rounds: int = 60) -> dict[str, float]:
    """Fit a logistic model by Newton's method, its weights drawn to 0; the bias has the name "". Equal rows are one with a count."""
    groups: dict[tuple, list[float]] = {}
    for r, label, off in zip(rows, labels.tolist(), offset.tolist(), strict=True):
        group = groups.setdefault((off, *sorted(r.items())), [0.0, 0.0])
        group[0] += 1.0
        group[1] += label
    rows, offset = [dict(g[1:]) for g in groups], np.array([g[0] for g in groups])
    n, ones = np.array(list(groups.values())).reshape(-1, 2).T
    names = ["", *sorted({f for r in rows for f in r})]
    column = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    x[:, 0] = 1.0
    for i, r in enumerate(rows):
        for f, v in r.items():
            x[i, column[f]] = v
    w, pull = np.zeros(len(names)), np.full(len(names), strength)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * p - ones) + pull * w)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return {f: float(w[k]) for f, k in column.items()}


def labelled_parts(page: Page) -> list[bool]:
    """Tell of every part whether it stands between the comments `begin` and `end`."""
    out, on, marks = [], False, iter([*page.marks, ("", len(page.parts))])
    mark, at = next(marks)
    for i in range(len(page.parts)):
        while at <= i:
            on = True if mark == "begin" else False if mark == "end" else on
            mark, at = next(marks)
        out.append(on)
    return out


def learn_weights(labelled: tuple[str, ...], bare: tuple[str, ...] = ()) -> Weights:
    """Fit weights on pages whose article text stands between the comments `begin` and `end`, a row per block.

    First what the elements around a block say by themselves, then what the block adds to that. A
    tag costs the squared share of its uses outside of articles, times MOST_COST if no article uses it, else USED_COST.
    """
    inside, outside = Counter(), Counter()
    around: list[dict[str, float]] = []
    labels: list[float] = []
    where: list[tuple[Page, int, int]] = []
    pages = [read_page(source) for source in labelled]
    for page in pages:
        own, is_text, seen = element_features(page), labelled_parts(page), set()
        for p, label in zip(page.parts, is_text, strict=True):
            if p.kind:
                (inside if label else outside)[p.kind] += 1
            elif p.text.strip() and p.block not in seen and not page.elements[p.element].hidden:
                seen.add(p.block)
                row, e = {}, p.element
                while e > 0:
                    for f in own[e]:
                        row[f] = row.get(f, 0.0) + 1.0
                    e = page.elements[e].parent
                around.append(row)
                labels.append(float(label))
                where.append((page, p.element, p.block))
    y = np.array(labels)
    weights = Weights(_fit(around, y, np.zeros(len(y))), {}, {})
    against = {id(page): evidence(page, weights) for page in pages}
    blocks = {id(page): block_features(page, _under_article(page, against[id(page)])) for page in pages}
    rows = [dict(blocks[id(page)][block]) for page, _, block in where]
    block = _fit(rows, y, np.array([against[id(page)][e] for page, e, _ in where]))
    cost = {t: max(LEAST_COST, (USED_COST if inside[t] else MOST_COST) * (outside[t] / (outside[t] + inside[t])) ** 2) for t in inside | outside}
    return Weights(weights.around, block, cost, learn_bare(bare))


def learn_bare(labelled: tuple[str, ...]) -> dict[str, float]:
    """Fit the weights of blocks of bare pages, from the features of the blocks alone."""
    rows, labels = [], []
    for page in map(read_page, labelled):
        features, seen = block_features(page, [False] * len(page.elements)), set()
        for p, label in zip(page.parts, labelled_parts(page), strict=True):
            if not p.kind and p.text.strip() and p.block not in seen and not page.elements[p.element].hidden:
                seen.add(p.block)
                rows.append(dict(features[p.block]))
                labels.append(float(label))
    return _fit(rows, np.array(labels), np.zeros(len(rows))) if rows else {}


#: Names that page templates give to what is not article text, to article text, and to wrappers of both.
NAMES_OUT = {
    "menu": "menu nav navbar navigation main-menu site-nav nav-bar breadcrumb breadcrumbs topbar toolbar pagination pager tags tag-list toc skip-link",
    "ad": "ad ads adv advert advertisement advertising adsense ad-slot adbox banner sponsor sponsored promo promoted promotion taboola",
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr alert notice notices notification overlay popup modal message warning disclaimer legal copyright",
    "side": "sidebar side-bar sidebar-left widget widgets related related-posts recommended recommendations trending popular teaser teasers newsletter subscribe signup subscription donate",
    "comments": "comments comment comment-list comments-area discussion disqus replies reply respond feedback",
    "share": "share sharing share-buttons social social-links follow byline-share",
    "head": "header site-header page-header masthead top-header global-header logo",
    "foot": "footer site-footer page-footer bottom-footer colophon",
    "form": "search search-form searchbox login login-form",
}
NAMES_IN = "content main-content post post-content post-body entry entry-content article article-body story story-body text body page-content markdown prose hentry blog-post chapter section part".split()
NAMES_AROUND = "wrapper container layout page site app root row col outer inner layout-sidebar right-sidebar left-sidebar content-with-sidebar has-sidebar with-sidebar no-menu has-comments with-ads main-wrapper".split()
#: What an article's own parts are called; the names are no reason to drop them.
NAMES_WITHIN = "related-work methods results introduction background discussion search legal-basis tracking-objects comments-on-theory menu warning message tags social alert intro lead highlight figure-box columns".split()
ROLES = {"menu": "navigation", "side": "complementary", "head": "banner", "foot": "contentinfo", "form": "search", "notice": "alert"}


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 11) -> tuple[str, ...]:
    """Make labelled pages by rule, from the layouts that templates use: semantic elements, named divs, and old tables with neither."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "le", "mi", "no", "ru", "sta", "ter", "ven", "do", "ka")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + rng.choice((".", ".", "!", "?"))
    links = lambda a, b: [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]
    often = lambda p: rng.random() < p

    def prose(a: int, b: int) -> str:
        out = [sentence() for _ in range(rng.randint(a, b))]
        if often(0.3):
            out.insert(rng.randint(0, len(out)), rng.choice((f'<a href="/x">{words(1, 5)}</a>', f"<b>{words(1, 4)}</b>", f"<em>{words(1, 3)}</em>", f"<code>{word()}</code>", "<br>", "<br><br>", f"<font>{words(1, 3)}</font>", f"<i>{word()}</i>", f"<strong>{word()}</strong>", f"<span>{word()}</span>", f"<u>{word()}</u>", '<img src="x">')))
        return " ".join(out)

    def left_out(kind: str, tag: str | None = None, within: bool = False) -> str:
        natural = {"menu": "nav", "side": "aside", "head": "header", "foot": "footer", "form": "form"}.get(kind, "div")
        tag = tag or (natural if often(0.5) else rng.choice(("div", "section", "ul" if kind in ("menu", "share") else "div")))
        name = "" if tag == natural and tag != "div" and often(0.5) else f' {rng.choice(("class", "class", "id"))}="{rng.choice(NAMES_OUT[kind].split())}"'
        if kind in ROLES and often(0.15):
            name += f' role="{ROLES[kind]}"'
        if kind in ("menu", "share"):
            some = links(2, 9) if kind == "menu" else links(1, 4)
            body = "".join(f"<li>{x}</li>" for x in some) if often(0.6) or tag == "ul" else rng.choice((" | ", " ", " / ")).join(some)
            body = body if tag == "ul" or not body.startswith("<li>") else f"<ul>{body}</ul>"
        elif kind == "ad":
            body = rng.choice((sentence(3, 14), f"<p>{sentence(3, 20)}</p>", f'<a href="/x">{sentence(2, 8)}</a>', f"{sentence()} {sentence()}"))
        elif kind == "side":
            body = f"<h3>{words(1, 3)}</h3>" * often(0.6) + rng.choice((f"<p>{prose(1, 6)}</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in links(2, 6)) + "</ul>", f"<article><h4>{words(2, 6)}</h4><p>{sentence()}</p></article>" * rng.randint(1, 3)))
        elif kind == "comments":
            one = lambda: rng.choice((f"<p>{prose(1, 4)}</p>", f'<article class="comment"><p>{prose(1, 4)}</p></article>', f'<div class="comment"><b>{word()}</b><p>{prose(1, 3)}</p></div>'))
            body = f"<h3>{words(1, 2)}</h3>" * often(0.5) + "".join(one() for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input><button>{word()}</button>" + f"<p>{sentence()}</p>" * often(0.4)
        elif kind == "head":
            body = f"<a href='/'>{words(1, 3)}</a>" + f"<p>{words(2, 7)}</p>" * often(0.5) + left_out("menu") * often(0.4)
        else:
            body = rng.choice((sentence(3, 25), f"<p>{prose(1, 3)}</p>", f"&copy; {words(1, 6)} " + " ".join(links(0, 3))))
        out = f"<{tag}{name}>{body}</{tag}>"
        return f"<!--end-->{out}<!--begin-->" if within else out

    def piece(semantic: bool) -> str:
        k = rng.random()
        named = rng.choice(("", "", "", f' id="{rng.choice(NAMES_WITHIN)}"', f' class="{rng.choice(NAMES_WITHIN)}"'))
        if k < 0.14:
            level = rng.randint(2, 4)
            return f"<h{level}{named}>{words(1, 6)}</h{level}>"
        if k < 0.24:
            kind = rng.choice(("ul", "ol"))
            item = lambda: rng.choice((words(1, 9), sentence(), links(1, 1)[0], f"{links(1, 1)[0]} {words(1, 6)}"))
            return f"<{kind}>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(1, 6))) + f"</{kind}>"
        if k < 0.29:
            return f"<table{named}>" + "".join("<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if k < 0.35:
            return rng.choice((f"<blockquote><p>{prose(1, 3)}</p></blockquote>", f"<pre><code>{words(2, 12)}</code></pre>", f'<figure><img src="x"><figcaption>{words(2, 9)}</figcaption></figure>', f"<dl><dt>{word()}</dt><dd>{sentence()}</dd></dl>"))
        if k < 0.40:
            return rng.choice((f"<address>{words(2, 8)}</address>", f"<center>{words(2, 9)}</center>", "<hr>", f"<div>{prose(1, 3)}</div>", f"<p><a href='/x'>{words(2, 6)}</a></p>"))
        if k < 0.47 and semantic:
            return f'<section id="{rng.choice(NAMES_WITHIN)}"><h2>{words(1, 4)}</h2><p>{prose(1, 4)}</p></section>' if often(0.6) else f"<section><p>{prose(1, 4)}</p></section>"
        if k < 0.55:
            return left_out(rng.choice(("ad", "ad", "share", "side", "menu", "notice", "form")), within=True)
        return f"<p{named}>{prose(1, 7)}" + "</p>" * often(0.8)

    def page(nr: int) -> str:
        style = rng.choice(("semantic", "semantic", "named", "named", "old"))
        size = rng.choice((0, 1, 3, 8, 15))
        body = f"<h1>{words(1, 9)}</h1>" + "".join(piece(style == "semantic") for _ in range(size))
        if style == "semantic" and often(0.2):
            body = f"<header>{body[: body.index('</h1>') + 5]}</header>{body[body.index('</h1>') + 5 :]}"
        body = f"<!--begin-->{body}<!--end-->"
        if often(0.2):
            return f"<html><body>{''.join(left_out(rng.choice(list(NAMES_OUT))) for _ in range(rng.randint(1, 3)))}</body></html>"
        kinds = [k for k in ("head", "menu", "ad", "notice", "side") if often(0.5)]
        after = [k for k in ("side", "comments", "share", "ad", "form", "notice", "foot", "menu") if often(0.4)]
        if style == "semantic":
            tail = left_out("comments") * often(0.15) + left_out("foot") * often(0.15)
            core = rng.choice((f"<article>{body}{tail}</article>", f"<main>{body}</main>", f"<main><article>{body}{tail}</article></main>", f'<article class="{rng.choice((*NAMES_IN, "post category-social", "post has-sidebar"))}">{body}</article>'))
        elif style == "named":
            core = f'<div {rng.choice(("class", "id"))}="{rng.choice(NAMES_IN)}">{body}</div>'
        else:
            core, kinds, after = body, [k for k in kinds if k == "ad"], [k for k in after if k == "foot"]
            row = "<table><tr>" + "".join(f"<td>{x}</td>" for x in links(2, 8)) + "</tr></table>"
            core = rng.choice((row, f"<center><font>{' | '.join(links(2, 8))}</font></center><hr>", "<br>".join(links(3, 8)) + "<hr>")) + core + f"<hr>{' '.join(links(1, 5))}" * often(0.5)
        if style != "old" or often(0.2):
            strays = lambda: f"<div>{words(2, 12)}</div>" if style == "semantic" and often(0.4) else ""
            core = strays() + core + strays()
            while often(0.5) and size > 3:
                core = f'<div {rng.choice(("class", "class", "id"))}="{rng.choice(NAMES_AROUND)}">{core}{left_out("side") * often(0.3)}</div>'
            if often(0.3) and size > 3:
                core = f"<form>{core}</form>"
        return f"<html><head><title>{words(1, 4)}</title></head><body>{''.join(left_out(k) for k in kinds)}{core}{''.join(left_out(k) for k in after)}</body></html>"

    return tuple(page(i) for i in range(n))


def bare_pages(n: int = LABELLED_PAGES // 2, seed: int = 12) -> tuple[str, ...]:
    """Make labelled bare pages by rule: text with no markup but its own, and rows of links above and below, with or without lines between."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "le", "mi", "no", "ru", "sta", "ter", "ven", "do", "ka")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 18).capitalize() + rng.choice((".", ".", "!", "?", ""))
    prose = lambda: " ".join(sentence() + f' <a href="/x">{word()}</a>' * (rng.random() < 0.1) + f" <b>{word()}</b>" * (rng.random() < 0.1) for _ in range(rng.randint(1, 6)))

    def links() -> str:
        some = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(1, 8))]
        return rng.choice((" | ".join(some), " ".join(some), "<br>".join(some), "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>", "<table><tr>" + "".join(f"<td>{x}</td>" for x in some) + "</tr></table>"))

    def page() -> str:
        parts = [prose() for _ in range(rng.choice((1, 1, 2, 4, 9)))]
        text = rng.choice((lambda: "<br>".join(parts), lambda: "<br><br>".join(parts), lambda: "".join(f"<p>{x}</p>" for x in parts), lambda: "".join(f"<div>{x}</div>" for x in parts), lambda: " ".join(parts), lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in parts) + "</ul>", lambda: f"<pre>{' '.join(parts)}</pre>", lambda: "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in parts) + "</table>"))()
        text = rng.choice(("", "", f"<h1>{words(1, 8)}</h1>", f"<center><b>{words(1, 8)}</b></center>", f"<h2>{words(1, 6)}</h2><p>")) + text
        if rng.random() < 0.15:
            text = rng.choice((words(1, 3), f"<p>{words(1, 4)}</p>", f"<h1>{words(1, 4)}</h1>"))
        between = rng.choice(("<hr>", "<br><br>", "<br>"))
        above, below = links() + between if rng.random() < 0.4 else "", between + links() if rng.random() < 0.4 else ""
        text = f"{above}<!--begin-->{text}<!--end-->{below}" if rng.random() < 0.93 else links()
        return rng.choice((text, f"<body>{text}</body>", f"<div>{text}</div>", f"<html><head><title>{words(1, 4)}</title></head><body>{text}</body></html>"))

    return tuple(page() for _ in range(n))


@lru_cache(maxsize=4)
def default_weights(n: int = LABELLED_PAGES) -> Weights:
    return learn_weights(labelled_pages(n), bare_pages(n // 2))


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html") -> DataFrame:
    """Add text and n_chars (code points) to every page, from its whole html.

    Null and empty html give an empty text, and so do pages of menus, adverts or tags alone. Rows are
    handled one by one and repeated rows alike; columns named text or n_chars are replaced.
    """
    weights = weights or default_weights()
    bounded_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")

    @F.pandas_udf("string")
    def text_of(source):
        return source.map(lambda s: main_text(s, weights))

    out = pages.withColumn("text", text_of(html_col))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_text(pages: DataFrame) -> DataFrame:
    """Extract the main text of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
