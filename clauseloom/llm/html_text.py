"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags. Each block has a vector of hashed
tag-path tokens (tag names, words of class and id), hashed words and a few measures. A bidirectional
LSTM in numpy reads the sequence of a page's blocks and labels each with the whole page as context;
blocks labelled as article are the main text.

The labeller is trained here, on pages that :func:`made_up_page` lays out in many ways (bounded: ``PAGES``),
with a fixed seed, so every run has the same weights. Text and markup of the made-up pages are random
but for the usual names of page parts; elements whose names tell nothing stand around the article and other parts, so
that content and place decide there. The pages of a corpus are never used for training. What is hidden isn't read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

PATH, WORDS, MEASURES = 112, 48, 6
D = PATH + WORDS + MEASURES
HIDDEN, PAGES, EPOCHS, BATCH, RATE = 20, 4000, 12, 50, 0.02
#: Words of a block up to which each weighs the same.
USUAL = 16
#: Pages that are labelled at once.
AT_ONCE = 128

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page. What else a head holds is void; it ends with its first other tag or text, so it needs no end tag.
RAW = set("script style noscript template textarea title svg math iframe object canvas audio video select button xmp noframes".split())
#: Block-level tags that a select holds itself.
OPTIONS = {"option", "optgroup", "hr"}
#: A start tag ends an open element of these kinds, if that is nearer than the second set.
CLOSES = {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A tag whose attributes hold no angle brackets; others are read by :class:`Scanner`.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDES = re.compile(r"(?:^|\s)hidden(?:\s|=|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAME = re.compile(r"[a-z]+")


class Scanner:
    """Finds the tags and comments of a page, in time linear in its length.

    Quotes hide a ``>``. Where no other one is left, a tag ends at the first ``>`` instead; the places
    between quotes that such a search has passed are kept, since another one that comes to them ends alike.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag; comments and the like have no name."""
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if m := PLAIN_TAG.match(page, i):
                return i, m.end(), bool(m[1]), m[2].lower(), m[3]
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(page), False, "", ""
            if i > self.last[">"]:
                at = page.find("<!--", i)
                if at < 0:
                    return None
                continue
            if m := TAG_NAME.match(page, i):
                end = self.tag_end(m.end())
                return i, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            if page[i + 1 : i + 2] in ("!", "?", "/"):
                return i, page.find(">", i) + 1, False, "", ""
            at = i + 1
        return None

    def tag_end(self, at: int) -> int:
        first, passed = self.page.find(">", at), []
        while m := QUOTE_OR_END.search(self.page, at):
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last[m[0]]:
                break
            at = self.page.find(m[0], m.end()) + 1
            if at in self.dead or at > self.last[">"]:
                break
            passed.append(at)
        self.dead.update(passed)
        return first


class Path:
    """The tokens of all open elements, as a chain; each adds to its parent's vector, a token that is open already once only."""

    __slots__ = ("parent", "tokens", "vector")

    def __init__(self, parent: Path | None, tokens: tuple[str, ...], new: list[str]):
        self.parent, self.tokens = parent, tokens
        self.vector = np.zeros(PATH, np.float32) if parent is None else parent.vector.copy() if new else parent.vector
        for t in new:
            if (k := OWN_AT.get(t)) is not None:
                self.vector[k] = 1.0
            else:
                k, sign = bucket(t, PATH - len(OWN))
                self.vector[len(OWN) + k] += 0.5 * sign

    def __iter__(self) -> Iterator[str]:
        node = self
        while node is not None:
            yield from node.tokens
            node = node.parent


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            out += [f"{'role' if name.lower() == 'role' else ''}.{w}" for w in NAME.findall(value.lower())]
        if HIDES.search(attributes):
            out.append(".hidden")
    return tuple(out)


def raw_ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a raw tag end, by where they start; those without an end tag of their own are left out."""
    out, open_ = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def unclosed_end(scanner: Scanner, at: int, tag: str) -> int:
    """Where the content of a raw element without end tag stops: at the next block-level tag or the end tag of what it stands in."""
    page, inner, open_ = scanner.page, [], Counter()
    while token := scanner.next(at):
        start, at, closes, name, _ = token
        if (name in BLOCKS or name == "form") and not (tag == "select" and name in OPTIONS):
            return start
        if name and closes and name not in OPTIONS:
            if not open_[name]:
                return start
            while True:
                open_[inner[-1]] -= 1
                if inner.pop() == name:
                    break
        elif name in ("script", "style") and not closes:
            end = end_tag(page, name, at)
            at = end if end is not None else len(page)
        elif name and name not in VOID and name not in OPTIONS:
            inner.append(name)
            open_[name] += 1
    return len(page)


def end_tag(page: str, name: str, at: int) -> int | None:
    """Where the next end tag of an element without inner elements ends."""
    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return end + 1 if end >= 0 else None


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space normalised; empty ones and those that are hidden are left out."""
    out: list[Block] = []
    root = Path(None, (), [])
    stack: list[tuple[str, Path]] = []
    open_tokens: Counter[str] = Counter()
    text: list[str] = []
    ends_of: dict[str, dict[int, int]] = {}
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    scanner = Scanner(page)
    links = linked = at = 0

    def close() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words and not open_tokens[".hidden"]:
                out.append(Block(stack[-1][1] if stack else root, " ".join(words), linked))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        close()
        while len(stack) > k:
            tag, path = stack.pop()
            open_at[tag].pop()
            open_tokens.subtract(path.tokens)

    n = len(page)
    while at < n:
        token = scanner.next(at)
        start, end, closes, tag, attributes = token or (n, n, False, "", "")
        if start > at:
            data = page[at:start]
            if not token and (k := data.rfind("<")) >= 0 and re.match(r"<(?:[a-zA-Z/!?]|\Z)", data[k:]):
                data = data[:k]  # a tag that the page's end cuts off
            if "&" in data:
                data = html.unescape(data)
            text.append(data)
            if links:
                linked += len(data)
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS or tag == "form":
                if open_at[tag]:
                    pop_to(open_at[tag][-1])
                else:
                    close()
            continue
        if tag in RAW:
            if tag == "title":
                close()
            if not attributes.rstrip().endswith("/") or tag in ("script", "style"):
                if tag in ("script", "style"):  # their content holds no elements
                    stop = None if tag in ends_of else end_tag(page, tag, at)
                    if stop is None:
                        ends_of[tag] = {}  # nor do later ones end
                else:
                    if tag not in ends_of:
                        ends_of[tag] = raw_ends(page, tag)
                    stop = ends_of[tag].get(start)
                if stop is None:
                    stop = n if tag == "script" else unclosed_end(scanner, at, tag)
                at = stop
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "head":
            close()
        elif tag == "a":
            links += 1
        elif tag in BLOCKS or tag == "form":
            close()
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                stop = max((open_at[s][-1] for s in stops if open_at[s]), default=-1)
                first = [open_at[e][bisect_right(open_at[e], stop)] for e in ends if open_at[e] and open_at[e][-1] > stop]
                if first:
                    pop_to(min(first))
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section", "blockquote", "pre", "form", "footer", "header", "nav", "aside", "article", "p") and stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if tag not in VOID:
                tokens = path_tokens(tag, attributes)
                open_at[tag].append(len(stack))
                stack.append((tag, Path(stack[-1][1] if stack else root, tokens, [t for t in dict.fromkeys(tokens) if not open_tokens[t]])))
                open_tokens.update(tokens)
            links = 0
    close()
    return out


@lru_cache(maxsize=100_000)
def bucket(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 31 else -1.0


#: Tokens with places of their own in the path vector; all others share the rest by hash.
OWN = [*"article main section div p li a h1 h2 h3 table td form nav aside footer header blockquote pre ul ol dl figure body html".split(), *".ad .ads .advert .sponsored .promo .nav .menu .sidebar .footer .foot .copyright .legal .header .masthead .cookie .consent .banner .notice .comment .comments .related .share .widget .newsletter .search .content .article .post .entry .main .text .body .hidden".split()]
OWN_AT = {t: i for i, t in enumerate(OWN)}


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block."""
    out = np.zeros((len(page), D), np.float32)
    for i, b in enumerate(page):
        row = out[i]
        row[:PATH] = b.path.vector
        words = b.text.lower().split()
        # counts of all words; in long blocks they weigh less, as their sums scatter more, and no word outweighs all else
        at, sign = zip(*[bucket(w, WORDS) for w in words], strict=True)
        row[PATH : PATH + WORDS] = np.tanh(np.bincount(at, sign, WORDS) * (0.15 * min(1.0, (USUAL / len(words)) ** 0.5)))
        n = len(words)
        size = max(1, len(b.text))
        row[PATH + WORDS :] = (np.log1p(n) / 5, min(1.0, b.linked / size), sum(b.text.count(c) for c in ".,;") / size * 20, i / max(1, len(page) - 1), 1.0 if n > 12 else 0.0, 1.0 if "©" in b.text else 0.0)
    return out


def made_up_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page in one of many layouts, and the article's blocks."""
    syllables = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouäéö") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    noisy = rng.choice(["", "", "", "%%%", "***", "!!", " |", "&amp;&amp;"])

    def words(n: int, noise: str = "") -> str:
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + noise for _ in range(n)]
        for i in range(len(out)):
            if rng.random() < 0.12:
                out[i] += rng.choice([",", ".", ".", ";"])
        return " ".join(out).capitalize()

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def neutral() -> str:
        """The attribute of an element whose name tells nothing."""
        if rng.random() < 0.2:
            return ""
        plain = [rng.choice(("wrap", "row", "col", "box", "block", "inner", "outer", "page", "grid", "container", "wrapper", "section", "primary", "layout", "site", "center", "left", "right")), rng.choice(syllables), rng.choice("abcdexyz") + rng.choice(("-", "")) + str(rng.randint(1, 99)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))]
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(plain, rng.choice((1, 1, 2))))}{rng.choice(("", "", "-" + str(rng.randint(1, 12))))}"'

    def wrapped(inner: str, most: int) -> str:
        for _ in range(rng.randint(0, most)):
            inner = f"<div{neutral()}>{inner}</div>"
        return inner

    def attr(*names: str) -> str:
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}{rng.choice(["", "", " x" + str(rng.randint(1, 9)), "-" + rng.choice(syllables[:5])])}"'

    def menu() -> str:
        items = "".join(f"<li>{link(words(rng.randint(1, 2)))}</li>" for _ in range(rng.randint(3, 9)))
        tag, a = rng.choice([("nav", ""), ("div", attr("menu", "nav", "navbar", "breadcrumb", "toolbar", "links", "tabs", "navigation")), ("nav", attr("main-nav", "top"))])
        return rng.choice([f"<{tag}{a}><ul>{items}</ul></{tag}>", f"<{tag}{a}>{' | '.join(link(words(1)) for _ in range(5))}</{tag}>"])

    def header() -> str:
        return rng.choice([f"<header{rng.choice(['', attr('header', 'masthead')])}>{rng.choice(['<h1>' + words(2) + '</h1>', '<p>' + words(4) + '</p>', '<div>' + link(words(2)) + '</div>'])}</header>", f"<div{attr('header', 'masthead', 'site-header', 'topbar', 'branding', 'head', 'top')}><p>{words(rng.randint(1, 6))}</p></div>"])

    def footer() -> str:
        text = rng.choice([f"&copy; {words(2)} &middot; {words(rng.randint(2, 12))}", f"© 20{rng.randint(10, 25)} {words(3)}. All rights reserved.", f"{link('Privacy')} | {link('Terms')} | {link('Contact')}", words(rng.randint(4, 20))])
        return rng.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><p>{words(3)}</p></footer>", f"<div{attr('footer', 'site-footer', 'copyright', 'bottom', 'foot', 'page-foot', 'colophon', 'legal', 'imprint')}>{text}</div>"])

    def advert() -> str:
        a = attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsense")
        return rng.choice([f"<!-- ad {rng.randint(0, 9)} --><div{a}>{words(rng.randint(3, 40))}</div>", f"<aside{a}><p>{words(rng.randint(3, 30))}</p></aside>", f"<div{a}><p>Advertisement</p><p>{words(rng.randint(3, 20))}</p></div>"])

    def notice() -> str:
        return f"<div{attr('cookie', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal')}{rng.choice(['', ' role=dialog'])}><p>{rng.choice(['We use cookies. ', 'Please accept our cookies. ', '', 'Subscribe now: '])}{words(rng.randint(4, 30))}</p><button>OK</button></div>"

    def form() -> str:
        return f"<form action='/s'{rng.choice(['', attr('search', 'newsletter', 'subscribe', 'login')])}><label>{words(rng.randint(1, 8))}</label><input type=text><p>{words(rng.randint(2, 12))}</p></form>"

    def sidebar() -> str:
        items = "".join(f"<li>{link(words(rng.randint(2, 8)))}</li>" for _ in range(rng.randint(2, 7)))
        head = rng.choice(["", f"<h{rng.randint(2, 4)}>{words(2)}</h3>"])
        body = rng.choice([f"<ul>{items}</ul>", f"<p>{words(rng.randint(5, 60))}</p>", f"<p>{words(20)}</p><ul>{items}</ul>"])
        return rng.choice([f"<aside>{head}{body}</aside>", f"<div{attr('sidebar', 'side', 'widget', 'related', 'recommended', 'more', 'share', 'social', 'tags', 'popular')}>{head}{body}</div>", f"<section{attr('related', 'sidebar', 'recommended')}>{head}{body}</section>"])

    def comments() -> str:
        posts = [words(rng.randint(3, 50)) for _ in range(rng.randint(1, 5))]
        head = rng.choice(["<h3>Comments</h3>", f"<h2>{len(posts)} comments</h2>", ""])
        return rng.choice([f"<div{attr('comments', 'comment-list', 'discussion', 'replies', 'disqus')}>{head}" + "".join(f"<div class=comment><p>{p}</p></div>" for p in posts) + "</div>", f"<section{attr('comments', 'responses')}>{head}<ol>" + "".join(f"<li><p>{p}</p></li>" for p in posts) + "</ol></section>", f"<ul{attr('commentlist', 'comments')}>" + "".join(f"<li>{p}</li>" for p in posts) + "</ul>"])

    wanted: list[str] = []

    def said(text: str) -> str:
        wanted.append(" ".join(html.unescape(text).split()))
        return text

    def article() -> str:
        noise, out = noisy, []
        level = rng.randint(1, 2)
        if rng.random() < 0.85:
            out.append(f"<h{level}>{said(words(rng.randint(2, 12), noise))}</h{level}>")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14, 22])):
            kind, n = rng.random(), rng.choice([1, 2, 4, 8, 15, 30, 60, 120])
            if kind < 0.7:
                inner = said(words(n, noise))
                out.append(rng.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>", f"<div>{inner}</div>"]))
            elif kind < 0.78:
                out.append(f"<h{level + 1}>{said(words(rng.randint(1, 7)))}</h{level + 1}>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{said(words(rng.randint(1, 18)))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{said(words(rng.randint(5, 30)))}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{said(words(rng.randint(1, 4)))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{said(words(8))}</pre>")
            elif rng.random() < 0.5:
                out.append(advert())
            else:
                out.append(f"<p>{said(words(10))}</p>" + form())
        if not wanted:
            out.append(f"<p>{said(words(20))}</p>")
        return "".join(out)

    around = rng.random() < 0.6  # elements of neutral names stand around the article and other parts
    tag, a = rng.choice([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("article", attr("post", "entry", "story")), ("div", attr("content", "main", "article", "post", "entry-content", "story", "body", "text")), ("section", attr("content", "article-body", "main")), ("td", attr("content", "main"))])
    if around and rng.random() < 0.75:
        tag, a = rng.choice(["div", "div", "div", "section", "main", "td"]), neutral()
    body = article()
    main = f"<{tag}{a}>{body}</{tag}>"
    if around and tag == "div" and rng.random() < 0.3:  # each block, or some of them, in an element of its own
        pieces, each = re.split(r"(?<=</p>)(?=<p>)|(?<=</h1>)|(?<=</h2>)", body), neutral()
        main = "".join(f"<div{each if rng.random() < 0.7 else neutral()}>{p}</div>" for p in pieces)
    if tag == "td":
        main = f"<table><tr><td>{menu()}</td>{main}</tr></table>"
    elif rng.random() < 0.25:
        main = f"<main>{main}{rng.choice([comments, sidebar])()}</main>" if tag != "main" else main
    before = [f() for f in rng.sample([menu, header, advert, notice, form, sidebar], rng.randint(0, 4))]
    after = [f() for f in rng.sample([footer, comments, sidebar, advert, form, notice], rng.randint(0, 4))]
    if rng.random() < 0.5:
        before, after = [menu(), *([advert()] if rng.random() < 0.7 else [])], [footer()]
    if around:
        main, before, after = wrapped(main, 3), [wrapped(x, 1) for x in before], [wrapped(x, 1) for x in after]
        if rng.random() < 0.3:  # something stands beside the article, in one element with it
            main = f"<div{neutral()}>{main}{rng.choice([sidebar, comments, form, advert])()}</div>"
        if rng.random() < 0.4:
            before, main, after = [], wrapped("".join(before) + main + "".join(after), 2), []
    if tag in ("article", "div", "section") and rng.random() < 0.12:
        main = main.removesuffix(f"</{tag}>") + f"{comments()}</{tag}>"
    bare = rng.random()
    if bare < 0.14:  # nothing stands around the article
        main = body
        if bare < 0.04:
            before, after = [], []
        if bare < 0.03:
            return rng.choice([body, f"<html><body>{body}</body></html>"]), wanted
    elif bare < 0.17:
        wanted = [" ".join(words(rng.choice([5, 20, 60, 200]), noisy).split())]
        return wanted[0], [html.unescape(wanted[0])]
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{rng.choice(['<script>var x=1;</script>', ''])}{''.join(before)}{main}{''.join(after)}{rng.choice(['</body></html>', '</body></html>', ''])}"
    return page, wanted


class Labeller:
    """A bidirectional LSTM; a block's logit is read from both directions' states."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(D), (D, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        self.w["oc"] = np.zeros(1, np.float32)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """x: blocks x pages x D; mask: 1 where a page has that block."""
        steps, pages, _ = x.shape
        gates = x.reshape(-1, D) @ self.w[f"x{d}"] + self.w[f"c{d}"]
        gates = gates.reshape(steps, pages, 4 * HIDDEN)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self.states(x, mask, d, tapes[k] if tapes else None) for k, d in enumerate("fb")], axis=2)
        return (both @ self.w["o"])[:, :, 0] + self.w["oc"], both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tapes: tuple[list, list] = ([], [])
        logit, both = self.logits(x, mask, tapes)
        d_logit = (mask * (1 / (1 + np.exp(-logit)) - y) / mask.sum()).astype(np.float32)[:, :, None]
        out = {"o": both.reshape(-1, 2 * HIDDEN).T @ d_logit.reshape(-1, 1), "oc": d_logit.sum((0, 1))}
        d_both = d_logit @ self.w["o"].T
        for k, d in enumerate("fb"):
            d_out = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_w = np.zeros_like(self.w[f"h{d}"])
            dh = dc = np.zeros(d_out.shape[1:], np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(tapes[k]):
                dh = dh + d_out[t]
                own_h, own_c = m * dh, m * dc
                own_c = own_c + own_h * o * (1 - tc * tc)
                z = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                dz[t] = z
                d_w += h.T @ z
                dh = (1 - m) * dh + z @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + own_c * f
            flat = dz.reshape(-1, 4 * HIDDEN)
            out |= {f"x{d}": x.reshape(-1, D).T @ flat, f"h{d}": d_w, f"c{d}": flat.sum(0)}
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page: which of its blocks are article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < AT_ONCE and len(pages[order[stop]]) * (stop - start) < 20_000:
                stop += 1
            x, mask = padded([vectors(pages[k]) for k in order[start:stop]])
            yes = self.logits(x, mask)[0] > 0
            for i, k in enumerate(order[start:stop]):
                out[k] = yes[: len(pages[k]), i]
            start = stop
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), D), np.float32), np.zeros((steps, len(rows)), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
        mask[: len(r), i] = 1
    return x, mask


@lru_cache(maxsize=1)
def trained(seed: int = 11) -> Labeller:
    """The labeller, trained with Adam on made-up pages."""
    rng = random.Random(seed)
    data = []
    while len(data) < PAGES:
        page, wanted = made_up_page(rng)
        own, left, y = blocks(page), list(wanted), []
        for b in own:  # the article's blocks come in order
            hit = bool(left) and b.text == left[0]
            y.append(hit)
            if hit:
                left.pop(0)
        if not left and own:
            data.append((vectors(own), np.array(y, np.float32)))
    net = Labeller()
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in net.w.items()}
    data.sort(key=lambda d: len(d[0]))
    groups, n = [data[i : i + BATCH] for i in range(0, len(data), BATCH)], 0
    for epoch in range(EPOCHS):
        rng.shuffle(groups)
        for group in groups:
            x, mask = padded([d[0] for d in group])
            y = padded([np.repeat(d[1][:, None], D, 1) for d in group])[0][:, :, 0]
            n += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                net.w[k] = net.w[k] - (rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """``keep`` and ``text``: the blocks of each page that are labelled as article, in order, two line feeds between.

    Null and empty pages, and pages without such blocks, give an empty text. Rows are independent:
    repeats stay, other columns are ignored, an empty table gives an empty result.
    """
    weights = pages.sparkSession.sparkContext.broadcast(trained().w)
    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = weights.value
        for batch in batches:
            for row in range(0, len(batch), 512):
                part = batch.slice(row, 512)
                read = [blocks(p) if p else [] for p in part.column(len(keep)).to_pylist()]
                texts = ["\n\n".join(b.text for b, yes in zip(own, label.tolist(), strict=True) if yes) for own, label in zip(read, net.label(read), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return mapped(pages.select(*keep, F.col(column).alias("_html")), run, f"{types}, text string")
