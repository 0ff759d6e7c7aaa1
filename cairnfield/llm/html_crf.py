"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between the tags of block
elements, with the end tags that HTML lets authors leave out. A block has features
of its ancestors (tags, kinds of their class and id names) and of its text (words,
links, punctuation, place). The field labels the sequence of blocks as main text or
not, is fitted on labelled pages by maximum likelihood with forward-backward sums,
and decodes by Viterbi. Without labelled pages of one's own it is fitted on pages
that `labelled_pages` makes in many layouts.

Labelled pages carry the attribute `data-main` on elements of the main text; it is
never a feature.

Defined results: null, empty and textless pages have an empty text; unclosed tags,
comments, quotes and scripts end with the page, and other elements whose texts are
not read with the block around them; a self-closed svg or math is empty; ties in decoding go to main text; repeated
rows are each extracted; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe head".split())
#: Elements without text of the page, of which markup is read to find their end; texts of math, object and noscript are read.
SKIPPED = frozenset("template svg select canvas audio video".split())
FOREIGN = frozenset({"svg", "math"})
_HTML_INSIDE = frozenset({"foreignobject", "desc", "title"})
BLOCK = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body button caption dd dt legend li option optgroup summary tbody td tfoot th thead tr".split())
#: Start tags that end an open element of a set, unless a boundary stands between.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Kinds of names in class and id attributes.
NAMES = {
    "content": "article articlebody post entry content story text prose body main page blog news read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip links sitemap topbar",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promoted banner adslot dfp outbrain taboola",
    "side": "sidebar side aside widget widgets related recommended recommendations more popular trending rail",
    "social": "share sharing social follow newsletter subscribe signup subscription tags tag",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader readers feedback",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay warning announcement toast privacy paywall",
    "head": "header head masthead logo brand tagline hero site",
    "foot": "footer foot copyright legal bottom colophon imprint credits",
    "form": "form search login register input field contact",
}
_GROUP = {name: group for group, names in NAMES.items() for name in names.split()}
ANCESTORS = "article main section nav header footer aside form ul ol li table blockquote figure figcaption p h1 h2 h3 h4 h5 h6 button label address dl pre details dialog a div".split()
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "main": "content", "article": "content", "dialog": "notice", "alert": "notice", "alertdialog": "notice"}
FEATURES = [
    "bias",
    *(f"in {x}" for x in ANCESTORS),
    *(f"own {x}" for x in ANCESTORS),
    *(f"named {x}" for x in NAMES),
    *(f"own name {x}" for x in NAMES),
    "hidden", "article in article", "no article", "links none", "links some", "links most", "links all", "words 1", "words 2-4", "words 5-12", "words 13-40", "words more",
    "ends sentence", "comma", "copyright", "bar", "many digits", "many capitals", "first", "last", "shallow", "deep",
]
_BIT = {name: 1 << k for k, name in enumerate(FEATURES)}

_TOKEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->)?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>?|<[!?/][^>]*+>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Frame(NamedTuple):
    tag: str
    mask: int  # features of this element and those around it
    own: int  # features of a block directly in it
    main: bool


class Block(NamedTuple):
    text: str
    mask: int
    main: bool


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE)


def _named(value: str) -> set[str]:
    return {_GROUP[x] for x in map(str.lower, _NAME.findall(value)) if x in _GROUP}


def _frame(parent: Frame, tag: str, attributes: str) -> Frame:
    mask, own, main = parent.mask, 0, parent.main
    if tag == "article" and mask & _BIT["in article"]:
        mask |= _BIT["article in article"]
    if f"in {tag}" in _BIT:
        mask |= _BIT[f"in {tag}"]
        own |= _BIT[f"own {tag}"]
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for group in _named(value):
                    mask |= _BIT[f"named {group}"]
                    own |= _BIT[f"own name {group}"]
            elif name == "role" and value.lower() in ROLES:
                mask |= _BIT[f"named {ROLES[value.lower()]}"]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                mask |= _BIT["hidden"]
            elif name == "data-main":
                main = value != "0"
    return Frame(tag, mask, own, main)


def _skipped_end(html: str, at: int, tag: str, around: set[str]) -> int:
    """Where an element that began before `at` ends: after its end tag, or before a tag that ends it as it was left open."""
    inner = [tag]
    while m := _TOKEN.search(html, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in inner:
                del inner[len(inner) - 1 - inner[::-1].index(name) :]
                if not inner:
                    return at
            elif name in BLOCK and name in around:
                return m.start()
        elif tag == "svg" and name in BLOCK and not _HTML_INSIDE.intersection(inner):
            return m.start()
        elif name in RAW and name not in _HTML_INSIDE and name != "head":
            end = _raw_end(name).search(html, at)
            at = end.end() if end else len(html)
        elif (name in BLOCK or name in SKIPPED or name in _HTML_INSIDE) and name not in VOID and not (m[3] if m[2] else m[6]).endswith("/"):
            inner.append(name)
    return len(html)


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in page order, with their features as bits."""
    stack = [Frame("", _BIT["bias"], 0, False)]
    out: list[tuple[str, Frame, int, int]] = []
    parts: list[str] = []
    linked = links = at = 0
    frame: Frame | None = None  # where the block's text began

    def flush() -> None:
        nonlocal linked, frame
        if parts:
            text = " ".join("".join(parts).split())
            if text and frame is not None:
                out.append((text, frame, linked, len(stack)))
            parts.clear()
        linked, frame = 0, None

    def holder() -> Frame:
        for x in reversed(stack):
            if x.tag in BLOCK or not x.tag:
                return x
        return stack[0]

    def add(raw: str) -> None:
        nonlocal linked, frame
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            if frame is None:
                inner, block = stack[-1], holder()
                frame = Frame(block.tag, inner.mask, block.own, inner.main)
            if links:
                linked += len(text.strip())

    def pop_to(index: int) -> None:
        nonlocal links
        links -= sum(x.tag == "a" for x in stack[index:])
        del stack[index:]

    size = len(html)
    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            add(html[at:])
            break
        if cut > at:
            add(html[at:cut])
        m = _TOKEN.match(html, cut)
        if m is None:
            add("<")
            at = cut + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        attributes = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            block = tag in BLOCK
            if block:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if not block and stack[k].tag in BLOCK:
                    break
            continue
        if tag in RAW:
            if tag == "head":
                body = re.compile(r"</head\b[^>]*>|<body\b", re.IGNORECASE).search(html, at)
                at = (body.end() if body and body[0][1] == "/" else body.start()) if body else at
                continue
            end = _raw_end(tag).search(html, at)
            at = end.end() if end else size
            continue
        if tag in FOREIGN and attributes.endswith("/"):
            continue
        if tag in SKIPPED:
            at = _skipped_end(html, at, tag, {x.tag for x in stack})
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    keep = k
                    while keep > 1 and stack[keep - 1].tag in ends:
                        keep -= 1
                    pop_to(keep)
                    break
                if stack[k].tag in until:
                    break
        stack.append(_frame(stack[-1], tag, attributes))
        links += tag == "a"
    flush()
    articles = any(f.mask & _BIT["in article"] for _, f, _, _ in out)
    return [Block(text, _text_mask(text, f, linked, depth, k, len(out), articles), f.main) for k, (text, f, linked, depth) in enumerate(out)]


def _text_mask(text: str, f: Frame, linked: int, depth: int, k: int, n: int, articles: bool) -> int:
    mask = f.mask | f.own
    words = text.count(" ") + 1
    share = linked / len(text)
    mask |= _BIT["links none" if not linked else "links some" if share < 0.4 else "links most" if share < 0.9 else "links all"]
    mask |= _BIT["words 1" if words == 1 else "words 2-4" if words < 5 else "words 5-12" if words < 13 else "words 13-40" if words < 41 else "words more"]
    if text[-1] in ".!?…。！？\"”»":
        mask |= _BIT["ends sentence"]
    if ", " in text:
        mask |= _BIT["comma"]
    if "©" in text:
        mask |= _BIT["copyright"]
    if " | " in text or " · " in text:
        mask |= _BIT["bar"]
    if words < 41:
        if 4 * sum(map(str.isdigit, text)) > len(text):
            mask |= _BIT["many digits"]
        if 2 * sum(map(str.isupper, text)) > len(text):
            mask |= _BIT["many capitals"]
    if 10 * k < n:
        mask |= _BIT["first"]
    if 10 * (n - 1 - k) < n:
        mask |= _BIT["last"]
    if depth <= 4:
        mask |= _BIT["shallow"]
    elif depth > 8:
        mask |= _BIT["deep"]
    if not articles:
        mask |= _BIT["no article"]
    return mask


# ---------------------------------------------------------------------------------------------------------------------
# the field


class Field(NamedTuple):
    """Score of main text over other text by feature, and scores of transitions (from, to)."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, masks: list[int], memo: dict[int, float]) -> list[bool]:
        """The most likely labels by Viterbi."""
        if not masks:
            return []
        (a00, a01), (a10, a11) = self.step.tolist()
        other = main = 0.0
        back: list[tuple[bool, bool]] = []
        for k, mask in enumerate(masks):
            score = memo.get(mask)
            if score is None:
                if len(memo) > 200_000:
                    memo.clear()
                score = memo[mask] = float(sum(self.weight[b] for b in bits(mask)))
            if k:
                to_other, to_main = main + a10 > other + a00, main + a11 >= other + a01
                other, main = max(other + a00, main + a10), max(other + a01, main + a11)
                back.append((to_other, to_main))
            main += score
        label = main >= other
        out = [label]
        for to_other, to_main in reversed(back):
            label = to_main if label else to_other
            out.append(label)
        return out[::-1]


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def fit(pages: Iterable[str], *, steps: int = 250, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a square penalty, by Adam on all pages at once."""
    found = [x for x in map(blocks, pages) if x]
    if not found:
        return Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    longest = max(map(len, found))
    x = np.zeros((len(found), longest, len(FEATURES)), np.float32)
    y = np.zeros((len(found), longest), np.int64)
    there = np.zeros((len(found), longest), bool)
    for i, page in enumerate(found):
        for k, b in enumerate(page):
            x[i, k, list(bits(b.mask))] = 1
            y[i, k], there[i, k] = b.main, True
    n = there.sum()
    pair = there[:, 1:]
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    par = np.zeros(len(FEATURES) + 4)
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        move = par[-4:].reshape(2, 2)
        score = np.zeros((len(found), longest, 2))
        score[:, :, 1] = x @ par[:-4].astype(np.float32)
        score[~there] = 0
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(forward[:, k - 1, :1] + move[0], forward[:, k - 1, 1:] + move[1]) + score[:, k]
            forward[:, k] = np.where(there[:, k, None], new, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = score[:, k + 1] + backward[:, k + 1]
            new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            backward[:, k] = np.where(there[:, k + 1, None], new, 0)
        log_z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z[:, None]) * there
        joint = np.exp(forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        grad = np.concatenate([np.einsum("ikf,ik->f", x, (p - y * there).astype(np.float32)), ((joint * pair[:, :, None, None]).sum(axis=(0, 1)) - wanted).reshape(-1)]) / n
        grad += penalty * par / len(par)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par = par - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(par[:-4], par[-4:].reshape(2, 2))


# ---------------------------------------------------------------------------------------------------------------------
# labelled pages


def _sentence(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(("an", "er", "ti", "on", "la", "de", "sh", "ou", "ein", "és", "ka", "mi")) for _ in range(r.randint(1, 4))) for _ in range(n)]
    text = " ".join(w + ("," if r.random() < 0.1 else "") for w in words).rstrip(",")
    return text[:1].upper() + text[1:] + r.choice(("." if r.random() < 0.95 else "?", "."))


def _words(r: random.Random, low: int, high: int) -> str:
    return _sentence(r, r.randint(low, high)).rstrip(".?")


def _list(r: random.Random, n: int, kind: str = "ul") -> str:
    return f"<{kind}>" + "".join(f'<li><a href="/{k}">{_words(r, 1, 3)}</a></li>' for k in range(n)) + f"</{kind}>"


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Pages in many layouts whose main text carries `data-main`."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        semantic, named = r.random() < 0.7, r.random() < 0.85

        def box(tag: str, group: str, inner: str, semantic: bool = semantic, named: bool = named) -> str:
            own = tag if semantic or r.random() < 0.3 else "div"
            name = f' {r.choice(("class", "id"))}="{r.choice(NAMES[group].split())}{r.choice(("", "-box", " wide", "_1"))}"' if named or own == "div" and r.random() < 0.6 else ""
            return f"<{own}{name}>{inner}</{own}>"

        def paragraph() -> str:
            text = " ".join(_sentence(r, r.choice((1, 2, 4, 9, 15, 22))) for _ in range(r.choice((1, 1, 2, 4))))
            kind = r.random()
            if kind < 0.12:
                return f"<p><b>{text}<br>"
            if kind < 0.2:
                return f'<p>{text} <a href="/x">{_words(r, 1, 3)}</a> {_sentence(r, 5)}</p>'
            return f"<p>{text}</p>"

        body: list[str] = []
        bare = r.random() < 0.15  # little but the article itself
        for _ in range(r.randint(1, 3) if bare else r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                body.append(paragraph())
            elif kind < 0.79:
                body.append(f"<h{(k := r.randint(2, 4))}>{_words(r, 1, 6)}</h{k}>")
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{_sentence(r, r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                body.append(f"<blockquote><p>{_sentence(r, 12)}</p></blockquote>")
            elif kind < 0.91:
                body.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 2)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                body.append(f"<figure><img src=x><figcaption>{_sentence(r, 7)}</figcaption></figure>")
            elif kind < 0.95:
                body.append(f"<pre>{_words(r, 3, 8)}</pre>")
            elif kind < 0.98:
                body.append(f'<div data-main="0"{" class=" + r.choice(NAMES["advert"].split()) if r.random() < 0.8 else ""}>{_sentence(r, r.randint(3, 10))}</div>')
            else:
                body.append('<div data-main="0">' + box(r.choice(("aside", "div")), r.choice(("side", "social", "notice", "advert")), _sentence(r, r.randint(2, 9)) + (_list(r, 3) if r.random() < 0.5 else "")) + "</div>")
        title = f"<h1>{_words(r, 2, 10)}</h1>" if r.random() < (0.5 if bare else 0.85) else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inside = ""
        if r.random() < 0.15:
            inside = '<div data-main="0">' + box("footer", "social", _list(r, 3) + _words(r, 1, 4)) + "</div>"
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        name = f' class="{r.choice(NAMES["content"].split())}"' if r.random() < (0.9 if tag in ("div", "section") else 0.4) else ""
        content = f"<{tag}{name} data-main>{title}{''.join(body)}{inside}</{tag}>"
        if tag == "article" and r.random() < 0.3:
            content = f"<main>{content}</main>"
        before = [box("nav", "menu", _list(r, r.randint(2, 8)))] if r.random() < 0.85 else []
        if r.random() < 0.4:
            before.insert(0, box("header", "head", (f"<h1>{_words(r, 1, 2)}</h1>" if r.random() < 0.3 else f"<p>{_words(r, 1, 6)}</p>") + (_list(r, 4) if r.random() < 0.3 else "")))
        if r.random() < 0.3:
            before.append(box("div", "notice", f"<p>{_sentence(r, r.randint(4, 18))}</p><button>{_words(r, 1, 2)}</button>"))
        if r.random() < 0.15:
            before.append(box("div", "menu", " &raquo; ".join(f"<a href=/>{_words(r, 1, 1)}</a>" for _ in range(3))))
        if r.random() < 0.5:
            before.append(f'<div class="{r.choice(NAMES["advert"].split())}">{_sentence(r, r.randint(2, 12))}</div>')
        after: list[str] = []
        if r.random() < 0.35:
            after.append(box("aside", "side", f"<h3>{_words(r, 1, 3)}</h3>" + (_list(r, 4) if r.random() < 0.6 else f"<p>{_sentence(r, 12)}</p>")))
        if r.random() < 0.35:
            said = "".join(r.choice(("<li>{}</li>", "<div class=comment><p>{}</p></div>", "<article class=comment><h4>x</h4><p>{}</p></article>", "<p>{}</p>")).format(" ".join(_sentence(r, r.randint(2, 15)) for _ in range(r.randint(1, 3)))) for _ in range(r.randint(1, 5)))
            after.append(f'<{(t := r.choice(("section", "div", "ol")))} {r.choice(("class", "id"))}="{r.choice(NAMES["comment"].split())}"><h3>{_words(r, 1, 2)}</h3>{said}</{t}>')
        if r.random() < 0.25:
            after.append(f"<form{' class=newsletter' if r.random() < 0.5 else ''}><label>{_words(r, 1, 4)}</label><input name=q><button>{_words(r, 1, 1)}</button></form>")
        if r.random() < 0.2:
            after.append(box("div", "social", _list(r, 3)))
        if bare:
            before, after = before[:1] if r.random() < 0.3 else [], after[:1]
        r.shuffle(after)
        if r.random() < 0.3 and after:  # comments and others inside the article's frame
            content = content[: content.rindex("</")] + f'<div data-main="0">{after.pop()}</div>' + content[content.rindex("</") :]
        foot = box("footer", "foot", r.choice(("&copy; {} &middot; {}", "<p>{}</p><p>{}</p>", "{} | {}")).format(_words(r, 1, 2), _sentence(r, r.randint(2, 12)))) if r.random() < 0.85 else ""
        pages.append(f"<!DOCTYPE html><html><head><title>{_words(r, 2, 5)}</title></head><body>{''.join(before)}{content}{''.join(after)}{foot}</body></html>")
    return pages


@cache
def default_field() -> Field:
    return fit(labelled_pages())


def extract(pages: DataFrame, field: Field | None = None, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with text and n_chars of every whole page; no shuffle."""
    keep = ["page_id", "url"] if keep is None else keep
    own = field or default_field()
    plain = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, float] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = []
                for html in part.column(len(keep)).to_pylist():
                    found = blocks(html or "")
                    labels = own.decode([b.mask for b in found], memo)
                    texts.append("\n".join(b.text for b, main in zip(found, labels, strict=True) if main))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return plain.mapInArrow(scratch.lean(run), f"{kept}text string, n_chars bigint")
