"""HTML main-text extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is read by a tolerant parser (implied end tags, unclosed and stray tags, raw-text elements). Every block element
gets features: its kind, depth, place among siblings, length, link share, punctuation and tag density of its subtree,
the parts of the page that it lies in, and tokens of class, id and role of itself and its ancestors. Boosted trees give
each the probability of being main text. Decoding chooses for each element one of three states (page, article, left out)
so that the sum of log-probabilities is largest and no choice contradicts another: below what is left out nothing is
kept, and below the article elements are article or left out.

No labelled pages exist, so the trees are trained on pages that `sample_page` draws (a fixed, documented number), whose
markup, class names, order and nesting vary; real pages are never used for it.

A block is the text of a block element between its block children: character references decoded, runs of white space
turned into one space, trimmed; blocks are joined by two line feeds in page order. Cases: null and empty html, and pages
without main text, give an empty text; html without tags is one block, and kept; very long pages are read whole, in time
that grows with their length; text of formulas, drawings and embedded objects is text of their block; of an unclosed tag,
comment or script the rest of the page is part, as in browsers; repeated rows (ties of ids) are rows of their own; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.kernels import slices, texts
from tabulon.session import small_batches

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
INLINE = frozenset("a abbr acronym annotation audio b bdi bdo big br canvas cite code data del desc dfn em font g i img ins kbd label mark math mfenced mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover nobr object picture q rp rt ruby s samp semantics small span strike strong sub sup svg text time tspan tt u use var video wbr".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = frozenset("ul ol dl table div section article main aside nav header footer form body html".split())
KINDS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "quote", "figure")
KIND_OF = {**{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "button": "form", "menu": "nav", "legend": "form"} | {k: k for k in ("p", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "figure")}
GOOD = frozenset("article content post entry story main body text page blog news prose markdown artikel inhalt contenu contenido articulo".split())
BAD = frozenset("ad ads adv advert advertisement advertising anzeige publicidad publicite banner sponsor sponsored promo promoted promotion nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar side rail widget footer foot bottom header head masthead top topbar cookie cookies consent gdpr notice alert message popup modal overlay banner comment comments reply replies discussion respond disqus share sharing social related recommended recommendations more subscribe newsletter signup login form search pagination pager tags tag legal copyright credits toolbar kommentare commentaires comentarios".split())

# A tag's attributes are read as a browser does: a quote opens a value only after an equals sign, and one that nothing closes is a plain character.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "texts", "chars", "links", "marks", "words", "tags", "index", "first")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.texts: list[int] = []  # numbers of blocks of its own
        self.chars = self.links = self.marks = self.words = 0
        self.tags, self.index, self.first = 1, 0, 0


def tokens_of(attributes: str) -> frozenset:
    return frozenset(t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall(m[2] or m[3] or m[4] or "")) if attributes else frozenset()


def parse(page: str) -> tuple[list[Node], list[str]]:
    """Block elements in page order (the first stands for the page), and the text of each block."""
    root = Node("html", None)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements; inline ones share their block's node
    held: list[str] = []
    at, depth_a = 0, 0
    opened: dict[str, int] = {"html": 1}  # open elements by tag
    endless: set[str] = set()  # raw elements whose end doesn't come any more

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", references.unescape("".join(held))).strip()
            held.clear()
            if text:
                stack[-1][1].texts.append(len(blocks))
                blocks.append(text)

    def close(k: int) -> None:
        nonlocal depth_a
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            opened[t] -= 1
        depth_a = opened.get("a", 0)
        del stack[k:]

    def add(text: str) -> None:
        if text:
            held.append(text)
            n = stack[-1][1]
            size = len(text.strip())
            n.chars += size
            n.links += size if depth_a else 0
            n.words += text.count(" ") + 1 if size else 0
            n.marks += text.count(".") + text.count(",") + text.count(";") + text.count("!") + text.count("?")

    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1] and not opened.get(tag):
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("td", "th", "table") and tag in INLINE:
                    break
            continue
        if tag in RAW:
            end = None if tag in endless else _END[tag].search(page, at)
            if end is None:
                endless.add(tag)
            if not m[0].endswith("/>"):
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                held.append("\n" if tag != "wbr" else "")
                if tag == "hr":
                    flush()
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack) and tag == "html":
            root.tokens |= tokens_of(m[3])
            continue
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSED_BY_BLOCK:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
            peers = PEERS.get(tag)
            if peers:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in peers:
                        close(k)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                    elif stack[k][0] in LISTS:
                        break
            flush()
            parent = stack[-1][1]
            n = Node(tag, parent, tokens_of(m[3]))
            parent.children.append(n)
            n.first = len(blocks)
            nodes.append(n)
        else:
            n = stack[-1][1]
            n.tags += 1
        if not m[0].endswith("/>") or tag in INLINE and tag not in ("g", "mspace", "text", "tspan", "use"):
            stack.append((tag, n))
            opened[tag] = opened.get(tag, 0) + 1
            depth_a = opened.get("a", 0)
    flush()
    return nodes, blocks


N_FEATURES = 2 * len(KINDS) + 22


def features(nodes: list[Node], blocks: list[str]) -> np.ndarray:
    """A row of features for each element."""
    for i, n in enumerate(nodes):
        n.index = i
    sums = [[n.chars, n.links, n.words, n.marks, n.tags, 0, 0] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], sums[nodes[i].parent.index]
        for k in range(7):
            p[k] += sums[i][k]
        p[5] += n.tag == "p"
        p[6] += n.tag == "li"
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    whole = max(1, sums[0][0])
    k0 = len(KINDS)
    good_above, bad_above, depth = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    place, alike = [0] * len(nodes), [1] * len(nodes)  # among its siblings, and siblings of its tag
    for n in nodes:
        tags = Counter(c.tag for c in n.children)
        for at, c in enumerate(n.children):
            place[c.index], alike[c.index] = at, tags[c.tag]
    for i, n in enumerate(nodes):
        r = out[i]
        kind = KIND_OF.get(n.tag)
        k = KINDS.index(kind) if kind else -1
        if k >= 0:
            r[k] = 1
        good, bad = len(n.tokens & GOOD), len(n.tokens & BAD)
        if n.parent is not None:
            j = n.parent.index
            r[k0 : 2 * k0] = np.maximum(out[j, k0 : 2 * k0], out[j, :k0])
            good_above[i], bad_above[i], depth[i] = good_above[j] + good, bad_above[j] + bad, depth[j] + 1
            siblings = (len(n.parent.children), alike[i], place[i])
            near = sums[j]
        else:
            good_above[i], bad_above[i], siblings, near = good, bad, (1, 1, 0), sums[0]
        c, a, w, marks, tags, ps, lis = sums[i]
        r[2 * k0 :] = (good, bad, good_above[i] - good, bad_above[i] - bad, depth[i], *siblings, np.log1p(c), a / max(1, c), np.log1p(w), marks / max(1, w), np.log1p(tags), c / tags, ps, lis, np.log1p(n.chars), c / whole, c / max(1, near[0]), n.first / max(1, len(blocks)), near[5], near[1] / max(1, near[0]))
    return out


class Trees:
    """Gradient-boosted regression trees with logistic loss over histograms of binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        n, m = binned.shape
        flat = binned + np.arange(m) * self.bins
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.bias)
        self.feature = np.zeros((self.rounds, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.rounds, 2**self.depth - 1), np.inf, np.float32)
        self.leaf = np.zeros((self.rounds, 2**self.depth), np.float32)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-9
            at = np.zeros(n, np.int64)
            for d in range(self.depth):
                slot = (at[:, None] * (m * self.bins) + flat).ravel()
                size = 2**d * m * self.bins
                gs, hs = (np.bincount(slot, np.repeat(v, m), size).reshape(2**d, m, self.bins).cumsum(axis=2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = 0
                best = gain.reshape(2**d, -1).argmax(axis=1)
                k, b = best // self.bins, best % self.bins
                good = (gain.reshape(2**d, -1)[np.arange(2**d), best] > 1e-6) & np.array([c < len(self.edges[j]) for j, c in zip(k, b, strict=True)])
                base = 2**d - 1
                self.feature[t, base : base + 2**d] = k
                self.cut[t, base : base + 2**d] = [self.edges[j][c] if ok else np.inf for j, c, ok in zip(k, b, good, strict=True)]
                at = 2 * at + (x[np.arange(n), k[at]] > self.cut[t, base + at])
            gl, hl = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
            self.leaf[t] = self.rate * gl / (hl + 1)
            f += self.leaf[t][at]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(self.rounds):
            at = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = 2**d - 1 + at
                at = 2 * at + (x[rows, self.feature[t, node]] > self.cut[t, node])
            f += self.leaf[t][at]
        return f


def decode(nodes: list[Node], logit: np.ndarray) -> set[int]:
    """The elements in the state `article` of the best choice of states."""
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    page, article, out = ([0.0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        weight = 1.0 + (1.0 if n.texts else 0.0)
        p, a, o = (weight * no[i] if n.texts else 0.0), weight * yes[i], weight * no[i]
        for c in n.children:
            j = c.index
            p += max(page[j], article[j], out[j])
            a += max(article[j], out[j])
            o += out[j]
        page[i], article[i], out[i] = p, a, o
    kept: set[int] = set()
    todo = [(0, "page")]
    while todo:
        i, above = todo.pop()
        if above == "page":
            state = max((("article", article[i]), ("page", page[i]), ("out", out[i])), key=lambda s: s[1])[0]
        else:
            state = "article" if article[i] >= out[i] else "out"
        if state == "out":
            continue
        if state == "article":
            kept.add(i)
        todo += [(c.index, state) for c in nodes[i].children]
    return kept


def extract_many(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    logit = trees.logits(np.concatenate([features(n, b) for n, b in parsed]))
    out, at = [], 0
    for nodes, blocks in parsed:
        if len(nodes) == 1:
            out.append("\n\n".join(blocks))
        else:
            kept = decode(nodes, logit[at : at + len(nodes)])
            own = sorted(b for i in kept for b in nodes[i].texts)
            out.append("\n\n".join(blocks[b] for b in own))
        at += len(nodes)
    return out


def sample_page(rng: Random) -> tuple[str, list[str]]:
    """A drawn page and the blocks of its main text. Marked-up parts have telling names or none, and stand in varying order."""
    syllables = "an ber con der en fi ge ho in jo ka lo mi na or pe qui ra sten tu ver wa xi yo zu ä é ñ".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        w = [word() for _ in range(rng.randint(lo, hi))]
        if len(w) > 6 and rng.random() < 0.6:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def prose(lo: int = 1, hi: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def label(lo: int = 1, hi: int = 3) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()

    def link(text: str | None = None) -> str:
        return f'<a href="/{word()}">{text or label()}</a>'

    def name(choices: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        c = rng.choice(choices.split())
        return f' {rng.choice(["class", "class", "id"])}="{c}{rng.choice(["", "", f" {word()}", "-box", "-" + word()])}"'

    def links(n: int) -> str:
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{link()}" + rng.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"
        return rng.choice([" | ", " ", ""]).join(link() for _ in range(n)) if style < 0.8 else "".join(f"<div>{link()}</div>" for _ in range(n))

    def menu() -> str:
        return rng.choice([f"<nav{name('nav menu navbar', 0.4)}>{links(rng.randint(3, 9))}</nav>", f"<div{name('nav menu navigation navbar breadcrumb', 0.95)}>{links(rng.randint(2, 9))}</div>"])

    def header() -> str:
        inner = f"<{(h := rng.choice(['h1', 'h2', 'div', 'p']))}>{label()}</{h}>" + (f"<p>{sentence()}</p>" if rng.random() < 0.4 else "") + (menu() if rng.random() < 0.5 else "")
        return rng.choice([f"<header{name('header masthead top', 0.4)}>{inner}</header>", f"<div{name('header masthead topbar site-header', 1)}>{inner}</div>"])

    def footer() -> str:
        inner = rng.choice([f"&copy; {word()} {sentence()}", f"<p>&copy; {label()}. {prose(1, 2)}</p>", f"<p>{prose(1, 2)}</p>" + links(rng.randint(2, 6))])
        return rng.choice([f"<footer{name('footer', 0.3)}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{name('footer copyright legal bottom', 1)}>{inner}</div>"])

    def sidebar() -> str:
        inner = "".join(rng.choice([f"<h3>{label()}</h3>{links(rng.randint(2, 6))}", f"<div{name('widget related promo', 0.6)}><h4>{label()}</h4><p>{prose(1, 3)}</p></div>", f"<p>{prose(1, 3)}</p>"]) for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside{name('sidebar', 0.4)}>{inner}</aside>", f"<div{name('sidebar side rail related widget', 1)}>{inner}</div>"])

    def advert() -> str:
        inner = rng.choice([prose(1, 2), f"<p>{prose(1, 2)}</p>", f"{link()} {sentence()}"])
        return f"<{(t := rng.choice(['div', 'div', 'section', 'aside', 'div' if '<p>' in inner else 'p']))}{name('ad ads advert banner sponsored promo sponsor advertisement', 1)}>{inner}</{t}>"

    def notice() -> str:
        return f"<div{name('cookie notice consent alert popup gdpr message', 1)}>" + rng.choice([f"<p>{prose(1, 3)}</p>", prose(1, 3)]) + rng.choice(["", f"<button>{label()}</button>", link()]) + "</div>"

    def form() -> str:
        return f"<form{name('search login newsletter subscribe signup', 0.6)}>" + rng.choice(["", f"<p>{sentence()}</p>", f"<h3>{label()}</h3>"]) + f'<label>{label()}</label><input name="q"><button>{label()}</button></form>'

    def comments() -> str:
        each = "".join(rng.choice([f"<div{name('comment reply', 0.8)}><b>{label()}</b><p>{prose(1, 4)}</p></div>", f"<li><p>{prose(1, 4)}</p></li>", f"<p>{prose(1, 4)}</p>"]) for _ in range(rng.randint(1, 5)))
        return f"<{(t := rng.choice(['section', 'div', 'div', 'ul', 'ol']))}{name('comments comment discussion replies', 1)}>{rng.choice(['', f'<h3>{label()}</h3>'])}{each}</{t}>"

    body: list[str] = []

    def block(text: str, markup: str) -> str:
        body.append(text)
        return markup

    def item() -> str:
        r = rng.random()
        if r < 0.68:
            t = prose(1, 7)
            cut = t.find(" ")
            inner = rng.choice([t, t, t, f"<b>{t[:cut]}</b>{t[cut:]}" if cut > 0 else t, t[:cut] + f' <a href="/x">{t[cut + 1 :]}</a>' if cut > 0 and len(t) < 90 else t])
            return block(t, rng.choice([f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<div>{inner}</div>" if rng.random() < 0.3 else f"<p>{inner}</p>"]))
        if r < 0.78:
            t = label(2, 6)
            return block(t, f"<{(h := rng.choice(['h2', 'h3']))}>{t}</{h}>")
        if r < 0.88:
            return "<ul>" + "".join(block(t := sentence(3, 14), f"<li>{t}</li>") for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.94:
            return block(t := prose(1, 3), f"<blockquote>{t}</blockquote>")
        return "<table><tr>" + "".join(block(t := label(1, 3), f"<td>{t}</td>") for _ in range(rng.randint(2, 4))) + "</tr></table>"

    title = label(3, 9)
    inner = block(title, f"<h1>{title}</h1>") if rng.random() < 0.85 else ""
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
        inner += item()
        if rng.random() < 0.12:
            inner += rng.choice([advert, advert, form, sidebar])()
    if rng.random() < 0.15:
        inner += rng.choice([comments, f"<div{name('share social tags', 1)}>{links(3)}</div>".__str__])()
    shape = rng.random()
    if shape < 0.45:
        inner = f"<article{name('article post entry', 0.4)}>{inner}</article>"
    elif shape < 0.65:
        inner = f"<main{name('main content', 0.4)}>{inner}</main>"
    elif shape < 0.95:
        inner = f"<{(t := rng.choice(['div', 'div', 'section']))}{name('content article post entry-content story main text', 0.85)}>{inner}</{t}>"
    before = [p() for p in rng.sample([header, menu, notice, advert, form, sidebar], rng.randint(0, 4))]
    after = [p() for p in rng.sample([footer, sidebar, comments, advert, notice, form, menu], rng.randint(0, 4))]
    if rng.random() < 0.7:
        after.append(footer())
    whole = "".join(before) + inner + "".join(after)
    for _ in range(rng.choice([0, 0, 1, 2])):
        whole = f"<div{name('page wrapper container site', 0.7)}>{whole}</div>"
    head = f"<head><title>{title}</title><style>p{{}}</style><script>var a = 1 < 2;</script></head>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html>{head}<body>{whole}" + rng.choice(["</body></html>", "</body></html>", ""]), body


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 11) -> Trees:
    """Trees trained on drawn pages; an element is main text if all its own blocks are, or, without any, all blocks below it that aren't in a marked part."""
    rng = Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        page, body = sample_page(rng)
        nodes, blocks = parse(page)
        left: dict[str, int] = {}
        for b in body:
            left[_SPACE.sub(" ", b).strip()] = left.get(_SPACE.sub(" ", b).strip(), 0) + 1
        main = [left.get(b, 0) > 0 for b in blocks]
        x = features(nodes, blocks)
        count = [[sum(main[t] for t in n.texts), len(n.texts)] for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            j = nodes[i].parent.index
            count[j][0] += count[i][0]
            count[j][1] += count[i][1]
        whole = count[0][0]
        for i, n in enumerate(nodes):
            own = [main[t] for t in n.texts]
            # an element without text of its own is article if it holds no foreign majority and isn't a wrapper of the whole page
            good = all(own) if own else count[i][1] > 0 and count[i][0] >= 0.6 * count[i][1] and (count[i][0] < whole or i > 0 and n.tag not in ("body", "html") and count[i][0] >= 0.8 * count[i][1])
            rows.append(x[i])
            labels.append(float(good))
    return Trees().fit(np.array(rows), np.array(labels))


def _extract(batches: Iterator[pa.RecordBatch], trees) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 1 << 20):
        out = extract_many(texts(b.column(2)).to_pylist(), trees.value)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    trees = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(partial(_extract, trees=trees), "page_id long, url string, text string, n_chars long")
