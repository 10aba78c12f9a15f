"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A lenient parser makes a tree of block elements from the whole page. Each block gets features (tag,
attribute tokens, depth, sibling statistics, subtree text and link density, what its ancestors are) and boosted trees
score it as part of the article or not. Decoding gives each block one of three states: around the
article, in it, or removed from it. A removed block has removed descendants only, and nothing in
the article leads back out of it, so no choice contradicts an ancestor's; the likeliest states come from one
pass up and one down the tree.

The trees are fitted on pages made by ``training_pages``: seeded layouts of many kinds with known articles.
"""

from __future__ import annotations

import html as H
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements within a line of text; all others are blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th noscript object math".split())
#: Elements of formulas.
INLINE |= frozenset("maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
#: Elements whose content isn't text of the page.
RAW = frozenset("script style template textarea title svg iframe select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes open elements of these kinds.
CLOSES = {"li": {"li", "p"}, "tr": {"tr"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody"}}
#: Blocks past which an opening or closing tag closes nothing.
WALLS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "section", "article", "aside", "nav", "footer", "header", "main", "li", "td", "blockquote", "form", "body", "figure"}}

TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "button", "table", "tr", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "body", "fieldset", "details")
#: Attribute tokens by what they tell.
HINTS = {
    "content": "article content post entry story main body text page maincontent postbody prose",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs links skip",
    "side": "sidebar side aside related recommended widget promo rail trending popular more teaser secondary",
    "comment": "comment comments reply replies discussion respond disqus thread responses",
    "advert": "ad ads advert advertisement adverts sponsor sponsored banner promoted adsense dfp",
    "foot": "footer foot copyright legal colophon bottom disclaimer",
    "head": "header masthead top logo brand topbar sitename",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup gdpr banner toast paywall",
    "share": "share social sharing follow like tweet author meta byline tags",
    "form": "form login search searchbox input contact signin",
}
_HINT_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        _HINT_OF.setdefault(_w, []).append(_i)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_N_HINTS = len(HINTS)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,600}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
#: A tag of more than some 300 quoted values ends at its first ``>``, so that stray quotes are not read to the end of the page again and again.
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Tree:
    """The blocks of one or more pages, as columns in page order; ``up`` is -1 at each page's root."""

    def __init__(self):
        self.tag: list[int] = []
        self.up: list[int] = []
        self.depth: list[int] = []
        self.own: list[int] = []
        self.links: list[int] = []
        self.stops: list[int] = []
        self.at: list[int] = []
        self.label: list[int] = []
        self.hints: list[tuple[int, tuple[int, ...]]] = []

    def add(self, tag: int, up: int, label: int, at: int, depth: int) -> int:
        for column, v in ((self.tag, tag), (self.up, up), (self.label, label), (self.at, at), (self.depth, depth), (self.own, 0), (self.links, 0), (self.stops, 0)):
            column.append(v)
        return len(self.up) - 1


@lru_cache(maxsize=20_000)
def _hints(attributes: str) -> tuple[int, ...]:
    found: set[int] = set()
    for m in _ATTR.finditer(attributes):
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            found.update(_HINT_OF.get(w.lower(), ()))
    return tuple(sorted(found))


def parse(page: str, tree: Tree) -> list[tuple[int, str]]:
    """Adds the page's blocks to ``tree``; returns its runs of text as (block, text). A run ends at each block boundary."""
    root = tree.add(_TAG_AT["body"], -1, 0, 0, 0)
    names = {root: "body"}
    up, depth, own, links, stops = tree.up, tree.depth, tree.own, tree.links, tree.stops
    runs: list[tuple[int, str]] = []
    here, pos, chars, link = root, 0, 0, 0
    text: list[str] = []
    endless: set[str] = set()
    search = _TOKEN.search
    # the open blocks, and of each name how deep they stand; nothing after the last bracket is a tag
    stack, where, tags_end = [root], defaultdict(list), page.rfind(">") + 1

    def wall_of(walls) -> int:
        return max((where[w][-1] for w in walls if where[w]), default=0)

    def close_from(deep: int) -> int:
        while len(stack) > deep:
            where[names[stack.pop()]].pop()
        return stack[-1]

    def close_run() -> None:
        nonlocal chars
        s = " ".join("".join(text).split())
        text.clear()
        if s:
            runs.append((here, s))
            own[here] += len(s)
            stops[here] += sum(map(s.count, ".,;:!?"))
            chars += len(s)

    while True:
        m = search(page, pos, tags_end)
        if not m and (comment := page.find("<!--", pos)) >= 0:
            m = search(page, comment)
        piece = page[pos : m.start()] if m else page[pos:]
        if piece:
            plain = H.unescape(piece) if "&" in piece else piece
            text.append(plain)
            if link:
                links[here] += len(plain)
        if not m:
            break
        # a comment without an end takes the rest of the page
        pos = m.end() if m[0][:4] != "<!--" or m[0].endswith("-->") else len(page)
        slash, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not slash and tag not in endless and not (tag == "svg" and attributes.endswith("/")):
                end = _raw_end(tag).search(page, pos)
                if end:
                    pos = end.end()
                elif tag in ("script", "style"):
                    pos = len(page)
                else:  # the tag alone is left out, not the rest of the page
                    endless.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if slash else 1
            elif tag in ("br", "td", "th", "img"):
                text.append(" ")
            continue
        if text:
            close_run()
        if tag in ("html", "head", "body"):
            if tag == "body" and not slash and "=" in attributes and (found := _hints(attributes)):
                tree.hints.append((root, found))
            continue
        link = 0
        if slash:
            if where[tag] and (deep := where[tag][-1]) > wall_of(WALLS.get(tag, ())):
                here = close_from(deep)
            continue
        shut = [where[s] for s in CLOSES.get(tag) or _P if where[s]]
        if shut:
            wall = wall_of(WALLS.get(tag) or WALLS["p"])
            inside = [s[k] for s in shut if (k := bisect_right(s, wall)) < len(s)]
            if inside:
                here = close_from(min(inside))
        label = 1 if " y1" in attributes else 2 if " y0" in attributes else 0
        block = tree.add(_TAG_AT.get(tag, -1), here, label, chars, depth[here] + 1)
        names[block] = tag
        if "=" in attributes and (found := _hints(attributes)):
            tree.hints.append((block, found))
        if tag not in VOID and not attributes.endswith("/"):
            here = block
            where[tag].append(len(stack))
            stack.append(block)
    if text:
        close_run()
    return runs


_P = frozenset({"p"})


@lru_cache(maxsize=64)
def _raw_end(tag: str):
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


INSIDE = ("article", "main", "nav", "header", "footer", "aside", "form")
FEATURES = len(TAGS) + 2 * _N_HINTS + 14 + len(INSIDE)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Blocks by depth, the roots first."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def features(tree: Tree) -> np.ndarray:
    """One row per block of the tree's pages."""
    n = len(tree.up)
    up, depth, tag = np.array(tree.up), np.array(tree.depth), np.array(tree.tag)
    own, links, stops, at = (np.array(v, float) for v in (tree.own, tree.links, tree.stops, tree.at))
    levels = _levels(depth)
    sub, count = own.copy(), np.ones(n)
    for rows in levels[:0:-1]:
        for v in (sub, links, stops, count):
            np.add.at(v, up[rows], v[rows])
    roots = np.maximum.accumulate(np.where(up < 0, np.arange(n), 0))
    total = np.maximum(sub[roots], 1.0)
    x = np.zeros((n, FEATURES), np.float32)
    named = np.flatnonzero(tag >= 0)
    x[named, tag[named]] = 1
    base, far = len(TAGS), len(TAGS) + _N_HINTS
    for i, found in tree.hints:
        x[i, [base + h for h in found]] = 1
    inside = np.zeros((n, len(INSIDE)), np.float32)
    kinds = np.array([_TAG_AT[k] for k in INSIDE])
    for rows in levels[1:]:
        u = up[rows]
        x[rows, far : far + _N_HINTS] = np.maximum(x[u, far : far + _N_HINTS], x[u, base:far])
        inside[rows] = np.maximum(inside[u], x[u][:, kinds])
    order = np.argsort(up, kind="stable")
    kin = up[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], kin[1:] != kin[:-1])), np.arange(n), 0))
    place, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    place[order] = np.arange(n) - first
    twins = np.flatnonzero((kin[1:] == kin[:-1]) & (kin[1:] >= 0))
    before[order[twins + 1]], after[order[twins]] = sub[order[twins]], sub[order[twins + 1]]
    place[up < 0] = 0
    _, at_key, times = np.unique((up + 1) * (len(TAGS) + 1) + tag + 1, return_inverse=True, return_counts=True)
    same = np.where(up < 0, 1, times[at_key])
    kids = np.bincount(up[up >= 0], minlength=n)
    parent = np.where(up >= 0, up, np.arange(n))
    columns = [
        depth, np.log1p(own), np.log1p(sub), sub / total, np.minimum(links / np.maximum(sub, 1), 1), stops / np.maximum(sub, 1) * 100,
        np.log1p(sub / count), at / total, np.log1p(kids), np.log1p(place), np.log1p(before), np.log1p(after), np.log1p(same), sub / np.maximum(sub[parent], 1),
    ]
    x[:, far + _N_HINTS : far + _N_HINTS + 14] = np.stack(columns, 1)
    x[:, -len(INSIDE) :] = inside
    return x


class Boosted:
    """Boosted trees of fixed depth, as arrays: features and thresholds by level order, values by leaf."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.start)
        usable = [j for j, e in enumerate(edges) if len(e)]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                best, pick = np.full(width, 1e-3), [(0, np.inf, self.bins)] * width
                for j in usable:
                    key = node * self.bins + binned[:, j]
                    gs = np.bincount(key, g, width * self.bins).reshape(width, self.bins).cumsum(1)
                    hs = np.bincount(key, h, width * self.bins).reshape(width, self.bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    m = len(edges[j])
                    at = gain[:, :m].argmax(1)
                    for w in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[w], pick[w] = gain[w, at[w]], (j, edges[j][at[w]], at[w])
                for w, (j, t, _) in enumerate(pick):
                    feature[width - 1 + w], threshold[width - 1 + w] = j, t
                js, bs = np.array([q[0] for q in pick]), np.array([q[2] for q in pick])
                node = node * 2 + (binned[np.arange(len(y)), js[node]] > bs[node])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            f += value[node]
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.value.append(value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                spot = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[spot]] > threshold[spot])
            out += value[node]
        return out


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """For each block whether it is in the article: the likeliest states that don't contradict each other."""
    up, levels = np.array(tree.up), _levels(np.array(tree.depth))
    weight = 1.0 + np.log1p(np.array(tree.own))
    odds = np.clip(odds, -12, 12)
    cost = np.stack([np.logaddexp(0, odds) * weight, np.logaddexp(0, -odds) * weight, np.logaddexp(0, odds) * weight])  # around, within, removed
    for rows in levels[:0:-1]:
        below = cost[:, rows]
        for state, least in enumerate((below.min(0), below[1:].min(0), below[2])):
            np.add.at(cost[state], up[rows], least)
    state = np.zeros(len(up), np.int8)
    state[levels[0]] = np.argmin(cost[:2, levels[0]], 0)
    for rows in levels[1:]:
        above, below = state[up[rows]], cost[:, rows]
        state[rows] = np.where(above == 2, 2, np.where(above == 1, 1 + np.argmin(below[1:], 0), np.argmin(below, 0)))
    return state == 1


def extract_many(pages: list[str], model: Boosted) -> list[str]:
    tree = Tree()
    runs = [parse(p, tree) for p in pages]
    if not runs:
        return []
    keep = decode(tree, model.log_odds(features(tree)))
    return ["\n".join(s for b, s in page if keep[b]) for page in runs]


_SYLLABLES = "an be ti on re sha mi lo er in the que la des ung ver ción ment al ta".split()


def training_pages(n: int, seed: int = 11) -> list[str]:
    """Pages in many layouts; in their tags ``y1`` marks the article and ``y0`` what is within or beside it but not of it."""
    r = np.random.default_rng(seed)
    pick = lambda *a: a[r.integers(len(a))]
    chance = lambda p: r.random() < p
    word = lambda: "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), r.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.integers(a, b)))

    def prose(a: int, b: int) -> str:
        out = [words(3, 18).capitalize() + pick(".", ".", "!", "?", "") for _ in range(r.integers(a, b))]
        s = " ".join(out)
        if chance(0.15):
            s += f' <a href="/{word()}">{words(1, 4)}</a> {words(2, 8)}.'
        return pick(s, s, s, s.upper(), " | ".join(s.split()), "*** ".join(s.split())) if chance(0.25) else s

    def hint(*kinds: str) -> str:
        if chance(0.2):
            return ""
        names = HINTS[pick(*kinds)].split()
        name = pick(*names)
        name = pick(name, f"{name}-{word()}", f"{pick('site', 'page', 'block', 'l')}-{name}", f"{name} {word()}")
        return f' {pick("class", "class", "id")}="{name}"'

    def links(k: int) -> str:
        items = "".join(pick(f'<li><a href="/{word()}">{words(1, 3)}</a></li>', f'<li><a href="/{word()}">{words(1, 9)}</a>') for _ in range(k))
        return pick(f"<ul>{items}</ul>", f"<ul>{items}</ul>", "".join(f'<a href="/{word()}">{words(1, 3)}</a> ' for _ in range(k)), f"<div>{items}</div>")

    def other() -> str:
        kind = r.integers(9)
        if kind == 0:
            return pick(f"<nav y0{hint('menu')}>{links(r.integers(2, 12))}</nav>", f"<div y0 class=\"{pick(*HINTS['menu'].split())}\">{links(r.integers(2, 12))}</div>")
        if kind == 1:
            return f"<{(t := pick('header', 'div'))} y0 class=\"{pick(*HINTS['head'].split())}\">{pick(words(1, 4), f'<h2>{words(1, 5)}</h2>', '')}{links(r.integers(1, 6))}</{t}>"
        if kind == 2:
            return f"<{(t := pick('footer', 'footer', 'div'))} y0{hint('foot') if t == 'footer' else ' class=footer'}>{pick('&copy; ', '')}{words(2, 12)} {pick(prose(1, 3), '', links(3))}</{t}>"
        if kind == 3:
            body = "".join(f"<{(t := pick('h3', 'p', 'div', 'li'))}>{pick(prose(1, 3), words(2, 8))}</{t}>" for _ in range(r.integers(1, 5)))
            return pick(f"<aside y0{hint('side')}>{body}{links(3)}</aside>", f"<div y0 class=\"{pick(*HINTS['side'].split())}\">{body}</div>")
        if kind == 4:
            tag = pick("div", "div", "section", "p", "aside")
            return f"<{tag} y0 class=\"{pick(*HINTS['advert'].split())}\">{pick(prose(1, 4), words(2, 9), f'<p>{prose(1, 2)}</p>')}</{tag}>"
        if kind == 5:
            body = "".join(pick(f"<div class=\"{pick('comment', 'reply', 'c')}\"><b>{word()}</b><p>{prose(1, 5)}</p></div>", f"<li><p>{prose(1, 4)}</p></li>") for _ in range(r.integers(1, 7)))
            return f"<{(t := pick('section', 'div', 'ol'))} y0 {pick('class', 'id')}=\"{pick(*HINTS['comment'].split())}\">{pick('', f'<h3>{words(1, 3)}</h3>')}{body}</{t}>"
        if kind == 6:
            return f"<{(t := pick('div', 'div', 'section'))} y0 class=\"{pick(*HINTS['notice'].split())}\">{pick(f'<p>{prose(1, 3)}</p>', prose(1, 3))}{pick('<button>' + word() + '</button>', '')}</{t}>"
        if kind == 7:
            return f"<form y0{hint('form')}>{pick('<label>' + words(1, 3) + '</label>', f'<p>{words(2, 9)}</p>')}<input name=q><button>{word()}</button></form>"
        return f"<div y0 class=\"{pick(*HINTS['share'].split())}\">{words(1, 6)} {links(r.integers(1, 5))}</div>"

    def part() -> str:
        kind = r.integers(12)
        if kind < 7:
            return pick(f"<p>{prose(1, 7)}</p>", f"<p>{prose(1, 7)}", f"<p><b>{prose(1, 4)}<br>", f"<p>{words(1, 3)}.</p>")
        if kind == 7:
            return f"<{(t := pick('h2', 'h3'))}>{words(1, 9)}</{t}>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{pick(words(1, 9), prose(1, 2))}</li>" for _ in range(r.integers(1, 7))) + "</ul>"
        if kind == 9:
            return f"<blockquote>{pick(prose(1, 3), f'<p>{prose(1, 2)}</p>')}</blockquote>"
        if kind == 10:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.integers(1, 6))) + "</table>"
        return pick(f"<figure><img src=x><figcaption>{words(2, 10)}</figcaption></figure>", f"<div>{prose(1, 5)}</div>", f"<pre>{words(3, 20)}</pre>")

    pages = []
    for _ in range(n):
        title = f"<h1 y1>{words(1, 10)}</h1>"
        body = [part() for _ in range(r.integers(1, pick(3, 8, 25)))]
        for _ in range(r.integers(0, 3)):
            if chance(0.4):
                body.insert(r.integers(0, len(body) + 1), other())
        inner = pick(title, title, "") + "".join(body)
        if chance(0.3):
            inner = f"<div{hint('content')}>{inner}</div>"
        tag = pick("article", "article", "div", "main", "section")
        article = f"<{tag} y1{hint('content') if tag in ('article', 'main') else ' class=' + pick(*HINTS['content'].split())}>{inner}</{tag}>"
        if chance(0.3):
            article = f"<{(t := pick('div', 'main', 'section'))}{hint('content')}>{pick('', other())}{article}{pick('', other())}</{t}>"
        if chance(0.2):
            article = f"<div id={pick('wrap', 'container', 'root')}>{article}</div>"
        top = "".join(other() for _ in range(r.integers(0, 4)))
        bottom = "".join(other() for _ in range(r.integers(0, 4)))
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{top}{article}{bottom}</body></html>")
    return pages


def labelled(tree: Tree) -> np.ndarray:
    """1 for blocks of the article, by the nearest mark above them."""
    state: list[int] = []
    for label, u in zip(tree.label, tree.up):
        state.append(label or (state[u] if u >= 0 else 2))
    return np.array(state) == 1


#: Made pages to fit on.
TRAINING_PAGES = 300


@lru_cache(maxsize=2)
def fitted(pages: int = TRAINING_PAGES, seed: int = 11) -> Boosted:
    tree = Tree()
    for page in training_pages(pages, seed):
        parse(page, tree)
    return Boosted().fit(features(tree), labelled(tree).astype(float))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``; null and empty pages, and pages without an article, have an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def run(batches):
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract_many([h or "" for h in part.column(2).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
