"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into its leaf blocks: the runs of text between block-level tags, with the elements around them. Each block
is content or not; a block's score sums weights of its ancestors' tags, classes, ids and roles, of its own text (length,
share of link text, punctuation, words of short blocks) and its neighbours', and of where it stands to the container with
the most running text on the page; weights on pairs of neighbouring labels let a block lean on the one before. Weights
maximise the likelihood of labelled pages (forward-backward, regularised); Viterbi finds the best labelling of a page.

An ancestor's feature counts once however often it occurs, neutral tags (div, td and the like) and the names on html and
body say nothing, and names on elements that hold most of the page's text are features of their own, so that wrappers, of
any number and name, don't speak for what they wrap. Time and memory are in proportion to the page at any depth.

What script, style, template, iframe, noembed, noframes and svg hold is not text, up to their end tag or else the end of
the page; nor is what an inline element with `hidden` or `display:none` holds (on block elements those are features). The
labelled pages come from `training_pages`, which lays out articles of invented words with the furniture of many kinds of
sites; `fit` takes any other labelled pages as well.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import slices

# an attribute's value ends at its closing quote; a quote without one, or inside a bare value, is a character of it
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+")
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE}))?+)*+)>?|<[!?/][^>]*+>?", re.S)
CLASS_NAME = re.compile(r"[^\s]+")
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
# Fixed values of HTML: elements without content, with raw text, with text but no elements, and those laid out as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes svg".split())
TEXT_ONLY = frozenset("title textarea xmp".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul xmp".split())
CLOSES_P = BLOCK - frozenset("body button head html label option optgroup select textarea title".split())
#: An element that begins ends an open one of these, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
SPACE = {"br", "wbr", "img", "input", "hr"}
#: Elements whose tag says nothing of what they hold, and those that hold a part of the page rather than a part of a text.
NEUTRAL = frozenset("body center div html section table tbody td tfoot th thead tr".split())
HOLDERS = frozenset("article aside body center details dialog div fieldset footer form header html main menu nav search section".split())
BESIDE = frozenset("aside footer form head nav".split())
TELLING = BESIDE | {"article", "header", "main"}
#: Names that begin so tell of something elsewhere on the page.
ELSEWHERE = ("has-", "has_", "with-", "with_", "no-", "no_", "js-", "is-")
WIDE = 0.7


@dataclass
class Block:
    """Text with references decoded and white space single, the element that holds it, and the features of the text."""

    text: str
    node: int
    linked: int
    own: tuple[str, ...] = field(default=())


@dataclass
class Page:
    """Blocks in page order; parent and added features of each element, in the order of their start tags (0: the page)."""

    blocks: list[Block]
    parent: list[int]
    added: list[tuple[str, ...]]

    def path(self, block: Block) -> list[str]:
        """Features of the elements around a block, each once."""
        out, node = [], block.node
        while node >= 0:
            out += self.added[node]
            node = self.parent[node]
        return out


def element_features(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """The tag and the words in class, id, role and the like; and whether the element is not shown."""
    out = [] if tag in NEUTRAL else [f"t={tag}"]
    hidden = unshown = False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = (m[2] or "").strip("\"'")
            if name == "hidden" or name == "style" and UNSHOWN.search(value):
                hidden = unshown = True
            elif name == "aria-hidden":
                hidden = hidden or value.lower() == "true"
            elif name in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
                for part in CLASS_NAME.findall(value):
                    if not part.lower().startswith(ELSEWHERE):
                        for w in LETTERS.findall(part):
                            w = w.lower()
                            if len(w) > 1:
                                out.append(f"c={w}")
                                if len(w) > 4:
                                    out += (f"c^{w[:4]}", f"c${w[-4:]}")
    if hidden:
        out.append("hidden")
    return tuple(dict.fromkeys(out)), unshown


def size_of(n: int) -> int:
    return min(8, int(math.log2(n + 1)))


def share_of(part: float, whole: float) -> int:
    """A share in six steps, from nothing to all but all."""
    x = part / whole if whole else 0.0
    return 0 if x <= 0 else 1 if x < 0.1 else 2 if x < 0.34 else 3 if x < 0.6 else 4 if x < 0.9 else 5


def text_features(text: str, linked: int, tag: str) -> list[str]:
    """What the block's own text says."""
    n = len(text)
    out = [f"b={tag}", f"n={size_of(n)}", f"a={share_of(linked, n)}"]
    if text[-1] in ".!?:;…。":
        out.append("end")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if n <= 80:
        out += [f"w={w}" for w in dict.fromkeys(WORD.findall(text.lower()))]
    return out


def after(page: str, at: int, tag: str) -> int:
    """Where an element with raw text ends; svg and template may hold their like."""
    nests, depth = tag in ("svg", "template"), 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)[^>]*+>?", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif nests and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def parsed(page: str | None) -> tuple[list[Block], list[int], list[str], list[tuple[str, ...]]]:
    """The leaf blocks in page order, and the parent, tag and features of each element that can hold some."""
    blocks: list[Block] = []
    parent, tags, names = [-1], [""], [()]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element that holds, whether an inline element is unshown
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "unshown": 0, "where": 0}
    page = page or ""

    def text(raw: str) -> None:
        if state["unshown"]:
            return
        if not parts:
            state["where"] = stack[-1][1]
        parts.append(raw)
        if state["links"]:
            state["linked"] += len(raw)

    def flush() -> None:
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(Block(joined, state["where"], min(state["linked"], len(joined))))
            parts.clear()
            state["linked"] = 0

    def close(index: int) -> None:
        for tag, _, unshown in stack[index:]:
            if tag in BLOCK:
                flush()
            if tag == "a":
                state["links"] -= 1
            state["unshown"] -= unshown
            places[tag].pop()
        del stack[index:]

    def innermost(*tags: str) -> int:
        """Where the innermost open one of these is; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        start = m.start() if m else end
        if start > at:
            raw = page[at:start]
            text(html.unescape(raw) if "&" in raw else raw)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if i := innermost(tag):
                close(i)
            elif tag in BLOCK:
                flush()
            elif tag == "br" and parts:
                parts.append(" ")
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in SPACE and parts:
                parts.append(" ")
            continue
        if tag in RAW:
            if tag != "svg" or not m[0].endswith("/>"):
                at = after(page, at, tag)
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES:
            which, bounds = CLOSES[tag]
            bound = innermost(*bounds)
            while (i := innermost(*which)) > bound:
                close(i)
                if tag != "tr":
                    break
        if tag in CLOSES_P:
            i = innermost("p")
            if i > innermost("table", "td", "th", "button", "caption"):
                close(i)
        own, unshown = element_features(tag, m[3])
        holds = tag in BLOCK or "-" in tag
        if holds:
            parent.append(stack[-1][1])
            tags.append(tag)
            names.append(own)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(parent) - 1 if holds else stack[-1][1], unshown and not holds))
        state["unshown"] += stack[-1][2]
        if tag == "a":
            state["links"] += 1
        if tag in TEXT_ONLY:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            upto = stop.start() if stop else end
            text(page[at:upto] if tag == "xmp" else html.unescape(page[at:upto]))
            at = upto
    flush()
    return blocks, parent, tags, names


def described(blocks: list[Block], parent: list[int], tags: list[str], names: list[tuple[str, ...]]) -> Page:
    """The page with the features of its elements and blocks."""
    n = len(parent)
    chars, linked, parted = [0] * n, [0] * n, [False] * n
    for b in blocks:
        chars[b.node] += len(b.text)
        linked[b.node] += b.linked
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        linked[parent[i]] += linked[i]
        if chars[i]:
            parted[parent[i]] = True
    # the holder of each element: the nearest element that is a part of the page (a table cell, if it has blocks inside)
    holder = [0] * n
    for i in range(1, n):
        holder[i] = i if tags[i] in HOLDERS or "-" in tags[i] or tags[i] == "td" and parted[i] else holder[parent[i]]
    beside = [False] * n  # inside an element that is no article by its tag
    kind = [""] * n  # the innermost element that tells by its tag what it is, and the next one around it
    for i in range(1, n):
        beside[i] = beside[parent[i]] or tags[i] in BESIDE
        kind[i] = f"{tags[i]} {kind[parent[i]].split(' ')[0]}" if tags[i] in TELLING else kind[parent[i]]
    prose, rank = [0.0] * n, [0.0] * n
    for b in blocks:
        plain = len(b.text) - b.linked
        if plain >= 25 and not beside[b.node]:
            prose[holder[b.node]] += plain
    for i in range(n):
        if prose[i]:
            rank[i] += prose[i]
            if i:
                rank[holder[parent[i]]] += prose[i] / 2
    best = max(range(n), key=rank.__getitem__)  # of equals the first
    within, around = [False] * n, [False] * n
    within[best] = True
    for i in range(best + 1, n):
        within[i] = within[parent[i]]
    i = best
    while i > 0:
        i = parent[i]
        around[i] = True
    inside = [i for i, b in enumerate(blocks) if within[holder[b.node]]]
    first, last = (inside[0], inside[-1]) if inside else (0, -1)
    all_prose = sum(prose)

    added: list[tuple[str, ...]] = [()] * n
    shown: dict[str, int] = {}  # how many of the elements around have a feature
    stack: list[tuple[int, tuple[str, ...]]] = []
    for i in range(1, n):
        while stack and stack[-1][0] != parent[i]:
            for f in stack.pop()[1]:
                shown[f] -= 1
        own = names[i]
        if chars[i] > WIDE * chars[0]:
            own = tuple([f if f == "hidden" else "W" + f for f in own])
        added[i] = tuple([f for f in own if not shown.get(f)])
        for f in own:
            shown[f] = shown.get(f, 0) + 1
        stack.append((i, own))

    looks = [f"{size_of(len(b.text)) // 2}{share_of(b.linked, len(b.text))}" for b in blocks]
    for i, b in enumerate(blocks):
        h = holder[b.node]
        own = text_features(b.text, b.linked, tags[b.node])
        stands = ("in" if within[h] else "up" if around[h] else "out") + ("<" if i < first else ">" if i > last else "")
        own += [
            f"r={stands}", f"r={stands} {looks[i]}", f"r={stands} {own[0]}",
            f"l={share_of(linked[h], chars[h])}", f"l={share_of(linked[h], chars[h])} {stands}",
            f"s={share_of(prose[h], all_prose)}", f"s={share_of(prose[h], all_prose)} {stands}",
            f"k={kind[h]}", f"k={kind[h]} {stands}",
            f"p={looks[i - 1] if i else ''}", f"q={looks[i + 1] if i + 1 < len(blocks) else ''}",
        ]
        b.own = tuple(own)
    return Page(blocks, parent, added)


def read(page: str | None) -> Page:
    """The leaf blocks in page order with their features; scripts, styles, comments and the like leave none."""
    return described(*parsed(page))


@dataclass
class ChainModel:
    """weight of each feature towards `content`; pair[i][j]: score of label j after i; first[j]: of label j at the start."""

    weight: dict[str, float]
    pair: np.ndarray
    first: np.ndarray

    def scores(self, page: Page) -> list[float]:
        """Score of `content` for each block."""
        get = self.weight.get
        above = [0.0] * len(page.parent)
        for i in range(1, len(above)):
            above[i] = above[page.parent[i]] + sum([get(f, 0.0) for f in page.added[i]])
        return [above[b.node] + sum([get(f, 0.0) for f in b.own]) for b in page.blocks]

    def decode(self, page: Page) -> list[bool]:
        """Viterbi: the best labelling of a page; ties to `not content`."""
        (p00, p01), (p10, p11) = self.pair.tolist()
        back = []
        s0 = s1 = 0.0
        for i, e in enumerate(self.scores(page)):
            if i == 0:
                s0, s1 = float(self.first[0]), float(self.first[1]) + e
                continue
            from0 = s1 + p10 > s0 + p00
            from1 = s1 + p11 > s0 + p01
            back.append((from0, from1))
            s0, s1 = (s1 + p10 if from0 else s0 + p00), (s1 + p11 if from1 else s0 + p01) + e
        if not page.blocks:
            return []
        label = int(s1 > s0)
        labels = [bool(label)]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            labels.append(bool(label))
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = read(page)
        return "\n".join(b.text for b, keep in zip(found.blocks, self.decode(found), strict=True) if keep)


def marginals(e: np.ndarray, lengths: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over pages side by side: P(label at t) and P(labels at t-1 and t), zero behind a page's end.

    e[page, t] is the score of `content`. Values are scaled at each step, which leaves the probabilities as they are.
    """
    pages, steps = e.shape
    x = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    m = np.exp(pair)
    up, down = np.zeros((pages, steps, 2)), np.ones((pages, steps, 2))
    up[:, 0] = np.exp(first) * x[:, 0]
    for t in range(1, steps):
        v = (up[:, t - 1] / up[:, t - 1].sum(1, keepdims=True)) @ m
        up[:, t] = v * x[:, t]
    for t in range(steps - 2, -1, -1):
        v = (x[:, t + 1] * down[:, t + 1]) @ m.T
        v /= v.sum(1, keepdims=True)
        down[:, t] = np.where((t + 1 < lengths)[:, None], v, 1.0)
    p = up * down
    p /= p.sum(2, keepdims=True)
    both = up[:, :-1, :, None] * m * (x * down)[:, 1:, None, :]
    both /= both.sum((2, 3), keepdims=True)
    alive = np.arange(steps) < lengths[:, None]
    return p * alive[:, :, None], both * alive[:, 1:, None, None]


def fit(pages: list[tuple[Page, list[bool]]], rounds: int = 24, batch: int = 48, ridge: float = 5e-5, seed: int = 5) -> ChainModel:
    """Maximum likelihood by AdaGrad over batches of pages of like length, gradients by forward-backward."""
    index: dict[str, int] = {}
    pages = sorted((p for p in pages if p[0].blocks), key=lambda p: len(p[1]))
    batches = []
    for at in range(0, len(pages), batch):
        part = pages[at : at + batch]
        steps = max(len(y) for _, y in part)
        columns, owner = [], []
        labels, lengths = np.zeros((len(part), steps), np.int64), np.array([len(y) for _, y in part])
        for i, (page, y) in enumerate(part):
            labels[i, : len(y)] = y
            paths: dict[int, list[int]] = {}
            for t, b in enumerate(page.blocks):
                if b.node not in paths:
                    paths[b.node] = [index.setdefault(f, len(index)) for f in page.path(b)]
                row = paths[b.node] + [index.setdefault(f, len(index)) for f in b.own]
                columns += row
                owner += [i * steps + t] * len(row)
        use, inverse = np.unique(np.array(columns), return_inverse=True)
        batches.append((use, inverse, np.array(owner), labels, lengths))
    w, gw = np.zeros(len(index)), np.full(len(index), 1e-2)
    q, gq = np.zeros(6), np.full(6, 1e-2)  # pair 0-3, first 4-5
    order, rng = list(range(len(batches))), random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            use, inverse, owner, y, lengths = batches[i]
            e = np.bincount(owner, w[use][inverse], y.size).reshape(y.shape)
            p, both = marginals(e, lengths, q[:4].reshape(2, 2), q[4:])
            alive = np.arange(y.shape[1]) < lengths[:, None]
            d = (p[:, :, 1] - y) * alive
            counts = np.zeros(6)
            counts[:4] = both.sum((0, 1)).ravel() - np.bincount((2 * y[:, :-1] + y[:, 1:])[alive[:, 1:]], minlength=4)
            counts[4:] = p[:, 0].sum(0) - np.bincount(y[:, 0], minlength=2)
            g = np.bincount(inverse, d.ravel()[owner], len(use)) + ridge * len(y) * w[use]
            gw[use] += g * g
            w[use] -= 0.3 * g / np.sqrt(gw[use])
            gq += counts * counts
            q -= 0.1 * counts / np.sqrt(gq)
    return ChainModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, q[:4].reshape(2, 2).copy(), q[4:].copy())


# --- labelled pages ---

#: What each kind of furniture is called in class and id names, and the words that short blocks of it show.
FURNITURE = {
    "ad": ("ad ads advert advertisement banner sponsored promo promotion adsbygoogle dfp commercial adslot adbox advertSlot sponsor outbrain taboola", "advertisement sponsored ad promoted buy now offer sale anzeige publicité publicidad реклама"),
    "nav": ("nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc links tabs skip mainmenu leftMenu sitenav navWrapper topmenu portal subnav", "home about contact next previous menu login search more news skip to content navigation startseite kontakt accueil inicio contacto главная"),
    "header": ("header masthead topbar logo branding site sitehead hero siteHeader pageheader topBar tagline", "welcome home subscribe sign in your daily news"),
    "footer": ("footer foot colophon copyright legal bottom siteinfo pageFooter sitefooter credits imprint", "copyright all rights reserved privacy policy terms imprint of use last edited licence impressum datenschutz mentions légales aviso legal"),
    "aside": ("sidebar aside widget related recommended popular trending rail secondary teaser tags archive relatedStories leftSidebar rightcolumn jp-relatedposts morestories sphinxsidebar mostread category author-bio card panel list-group col-md-4 col-lg-3 right-column", "related popular recent posts most read archives tags more on this story you may also like categories in brief table of contents"),
    "notice": ("notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall message toast disclaimer warning cookieBanner newsletterSignup dialog lightbox", "cookies accept all we use this site subscribe now get our newsletter agree"),
    "share": ("share sharing social follow buttons print sharedaddy addtoany shareButtons social-links sharebar likes", "share this tweet facebook twitter email print follow us click to"),
    "form": ("form search login signup contact poll survey searchbox loginform respond", "submit name email password send search reset leave a reply"),
    "comment": ("comment comments respond replies discussion disqus commentlist reply thread commentsArea disqus_thread responses", "comments reply says posted leave a comment report"),
}
CONTENT = "content article post entry body main story text page article-body post-content entry-content storyBody mw-parser-output single blogpost rightContent articleText markdown document bodywrapper".split()
WRAPPERS = "wrapper container page layout row grid site hfeed app root outer inner wrap main-wrapper site-content content-area col-md-12 l-page l-main primary section shell viewport".split()
SIDE_BY_SIDE = "row columns grid wrap flex two-col container layout".split()
COLUMNS = ("col-md-8", "col-lg-9", "column left", "primary", "main-column", "eight columns", "l-main", "center", "content-area", "documentwrapper")
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "notice": "alert"}
SYLLABLES = "th er on an re he in ed nd sch ei ü é ou ció a o st ti l m к на ру".split()


class Layouts:
    """Random pages; blocks of the article hold \x02 as their mark, to be taken off by `labelled`."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.names = "named"
        self.vocabulary = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 5))) for _ in range(20_000)]

    def one(self, *choices):
        return self.rng.choice(choices)

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def word(self) -> str:
        return self.rng.choice(self.vocabulary)

    def words(self, low: int, high: int | None = None) -> str:
        out = " ".join(self.rng.choices(self.vocabulary, k=self.rng.randint(low, high or low)))
        return out[:1].upper() + out[1:]

    def sentence(self, low: int = 1, high: int = 30) -> str:
        s = self.words(low, high if self.chance(0.8) else max(low, min(high, 3)))
        return s + self.one(".", ".", ".", ".", "!", "?", "", "!!", "%%%", "&amp;") if self.chance(0.95) else s.upper()

    def prose(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def items(self, texts: list[str]) -> str:
        tag = self.one("ul", "ul", "ol")
        return f"<{tag}>{''.join(f'<li>{t}</li>' if self.chance(0.8) else f'<li>{t}' for t in texts)}</{tag}>"

    def attributes(self, names, role: str = "") -> str:
        """class or id of one of the names, as the page goes: names that tell, letters without sense, or none."""
        if self.names == "none":
            return ""
        if self.names == "hashed":
            return f' class="{self.one("css", "sc", "x", "_")}-{"".join(self.rng.choice("abcdefghij0123456789") for _ in range(6))}"' if self.chance(0.8) else ""
        names = names.split() if isinstance(names, str) else list(names)
        if role and self.chance(0.12):
            return f' role="{role}"'
        chosen = [self.rng.choice(names)]
        if names[0] in ("ad", "nav", "footer", "sidebar") and self.chance(0.2):  # furniture is also named after what it stands by
            chosen.append(self.rng.choice((*CONTENT, "posts", "articles")))
            self.rng.shuffle(chosen)
        elif self.chance(0.4):
            chosen.append(self.rng.choice((self.word(), "box", "wrap", "inner", "block", "col", "area", "section", self.rng.choice(names))))
        return f' {self.one("class", "class", "id")}="{self.one(" ", "-", "_").join(chosen)}"' + (f' role="{role}"' if role and self.chance(0.15) else "")

    def told(self, kind: str) -> str:
        """A telling phrase."""
        words = FURNITURE[kind][1].split()
        at = self.rng.randrange(len(words))
        return " ".join(words[at : at + self.rng.randint(1, 4)] if self.chance(0.5) else self.rng.sample(words, self.rng.randint(1, 3))).capitalize()

    def shown(self, kind: str) -> str:
        """Text of furniture: a telling phrase, a link, or, where names or tags give it away, prose."""
        r = self.rng.random()
        if r < (0.3 if self.names == "named" else 0.7):
            return self.told(kind)
        return self.prose(1, 3) if r < 0.75 and self.names == "named" else self.link(self.words(1, 6))

    def furniture(self, kind: str) -> str:
        names = FURNITURE[kind][0]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        attributes = ""
        if tag == "div" or self.chance(0.6):
            tag = self.one("div", "div", "div", "div", "div", "section") if tag == "div" or self.chance(0.7) else tag
            attributes = self.attributes(names, ROLES.get(kind, ""))
        if kind == "nav":
            told = FURNITURE["nav"][1].split()
            labels = [self.link(self.rng.choice(told).capitalize() if self.chance(0.3) else self.words(1, 3)) if self.chance(0.9) else self.words(1) for _ in range(self.rng.randint(1, 9))]
            inner = self.items(labels) if self.chance(0.6) else self.one(" | ", "<br>", " ", " &raquo; ").join(labels)
            if self.chance(0.15):
                inner = f"<{(h := self.one('h2', 'h3', 'h4'))}>{self.one('Navigation', 'Navigation menu', 'Menu', 'Table of contents', self.words(1, 2))}</{h}>" + inner
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name=q><select><option>{self.words(1)}<option>{self.words(2)}</select><textarea>{self.words(3)}</textarea><button>{self.words(1)}</button>" + (f"<p>{self.shown(kind)}</p>" if self.chance(0.6) else "")
            if attributes or self.chance(0.5):
                inner = f"<form>{inner}</form>" if tag != "form" else inner
        elif kind == "comment":
            one = lambda: self.one(f'<div class="comment"><p>{self.prose()}</p></div>', f"<article class=comment><header>{self.words(2)}</header><p>{self.prose()}</p></article>", f"<li class=comment><b>{self.words(1)}</b><p>{self.prose()}</p>", f'<div class="comment-body"><p>{self.prose()}</p></div>')
            inner = f"<h3>{self.shown(kind)}</h3>" + "".join(one() for _ in range(self.rng.randint(0, 4)))
            if not attributes.strip():
                attributes = ' class="comments"'
        elif kind == "footer":
            inner = self.one(
                f"{self.one('&copy; ', 'Copyright ', '&copy; 2024 ', 'Copyright &copy; ')}{self.words(1, 3)}{self.one('', '.', ' All rights reserved.', ', all rights reserved.', ' 2023')}",
                f"{self.one('&copy; ', '')}{self.word()}.example.net &middot; {self.prose(1, 2)}",
                f"<p>{self.shown(kind)}</p><p>{self.one('&copy; 2020 ', '')}{self.prose(1, 1)}</p>",
                f"<p>&copy; {self.words(1, 3)}. All rights reserved.</p>",
                self.items([self.sentence(4, 12) + " " + self.shown(kind) for _ in range(2)]) if self.names == "named" else f"<small>Copyright 2001 {self.words(2)}</small>",
                " | ".join(self.link(self.one("Privacy policy", "Terms of use", "Help", self.words(1, 2))) for _ in range(3)),
            )
        elif kind == "aside":
            inner = f"<{(h := self.one('h2', 'h3', 'h4', 'div', 'p'))}>{self.shown(kind)}</{h}>"
            inner += self.items([self.link(self.words(2, 7)) for _ in range(self.rng.randint(2, 6))]) if self.chance(0.6) or self.names != "named" else f"<p>{self.prose()}</p>"
            if self.names == "named" and self.chance(0.3):
                inner += f"<p>{self.prose()}</p>"
        elif kind == "header":
            inner = self.one(f"<h1>{self.words(2)}</h1>", f"<div class=logo>{self.words(2)}</div>", f"<p>{self.prose(1, 1)}</p>", self.link(self.words(2)), f"<p class=site-title>{self.link(self.words(2))}</p><p class=site-description>{self.sentence(3, 8)}</p>") if self.names == "named" or tag == "header" else self.link(self.words(2))
        elif kind == "share":
            inner = self.one(self.shown(kind), f"<h3>{self.one('Share this:', 'Share', self.shown(kind))}</h3>{self.items([self.link(self.words(1, 4)) for _ in range(3)])}", " ".join(self.link(self.one("Facebook", "Twitter", "Email", "Print", self.words(1))) for _ in range(3)), f"<p>Share this: {self.link('Twitter')} {self.link('Email')}</p>")
        else:
            inner = self.one(self.shown(kind), f"<p>{self.shown(kind)}</p>", f"<p>{self.shown(kind)}</p><p>{self.prose(1, 2)}</p>", f"<h4>{self.shown(kind)}</h4>{self.prose(1, 1)}", f"<p>{self.prose(1, 2)}</p><button>{self.one('Accept', 'OK', self.words(1))}</button>") if self.names == "named" else self.shown(kind)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def paragraph(self) -> str:
        r = self.rng.random()
        mark = "\x02"
        body = self.prose(1, 6) if self.chance(0.8) else self.sentence(1, 8)
        if self.chance(0.2):  # articles, too, say what furniture says
            body = self.told(self.rng.choice(sorted(FURNITURE))) + self.one(".", "")
        if self.chance(0.15):
            body += f" {self.link(self.words(2))} {self.sentence()}"
        if self.chance(0.15):
            body = self.one(f"<b>{body}</b>", f"<em>{body}</em>", f"<b>{body}<br>", f"<span>{body}</span>")
        if r < 0.70:
            return f"<p>{mark}{body}" + ("</p>" if self.chance(0.85) else "")
        if r < 0.76:
            return f"<{(h := self.one('h2', 'h3', 'h4'))}>{mark}{self.words(1, 8)}</{h}>"
        if r < 0.82:
            return self.items([mark + (self.sentence() if self.chance(0.8) else self.link(self.words(3))) for _ in range(self.rng.randint(2, 5))])
        if r < 0.86:
            return f"<blockquote>{self.one('', '<p>')}{mark}{body}</blockquote>"
        if r < 0.88:
            return f"<pre>{mark}{self.words(6)}\n  {self.words(4)}</pre>"
        if r < 0.91:
            return f"<figure><img src=x.png><figcaption>{mark}{self.sentence(1, 9)}</figcaption></figure>"
        if r < 0.95:
            return f"<table><tr><th>{mark}{self.words(1, 2)}</th><th>{mark}{self.words(1)}</th></tr>" + "".join(f"<tr><td>{mark}{self.words(1, 3)}</td><td>{mark}{self.one(self.sentence(1, 9), str(self.rng.randint(1, 999)))}</td></tr>" for _ in range(self.rng.randint(1, 3))) + "</table>"
        if r < 0.98:
            return f"<div>{mark}{body}</div>"
        return f"<dl><dt>{mark}{self.words(2)}<dd>{mark}{self.sentence()}</dl>"

    def article(self) -> str:
        title = f"<{(h := self.one('h1', 'h1', 'h1', 'h2'))}>\x02{self.words(1, 9)}</{h}>" if self.chance(0.85) else ""
        parts = [self.paragraph() for _ in range(self.one(1, 1, 2, 3, 3, 5, 8, 14))]
        for _ in range(self.one(0, 0, 0, 1, 1, 2) if self.names == "named" else 0):
            parts.insert(self.rng.randint(0, len(parts)), self.furniture(self.one("ad", "share", "aside", "notice", "form", "ad", "share")))
        if self.chance(0.08):
            parts.insert(self.rng.randint(0, len(parts)), self.one(f"<p hidden>{self.prose()}</p>", f'<div style="display:none">{self.prose()}</div>', f'<p style="color: red; display: none;">{self.prose()}</p>'))
        if self.chance(0.1):  # sections of their own
            cut = self.rng.randint(0, len(parts))
            parts = [f"<section>{''.join(parts[:cut])}</section><section>{''.join(parts[cut:])}</section>"]
        inner = title + "".join(parts)
        if self.chance(0.25) and title:
            inner = f"<header{self.attributes(['entry-header', 'post-header', 'article-header']) if self.chance(0.5) else ''}>{title}</header>" + self.one("".join(parts), f"<div{self.attributes(CONTENT)}>{''.join(parts)}</div>")
        r = self.rng.random() if self.names == "named" or self.chance(0.3) else 0.7 + 0.3 * self.rng.random()
        if r < 0.35:
            return f"<article{self.attributes(CONTENT) if self.chance(0.4) else ''}>{inner}</article>"
        if r < 0.45:
            return f"<main{self.attributes(CONTENT) if self.chance(0.3) else ''}>{inner}</main>"
        if r < 0.53:
            return f"<main><article>{inner}</article></main>"
        if r < 0.6:
            return f'<div role="main"{self.attributes(CONTENT)}>{inner}</div>'
        if r < 0.7 and self.names == "named":
            return f"<{(t := self.one('div', 'div', 'section'))}{self.attributes(CONTENT, 'main')}>{inner}</{t}>"
        if r < 0.78:
            return inner
        return self.wrapped(f"<div{self.attributes(CONTENT)}>{inner}</div>", self.one(0, 0, 1, 2))

    def wrapped(self, inner: str, n: int) -> str:
        for _ in range(n):
            noise = f' class="{self.rng.choice(FURNITURE[self.rng.choice(sorted(FURNITURE))][0].split())}-{self.one("on", "fixed", "open", "left", "dark")}"'
            inner = f"<div{noise if self.names == 'named' and self.chance(0.1) else self.attributes(WRAPPERS) if self.chance(0.6) else ''}>{inner}</div>"
        return inner

    def alone(self) -> str:
        """A page of text alone."""
        text = "\x02" + self.prose(1, 5)
        page = self.one(text, f"<p>{text}</p>", f"<html><body>{text}</body></html>", f"<body><p>{text}</p><p>\x02{self.prose()}</p></body>", f"<html><head><title>{self.words(3)}</title></head><body><h1>\x02{self.words(3)}</h1><p>{text}</p></body></html>", f"<div><p>{text}<p>\x02{self.prose()}</div>", f"<div><div><p>{text}</p></div></div>")
        return page

    def table_layout(self) -> str:
        """Cells of a table as the parts of a page."""
        menu = self.one("<br>", " ", " | ").join(self.link(self.words(1, 2)) for _ in range(self.rng.randint(1, 6)))
        article = (f"<h1>\x02{self.words(2, 6)}</h1>" if self.chance(0.7) else "") + "".join(self.paragraph() for _ in range(self.one(2, 3, 5)))
        top = f"<tr><td colspan=2>{self.one(f'<b>{self.words(2)}</b>', self.link(self.words(2)))}</td></tr>" if self.chance(0.6) else ""
        foot = f"<tr><td colspan=2>{self.one('', '<small>', '<font size=1>')}{self.one('&copy;', 'Copyright')} 2004 {self.words(2)}{self.one('', '. All rights reserved.')}</td></tr>" if self.chance(0.7) else ""
        cells = [f"<td{self.attributes('menu nav left') if self.chance(0.3) else ''}>{menu}</td>", f"<td>{article}</td>"]
        return f"<html><body><table>{top}<tr>{''.join(cells if self.chance(0.8) else cells[::-1])}</tr>{foot}</table></body></html>"

    def page(self) -> str:
        r = self.rng.random()
        self.names = "named" if r < 0.76 else "hashed" if r < 0.86 else "none"
        if self.chance(0.05):
            return self.alone()
        if self.chance(0.06):
            return self.table_layout()
        if self.chance(0.04):  # from before there were divs
            bar = self.one(" | ", " ").join(self.link(self.words(1, 2)) for _ in range(4))
            middle = f"<H1>\x02{self.words(2, 6)}</H1>" + "".join(f"<P>\x02{self.prose(1, 5)}" for _ in range(self.rng.randint(1, 6)))
            return f"<HTML><BODY><CENTER>{bar}</CENTER><HR>{middle}<HR><FONT SIZE=1>{self.one('Copyright', '&copy;')} 1998 {self.words(1, 3)}{self.one('', '. All rights reserved.')}</FONT></BODY></HTML>"
        before = [self.furniture(k) for k in self.rng.sample(["nav", "header", "ad", "notice", "nav", "ad", "form", "aside"] if self.names == "named" else ["nav", "header", "nav"], self.rng.randint(0, 4 if self.names == "named" else 2))]
        after = [self.furniture(k) for k in self.rng.sample(["aside", "ad", "share", "form", "notice", "nav", "ad"] if self.names == "named" else ["aside", "share", "nav"], self.rng.randint(0, 3 if self.names == "named" else 2))]
        if self.chance(0.4):
            after.append(self.furniture("comment"))
        if self.chance(0.8):
            after.append(self.furniture("footer"))
        middle = self.article()
        if self.chance(0.4):  # beside a sidebar or the like
            column = f' class="{self.rng.choice(COLUMNS)}"' if self.names == "named" and self.chance(0.6) else self.attributes(WRAPPERS)
            parts = [self.one(middle, f"<div{column}>{middle}</div>"), self.furniture(self.one("aside", "aside", "nav", "ad" if self.names == "named" else "nav"))]
            if self.chance(0.25):
                parts.reverse()
            if self.chance(0.2) and self.names == "named":
                parts.append(f'<div class="{self.one("col-md-4", "col-lg-3", "column right", "four columns")}"><div class="{self.one("card", "panel", "box")}"><div class="{self.one("card-header", "panel-heading", "title")}">{self.one("Most read", self.words(1, 3), self.shown("aside"))}</div>{self.items([self.link(self.words(2, 7)) for _ in range(3)])}</div></div>')
            middle = f"<div{self.attributes(SIDE_BY_SIDE)}>{''.join(parts)}</div>"
        if self.chance(0.1) and len(after) > 1:  # what comes behind the article is inside its element's parent
            middle, after = f"<main>{middle}{after[0]}</main>", after[1:]
        body = self.wrapped("".join(before) + self.wrapped(middle, self.one(0, 0, 0, 1, 2)) + "".join(after), self.one(0, 0, 0, 1, 1, 2, 3, 4, 6, 10, 40) if self.chance(0.9) else 0)
        head = f"<head><title>{self.words(5)}</title><style>p{{}}</style></head>" if self.chance(0.9) else ""
        names = f' class="{" ".join(self.rng.choice(FURNITURE[self.rng.choice(sorted(FURNITURE))][0].split()) for _ in range(2))}"' if self.chance(0.2) else ""
        return f'<!DOCTYPE html><html lang="x">{head}<body{names}><!-- {self.word()} -->{body}' + ("</body></html>" if self.chance(0.9) else "")


def training_pages(n: int = 2_500, seed: int = 11) -> list[str]:
    """n marked pages."""
    layouts = Layouts(seed)
    return [layouts.page() for _ in range(n)]


def labelled(marked_page: str) -> tuple[Page, list[bool]]:
    """A page from `training_pages` without its marks, and the labels of its blocks."""
    blocks, *elements = parsed(marked_page)
    marks = ["\x02" in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace("\x02", "")
        b.linked = min(b.linked, len(b.text))
    return described(blocks, *elements), marks


@lru_cache(maxsize=1)
def trained() -> ChainModel:
    """The production model; always the same."""
    pages = [labelled(p) for p in training_pages()]
    return fit(pages)


def extract(pages: DataFrame, model: ChainModel) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages, and pages without a block of content, give an empty text. Rows are read one by one: repeated rows
    repeat, an empty table gives an empty one, other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extracted(batches):
        crf = shared.value
        for b in slices(batches):
            texts = [crf.extract(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").alias("h")).mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
