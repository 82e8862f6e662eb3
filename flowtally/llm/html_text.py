"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block in the context of its whole page."""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum

PATH_DIMS, WORD_DIMS, MORE_DIMS, HIDDEN = 192, 32, 9, 16
FIT_PAGES, FIT_EPOCHS, SEED = 2000, 12, 11

_NAMED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_CLOSED = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
SKIPPED = {"head", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "datalist"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption colgroup tbody td tfoot th thead tr ul button".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot caption option optgroup button html body".split())
_UP_TO = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("tbody", "thead", "tfoot", "table"), "option": ("select", "datalist"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
_LIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}


class Level:
    """One open tag of a path: its label (tag, then words of class, id and role), the level around it, and how deep it is."""

    __slots__ = ("label", "up", "depth")

    def __init__(self, label: str, up: Level | None) -> None:
        self.label, self.up, self.depth = label, up, up.depth + 1 if up else 1

    @staticmethod
    def of(labels: tuple[str, ...]) -> Level | None:
        at = None
        for x in labels:
            at = Level(x, at)
        return at


@dataclass
class Block:
    """A leaf: its text (references decoded, white space collapsed), tag path (the innermost level, or labels from the root), and
    the characters that are links."""

    text: str
    path: Level | tuple[str, ...] | None
    linked: int


class Tags:
    """The tags of a page from left to right, each in time that its own length takes, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.marks: list[int] | None = None
        self.ends: list[int] = []

    def _end(self, at: int) -> int:
        """Where the first > outside of quotes is; -1 if there is none. Once that has failed, it's looked up for all places."""
        if self.marks is None:
            m = _CLOSED.match(self.page, at)
            if m:
                return m.end() - 1
            self.marks = [m.start() for m in _SPECIAL.finditer(self.page)]
            self.ends = [-1] * (len(self.marks) + 1)
            quote = {'"': len(self.marks), "'": len(self.marks)}  # the next of its kind
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[k]]
                if c == ">":
                    self.ends[k] = self.marks[k]
                else:
                    self.ends[k] = self.ends[quote[c] + 1] if quote[c] < len(self.marks) else -1
                    quote[c] = k
        return self.ends[bisect_left(self.marks, at)]

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        start = page.find("<", at)
        while start >= 0:
            if start > self.last:  # nothing is closed any more; a comment goes to the end
                start = page.find("<!--", start)
                return (start, len(page), "", False, "") if start >= 0 else None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            m = _NAMED.match(page, start)
            if m:
                end = self._end(m.end())
                end = page.find(">", m.end()) if end < 0 else end
                return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            if page[start + 1] in "!?":
                return start, page.find(">", start + 2) + 1, "", False, ""
            start = page.find("<", start + 1)
        return None


class Stack:
    """Open tags, with the places of each name, so that the nearest one of a name is found at once."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.skip = 0

    def push(self, name: str, label: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.levels.append(Level(label, self.top()))
        self.skip += name in SKIPPED

    def top(self) -> Level | None:
        return self.levels[-1] if self.levels else None

    def nearest(self, names: tuple[str, ...]) -> int:
        """The highest place of any of the names; -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, place: int) -> None:
        while len(self.names) > place >= 0:
            name = self.names.pop()
            self.levels.pop()
            self.places[name].pop()
            self.skip -= name in SKIPPED

    def close_within(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close up to the nearest of the names, unless one of the limits is nearer."""
        place = self.nearest(names)
        if place > self.nearest(limits):
            self.close(place)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Unclosed and crossing tags are taken as browsers take them, as far as blocks go. Time and memory
    are in proportion to the page's length: a path is a chain of levels that blocks share."""
    out: list[Block] = []
    tags, stack = Tags(page), Stack()
    parts: list[str] = []
    links = [0, 0]  # open <a>, raw characters in them

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text and not stack.skip:
                out.append(Block(text, stack.top(), links[1]))
            parts.clear()
        links[1] = 0

    at, n = 0, len(page)
    lower = None
    while tag := tags.after(at):
        start, end, name, closes, attributes = tag
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if links[0]:
                links[1] += len(piece)
        at = end
        if not name:
            continue
        if closes:
            if name == "a":
                links[0] = max(0, links[0] - 1)
            elif name in BLOCK or name in SKIPPED:
                flush()
                stack.close(stack.nearest((name,)))
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != n:  # a character changed its length
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find("</" + name, at)
            at = n if end < 0 else end
            parts.append(" ")
            continue
        if name == "a":
            links[0] += 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK or name in SKIPPED:
            flush()
            if name in CLOSES_P:
                stack.close_within(("p",), ("table", "button"))
            if name in _UP_TO:
                stack.close_within(_LIKE.get(name, (name,)), _UP_TO[name])
            if name == "body" and stack.places.get("head"):
                stack.close(stack.places["head"][0])
            if name not in VOID and not attributes.endswith("/"):
                named = [a or b or c for a, b, c in _ATTR.findall(attributes)]
                stack.push(name, " ".join([name, *dict.fromkeys(t.lower() for x in named for t in _NAME.findall(x))]))
    if at < n:
        parts.append(page[at:])
    flush()
    return out


#: How the weight of a level falls with its distance from the leaf, and what it doesn't fall below.
FALL, FLOOR = 0.85, 0.35
#: Levels that weigh more than FLOOR.
NEAR = 7


@lru_cache(maxsize=1 << 14)
def _hashed(text: str) -> tuple[int, int]:
    h = zlib.crc32(text.encode())
    return h % PATH_DIMS, 1 if h >> 16 & 1 else -1


def _marks(label: str) -> list[tuple[int, int]]:
    """Place and sign of a level's tag and of its words."""
    tag, *names = label.split(" ")
    return [_hashed(f"<{tag}>"), *map(_hashed, names)]


@lru_cache(maxsize=1 << 14)
def _near(labels: tuple[str, ...]) -> np.ndarray:
    """What the levels nearest to a leaf, the innermost first, weigh over FLOOR; the leaf's tag counts by itself."""
    v = np.zeros(PATH_DIMS, np.float32)
    for d, label in enumerate(labels):
        for k, sign in _marks(label):
            v[k] += sign * (max(FLOOR, FALL**d) - FLOOR)
    if labels:
        k, sign = _hashed(f"leaf <{labels[0].split(' ')[0]}>")
        v[k] += sign
    return v


@lru_cache(maxsize=1 << 14)
def _whole(labels: tuple[str, ...]) -> np.ndarray:
    """The vector of a path of up to NEAR levels."""
    sums = np.zeros(PATH_DIMS, np.float32)
    for label in labels:
        for k, sign in _marks(label):
            sums[k] += sign
    return np.clip(_near(labels) + np.float32(FLOOR) * sums, -2, 2)


class Paths:
    """Vectors of paths one after the other: the sum over all levels is kept, and only levels that open or close change it."""

    def __init__(self) -> None:
        self.at: Level | None = None
        self.sums = np.zeros(PATH_DIMS, np.float32)  # of whole numbers

    def _add(self, level: Level, times: int) -> None:
        for k, sign in _marks(level.label):
            self.sums[k] += times * sign

    def vector(self, path: Level | None) -> np.ndarray:
        """Hashed tags and class or id words of a path; the nearer to the leaf, the heavier."""
        near, x = [], path
        while x is not None and len(near) < NEAR:
            near.append(x.label)
            x = x.up
        if x is None:
            return _whole(tuple(near))
        here, there, opened = self.at, path, []
        while here is not there:
            if there is None or (here is not None and here.depth >= there.depth):
                self._add(here, -1)
                here = here.up
            else:
                opened.append(there)
                there = there.up
        for x in opened:
            self._add(x, 1)
        self.at = path
        return np.clip(_near(tuple(near)) + np.float32(FLOOR) * self.sums, -2, 2)


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """One matrix for each page: tag-path vector, hashed-word vector and measures of every block, from its whole text."""
    every = [b for p in pages for b in p]
    x = np.zeros((len(every), PATH_DIMS + WORD_DIMS + MORE_DIMS), np.float32)
    for lo, hi, counts, h in textnum.FOLDED.blocks(pa.array([b.text for b in every], pa.string())):
        row = np.repeat(np.arange(lo, hi), counts)
        sign = np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
        w = np.bincount((row - lo) * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), sign, (hi - lo) * WORD_DIMS).reshape(hi - lo, WORD_DIMS)
        x[lo:hi, PATH_DIMS : PATH_DIMS + WORD_DIMS] = w / np.sqrt(np.maximum(counts, 1))[:, None]
        x[lo:hi, -1] = np.log1p(counts) / 5
    paths = Paths()
    for i, b in enumerate(every):
        t, n = b.text, len(b.text)
        path = Level.of(b.path) if isinstance(b.path, tuple) else b.path
        x[i, :PATH_DIMS] = paths.vector(path)
        x[i, -9:-1] = (np.log1p(n) / 7, min(1.0, b.linked / n), (t.count(".") + t.count(",")) / n * 10, t.count("|") / n * 10, t[-1] in ".!?…", "©" in t, (path.depth if path else 0) / 10, sum(map(str.isdigit, t)) / n)
    cuts = np.cumsum([len(p) for p in pages])[:-1]
    return np.split(x, cuts)


@dataclass
class Labeller:
    """Weights: for each direction input, recurrent and bias of the four gates; then the output layer."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        d, h = PATH_DIMS + WORD_DIMS + MORE_DIMS, HIDDEN
        p = {}
        for way in "fb":
            p["x" + way] = rng.normal(0, d**-0.5, (d, 4 * h))
            p["h" + way] = rng.normal(0, h**-0.5, (h, 4 * h))
            p["b" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        p["o"] = rng.normal(0, 0.1, 2 * h + d)
        p["ob"] = np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time-major x; a padded step passes the state on."""
        t, b, _ = x.shape
        gates = x.reshape(t * b, -1) @ self.p["x" + way] + self.p["b" + way]
        gates = gates.reshape(t, b, -1)
        h = c = np.zeros((b, HIDDEN), np.float32)
        out, tape = np.zeros((t, b, HIDDEN), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = gates[k] + h @ self.p["h" + way]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, a * HIDDEN : (a + 1) * HIDDEN], -30, 30))) for a in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                tape.append((k, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[k] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        o = self.p["o"]
        return self._run(x, mask, "f", False)[0] @ o[:HIDDEN] + self._run(x, mask, "b", False)[0] @ o[HIDDEN : 2 * HIDDEN] + x @ o[2 * HIDDEN :] + self.p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the blocks, by backpropagation through time."""
        sides = {w: self._run(x, mask, w, True) for w in "fb"}
        s = np.concatenate([sides["f"][0], sides["b"][0], x], 2)
        err = (1 / (1 + np.exp(-np.clip(s @ self.p["o"] + self.p["ob"], -30, 30))) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tb,tbk->k", err, s), "ob": err.sum(keepdims=True).reshape(1)}
        for n, way in enumerate("fb"):
            dout = err[:, :, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.p["h" + way])
            for k, h, c, i, f, o, g, tc, m in reversed(sides[way][1]):
                dh = dh + dout[k]
                dn = dh * m
                dc2 = dc * m + dn * o * (1 - tc * tc)
                z = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dn * tc * o * (1 - o), dc2 * i * (1 - g * g)], 1)
                dz[k] = z
                gh += h.T @ z
                dh = np.where(m, z @ self.p["h" + way].T, dh)
                dc = np.where(m, dc2 * f, dc)
            flat = dz.reshape(-1, 4 * HIDDEN)
            grad |= {"h" + way: gh, "x" + way: x.reshape(len(flat), -1).T @ flat, "b" + way: flat.sum(0)}
        return grad

    def label(self, pages: list[np.ndarray], cells: int = 1 << 14) -> list[np.ndarray]:
        """Which blocks are main text. Pages of like length run side by side; none is cut."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(x) for x in pages], kind="stable").tolist() if len(pages[i])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            x, mask = padded([pages[i] for i in order[at:end]])
            s = self.scores(x, mask)
            for j, i in enumerate(order[at:end]):
                out[i] = s[: len(pages[i]), j] > 0
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), np.float32), np.zeros((t, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


# Names that pages give to their parts.
NAMES = {
    "nav": "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs pagination pager links tabs toc-nav skip",
    "header": "header site-header masthead top-bar page-header branding logo",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner ad-slot adbox outbrain",
    "notice": "notice cookie cookies consent gdpr alert banner-notice popup modal overlay disclaimer paywall",
    "aside": "sidebar aside widget related recommended trending popular most-read more-stories share social tags author-box",
    "form": "newsletter subscribe signup search login contact-form register",
    "comment": "comments comment comment-list discussion replies responses disqus reader-comments respond",
    "footer": "footer site-footer bottom copyright legal colophon",
    "main": "content article post entry story article-body post-content entry-content main text body-copy page-content",
}
_SAID = {
    "nav": "Home News About Contact Sport World Business Culture Archive Next Previous Menu",
    "ad": "Buy now save today offer free shipping sale deal advertisement sponsored",
    "notice": "We use cookies to improve this site accept privacy policy settings",
    "aside": "Read more related stories share follow us tags popular latest",
    "form": "Email address name password search subscribe send sign up log in submit",
    "comment": "Reply said wrote agree thanks great comment comments posted ago",
    "footer": "Copyright all rights reserved terms privacy imprint contact",
}
_SYLLABLES = [
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "le de es en re nt on er ou ai te an eu qu la me ss ch pa vi é è ê ç".split(),
    "en er ch de ei te in un ge be sch ie ung au ver ä ö ü ß lich".split(),
    "de la en os es ci ón as ra ta do al co mi rr ll ñ í á".split(),
]


def synthetic_page(rng: random.Random) -> str:
    """A made-up page; main text stands between characters U+E000 and U+E001 that mark its blocks."""
    syllables = rng.choice(_SYLLABLES)
    known = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 2))) for _ in range(25)]
    noisy = rng.random() < 0.15

    def word() -> str:
        w = rng.choice(known) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
        return w + rng.choice(["&amp;&amp;", "%%%", "***", "###", "$$$", "!!", " |"]) if noisy else w

    def sentence(lo: int = 1, hi: int = 16) -> str:
        return (" ".join(word() for _ in range(rng.randint(lo, hi)))).capitalize() + rng.choice([".", ".", ".", ".", "?", "!"] if rng.random() < 0.9 else [""])

    def prose(hi: int = 12) -> str:
        odd = rng.random()
        if odd < 0.03:
            return " ".join([word().capitalize()] * rng.randint(2, 60)) + rng.choice([".", ""])
        if odd < 0.06:
            return " | ".join(word() for _ in range(rng.randint(2, 30))) + rng.choice([" |", ".", ""])
        if odd < 0.08:
            return word().capitalize()
        if odd < 0.10:
            return sentence().upper()
        if odd < 0.12:
            return " ".join(rng.sample(" ".join(_SAID.values()).split(), rng.randint(2, 9))) + "."
        if odd < 0.14:
            return " ".join(rng.choice([word(), str(rng.randint(0, 10**10)), f"{word()}@{word()}.com", '"' + "%x" % rng.getrandbits(80) + '"']) for _ in range(rng.randint(1, 20)))
        return " ".join(sentence() for _ in range(rng.randint(1, hi if rng.random() < 0.7 else 2)))

    def said(kind: str) -> str:
        if rng.random() < 0.55:
            return prose(4)
        return " ".join(rng.sample(_SAID[kind].split(), rng.randint(1, 6)))

    def named(kind: str, tag: str = "div") -> str:
        if rng.random() < 0.08:
            return f"<{tag}>" if tag != "div" else f'<div class="{word()}">'
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(NAMES[kind].split())}{rng.choice(["", "", " c" + str(rng.randint(1, 9)), " wide"])}">'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def links(n: int) -> str:
        inner = [link(rng.choice([word(), word().capitalize(), said("nav")])) for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>" if rng.random() < 0.75 else " | ".join(inner)

    def nav() -> str:
        t = rng.choice(["nav", "nav", "div"])
        return (f"<{t}>" if t == "nav" and rng.random() < 0.6 else named("nav", t)) + links(rng.randint(2, 12)) + f"</{t}>"

    def ad() -> str:
        t = rng.choice(["div", "div", "aside", "section", "p"])
        inner = said("ad") if t == "p" or rng.random() < 0.6 else f"<p>{said('ad')}</p>" * rng.randint(1, 2)
        return named("ad", t) + (link(inner) if rng.random() < 0.3 and t != "p" else inner) + f"</{t}>"

    def notice() -> str:
        t = rng.choice(["div", "div", "section", "aside", "dialog"])
        return named("notice", t) + (said("notice") if rng.random() < 0.5 else f"<p>{said('notice')}</p>") + (f"<button>{word()}</button>" if rng.random() < 0.4 else "") + f"</{t}>"

    def aside() -> str:
        t = rng.choice(["aside", "aside", "div", "section"])
        head = f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{said('aside')}</{h}>" if rng.random() < 0.6 else ""
        return (f"<{t}>" if t == "aside" and rng.random() < 0.5 else named("aside", t)) + head + (links(rng.randint(2, 7)) if rng.random() < 0.6 else "".join(f"<p>{prose(3)}</p>" for _ in range(rng.randint(1, 3)))) + f"</{t}>"

    def form() -> str:
        inner = "".join(rng.choice([f"<label>{said('form')}</label><input name=x>", f"<p>{said('form')}</p>", f"<div>{prose(2)}</div>", f"<textarea>{word()}</textarea>", f"<select><option>{word()}</select>"]) for _ in range(rng.randint(1, 4)))
        return ("<form>" if rng.random() < 0.5 else named("form", "form")) + inner + f"<button>{word()}</button></form>"

    def comments() -> str:
        t = rng.choice(["div", "section", "section", "ol"])
        one = "li" if t == "ol" else rng.choice(["div", "article", "div", "p"])
        head = f"<h3>{said('comment')}</h3>" if rng.random() < 0.6 and t != "ol" else ""
        body = lambda: prose(5) if one == "p" or rng.random() < 0.4 else "".join(f"<p>{prose(4)}</p>" for _ in range(rng.randint(1, 3)))
        each = "".join((named("comment", one) if rng.random() < 0.6 else f"<{one}>") + body() + f"</{one}>" for _ in range(rng.randint(1, 6)))
        return f'<{t} {rng.choice(["class", "id"])}="{rng.choice(NAMES["comment"].split())}">' + head + each + f"</{t}>"

    def footer() -> str:
        t = rng.choice(["footer", "footer", "div"])
        inner = f"&copy; {word()} &middot; {said('footer')}" if rng.random() < 0.6 else f"<p>{said('footer')}</p>" + links(rng.randint(1, 5))
        return (f"<{t}>" if t == "footer" and rng.random() < 0.6 else named("footer", t)) + inner + f"</{t}>"

    def header() -> str:
        t = rng.choice(["header", "header", "div"])
        return (f"<{t}>" if t == "header" and rng.random() < 0.5 else named("header", t)) + rng.choice([f"<h1>{sentence(1, 4)}</h1>", f"<p>{sentence(1, 6)}</p>", link(word()), f"<div>{word()}</div>"]) + (nav() if rng.random() < 0.4 else "") + f"</{t}>"

    mark = lambda s: "\ue000" + s + "\ue001"

    def paragraph() -> str:
        k = rng.random()
        if k < 0.55:
            return f"<p>{mark(prose())}</p>"
        if k < 0.68:
            return f"<p><b>{mark(prose())}<br>"
        if k < 0.74:
            return f"<p>{mark(sentence() + ' ' + link(word()) + ' ' + sentence())}</p>"
        if k < 0.80:
            return f"<h{(n := rng.randint(2, 4))}>{mark(sentence(1, 8))}</h{n}>"
        if k < 0.87:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{mark(sentence())}</li>" for _ in range(rng.randint(1, 6))) + f"</{t}>"
        if k < 0.92:
            return f"<blockquote>{mark(prose(3))}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{mark(prose(3))}</p></blockquote>"
        if k < 0.95:
            return "<table>" + "".join(f"<tr><td>{mark(word())}</td><td>{mark(sentence(1, 5))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<pre>{mark(prose(2))}</pre>"
        return f"<div>{mark(prose())}</div>" if rng.random() < 0.6 else f"<figure><img src=x><figcaption>{mark(sentence())}</figcaption></figure>"

    bad = [ad, notice, aside, form, nav]
    title = f"<h1>{mark(sentence(1, 10))}</h1>" if rng.random() < 0.9 else ""
    if title and rng.random() < 0.12:
        title = f"<header>{title}</header>"
    body = [paragraph() for _ in range(rng.randint(1, 14) if rng.random() < 0.8 else rng.randint(14, 40))]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        body.insert(rng.randint(0, len(body)), rng.choice(bad)())
    if rng.random() < 0.12:
        body.append(comments())
    if rng.random() < 0.1:
        body.append(f"<footer>{said('aside')}</footer>")
    t = rng.choice(["article"] * 4 + ["main", "main", "div", "div", "section"])
    main = (f"<{t}>" if t in ("article", "main") and rng.random() < 0.7 else named("main", t)) + title + "".join(body) + f"</{t}>"
    if rng.random() < 0.35:
        main = rng.choice(["<main>", '<div class="container">', '<div id="wrap">', '<div class="row"><div class="col">']) + main + (aside() if rng.random() < 0.4 else "") + (comments() if rng.random() < 0.3 else "")
    before = [rng.choice([nav, header, notice, ad, nav, header, form, aside])() for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4]))]
    after = [rng.choice([comments, comments, aside, ad, notice, form, nav])() for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
    foot = footer() if rng.random() < 0.85 else ""
    return f"<!DOCTYPE html><html><head><title>{word()}</title><script>var t='</p>';</script></head><body>" + "".join(before) + main + "".join(after) + foot + ("</body></html>" if rng.random() < 0.9 else "")


@lru_cache(maxsize=1)
def fitted(pages: int = FIT_PAGES, epochs: int = FIT_EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, fitted on synthetic pages (a bounded number of labelled rows) by Adam; the same for equal arguments."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    found = [blocks(synthetic_page(draw)) for _ in range(pages)]
    labels = []
    for p in found:
        labels.append(np.array(["\ue000" in b.text for b in p], np.float32))
        for b in p:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "") or "."
    every = vectors(found)
    model = Labeller.fresh(rng)
    m, v, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    order = np.argsort([len(x) for x in every], kind="stable")
    for epoch in range(epochs):
        for batch in rng.permutation(-(-len(order) // 35)):
            pick = [i for i in order[batch * 35 : batch * 35 + 35].tolist() if len(every[i])]
            x, mask = padded([every[i] for i in pick])
            quiet = rng.random(len(pick)) < 0.4  # words left out, so that tags and context must do
            x[:, quiet, PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(pick):
                y[: len(labels[i]), j] = labels[i]
            step += 1
            rate = 0.01 * 0.5 ** (2.5 * epoch / epochs)
            for k, g in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, its main blocks joined by newlines ('' if none), and `n_chars`, its code points; columns of those
    names and the markup are replaced or dropped, others pass through.

    Null and empty markup have no text, and what isn't markup is one block. Pages that repeat are read one by one. Very long
    pages are read and labelled whole, in a batch of their own. No rows give none. The labeller is fitted when it is first
    used in a driver, on pages that it makes up (a bounded number), and sent to the executors."""
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    held = pages.sparkSession.sparkContext.broadcast(fitted().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                part = b.slice(lo, 400)
                found = [blocks(h.as_py() or "") for h in part.column(len(names))]
                chosen = model.label(vectors(found)) if any(found) else [np.zeros(0, bool)] * len(found)
                text = ["\n".join(x.text for x, y in zip(p, c.tolist(), strict=True) if y) if p else "" for p, c in zip(found, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    from pyspark.sql import types as T

    d = pages.select(*names, F.col(html).cast("string"))
    return d.mapInArrow(run, T.StructType([*[d.schema[n] for n in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of pages: its id, url, main text ('' if none) and the text's code points.

    Null, empty and broken markup, repeats and long pages as in extract(); no pages give no rows."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
