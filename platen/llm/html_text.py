"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: the runs of text between block-level tags. A block's
features are its ancestors' tags and names and what its text looks like; a first-order chain with two
labels, trained on labelled pages, is decoded by Viterbi. The model is small and of a fixed size.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .pages_labelled import AROUND, MAIN, labelled_pages

#: Elements by how a parser treats them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("audio button canvas datalist head iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
#: What may be in a head; whatever else begins ends it, as its end tag may be left out.
HEADED = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that a slash closes, with all in them, and that end where an element of HTML begins.
FOREIGN = frozenset({"math", "svg"})
BREAKOUT = BLOCKS | frozenset("b big br code em embed i img nobr ruby s small span strike strong sub sup tt u var".split())
#: Elements that can hold one of their own name; any other ends where the next one of its name begins.
NESTING = frozenset("audio canvas object svg template video".split())
#: Elements of which only the label up to the next tag goes with a start tag that nothing ends.
LABELS = frozenset("button option select title".split())
#: An open element of the value's names ends where one of the key's begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
HINTS = "cookie consent subscribe newsletter comment comments reply privacy terms copyright rights share advertisement sponsored login search menu home contact".split()
#: What an element is by its tag alone.
KINDS = {"nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "note", "article": "main", "main": "main"}
#: What an element is by a word of its names; words of five letters and more count within longer ones, too.
NAMED = {w: kind for kind, words in AROUND.items() for w in words.split()} | {w: "main" for w in MAIN.split()}

_TAG = re.compile(rf"<(/?)({'|'.join(sorted(SILENT - {'head', 'script', 'style'}))})\b", re.I)
_RAW = {name: (re.compile(rf"<{name}\b", re.I), re.compile(rf"</{name}\b", re.I)) for name in ("script", "style")}
_UNENDED = re.compile(r"<[a-zA-Z/!?]")


def _bucket(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


@functools.lru_cache(maxsize=65_536)
def kind_of(tag: str, words: tuple[str, ...]) -> tuple[str | None, frozenset[str]]:
    """What an element is by its tag or, failing that, the first of its names that tells; and the words that do."""
    known = [n for w in words for n in ([w] if w in NAMED else [n for n in NAMED if len(n) > 4 and n in w])] if tag not in ("html", "body") else []
    return KINDS.get(tag) or (NAMED[known[0]] if known else None), frozenset(known)


class Place:
    """An open element, with what all elements around it tell: a page's places share what they have in common."""

    __slots__ = ("around", "tag", "words", "labelled", "tags", "names", "inner", "outer", "kinds", "above", "below", "last")

    def __init__(self, around: Place | None, tag: str, words: tuple[str, ...], labelled: bool):
        self.around, self.tag, self.words, self.labelled = around, tag, words, labelled or bool(around and around.labelled)
        kind, known = kind_of(tag, words)
        tags, names = (around.tags, around.names) if around else (frozenset(), frozenset())
        block = tag in BLOCKS and tag not in ("html", "body")
        self.tags = tags | {tag} if block and tag not in tags else tags
        self.names = names if known <= names else names | known
        self.last = tag if block else around.last if around else None
        self.inner = kind or (around.inner if around else None)
        self.outer = (around.outer if around else None) or kind
        kinds = around.kinds if around else frozenset()
        self.kinds = kinds if kind is None or kind in kinds else kinds | {kind}
        self.above = kinds if kind == "main" else around.above if around else frozenset()  # those around that element
        below = around.below if around else None  # the kinds within the innermost main element; null outside of any
        self.below = frozenset() if kind == "main" else below if kind is None or below is None or kind in below else below | {kind}


class Block(NamedTuple):
    text: str
    place: Place | None
    linked: float  # share of the text in links

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...], bool], ...]:
        """Of each open element, outermost first: tag, words of its class, id and role, whether it or one around it is labelled as main."""
        out, at = [], self.place
        while at:
            out.append((at.tag, at.words, at.labelled))
            at = at.around
        return tuple(reversed(out))


def ended(html: str) -> str:
    """html without the start tags of silent elements that nothing ends, which would swallow the page from there on,
    without comments, and without a tag at the end that breaks off. One pass: its time grows with the page's length.
    """
    cut = _UNENDED.search(html, html.rfind(">") + 1)
    html = html[: cut.start()] if cut else html
    last: dict[str, list[tuple[int, int, str]]] = {}
    drop: list[tuple[int, int]] = []
    lost: list[tuple[int, int, str]] = []
    closed = {"script": True, "style": True, "comment": True}  # whether any more of its ends may come
    at = html.find("<")
    while at >= 0:
        to = at + 1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) if closed["comment"] else -1
            closed["comment"] = end >= 0
            to = end + 3 if end >= 0 else at + 4
            drop.append((at, to))
        elif m := _TAG.match(html, at):
            to = html.find(">", at) + 1
            if html[to - 2] != "/":
                name = m[2].lower()
                held = last.setdefault(name, [])
                if m[1]:
                    del held[-1:]
                else:
                    if held and name not in NESTING:
                        lost.append(held.pop())
                    held.append((at, to, name))
        else:
            for name, (begin, end_tag) in _RAW.items():
                if begin.match(html, at):
                    end = end_tag.search(html, at) if closed[name] else None
                    closed[name] = end is not None
                    to = end.start() + 1 if end else at + 1
        at = html.find("<", to)
    lost = [x for x in [*lost, *(x for held in last.values() for x in held)] if x[2] != "option"]  # an option's end tag may be left out
    for begin, end, name in lost:
        to = html.find("<", end) if name in LABELS else end
        drop.append((begin, to if to >= 0 else len(html)))
    out, at = [], 0
    for begin, end in sorted(drop):
        if begin > at:
            out.append(html[at:begin])
        at = max(at, end)
    return "".join([*out, html[at:]])


class Leaves(HTMLParser):
    """Collects the leaf blocks of a page, however it is broken."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Place] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where in open each tag is
        self.outer: list[int] = []  # where in open blocks are, and what may hold options
        self.blocks: list[Block] = []
        self.run: list[str] = []
        self.place: Place | None = None
        self.begun = False
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.blocks.append(Block(text, self.place, self.linked / max(1, sum(map(len, self.run)))))
        self.run, self.place, self.begun, self.linked = [], None, False, 0

    def leave(self, to: int) -> None:
        for element in self.open[to:]:
            self.silent -= element.tag in SILENT
            self.links -= element.tag == "a"
            self.places[element.tag].pop()
        while self.outer and self.outer[-1] >= to:
            self.outer.pop()
        del self.open[to:]

    def end_head(self, body: bool) -> None:
        """Ends a head without an end tag: a body does from anywhere in it, anything else only right in it."""
        if self.silent and self.places["head"] and (body or self.open[-1].tag == "head"):
            self.leave(self.places["head"][-1])

    def end_foreign(self) -> None:
        """Ends an open drawing or formula, in which an element of HTML cannot be."""
        if self.silent and not self.places["foreignobject"] and (at := [self.places[name][0] for name in FOREIGN if self.places[name]]):
            self.leave(min(at))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEADED:
            self.end_head(tag == "body")
        if tag in BREAKOUT:
            self.end_foreign()
        if tag == "br":
            self.run.append(" ")
        if tag in BLOCKS:
            if tag not in ("option", "select"):
                while self.silent and self.open and self.open[-1].tag in LABELS:  # no block can be in them
                    self.leave(len(self.open) - 1)
            self.flush()
            if self.outer and self.open[self.outer[-1]].tag in CLOSES.get(tag, set()) | {"p"}:
                self.leave(self.outer[-1])
        if tag in VOID:
            return
        names = dict(attrs)
        words = tuple(re.findall(r"[a-z]+", f"{names.get('class') or ''} {names.get('id') or ''} {names.get('role') or ''}".lower()))
        self.places[tag].append(len(self.open))
        if tag in BLOCKS or tag == "optgroup":
            self.outer.append(len(self.open))
        self.open.append(Place(self.open[-1] if self.open else None, tag, words, "data-main" in names))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in FOREIGN:
            self.end_head(False)
        elif not (self.silent and any(self.places[name] for name in FOREIGN)):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.places[tag]:
            self.leave(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.silent and data.strip():
            self.end_head(False)
        if self.silent:
            return
        if not self.begun and data.strip():
            self.begun, self.place = True, self.open[-1] if self.open else None
        self.run.append(data)
        self.linked += len(data) * (self.links > 0)


def leaves(html: str) -> list[Block]:
    parser = Leaves()
    parser.feed(ended(html))
    parser.close()
    parser.flush()
    return parser.blocks


def features(blocks: list[Block]) -> list[set[str]]:
    """The names of each block's features."""
    out = []
    for b in blocks:
        p = b.place or Place(None, "", (), False)
        size = _bucket(len(b.text), 20, 60, 150, 400)
        own = {f"in:{t}" for t in p.tags} | {f"name:{w}" for w in p.names}
        own |= {f"tag:{p.last or '-'}", f"long:{size}", f"linked:{_bucket(b.linked, 0.01, 0.3, 0.8)}"}
        own |= {f"inner:{p.inner or '-'}", f"outer:{p.outer or '-'}"}
        own |= {"outside"} if p.below is None else {f"below:{k}" for k in p.below} or {"directly"}
        own |= {f"above:{k}" for k in p.above}
        if b.text[-1] in ".!?…":
            own.add("ended")
        if "©" in b.text:
            own.add("rights")
        low = b.text.lower()
        own |= {f"hint:{w}:{size}" for w in HINTS if w in low}
        if not {"article", "main"} & p.tags:
            own.add("untagged")
        out.append(own)
    return out


class Field(NamedTuple):
    """Log weights: of each feature for the label main, of (label, next label), of the first label (none: an article may begin a page)."""

    weights: dict[str, float]
    steps: list[list[float]]
    start: list[float]

    def labels(self, rows: list[set[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        best, back = None, []
        for row in rows:
            gain = sum(self.weights.get(f, 0.0) for f in row)
            if best is None:
                best = [self.start[0], self.start[1] + gain]
                continue
            came = [0 if best[0] + self.steps[0][y] >= best[1] + self.steps[1][y] else 1 for y in (0, 1)]
            back.append(came)
            best = [best[came[0]] + self.steps[came[0]][0], best[came[1]] + self.steps[came[1]][1] + gain]
        if best is None:
            return []
        out = [int(best[1] > best[0])]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]


def train(pages: list[str] | None = None, rounds: int = 120, ridge: float = 1.0) -> Field:
    """A field from labelled pages: the penalised conditional likelihood, climbed by Adam on exact gradients."""
    data = []
    for html in pages if pages is not None else labelled_pages():
        blocks = leaves(html)
        if blocks:
            data.append((features(blocks), [int(any(m for _, _, m in b.path)) for b in blocks]))
    names = sorted({f for rows, _ in data for row in rows for f in row})
    at = {f: i for i, f in enumerate(names)}
    k, sizes = len(names), [len(y) for _, y in data]
    owner = np.concatenate([np.full(len(row), j) for j, row in enumerate(r for rows, _ in data for r in rows)])
    column = np.concatenate([[at[f] for f in row] for rows, _ in data for row in rows]).astype(np.int64)
    truth, starts = np.concatenate([y for _, y in data]), np.concatenate([[0], np.cumsum(sizes)])
    # pages side by side, padded: every step of the recursions handles all pages
    width, grid = max(sizes), np.full((len(data), max(sizes)), -1)
    for i, (a, n) in enumerate(zip(starts[:-1], sizes, strict=True)):
        grid[i, :n] = np.arange(a, a + n)
    real, last = grid >= 0, np.array(sizes) - 1
    theta, m, v = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)
    seen = np.zeros(k + 6)
    seen[:k] = np.bincount(column, truth[owner], k)
    for i in range(len(data)):
        y = truth[starts[i] : starts[i + 1]]
        seen[k + 4 + y[0]] += 1
        np.add.at(seen, k + 2 * y[:-1] + y[1:], 1)
    for t in range(1, rounds + 1):
        gain = np.bincount(owner, theta[column], len(truth))
        emit = np.zeros((len(data), width, 2))
        emit[..., 1][real] = gain[grid[real]]
        step = theta[k : k + 4].reshape(2, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = theta[k + 4 :] + emit[:, 0]
        for j in range(1, width):
            ahead[:, j] = np.logaddexp(ahead[:, j - 1, 0, None] + step[0], ahead[:, j - 1, 1, None] + step[1]) + emit[:, j]
        for j in range(width - 2, -1, -1):
            x = behind[:, j + 1] + emit[:, j + 1]
            behind[:, j] = np.where((j < last)[:, None], np.logaddexp(x[:, 0, None] + step[:, 0], x[:, 1, None] + step[:, 1]), 0)
        total = np.logaddexp(*ahead[np.arange(len(data)), last].T)
        p = np.exp(ahead + behind - total[:, None, None])
        expected = np.zeros(k + 6)
        main = np.zeros(len(truth))
        main[grid[real]] = p[..., 1][real]
        expected[:k] = np.bincount(column, main[owner], k)
        pair = ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected[k : k + 4] = np.exp(pair)[real[:, 1:]].sum(axis=0).ravel()
        expected[k + 4 :] = p[:, 0].sum(axis=0)
        slope = seen - expected - ridge * theta
        slope[k + 4 :] = 0  # where a page begins tells nothing
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Field(dict(zip(names, map(float, theta[:k]), strict=True)), theta[k : k + 4].reshape(2, 2).tolist(), theta[k + 4 :].tolist())


@functools.cache
def fitted() -> Field:
    """The field of the labelled pages, trained once a process."""
    return train()


def main_blocks(html: str, field: Field) -> list[str]:
    blocks = leaves(html)
    return [b.text for b, y in zip(blocks, field.labels(features(blocks)), strict=True) if y]


def extract(spark: SparkSession, html: Column, field: Field | None = None) -> Column:
    """The main text of a column of pages: the main blocks in page order, joined by newlines.

    Defined results: a null or empty page and one without main blocks give an empty text; a page that
    breaks off gives the blocks until there. White space within a block is one space.
    """
    sent = spark.sparkContext.broadcast(tuple(field or fitted()))

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        own = Field(*sent.value)
        return pd.Series(["\n".join(main_blocks(p or "", own)) for p in pages], dtype=object)

    return text(F.coalesce(html.cast("string"), F.lit("")))
