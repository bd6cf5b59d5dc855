"""Operator 2: the main text of web pages by a conditional random field over DOM leaf blocks.

A page is read into blocks: runs of text between tags that are not inline, each with the open
elements around it. A block's features are the tags of its ancestors, the words of their classes,
ids and roles, and properties of its text (length, share of links, punctuation). A linear chain
with two labels, article or not, is trained by gradient steps on labelled pages and decoded by
Viterbi. The labelled pages are made here: layouts of many kinds from invented words, of which
every part is known.

Scripts, styles, other raw elements and comments in the markup are no blocks. Character references
are decoded, white space inside a block becomes one space, blocks are joined by a line feed. A
null, empty or blockless page has an empty text. Reading takes time in proportion to the length of a
page, however deep or untidy it is. Pages that repeat are read each; extra columns
are ignored. Unclosed tags, comments and quotes end at the end of the page at the latest.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import slices, table

TRAIN_PAGES = 600
RARE = 6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
    "samp small span strike strong sub sup time tt u var wbr object param math mi mn mo ms mtext mrow "
    "mfrac msqrt mroot msup msub msubsup mmultiscripts mprescripts munder mover munderover mtable mtr "
    "mtd mspace mstyle mpadded mphantom menclose merror semantics".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Nothing but its closing tag ends such an element.
_RAW = frozenset("script style iframe title textarea".split())
# Such an element hides what it holds, at most up to the end of its parent.
_HIDING = frozenset("noscript template svg select annotation annotation-xml".split())
# These begin outside of an open svg or select, which was not closed then.
_OUTSIDE = frozenset(
    "article aside blockquote body dd div dl dt footer h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre "
    "section table ul".split()
)
# An opening tag ends these open elements, up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


class Block:
    __slots__ = ("path", "parts", "links")

    def __init__(self, path: tuple):
        self.path, self.parts, self.links = path, [], 0


def _words_of(tag: str, attributes: str) -> tuple[str, ...]:
    """Feature words of an element: its tag, and the words of its class, id and role."""
    found = ["t:" + tag]
    if attributes.strip(" /"):
        for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            name = name.lower()
            if name in ("class", "id", "role"):
                found += ["c:" + w for w in _NAME.findall(value)]
            elif hidden or name == "aria-hidden" and value == "true" or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
            ):
                found.append("hidden")
    return tuple(found)


class _Open:
    """The open elements: tag, words of the element, and words of it and all its ancestors.

    Elements that add no word share the set of their parent, and the places of each tag are kept,
    so that a page costs time in proportion to its length however deep it is.
    """

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack: list[tuple[str, tuple, frozenset]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, words: tuple[str, ...] = ()) -> None:
        if self.known is not None:
            words = tuple(w for w in words if w in self.known)
        above = self.stack[-1][2] if self.stack else frozenset()
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, words, above if above.issuperset(words) else above.union(words)))

    def cut(self, depth: int) -> None:
        """Close all from ``depth`` on."""
        for tag, _, _ in self.stack[depth:]:
            self.places[tag].pop()
        del self.stack[depth:]

    def last(self, *tags: str) -> int:
        """The place of the innermost element of these tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def path(self) -> tuple[frozenset, tuple, bool]:
        """(words of all ancestors, words of the nearest, whether the place is deep)."""
        _, near, words = self.stack[-1] if self.stack else ("", (), frozenset())
        return words, near, len(self.stack) > 6


def blocks_of(page: str, known: frozenset[str] | None = None) -> list[tuple[tuple, str, float]]:
    """(ancestors, text, share of its letters in links) of every block in page order.

    ``known`` are the words of elements that matter; without it all are kept.
    """
    opened = _Open(known)
    stack = opened.stack
    found: list[Block] = []
    block: Block | None = None
    path: tuple | None = None
    in_link = 0
    hiding: int | None = None  # place of the outermost hiding element in the stack
    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.match(page, at)
        at = match.end()
        tag = match.group(2) or match.group(5)
        if tag is None:
            if hiding is not None:
                continue
            text = match.group()
            if text[:2] in ("<!", "<?"):
                if not text.startswith("<![CDATA["):
                    continue
                text = text[9:].removesuffix("]]>")
            if block is None:
                if not text.strip():
                    continue
                if path is None:
                    path = opened.path()
                block = Block(path)
                found.append(block)
            text = html.unescape(text)
            block.parts.append(text)
            if in_link:
                block.links += len(text)
            continue
        tag = tag.lower()
        closing = match.group(1) or match.group(4)
        if tag in _RAW and not closing:
            if not (match.group(3) or match.group(6) or "").endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if hiding is not None:
            if closing:
                depth = opened.last(tag)
                if depth >= 0:
                    if depth < hiding:
                        block, path, in_link = None, None, 0
                    opened.cut(depth)
                if len(stack) <= hiding:
                    hiding = None
                continue
            if not (
                tag in _OUTSIDE and stack[hiding][0] in ("svg", "select")
                and opened.last("foreignobject") < hiding
            ):
                alone = tag in _VOID or tag in _INLINE or (match.group(3) or match.group(6) or "").endswith("/")
                if not alone:
                    opened.push(tag)
                continue
            opened.cut(hiding)
            hiding = None
        if tag in _HIDING and not closing:
            if not (match.group(3) or match.group(6) or "").endswith("/"):
                hiding = len(stack)
                opened.push(tag)
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br" and block is not None:
                block.parts.append(" ")
            continue
        block, path, in_link = None, None, 0
        if closing:
            depth = opened.last(tag)
            if depth >= 0:
                opened.cut(depth)
            continue
        if stack and stack[-1][0] == "p":
            opened.cut(len(stack) - 1)
        if tag in _ENDS:
            ended, bound = _ENDS[tag]
            depth = opened.last(*ended)
            if depth > opened.last(*bound):
                opened.cut(depth)
        if tag not in _VOID:
            attributes = match.group(3) if match.group(2) else match.group(6)
            opened.push(tag, _words_of(tag, attributes or ""))
    result = []
    for block in found:
        raw = "".join(block.parts)
        text = " ".join(raw.split())
        if text:
            result.append((block.path, text, min(1.0, block.links / max(1, len(raw)))))
    return result


@functools.lru_cache(maxsize=50_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    words, near, deep = path
    found = words | {"own " + w for w in near} | {"deep" if deep else "flat"}
    return tuple(sorted(found))


def _text_features(text: str, links: float, place: int, n: int) -> list[str]:
    size = len(text)
    marks = sum(map(text.count, ".,;:!?"))
    found = [
        f"size {min(6, size.bit_length() // 2)}", f"link {int(links * 4)}",
        f"marks {min(3, marks)}", "end" if text[-1] in ".!?:;\"'”…)" else "no end",
    ]
    if "©" in text or "»" in text:
        found.append("sign")
    if place == 0 or place == n - 1:
        found.append("edge")
    return found


class Extractor:
    """Weights of features for "article" against "not", and transition scores."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.known = frozenset(name.removeprefix("own ") for name in weights)
        self.paths: dict[tuple, float] = {}

    def _score(self, path: tuple) -> float:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            found = self.paths[path] = sum(self.weights.get(f, 0.0) for f in _path_features(path))
        return found

    def keep(self, blocks: list[tuple[tuple, str, float]]) -> list[bool]:
        """The best labels of a page's blocks, by Viterbi."""
        (same0, to1), (to0, same1) = self.moves
        get, n = self.weights.get, len(blocks)
        low = high = 0.0
        back = []
        for place, (path, text, links) in enumerate(blocks):
            own = self._score(path) + sum(get(f, 0.0) for f in _text_features(text, links, place, n))
            if place:
                from0, from1 = low + same0 >= high + to0, low + to1 > high + same1
                low, high = (
                    low + same0 if from0 else high + to0, low + to1 if from1 else high + same1
                )
                back.append((0 if from0 else 1, 0 if from1 else 1))
            high += own
        label = 1 if high >= low else 0
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [x == 1 for x in reversed(labels)][:n]

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "", self.known)
        if not blocks:
            return ""
        return "\n".join(b[1] for b, kept in zip(blocks, self.keep(blocks)) if kept)


# -- labelled pages ----------------------------------------------------------------------------

_SIDE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs"],
    "header": ["header", "masthead", "banner", "topbar", "branding", "logo", "top"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "credits"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "tags", "rail", "teaser",
              "more", "promo", "trending", "author", "bio", "meta", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner", "adsense",
           "promo", "promotion"],
    "notice": ["notice", "cookie", "cookies", "consent", "alert", "modal", "popup", "gdpr", "overlay",
               "warning", "paywall", "subscribe", "newsletter", "signup"],
    "comments": ["comments", "comment", "respond", "replies", "reply", "disqus", "discussion", "responses",
                 "feedback"],
}
_MAIN = ["content", "article", "post", "entry", "story", "main", "body", "text", "page", "blog", "news"]


class _Maker:
    """Makes one page; pieces are (markup, labels of its blocks)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        letters = "etaoinshrdlucmfwypvbgk"
        return "".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.phrase(2, 25).capitalize() + self.r.choice([".", ".", ".", "!", "?", ","])

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 6, 12])))
        if self.r.random() < 0.2:
            text = f'{text} <a href="/{self.word()}">{self.phrase(1, 4)}</a> {self.sentence()}'
        if self.r.random() < 0.1:
            text = f"<b>{text}<br>" if self.r.random() < 0.5 else f"<em>{text}</em>"
        return text

    def names(self, kind: list[str]) -> str:
        name = self.r.choice(kind)
        if self.r.random() < 0.4:
            name += self.r.choice(["-", "_", " "]) + self.r.choice(
                ["box", "wrap", "area", "block", "inner", "list", "item", "section"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def short(self) -> str:
        return self.r.choice([self.phrase(1, 4), self.phrase(1, 8), self.sentence()])

    def wrapped(self, tag: str, attributes: str, inside: list[tuple[str, list[int]]]):
        markup, labels = "", []
        for text, own in inside:
            markup += text
            labels += own
        return f"<{tag}{attributes}>{markup}</{tag}>", labels

    def listing(self):
        items = [f'<li><a href="/{self.word()}">{self.phrase(1, 4)}</a></li>' for _ in range(self.r.randint(2, 9))]
        return f"<ul>{''.join(items)}</ul>", [0] * len(items)

    def boilerplate(self, kind: str):
        tag = kind if kind in ("nav", "header", "footer", "aside") and self.r.random() < 0.6 else "div"
        if kind == "comments" and self.r.random() < 0.3:
            tag = "section"
        names = self.names(_SIDE[kind]) if tag in ("div", "section") or self.r.random() < 0.4 else ""
        if kind == "notice" and self.r.random() < 0.3:
            names += ' role="dialog"'
        inside = []
        for _ in range(self.r.randint(1, 4)):
            pick = self.r.random()
            if kind == "comments":
                text = " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))
                piece = self.wrapped(self.r.choice(["div", "li", "article"]), self.names(["comment"]),
                                     [(f"<p>{text}</p>", [0])])
                inside.append(piece)
            elif kind in ("nav", "aside") and pick < 0.6:
                inside.append(self.listing())
            elif pick < 0.75:
                inside.append((f"<p>{self.short()}</p>", [0]))
            elif pick < 0.85:
                inside.append((f"<h3>{self.phrase(1, 4)}</h3>", [0]))
            elif pick < 0.93:
                inside.append((f"<div>{self.prose()}</div>", [0]))
            else:
                inside.append(("&copy; " + self.phrase(1, 4) if not inside else f"<p>&copy; {self.phrase(1, 4)}</p>",
                               [0]))
        return self.wrapped(tag, names, inside)

    def form(self):
        inside = [(f"<p>{self.short()}</p>", [0]), (f"<label>{self.word()}</label><input name=q>", [0]),
                  (f"<button>{self.word()}</button>", [0])]
        return self.wrapped("form", "", inside[self.r.randint(0, 1):])

    def hidden(self):
        how = self.r.choice([" hidden", ' style="display: none"', ' aria-hidden="true"'])
        return self.wrapped("div", how, [(f"<p>{self.prose()}</p>", [0])])

    def article(self):
        inside = []
        if self.r.random() < 0.8:
            title = f"<h1>{self.short()}</h1>", [1]
            inside.append(self.wrapped("header", "", [title]) if self.r.random() < 0.1 else title)
        for _ in range(self.r.randint(1, 14)):
            pick = self.r.random()
            close = "</p>" if self.r.random() < 0.85 else ""
            if pick < 0.72:
                inside.append((f"<p>{self.r.choice([self.prose(), self.prose(), self.short()])}{close}", [1]))
            elif pick < 0.80:
                inside.append((f"<h2>{self.short()}</h2>", [1]))
            elif pick < 0.85:
                items = [f"<li>{self.short()}</li>" for _ in range(self.r.randint(2, 5))]
                inside.append((f"<ul>{''.join(items)}</ul>", [1] * len(items)))
            elif pick < 0.89:
                inside.append((f"<blockquote><p>{self.prose()}</p></blockquote>", [1]))
            elif pick < 0.92:
                inside.append((f"<pre>{self.phrase(3, 20)}</pre>", [1]))
            elif pick < 0.94:
                inside.append((f"<table><tr><td>{self.short()}</td><td>{self.short()}</td></tr></table>", [1, 1]))
            else:
                inside.append((f"<div>{self.prose()}</div>", [1]))
        for kind in ("ad", "aside", "notice", "nav", "comments"):
            if self.r.random() < 0.12:
                place = len(inside) if kind == "comments" else self.r.randint(1, len(inside))
                inside.insert(place, self.boilerplate(kind))
        kind = self.r.random()
        if kind < 0.08:
            return "".join(m for m, _ in inside), [x for _, labels in inside for x in labels]
        if kind < 0.45:
            piece = self.wrapped("article", self.names(_MAIN) if self.r.random() < 0.3 else "", inside)
        elif kind < 0.6:
            piece = self.wrapped("main", "", inside)
        else:
            piece = self.wrapped("div", self.names(_MAIN), inside)
        if self.r.random() < 0.3:
            piece = self.wrapped(self.r.choice(["main", "div", "section"]), self.names(_MAIN), [piece])
        return piece

    def page(self) -> tuple[str, list[int]]:
        pieces = []
        for kind in ("header", "nav", "notice", "ad", "aside"):
            if self.r.random() < 0.5:
                pieces.append(self.boilerplate(kind))
        if self.r.random() < 0.15:
            pieces.append(self.hidden())
        self.r.shuffle(pieces)
        pieces.append(self.article())
        for kind in ("ad", "aside", "comments", "notice", "nav", "footer"):
            if self.r.random() < 0.4:
                pieces.append(self.boilerplate(kind))
        if self.r.random() < 0.25:
            pieces.append(self.form())
        if self.r.random() < 0.2:
            pieces = [self.wrapped("div", self.names(["wrapper", "container", "site", "layout"]), pieces)]
        markup, labels = self.wrapped("body", "", pieces)
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head>{markup}</html>", labels


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 2) -> list[tuple[str, list[int]]]:
    """(page, label of each block) of ``n`` made pages."""
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]


def train(pages: list[tuple[str, list[int]]], rounds: int = 90, step: float = 0.2) -> Extractor:
    """Maximum likelihood by gradient steps, all pages side by side."""
    numbers: dict[str, int] = {}
    rows = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError("A labelled page has other blocks than labels")
        rows.append([
            [numbers.setdefault(f, len(numbers))
             for f in (*_path_features(path), *_text_features(text, links, i, len(blocks)))]
            for i, (path, text, links) in enumerate(blocks)
        ])
    n, longest = len(rows), max(map(len, rows))
    # What few pages have is chance and gets no weight.
    spread = np.bincount([f for row in rows for f in set().union(*row)], minlength=len(numbers))
    rare = spread < RARE
    flat = np.concatenate([np.array(f) for row in rows for f in row])
    sizes = np.array([len(f) for row in rows for f in row])
    firsts = np.cumsum(sizes) - sizes
    page_of = np.repeat(np.arange(n), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) for r in rows])
    truth = np.zeros((n, longest), np.int64)
    truth[page_of, place] = np.concatenate([np.array(labels) for _, labels in pages])
    real = np.zeros((n, longest), bool)
    real[page_of, place] = True
    weights, moves = np.zeros(len(numbers)), np.zeros((2, 2))
    squares, move_squares = np.full(len(numbers), 1e-8), np.full((2, 2), 1e-8)
    pairs = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    for _ in range(rounds):
        score = np.zeros((n, longest))
        score[page_of, place] = np.add.reduceat(weights[flat], firsts)
        emission = np.ones((n, longest, 2))
        emission[..., 1] = np.exp(np.clip(score, -30, 30))
        emission /= emission.sum(axis=2, keepdims=True)
        move = np.exp(moves)
        alpha, beta = np.empty_like(emission), np.ones_like(emission)
        alpha[:, 0] = emission[:, 0]
        for t in range(1, longest):
            ahead = (alpha[:, t - 1] @ move) * emission[:, t]
            ahead /= ahead.sum(axis=1, keepdims=True)
            alpha[:, t] = np.where(real[:, t, None], ahead, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind = (beta[:, t + 1] * emission[:, t + 1]) @ move.T
            behind /= behind.sum(axis=1, keepdims=True)
            beta[:, t] = np.where(real[:, t + 1, None], behind, beta[:, t + 1])
        posterior = alpha * beta
        posterior /= posterior.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * move * (emission * beta)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        slope = (pair[pairs].sum(axis=0) - seen) / n + 0.001 * moves
        move_squares += slope**2
        moves -= step * slope / np.sqrt(move_squares)
        wrong = (posterior[..., 1] - truth)[page_of, place]
        slope = np.bincount(flat, np.repeat(wrong, sizes), len(weights)) / n + 0.0005 * weights
        squares += slope**2
        weights -= step * slope / np.sqrt(squares)
        weights[rare] = 0
    return Extractor({f: float(weights[i]) for f, i in numbers.items()}, moves.tolist())


@functools.cache
def default_extractor() -> Extractor:
    """Trained on the made pages, once per process."""
    return train(labelled_pages())


def extract_text(rows: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = extractor or default_extractor()
    plain = Extractor(model.weights, model.moves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [plain.text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint"
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
