"""Main text of HTML pages by a conditional random field over leaf blocks (op 11).

A page is read into its leaf blocks: stretches of text between block elements.
Each block has features of its ancestors (elements, words of their class, id and
role) and of its text (length, share of links, punctuation, tell-tale words); an
edge of the chain knows whether its two blocks have the same parent. A
linear-chain conditional random field over two labels (main text or not) is
trained on labelled pages by gradient ascent with forward-backward sums, and
pages are decoded by Viterbi. Without labelled pages of the user's own the field
is trained on invented ones (page_layouts).

Training uses at most MAX_TRAIN pages of at most MAX_BLOCKS blocks (bounds of
what reaches the driver); extraction reads every page whole, one page at a time.

Text inside a block has its character references decoded and its white space
turned into single spaces; a line break element is white space. Scripts, styles,
comments, templates, the head and text areas are never text. Null and empty
pages, and pages without blocks, give the empty text. Elements may be unclosed
or closed without being open. Repeated rows are extracted each, of equal scores
the label "not main" wins; tables may be empty, other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .page_layouts import labelled

#: Labelled pages and blocks of a page that are trained on at most; steps, step size and ridge of the training; how often a feature must occur in it; remembered attribute strings.
MAX_TRAIN, MAX_BLOCKS, STEPS, RATE, RIDGE, LEAST, MEMO = 600, 2000, 120, 0.2, 0.2, 3, 20_000

#: Elements that begin and end a block; those that are empty; those whose content is raw text; those whose text is never shown.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul svg math noscript object select button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head template svg math noscript select object".split())
#: Elements that an opening one ends, and the elements beyond which it does not reach.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_SCOPE = {"table", "td", "th", "button", "object", "caption"}
_IN_P = {"button", "label", "select", "option", "optgroup", "object", "svg", "math", "noscript", "template", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "legend"}

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--|[!?]))")
_QUOTE = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TELLS = frozenset("cookie cookies subscribe newsletter sign log login share comment comments reply related advertisement sponsored promoted menu search privacy terms rights copyright reserved follow tags trending powered accept".split())


class Block:
    """A leaf block: its text, the features of where it stands, and its parent."""

    __slots__ = ("text", "place", "parent", "linked")

    def __init__(self, text: str, place: frozenset, parent: int, linked: float):
        self.text, self.place, self.parent, self.linked = text, place, parent, linked


class _Element:
    __slots__ = ("tag", "place", "number")

    def __init__(self, tag: str, place: frozenset, number: int):
        self.tag, self.place, self.number = tag, place, number


def _attribute_words(attributes: str, memo: dict[str, tuple]) -> tuple:
    known = memo.get(attributes)
    if known is None:
        found = " ".join("".join(m) for m in _NAMES.findall(attributes))
        known = tuple(dict.fromkeys("cls:" + w.lower() for w in _WORD.findall(found))) if found else ()
        if len(memo) > MEMO:
            memo.clear()
        memo[attributes] = known
    return known


def leaf_blocks(page: str, memo: dict[str, tuple] | None = None, known=None) -> list[Block]:
    """The blocks of a page in order. known: the features to keep (all if None), which bounds what deep pages hold."""
    memo = {} if memo is None else memo
    out: list[Block] = []
    stack = [_Element("", frozenset(), 0)]
    open_tags: Counter = Counter()
    pieces: list[str] = []
    numbers, anchors, hidden, linked, size, at, end = 0, 0, 0, 0, 0, 0, len(page)
    no_more: set[str] = set()  # quotes, raw elements' ends and comments' ends that do not come again

    def flush():
        nonlocal linked, size
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.place | {"leaf:" + top.tag}, stack[-2].number if len(stack) > 1 else 0, linked / max(1, size)))
            pieces.clear()
            linked = size = 0

    def say(raw: str):
        nonlocal linked, size
        if hidden or not raw:
            return
        pieces.append(html.unescape(raw) if "&" in raw else raw)
        n = len(raw) - raw.count(" ")
        size += n
        if anchors:
            linked += n

    def drop(i: int):
        nonlocal hidden
        for e in stack[i:]:
            open_tags[e.tag] -= 1
            hidden -= e.tag in HIDDEN
        del stack[i:]

    def close(names, scope):
        if any(open_tags[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    drop(i)
                    return
                if stack[i].tag in scope:
                    return

    while at < end:
        m = _OPEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[3]:  # a comment, a declaration or an instruction
            mark = "-->" if m[3] == "!--" else ">"
            stop = -1 if mark in no_more else page.find(mark, at)
            if stop < 0:
                no_more.add(mark)
                at = end if mark == "-->" else at
                continue
            at = stop + len(mark)
            continue
        start = at
        while True:  # to the end of the tag, over quoted values
            q = _QUOTE.search(page, at)
            if not q:
                at = stop = end
                break
            at = q.end()
            if q[0] == ">":
                stop = q.start()
                break
            if q[0] in no_more or (close_at := page.find(q[0], at)) < 0:
                no_more.add(q[0])
                continue
            at = close_at + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                anchors = 0
            elif tag == "p" and not open_tags["p"]:
                flush()
            elif tag in BLOCK:
                flush()
                anchors = 0
                close({tag}, ())
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            anchors = 1
        if tag in RAW:
            if f"</{tag}" in no_more:
                at = end
            else:
                found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = found.start() if found else end
                if not found:
                    no_more.add(f"</{tag}")
            if tag in BLOCK:
                flush()
            continue
        if tag not in BLOCK:
            continue
        flush()
        anchors = 0
        if tag not in _IN_P:
            close({"p"}, _SCOPE)
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in VOID:
            continue
        numbers += 1
        own = {"in:" + tag, *_attribute_words(page[start:stop], memo)} if stop > start else {"in:" + tag}
        place = stack[-1].place
        if open_tags["article"] and tag in ("article", "header", "footer"):  # a comment, or the article's own head
            own.discard("in:" + tag)
            own.add(f"in:{tag} in article")
        if known is not None:
            own = {f for f in own if f in known}
        stack.append(_Element(tag, place | own if not own <= place else place, numbers))
        open_tags[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block."""
    out, heading = [], False
    for i, b in enumerate(page):
        words = b.text.split()
        n = len(words)
        heading = heading or "leaf:h1" in b.place
        f = [
            *b.place,
            f"words:{min(8, n.bit_length())}",
            f"linked:{0 if not b.linked else 1 + int(b.linked * 2.99)}",
            "ends" if b.text[-1] in ".!?…:;\"'»”" else "open",
            f"commas:{min(2, b.text.count(','))}",
            "titled" if heading else "untitled",
            f"from_end:{min(3, len(page) - 1 - i)}",
        ]
        if n < 30:
            f += ["says:" + w for w in {x.strip(".,:;!?()").lower() for x in words} & _TELLS]
            if "©" in b.text:
                f.append("says:©")
        out.append(f)
    return out


class Field:
    """Weights of the features for "main", of a block's label by its predecessor's (twice: other parent, same parent), and of the first label."""

    def __init__(self, weights: dict[str, float], edges: np.ndarray, first: np.ndarray):
        self.weights, self.first = weights, first.tolist()
        self.edges = edges.tolist()
        self.known = frozenset(f for f in weights if f.startswith(("in:", "cls:")))

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: which blocks are main text."""
        if not page:
            return []
        get, back = self.weights.get, []
        own = [sum(get(f, 0.0) for f in fs) for fs in features(page)]
        no, yes = self.first[0], self.first[1] + own[0]
        for i in range(1, len(page)):
            e = self.edges[page[i].parent == page[i - 1].parent]
            from_no, from_yes = (no + e[0][0], yes + e[1][0]), (no + e[0][1], yes + e[1][1])
            back.append((from_no[1] > from_no[0], from_yes[1] > from_yes[0]))
            no, yes = max(from_no), max(from_yes) + own[i]
        label = yes > no
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None, memo: dict[str, tuple] | None = None) -> str:
        found = leaf_blocks(page, memo, self.known) if page else []
        return "\n\n".join(b.text for b, main in zip(found, self.decode(found)) if main)


def train(pages: list[tuple[list[list[str]], list[bool], list[bool]]]) -> Field:
    """Fits the field. pages: features of the blocks, whether each has its predecessor's parent, labels; of at least one page with blocks."""
    count = Counter(f for fs, _, _ in pages for block in fs for f in block)
    number = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= LEAST))}
    n, longest = len(pages), max(len(y) for _, _, y in pages)
    real, label, same = np.zeros((n, longest), dtype=bool), np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=np.int64)
    at, which = [], []
    for p, (fs, parents, y) in enumerate(pages):
        real[p, : len(y)], label[p, : len(y)], same[p, : len(y)] = True, y, parents
        for i, block in enumerate(fs):
            own = [number[f] for f in block if f in number]
            at += [p * longest + i] * len(own)
            which += own
    at, which = np.array(at), np.array(which)
    rows, edge_real = np.arange(n), real[:, 1:]
    # what the labels show: counts of features at main blocks, of edges, of first labels
    seen = np.bincount(which, weights=label.ravel()[at].astype(float), minlength=len(number))
    seen_edges = np.zeros((2, 2, 2))
    np.add.at(seen_edges, (same[:, 1:][edge_real], label[:, :-1][edge_real], label[:, 1:][edge_real]), 1)
    seen_first = np.bincount(label[:, 0][real[:, 0]], minlength=2).astype(float)
    w = [np.zeros(len(number)), np.zeros((2, 2, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1):
        own = np.zeros((n, longest, 2))
        own[:, :, 1] = np.bincount(at, weights=w[0][which], minlength=n * longest).reshape(n, longest)
        pair = w[1][same]  # (page, block, before, now)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = w[2] + own[:, 0]
        for i in range(1, longest):
            alpha[i] = np.where(real[:, i, None], np.logaddexp(alpha[i - 1][:, 0, None] + pair[:, i, 0], alpha[i - 1][:, 1, None] + pair[:, i, 1]) + own[:, i], alpha[i - 1])
        for i in range(longest - 2, -1, -1):
            to = pair[:, i + 1] + (own[:, i + 1] + beta[i + 1])[:, None, :]
            beta[i] = np.where(real[:, i + 1, None], np.logaddexp(to[:, :, 0], to[:, :, 1]), 0)
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p_main = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total).T * real
        between = alpha[:-1].transpose(1, 0, 2)[:, :, :, None] + pair[:, 1:] + (own[:, 1:] + beta[1:].transpose(1, 0, 2))[:, :, None, :]
        p_pair = np.exp(between - total[:, None, None, None]) * edge_real[:, :, None, None]
        edges = np.stack([p_pair[same[:, 1:] == k].sum(axis=0) for k in range(2)])
        first = np.array([(1 - p_main[rows, 0])[real[:, 0]].sum(), p_main[rows, 0].sum()])
        gradient = [seen - np.bincount(which, weights=p_main.ravel()[at], minlength=len(number)) - RIDGE * w[0], seen_edges - edges - RIDGE * w[1], seen_first - first - RIDGE * w[2]]
        for x, g, a, b in zip(w, gradient, mean, square):  # Adam
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(w[0][i]) for f, i in number.items()}, w[1], w[2])


def example(page: str | None, text: str | None, memo: dict[str, tuple] | None = None) -> tuple[list[list[str]], list[bool], list[bool]]:
    """A labelled page as train() wants it: a block is main text if it is one of the text's blocks."""
    found = leaf_blocks(page, memo) if page else []
    gold = {" ".join(x.split()) for x in (text or "").split("\n\n")}
    return features(found), [False] + [a.parent == b.parent for a, b in zip(found, found[1:])] if found else [], [b.text in gold for b in found]


def fit(pages: DataFrame | None = None, most: int = MAX_TRAIN) -> Field:
    """The field trained on labelled pages (html, text), at most `most` of at most MAX_BLOCKS blocks, those of the least hashes; on invented ones if there are none."""
    examples = []
    if pages is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for y in batches for x in blocks([y], "html")):
                rows = [example(h, t) for h, t in zip(b.column("html").to_pylist(), b.column("text").to_pylist())]
                rows = [r for r in rows if 0 < len(r[2]) <= MAX_BLOCKS]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.string()))), pa.array([r[1] for r in rows], pa.list_(pa.bool_())), pa.array([r[2] for r in rows], pa.list_(pa.bool_()))], names=["blocks", "same", "main"])

        own = pages.select(F.col("html").cast("string").alias("html"), F.col("text").cast("string").alias("text")).where("html IS NOT NULL AND text IS NOT NULL")
        own = own.orderBy(F.xxhash64("html", "text"), "html", "text").limit(most)
        examples = [(r.blocks, r.same, r.main) for r in own.mapInArrow(run, "blocks array<array<string>>, same array<boolean>, main array<boolean>").toLocalIterator()]
    if not examples:
        memo: dict[str, tuple] = {}
        examples = [example(h, t, memo) for h, t in labelled(most)]
    return train(examples)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in (x for y in batches for x in blocks([y], "html")):
            texts = [shared.value.main_text(h, memo) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
