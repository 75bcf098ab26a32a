"""Fuzzy search for short license notices (op 3).

A notice with up to k edits, cut into k + 1 pieces, keeps one piece unchanged.
The pieces of all notices are sought at once (Aho-Corasick); each one found
gives a window that could hold its notice, and there the regex library's
bounded-error matching verifies it, counts the edits and reports the span.

Texts are seen as words (runs of digits, letters and non-ASCII characters, A-Z
lower-cased) joined by a space. Beside the fuzzy notices, the places of BASE
phrases (whole words) are counted exactly.

Null and empty texts have no words, no places and empty labels. Repeated rows
and null doc_ids are scanned each. Windows are as long as a notice and its edits,
whatever the text's length; equal windows are verified once. Of overlapping spans
of one notice the one with the least edits is reported (then the first); spans of
different notices may overlap. An empty table gives no rows; other columns are
untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, raw

#: Phrases whose places are counted, and their labels (fixed values of the query's contract).
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices that are sought with edits, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
]
#: A notice may differ by one edit for so many of its characters.
CHARS_AN_EDIT = 10
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Searcher:
    """Finds notices with bounded edits; made once in each task."""

    def __init__(self, notices: list[tuple[str, str]]):
        import ahocorasick
        import regex

        self.notices = notices
        self.edits = [max(1, len(p) // CHARS_AN_EDIT) for p, _ in notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}") for (p, _), k in zip(notices, self.edits)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((p, _), k) in enumerate(zip(notices, self.edits)):
            cuts = [round(j * len(p) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(p[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for s, of in seeds.items():
            self.automaton.add_word(s, (len(s), of))
        self.automaton.make_automaton()
        self.verify = lru_cache(maxsize=4096)(self._verify)

    def _verify(self, notice: int, window: str) -> list[tuple[int, int, int]]:
        """The best match of a window, and the best ones of what stands before and behind it."""
        m = self.patterns[notice].search(window)
        if not m:
            return []
        a, b, least = m.start(), m.end(), len(self.notices[notice][0]) - self.edits[notice]
        before = self._verify(notice, window[:a]) if a >= least else []
        behind = [(b + x, b + y, e) for x, y, e in self._verify(notice, window[b:])] if len(window) - b >= least else []
        return [*before, (a, b, sum(m.fuzzy_counts)), *behind]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, stop, edits) of each notice that text has, positions in characters.

        Each seed's own window is searched, so a better notice close by hides none. Of
        spans of one notice that overlap, the one with the least edits stays, then the
        first, then the shortest.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (n, of) in self.automaton.iter(text):
            for notice, offset in of:
                k = self.edits[notice]
                start = end + 1 - n - offset - k
                windows.setdefault(notice, set()).add((max(0, start), start + len(self.notices[notice][0]) + 3 * k))
        found = []
        for notice, own in windows.items():
            spans = {(e, start + a, start + b) for start, stop in own for a, b, e in self.verify(notice, text[start:stop])}
            taken: list[tuple[int, int]] = []  # disjoint, in order
            for e, a, b in sorted(spans):
                i = bisect_left(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.append((notice, a, b, e))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words stand in text, which has a space before and behind each word."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def _word_at(text: bytes, places: list[int]) -> list[int]:
    """Number of the word that follows each place (sorted)."""
    out, last, n = [], 0, 0
    for p in places:
        n += text.count(b" ", last, p)
        last = p
        out.append(n)
    return out


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, start and stop (words), edits of each fuzzy notice. score: the
    best share of a notice's characters that agree; 1 where a base phrase stands.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,edits:int>>"
    longs, span = pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))
    types = [longs] * 5 + [pa.string(), pa.string(), pa.float64(), span]
    names = [x.split()[0] for x in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")]

    def one(doc: int | None, text: bytes, searcher: Searcher) -> tuple:
        words = text.translate(_FOLD).split()
        line = b" " + b" ".join(words) + b" "
        base, starts = set(), []
        for phrase, label in BASE:
            if at := _places(line, b" " + phrase.encode() + b" "):
                base.add(label)
                starts += _word_at(line, at)
        plain = line.decode("utf-8", "replace")
        found = searcher.find(plain) if words else []
        spans = [{"label": notices[n][1], "start": plain.count(" ", 0, a + 1) - 1 if a else 0, "stop": plain.count(" ", 0, b), "edits": e} for n, a, b, e in found]
        best = max([1 - e / len(notices[n][0]) for n, _, _, e in found], default=0.0)
        labels = base | {s["label"] for s in spans}
        return doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices)
        for b in (x for y in batches for x in blocks([y])):
            rows = [one(d, t, searcher) for d, t in zip(b.column("doc_id").to_pylist(), raw(b.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
