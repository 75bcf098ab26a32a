"""Matching blocks against the standard library's matcher, and the layout metric against fractions."""

import random
import re
from difflib import SequenceMatcher
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolo.catalog import QUERIES
from tremolo.functions import matching_blocks as M
from tremolo.functions import text as T
from tremolo.plans.bridge import turns, xform

SF = "/root/testdata/sf0.001"


def of_matcher(a, b, popular):
    return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=popular).get_matching_blocks()][:-1]


def merged(found, n):
    """Blocks of each pair, those that touch in both texts as one."""
    out = [[] for _ in range(n)]
    for q, i, j, k in zip(*(x.tolist() for x in found)):
        last = out[q][-1] if out[q] else None
        if last and (last[0] + last[2], last[1] + last[2]) == (i, j):
            out[q][-1] = (last[0], last[1], last[2] + k)
        else:
            out[q].append((i, j, k))
    return out


def random_pairs(n, seed):
    rng = random.Random(seed)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    out = []
    for _ in range(n):
        letters = rng.choice(["a", "ab", "aab", "abc ", "abcdefghij ", "äé漢 𝄞xyzzzz"])
        a = some(rng.randint(0, 60), letters)
        b = some(rng.randint(0, 60), letters) if rng.random() < 0.5 else a[: rng.randint(0, 30)] + some(rng.randint(0, 20), letters) + a[rng.randint(0, 30) :]
        if rng.random() < 0.3:  # beyond 200 characters, where the rule of popular ones begins
            a, b = a * rng.randint(1, 4), b * rng.randint(1, 9)
        out.append((a, b))
    return out


@pytest.mark.parametrize("popular", [True, False])
def test_blocks_are_those_of_the_matcher(popular):
    pairs = random_pairs(10_000, 7)
    for lo, hi in M.batches(pairs):
        for got, (a, b) in zip(merged(M.blocks(pairs[lo:hi], popular), hi - lo), pairs[lo:hi]):
            assert got == of_matcher(a, b, popular), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=30), st.text("ab c", max_size=30)), max_size=5))
def test_any_batch(pairs):
    for popular in (True, False):
        assert merged(M.blocks(pairs, popular), len(pairs)) == [of_matcher(a, b, popular) for a, b in pairs]


def test_numbers_that_do_not_fit_together(monkeypatch):
    # windows are numbered in two steps when owner, first and second would not fit one integer
    pairs = random_pairs(200, 3)
    want = [of_matcher(a, b, False) for a, b in pairs]
    windows = M._Factors.windows

    def two_steps(self, at, owner, k, t, whole):
        n, self_n = len(t), self.n
        if whole:
            return windows(self, at, owner, k, t, whole)
        import numpy as np

        self.level(int(t.max(initial=0)))
        row = (t * self_n)[owner] + at
        return owner * len(row) + np.unique(self.flat[row] * self_n + self.flat[row + (k - (1 << t))[owner]], return_inverse=True)[1] if n else windows(self, at, owner, k, t, whole)

    monkeypatch.setattr(M._Factors, "windows", two_steps)
    assert merged(M.blocks(pairs, False), len(pairs)) == want


def measures(o, c):
    low = (o.lower(), c.lower())
    edits, unchanged = 0, True
    for tag, i, j, k, m in SequenceMatcher(None, o, c, autojunk=False).get_opcodes():
        if tag != "equal":
            edits += max(j - i, m - k)
            unchanged = unchanged and not any(x.isalpha() or x.isdigit() for x in o[i:j] + c[k:m])
    return SequenceMatcher(None, *low).ratio(), edits, unchanged


def test_measures():
    pairs = [p for p in random_pairs(1000, 9) if p[0] != p[1]] + [("", "x"), ("x", ""), ("a, b", "a - b"), ("İx", "ix")]
    got = list(zip(M.ratios(pairs).tolist(), *(x.tolist() for x in M.edits(pairs))))
    assert got == [measures(*p) for p in pairs]


def test_queries(spark):
    pairs = {(r.conv_id, r.turn): (r.o or "", r.c or "") for r in turns(spark, SF).collect()}
    want = {k: measures(*p) for k, p in pairs.items()}
    for r in QUERIES["txt19_difflib"](spark, SF).collect():
        ratio, edits, _ = want[r.conv_id, r.turn]
        n = len(pairs[r.conv_id, r.turn][0])
        assert (r.sim, r.tcr) == pytest.approx((ratio, 1 - ratio), abs=6e-5) and r.cer == pytest.approx(edits / n if n else 0, abs=6e-5)
    blank = lambda p: not p[0].strip() or not p[1].strip()
    for r in QUERIES["sim04_text"](spark, SF).collect():
        o, c = pairs[r.conv_id, r.turn]
        assert r.sim == pytest.approx(0 if blank((o, c)) else SequenceMatcher(None, c.strip(" ").lower(), o.strip(" ").lower()).ratio(), abs=6e-5)
    for r in QUERIES["gat01_format_gate"](spark, SF).collect():
        if r.reason == "alphanumeric character changed":
            assert not want[r.conv_id, r.turn][2]
        elif r.passed:
            assert want[r.conv_id, r.turn][2]


def exact_layout(o, c):
    lines = [x for x in c.split("\n") if x.strip()]
    n = len(lines)
    depth = [len(x) - len(x.lstrip(" \t")) for x in lines]
    mark = sum(bool(re.match(r"^\s*(?:#{1,6}\s|[-*+]\s|\d+\.\s|>\s|\|)", x)) or x.strip(" ").startswith(("---", "===")) for x in lines)
    breaks = min(Fraction(1), Fraction(max(0, c.count("\n") - o.count("\n")), 20))
    mean = Fraction(sum(depth), n) if n else Fraction(0)
    spread = min(Fraction(1), sum((d - mean) ** 2 for d in depth) / n / 25) if n > 1 else Fraction(0)
    value = Fraction(4, 10) * breaks + Fraction(3, 10) * spread + (Fraction(3, 10) * Fraction(mark, n) if n else 0)
    return int(value * 10000 + Fraction(1, 2)) / 10000


def test_layout(spark):
    rng = random.Random(2)
    rows = [(r.o, r.c) for r in xform(spark, SF).collect()] + [("", ""), (None, None), ("a\nb", "c"), ("", "   x\n\ty\n- z\n\n---\n1. a"), ("", " " * 300_000 + "x\ny")]
    rows += [("", "\n".join(" " * rng.randint(0, 9) + rng.choice(["- a", "b", "# c", "===", ""]) for _ in range(rng.randint(1, 40)))) for _ in range(500)]
    df = spark.createDataFrame(rows, "o string, c string")
    for r in df.select("o", "c", T.layout("o", "c").alias("x")).collect():
        assert r.x == exact_layout(r.o or "", r.c or "")
