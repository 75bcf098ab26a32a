"""Patterns with their word bound tested first match what they match as written."""

import random
import re

import pytest

from tremolo.functions.decision import COUNTED
from tremolo.functions.text import GOALS, anchored

PATTERNS = [*COUNTED.values(), *(p for _, p in GOALS), "|".join(p for _, p in GOALS)]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_matches(pattern):
    rng = random.Random(1)
    words = re.findall(r"[a-z]+", re.sub(r"\\[a-z]", " ", pattern)) + ["x", "If", "THEN", "éif", "an"]
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "", ",", "\n", "_", "é"]) for _ in range(rng.randint(1, 14)))
        found = [[m.span() for m in re.finditer(p, text, re.I | re.S | re.A)] for p in (pattern, anchored(pattern))]
        assert found[0] == found[1]


def test_what_cannot_be_anchored():
    for pattern in ("a|\\bb", "\\b\\d"):
        with pytest.raises(ValueError):
            anchored(pattern)
