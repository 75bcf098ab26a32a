"""Deterministic perturbations of texts at five levels, as expressions seeded by hashes.

A text's random draws are hashes of (text, place, seed), so results do not
depend on partitions, tasks or retries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _t, let, words

#: Sentences that distract.
DISTRACTIONS = [
    "The weather today is partly cloudy.",
    "Many people enjoy listening to music while working.",
    "The capital of France is Paris.",
    "There are approximately 7 billion people on Earth.",
    "Dogs are often called man's best friend.",
    "The Eiffel Tower is located in France.",
    "Water boils at 100 degrees Celsius at sea level.",
    "The average human heart beats about 70 times per minute.",
    "Mount Everest is the tallest mountain in the world.",
    "Shakespeare wrote many famous plays and sonnets.",
]
MARKS = [",", ";", ".", "..."]
PUNCTUATION = r"[!-/:-@\[-`{-~]"
LEVELS = ["L1", "L2", "L3", "L4", "L5"]
#: Characters for each operation on punctuation.
PIECE = 50


def draw(text: Column, place, seed: int, n: int) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(text, F.lit(seed), place if isinstance(place, Column) else F.lit(place)), F.lit(n)).cast("int")


def whitespace(x, seed: int = 0) -> Column:
    text = F.trim(F.regexp_replace(_t(x), " {2,}", " "))
    return F.when(draw(text, "line", seed, 2) == 0, text).otherwise(F.concat(text, F.lit("\n")))


def _hash_int(value: np.ndarray, state: np.ndarray) -> np.ndarray:
    """What xxhash64 makes of one more integer after the columns hashed so far."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (state + p5 + np.uint64(4)) ^ (value.astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _edits(seed: int):
    """Of texts (hash and length): each piece's draws as one number, its place * 8 + its mark * 2 + whether a mark goes.

    A text is hashed once and not for each of its pieces.
    """

    @F.pandas_udf("array<smallint>")
    def edits(hashes: pd.Series, lengths: pd.Series) -> pd.Series:
        pieces = np.maximum(1, lengths.to_numpy() // PIECE)

        def some(lo: int, hi: int) -> list[np.ndarray]:
            n = pieces[lo:hi]
            ends = np.cumsum(n)
            h = np.repeat(hashes.to_numpy()[lo:hi].astype(np.int64).view(np.uint64), n)
            i = np.arange(ends[-1]) - np.repeat(ends - n, n)
            size = np.full(ends[-1], PIECE)
            size[ends - 1] = np.maximum(1, lengths.to_numpy()[lo:hi] - (n - 1) * PIECE)
            once = np.array([seed])
            seeded = _hash_int(once, h)
            pmod = lambda x, by: x.view(np.int64) % by
            at = pmod(_hash_int(once, _hash_int(i, h)), size) + 1
            out = at * 8 + pmod(_hash_int(i + 1000000, seeded), len(MARKS)) * 2 + (pmod(_hash_int(i + 2000000, seeded), 2) == 0)
            return np.split(out.astype(np.int16), ends[:-1])

        # about a million pieces at a time
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(pieces) >> 20)) + 1).tolist(), len(pieces)]
        return pd.Series([x for lo, hi in zip(cuts, cuts[1:]) if lo < hi for x in some(lo, hi)], dtype=object)

    return edits


def punctuation(x, seed: int = 0) -> Column:
    """One operation for each 50 characters: a mark is inserted, or half of the time an existing one goes."""
    text = _t(x)
    # the last piece has what is left; found by one pass, since a substring counts from the text's start
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{{PIECE}}}(?=.{{{PIECE}}})|.+"), F.lit(0))

    def edit(s: Column, draws: Column) -> Column:
        at, mark, gone = F.shiftright(draws.cast("int"), 3), F.get(F.array(*(F.lit(m) for m in MARKS)), F.shiftright(draws.cast("int"), 1).bitwiseAND(3)), draws.cast("int").bitwiseAND(1) == 1
        here, before, after = F.substring(s, at, F.lit(1)), F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s))
        return F.when(F.rlike(here, F.lit(PUNCTUATION)), F.when(gone, F.concat(before, after)).otherwise(s)).otherwise(F.concat(before, mark, here, after))

    edited = F.zip_with(pieces, _edits(seed)(F.xxhash64(text), F.length(text)), edit)
    return F.when(text == "", text).otherwise(F.array_join(edited, ""))


def word_order(x, seed: int = 0) -> Column:
    """Inner words of each clause by their hashes; first and last ones stay."""
    clauses = F.split(F.regexp_replace(_t(x), "([,;])", "\u0001$1\u0001"), "\u0001")

    def mixed(w: Column) -> Column:
        n = F.size(w)
        inner = F.transform(F.slice(w, 2, F.greatest(n - 2, F.lit(0))), lambda y, i: F.struct(F.xxhash64(y, i, F.lit(seed)).alias("h"), y.alias("y")))
        return F.array_join(F.when(n > 3, F.concat(F.slice(w, 1, 1), F.transform(F.array_sort(inner), lambda z: z["y"]), F.slice(w, -1, 1))).otherwise(w), " ")

    return F.array_join(F.transform(clauses, lambda s: F.when(s.isin(",", ";"), s).otherwise(let(words(s), mixed))), "")


def distraction(x, seed: int = 0) -> Column:
    text = _t(x)
    extra = F.get(F.array(*(F.lit(s) for s in DISTRACTIONS)), draw(text, "which", seed, len(DISTRACTIONS)))
    return F.when(draw(text, "side", seed, 2) == 0, F.concat_ws(" ", extra, text)).otherwise(F.concat_ws(" ", text, extra))


def combined(x, seed: int = 0) -> Column:
    """Punctuation, a distraction, and the first word's case turned."""

    def turn(w: Column) -> Column:
        first = F.get(w, F.lit(0))
        head = F.substring(first, 1, 1)
        turned = F.when(F.upper(head) == head, F.lower(first)).otherwise(F.concat(F.upper(head), F.lower(F.substring(first, F.lit(2), F.length(first)))))
        return F.array_join(F.concat(F.array(turned), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))), " ")

    return let(let(punctuation(x, seed), lambda y: words(distraction(y, seed))), turn)


TRANSFORMS = {"L1": whitespace, "L2": punctuation, "L3": word_order, "L4": distraction, "L5": combined}


def apply_transform(x, level: str, seed: int = 0, reduce_intensity: bool = False) -> Column:
    at = LEVELS.index(level) if level in LEVELS else 0
    return TRANSFORMS[LEVELS[max(0, at - 1) if reduce_intensity else at]](x, seed)


def spliced(fields: list[str], perturbed: dict[str, Column]) -> Column:
    """A payload of `[FIELD] value` lines, perturbed fields replaced."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"[{f.upper()}] "), perturbed.get(f, F.col(f))) for f in fields))


def wrap_words(words_: Column, lo: float, hi: float, cap: int = 8192) -> Column:
    """Words that a wrapped text should have: the middle of the band, within the token budget."""
    return F.least(F.lit(cap), F.floor(words_ * ((lo + hi) / 2)).cast("long"))


def hint(hints: Column, attempt: Column) -> Column:
    """Style hints in turn."""
    return F.get(hints, F.pmod(attempt - 1, F.size(hints)))
