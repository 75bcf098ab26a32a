"""Longest common blocks, recursively, of many pairs of texts at once, in arrays.

The longest common block of two texts, then the longest ones on both sides of
it, and so on, is what matching-block similarity is made of. Searching it pair
by pair costs the product of the lengths. Here all pairs of a batch share one
dictionary of basic factors (Karp, Miller and Rosenberg, 1972): level t numbers
all windows of 2^t characters so that equal windows have equal numbers, each
level from the one below it by one sort. A window of any length is told exactly
by two overlapping windows of a level, so whether two ranges have a common block
of k characters is one sorted search, and the longest k is found bit by bit, for
all open ranges of all pairs together. A round costs n log n in what is open;
rounds are as many as the recursion is deep. Levels are made when a block is
found that needs them.

Of blocks of equal length the one that starts first in a, then first in b, is
taken. `popular` leaves out characters that make up more than a hundredth of a
long b (200 characters or more) when blocks are sought; found blocks are then
extended over them, as is the corner of a range without any block. Both rules
are those of difflib.SequenceMatcher, whose blocks these are.
"""

from __future__ import annotations

import numpy as np

#: Characters of the pairs that are searched together; one longer pair is searched by itself.
BATCH_CHARS = 1 << 16


def _characters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Factors:
    """Numbers of all windows of 2^t characters, level by level."""

    def __init__(self, characters: np.ndarray):
        self.n = len(characters)
        self.flat = np.unique(characters, return_inverse=True)[1].astype(np.int64)  # level t begins at t * n

    def level(self, t: int) -> np.ndarray:
        while len(self.flat) <= t * self.n:
            last, half = self.flat[-self.n :], len(self.flat) // self.n - 1
            ahead = np.zeros(self.n, dtype=np.int64)  # windows over the end are never asked for
            ahead[: max(0, self.n - (1 << half))] = last[1 << half :]
            self.flat = np.concatenate([self.flat, np.unique(last * self.n + ahead, return_inverse=True)[1]])
        return self.flat[t * self.n : (t + 1) * self.n]

    def windows(self, at: np.ndarray, owner: np.ndarray, k: np.ndarray, t: np.ndarray, whole: bool) -> np.ndarray:
        """A number for each window of k characters (2^t at least, below twice that; whole: just that) at a place, different for each owner."""
        self.level(int(t.max(initial=0)))
        row = (t * self.n)[owner] + at
        first = self.flat[row]
        if whole:
            return owner * self.n + first
        second = self.flat[row + (k - (1 << t))[owner]]
        if len(t) * self.n * self.n < 1 << 62:
            return (owner * self.n + first) * self.n + second
        return owner * len(row) + np.unique(first * self.n + second, return_inverse=True)[1]


class _Search:
    def __init__(self, characters: np.ndarray, popular: np.ndarray):
        self.factors = _Factors(characters)
        self.popular = np.concatenate([[0], np.cumsum(popular)]) if popular.any() else None

    def _windows(self, r: np.ndarray, k: np.ndarray, t: np.ndarray, which: np.ndarray, whole: bool = False):
        """Places, owners and numbers of the windows of length k of a, and of b, in the ranges `which`."""
        k, t = k[which], t[which]
        places, owners = [], []
        for side, (lo, hi) in enumerate(((r[0], r[1]), (r[2], r[3]))):
            size = np.maximum(hi[which] - lo[which] - k + 1, 0)
            at, owner = _ranges(lo[which], size), np.repeat(np.arange(len(which)), size)
            if side and self.popular is not None:
                own = self.popular[at + k[owner]] == self.popular[at]
                at, owner = at[own], owner[own]
            places.append(at)
            owners.append(owner)
        # numbered together, so that equal windows stay equal
        numbers = self.factors.windows(np.concatenate(places), np.concatenate(owners), k, t, whole)
        n = len(places[0])
        return places[0], owners[0], numbers[:n], places[1], owners[1], numbers[n:]

    def _having(self, r: np.ndarray, k: np.ndarray, t: np.ndarray, which: np.ndarray, whole: bool = False) -> np.ndarray:
        """Those of the ranges `which` that have a common block of length k."""
        _, a_owner, a, _, b_owner, b = self._windows(r, k, t, which, whole)
        if len(a) > len(b):
            a_owner, a, b_owner, b = b_owner, b, a_owner, a
        found = np.zeros(len(which), dtype=bool)
        if len(a):
            a = np.sort(a)
            found[b_owner[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b]] = True
        return which[found]

    def longest(self, r: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j, k of the longest block of each range (alo, ahi, blo, bhi), of `most` characters at most."""
        n = r.shape[1]
        top = np.minimum(np.minimum(r[1] - r[0], r[3] - r[2]), most)
        k, t, level = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
        which = np.flatnonzero(top >= 1)
        while len(which):  # up, as long as blocks of 2^level are found
            found = self._having(r, np.full(n, 1 << level), np.full(n, level), which, whole=True)
            k[found], t[found] = 1 << level, level
            level += 1
            which = found[top[found] >= 1 << level]
        for bit in range(level - 2, -1, -1):  # down, bit by bit
            longer = k + (1 << bit)
            which = np.flatnonzero((k > 0) & (bit < t) & (longer <= top))
            if len(which):
                found = self._having(r, longer, t, which)
                k[found] = longer[found]
        i, j = r[0].copy(), r[2].copy()
        which = np.flatnonzero(k > 0)
        if len(which):
            at, owner, a, b_at, b_owner, b = self._windows(r, k, t, which)
            order = np.argsort(a, kind="stable")
            place = np.minimum(np.searchsorted(a[order], b), len(a) - 1)  # of equal windows of a the first
            first = order[place]
            hit = np.flatnonzero(a[first] == b)
            # of each range the least place in a, then the least in b: places are in order within ranges
            best = np.full(len(which), len(a))
            np.minimum.at(best, b_owner[hit], first[hit])
            hit = hit[first[hit] == best[b_owner[hit]]]
            i[which] = at[best]
            j[which[b_owner[hit[::-1]]]] = b_at[hit[::-1]]  # the last one written is the first
        return i, j, k

    def extended(self, r: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> None:
        """Blocks longer by equal characters on both sides, in place."""
        left, right = np.minimum(i - r[0], j - r[2]), np.minimum(r[1] - i, r[3] - j) - k
        for room, back in ((left, True), (right, False)):
            step, going = 0, np.flatnonzero(room > 0)
            while len(going):  # steps double while they succeed
                fits = going[room[going] >= 1 << step]
                at, bt = (i[fits] - (1 << step), j[fits] - (1 << step)) if back else (i[fits] + k[fits], j[fits] + k[fits])
                table = self.factors.level(step)
                same = fits[table[at] == table[bt]]
                if len(same):
                    if back:
                        i[same] -= 1 << step
                        j[same] -= 1 << step
                    k[same] += 1 << step
                    room[same] -= 1 << step
                    step += 1
                elif step:
                    step -= 1
                    continue
                else:
                    break
                going = going[room[going] > 0]


def blocks(pairs: list[tuple[str, str]], popular: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pair, i, j, k of every block, by pair and place; i and j count from the start of a and of b."""
    characters = _characters([x for p in pairs for x in p])
    sizes = np.array([len(x) for p in pairs for x in p], dtype=np.int64).reshape(-1, 2)
    start = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 2)
    skipped = np.zeros(len(characters), dtype=bool)
    if popular:
        for (_, blo), (_, n) in zip(start.tolist(), sizes.tolist()):
            if n >= 200:
                own, back, count = np.unique(characters[blo : blo + n], return_inverse=True, return_counts=True)
                skipped[blo : blo + n] = (count > n // 100 + 1)[back]
    search = _Search(characters, skipped)
    open_pairs = np.arange(len(pairs))
    r = np.stack([start[:, 0], start[:, 0] + sizes[:, 0], start[:, 1], start[:, 1] + sizes[:, 1]])
    most = sizes.min(axis=1) if len(pairs) else np.empty(0, dtype=np.int64)
    out = []
    while True:
        own = (r[1] > r[0]) & (r[3] > r[2])
        r, open_pairs, most = r[:, own], open_pairs[own], most[own]
        if not r.shape[1]:
            break
        i, j, k = search.longest(r, most)
        sought = k.copy()  # what is left has no longer block than this; extensions do not count
        if search.popular is not None:
            search.extended(r, i, j, k)
        own = k > 0
        r, open_pairs, i, j, k, sought = r[:, own], open_pairs[own], i[own], j[own], k[own], sought[own]
        out.append(np.stack([open_pairs, i - start[open_pairs, 0], j - start[open_pairs, 1], k]))
        r = np.concatenate([np.stack([r[0], i, r[2], j]), np.stack([i + k, r[1], j + k, r[3]])], axis=1)
        open_pairs, most = np.concatenate([open_pairs, open_pairs]), np.concatenate([sought, sought])
    found = np.concatenate(out, axis=1) if out else np.empty((4, 0), dtype=np.int64)
    return tuple(found[:, np.lexsort((found[2], found[1], found[0]))])


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Of each pair: twice the characters in blocks of the lower-cased texts (popular ones left out) by all characters."""
    low = [(a.lower(), b.lower()) for a, b in pairs]
    pair, _, _, k = blocks(low, popular=True)
    total = np.array([len(a) + len(b) for a, b in low], dtype=np.int64)
    return np.where(total > 0, 2.0 * np.bincount(pair, weights=k, minlength=len(pairs)) / np.maximum(total, 1), 1.0)


def edits(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: the characters edited (none left out of the search), and whether no letter or digit is edited."""
    pair, i, j, k = blocks(pairs, popular=False)
    sizes = np.array([(len(a), len(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    # gaps before each block, and behind a pair's last one, as an empty block at its end
    every = np.arange(len(pairs))
    rows = np.concatenate([np.stack([pair, i, j, k]), np.stack([every, sizes[:, 0], sizes[:, 1], np.zeros(len(pairs), dtype=np.int64)])], axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    same = np.concatenate([[False], rows[0][1:] == rows[0][:-1]])[: rows.shape[1]]
    end = np.roll(rows[1:3] + rows[3], 1, axis=1) * same
    edited = np.bincount(rows[0], weights=np.maximum(*(rows[1:3] - end)), minlength=len(pairs)).astype(np.int64)
    return edited, _unchanged(pairs, sizes, pair, i, j, k)


def _unchanged(pairs, sizes, pair, i, j, k) -> np.ndarray:
    """Whether all letters and digits of both texts lie in blocks."""
    out = np.ones(len(pairs), dtype=bool)
    for side, at in ((0, i), (1, j)):
        characters = _characters([p[side] for p in pairs])
        values, back = np.unique(characters, return_inverse=True)
        telling = np.array([chr(v).isalpha() or chr(v).isdigit() for v in values.tolist()], dtype=bool)
        run = np.concatenate([[0], np.cumsum(telling[back] if len(values) else [])])
        start = np.cumsum(sizes[:, side]) - sizes[:, side]
        inside = np.bincount(pair, weights=run[start[pair] + at + k] - run[start[pair] + at], minlength=len(pairs))
        out &= inside == run[start + sizes[:, side]] - run[start]
    return out


def batches(pairs: list[tuple[str, str]]):
    """(from, to) of runs of pairs with at most BATCH_CHARS characters, or one longer pair."""
    lo = held = 0
    for at, (a, b) in enumerate(pairs):
        if at > lo and held + len(a) + len(b) > BATCH_CHARS:
            yield lo, at
            lo, held = at, 0
        held += len(a) + len(b)
    if len(pairs) > lo:
        yield lo, len(pairs)
