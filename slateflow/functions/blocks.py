"""Characters in the matching blocks of many pairs of texts, as difflib counts them, without a loop over the pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Blocks of so many characters and more are looked for before shorter ones, which are then found in what lies between.
GRAMS = (3, 1)
#: Entries of a list of cells that are held at once; pairs with more cells than ``CELLS`` go through difflib one by one.
ENTRIES, CELLS, LENGTH = 400_000, 1_000_000, 1 << 20
LAST = LENGTH - 1
#: Entries of a table of grams by text or by place.
TABLE = 4_000_000


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each start up to its stop, and which range each is of."""
    size = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size), owner


class _Texts:
    """Texts laid end to end: their characters, where each begins, how long it is."""

    def __init__(self, texts: list[str], alphabet: np.ndarray | None = None):
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.alphabet = np.unique(flat) if alphabet is None else alphabet
        # characters that the alphabet lacks are -1
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(len(self.alphabet) - 1, 0))
        self.chars = np.where(self.alphabet[at] == flat, at, -1) if len(self.alphabet) else np.full(len(flat), -1)

    def seeds(self) -> np.ndarray:
        """Characters without those that difflib takes for too frequent in a text of 200 and more: these extend a block, but none begins by them."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        k = max(len(self.alphabet), 1)
        _, inverse, counts = np.unique(owner * k + self.chars, return_inverse=True, return_counts=True)
        n = self.size[owner]
        return np.where((n >= 200) & (counts[inverse] > n // 100 + 1), -1, self.chars)


def _grams(chars: np.ndarray, g: int, k: int) -> np.ndarray:
    """A number of the ``g`` characters from each place on; -1 where one of them is -1 or past the end."""
    out = np.full(len(chars), -1, np.int64)
    if len(chars) >= g:
        code, whole = np.zeros(len(chars) - g + 1, np.int64), np.ones(len(chars) - g + 1, bool)
        for x in range(g):
            part = chars[x : len(chars) - g + 1 + x]
            code, whole = code * k + part, whole & (part >= 0)
        out[: len(code)] = np.where(whole, code, -1)
    return out


def _met(ga, gb, a_from, a_to, b_from, b_to, owner, n):
    """Places in a and b with equal grams in rectangles, and their rectangle, rectangle by rectangle; None if several rectangles have too many.

    ``b_from`` and ``b_to`` are by owner, which rectangles with all of a text share.
    """
    bpos, bown = ranges(b_from, b_to)
    has = gb[bpos] >= 0
    bpos, key = bpos[has], bown[has] * n + gb[bpos[has]]
    bpos = bpos[np.argsort(key, kind="stable")]
    counts = np.bincount(key, minlength=len(b_from) * n)
    first = np.cumsum(counts) - counts
    apos, rect = ranges(a_from, a_to)
    has = ga[apos] >= 0
    apos, rect = apos[has], rect[has]
    key = owner[rect] * n + ga[apos]
    has = counts[key] > 0
    apos, rect, key = apos[has], rect[has], key[has]
    if len(a_from) > 1 and counts[key].sum() > ENTRIES:
        return None
    found, cell = ranges(first[key], first[key] + counts[key])
    return rect[cell], apos[cell], bpos[found]


def _met_all(ga, gb, texts_a, texts_b, rect_of, n):
    """``_met`` of all pairs of some texts (from, to, each in order) of either side: grams of a are looked up once for all texts of b. ``rect_of`` has the rectangle of each pair, -1 if there is none."""
    bpos, bown = ranges(*texts_b)
    has = gb[bpos] >= 0
    bpos, bown = bpos[has], bown[has]
    order = np.argsort(gb[bpos], kind="stable")
    counts = np.bincount(gb[bpos], minlength=n)
    first = np.cumsum(counts) - counts
    bpos, bown = bpos[order], bown[order]
    apos, aown = ranges(*texts_a)
    has = ga[apos] >= 0
    apos, aown = apos[has], aown[has]
    key = ga[apos]
    if len(texts_a[0]) > 1 and counts[key].sum() > ENTRIES:
        return None
    found, cell = ranges(first[key], first[key] + counts[key])
    rect, i, j = rect_of[aown[cell], bown[found]], apos[cell], bpos[found]
    order = np.argsort(rect.astype(np.uint16) if rect_of.size < 1 << 16 else rect, kind="stable")
    if (rect_of < 0).any():
        order = order[rect[order] >= 0]
    return rect[order], i[order], j[order]


class _Counted:
    """Where each gram of a few stands: how often before each place, and its places in order."""

    def __init__(self, grams: np.ndarray, n: int):
        seen = np.zeros((len(grams) + 1, n), np.int32)
        at = np.flatnonzero(grams >= 0)
        seen[at + 1, grams[at]] = 1
        self.before = np.cumsum(seen, axis=0, out=seen)
        self.places = at[np.argsort(grams[at], kind="stable")]
        self.first = np.cumsum(self.before[-1]) - self.before[-1]

    def met(self, gb, a_from, a_to, b_from, b_to):
        """``_met`` of rectangles that share no text."""
        bpos, rect = ranges(b_from, b_to)
        has = gb[bpos] >= 0
        bpos, rect = bpos[has], rect[has]
        key = gb[bpos]
        low, high = self.before[a_from[rect], key], self.before[np.maximum(a_from, a_to)[rect], key]
        if len(a_from) > 1 and int((high - low).sum()) > ENTRIES:
            return None
        found, cell = ranges(self.first[key] + low, self.first[key] + high)
        return rect[cell], self.places[found], bpos[cell]


def _runs(met, ga, gb, a_from, a_to, b_from, b_to):
    """Runs of equal grams in rectangles of two texts, rectangle by rectangle: rectangle, places in a and b, grams; ``met`` are their places with equal grams."""
    rect, i, j = met
    # both texts end in a gram that equals none, which is also what stands before their first
    x = gb[j - 1]
    inner = np.flatnonzero((x == ga[i - 1]) & (x >= 0))
    inner = inner[(i[inner] > a_from[rect[inner]]) & (j[inner] > b_from[rect[inner]])]
    starts = np.ones(len(i), bool)
    starts[inner] = False
    starts = np.flatnonzero(starts)
    i, j, rect = i[starts], j[starts], rect[starts]
    length = np.ones(len(i), np.int64)
    going, step = np.arange(len(i)), 1
    while len(going):
        x = gb[j[going] + step]
        going = going[(x == ga[i[going] + step]) & (x >= 0)]
        going = going[(i[going] + step < a_to[rect[going]]) & (j[going] + step < b_to[rect[going]])]
        length[going] += 1
        step += 1
    return rect, i, j, length


def _extend(a, b, i, j, n, a_from, a_to, b_from, b_to):
    """Blocks made longer by equal characters before and behind them."""
    i, j, n = i.copy(), j.copy(), n.copy()
    going = np.arange(len(i))
    while len(going := going[(i[going] > a_from[going]) & (j[going] > b_from[going])]):
        going = going[(a[i[going] - 1] >= 0) & (a[i[going] - 1] == b[j[going] - 1])]
        i[going], j[going], n[going] = i[going] - 1, j[going] - 1, n[going] + 1
    going = np.arange(len(i))
    while len(going := going[(i[going] + n[going] < a_to[going]) & (j[going] + n[going] < b_to[going])]):
        x = a[i[going] + n[going]]
        going = going[(x >= 0) & (x == b[j[going] + n[going]])]
        n[going] += 1
    return i, j, n


def matched(said: list[str], wanted: list[str], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many characters the matching blocks of ``SequenceMatcher(None, said[at], wanted[to])`` have, for each pair of ``at`` and ``to``.

    The longest block of a rectangle (the first in the first text, then in the second) leaves a rectangle on either side; all
    rectangles of all pairs are divided at once. Runs of equal characters are found once, and clipped as rectangles get smaller.
    """
    w = _Texts(wanted)
    s = _Texts(said, w.alphabet)
    k = max(len(w.alphabet), 1)
    seeds = w.seeds()
    total = np.zeros(len(at), np.int64)
    large = (s.size[at] * w.size[to] > CELLS) | (np.maximum(s.size[at], w.size[to]) >= LENGTH)
    for p in np.flatnonzero(large):
        total[p] = sum(m.size for m in SequenceMatcher(None, said[at[p]], wanted[to[p]]).get_matching_blocks())
    pair = np.flatnonzero(~large)
    rects = [pair, s.start[at[pair]], (s.start + s.size)[at[pair]], w.start[to[pair]], (w.start + w.size)[to[pair]]]

    def meet(g, ga, gb, n, counted, pair, al, ah, bl, bh):
        if counted is not None:
            return counted.met(gb, al, ah - g + 1, bl, bh - g + 1)
        if g == GRAMS[0]:
            # whole texts still
            (these, x), (those, y) = (np.unique(side[pair], return_inverse=True) for side in (at, to))
            if len(np.unique(x * len(those) + y)) == len(pair) and len(pair) * 2 >= len(these) * len(those):
                rect_of = np.full((len(these), len(those)), -1)
                rect_of[x, y] = np.arange(len(pair))
                ends = lambda t, of: (t.start[of], (t.start + t.size)[of] - g + 1)
                return _met_all(ga, gb, ends(s, these), ends(w, those), rect_of, n)
            if len(those) * n <= TABLE or len(pair) == 1:
                return _met(ga, gb, al, ah - g + 1, w.start[those], (w.start + w.size)[those] - g + 1, y, n)
            return None
        if len(pair) * n > TABLE and len(pair) > 1:
            return None
        return _met(ga, gb, al, ah - g + 1, bl, bh - g + 1, np.arange(len(pair)), n)

    def divide(g, ga, gb, n, counted, pair, al, ah, bl, bh):
        """Divides rectangles by their blocks of ``g`` and more; returns lists of those that have none."""
        if not len(pair):
            return []
        large = len(pair) > 1 and (int((ah - al).sum()) > ENTRIES if counted is None else int((bh - bl).sum()) > ENTRIES)
        met = None if large else meet(g, ga, gb, n, counted, pair, al, ah, bl, bh)
        if met is None:
            half = len(pair) // 2
            return [p for part in (slice(half), slice(half, None)) for p in divide(g, ga, gb, n, counted, *(x[part] for x in (pair, al, ah, bl, bh)))]
        r, i, j, size = _runs(met, ga, gb, al, ah - g + 1, bl, bh - g + 1)
        # places count from the beginning of their texts, and a run is one number, the larger the longer it is and the further ahead it stands
        sa, wa = s.start[at[pair]], w.start[to[pair]]
        run = (size + g - 1 << 40) | (LAST - (i - sa[r]) << 20) | (LAST - (j - wa[r]))
        rest = []
        while True:
            none = np.ones(len(pair), bool)
            none[r] = False
            none &= (al < ah) & (bl < bh)
            rest.append([x[none] for x in (pair, al, ah, bl, bh)])
            if not len(r):
                return rest
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            who = r[first]
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(r))))
            pair, sa, wa, al, ah, bl, bh = (x[who] for x in (pair, sa, wa, al, ah, bl, bh))
            # the longest, of these the first
            top = np.maximum.reduceat(run, first)
            bi, bj, bn = _extend(s.chars, w.chars, sa + LAST - (top >> 20 & LAST), wa + LAST - (top & LAST), top >> 40, al, ah, bl, bh)
            np.add.at(total, pair, bn)
            # what of each run lies before the block, and what behind it
            size, i, j = run >> 40, LAST - (run >> 20 & LAST), LAST - (run & LAST)
            left = np.minimum((bi - sa)[group] - i, (bj - wa)[group] - j)
            one = np.flatnonzero((left >= g) & (size >= g))
            cut = np.maximum(size[one] - left[one], 0)
            skip = np.maximum(np.maximum((bi + bn - sa)[group] - i, (bj + bn - wa)[group] - j), 0)
            two = np.flatnonzero(size - skip >= g)
            r = np.concatenate((group[one], group[two] + len(first)))
            run = np.concatenate((run[one] - (cut << 40), run[two] + skip[two] * ((-1 << 40) - (1 << 20) - 1)))
            pair, sa, wa = (np.concatenate((x, x)) for x in (pair, sa, wa))
            al, ah, bl, bh = (np.concatenate(x) for x in ((al, bi + bn), (bi, ah), (bl, bj + bn), (bj, bh)))

    for g in GRAMS:
        gb = _grams(seeds, g, k)
        vocabulary = np.unique(gb[gb >= 0])
        number = lambda codes: np.where((codes >= 0) & (vocabulary[x := np.minimum(np.searchsorted(vocabulary, codes), max(len(vocabulary) - 1, 0))] == codes), x, -1) if len(vocabulary) else np.full(len(codes), -1)  # noqa: E731, B023
        ga, gb, n = (*(np.append(number(codes), -1) for codes in (_grams(s.chars, g, k), gb)), len(vocabulary))
        # counts are at hand where there are few different grams, and for rectangles that are no longer whole texts
        counted = _Counted(ga, n) if g != GRAMS[0] and (len(ga) + 1) * n <= TABLE else None
        parts = divide(g, ga, gb, n, counted, *rects)
        rects = [np.concatenate([p[x] for p in parts]) if parts else rects[x][:0] for x in range(5)]
    # where no block begins, what both sides begin with is one
    pair, al, ah, bl, bh = rects
    _, _, n = _extend(s.chars, w.chars, al, bl, np.zeros(len(al), np.int64), al, ah, bl, bh)
    np.add.at(total, pair, n)
    return total
