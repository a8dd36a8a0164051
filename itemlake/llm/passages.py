"""Repeated fuzzy passages across documents, by collinear chaining.

Words are as in neardup. Of every WINDOW successive runs of SEED words the one
of the smallest hash is a seed (a minimiser), so any equal run of WINDOW +
SEED - 1 words shares one; what is found at which agreement of words is
measured in tests/llm. Documents of equal words are one class with one
representative. Of the seeds that classes share, those stay that lie in runs as long as
a chain, without a gap; others can be in none. Classes that share one are candidates
(graph.candidates): all pairs of a seed of few classes, a star around one class of a frequent one. Two
frequent seeds of LEAST_CHAIN words together, at most REACH apart, count again as one, so
texts that share no other seed meet by the two that a chain needs. A holder of
such a couple whose place is in no passage with the centre of its star is held
against up to graph.CENTRES that are, and then, if it is in none with these
either, against every other holder, so no cut is made where stars do not reach. All
seeds that two candidates share are matched and, in order, chained by a dynamic programme
whose best predecessor a tree of maxima finds, among those near enough: a match
adds its new words, a gap costs by its length in both texts. Chains are aligned
word by word, extended at both ends over edits too, and are passages if both
sides have `least` words and `percent` of the longer side's words agree.

A passage that more than graph.HOT classes hold is so reported as each one's
pair with a representative and not as all pairs of its holders; those that have
none with the representative are reported with some that have one, or with all others that have it. A seed that one
text repeats is matched place by place with those of the other text, and each of
its places with the first there, so all places are covered.

Null and empty texts have no passage. Copies are reported with the smallest id
of their class, over all their words. Passages within one text are not looked
for. Rows of one id and text count once; a class of null ids alone is named by
null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlake.llm.common import drop, small, small_batches, written
from itemlake.llm.graph import CENTRES, candidates, centres
from itemlake.llm.neardup import _MULT, PIECE, _mix, word_hashes

SEED, WINDOW = 6, 8  # words, runs
GAP = 25  # most words between matches of a chain
REACH = 2 * (GAP + SEED)  # words from the first of two frequent seeds to the other
GAP_COST = 0.25  # of a word between matches
EDIT_COST = 3  # of an edit beyond a chain's ends, in words that agree
LEAST_CHAIN = 24  # words from a chain's first to its last match


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower())[0]


def key_of(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _runs(words: np.ndarray) -> np.ndarray:
    """The hash of the SEED words from every word on."""
    n = max(0, len(words) - SEED + 1)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(SEED):
        run = run * _MULT + words[i : i + n]
    return (_mix(run) >> np.uint64(1)).astype(np.int64)


def _least(run: np.ndarray) -> np.ndarray:
    """Where the first least of every WINDOW successive runs is, a power of two."""
    at, width = np.arange(len(run)), 1
    while width < WINDOW and len(at) > width:
        left, right = at[:-width], at[width:]
        at, width = np.where(run[right] < run[left], right, left), 2 * width
    return at if width == WINDOW else at[:0]


def _minimisers(run: np.ndarray, least: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimisers of a text's runs, which are from `start` on; least: of its whole windows, from there too."""
    if not len(run):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    if len(run) <= WINDOW:
        places = np.array([int(run.argmin())])
    else:
        places = least[np.concatenate([[True], least[1:] != least[:-1]])] - start
        new = run[places[1:]] != run[places[:-1]]
        places = places[np.concatenate([[True], new]) | np.concatenate([new, [True]])]  # of a run of equal seeds, the ends
    return run[places], places.astype(np.int32)


def seeds_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of each text, and hashes and places of its minimisers; many short texts are hashed at once."""
    at = 0
    while at < len(texts):
        raws, total = [], 0
        while at < len(texts) and (not raws or total < PIECE):
            raws.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            total += len(raws[-1]) + 1
            at += 1
        words, starts = word_hashes(b" ".join(raws))
        run = _runs(words)
        least = _least(run)
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
        for a, b in zip(first, first[1:]):
            n = max(0, b - a - SEED + 1)
            yield words[a:b], *_minimisers(run[a : a + n], least[a : a + n - WINDOW + 1] if n > WINDOW else least[:0], a)


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, hashes, places = [], [], [], []
        for words, h, p in seeds_of(batch.column(1).to_pylist()):
            keys.append(key_of(words) if len(words) else None)
            sizes.append(len(words))
            hashes.append(h)
            places.append(p)
        ends = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
        flat = [pa.array(np.concatenate(x) if x else np.empty(0), kind) for x, kind in ((hashes, pa.int64()), (places, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), *(pa.ListArray.from_arrays(ends, x) for x in flat)], ["id", "n", "key", "hashes", "places"])


class Maxima:
    """The best (value, index) over a range of places, each of which holds its entries in order of time."""

    NONE = (float("-inf"), -1)

    def __init__(self, n: int):
        self.n, self.best = n, [self.NONE] * (2 * n)
        self.held: list[deque[tuple[float, int]]] = [deque() for _ in range(n)]

    def put(self, at: int, value: tuple[float, int]) -> None:
        held = self.held[at]
        while held and held[-1] <= value:  # no better and gone sooner
            held.pop()
        held.append(value)
        self._renew(at)

    def expire(self, at: int, index: int) -> None:
        """Take out the entry of this index, the oldest one put to its place that is left."""
        if self.held[at] and self.held[at][0][1] == index:
            self.held[at].popleft()
            self._renew(at)

    def _renew(self, at: int) -> None:
        best = self.held[at][0] if self.held[at] else self.NONE
        at += self.n
        while self.best[at] != best:  # what lies above a node that stays as it was stays too
            self.best[at] = best
            if at == 1:
                break
            at //= 2
            best = max(self.best[2 * at], self.best[2 * at + 1])

    def over(self, start: int, end: int) -> tuple[float, int]:
        out, start, end = self.NONE, start + self.n, end + self.n
        while start < end:
            if start & 1:
                out, start = max(out, self.best[start]), start + 1
            if end & 1:
                end -= 1
                out = max(out, self.best[end])
            start, end = start // 2, end // 2
        return out


def chains(matches: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Collinear chains of matches (place in a, place in b), the best first; no match is in two.

    A predecessor lies before in both texts, by GAP words beyond its own at
    most. Gaps cost GAP_COST for each word of both sides, which splits into a
    part of either match, so the best predecessor that does not overlap is a
    maximum over a range of places in b, from which matches expire that lie too
    far back in a. The few that overlap are tried one by one.
    """
    matches = sorted(set(matches))
    ys = sorted({q for _, q in matches})
    at = [bisect_left(ys, q) for _, q in matches]
    tree, score, back = Maxima(len(ys)), [], []
    near: list[list[int]] = [[] for _ in ys]  # by place in b, the matches not yet over GAP back in a
    fresh = far = 0  # the first match that is not yet in the tree, and the first that has not expired
    for i, (p, q) in enumerate(matches):
        while matches[fresh][0] <= p - SEED:
            tree.put(at[fresh], (score[fresh] + GAP_COST * sum(matches[fresh]), fresh))
            fresh += 1
        while matches[far][0] < p - GAP - SEED:
            tree.expire(at[far], far)
            near[at[far]].remove(far)
            far += 1
        low, most = bisect_left(ys, q - GAP - SEED), bisect_right(ys, q - SEED)
        gain, before = float(SEED), -1
        value, j = tree.over(low, most)
        if j >= 0 and value - GAP_COST * (p + q) + SEED + 2 * GAP_COST * SEED > gain:
            gain, before = value - GAP_COST * (p + q) + SEED + 2 * GAP_COST * SEED, j
        # overlapping in b, by any place in a; then in a alone
        overlapping = [j for y in range(most, at[i]) for j in near[y] if matches[j][0] < p]
        overlapping += [j for j in range(fresh, i) if matches[j][0] < p and low <= at[j] < most]
        for j in overlapping:
            x, y = p - matches[j][0], q - matches[j][1]
            joined = score[j] + min(SEED, x, y) + 2 * GAP_COST * SEED - GAP_COST * (x + y)
            if joined > gain:
                gain, before = joined, j
        score.append(gain)
        back.append(before)
        near[at[i]].append(i)
    used: set[int] = set()
    for i in sorted(range(len(matches)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(matches[i])
            i = back[i]
        if chain:
            yield chain[::-1]


def matches_of(ha: np.ndarray, pa_: np.ndarray, hb: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """Places in a and b of the seeds that both have, by hashes and places of either, in order.

    Of a seed that is repeated, the places are matched one by one and each one
    with the first of the other side: a number that is linear in them.
    """
    if not len(ha) or not len(hb):
        return []
    first = np.searchsorted(hb, ha)
    hit = np.flatnonzero(hb[np.minimum(first, len(hb) - 1)] == ha)
    first = first[hit]
    out = list(zip(pa_[hit].tolist(), pb[first].tolist()))
    if (ha[1:] == ha[:-1]).any() or (hb[1:] == hb[:-1]).any():
        even = first + hit - np.searchsorted(ha, ha[hit])
        both = even < np.searchsorted(hb, ha[hit], side="right")
        out += zip(pa_[hit[both]].tolist(), pb[even[both]].tolist())
        first = np.searchsorted(ha, hb)
        hit = np.flatnonzero(ha[np.minimum(first, len(ha) - 1)] == hb)
        out += zip(pa_[first[hit]].tolist(), pb[hit].tolist())
    return out


def _along(found: list[tuple[int, int]]) -> list[list[tuple[int, int]]] | None:
    """The one chain of matches that follow each other closely at one distance, as chains() would find it; else None."""
    found = sorted(set(found))
    shift = found[0][1] - found[0][0]
    if all(q - p == shift for p, q in found) and all(b[0] - a[0] <= 2 * SEED for a, b in zip(found, found[1:])):
        return [found]
    return None


def _span(matches: list[tuple[int, int]]) -> int:
    """Words from the first to the last match, in the text in which they are fewer."""
    ps, qs = zip(*matches)
    return min(max(ps) - min(ps), max(qs) - min(qs)) + SEED


def _parts(found: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Matches in parts that no chain joins, as they are too far apart in either text; without parts too short for a chain."""
    parts = [found] if found else []
    for side in (1, 0):
        cut = []
        for part in parts:
            part = sorted(part, key=lambda m: m[side])
            ends = [i for i in range(1, len(part)) if part[i][side] - part[i - 1][side] > GAP + SEED]
            cut += [part[x:y] for x, y in zip([0, *ends], [*ends, len(part)])]
        parts = [part for part in cut if _span(part) >= LEAST_CHAIN]
    yield from parts


def _slices(lists: pa.ListArray) -> Callable[[int], np.ndarray]:
    """The numbers of the list at a row, of a column without nulls, without an object for each list."""
    flat, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
    return lambda i: flat[ends[i] : ends[i + 1]]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists without nulls, and how many each row has."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)


def _keyed(hashes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all rows, their rows, keys in the order of (row, hash), and the rows in which a key comes twice."""
    flat, sizes = _flat(hashes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row << 48 | flat >> 15
    return flat, row, key, row[1:][key[1:] == key[:-1]]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Lists of small numbers, as the steps of a chain are, which are a gap at most."""
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int8)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.astype(np.int8), pa.int8()))


def chains_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places in a, in b) of the chains of all pairs (.., .., ha, pa, hb, pb) of a batch.

    Rows of which neither side repeats a seed are matched at once. Their matches
    are cut where they are too far apart in a, and those that follow each other
    closely at one distance are a chain as they are; others go on one by one.
    """
    (ha, row, ka, twice_a), (hb, _, kb, twice_b) = _keyed(batch.column(2)), _keyed(batch.column(4))
    pa_, pb = _flat(batch.column(3))[0], _flat(batch.column(5))[0]
    once = np.ones(batch.num_rows, dtype=bool)
    once[twice_a] = once[twice_b] = False
    sides = [_slices(batch.column(c)) for c in range(2, 6)]
    slow = [(int(i), matches_of(*(side(i) for side in sides))) for i in np.flatnonzero(~once)]
    if len(ka) and len(kb):
        at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        hit = np.flatnonzero((kb[at] == ka) & (hb[at] == ha) & once[row])
        row, p, q = row[hit], pa_[hit], pb[at[hit]]
        order = np.argsort(row << 32 | p)
        row, p, q = row[order], p[order], q[order]
    else:
        row, p, q = row[:0], pa_[:0], pb[:0]
    if len(row):
        gap, shift = np.diff(p), q - p
        start = np.concatenate([[0], np.flatnonzero((row[1:] != row[:-1]) | (gap > GAP + SEED)) + 1])
        end = np.append(start[1:], len(row))
        gap[start[1:] - 1] = 0  # between two parts
        most = np.maximum.reduceat(np.append(gap, 0), start)
        span = np.minimum(p[end - 1] - p[start], np.maximum.reduceat(q, start) - np.minimum.reduceat(q, start)) + SEED
        along = (np.maximum.reduceat(shift, start) == np.minimum.reduceat(shift, start)) & (most <= 2 * SEED)
        for i in np.flatnonzero(span >= LEAST_CHAIN).tolist():
            x, y = start[i], end[i]
            if along[i]:
                yield int(row[x]), p[x:y], q[x:y]
            else:
                slow.append((int(row[x]), list(zip(p[x:y].tolist(), q[x:y].tolist()))))
    for i, found in slow:
        for part in _parts(found):
            for chain in _along(part) or chains(part):
                if len(chain) > 1 and _span(chain) >= LEAST_CHAIN:
                    yield i, *np.array(chain, dtype=np.int32).T


CHAIN = {"p": "int", "p1": "int", "q": "int", "q1": "int", "dp": "array<tinyint>", "dq": "array<tinyint>"}  # first and last place, steps between them


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole, at in ((batch, at) for batch in batches for at in range(0, batch.num_rows, 1 << 14)):  # rows that a key has room for
        batch = whole.slice(at, 1 << 14)
        found = list(chains_of(batch))
        rows = pa.array([i for i, _, _ in found], pa.int32())
        ends = [pa.array([c[side][at] for c in found], pa.int32()) for side in (1, 2) for at in (0, -1)]
        steps = [_lists([np.diff(c[side]) for c in found]) for side in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *ends, *steps], ["a", "b", *CHAIN])


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, in order, of two short runs: the longest common subsequence, a row of it in the bits of a number."""
    b, places = b.tolist(), {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for word in a.tolist():
        step = row & places.get(word, 0)
        row = (row + step | row - step) & full
    return len(b) - row.bit_count()


@lru_cache(64)
def _order(n: int) -> np.ndarray:
    return np.arange(n)


def _onwards(sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words of a and b, and how many agree, by which each two texts go on alike: equal words, then the best alignment.

    A word that agrees counts 1, one changed, added or left out EDIT_COST, so
    that what is added agrees in three words of four or more.
    """
    if not sides:
        return np.zeros((0, 3), dtype=np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in sides])
    width = int(sizes.max()) + EDIT_COST
    place = _order(width)
    a, b = np.zeros((2, len(sides), width), dtype=np.uint64)
    for side, words, n in ((0, a, sizes[:, 0]), (1, b, sizes[:, 1])):
        words[place < n[:, None]] = np.concatenate([s[side] for s in sides])
    more = (a != b) | (place >= sizes.min(axis=1)[:, None])
    more = more.argmax(axis=1)
    out = np.repeat(more[:, None], 3, axis=1)
    left = sizes - more[:, None]
    # an edit comes first, and one before each run of words that agree, so a gain has a run of more than EDIT_COST words
    rows = np.flatnonzero(left.min(axis=1) > EDIT_COST)
    for rows in np.array_split(rows, -(-len(rows) // 1024) or 1):
        at = np.minimum(more[rows, None] + place, width - 1)
        wa, wb = np.take_along_axis(a[rows], at, 1), np.take_along_axis(b[rows], at, 1)
        equal = (wa[:, :, None] == wb[:, None, :]) & (place < left[rows, :1])[:, :, None] & (place < left[rows, 1:])[:, None, :]
        runs = equal[:, :-EDIT_COST, :-EDIT_COST].copy()
        for d in range(1, EDIT_COST + 1):
            runs &= equal[:, d : width - EDIT_COST + d, d : width - EDIT_COST + d]
        gains = runs.any(axis=(1, 2))
        rows, equal = rows[gains], equal[gains]
        if not len(rows):
            continue
        unit = 1 << 20  # a cell is its score in units, and how many words agree
        step = EDIT_COST * unit * np.arange(width + 1)
        row, best = np.repeat(-step[None], len(rows), axis=0), np.zeros((len(rows), 3), dtype=np.int64)
        for i in range(int(left[rows, 0].max())):
            after = row - EDIT_COST * unit
            after[:, 1:] = np.maximum(after[:, 1:], row[:, :-1] + np.where(equal[:, i], unit + 1, -EDIT_COST * unit))
            row = np.maximum.accumulate(after + step, axis=1) - step
            j = row.argmax(axis=1)
            value = row[np.arange(len(rows)), j]
            better = (value >= unit) & (value > best[:, 0])
            best[better] = np.stack([value, np.full(len(j), i + 1), j], axis=1)[better]
        out[rows] += np.stack([best[:, 1], best[:, 2], best[:, 0] % unit], axis=1)
    return out


def _onward(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    return tuple(_onwards([(a, b)])[0].tolist())


MARGIN = 2 * (WINDOW + SEED)  # words beyond a chain into which its passage may go on


def _gaps(dp: np.ndarray, dq: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The words in a and in b between matches that neither has, where both sides have such words, by a chain's steps; the words of the matches."""
    fresh = np.minimum(np.minimum(dp, dq), SEED)
    na, nb = dp - fresh, dq - fresh
    return np.where(nb > 0, na, 0), np.where(na > 0, nb, 0), SEED + int(fresh.sum())


def _loose(words: np.ndarray, first: int, steps: np.ndarray, gaps: np.ndarray) -> list[np.ndarray]:
    """The words before a chain, those of its gaps, and those after it: all that is not equal by its matches."""
    ends = first + SEED + np.cumsum(steps)  # of the matches but the first
    held = np.flatnonzero(gaps)
    parts = [words[max(0, first - MARGIN) : first]]
    parts += [words[x : x + n] for x, n in zip((ends[held] - steps[held]).tolist(), gaps[held].tolist())]
    last = int(ends[-1]) if len(ends) else first + SEED
    return [*parts, words[last : last + MARGIN]]


def aligned_all(rows: list[tuple]) -> np.ndarray:
    """(start and end in a, in b, words that agree) of chains (loose words of a, of b, first places, steps), extended at both ends."""
    if not rows:
        return np.zeros((0, 5), dtype=np.int64)
    out = np.zeros((len(rows), 5), dtype=np.int64)
    for i, (a, b, p, q, dp, dq) in enumerate(rows):
        same = _gaps(dp, dq)[2] + sum(len(x) if len(x) == len(y) and (x == y).all() else _agree(x, y) for x, y in zip(a[1:-1], b[1:-1]))
        out[i] = p, p + int(dp.sum()) + SEED, q, q + int(dq.sum()) + SEED, same
    back = _onwards([(a[0][::-1], b[0][::-1]) for a, b, *_ in rows])
    on = _onwards([(a[-1], b[-1]) for a, b, *_ in rows])
    return out + np.stack([-back[:, 0], on[:, 0], -back[:, 1], on[:, 1], back[:, 2] + on[:, 2]], axis=1)


def aligned(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int]) -> tuple[int, int, int, int, int]:
    """The same of one chain, by whole texts and places."""
    dp, dq = np.diff(p), np.diff(q)
    na, nb, _ = _gaps(dp, dq)
    return tuple(aligned_all([(_loose(a, p[0], dp, na), _loose(b, q[0], dq, nb), p[0], q[0], dp, dq)])[0].tolist())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a text's windows (first, last), each with a margin, once each: the pieces that they cover, and where these start."""
    for batch in batches:
        rows = batch.to_pydict()
        for text, key, cls, windows in zip(rows["text"], rows["key"], rows["cls"], rows["windows"]):
            words = words_of(text)
            if key_of(words) != key:  # another text may have the same id
                continue
            pieces: list[list[int]] = []
            for start, end in sorted((max(0, w["first"] - MARGIN), w["last"] + SEED + MARGIN) for w in windows):
                if pieces and start <= pieces[-1][1]:
                    pieces[-1][1] = max(pieces[-1][1], end)
                else:
                    pieces.append([start, end])
            parts = [words[start:end].view(np.int64) for start, end in pieces]
            ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            cols = [pa.array([cls] * len(parts), pa.int64()), pa.array([start for start, _ in pieces], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), pa.int64()))], ["cls", "start", "words"])


# chains by their class on either side, and pieces of texts (which have no other, and their start as p), by which they are met
SIDES = {"cls": "long", "other": "long", **CHAIN, "words": "array<long>"}


def _with_loose(batches: Iterator[pa.RecordBatch], of_a: bool) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches in the order of cls, pieces first; of each chain (row, loose words on this side, gaps in a, first places, steps)."""
    held, starts, pieces = None, [], []
    for batch in batches:
        found = []
        words, dp, dq = (_slices(batch.column(c)) for c in ("words", "dp", "dq"))
        of_chains = batch.column("other").is_valid().to_pylist()
        for i, (cls, p, q, chain) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cls", "p", "q")), of_chains)):
            if chain:
                x, y = dp(i).astype(np.int64), dq(i).astype(np.int64)
                na, nb, _ = _gaps(x, y)
                first, steps, gaps = (p, x, na) if of_a else (q, y, nb)
                n = bisect_right(starts, first) - 1
                found.append((i, _loose(pieces[n], first - starts[n], steps, gaps), na, p, q, x, y))
            else:
                if held != cls:
                    held, starts, pieces = cls, [], []
                starts.append(p)
                pieces.append(words(i).view(np.uint64).copy())  # not with its batch
        yield batch, found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chain with its loose words in a, for the other side."""
    for whole, found in _with_loose(batches, True):
        for at in range(0, len(found), 256):  # a bounded number to a batch
            some = found[at : at + 256]
            batch = whole.take(pa.array([row[0] for row in some], pa.int32()))
            words = [np.concatenate(row[1]) for row in some]
            ends = pa.array(np.cumsum([0, *map(len, words)]), pa.int32())
            cols = [batch.column(c) for c in ("other", "cls", *CHAIN)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(words).view(np.int64), pa.int64()))], list(SIDES))


def _aligned(least: int, percent: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _with_loose(batches, False):
            words, rows = _slices(batch.column("words")), []
            for i, of_b, na, p, q, dp, dq in found:
                ends = np.cumsum([min(p, MARGIN), *na[na > 0].tolist()])
                rows.append((np.split(words(i).view(np.uint64), ends), of_b, p, q, dp, dq))
            a0, a1, b0, b1, same = aligned_all(rows).T
            longer = np.maximum(a1 - a0, b1 - b0)
            keep = (np.minimum(a1 - a0, b1 - b0) >= least) & (100 * same >= percent * longer)
            of = pa.array(np.array([row[0] for row in found], dtype=np.int32)[keep])
            cols = [*(batch.column(c).take(of) for c in ("other", "cls")), *(pa.array(x[keep].astype(np.int32)) for x in (a0, a1, b0, b1))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(same[keep] / longer[keep], pa.float64())], ["a", "b", "a0", "a1", "b0", "b1", "similarity"])

    return align


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of each text that others share, by place, in the runs that can hold a chain.

    A match of a chain follows another within a gap, in both texts, so it lies in a
    run of such seeds that is as long as a chain.
    """
    for batch in batches:
        (place, sizes), value = _flat(batch.column("place")), _flat(batch.column("value"))[0]
        row = np.repeat(np.arange(len(sizes)), sizes)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(place) > GAP + SEED)]) if len(row) else np.empty(0, dtype=bool)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(row))[: len(start)]
        keep = np.repeat(place[end - 1] - place[start] + SEED >= LEAST_CHAIN, end - start)
        row, place, value = row[keep], place[keep], value[keep]
        order = np.lexsort((place, value, row))
        held = np.bincount(row, minlength=len(sizes))
        ends = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
        cols = [pa.ListArray.from_arrays(ends, pa.array(x[order], kind)) for x, kind in ((value, pa.int64()), (place, pa.int32()))]
        out = pa.RecordBatch.from_arrays([batch.column("cls"), *cols], ["cls", "value", "place"])
        yield out.filter(pa.array(held > 0))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, percent: int = 75) -> DataFrame:
    """(id, start, end, other_id, other_start, other_end, similarity): passages by words, end exclusive, between representatives, and copies with theirs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    seeded = written(rows.mapInArrow(_seeded, f"id {id_type}, n int, key binary, hashes array<long>, places array<int>").filter(F.col("n") >= least), "seeds")
    classes = seeded.groupBy("key").agg(F.min("id").alias("id"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))
    # numbers are fixed once they are written
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = written(seeded.select("id", "n", "key"), "members")
    named = written(classes.select("cls", "key", "id"), "named")
    drop(seeded)

    # a seed that one class has alone matches nothing; what others share goes on, with its places
    common = classes.select(F.explode(F.array_distinct("hashes")).alias("value")).groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    common = written(common.select("value"), "common")
    placed = classes.select("cls", F.posexplode("hashes").alias("at", "value"), "places").select("cls", "value", F.col("places")[F.col("at")].alias("place"))
    shared = placed.join(small(common), "value", "left_semi").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("s"))
    shared = shared.select("cls", F.col("s.place").alias("place"), F.col("s.value").alias("value"))
    seeds = written(shared.mapInArrow(_in_runs, "cls long, value array<long>, place array<int>"), "sorted")  # of one text
    drop(classes, common)
    short, long = candidates(seeds.select(F.col("cls").alias("id"), F.explode(F.array_distinct("value")).alias("value")))
    frequent = written(long.select("value").distinct(), "frequent")

    # chains of frequent seeds alone: two of them, so far apart that a chain has both
    # (all seeds of a chain that no short list has are frequent, and none is further from the next than a gap, in either text)
    in_text = Window.partitionBy("cls").orderBy("place")
    far = F.coalesce((F.col("place") - F.lag("place").over(in_text) > GAP + SEED).cast("int"), F.lit(0))
    each = seeds.select("cls", F.explode(F.arrays_zip("value", "place")).alias("s")).select("cls", "s.value", "s.place")
    held = each.join(small(frequent), "value").withColumn("far", far).withColumn("part", F.sum("far").over(in_text))
    held = held.groupBy("cls", "part").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("m"))
    apart = lambda x, y: (y["place"] - x["place"] >= LEAST_CHAIN - SEED) & (y["place"] - x["place"] <= REACH)
    couple = lambda x, y: F.struct(F.xxhash64(x["value"], y["value"]).alias("value"), x["place"].alias("first"), (y["place"] + SEED).alias("end"))
    onward = lambda x, i: F.slice("m", i + 2, F.lit(REACH))  # noqa: E731  places are distinct, so what REACH words hold is among so many
    couples = held.select("cls", F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(onward(x, i), lambda y: apart(x, y)), lambda y: couple(x, y))))).alias("c"))
    couples = written(couples.select(F.col("cls").alias("id"), "c.*"), "couples")
    drop(frequent)
    # one order of centres for all lists, so that a text meets few; what they leave goes on below
    more, long = candidates(couples.select("id", "value").distinct(), masks=1)
    pairs = written(short.union(more).distinct(), "pairs")
    drop(short, more)

    first = _confirmed(rows, named, seeds, pairs, least, percent)
    found, done = [first], pairs

    def held_against(places: DataFrame) -> DataFrame:
        """The passages of the holders at these places with x, of those pairs that have not been compared."""
        nonlocal done
        new = places.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        new = written(new, "rest")
        done = done.union(new)
        found.append(_confirmed(rows, named, seeds, new, least, percent))
        return reduce(DataFrame.union, found)

    # places of a frequent couple that no passage with its star's centre covers there
    stars = written(centres(long, masks=1), "stars")
    left = written(_uncovered(couples.join(small(stars), "value").filter(F.col("id") != F.col("x")), first), "uncovered")
    if not left.isEmpty():
        counts = written(left.groupBy("value").agg(F.count("*").alias("left")), "counts")
        every = written(couples.join(small(counts.select("value")), "value").select(*left.columns), "places")
        left = _settled(every, left, counts, held_against)
        others = long.join(small(left.select("value").distinct()), "value").select("value", F.col("id").alias("x"))
        held_against(left.select("value", "id").distinct().join(others, "value").filter("id <> x"))
        drop(counts, every)
    found = reduce(DataFrame.union, found)
    drop(seeds, couples, stars)

    ids = [named.select(F.col("cls").alias(s), F.col("id").alias(f"id_{s}")) for s in "ab"]
    passages = found.join(ids[0], "a").join(ids[1], "b").select(F.col("id_b").alias("id"), F.col("b0").alias("start"), F.col("b1").alias("end"), F.col("id_a").alias("other_id"), F.col("a0").alias("other_start"), F.col("a1").alias("other_end"), "similarity")
    copies = members.join(named.select("key", F.col("id").alias("other_id")), "key").filter(F.col("id") != F.col("other_id"))
    return passages.union(copies.select("id", F.lit(0), "n", "other_id", F.lit(0), "n", F.lit(1.0)).distinct())


def _uncovered(places: DataFrame, found: DataFrame) -> DataFrame:
    """(value, id, first, end): the places (value, id, first, end, x) of couples that no x of theirs has in its passages.

    It has a place if one passage with it covers it, or if one covers the first seed
    there and another the last: two seeds may lie further apart than a gap.
    """
    place = ["value", "id", "first", "end"]
    sides = ("a", "b", "a0", "a1"), ("b", "a", "b0", "b1")
    spans = reduce(DataFrame.union, (found.select(*(F.col(c).alias(n) for c, n in zip(side, ("of", "with", "start", "stop")))) for side in sides))
    same = (F.col("id") == F.col("of")) & (F.col("x") == F.col("with"))
    open_ = places.join(spans, same & (F.col("first") >= F.col("start")) & (F.col("end") <= F.col("stop")), "left_anti")
    covers = lambda at: F.coalesce(F.bool_or((at >= F.col("start")) & (at + SEED <= F.col("stop"))), F.lit(False))
    parts = open_.join(spans, same, "left").groupBy(*place, "x").agg((covers(F.col("first")) & covers(F.col("end") - SEED)).alias("has"))
    # a place is open if it is so with all x
    lost = parts.filter("not has").groupBy(*place).agg(F.count("*").alias("open"))
    if "among" not in places.columns:
        return lost.select(*place)
    among = places.select("value", "among").distinct()
    return lost.join(among, "value").filter("open = among").select(*place)


def _settled(every: DataFrame, left: DataFrame, counts: DataFrame, held_against: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(value, id, first, end): the places that are still in no passage with their list's largest star or what it holds.

    every: all places of the lists; left: those that the first star left; counts
    (value, left). A list of which most is left gets another star, as its centre
    may be an odd one. What is outside the larger star is held against up to
    CENTRES that are in it, so whatever has a passage with any of them is of the
    star's component, and need not be held against all.
    """
    place = ["value", "id", "first", "end"]
    sums = counts.join(every.groupBy("value").agg(F.count("*").alias("n")), "value")
    again = written(left.join(small(sums.filter(2 * F.col("left") > F.col("n")).select("value")), "value", "left_semi"), "again")
    if not again.isEmpty():
        second = written(again.groupBy("value").agg(_members(1).alias("x")).select("value", F.explode("x").alias("x")), "stars")
        beside = again.join(small(second), "value").filter(F.col("id") != F.col("x"))
        still = written(_uncovered(beside, held_against(beside)), "uncovered")
        now = again.groupBy("value").agg(F.count("*").alias("k")).join(still.groupBy("value").agg(F.count("*").alias("s")), "value", "left")
        larger = written(sums.join(now, "value").filter(F.col("k") - F.coalesce("s", F.lit(0)) > F.col("n") - F.col("left")).select("value"), "larger")
        of_larger = still.join(small(larger), "value", "left_semi").union(every.join(small(larger), "value", "left_semi").join(left, place, "left_anti"))
        left = written(left.join(small(larger), "value", "left_anti").union(of_larger), "uncovered")
    held = every.select("value", "id", F.lit(False).alias("out")).union(left.select("value", "id", F.lit(True)))
    inside = held.groupBy("value", "id").agg(F.bool_or("out").alias("out")).filter("not out").groupBy("value").agg(_members(CENTRES).alias("x"))
    inside = written(inside.select("value", F.size("x").alias("among"), F.explode("x").alias("x")), "inside")
    beside = left.join(small(inside), "value")
    still = _uncovered(beside, held_against(beside))
    alone = left.join(small(inside.select("value").distinct()), "value", "left_anti")
    return written(still.union(alone), "uncovered")


def _members(n: int) -> Column:
    """Up to n of a group's ids: the least under each of so many masks, which are those of all lists."""
    masks = [F.xxhash64(F.lit(-1 - i)) for i in range(n)]
    return F.array_distinct(F.array(*(F.min(F.col("id").bitwiseXOR(m)).bitwiseXOR(m) for m in masks)))


def _confirmed(rows: DataFrame, named: DataFrame, seeds: DataFrame, pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b, a0, a1, b0, b1, similarity): the passages of these pairs of classes."""
    sides = [seeds.select(F.col("cls").alias(s), F.col("value").alias(f"h{s}"), F.col("place").alias(f"p{s}")) for s in "ab"]
    matched = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "pa", "hb", "pb")
    def schema(columns: dict[str, str]) -> str:
        return ", ".join(f"{c} {kind}" for c, kind in columns.items())

    chained = written(matched.mapInArrow(_chained, schema({"a": "long", "b": "long", **CHAIN})), "chains")

    # a text is read once, whatever chains it has
    windows = chained.select(F.col("a").alias("cls"), F.col("p").alias("first"), F.col("p1").alias("last")).union(chained.select("b", "q", "q1")).distinct().groupBy("cls").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    wanted = written(windows.join(named, "cls").select("cls", "key", F.col("id").alias("source"), "windows"), "windows")
    texts = rows.join(small(wanted.select("source").distinct()), F.col("id").eqNullSafe(F.col("source")), "left_semi")
    beside = texts.join(small(wanted), F.col("source").eqNullSafe(F.col("id"))).select("cls", "key", "windows", "text")
    pieces = written(beside.mapInArrow(_pieces, "cls long, start int, words array<long>"), "pieces")

    def met(chains: DataFrame) -> DataFrame:
        """Chains by cls, after the pieces of its text."""
        more = {c: (F.array() if kind.startswith("array") else F.lit(None)).cast(kind) for c, kind in SIDES.items() if c not in ("cls", "p", "words")}
        both = pieces.withColumnRenamed("start", "p").withColumns(more).select(*SIDES).union(chains.select(*SIDES))
        return both.repartition("cls").sortWithinPartitions("cls", F.col("other").isNotNull(), "p")

    # first with a, whose words then go to b
    of_a = chained.withColumnsRenamed({"a": "cls", "b": "other"}).withColumn("words", F.array().cast("array<long>"))
    cut = met(of_a).mapInArrow(_cut, schema(SIDES))
    found = met(cut).mapInArrow(_aligned(least, percent), "a long, b long, a0 int, a1 int, b0 int, b1 int, similarity double")
    found = written(found.distinct(), "passages")
    drop(chained, wanted, pieces)
    return found
