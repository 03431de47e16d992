"""Every sequence of one list against every one of another: matching places, common subsequences and distances as matrices.

Sequences are whole numbers, -1 for an element that matches nothing, all in one array with their sizes. Sequences of similar
length are worked on together, so that a step is a few operations on some thousands of machine words.
"""

from __future__ import annotations

import numpy as np

from .sequences import edit_distance, lcs_length

#: Words that one step works on, bytes of the table of places that a chunk of sequences may have, and elements of a batch.
_WORDS, _TABLE_MOST, _COLUMNS_MOST = 8192, 64 << 20, 1 << 22
#: Rows of a tile of matching places.
_TILE = 64
_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FULL_63, _TOP = np.uint64(0x7FFFFFFFFFFFFFFF), np.uint64(63)


class _Columns:
    """Sequences, the longest first, by place: ``at(p)`` has the p-th elements of those that reach so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        longest = int(self.sizes[0]) if len(sizes) else 0
        self.count = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(longest), side="right")
        self.start = np.cumsum(self.count) - self.count
        ends = np.cumsum(self.sizes)
        self.place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - self.sizes, self.sizes)
        self.row = np.repeat(np.arange(len(sizes)), self.sizes)
        self.ids = ids[np.repeat((np.cumsum(sizes) - sizes)[self.order], self.sizes) + self.place]  # sequence by sequence
        self.flat = np.empty_like(self.ids)
        self.flat[self.start[self.place] + self.row] = self.ids

    def at(self, p: int, lo: int, hi: int) -> np.ndarray:
        return self.flat[self.start[p] + lo : self.start[p] + min(hi, self.count[p])]

    def sequence(self, i: int) -> list[int | None]:
        lo = int(self.sizes[:i].sum())
        return [x if x >= 0 else None for x in self.ids[lo : lo + int(self.sizes[i])].tolist()]


def matches(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Number of places with equal elements."""
    kinds = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    kind = np.uint8 if kinds <= 254 else np.uint16 if kinds <= 65534 else np.uint32
    x, y = _Columns(np.where(a < 0, kinds, a).astype(kind), n), _Columns(np.where(b < 0, kinds + 1, b).astype(kind), m)
    found = np.zeros((len(n), len(m)), np.int32)
    equal, part = np.empty((_TILE, len(m)), bool), np.zeros((_TILE, len(m)), np.uint8)
    shortest = len(y.count)
    for lo in range(0, len(n), _TILE):
        hi = min(len(n), lo + _TILE)
        for p in range(min(int(x.sizes[lo]), shortest)):
            u, v = x.at(p, lo, hi), y.at(p, 0, len(m))
            e = np.equal(u[:, None], v[None, :], out=equal[: len(u), : len(v)])
            part[: len(u), : len(v)] += e.view(np.uint8)
            if p % 255 == 254:
                found[lo:hi] += part[: hi - lo]
                part[:] = 0
        found[lo:hi] += part[: hi - lo]
        part[:] = 0
    out = np.empty_like(found)
    out[np.ix_(x.order, y.order)] = found
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The numbers that both sides have, from 0 on; the others match nothing."""
    kinds = int(max(a.max(initial=-1), b.max(initial=-1))) + 2
    both = (np.bincount(a + 1, minlength=kinds) > 0) & (np.bincount(b + 1, minlength=kinds) > 0)
    both[0] = False
    number = np.where(both, np.cumsum(both) - 1, -1)
    return number[a + 1], number[b + 1], int(both.sum())


def _live(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sequences with an element that may match."""
    return np.flatnonzero(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ids >= 0], minlength=len(sizes)))


def _part(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.zeros(len(sizes), bool)
    k[rows] = True
    return ids[np.repeat(k, sizes)], sizes[rows]


def _grid(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, out: np.ndarray, bits: int, run, plain) -> np.ndarray:
    """Fills in the pairs that have something in common; ``run`` works on a table of places and the elements that it meets."""
    a, b, kinds = _shared(a, b)
    rows, cols = _live(a, n), _live(b, m)
    if not len(rows) or not len(cols):
        return out
    x, y = _Columns(*_part(a, n, rows)), _Columns(*_part(b, m, cols))
    rows, cols = rows[x.order], cols[y.order]
    words = -(-x.sizes // bits)
    starts = np.concatenate([[0], np.cumsum(x.sizes)])
    lo = 0
    while lo < len(rows):
        most = int(words[lo])
        room = _TABLE_MOST // (8 * most * (kinds + 1))
        if not room:  # long and of very many kinds
            u = x.sequence(lo)
            out[rows[lo], cols] = [plain(u, y.sequence(j)) for j in range(len(cols))]
            lo += 1
            continue
        hi = min(len(rows), lo + room, lo + max(1, _WORDS // most), lo + int(np.searchsorted(-words[lo:], -(most * 3 // 4), side="right")) if most > 1 else len(rows))
        count = hi - lo
        table = np.zeros((most, kinds + 1, count), np.uint64)
        k = slice(starts[lo], starts[hi])
        ids, place, row = x.ids[k], x.place[k], x.row[k] - lo
        some = ids >= 0
        ids, place, row = ids[some], place[some], row[some]
        np.add.at(table.reshape(-1), ((place // bits) * (kinds + 1) + ids) * count + row, _ONE << (place % bits).astype(np.uint64))
        step = min(max(1, _WORDS // (count * most)), max(1, _COLUMNS_MOST // int(y.sizes[0])))
        for at in range(0, len(cols), step):
            end = min(len(cols), at + step)
            out[np.ix_(rows[lo:hi], cols[at:end])] = run(table, x.sizes[lo:hi], y, at, end).T
        lo = hi
    return out


class _Run:
    """The walk of a batch of sequences over a table of places: word k meets column t - k in step t, so that all words are worked on at once.

    Sequences end together, the longest starts first; a word that has not been reached meets columns of nothing.
    """

    def __init__(self, table: np.ndarray, y: _Columns, lo: int, hi: int):
        self.words, self.kinds, self.count = table.shape
        self.size = y.sizes[lo:hi]
        self.many = hi - lo
        self.longest = int(self.size[0])
        k = slice(int(y.sizes[:lo].sum()), int(y.sizes[:hi].sum()))
        self.columns = np.full((self.longest, self.many), self.kinds - 1)
        ids = y.ids[k]
        row = y.row[k] - lo
        self.columns[self.size[row] - 1 - y.place[k], row] = np.where(ids < 0, self.kinds - 1, ids)  # from the end
        self.table = table.reshape(-1, self.count)

    def array(self, value: np.uint64, more: int = 0) -> np.ndarray:
        return np.full((self.words + more, self.many, self.count), value)

    def steps(self):
        """(first word, end of words, live sequences, where the elements of the columns stand)"""
        live = self.many - np.searchsorted(self.size[::-1], np.arange(self.longest), side="right")
        base = (np.arange(self.words) * self.kinds)[:, None]
        room = np.empty(self.words * self.many * self.count, np.uint64)
        for t in range(self.longest + self.words - 1):
            lo, hi = max(0, t - self.longest + 1), min(self.words, t + 1)
            first = self.longest - 1 - t
            n = int(live[max(0, first)])
            at = self.columns[first + lo : first + hi, :n] + base[lo:hi]
            g = room[: (hi - lo) * n * self.count].reshape(hi - lo, n, self.count)
            self.table.take(at, axis=0, out=g, mode="clip")
            yield lo, hi, n, g


def _common(table: np.ndarray, n: np.ndarray, y: _Columns, lo: int, hi: int) -> np.ndarray:
    run = _Run(table, y, lo, hi)
    state, sums, carry = run.array(_FULL_63), run.array(_FULL), run.array(np.uint64(0), 1)
    one = run.words == 1
    for lo, hi, live, g in run.steps():
        v, t = state[lo:hi, :live], sums[lo:hi, :live]
        g &= v
        np.add(v, g, out=t)
        if not one:
            t += carry[lo:hi, :live]
            np.right_shift(t, _TOP, out=carry[lo + 1 : hi + 1, :live])
        v ^= g
        v |= t
        v &= _FULL_63
    return (63 - np.bitwise_count(state).astype(np.int32)).sum(0, dtype=np.int32)


def _edits(table: np.ndarray, n: np.ndarray, y: _Columns, lo: int, hi: int) -> np.ndarray:
    run = _Run(table, y, lo, hi)
    size = run.size
    plus, minus, work = run.array(_FULL), run.array(np.uint64(0)), run.array(_FULL)
    # what the word above had in its last row: a step down along the row, no step up; before the first row there are steps up only
    down, level, down_next, level_next = (run.array(x, 1) for x in (np.uint64(0), _ONE) * 2)
    level[0], level_next[0] = 0, 0
    one = run.words == 1
    for lo, hi, live, g in run.steps():
        p, q, t = plus[lo:hi, :live], minus[lo:hi, :live], work[lo:hi, :live]
        if not one:
            d = down[lo:hi, :live]
            g |= d
        g |= q
        np.bitwise_and(g, p, out=t)
        t += p
        t ^= p
        t |= g  # no step along the diagonal
        np.bitwise_or(t, p, out=g)
        g ^= q  # no step up along the row
        p &= t  # a step down along the row
        if not one:
            np.right_shift(p, _TOP, out=down_next[lo + 1 : hi + 1, :live])
            np.right_shift(g, _TOP, out=level_next[lo + 1 : hi + 1, :live])
        g += g
        p += p
        if not one:
            g |= level[lo:hi, :live]
            p |= d
        np.bitwise_and(t, g, out=q)
        g ^= q
        p |= g
        q ^= t
        down, level, down_next, level_next = down_next, level_next, down, level
    held = np.clip(n - 64 * np.arange(run.words)[:, None], 0, 64)
    mask = np.where(held == 64, _FULL, (_ONE << np.minimum(held, 63).astype(np.uint64)) - _ONE)[:, None, :]
    step = np.bitwise_count(plus & mask).astype(np.int32) - np.bitwise_count(minus & mask)
    return size[:, None] + step.sum(0, dtype=np.int32)


def lcs(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    return _grid(a, n, b, m, np.zeros((len(n), len(m)), np.int32), 63, _common, lcs_length)


def edits(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Levenshtein distances with unit costs."""
    return _grid(a, n, b, m, np.maximum(n[:, None], m[None, :]).astype(np.int32), 64, _edits, edit_distance)
