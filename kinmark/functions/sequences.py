"""Exact distances of two sequences, bit-parallel over whole numbers of any length."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np


def _positions(a: Sequence[Hashable]) -> dict[Hashable, int]:
    out: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence; a None in either matches nothing."""
    if not a or not b:
        return 0
    where, full = _positions(a), (1 << len(a)) - 1
    where.pop(None, None)
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], limit: int | None = None) -> int:
    """Levenshtein distance with unit costs; a None in either matches nothing. Where it exceeds the limit, some number above it."""
    m = len(a)
    if not m or not len(b):
        return m or len(b)
    where, full, top = _positions(a), (1 << m) - 1, 1 << m - 1
    where.pop(None, None)
    plus, minus, score = full, 0, m
    rest = len(b)
    for x in b:
        if limit is not None and score - rest > limit:  # each column takes one off at most
            return limit + 1
        rest -= 1
        eq = where.get(x, 0)
        xv = eq | minus
        xh = (eq & plus) + plus ^ plus | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph = ph << 1 | 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
    return score


#: Pairs that one vectorised pass handles, with limits and without; kinds of values beyond which a pass is left to the plain functions.
_PASS, _PASS_ALL, _KINDS_MOST = 1024, 512, 1024
#: Costs in microseconds of a column: of a numpy step and of each pair in it, per block of 64 rows; of the plain function, and of each block in it.
_STEP, _PAIR, _PLAIN, _PLAIN_BLOCK = 20.0, 0.03, 1.35, 0.01
#: Columns between two looks at whether a pair can still end within its limit.
_LOOK = 24


def edit_distances(a: Sequence[str], b: Sequence[str], limit: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of many pairs of strings at once; where one exceeds its limit, some number above the limit.

    The bit-parallel recurrence runs over blocks of 64 rows, each step for thousands of pairs together; pairs of similar
    length share a pass.
    """
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]) if len(a) else ((), ())
    n = np.array([len(x) for x in b], np.int64)
    blocks = np.array([len(x) for x in a], np.int64) // 64
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((n, blocks))
    size = _PASS_ALL if limit is None else _PASS
    for lo in range(0, len(order), size):
        part = order[lo : lo + size]
        most = int(blocks[part[-1]]) + 1
        if len(part) * (_PLAIN + _PLAIN_BLOCK * most) < most * (_STEP + _PAIR * len(part)):  # few pairs or long ones
            out[part] = [edit_distance(a[i], b[i], None if limit is None else int(limit[i])) for i in part]
        else:
            out[part] = _edit_pass([a[i] for i in part], [b[i] for i in part], None if limit is None else np.asarray(limit)[part])
    return out


def _padded(texts: list[str], size: np.ndarray) -> np.ndarray:
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _edit_pass(a: list[str], b: list[str], limit: np.ndarray | None) -> np.ndarray:
    m = np.array([len(x) for x in a], np.int64)
    n = np.array([len(x) for x in b], np.int64)
    x, y = _padded(a, m), _padded(b, n)
    seen = np.zeros(max(int(x.max(initial=0)), int(y.max(initial=0))) + 2, bool)  # a table instead of a sort; -1 pads
    seen[x + 1], seen[y + 1] = True, True
    kinds = np.flatnonzero(seen)
    if len(kinds) > _KINDS_MOST:
        return np.array([edit_distance(p, q) for p, q in zip(a, b)], np.int64)
    number = np.zeros(len(seen), np.int64)
    number[kinds] = np.arange(len(kinds))
    x, y = number[x + 1], number[y + 1]
    rows, one = np.arange(len(a)), np.uint64(1)
    blocks = max(1, -(-int(m.max(initial=0)) // 64))
    # where each kind of value stands in a: a bit per place
    where = np.zeros((blocks, len(kinds), len(a)), np.uint64)
    for i in range(x.shape[1]):
        live = i < m
        r = rows[live]
        where[i // 64, x[live, i], r] |= one << np.uint64(i % 64)
    full, none, top = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), np.uint64(63)
    plus, minus = [np.full(len(a), full) for _ in range(blocks)], [np.zeros(len(a), np.uint64) for _ in range(blocks)]
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    score, out, lengths = m.copy(), np.where(n == 0, m, 0), (m, n)
    ids, columns = rows, np.ascontiguousarray(y.T)
    flat, ending = where.reshape(blocks, -1), [np.flatnonzero(last == k) for k in range(blocks)]
    for j in range(y.shape[1]):
        up, down = np.ones(len(rows), np.uint64), np.zeros(len(rows), np.uint64)  # the step into the first row is +1
        place = columns[j] * len(rows) + rows
        for k in range(blocks):
            p, q = plus[k], minus[k]
            eq = flat[k].take(place)
            xv = eq | q
            eq |= down
            xh = ((eq & p) + p ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            e = ending[k]
            if len(e) == len(rows):
                score += (ph >> bit & one).view(np.int64) - (mh >> bit & one).view(np.int64)
            elif len(e):
                score[e] += (ph[e] >> bit[e] & one).view(np.int64) - (mh[e] >> bit[e] & one).view(np.int64)
            up_next, down_next = ph >> top, mh >> top
            ph, mh = ph << one | up, mh << one | down
            plus[k], minus[k] = mh | ~(xv | ph), ph & xv
            up, down = up_next, down_next
        done = n == j + 1
        out[ids[done]] = score[done]
        if limit is not None and j % _LOOK == _LOOK - 1:
            low = _least_end(plus, minus, m, n, j + 1)
            over = (low > limit) & (n > j + 1)
            out[ids[over]] = limit[over] + 1
            keep = ~over & (n > j + 1)
            if not keep.any():
                break
            if keep.sum() < 0.75 * len(keep):
                ids, m, n, limit = ids[keep], m[keep], n[keep], limit[keep]
                last, bit, score, where = last[keep], bit[keep], score[keep], np.ascontiguousarray(where[:, :, keep])
                columns, flat = np.ascontiguousarray(columns[:, keep]), where.reshape(blocks, -1)
                ending = [np.flatnonzero(last == k) for k in range(blocks)]
                plus, minus = [p[keep] for p in plus], [q[keep] for q in minus]
                rows = np.arange(len(ids))
    out[lengths[0] == 0] = lengths[1][lengths[0] == 0]
    return out


def _least_end(plus: list[np.ndarray], minus: list[np.ndarray], m: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
    """The least distance that pairs can end with after j columns: the best row of the column, then a straight way."""
    bits = lambda parts: np.unpackbits(np.stack(parts, 1).view(np.uint8), axis=1, bitorder="little").view(np.int8)
    rows = 64 * len(plus)
    kind = np.int16 if 2 * rows + j + int(n.max(initial=0)) <= np.iinfo(np.int16).max else np.int64  # what a sum may come to
    column = np.cumsum(bits(plus) - bits(minus), axis=1, dtype=kind) + kind(j)
    row = np.arange(1, rows + 1, dtype=kind)
    left = (m - (n - j)).astype(kind)[:, None]
    end = column + np.abs(left - row)
    end[row[None, :] > m[:, None]] = np.iinfo(kind).max
    return np.minimum(end.min(1).astype(np.int64), j + np.abs(m - (n - j)))


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs of strings at once, as ``edit_distances`` works."""
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]) if len(a) else ((), ())
    n = np.array([len(x) for x in b], np.int64)
    blocks = np.array([len(x) for x in a], np.int64) // 64
    out = np.zeros(len(a), np.int64)
    order = np.lexsort((n, blocks))
    for lo in range(0, len(order), _PASS_ALL):
        part = order[lo : lo + _PASS_ALL]
        most = int(blocks[part[-1]]) + 1
        x, y = [a[i] for i in part], [b[i] for i in part]
        plain = len(part) * (_PLAIN + _PLAIN_BLOCK * most) < 2 * most * (_STEP + _PAIR * len(part)) / 3  # a step has fewer parts than one of distances
        found = None if plain else _lcs_pass(x, y)
        out[part] = [lcs_length(p, q) for p, q in zip(x, y)] if found is None else found
    return out


def _lcs_pass(a: list[str], b: list[str]) -> np.ndarray | None:
    """Nothing where there are too many kinds of characters for a table."""
    m, n = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    x, y = _padded(a, m), _padded(b, n)
    seen = np.zeros(max(int(x.max(initial=0)), int(y.max(initial=0))) + 2, bool)
    seen[x + 1], seen[y + 1] = True, True
    kinds = np.flatnonzero(seen)
    if len(kinds) > _KINDS_MOST:
        return None
    number = np.zeros(len(seen), np.int64)
    number[kinds] = np.arange(len(kinds))
    y = np.where(y < 0, len(kinds), number[y + 1])  # padding meets an empty mask, which changes nothing
    x = number[x + 1]
    rows, one = np.arange(len(a)), np.uint64(1)
    blocks = max(1, -(-int(m.max(initial=0)) // 64))
    where = np.zeros((blocks, len(kinds) + 1, len(a)), np.uint64)
    for i in range(x.shape[1]):
        live = i < m
        where[i // 64, x[live, i], rows[live]] |= one << np.uint64(i % 64)
    v = [np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(blocks)]
    columns, flat = np.ascontiguousarray(y.T), where.reshape(blocks, -1)
    for j in range(y.shape[1]):
        carry = np.zeros(len(a), np.uint64)
        place = columns[j] * len(a) + rows
        for k in range(blocks):
            u = v[k] & flat[k].take(place)
            s = v[k] + u
            over = s < u
            t = s + carry
            carry = (over | (t < s)).astype(np.uint64)
            v[k] = t | (v[k] - u)
    zeros = np.zeros(len(a), np.int64)
    for k in range(blocks):
        zeros += 64 - np.bitwise_count(v[k])
    return zeros


def as_texts(a: Sequence, b: Sequence) -> tuple[list[str], list[str]]:
    """Sequences of codes as strings of characters that are equal where codes are; None and nan match nothing.

    Only equality between a sequence of ``a`` and one of ``b`` is kept, which is all that distances ask for.
    """
    flat = [x for part in (a, b) for s in part for x in s]
    number: dict = {}
    for x in flat:
        if x is not None and x == x:
            number.setdefault(x, 2 + len(number))
    char = [chr(0x100 + i if i < 0xD600 else 0x2100 + i) for i in range(2 + len(number))]  # surrogates are left out
    side = lambda part, none: ["".join([char[number[x] if x is not None and x == x else none] for x in s]) for s in part]
    return side(a, 0), side(b, 1)
