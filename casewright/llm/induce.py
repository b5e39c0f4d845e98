"""Induced sorting of suffixes with their common prefixes, a bucket of tuples at a time (used inside tasks).

Suffixes are told apart by their first ``cap`` symbols; common prefixes are counted up to ``cap``. A suffix is small if it
stands before the one that follows it in the text, else large; a seed is a small suffix after a large one. Seeds are sorted
first; they induce the large suffixes by ascending buckets of first symbols, and these the small ones by descending buckets.
A queue holds, for each bucket, the tuples (start, common prefix with the tuple before) that earlier buckets pushed; a whole
bucket is popped, and what it induces is pushed, in one go.
"""

from __future__ import annotations

import numpy as np

#: Sets the last symbols of eight, all but the first k; and all bits but those of the last symbol.
_FILL = np.array([(1 << 8 * (8 - k)) - 1 for k in range(9)], np.uint64)
_LOW = ~np.uint64(255)


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are small, and how many equal symbols each begins with. t ends with a symbol less than all others."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, n - 1)
    run = np.diff(np.concatenate(([-1], ends)))
    rises = np.append(t[change] < t[change + 1], True)
    small = np.repeat(rises, run)
    left = np.repeat(ends, run) - np.arange(n) + 1
    return small, left


class _Least:
    """The least value between two places of a sequence, by a table of powers of two."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows, k = [values], 1
        while 2 * k <= widest:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both included."""
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        if len(self.rows) == 1 or not len(lo):
            return self.rows[0][lo]
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k) + 1])
        return out


def _steps(lcp: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of what the entries ``at`` of a sequence induce in one bucket, each with the one before (the first: 0)."""
    if len(at) < 2:
        return np.zeros(len(at), lcp.dtype)
    least = _Least(lcp, int(np.diff(at).max())).between(at[:-1] + 1, at[1:])
    return np.concatenate((np.zeros(1, lcp.dtype), np.minimum(least + 1, cap).astype(lcp.dtype)))


class _Queue:
    """Tuples by bucket, in the order in which they were pushed."""

    def __init__(self, symbols: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]

    def push(self, starts: np.ndarray, symbols: np.ndarray, lcp: np.ndarray, at: np.ndarray, cap: int) -> None:
        """starts: suffixes induced by the entries ``at`` of a sequence with common prefixes lcp; symbols: their first ones."""
        if not len(starts):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, starts, at = symbols[order], starts[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        common = np.zeros(len(at), lcp.dtype)
        inner = np.ones(len(at), bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        if len(inner):
            lo, hi = at[inner - 1] + 1, at[inner]
            common[inner] = np.minimum(_Least(lcp, int((hi - lo).max()) + 1).between(lo, hi) + 1, cap)
        # what another bucket pushed begins with another second symbol
        common[first] = 1
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            self.held[symbols[lo]].append((starts[lo:hi], common[lo:hi]))

    def pop(self, symbol: int, kind) -> tuple[np.ndarray, np.ndarray]:
        parts, self.held[symbol] = self.held[symbol], []
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, kind)
        starts, common = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        common[0] = 0
        return starts, common


def _bucket(t, starts, lcp, symbol, cap):
    """A popped bucket with what it induces in itself: rounds of starts - 1 with the same symbol. Returns starts, lcp."""
    all_starts, all_lcp, rounds = [starts], [lcp], 0
    while len(starts):
        back = starts - 1
        at = np.flatnonzero((t[back] == symbol) & (starts > 0))
        if not len(at):
            break
        rounds += 1
        lcp = _steps(lcp, at, cap)
        lcp[0] = min(rounds, cap)
        starts = back[at]
        all_starts.append(starts)
        all_lcp.append(lcp)
    return (np.concatenate(all_starts), np.concatenate(all_lcp)) if rounds else (all_starts[0], all_lcp[0])


def induce(t: np.ndarray, seeds: np.ndarray, common: np.ndarray, left: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with common prefixes, from the seeds in order and theirs. The last symbol's suffix is the first seed."""
    n, symbols = len(t), int(t.max()) + 1
    kind = common.dtype
    first = t[seeds]
    cuts = np.searchsorted(first, np.arange(symbols + 1))
    queue, large = _Queue(symbols), []
    for c in range(symbols):
        starts, lcp = _bucket(t, *queue.pop(c, kind), c, cap)
        large.append((starts, lcp))
        s, l = seeds[cuts[c] : cuts[c + 1]], common[cuts[c] : cuts[c + 1]].copy()
        if len(s):
            # a large suffix and a seed differ where the shorter run of their first symbol ends
            l[0] = min(int(min(left[starts[-1]], left[s[0]])), cap) if len(starts) else 0
            starts, lcp = np.concatenate((starts, s)), np.concatenate((lcp, l))
        if len(starts):
            back = np.maximum(starts - 1, 0)
            d = t[back]
            at = np.flatnonzero((d > c) & (starts > 0))
            queue.push(back[at], d[at], lcp, at, cap)
    queue, out = _Queue(symbols), []
    for c in range(symbols - 1, -1, -1):
        starts, lcp = queue.pop(c, kind)
        if c == 0:
            starts, lcp = np.array([n - 1], np.int32), np.zeros(1, kind)
        # descending: each entry's common prefix is with the one before, the next larger suffix
        starts, lcp = _bucket(t, starts, lcp, c, cap)
        big, common_big = large[c]
        down = np.append(common_big[1:], np.zeros(1, kind))[::-1] if len(big) else common_big
        if len(starts) and len(big):
            down = down.copy()
            down[0] = min(int(min(left[starts[-1]], left[big[-1]])), cap)
        starts, lcp = np.concatenate((starts, big[::-1])), np.concatenate((lcp, down))
        out.append((starts, lcp))
        if len(starts):
            back = np.maximum(starts - 1, 0)
            d = t[back]
            at = np.flatnonzero((d < c) & (starts > 0))
            queue.push(back[at], d[at], lcp, at, cap)
        large[c] = None
    order, lcp = np.concatenate([x[0] for x in out])[::-1], np.concatenate([x[1] for x in out])
    # from "with the next larger" to "with the next smaller"
    return order, np.concatenate((np.zeros(1, kind), lcp[1:][::-1]))


def _sort_seeds(t: np.ndarray, seeds: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in order of their suffixes (by ``cap`` symbols at least) and their common prefixes.

    The pieces from seed to seed are sorted and named, and the text of names is sorted by doubling, where only names that
    still stand for several suffixes are looked at again.
    """
    m = len(seeds)
    size = np.append(np.diff(seeds) + 1, 1)
    eight = _eights(t)
    rank, depth, todo = np.zeros(m, np.int64), 0, np.arange(m)
    # names: pieces by seven symbols at a time; a piece that ends (in a small suffix) stands after one that goes on (in a large one)
    while len(todo):
        keep = np.clip(size[todo] - depth, 0, 8)
        key = (eight[np.minimum(seeds[todo] + depth, len(t) - 1)] | _FILL[np.minimum(keep, 7)]) & _LOW | (8 - keep).astype(np.uint64)
        order = np.lexsort((key, rank[todo])) if depth else np.argsort(key)
        todo, key = todo[order], key[order]
        size_of, rank[todo], _ = _regroup(rank[todo], key)
        todo = todo[(size_of > 1) & (size[todo] > depth + 7)]
        depth += 7
    # doubling over names: of each group that a name still stands for, by the name ``step`` places on
    reach, step, order = size - 1, 1, np.argsort(rank)
    slots, low = np.arange(m), np.zeros(m, np.int64)
    while True:
        r = rank[order[slots]]
        same = np.concatenate((r[1:] == r[:-1], [False]))
        slots = slots[same | np.concatenate(([False], same[:-1]))]
        todo = order[slots]
        slots = slots[(reach[todo] < cap) & (todo + step < m)]
        if not len(slots):
            break
        todo = order[slots]
        key = rank[todo] * (m + 1) + rank[todo + step]
        o = np.argsort(key)
        todo = todo[o]
        order[slots] = todo
        _, new, split = _regroup(rank[todo], key[o])
        # neighbours that part here have ``step`` names in common
        low[slots[split]] = reach[todo[split]]
        far = reach.copy()
        far[: m - step] += reach[step:]
        rank[todo] = new
        reach, step = far, 2 * step
    r = rank[order]
    low[1:][r[1:] == r[:-1]] = cap
    seeds = seeds[order].astype(np.int32)
    return seeds, _common(eight, seeds, low, cap)


def _eights(t: np.ndarray) -> np.ndarray:
    """At each place the eight symbols from there as one number, zeros after the end."""
    out = np.concatenate((t, np.zeros(8, t.dtype))).astype(np.uint64)
    for k in (1, 2, 4):
        out = out[:-k] << np.uint64(8 * k) | out[k:]
    return out[: len(t)]


def _regroup(old: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the groups of equal (old, key), both in order; their names: the old one's and those that stand before in it; where old ones split."""
    n = len(old)
    first = np.concatenate(([True], old[1:] != old[:-1]))
    new = first | np.concatenate(([True], key[1:] != key[:-1]))
    starts, base = np.flatnonzero(new), np.flatnonzero(first)
    count = np.diff(np.append(starts, n))
    before = starts - base[np.cumsum(first)[starts] - 1]
    return np.repeat(count, count), old + np.repeat(before, count), np.flatnonzero(new & ~first)


def _common(eight: np.ndarray, order: np.ndarray, low: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours in order, up to cap, by comparing eight symbols at a time; ``low`` of them are known to be equal."""
    out = np.minimum(low, cap)
    n = len(eight) - 1
    todo = np.flatnonzero(out < cap)[1:] if len(out) and out[0] < cap else np.flatnonzero(out < cap)
    at, depth = order[todo] + out[todo], out[todo]
    far = order[todo - 1] - order[todo]
    while len(todo):
        x = eight[np.minimum(at, n)] ^ eight[np.minimum(at + far, n)]
        differ = np.flatnonzero(x)
        v = x[differ]
        lead = sum(((v >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8))
        out[todo[differ]] = depth[differ] + lead
        go = np.flatnonzero((x == 0) & (depth + 8 < cap))
        done = (x == 0) & (depth + 8 >= cap)
        out[todo[done]] = cap
        todo, at, depth, far = todo[go], at[go] + 8, depth[go] + 8, far[go]
    return np.minimum(out, cap).astype(np.int16)


def suffixes(parts: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes of the parts, laid end to end with one byte between them, in order, and common prefixes.

    Bytes 254 and 255, which UTF-8 never holds, are not told apart.
    """
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    t = np.where(joined == 255, 1, np.minimum(joined, 253).astype(np.int64) + 2).astype(np.uint8)
    t = np.append(t, np.uint8(0))
    small, left = _types(t)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds, common = _sort_seeds(t, seeds, cap)
    return induce(t, seeds, common, left, cap)
