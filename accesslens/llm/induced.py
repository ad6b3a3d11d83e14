"""Suffix arrays by induced sorting, in numpy."""

from __future__ import annotations

import numpy as np

#: A reduced string with more names than this has too short buckets to be worth a pass each; its suffixes are ranked by doubling.
MANY_NAMES = 2048


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end of the string counts as smallest."""
    n = len(s)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = -1
    # Within a run of equal symbols the type is that of the step that ends it.
    turn = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(turn[::-1])[::-1]] > 0


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions that are smaller than the next and follow one that is not."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order ``seeds``.

    A bucket is all suffixes with one first symbol. Buckets are filled by two passes over the buckets; all
    predecessors that one part of a bucket yields are placed with a few array operations.
    """
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    seed: list[np.ndarray | None] = [None] * symbols
    for c, part in by_symbol(seeds, s):
        seed[c] = part

    def place(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        for c, part in by_symbol(found, s):
            into[c].append(part)

    def before(part: np.ndarray, kind: bool) -> np.ndarray:
        prior = part[part > 0] - 1
        return prior[smaller[prior] == kind]

    last = np.array([len(s) - 1])
    place(last, larger)
    done: list[np.ndarray | None] = [None] * symbols
    for c in range(symbols):
        at = 0
        while at < len(larger[c]):  # a run of the symbol itself keeps adding to its bucket
            place(before(larger[c][at], False), larger)
            at += 1
        if larger[c]:
            done[c] = np.concatenate(larger[c])
        if seed[c] is not None:
            place(before(seed[c], False), larger)
    small: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        at = 0
        while at < len(small[c]):
            place(before(small[c][at], True), small)
            at += 1
        if done[c] is not None:
            place(before(done[c][::-1], True), small)
    order = []
    for c in range(symbols):
        if done[c] is not None:
            order.append(done[c])
        if small[c]:
            order.append(np.concatenate(small[c])[::-1])
    return np.concatenate(order)


def by_symbol(positions: np.ndarray, s: np.ndarray):
    """``positions`` split by their symbol, in their order."""
    if len(positions) < 2:
        return [(int(s[positions[0]]), positions)] if len(positions) else []
    own = s[positions]
    order = np.argsort(own, kind="stable")
    own = own[order]
    cut = np.flatnonzero(own[1:] != own[:-1]) + 1
    return zip(own[np.concatenate(([0], cut))].tolist(), np.split(positions[order], cut), strict=True)


def names_of(s: np.ndarray, ordered: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal names for equal substrings between neighbouring marks, in text order, by their sorted order."""
    end = np.append(marks[1:], len(s) - 1)
    where = np.searchsorted(marks, ordered)
    length = end[where] - ordered
    same = np.zeros(len(ordered), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    offset = 0
    while len(pair):
        a, b = ordered[pair], ordered[pair - 1]
        pair = pair[s[a + offset] == s[b + offset]]
        full = length[pair] == offset
        same[pair[full]] = True
        pair = pair[~full]
        offset += 1
    # The last mark runs to the end of the text, which no other does.
    same &= (ordered != marks[-1]) & np.concatenate(([True], ordered[:-1] != marks[-1]))
    name = np.cumsum(~same) - 1
    out = np.empty(len(marks), np.int64)
    out[where] = name
    return out, int(name[-1]) + 1


def doubled(s: np.ndarray) -> np.ndarray:
    """Suffix order by ranks of prefixes of doubling length."""
    n, reach = len(s), 1
    rank = s.astype(np.int64) + 1
    while True:
        key = rank * (n + 2)
        key[: n - reach] += rank[reach:]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        if new[-1] == n or reach >= n:
            return order
        rank[order] = new
        reach *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of the suffixes of ``s`` (symbols 0 to ``symbols`` - 1) in order."""
    if len(s) < 2:
        return np.arange(len(s))
    smaller = suffix_types(s)
    marks = leftmost_smaller(smaller)
    if len(marks) > 1:
        rough = induce(s, smaller, marks, symbols)
        is_mark = np.zeros(len(s), bool)
        is_mark[marks] = True
        names, count = names_of(s, rough[is_mark[rough]], marks)
        if count == len(marks):
            order = np.empty(len(marks), np.int64)
            order[names] = np.arange(len(marks))
        elif count <= MANY_NAMES:
            order = suffix_array(names, count)
        else:
            order = doubled(names)
        marks = marks[order]
    return induce(s, smaller, marks, symbols)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position, in text order, how many bytes (at most ``most``) its suffix shares with the one before it in ``order``."""
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    at = np.flatnonzero(before >= 0)
    done = 0
    while len(at) and done < most:  # eight bytes at a time, as long as they agree
        i, j = at + done, before[at] + done
        inside = (i + 8 <= n) & (j + 8 <= n)
        equal = inside.copy()
        equal[inside] = words[i[inside]] == words[j[inside]]
        for p in () if equal.all() else (np.flatnonzero(~equal),):
            a, b, live, k = i[p], j[p], np.arange(len(p)), 0
            while len(live) and k < 8:
                live = live[(a[live] + k < n) & (b[live] + k < n)]
                live = live[data[a[live] + k] == data[b[live] + k]]
                k += 1
                shared[at[p[live]]] = done + k
        shared[at[equal]] = done + 8
        at = at[equal]
        done += 8
    return np.minimum(shared, most)
