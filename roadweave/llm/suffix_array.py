"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard in memory."""

from __future__ import annotations

import itertools

import numpy as np

#: Alphabets up to this size are induced a bucket at a time in numpy, larger ones an entry at a time.
SMALL = 512


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last, a unique smallest sentinel, counts as smaller."""
    n = len(t)
    out = np.ones(n, bool)
    differs = np.append(t[:-1] != t[1:], True)
    where = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(where[::-1])[::-1]
    inner = nxt < n - 1
    out[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    return out


def _deal(entries: np.ndarray, t: np.ndarray, keep: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Appends the kept predecessors of ``entries``, in order, to their first symbols' buckets."""
    p = entries[entries > 0] - 1
    p = p[keep[p]]
    if not len(p):
        return
    symbol = t[p]
    if len(p) < 24:
        for x, c in zip(p.tolist(), symbol.tolist(), strict=True):
            buckets[c].append(np.array([x]))
        return
    order = np.argsort(symbol, kind="stable")
    p, symbol = p[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for part in np.split(p, cuts):
        buckets[int(t[part[0]])].append(part)


def _drain(buckets: list[list[np.ndarray]], c: int, t: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Deals a bucket's entries, those that it gives to itself too, and returns all of them in order."""
    done = 0
    while done < len(buckets[c]):
        part = np.concatenate(buckets[c][done:])
        buckets[c][done:] = [part]
        done += 1
        _deal(part, t, keep, buckets)
    return np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)


def _induce_small(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    heads: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    tails: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    cuts = np.searchsorted(t[lms], np.arange(sigma + 1))
    larger = ~smaller
    full = []
    for c in range(sigma):
        full.append(_drain(heads, c, t, larger))
        _deal(lms[cuts[c] : cuts[c + 1]], t, larger, heads)
    out = []
    for c in reversed(range(sigma)):
        mine = _drain(tails, c, t, smaller)
        _deal(full[c][::-1], t, smaller, tails)
        out += [mine, full[c][::-1]]
    return np.concatenate([np.array([len(t) - 1]), *(x[::-1] for x in reversed(out))])


def _induce_large(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    text, is_small, n = t.tolist(), smaller.tolist(), len(t)
    sa = np.full(n, -1, np.int64)
    # Sorted LMS suffixes stand at their buckets' ends, in order.
    symbol = t[lms]
    sa[ends[symbol] - np.bincount(symbol, minlength=sigma)[symbol] + np.arange(len(lms)) - np.searchsorted(symbol, symbol)] = lms
    a = sa.tolist()
    head = (ends - counts).tolist()
    for j in a_iter(a):
        if j > 0 and not is_small[j - 1]:
            c = text[j - 1]
            a[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = a[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            a[tail[c]] = j
    a[0] = n - 1
    return np.array(a, np.int64)


def a_iter(a: list[int]):
    """The list's entries as they are when reached."""
    return iter(a)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of ``t``, whose last symbol is a unique 0; symbols are below ``sigma``.

    Suffixes are classified, leftmost smaller ones (LMS) sorted by their substrings through one induction, named, and
    their string of names sorted by recursion if names repeat; a second induction from the sorted LMS gives the rest.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = suffix_types(t)
    at = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_small if sigma <= SMALL else _induce_large
    sa = induce(t, smaller, at[np.argsort(t[at], kind="stable")], sigma)
    is_lms = np.zeros(n, bool)
    is_lms[at] = True
    order = sa[is_lms[sa]]
    number = np.empty(n, np.int64)
    number[at] = np.arange(len(at))
    length = np.append(np.diff(at), 0)[number[order]] + 1
    same = np.append(False, length[1:] == length[:-1])
    active = np.flatnonzero(same)
    for k in itertools.count():
        if not len(active):
            break
        a, b = order[active] + k, order[active - 1] + k
        differ = (t[a] != t[b]) | (smaller[a] != smaller[b])
        same[active[differ]] = False
        active = active[~differ & (k + 1 < length[active])]
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(order):
        reduced = np.empty(len(at), np.int64)
        reduced[number[order]] = names
        order = at[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(t, smaller, order, sigma)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each position of the bytes ``data``: the bytes that its suffix shares with its predecessor in the suffix array, up to ``cap``.

    Compared in text order, eight bytes at a time; those below a multiple of eight one at a time. The last position is a sentinel.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    for k in range(0, cap - 7, 8):
        equal = words[active + k] == words[np.minimum(before[active] + k, len(words) - 1)]
        out[active] = np.where(equal, k + 8, k)
        rest, active = active[~equal], active[equal]
        _finish(padded, before, out, rest, k, min(7, cap - k))
    done = cap - cap % 8
    _finish(padded, before, out, active, done, cap - done)
    return out


def _finish(data: np.ndarray, before: np.ndarray, out: np.ndarray, rows: np.ndarray, start: int, most: int) -> None:
    for k in range(start, start + most):
        rows = rows[data[rows + k] == data[np.minimum(before[rows] + k, len(data) - 1)]]
        if not len(rows):
            return
        out[rows] = k + 1
