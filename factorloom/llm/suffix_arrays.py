"""Suffix array by induced sorting, and permuted common prefixes, for one shard of text.

The top level has few symbols, so it is induced a bucket at a time with numpy;
the reduced strings below it have many, and are induced entry by entry.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (type S); the sentinel is S."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    is_s = np.empty(n, bool)
    is_s[-1] = True
    if n > 1:
        at = np.searchsorted(differs, np.arange(n - 1))  # the sentinel differs from all, so there always is one
        nearest = differs[at]
        is_s[:-1] = s[nearest] < s[nearest + 1]
    return is_s


def _append(sa, slot, step, symbols, rows, n_symbols):
    """Puts ``rows`` at the open ends of their buckets, in order; ``step`` is the direction of growth."""
    order = np.argsort(symbols, kind="stable")
    sym = symbols[order]
    first = np.searchsorted(sym, sym)
    sa[slot[sym] + step * (np.arange(len(sym)) - first)] = rows[order]
    slot += step * np.bincount(sym, minlength=n_symbols)


def _induce_by_bucket(s, is_s, lms, n_symbols):
    """Suffix array from sorted left-most S suffixes: L suffixes upwards, then S suffixes downwards."""
    n = len(s)
    counts = np.bincount(s, minlength=n_symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int32)
    head = starts.copy()
    by = np.argsort(s[lms], kind="stable")
    seeds = lms[by]
    seed_at = np.searchsorted(s[seeds], np.arange(n_symbols + 1))
    for c in np.flatnonzero(counts):
        done, found = starts[c], []
        while True:
            rows = sa[done : head[c]]
            done = head[c]
            if not len(rows):
                break
            j = rows[rows > 0] - 1
            j = j[~is_s[j]]
            same = s[j] == c
            found.append(j[~same])
            again = j[same]
            sa[head[c] : head[c] + len(again)] = again
            head[c] += len(again)
        j = seeds[seed_at[c] : seed_at[c + 1]]
        j = j[j > 0] - 1
        found.append(j[~is_s[j]])
        j = np.concatenate(found)
        if len(j):
            _append(sa, head, 1, s[j], j, n_symbols)
    tail = ends - 1
    for c in np.flatnonzero(counts)[::-1]:
        done, found = ends[c] - 1, []
        while True:
            rows = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            if not len(rows):
                break
            j = rows[rows > 0] - 1
            j = j[is_s[j]]
            same = s[j] == c
            found.append(j[~same])
            again = j[same]
            sa[tail[c] - len(again) + 1 : tail[c] + 1] = again[::-1]
            tail[c] -= len(again)
        rows = sa[starts[c] : head[c]][::-1]
        j = rows[rows > 0] - 1
        found.append(j[is_s[j]])
        j = np.concatenate(found)
        if len(j):
            _append(sa, tail, -1, s[j], j, n_symbols)
    sa[0] = n - 1
    return sa


def _induce_by_entry(s, is_s, lms, n_symbols):
    """The same for many symbols, one entry after the other."""
    n = len(s)
    counts = np.bincount(s, minlength=n_symbols)
    ends = np.cumsum(counts)
    text, small = s.tolist(), is_s.tolist()
    sa = [-1] * n
    tail = (ends - 1).tolist()
    for j in lms[::-1].tolist():
        c = text[j]
        sa[tail[c]] = j
        tail[c] -= 1
    head = (ends - counts).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = text[j]
            sa[tail[c]] = j
            tail[c] -= 1
    return np.array(sa, np.int32)


def _same_substrings(s, is_s, left, right, size):
    """For pairs of left-most S positions: are the substrings up to the next such position equal?"""
    same = size[left] == size[right]
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        a, b = left[at] + k, right[at] + k
        equal = (s[a] == s[b]) & (is_s[a] == is_s[b])
        same[at[~equal]] = False
        k += 1
        at = at[equal & (size[left[at]] > k)]
    return same


def suffix_array(s: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix array of ``s``, whose last value is 0 and occurs nowhere else (Nong, Zhang and Chan, 2009)."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    is_s = _types(s)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    induce = _induce_by_bucket if n > 64 * n_symbols else _induce_by_entry
    sa = induce(s, is_s, lms, n_symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    size = np.zeros(n, np.int32)  # of the substring that ends with the next left-most S position
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    new = np.ones(len(order), np.int32)
    if len(order) > 1:
        new[1:] = ~_same_substrings(s, is_s, order[:-1], order[1:], size)
    names = np.cumsum(new, dtype=np.int32) - 1
    if names[-1] + 1 < len(order):
        name = np.zeros(n, np.int32)
        name[order] = names
        order = lms[suffix_array(name[lms], int(names[-1]) + 1)]
    else:
        order = order.copy()
    return induce(s, is_s, order, n_symbols)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each text position, the common prefix (up to ``most``) with the suffix before it in ``sa``.

    The array is permuted, in text order.  Where a suffix and its predecessor
    follow equal symbols, the value is one less than at the position before, so
    only the others are compared, eight symbols at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    derived = (before > 0) & (at > 0)
    derived[derived] = s[at[derived] - 1] == s[before[derived] - 1]
    wide = np.zeros(n + 8, np.uint8 if s.max() < 256 else np.uint32)
    wide[:n] = s
    value = np.zeros(n, np.int32)
    rows = np.flatnonzero(~derived & (before >= 0))
    # a value bounds those derived from it, so these are compared in full up to where the text ends
    left = rows
    k = 0
    words = None
    if wide.dtype == np.uint8:
        words = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (n + 1, 8), (1, 1))
    while len(left) and words is not None:
        a, b = left + k, before[left] + k
        ok = (a < n) & (b < n)
        left, a, b = left[ok], a[ok], b[ok]
        differ = words[a] != words[b]
        some = differ.any(axis=1)
        value[left[some]] = k + differ[some].argmax(axis=1)
        left = left[~some]
        k += 8
    if words is None:
        while len(left):
            ok = (left + k < n) & (before[left] + k < n)
            left = left[ok]
            ok = s[left + k] == s[before[left] + k]
            value[left[~ok]] = k
            left = left[ok]
            k += 1
    last = np.maximum.accumulate(np.where(derived, -1, at))
    return np.minimum(value[last] - (at - last), most).clip(0)
