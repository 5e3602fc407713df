"""Suffix arrays by induced sorting, for many independent groups of strings at once.

A group is a run of characters that ends with its own smallest character.  Characters of
different groups differ, so the array of all groups together is the arrays of the groups,
one after the other.  Both scans of induced sorting walk all groups in step: step t
handles place t of every group, as vectors.
"""

from __future__ import annotations

import numpy as np


class _Groups:
    """Places of groups, longest first, so the groups still open at a step come first."""

    def __init__(self, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        self.first, self.last = (ends - sizes)[order], (ends - 1)[order]
        self.steps = int(sizes.max(initial=0))
        # open_at[t]: groups longer than t
        self.open_at = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(self.steps), "right")


def _induce(sa: np.ndarray, s: np.ndarray, small: np.ndarray, begins: np.ndarray, sorted_lms: np.ndarray, groups: _Groups) -> None:
    """Fill ``sa`` from the given order of leftmost-smaller places."""
    sa.fill(-1)
    bucket = s[sorted_lms]
    # leftmost-smaller places go to the ends of their buckets, in order
    n_bucket = np.bincount(bucket, minlength=len(begins) - 1)
    rank = np.arange(len(bucket)) - (np.cumsum(n_bucket) - n_bucket)[bucket]
    sa[begins[1:][bucket] - n_bucket[bucket] + rank] = sorted_lms
    head = begins[:-1].copy()
    for t in range(groups.steps):  # larger places, from the left
        k = groups.open_at[t]
        v = sa[groups.first[:k] + t]
        j = v[v > groups.first[:k]] - 1
        j = j[~small[j]]
        b = s[j]
        sa[head[b]] = j
        head[b] += 1
    tail = begins[1:].copy()
    for t in range(groups.steps):  # smaller places, from the right
        k = groups.open_at[t]
        v = sa[groups.last[:k] - t]
        j = v[v > groups.first[:k]] - 1
        j = j[small[j]]
        b = s[j]
        tail[b] -= 1
        sa[tail[b]] = j


def suffix_array(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``s``: dense characters 0..k-1, in group order; ``sizes``: characters per group."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int32)
    # classify: a place is small if its suffix sorts before the next place's
    falls = np.empty(n, np.int8)
    falls[-1] = 1
    falls[:-1] = np.sign(s[1:] - s[:-1])
    ends = np.cumsum(sizes) - 1
    falls[ends] = 1
    known = np.where(falls != 0, np.arange(n), n)
    small = falls[np.minimum.accumulate(known[::-1])[::-1]] > 0
    lms = np.zeros(n, bool)
    lms[1:] = small[1:] & ~small[:-1]
    starts = ends - sizes + 1
    lms[starts] = False
    lms[ends] = True  # a group's end, also where it is all of the group
    places = np.flatnonzero(lms)
    begins = np.concatenate([[0], np.cumsum(np.bincount(s))])
    groups = _Groups(sizes)
    sa = np.empty(n, np.int32)

    # sort the leftmost-smaller substrings by inducing from any order of them
    _induce(sa, s, small, begins, places[np.argsort(s[places], kind="stable")], groups)
    by_substring = sa[lms[sa]]
    following = np.empty(n, np.int64)
    following[places[:-1]] = places[1:]
    following[ends] = ends
    length = following[by_substring] - by_substring
    same = length[1:] == length[:-1]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        a, b = by_substring[left], by_substring[left + 1]
        equal = s[a + k] == s[b + k]
        same[left[~equal]] = False
        left = left[equal & (k < length[left])]
        k += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 == len(places):
        sorted_lms = by_substring
    else:  # names are not unique yet: sort the string of names
        names = np.empty(n, np.int64)
        names[by_substring] = name
        per_group = np.add.reduceat(lms, starts, dtype=np.int64)
        sorted_lms = places[suffix_array(names[places], per_group)]
    _induce(sa, s, small, begins, sorted_lms, groups)
    return sa


def permuted_common_prefixes(s: np.ndarray, sizes: np.ndarray, sa: np.ndarray, enough: int) -> np.ndarray:
    """For every place, the length of the common prefix with the suffix before it in the
    array; exact below ``enough``, at least that otherwise.

    Where the characters before both suffixes agree, the length is one less than that of
    the place before, so only the other places are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before[np.cumsum(sizes) - 1] = -1  # the first suffix of each group
    at = np.arange(n)
    derived = (before > 0) & (at > 0)
    derived[derived] = s[before[derived] - 1] == s[at[derived] - 1]
    derived[1:] &= before[:-1] >= 0
    own = np.flatnonzero(~derived)
    source = np.maximum.accumulate(np.where(derived, -1, at))
    run = np.diff(np.concatenate([own, [n]]))
    length = np.zeros(len(own), np.int64)
    left = np.flatnonzero(before[own] >= 0)
    while len(left):
        a, b = own[left] + length[left], before[own[left]] + length[left]
        equal = s[a] == s[b]
        length[left] += equal
        left = left[equal & (length[left] < enough + run[left])]
    out = np.zeros(n, np.int64)
    out[own] = length
    return np.maximum(out[source] - (at - source), 0)
