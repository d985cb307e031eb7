"""Suffix arrays by induced sorting and permuted common prefixes, in numpy over one shard.

Buckets of a byte alphabet are few and large, so the scans of induced sorting run bucket by bucket
on whole arrays: entries of a bucket place their left neighbours, stably, in the buckets of those.
"""

from __future__ import annotations

import numpy as np


def suffix_types(s):
    """True where the suffix is smaller than the next one (S-type); the last suffix is L-type."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    ends = np.append(change, n - 1)
    smaller = np.append(s[change] < s[change + 1], False)
    return np.repeat(smaller, np.diff(np.concatenate([[-1], ends])))


def leftmost_smaller(types):
    """Positions of S-type suffixes whose left neighbour is L-type."""
    return (np.flatnonzero(types[1:] & ~types[:-1]) + 1).astype(np.int32)


def induce(s, types, lms, sigma: int):
    """All suffixes in order, from the LMS suffixes in order; linear in the text.

    If ``lms`` is in text order instead, LMS substrings come out in order.
    """
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    out = np.full(n, -1, np.int32)
    first = s[lms]
    order = np.argsort(first, kind="stable")
    seeds = np.bincount(first, minlength=sigma)
    seed_at = end - seeds
    out[np.repeat(seed_at - (np.cumsum(seeds) - seeds), seeds) + np.arange(len(lms))] = lms[order]
    head = start.copy()

    def place(found, want: bool, at, step: int) -> None:
        left = found - 1
        left = left[left >= 0]
        left = left[types[left] == want]
        if not len(left):
            return
        c = s[left]
        by = np.argsort(c, kind="stable")
        c, left = c[by], left[by]
        count = np.bincount(c, minlength=sigma)
        nth = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        out[at[c] + nth if step > 0 else at[c] - 1 - nth] = left
        at += step * count

    used = np.flatnonzero(size)
    out[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    for c in used.tolist():
        a = start[c]
        while a < head[c]:
            b = head[c]
            place(out[a:b], False, head, 1)
            a = b
        if seeds[c]:
            place(out[seed_at[c] : end[c]], False, head, 1)
    tail = end.copy()
    for c in used[::-1].tolist():
        b = end[c]
        while b > tail[c]:
            a = tail[c]
            place(out[a:b][::-1], True, tail, -1)
            b = a
        if head[c] > start[c]:
            place(out[start[c] : head[c]][::-1], True, tail, -1)
    return out


def _names(s, lms, in_order):
    """Number of each LMS substring, equal ones alike, for LMS positions in text order."""
    n = len(s)
    following = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int32)
    length[lms] = following - lms + 1
    a, b = in_order[:-1], in_order[1:]
    same = length[a] == length[b]
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        x, y = a[todo], b[todo]
        equal = s[x + k] == s[y + k]
        same[todo[~equal]] = False
        k += 1
        todo = todo[equal & (length[x] > k)]
    last = lms[-1]
    same &= (a != last) & (b != last)  # it ends with the text, not with an LMS position
    name = np.zeros(n, np.int32)
    name[in_order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def rank_reduced(names):
    """Order of the suffixes of the reduced string: runs of 1, 2, 4 ... names, ties only."""
    n = len(names)
    order = np.argsort(names, kind="stable").astype(np.int32)
    sorted_names = names[order]
    new = np.append(True, sorted_names[1:] != sorted_names[:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~(new & np.append(new[1:], True))
    slots, width = np.flatnonzero(tied), 1
    while len(slots):
        own = order[slots]
        after = np.where(own + width < n, rank[np.minimum(own + width, n - 1)], -1)
        key = rank[own].astype(np.int64) * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        new = np.append(True, key[1:] != key[:-1])
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def suffix_array(s, sigma: int):
    """Suffix array of small non-negative numbers below ``sigma``; a text is smaller than its continuations."""
    n = len(s)
    if n == 0:
        return np.empty(0, np.int32)
    s = np.ascontiguousarray(s, np.uint8 if sigma <= 256 else np.uint16)
    types = suffix_types(s)
    lms = leftmost_smaller(types)
    if len(lms) > 1:
        rough = induce(s, types, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        names = _names(s, lms, rough[is_lms[rough]])
        del rough, is_lms
        lms = lms[rank_reduced(names)]
    return induce(s, types, lms, sigma)


def permuted_lcp(s, order, room):
    """Common prefix of each suffix with its predecessor in ``order``, by text position.

    ``s`` has bytes. ``room`` is how far a common prefix may reach from each position. Where the left neighbours of a
    suffix and its predecessor are equal the value is one less than that of the left neighbour;
    only the others are compared, eight bytes at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    b = before[1:]
    inherits = np.zeros(n, bool)
    inherits[1:] = (b >= 1) & (before[:-1] == b - 1) & (s[:-1] == s[np.maximum(b - 1, 0)]) & (room[:-1] > 0)
    raw = np.concatenate([s.astype(np.uint8), np.zeros(24, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(raw, (n + 9, 8), (1, 1)).copy().view(np.uint64)[:, 0]
    heads = np.flatnonzero(~inherits).astype(np.int32)
    found = np.zeros(len(heads), np.int32)
    most = np.minimum(room[heads], n - before[heads]).astype(np.int32)
    todo = np.flatnonzero(before[heads] >= 0)
    while len(todo):
        at = heads[todo]
        differ = eight[at + found[todo]] ^ eight[before[at] + found[todo]]
        equal = differ == 0
        low = differ & (~differ + np.uint64(1))
        found[todo] += np.where(equal, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int32)
        todo = todo[equal & (found[todo] < most[todo])]
    del eight, raw
    # a run of inheriting positions counts down from its head
    value = np.repeat(np.minimum(found, most) + heads, np.diff(np.append(heads, n))) - np.arange(n, dtype=np.int32)
    return np.minimum(np.maximum(value, 0), room), before
