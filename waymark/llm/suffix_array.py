"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from waymark.llm.common import range_hashes

LETTERS = 257  # bytes plus one, and the end


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), False for larger ones (L). The last letter is the only 0."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])
    rising = s[change] < s[change + 1]
    out = np.ones(n, bool)
    out[:change[-1] + 1] = np.repeat(rising, np.diff(np.append(-1, change)))
    return out


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Sort all suffixes from leftmost-smaller ones in the given order: two scans over the buckets.

    A bucket is scanned in waves: what lies in it already, then what that wave has put into the same bucket. Each wave moves
    all its suffixes at once.
    """
    n = len(s)
    counts = np.bincount(s, minlength=LETTERS)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int64)
    letters = s[seeds]
    order = np.argsort(letters, kind="stable")
    number = np.bincount(letters, minlength=LETTERS)
    first = np.cumsum(number) - number
    sa[(ends - number)[letters[order]] + np.arange(len(seeds)) - first[letters[order]]] = seeds[order]

    heads = begins.copy()

    def forward(block: np.ndarray) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if not len(before):
            return
        letter = s[before]
        by = np.argsort(letter, kind="stable")
        letter = letter[by]
        moved = np.bincount(letter, minlength=LETTERS)
        rank = np.arange(len(by)) - (np.cumsum(moved) - moved)[letter]
        sa[heads[letter] + rank] = before[by]
        np.add(heads, moved, out=heads)

    for c in np.flatnonzero(counts):
        done = begins[c]
        while heads[c] > done:
            low, done = done, heads[c]
            forward(sa[low:done])
        if number[c]:
            forward(sa[ends[c] - number[c]:ends[c]])

    tails = ends.copy()

    def backward(block: np.ndarray) -> None:
        before = block[::-1] - 1
        before = before[before >= 0]
        before = before[small[before]]
        if not len(before):
            return
        letter = s[before]
        by = np.argsort(letter, kind="stable")
        letter = letter[by]
        moved = np.bincount(letter, minlength=LETTERS)
        rank = np.arange(len(by)) - (np.cumsum(moved) - moved)[letter]
        sa[tails[letter] - 1 - rank] = before[by]
        np.subtract(tails, moved, out=tails)

    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c]
        while tails[c] < done:
            high, done = done, tails[c]
            backward(sa[done:high])
        backward(sa[begins[c]:heads[c]])
    sa[0] = n - 1
    return sa


def order_names(names: np.ndarray) -> np.ndarray:
    """The suffix array of the reduced string. Its alphabet is as large as itself, so its suffixes are not induced bucket by
    bucket: pairs of names are named again, then pairs of pairs, and only suffixes that are still tied take part."""
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    step = 1
    while len(tied):
        follow = tied + step
        key = rank[tied] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        place = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[tied] = old + start - group
        size = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Where the suffixes of the bytes begin, in order."""
    if not len(data):
        return np.empty(0, np.int64)
    s = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)
    small = suffix_types(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(s, small, leftmost)
    is_seed = np.zeros(len(s), bool)
    is_seed[leftmost] = True
    ranked = sa[is_seed[sa]]
    # name the substrings from one leftmost-smaller position to the next, in their order; the end is a substring of its own
    until = np.empty(len(s), np.int64)
    until[leftmost] = np.append(leftmost[1:] + 1, len(s))
    until = np.minimum(until[ranked], len(data))
    hashes = range_hashes(data, np.minimum(ranked, until), until)
    lengths = until - ranked
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1]))
    # a substring that reaches the end of the data is unlike any other
    ends_there = np.isin(ranked, leftmost[-2:])
    new |= ends_there
    new[1:] |= ends_there[:-1]
    names = np.empty(len(s), np.int64)
    names[ranked] = np.cumsum(new) - 1
    if not new.all():
        ranked = leftmost[order_names(names[leftmost])]
    return induce(s, small, ranked)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every position, how much its suffix shares with the one before it in the suffix array (the permuted LCP).

    Where the letters before both are equal the value is one less than at the position before, so only the others are
    compared, eight bytes at a time.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    reducible = (phi > 0) & (here > 0)
    reducible[reducible] = data[here[reducible] - 1] == data[phi[reducible] - 1]
    # the position before must have that very predecessor
    again = here[reducible]
    reducible[again] = phi[again - 1] == phi[again] - 1
    start = np.flatnonzero(~reducible)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight |= padded[k:k + n + 1].astype(np.uint64) << np.uint64(8 * k)
    shared = np.zeros(len(start), np.int64)
    todo = np.flatnonzero(phi[start] >= 0)
    while len(todo):
        a, b = start[todo] + shared[todo], phi[start[todo]] + shared[todo]
        room = n - np.maximum(a, b)
        differ = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        step = np.minimum(same, np.maximum(room, 0))
        shared[todo] += step
        todo = todo[(step == 8)]
    out = np.zeros(n, np.int64)
    out[start] = shared
    last = np.maximum.accumulate(np.where(~reducible, here, 0))
    return np.where(reducible, np.maximum(out[last] - (here - last), 0), out)
