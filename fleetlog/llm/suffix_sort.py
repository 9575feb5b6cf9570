"""Suffix array by linear grouping (two phases, no recursion, nothing renamed).

First phase: suffixes are grouped by their first symbol, and the groups are processed
from the highest down. When its turn comes, a group holds the suffixes that begin with
one certain Lyndon word. Each of them points to the nearest suffix before it that lies
in a lower group (its previous smaller one). Suffixes that are pointed to leave their
group for a new one right above it, the more pointers the higher: their Lyndon prefix
has grown by that many copies of the processed group's word.

Second phase: the array is filled from the front. Each suffix taken from it sends the
suffix before it, and then along the pointers, to the front of what is left of their
groups, until one is met that has its place already.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order. Symbols are small integers from 1 on; a text's end is below all."""
    symbols = [*text, 0]
    n = len(symbols)
    counts = [0] * (max(symbols) + 2)
    for c in symbols:
        counts[c + 1] += 1
    for c in range(1, len(counts)):
        counts[c] += counts[c - 1]
    group = [counts[c] for c in symbols]  # a group is named by where it begins in the order
    order, place, fill = [0] * n, [0] * n, counts[:]
    size = [0] * (n + 1)
    for i, c in enumerate(symbols):
        at = fill[c]
        order[at], place[i] = i, at
        fill[c] = at + 1
        size[group[i]] += 1
    before = [-1] * n  # previous smaller suffix
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        members.sort()
        end = start
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                moved.setdefault(group[p], []).append(p)
            for old, those in moved.items():
                if len(those) == size[old]:
                    continue  # the whole group moves above itself
                size[old] -= len(those)
                new = old + size[old]
                at = new + len(those)
                for p in those:  # to the end of the old group's range
                    at -= 1
                    here, other = place[p], order[at]
                    order[here], place[other] = other, here
                    order[at], place[p] = p, at
                for p in those:
                    group[p] = new
                size[new] = len(those)
    front = list(range(n + 1))
    done = [False] * n
    order = [-1] * n
    order[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            done[j] = True
            j = before[j]
    return order[1:]
