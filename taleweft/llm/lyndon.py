"""Suffix array in linear grouping steps (after Baier, 2016).

First suffixes are grouped by their longest Lyndon prefix. Groups are processed from the
greatest down; the previous-smaller pointers of a group's suffixes lead to the suffixes
whose Lyndon prefix the group extends, and those move up into groups of their own, by how
often the group follows them. Then one pass in ascending order places every suffix at the
front of what is left of its group. No names are given anew and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: bytes | list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in lexicographic order, the empty one left out."""
    n = len(s) + 1  # a sentinel below all symbols ends the string
    if n == 1:
        return []
    text = np.empty(n, np.int64)
    text[:-1] = np.frombuffer(s, np.uint8) if isinstance(s, bytes) else s
    text[-1] = -1
    # sa holds groups as ranges; group[i] is the start of suffix i's range, size[start] its length.
    # Index -1 is the sentinel, whose group is the lowest: the walks to the left end there.
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(text[order]) != 0]))
    lengths = np.diff(np.concatenate([first, [n]]))
    of, where, sizes = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    of[order] = np.repeat(first, lengths)
    where[order] = np.arange(n)
    sizes[first] = lengths
    sa, place, group, size = order.tolist(), where.tolist(), of.tolist(), sizes.tolist()
    prev = [-1] * n
    hi = n - 1
    while hi > 0:
        i = sa[hi]
        lo = group[i]
        if lo == hi:  # most groups are one suffix
            p = i - 1
            while group[p] > lo:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                z = size[g] - 1
                if z:
                    size[g] = z
                    last = g + z
                    q = sa[last]
                    if q != p:
                        a = place[p]
                        sa[a] = q
                        place[q] = a
                        sa[last] = p
                        place[p] = last
                    group[p] = last
                    size[last] = 1
            hi -= 1
            continue
        # previous-smaller pointers: the nearest suffix before, in a lower group
        follows: dict[int, int] = {}
        once = True
        for i in sorted(sa[lo : hi + 1]):
            p = i - 1
            while group[p] >= lo:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                if p in follows:
                    follows[p] += 1
                    once = False
                else:
                    follows[p] = 1
        if once:
            classes = [follows] if follows else []
        else:
            by: dict[int, list[int]] = {}
            for p, c in follows.items():
                by.setdefault(c, []).append(p)
            classes = [by[c] for c in sorted(by, reverse=True)]
        for found in classes:
            moved = []
            for p in found:  # to the end of its group
                g = group[p]
                z = size[g] - 1
                size[g] = z
                last = g + z
                q = sa[last]
                if q != p:
                    a = place[p]
                    sa[a] = q
                    place[q] = a
                    sa[last] = p
                    place[p] = last
                moved.append(g)
            for p, g in zip(found, moved):  # what went there is a group of its own, above what stayed
                top = g + size[g]
                group[p] = top
            for p in found:
                size[group[p]] = 0
            for p in found:
                size[group[p]] += 1
        hi = lo - 1
    # emission: suffixes that end their Lyndon prefix at the next suffix in order
    front = list(range(n))
    done = [False] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while not done[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            done[p] = True
            p = prev[p]
    return out[1:]
