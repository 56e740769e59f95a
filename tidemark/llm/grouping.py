"""Suffix arrays in linear time by grouping suffixes on their Lyndon prefixes.

First phase: suffixes start in groups by their first symbol. Groups are taken from the last to the first; each member's
previous smaller suffix is found along earlier pointers, and the suffixes so pointed at move, by how many members point at
them, into new groups to the right in their old group. In the end each group holds the suffixes with one longest Lyndon prefix,
and groups stand in order. Second phase: going through the order from the front, each suffix puts those that end their Lyndon
prefix at it, found by the same pointers, at the front of their groups. Nothing is renamed or solved recursively.
"""

from __future__ import annotations


def suffix_array(text) -> list[int]:
    """Start positions of the suffixes of `text`, a sequence of small non-negative integers, in order; a suffix that is a
    prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    symbols = [0] * (max(text) + 1)
    for x in text:
        symbols[x] += 1
    start, total = [], 0
    for count in symbols:
        start.append(total)
        total += count
    order, place, group, size = [0] * n, [0] * n, [0] * n, [0] * n
    fill = start[:]
    for s, x in enumerate(text):
        at = fill[x]
        fill[x] = at + 1
        order[at], place[s], group[s] = s, at, start[x]
    for first, count in zip(start, symbols, strict=True):
        if count:
            size[first] = count

    before = [-1] * n  # the nearest suffix to the left in a smaller group
    end = n
    while end:
        here = group[order[end - 1]]
        members = order[here:end]
        members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            if most == 1:
                rounds = [list(times)]
            else:
                by_count: dict[int, list[int]] = {}
                for p, count in times.items():
                    by_count.setdefault(count, []).append(p)
                rounds = [by_count[count] for count in sorted(by_count, reverse=True)]
            for moving in rounds:
                touched: dict[int, int] = {}
                for p in moving:  # to the right end of what is left of their group
                    g = group[p]
                    rest = size[g] - 1
                    size[g] = rest
                    touched[g] = touched.get(g, 0) + 1
                    last, at = g + rest, place[p]
                    other = order[last]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                for p in moving:
                    g = group[p]
                    if size[g]:
                        group[p] = g + size[g]
                for g, count in touched.items():
                    if size[g]:
                        size[g + size[g]] = count
                    else:
                        size[g] = count
        end = here

    # second phase: an empty suffix ends the Lyndon prefixes that reach the end of the text
    out, placed, front = [0] * n, [False] * n, group  # the first free place of a group is kept at its first place
    free = list(range(n))

    def follow(p: int) -> None:
        while p >= 0 and not placed[p]:
            g = front[p]
            at = free[g]
            out[at], free[g], placed[p] = p, at + 1, True
            p = before[p]

    follow(n - 1)
    for i in range(n):
        follow(out[i] - 1)
    return out
