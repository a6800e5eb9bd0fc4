"""Suffix arrays by linear grouping.

First, suffixes are grouped by the Lyndon word they begin with. Groups start as
the symbols and are processed from the largest to the smallest. Each member s
finds the nearest position before it that stands in a smaller group (its previous
smaller pointer; positions of larger groups are jumped over by their own
pointers); the Lyndon prefix of the suffix there is thereby known to go on with
the processed group's, so these positions leave their group for a new one just
above it, those that are followed by more copies higher up.

Then the order within the groups is emitted: from the smallest suffix on, the
position before each placed suffix, and those that its pointers lead to, take
the next free places of their groups. No suffix is renamed or compared.
"""

from __future__ import annotations

from collections.abc import Sequence


def group_suffixes(s: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each position: the start of its group in the suffix array, and its previous smaller pointer (-1: none).

    ``s`` ends with a symbol smaller than all others.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for i, p in enumerate(order):
        if i and s[p] != s[order[i - 1]]:
            start = i
        place[p] = i
        group[p] = start
        size[start] += 1
    before = [-1] * n
    top = n - 1
    while top > 0:
        g = group[order[top]]
        members = order[g : top + 1]
        top = g - 1
        if len(members) == 1:
            p = members[0] - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            before[members[0]] = p
            if p < 0:
                continue
            times = {p: 1}
        else:
            times = {}
            members.sort()  # a chain's earlier copies come first
            for m in members:
                p = m - 1
                while p >= 0 and group[p] > g:
                    p = before[p]
                if p >= 0 and group[p] == g:
                    p = before[p]
                before[m] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if not times:
                continue
        by_count: dict[int, list[int]] = {}
        for p, k in times.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            # All of them move to the ends of their groups, which are then cut off.
            grown: dict[int, int] = {}
            for p in by_count[k]:
                h = group[p]
                moved = grown.get(h, 0)
                last = h + size[h] - 1 - moved
                other, here = order[last], place[p]
                order[here], order[last] = other, p
                place[other], place[p] = here, last
                grown[h] = moved + 1
            for h, moved in grown.items():
                if moved < size[h]:
                    new = h + size[h] - moved
                    size[h] -= moved
                    size[new] = moved
                    for i in range(new, new + moved):
                        group[order[i]] = new
    return group, before


def suffix_array(s: Sequence[int]) -> list[int]:
    """Positions of ``s`` in the order of their suffixes; ``s`` ends with its only smallest symbol."""
    n = len(s)
    if not n:
        return []
    group, before = group_suffixes(s)
    free = list(range(n))  # next free place of the group that starts there
    out, placed = [-1] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = before[p]
    return out
