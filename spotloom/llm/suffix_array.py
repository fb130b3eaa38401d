"""Suffix sorting in linear time by Lyndon groups.

First stage: suffixes start in groups by their first symbol, and groups are taken in descending order.  For
each suffix of a group, its pointer is the nearest earlier suffix of a lower group.  Suffixes pointed at,
by how often, leave their group for new ones just above it: their known prefix has grown by that many
copies of the taken group's prefix.  When all groups have been taken, suffixes stand together that share
their Lyndon prefix, in order of that prefix.

Second stage: in ascending order, the suffix before each placed one, and those its pointers lead to, take
the next free place of their group, until one is met that has its place.  No symbol is renamed and nothing
is recursive.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in order.  A suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # the end of the text is a symbol of its own, below all others
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n
    end_of = [0] * (n + 1)
    at = 0
    while at < n:
        c, start = text[order[at]], at
        while at < n and text[order[at]] == c:
            i = order[at]
            place[i], group[i] = at, start
            at += 1
        end_of[start] = at
    before = [-1] * n
    top = n
    while top:
        start = group[order[top - 1]]
        members = order[start:top]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        top = start
        if not times:
            continue
        if len(times) == 1 or max(times.values()) == 1:
            ranked = (list(times),)
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in times.items():
                by_count.setdefault(k, []).append(j)
            ranked = [by_count[k] for k in sorted(by_count, reverse=True)]
        for pointed in ranked:
            new: dict[int, int] = {}
            for j in pointed:
                g = group[j]
                tail = end_of[g] - 1
                end_of[g] = tail
                new[g] = new.get(g, 0) + 1
                p, other = place[j], order[tail]
                order[p], order[tail] = other, j
                place[other], place[j] = p, tail
            for g, k in new.items():
                a = end_of[g]
                if a == g:  # the whole group moved: it keeps its place
                    end_of[g] = a + k
                    continue
                end_of[a] = a + k
                for p in range(a, a + k):
                    group[order[p]] = a
    out = [-1] * n
    placed = bytearray(n)
    free = group[:]  # next free place, by group start
    for g in set(group):
        free[g] = g
    j = n - 1
    i = -1
    while True:
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
