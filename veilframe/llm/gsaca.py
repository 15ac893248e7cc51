"""Suffix arrays by linear grouping.

First, suffixes are put into groups by their longest Lyndon prefix: starting from
groups by first symbol, groups are taken from the highest to the lowest; for each
suffix of a group the previous smaller suffix is found by pointers that were set
before, and those predecessors leave their groups for new ones just above,
ordered by how many suffixes of the group point to them. Then the order within
groups follows from the lowest suffix upwards along the same pointers. Nothing is
renamed or sorted recursively, and nothing is compared: first symbols and numbers
of pointers are counted into place.

All of it takes time in proportion to the text. A walk along the pointers passes
only suffixes between a suffix and its previous smaller one, and no later walk
comes to those again; counting sorts take as long as the group has members.
"""

from __future__ import annotations

from collections.abc import Sequence


def first_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(order, slot, group, size) of the suffixes by their first symbols."""
    n = len(text)
    count = [0] * (max(text) + 2)
    for c in text:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    group = [count[c] for c in text]
    free, size = count[:], [0] * n
    order, slot = [0] * n, [0] * n
    for i, c in enumerate(text):
        r = free[c]
        free[c] = r + 1
        order[r] = i
        slot[i] = r
        size[group[i]] += 1
    return order, slot, group, size


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group, previous): each suffix's group, as the rank of the group's first
    suffix, and its previous smaller suffix (-1 if none). `text` ends with its
    smallest symbol, which occurs once."""
    order, slot, group, size = first_groups(text)
    previous: list[int | None] = [None] * len(text)
    top = len(text)
    while top:
        g = group[order[top - 1]]
        points: dict[int, int] = {}
        for member in order[g:top]:
            if previous[member] is not None:
                continue
            waiting, at = [member], [member - 1]
            while waiting:  # one that leads over an open one of its group waits for it
                j = at[-1]
                while j >= 0 and group[j] >= g:
                    after = previous[j]
                    if after is None:
                        break
                    j = after
                if j >= 0 and group[j] >= g:
                    at[-1] = j
                    waiting.append(j)
                    at.append(j - 1)
                    continue
                previous[waiting.pop()] = j
                at.pop()
                if j >= 0:
                    points[j] = points.get(j, 0) + 1
        top = g
        if not points:
            continue
        by_group: dict[int, dict[int, list[int]]] = {}
        for j, times in points.items():
            by_group.setdefault(group[j], {}).setdefault(times, []).append(j)
        for h, moved in by_group.items():
            to = h + size[h]
            # the most pointed-to suffixes go to the top; equal numbers share a group
            for times in range(max(moved), 0, -1) if len(moved) > 1 else moved:
                part = moved.get(times)
                if not part:
                    continue
                for j in part:
                    to -= 1
                    other, own = order[to], slot[j]
                    order[own], slot[other] = other, own
                    order[to], slot[j] = j, to
                for j in part:
                    group[j] = to
                size[h] -= len(part)
                size[to] = len(part)
    return group, previous


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of `text` in order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    group, previous = lyndon_groups(text)
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out
