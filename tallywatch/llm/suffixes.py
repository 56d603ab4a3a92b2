"""Suffix arrays of integer strings by linear grouping of suffixes."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order.

    Suffixes are grouped by their first symbol, then groups are taken in
    descending order. For each suffix of the group, the nearest one before it
    that lies in a lower group (its previous smaller) is extended by the group's
    prefix, as many times as the group has suffixes that point to it, and moves
    to a new group directly above its own. In the end a group holds suffixes
    that share their longest Lyndon prefix, and groups are in order. The second
    phase walks the array from its start: the suffix before each one found, and
    its chain of previous smaller ones, take the next places of their groups. No
    string is renamed and nothing recurses.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    # starts are counted from 1, so that 0 means none; n + 1 is the end mark, alone in the lowest group
    order = np.argsort(symbols, kind="stable")
    differs = symbols[order[1:]] != symbols[order[:-1]]
    members = [[n + 1]] + [part.tolist() for part in np.split(order + 1, np.flatnonzero(differs) + 1)]
    start_group = np.zeros(n + 2, np.int64)
    start_group[order + 1] = np.cumsum(np.concatenate([[1], differs]))
    group = start_group.tolist()
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    left = list(range(-1, n + 1))
    taken = bytearray(n + 2)
    smaller = [0] * (n + 2)
    now = len(members) - 1
    while now >= 0:
        current = [i for i in members[now] if group[i] == now]
        members[now] = current
        for i in current:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in current:
            j = i - 1
            while taken[j]:
                k = left[j]
                if taken[k]:
                    k = left[j] = left[k]
                j = k
            left[i] = smaller[i] = j
            if j:
                times[j] = times.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in times.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[count]:
                old = group[j]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(members)
                    members.append([])
                    next_up = above[old]
                    below.append(old)
                    above.append(next_up)
                    above[old] = below[next_up] = new
                members[new].append(j)
                group[j] = new
        now = below[now]
    # second phase
    free = [0] * len(members)
    at = 0
    now = 0
    while now >= 0:
        free[now] = at
        at += len(members[now])
        now = above[now]
    out = [0] * (n + 1)
    placed = bytearray(n + 2)
    placed[0] = placed[n + 1] = 1
    out[0] = n + 1
    for at in range(n + 1):
        j = out[at] - 1
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = smaller[j]
    return np.array(out[1:], np.int64) - 1
