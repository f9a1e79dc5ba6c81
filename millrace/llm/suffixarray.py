"""Suffix arrays by linear grouping: no ranks are renamed and nothing is sorted by recursion.

Phase 1 groups the suffixes by their longest Lyndon prefix. It starts from groups by first symbol and settles them in descending order.
For each suffix of the group being settled the previous-smaller pointer names the nearest suffix to the left in a lower group; the prefix
of that suffix is extended by the settled group's, once for each suffix that points to it, and it moves to a new group right above its
old one. Every suffix is pointed from once, so the work is linear in the moves.

Phase 2 walks the array from its start. The suffixes whose Lyndon prefix ends where the suffix at hand begins lie on one chain of
previous-smaller pointers; each takes the next free place of its group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in ascending order; the end of the text is smaller than any symbol."""
    n = len(text)
    if not n:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    prefix = [1] * n
    smaller = [-1] * n
    settled = bytearray(n)

    g = len(members) - 1
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        for i in own:
            settled[i] = 1
        moved: dict[int, dict[int, list[int]]] = {}
        last, times = -1, 0
        for i in [*own, n]:
            p = i - 1 if i < n else -1
            while p >= 0 and settled[p]:
                p = smaller[p]
            if i < n:
                smaller[i] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                moved.setdefault(group[last], {}).setdefault(times, []).append(last)
            last, times = p, 1
        for old, by_times in moved.items():
            for k in sorted(by_times, reverse=True):  # more repeats are larger
                new = len(members)
                members.append(by_times[k])
                add = k * prefix[own[0]]
                for p in by_times[k]:
                    group[p] = new
                    prefix[p] += add
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]

    free = [0] * len(members)
    at, start = 0, 0  # the first symbol's group is the lowest and stays so
    while at >= 0:
        free[at] = start
        start += sum(1 for i in members[at] if group[i] == at)
        at = above[at]
    order = [0] * n

    def emit(s: int) -> None:
        j = s - 1
        while j >= 0 and j + prefix[j] == s:
            order[free[group[j]]] = j
            free[group[j]] += 1
            j = smaller[j]

    emit(n)
    for i in range(n):
        emit(order[i])
    return order
