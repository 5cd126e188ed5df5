"""Suffix array of a byte or integer string by linear grouping.

First every suffix is put into the group of its Lyndon prefix: groups start as
those of the first symbols and are processed in descending order.  For each
member of a group the nearest position before it that lies in a lower group is
its previous-smaller pointer; positions that are pointed to move behind their
group, further the more members point to them.  Then the array is filled from
the left: a suffix places the one before it, and all that follow its
previous-smaller pointers, at the next free place of their groups.  Nothing is
renamed or sorted again.

Large groups are handled with numpy, small ones one member after the other.
"""

from __future__ import annotations

import numpy as np

_SMALL = 40


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes; a suffix that is a prefix of another comes first."""
    n = len(symbols) + 1
    if n > 2**31 - 2:
        raise ValueError("the string is too long")
    data = np.zeros(n, np.int64)
    data[:-1] = symbols
    data[:-1] += 1 - (int(data[:-1].min()) if n > 1 else 0)
    group, previous = _grouped(data)
    return _filled(group, previous)[1:]


def _grouped(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's group, by its first place in the array, and its previous-smaller pointer (-1: none)."""
    n = len(data)
    order = np.argsort(data, kind="stable").astype(np.int32)
    first = np.flatnonzero(np.diff(data[order], prepend=-1))
    length = np.diff(first, append=n)
    group, place = np.empty(n, np.int32), np.empty(n, np.int32)
    group[order] = np.repeat(first, length)
    place[order] = np.arange(n, dtype=np.int32)
    size = np.zeros(n, np.int32)
    size[first] = length
    previous = np.full(n, -1, np.int32)
    marked = np.zeros(n, bool)
    arrays = order, group, place, size, previous
    at_order, at_group, at_place, at_size, at_previous = map(memoryview, arrays)
    end = n
    while end > 0:
        start = at_group[at_order[end - 1]]
        if end - start > _SMALL:
            _regroup(start, end, arrays, marked)
        elif end - start == 1:
            p = at_order[start]
            member = p
            p -= 1
            while p >= 0 and at_group[p] >= start:
                p = at_previous[p]
            at_previous[member] = p
            if p >= 0:
                low = at_group[p]
                held = at_size[low]
                if held > 1:
                    last, here = low + held - 1, at_place[p]
                    other = at_order[last]
                    at_order[here], at_place[other] = other, here
                    at_order[last], at_place[p] = p, last
                    at_size[low], at_size[last], at_group[p] = held - 1, 1, last
        else:
            pointed: dict[int, int] = {}
            for member in sorted(at_order[start:end].tolist()):
                p = member - 1
                while p >= 0 and at_group[p] >= start:
                    p = at_previous[p]
                at_previous[member] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            moved: dict[int, list[tuple[int, int]]] = {}
            for p, times in pointed.items():
                moved.setdefault(at_group[p], []).append((times, p))
            for low, members in moved.items():
                held = at_size[low]
                if held == 1:
                    continue
                if len(members) > 1:
                    members.sort(reverse=True)
                last, begun = low + held, 0
                for times, p in members:
                    last -= 1
                    here = at_place[p]
                    if here != last:
                        other = at_order[last]
                        at_order[here], at_place[other] = other, here
                        at_order[last], at_place[p] = p, last
                    if times != begun:
                        begun, top = times, last
                    at_group[p] = -1 - top
                at_size[low] = last - low
                # the members of one count form a group, from its lowest place
                slot = last
                while slot < low + held:
                    top = -1 - at_group[at_order[slot]]
                    for i in range(slot, top + 1):
                        at_group[at_order[i]] = slot
                    at_size[slot] = top + 1 - slot
                    slot = top + 1
        end = start
    return group, previous


def _regroup(start: int, end: int, arrays: tuple[np.ndarray, ...], marked: np.ndarray) -> None:
    order, group, place, size, previous = arrays
    members = np.sort(order[start:end])
    p = members - 1
    previous[members] = p
    todo = np.flatnonzero((p >= 0) & (group[p] >= start))
    while len(todo):
        p[todo] = previous[p[todo]]
        previous[members[todo]] = p[todo]
        todo = todo[(p[todo] >= 0) & (group[p[todo]] >= start)]
    pointed, times = np.unique(p[p >= 0], return_counts=True)
    low = group[pointed]
    several = size[low] > 1
    pointed, times, low = pointed[several], times[several], low[several]
    if not len(pointed):
        return
    by = np.lexsort((times, low))
    pointed, times, low = pointed[by], times[by], low[by]
    new_low = np.diff(low, prepend=-1) != 0
    heads = np.flatnonzero(new_low)
    counts = np.diff(heads, append=len(low))
    tail = np.repeat(low[heads] + size[low[heads]] - counts, counts)
    target = tail + np.arange(len(low)) - np.repeat(heads, counts)
    marked[pointed] = True
    occupants = order[target]
    evicted = occupants[~marked[occupants]]
    here = place[pointed]
    left = here[here < tail]
    marked[pointed] = False
    left = left[np.argsort(group[order[left]], kind="stable")]
    order[left], place[evicted] = evicted, left
    order[target], place[pointed] = pointed, target
    size[low[heads]] -= counts.astype(np.int32)
    runs = np.flatnonzero(new_low | (np.diff(times, prepend=-1) != 0))
    lengths = np.diff(runs, append=len(low))
    size[target[runs]] = lengths
    group[pointed] = np.repeat(target[runs], lengths)


def _filled(group: np.ndarray, previous: np.ndarray) -> np.ndarray:
    n = len(group)
    out = np.empty(n, np.int32)
    free = np.arange(n, dtype=np.int32)
    at_out, at_free, at_group, at_previous = map(memoryview, (out, free, group, previous))
    open_ = bytearray(b"\1") * n
    at_out[0] = n - 1
    open_[n - 1] = 0
    for k in range(n):
        s = at_out[k] - 1
        while s >= 0 and open_[s]:
            open_[s] = 0
            g = at_group[s]
            f = at_free[g]
            at_out[f] = s
            at_free[g] = f + 1
            s = at_previous[s]
    return out
