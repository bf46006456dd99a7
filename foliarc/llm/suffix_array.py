"""Linear grouping construction of suffix arrays, for many strings at once.

Phase one groups suffixes by their Lyndon prefix: groups are processed in descending order, each
suffix gets a pointer to the previous smaller one, and the suffixes pointed at move to new groups
right above their old ones, ordered by how many pointers they received. Phase two emits the order
inside the groups by following the pointers from each suffix that is already placed; nothing is
renamed or sorted recursively. The strings of a batch advance in step, so each step is a few
NumPy operations over all of them.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings laid end to end in ``symbols``, as positions in ``symbols``.

    Each string must end with a symbol that is smaller than all its others.
    """
    total = len(symbols)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    key = row * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(total, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.flatnonzero(new)
    size = np.zeros(total, np.int64)
    size[first] = np.diff(np.append(first, total))
    slot = np.empty(total, np.int64)
    slot[order] = np.arange(total)
    group = np.empty(total, np.int64)
    group[order] = np.repeat(first, size[first])
    previous = lyndon_groups(order, slot, group, size, starts, ends)
    return emit(group, previous, starts, ends)


def lyndon_groups(order, slot, group, size, starts, ends) -> np.ndarray:
    """Refine ``group`` (named by its first slot) to Lyndon-prefix groups; returns the pointers."""
    previous = np.full(len(order), -1, np.int64)
    pointed = np.zeros(len(order), bool)
    floor, top = starts.copy(), ends.copy()
    while len(top):
        low = group[order[top - 1]]
        width = top - low
        members = order[ranges(low, width)]
        threshold = np.repeat(low, width)
        at = np.where(members == np.repeat(floor, width), -1, members - 1)
        previous[members] = at
        behind = np.flatnonzero((at >= 0) & (group[at] >= threshold))
        while len(behind):
            at[behind] = previous[at[behind]]
            previous[members[behind]] = at[behind]
            reached = at[behind]
            behind = behind[(reached >= 0) & (group[reached] >= threshold[behind])]
        split(np.sort(at[at >= 0]), order, slot, group, size, pointed)
        going = low > floor
        floor, top = floor[going], low[going]
    return previous


def split(hits, order, slot, group, size, pointed) -> None:
    """Move the suffixes in ``hits`` (sorted, repeated by pointers) above the rest of their groups, fewest pointers lowest."""
    if not len(hits):
        return
    edge = np.flatnonzero(np.append(True, hits[1:] != hits[:-1]))
    moved, count = hits[edge], np.diff(np.append(edge, len(hits)))
    old = group[moved]
    by = np.lexsort((count, old))
    moved, count, old = moved[by], count[by], old[by]
    group_edge = np.append(True, old[1:] != old[:-1])
    subset_edge = group_edge | np.append(True, count[1:] != count[:-1])
    head = np.flatnonzero(group_edge)
    taken = np.diff(np.append(head, len(old)))
    names = old[head]
    tail = names + size[names] - taken
    targets = ranges(tail, taken)
    tail_of = np.repeat(tail, taken)
    at = slot[moved]
    pointed[moved] = True
    sitting = order[targets]
    displaced = sitting[~pointed[sitting]]
    vacated = at[at < tail_of]
    pointed[moved] = False
    order[vacated], slot[displaced] = displaced, vacated
    order[targets], slot[moved] = moved, targets
    subset = np.flatnonzero(subset_edge)
    sizes = np.diff(np.append(subset, len(old)))
    size[names] -= taken
    size[targets[subset]] = sizes
    group[moved] = np.repeat(targets[subset], sizes)


def emit(group, previous, starts, ends) -> np.ndarray:
    """Place suffixes from the smallest up; each placed suffix places the one before it and that one's pointer chain."""
    total = len(group)
    result = np.full(total, -1, np.int64)
    placed = np.zeros(total, bool)
    free = np.arange(total)
    result[starts] = ends - 1
    placed[ends - 1] = True
    floor, last, reading = starts.copy(), ends.copy(), starts.copy()
    at = np.where(result[reading] > floor, result[reading] - 1, -1)
    while len(at):
        put = (at >= 0) & ~placed[at]
        now = at[put]
        home = group[now]
        result[free[home]] = now
        free[home] += 1
        placed[now] = True
        at[put] = previous[now]
        wait = np.flatnonzero(~put)
        reading[wait] += 1
        over = reading >= last
        if over.any():
            floor, last, reading, at = floor[~over], last[~over], reading[~over], at[~over]
            wait = np.flatnonzero(~put[~over])
        here = result[reading[wait]]
        at[wait] = np.where(here > floor[wait], here - 1, -1)
    return result
