"""Suffix arrays by linear grouping, for many short texts in lockstep.

Phase one puts suffixes with equal Lyndon prefixes into one group.  It walks
the groups from the highest down.  Every suffix of the group at hand finds, over
previous-smaller pointers, the nearest position to its left whose group is
lower; those positions' prefixes grow by the group's prefix (once per repeat),
so they move into new groups right behind their old ones.  Phase two emits the
order inside the groups: reading the finished part of the array from the left,
every suffix settles the position before it and then that position's chain of
pointers.  No names are given anew and nothing recurses.

The texts do not depend on each other, so each step is taken for all of them
at once with array operations: in a step, every text handles its own highest
unfinished group, or its own next rank.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+count[0]-1, start[1].. and so on, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array of every text of a block.

    ``symbols`` holds the texts one after another; text ``l`` is
    ``symbols[bounds[l]:bounds[l + 1]]``.  Zero is a separator: every text ends
    with one and may hold more, no suffix is compared beyond one, and equal
    suffixes stand in the order of their separators.  Returns positions in
    ``symbols``, text by text, each text's sorted.
    """
    n, texts = len(symbols), len(bounds) - 1
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(-np.diff(bounds), kind="stable")  # longest first: the texts still at work are a prefix
    length = np.diff(bounds)[order].astype(np.int64)
    # One separator stands in front of everything, so that position 0 always ends a walk to the left.
    source = np.concatenate([[0], _ranges(bounds[:-1][order], length) + 1])
    sym = np.concatenate([[0], symbols])[source].astype(np.int32)
    base = np.concatenate([[1], 1 + np.cumsum(length)[:-1]])

    lane = np.repeat(np.arange(texts), length)
    sa = np.empty(n + 1, np.int64)
    sa[0] = 0
    sa[1:] = np.argsort(lane * 512 + sym[1:], kind="stable") + 1
    fresh = np.ones(n + 1, bool)
    key = sym[sa]
    fresh[2:] = (key[2:] != key[1:-1])
    fresh[base] = True
    head = np.flatnonzero(fresh)
    size = np.zeros(n + 2, np.int64)
    size[head] = np.diff(np.append(head, n + 1))
    group = np.empty(n + 1, np.int64)
    group[sa] = np.repeat(head, size[head])
    at = np.empty(n + 1, np.int64)
    at[sa] = np.arange(n + 1)
    before = np.zeros(n + 1, np.int64)
    moving = np.zeros(n + 1, bool)

    top, floor = base + length, base.copy()
    while True:
        g = group[sa[top - 1]]
        work = g > floor  # the separators' group is the lowest and needs nothing
        if not work.all():
            top, floor, g = top[work], floor[work], g[work]
            if not len(g):
                break
        count = top - g
        member = sa[_ranges(g, count)]
        own = np.repeat(g, count)
        top = g
        # the nearest position to the left in a lower group, over finished groups' pointers
        left = member - 1
        high = np.flatnonzero(group[left] > own)
        while len(high):
            left[high] = before[left[high]]
            high = high[group[left[high]] > own[high]]
        before[member] = left
        chain = np.flatnonzero(group[left] == own)
        while len(chain):  # repeats of the same prefix, one after another: by doubling
            step = before[left[chain]]
            left[chain] = step
            before[member[chain]] = step
            chain = chain[group[step] == own[chain]]
        target = left[sym[left] > 0]
        if not len(target):
            continue
        target, times = np.unique(target, return_counts=True)
        home = group[target]
        rank = np.lexsort((times, home))
        target, times, home = target[rank], times[rank], home[rank]
        new_home = np.ones(len(home), bool)
        new_home[1:] = home[1:] != home[:-1]
        first = np.flatnonzero(new_home)
        moved = np.diff(np.append(first, len(home)))
        tail = home[first] + size[home[first]] - moved
        size[home[first]] -= moved
        slot = _ranges(tail, moved)
        split = new_home.copy()
        split[1:] |= times[1:] != times[:-1]
        start = np.flatnonzero(split)
        into = slot[start]
        size[into] = np.diff(np.append(start, len(slot)))
        group[target] = np.repeat(into, size[into])
        # what moves takes the end of its old group's range; what stood there fills the holes
        moving[target] = True
        there = sa[slot]
        out = there[~moving[there]]
        now = at[target]
        hole = now[now < np.repeat(tail, moved)]
        sa[hole] = out
        at[out] = hole
        sa[slot] = target
        at[target] = slot
        moving[target] = False

    placed = sym == 0
    result = np.zeros(n + 1, np.int64)
    free = np.arange(n + 2)
    ends = np.flatnonzero(placed)[1:]
    result[np.sort(at[ends])] = ends
    for r in range(int(length[0])):
        alive = int(np.searchsorted(-length, -r, "left"))
        j = result[base[:alive] + r] - 1
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
            j = j[~placed[j]]
    ordered = np.empty(n, np.int64)
    ordered[_ranges(bounds[:-1][order], length)] = source[result[1:]] - 1
    return ordered
