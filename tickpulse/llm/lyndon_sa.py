"""Suffix arrays of many small texts at once by Lyndon-prefix groups.

The construction has two phases.  Phase 1 keeps the suffixes of a lane (one
independent text collection) in groups of equal context, highest group last.
Groups are taken in descending order; every suffix of the taken group looks up
its previous smaller suffix with pointers that skip everything already larger,
and the suffixes found that way extend their own context by the taken one, so
they move to new groups right above the rest of their old group.  When all are
taken each group holds the suffixes with one longest Lyndon prefix.  Phase 2
walks the ranks upwards and lets every emitted suffix place the suffixes that
it directly follows at the next free slot of their group.  Nothing is renamed
and nothing recurses.

Lanes never interact, so one numpy step serves the current group (phase 1) or
the current rank (phase 2) of all lanes together.
"""

from __future__ import annotations

import numpy as np


def _flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Indices where a new run of equal keys starts."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def suffix_arrays(text: np.ndarray, lane_starts: np.ndarray) -> np.ndarray:
    """Sorted suffix positions, lane after lane.

    ``text`` holds small non-negative integers (below 4096); 0 separates pieces
    and must be the first and the last value of every lane.  ``lane_starts`` has one entry per lane.
    Suffixes end at the next 0; equal suffixes come in any order.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    lane_starts = lane_starts.astype(kind)
    lane_sizes = np.diff(np.append(lane_starts, kind(n)))
    lane = np.repeat(np.arange(len(lane_starts)), lane_sizes)
    sa = np.argsort(lane * 4096 + text, kind="stable").astype(kind)
    first = _runs(lane[sa], text[sa]).astype(kind)
    sizes = np.diff(np.append(first, kind(n)))
    gid = np.empty(n, kind)
    gid[sa] = np.repeat(first, sizes)
    gend = np.zeros(n, kind)
    gend[first] = first + sizes
    rank = np.empty(n, kind)
    rank[sa] = np.arange(n, dtype=kind)
    separator = text == 0
    prev = np.full(n, -1, kind)
    moved = np.zeros(n, bool)
    cur = lane_starts + lane_sizes
    low = lane_starts + np.add.reduceat(separator.astype(kind), lane_starts)

    active = np.flatnonzero(cur > low)
    while len(active):
        end = cur[active]
        group = gid[sa[end - 1]]
        cur[active] = group
        sizes = end - group
        i = sa[_flat_ranges(group, sizes)]
        gi = np.repeat(group, sizes)
        j = i - 1
        gj = gid[j]
        up = np.flatnonzero(gj > gi)
        while len(up):
            j[up] = prev[j[up]]
            gj[up] = gid[j[up]]
            up = up[gj[up] > gi[up]]
        same = np.flatnonzero(gj == gi)
        prev[i] = j
        while len(same):  # repetitions of one context: hop to the first of them
            j[same] = prev[j[same]]
            same = same[gid[j[same]] == gi[same]]
        prev[i] = j
        hit = j[~separator[j]]
        if len(hit):
            hit.sort()
            at = _runs(hit)
            times = np.diff(np.append(at, len(hit))).astype(kind)
            p = hit[at]
            home = gid[p]
            order = np.lexsort((times, home))
            p, times, home = p[order], times[order], home[order]
            at = _runs(home)
            t = np.diff(np.append(at, len(p))).astype(kind)
            start = home[at]
            new_start = gend[start] - t
            slot = _flat_ranges(new_start, t)
            moved[p] = True
            there = sa[slot]
            staying = there[~moved[there]]
            old = rank[p]
            vacated = old[old < np.repeat(new_start, t)]
            sa[vacated] = staying
            rank[staying] = vacated
            sa[slot] = p
            rank[p] = slot
            moved[p] = False
            gend[start] = new_start
            at = _runs(home, times)
            t = np.diff(np.append(at, len(p))).astype(kind)
            gend[slot[at]] = slot[at] + t
            gid[p] = np.repeat(slot[at], t)
        active = active[cur[active] > low[active]]

    free = np.arange(n, dtype=kind)
    placed = separator.copy()
    by_size = np.argsort(-lane_sizes, kind="stable")
    starts, longest = lane_starts[by_size], lane_sizes[by_size]
    alive = np.searchsorted(-longest, -np.arange(int(longest[0])), side="left")
    for step, k in enumerate(alive):
        s = sa[starts[:k] + step] - 1
        s = s[~placed[s]]
        while len(s):
            g = gid[s]
            slot = free[g]
            free[g] = slot + 1
            sa[slot] = s
            placed[s] = True
            s = prev[s]
            s = s[~placed[s]]
    return sa
