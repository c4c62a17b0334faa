"""Suffix arrays of many short texts by linear grouping (no renaming).

The construction works on groups of suffixes that share their context, the
prefix known so far; groups are kept in lexicographic order.  Phase one
takes the groups in descending order.  Each suffix of the group taken finds
its previous smaller pointer, the nearest position to the left in a smaller
group; the suffix pointed at appends the group's context to its own (as often
as it is pointed at), and moves to a new group just above its old one.  When
all groups are done a suffix's context is its Lyndon prefix.  Phase two emits
the order within the groups: suffixes are visited in ascending order, and
each visit places the suffix before it and that one's chain of pointers at
the front of their groups.

One text gives little work per step, so the texts of a batch advance
together: step n takes the n-th group of every text, with numpy.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. , as one array."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class SuffixGroups:
    """State of the construction for a batch of texts.

    ``symbols`` holds the texts one after the other, each with a last symbol
    that is smaller than all its others; ``ends`` holds where they end.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        kind = np.int32 if n < 1 << 31 else np.int64
        self.high = ends.astype(kind)
        self.low = np.concatenate([[0], self.high[:-1]]).astype(kind)
        self.text_of = np.repeat(np.arange(len(ends)), self.high - self.low)
        key = self.text_of * (int(symbols.max()) + 1 if n else 1) + symbols
        self.order = np.argsort(key, kind="stable").astype(kind)
        first = np.concatenate([[True], np.diff(key[self.order]) != 0]) if n else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        self.size = np.zeros(n, kind)
        self.size[starts] = np.diff(np.append(starts, n))
        self.place = np.empty(n, kind)
        self.place[self.order] = np.arange(n)
        self.group = np.empty(n, kind)
        self.group[self.order] = np.repeat(starts, self.size[starts])
        self.previous = np.full(n, -1, kind)
        self.seen = np.full(n, -1, kind)

    def _pointers(self, s: np.ndarray, group: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Nearest position left of each s whose group is smaller; below
        ``low`` if there is none."""
        q = s - 1
        todo = np.flatnonzero(q >= low)
        todo = todo[self.group[q[todo]] >= group[todo]]
        while len(todo):
            at = q[todo]
            at = np.where(self.group[at] > group[todo], self.previous[at], at - 1)
            q[todo] = at
            todo = todo[at >= low[todo]]
            todo = todo[self.group[q[todo]] >= group[todo]]
        return q

    def _append(self, p: np.ndarray, times: np.ndarray, step: int) -> None:
        """Move each p, pointed at ``times`` times, above the rest of its group."""
        by = np.argsort(self.group[p] * (int(times.max()) + 1) + times)
        p, times = p[by], times[by]
        old = self.group[p]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        head = np.flatnonzero(new_group)
        moved = np.diff(np.append(head, len(p)))
        base = old[head] + self.size[old[head]] - moved
        target = _ranges(base, moved)
        # what stands at the targets and does not move there goes to the places left
        now = self.place[p]
        self.seen[p] = step
        there = self.order[target]
        there = there[self.seen[there] != step]
        left = now[now < np.repeat(base, moved)]
        self.order[left], self.place[there] = there, left
        self.order[target], self.place[p] = p, target
        new_part = new_group | np.concatenate([[True], times[1:] != times[:-1]])
        part = np.flatnonzero(new_part)
        count = np.diff(np.append(part, len(p)))
        self.size[old[head]] -= moved
        self.size[target[part]] = count
        self.group[p] = np.repeat(target[part], count)

    def lyndon_groups(self) -> None:
        """Phase one: groups in descending order."""
        high, step = self.high.copy(), 0
        live = np.flatnonzero(high > self.low)
        while len(live):
            start = self.group[self.order[high[live] - 1]]
            size = high[live] - start
            s = self.order[_ranges(start, size)]
            high[live] = start
            low = np.repeat(self.low[live], size)
            q = self._pointers(s, np.repeat(start, size), low)
            self.previous[s] = np.where(q >= low, q, -1)
            p = q[q >= low]
            if len(p):
                p.sort()
                head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                self._append(p[head], np.diff(np.append(head, len(p))), step)
            step += 1
            live = live[high[live] > self.low[live]]

    def emit(self) -> np.ndarray:
        """Phase two: all suffixes in order, text after text."""
        out = np.empty_like(self.order)
        front = np.arange(len(self.order), dtype=self.order.dtype)
        placed = np.zeros(len(self.order), bool)
        ends = self.high - 1
        some = self.high > self.low
        out[self.low[some]] = ends[some]            # the last symbol is the smallest suffix
        placed[ends[some]] = True
        at = self.low.copy()
        live = np.flatnonzero(some)
        while len(live):
            low = self.low[live]
            q = out[at[live]] - 1
            todo = np.flatnonzero(q >= low)
            q, low = q[todo], low[todo]
            while len(q):
                fresh = ~placed[q]
                q, low = q[fresh], low[fresh]
                g = self.group[q]
                out[front[g]] = q
                front[g] += 1
                placed[q] = True
                q = self.previous[q]
                up = q >= low
                q, low = q[up], low[up]
            at[live] += 1
            live = live[at[live] < self.high[live]]
        return out


def suffix_arrays(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` so that each text's range holds its suffixes
    in lexicographic order."""
    groups = SuffixGroups(symbols, ends)
    groups.lyndon_groups()
    return groups.emit()
