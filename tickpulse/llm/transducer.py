"""A minimal acyclic transducer from words to token ids, kept in one file that is memory-mapped.

Words share prefixes and suffixes in one automaton.  Every transition carries the
number of words that sort before it in its state, so the sum along a path is the
word's number, and the numbers index the id lists.  All words of a batch walk the
automaton together, one byte per step.
"""

from __future__ import annotations

import numpy as np

_MAGIC = b"MATW0001"


def build(words: list[bytes], ids: list[list[int]]) -> bytes:
    """File for distinct, sorted, non-empty words; the output of a word is its id list."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is final, ((label, target), ...)) of every finished state
    reach: list[int] = []  # words accepted from it
    path: list[list] = [[False, []]]  # unfinished states along the last word: final, transitions

    def finish(down_to: int) -> None:
        while len(path) > down_to:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            number = register.get(key)
            if number is None:
                number = register[key] = len(states)
                states.append(key)
                reach.append(final + sum(reach[t] for _, t in arcs))
            if path:
                path[-1][1][-1] = (path[-1][1][-1][0], number)

    last = b""
    for w in words:
        if w <= last:
            raise ValueError("words must be sorted, distinct and not empty")
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        finish(same + 1)
        for c in w[same:]:
            path[-1][1].append((c, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    finish(0)
    root = len(states) - 1
    key, target, skip = [], [], []
    for number, (final, arcs) in enumerate(states):
        before = int(final)
        for label, to in arcs:
            key.append(number << 8 | label)
            target.append(to)
            skip.append(before)
            before += reach[to]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    arrays = [
        np.array([root, len(states), len(key), len(words)], np.int64),
        np.array(key, np.int64),
        np.array(target, np.int64),
        np.array(skip, np.int64),
        np.array([s[0] for s in states], np.int64),
        np.append(0, np.cumsum(sizes)),
        np.array([x for i in ids for x in i], np.int64),
    ]
    return _MAGIC + b"".join(a.astype(np.int64).tobytes() for a in arrays)


class Transducer:
    """Reads a file made by ``build`` (a memory map, or any ``uint8`` array)."""

    def __init__(self, raw: np.ndarray):
        if bytes(raw[:8]) != _MAGIC:
            raise ValueError("not a transducer file")
        data = raw[8:].view(np.int64)
        self.root, states, arcs, words = map(int, data[:4])
        edges = np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        self.key, self.target, self.skip, final, self.first = (data[a:b] for a, b in zip(edges[:-1], edges[1:]))
        self.final, self.ids = final, data[edges[-1] :]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for words that are not in the automaton."""
        n = len(words)
        number = np.zeros(n, np.int64)
        if not n or not len(self.key):
            return number - 1
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state = np.full(n, self.root, np.int64)
        walking, step = np.flatnonzero(size > 0), 0
        state[size == 0] = -1
        while len(walking):
            want = state[walking] << 8 | flat[start[walking] + step]
            at = np.searchsorted(self.key, want)
            at[at == len(self.key)] = 0
            ok = self.key[at] == want
            state[walking] = np.where(ok, self.target[at], -1)
            number[walking] += self.skip[at]
            step += 1
            walking = walking[ok & (size[walking] > step)]
        done = state >= 0
        done[done] = self.final[state[done]] > 0
        return np.where(done, number, -1)

    def output(self, number: int) -> list[int]:
        return self.ids[int(self.first[number]) : int(self.first[number + 1])].tolist()
