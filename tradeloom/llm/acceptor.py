"""A minimised acceptor of many word groups at once, and its composition with one edit.

The words of a group are the paths from the group's own initial state. States are minimised over
all groups together: equal right languages are one state, found bottom-up by height (letters to
the end). Every state knows how many words it accepts and every edge how many come before it, so
the sum along a path numbers the word among its group's sorted words, and no path needs its letters.

`pairs` enumerates what the composition acceptor - one edit - acceptor accepts: it walks pairs of
states, first in step (both on the same letters), then after one substitution, or one letter more
on the second side. After the edit both sides must read the same letters; once their states are
equal, all the words these accept are pairs and none has to be walked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tradeloom.llm.text import spans

_LETTERS = 256
_SLICE = 1 << 20
_NONE = np.zeros(0, np.int64)


@dataclass
class Level:
    """The states of one height, as runs of edges sorted by letter."""

    first: np.ndarray  # per state
    degree: np.ndarray
    words: np.ndarray
    letter: np.ndarray  # per edge
    target: np.ndarray  # a state of the height below
    before: np.ndarray  # words of the state on earlier edges

    def __post_init__(self) -> None:
        self.key = np.repeat(np.arange(len(self.first)), self.degree) * _LETTERS + self.letter

    def edges(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `states`, edge) of every edge of the given states."""
        degree = self.degree[states]
        return np.repeat(np.arange(len(states)), degree), spans(self.first[states], degree)

    def on(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state on the letter beside it, and whether there is one."""
        wanted = states * _LETTERS + letters
        edge = np.minimum(np.searchsorted(self.key, wanted), max(0, len(self.key) - 1))
        return edge, self.key[edge] == wanted if len(self.key) else np.zeros(len(states), bool)


class Acceptor:
    """Built from words as bytes, sorted within each of the ascending `groups`, no word twice in a
    group, the words of a group of one length.

    levels[h]      states of height h; height 0 is the one final state
    starts[h]      per height, the rows at which a state's range of words begins
    state_at[h]    the state there
    """

    def __init__(self, words: list[bytes], groups: np.ndarray):
        self.length = np.array([len(w) for w in words], np.int64)
        self._data = np.frombuffer(b"".join(words), np.uint8)
        self._at = np.cumsum(self.length) - self.length
        shared = self._shared(groups)
        final = Level(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), _NONE, _NONE, _NONE)
        self.levels = [final]
        self.starts = [np.arange(len(words))]
        self.state_at = [np.zeros(len(words), np.int64)]
        for height in range(1, int(self.length.max(initial=0)) + 1):
            self._add(height, shared)

    def _shared(self, groups: np.ndarray) -> np.ndarray:
        """Leading letters that each word shares with the one before; -1 where a group begins."""
        shared = np.full(len(groups), -1, np.int64)
        live = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        shared[live] = 0
        place = 0
        while len(live):
            live = live[self.length[live] > place]
            live = live[self._data[self._at[live] + place] == self._data[self._at[live - 1] + place]]
            place += 1
            shared[live] = place
        return shared

    def _add(self, height: int, shared: np.ndarray) -> None:
        below = self.starts[-1]
        tall = self.length[below] >= height
        child, target = below[tall], self.state_at[-1][tall]
        letter = self._data[self._at[child] + self.length[child] - height].astype(np.int64)
        opens = shared[child] < self.length[child] - height
        start = child[opens]
        parent = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        degree = np.diff(np.r_[first, len(child)])
        state = np.zeros(len(start), np.int64)
        chosen, n = [], 0
        edge = target * _LETTERS + letter
        for d in np.unique(degree):  # equal states have equal edges
            own = np.flatnonzero(degree == d)
            _, sample, kind = np.unique(edge[first[own][:, None] + np.arange(d)], axis=0, return_index=True, return_inverse=True)
            state[own] = kind.ravel() + n
            chosen.append(own[sample])
            n += len(sample)
        chosen = np.concatenate(chosen) if chosen else _NONE
        kept = spans(first[chosen], degree[chosen])
        before = child - start[parent]
        words = self.levels[-1].words[target]
        total = np.bincount(parent, weights=words, minlength=len(start)).astype(np.int64)
        many = degree[chosen]
        self.levels.append(Level(np.cumsum(many) - many, many, total[chosen], letter[kept], target[kept], before[kept]))
        self.starts.append(start)
        self.state_at.append(state)

    def initial(self, rows: np.ndarray) -> np.ndarray:
        """The initial states of the groups that begin at these rows."""
        state = np.zeros(len(rows), np.int64)
        for height in np.unique(self.length[rows]):
            own = np.flatnonzero(self.length[rows] == height)
            state[own] = self.state_at[height][np.searchsorted(self.starts[height], rows[own])]
        return state


class _Composition:
    """Pairs of states between two heights, and the accepted pairs of rows so far."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.edited: list[list[tuple]] = [[] for _ in acceptor.levels]
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def after_edit(self, height: int, p, q, i, k) -> None:
        """Entries that must read the same letters to the end: equal states are accepted with all
        their words, the others wait for their height."""
        for at in range(0, len(p), _SLICE):
            s = slice(at, at + _SLICE)
            self._step(height, p[s], q[s], i[s], k[s])

    def _step(self, height: int, p, q, i, k) -> None:
        same = p == q
        if same.any():
            many = self.a.levels[height].words[p[same]]
            self.found.append((spans(i[same], many), spans(k[same], many)))
        if height and not same.all():
            p, q, i, k = (v[~same] for v in (p, q, i, k))
            level = self.a.levels[height]
            entry, mine = level.edges(p)
            yours, met = level.on(q[entry], level.letter[mine])
            entry, mine, yours = entry[met], mine[met], yours[met]
            if len(entry):
                self.edited[height - 1].append(
                    (level.target[mine], level.target[yours], i[entry] + level.before[mine], k[entry] + level.before[yours])
                )

    def finish(self, height: int) -> None:
        for entry in self.edited[height]:
            self.after_edit(height, *entry)
        self.edited[height].clear()


def _slices(weights: np.ndarray):
    """Runs of entries whose weights add up to about _SLICE."""
    run = np.cumsum(weights) // _SLICE
    cuts = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(weights)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def pairs(acceptor: Acceptor, short: np.ndarray, long: np.ndarray, at_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row, row) of words that differ by one letter, per group.

    short   first rows of groups; pairs by substitution lie inside one of them
    long    for each of them the first row of the group of words one letter longer, or -1: pairs
            by insertion, the shorter word first
    at_end  whether the letter may be added after the last one (elsewhere it always may)
    """
    work, levels = _Composition(acceptor), acceptor.levels
    height_of = acceptor.length[short]
    state = acceptor.initial(short)
    longer = np.flatnonzero(long >= 0)
    long_state = np.zeros(len(short), np.int64)
    long_state[longer] = acceptor.initial(long[longer])
    q = i = p = r = u = v = _NONE  # in step: (q, i) one side; (p, r, u, v) short and long
    end = np.zeros(0, bool)
    for h in range(len(levels) - 1, -1, -1):
        new = np.flatnonzero(height_of == h)
        q, i = np.r_[q, state[new]], np.r_[i, short[new]]
        new = longer[height_of[longer] == h]
        p, r, u, v = np.r_[p, state[new]], np.r_[r, long_state[new]], np.r_[u, short[new]], np.r_[v, long[new]]
        end = np.r_[end, at_end[new]]
        q, i = _substitute(work, h, q, i)
        p, r, u, v, end = _insert(work, h, p, r, u, v, end)
        work.finish(h)
    if not work.found:
        return _NONE, _NONE
    left, right = zip(*work.found, strict=True)
    return np.concatenate(left), np.concatenate(right)


def _substitute(work: _Composition, h: int, q, i):
    """Two different letters now, or one step on the same letter."""
    if not h:
        return _NONE, _NONE
    level = work.a.levels[h]
    wide = np.flatnonzero(level.degree[q] > 1)
    degree = level.degree[q[wide]]
    for s in _slices(degree * (degree - 1) // 2):
        entry, edge = level.edges(q[wide[s]])
        last = (level.first + level.degree)[q[wide[s]]][entry]
        later = last - edge - 1  # edges of the state after this one
        a, b = np.repeat(edge, later), spans(edge + 1, later)
        base = np.repeat(i[wide[s]][entry], later)
        work.after_edit(h - 1, level.target[a], level.target[b], base + level.before[a], base + level.before[b])
    entry, edge = level.edges(q)
    return level.target[edge], i[entry] + level.before[edge]


def _insert(work: _Composition, h: int, p, r, u, v, end):
    """One letter of the longer word now, or one step on the same letter.

    The letter is inserted where the words first differ: the shorter word's next letter is
    another one. So each pair is found once.
    """
    if h + 1 >= len(work.a.levels) or not len(p):
        return _NONE, _NONE, _NONE, _NONE, np.zeros(0, bool)
    above, level = work.a.levels[h + 1], work.a.levels[h]
    allowed = np.flatnonzero(end) if not h else np.arange(len(p))
    for s in _slices(above.degree[r[allowed]] * np.maximum(1, level.degree[p[allowed]])):
        some = allowed[s]
        entry, edge = above.edges(r[some])
        if not h:
            work.after_edit(0, p[some][entry], above.target[edge], u[some][entry], v[some][entry] + above.before[edge])
            continue
        which, mine = level.edges(p[some][entry])
        after = above.target[edge][which]
        yours, met = level.on(after, level.letter[mine])
        met &= level.letter[mine] != above.letter[edge][which]
        which, mine, yours = which[met], mine[met], yours[met]
        at, inserted = some[entry[which]], edge[which]
        work.after_edit(
            h - 1, level.target[mine], level.target[yours], u[at] + level.before[mine],
            v[at] + above.before[inserted] + level.before[yours],
        )
    if not h:
        return _NONE, _NONE, _NONE, _NONE, np.zeros(0, bool)
    entry, mine = level.edges(p)
    yours, met = above.on(r[entry], level.letter[mine])
    entry, mine, yours = entry[met], mine[met], yours[met]
    return level.target[mine], above.target[yours], u[entry] + level.before[mine], v[entry] + above.before[yours], end[entry]
