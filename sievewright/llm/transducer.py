"""A lexicon as a minimal acyclic transducer: words share prefixes and suffixes, numbers on the way add up to ids' places."""

from __future__ import annotations

import numpy as np


def _states(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions and finality of the states of the smallest automaton that accepts the words, and its first state.

    Words come in ascending order. What can't change any more, the suffix that a word doesn't share with the next, is
    replaced by equal states that are there already.
    """
    edges: list[dict[int, int]] = [{}]
    final, known, path, last = [False], {}, [0], b""

    def settle(to: int) -> None:
        while len(path) - 1 > to:
            state = path.pop()
            edges[path[-1]][last[len(path) - 1]] = known.setdefault((final[state], tuple(edges[state].items())), state)

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(shared)
        for byte in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    return edges, final, 0


def _place(used: np.ndarray, steps: np.ndarray, window: int = 4096) -> int:
    """The first base, from 0 on, whose cells for all steps are free; beyond what is in use all are."""
    for at in range(0, len(used) - 256, window):
        free = np.ones(min(window, len(used) - 256 - at), bool)
        for b in steps.tolist():
            free &= ~used[at + b : at + b + len(free)]
        if free.any():
            return at + int(free.argmax())
    return len(used) - 256


def compiled(entries: dict[bytes, list[int]]) -> np.ndarray:
    """Words and their ids as one array of 32-bit numbers, to be mapped into memory; words are not empty.

    A transition of state s by byte b is in cell base[s] + b, if that cell's owner is s. It has a number: how many words
    come before those that go this way. A word's numbers add up to its rank, at which its ids are found.
    """
    words = sorted(entries)
    edges, final, root = _states(words)
    reached, order = {root}, [root]
    for state in order:
        for to in edges[state].values():
            if to not in reached:
                reached.add(to)
                order.append(to)
    accepted: dict[int, int] = {}
    stack = [root]
    while stack:
        state = stack[-1]
        left = [to for to in edges[state].values() if to not in accepted]
        if left:
            stack += left
        else:
            accepted[stack.pop()] = final[state] + sum(accepted[to] for to in edges[state].values())
    name = {state: i for i, state in enumerate(order)}
    base, used = np.zeros(len(order), np.int32), np.zeros(1 << 12, bool)
    cells: dict[int, tuple[int, int, int]] = {}
    for state in sorted(order, key=lambda s: -len(edges[s])):
        steps = list(edges[state])
        if not steps:
            continue
        base[name[state]] = at = _place(used, np.array(steps))
        if at + 768 > len(used):
            used = np.concatenate([used, np.zeros_like(used)])
        used[at + np.array(steps)] = True
        number = int(final[state])
        for b in steps:
            cells[at + b] = (name[state], name[edges[state][b]], number)
            number += accepted[edges[state][b]]
    owner = np.full(max(cells, default=0) + 257, -1, np.int32)
    target, number = np.zeros_like(owner), np.zeros_like(owner)
    for cell, (s, to, n) in cells.items():
        owner[cell], target[cell], number[cell] = s, to, n
    lengths = np.array([len(entries[w]) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.array([i for w in words for i in entries[w]], np.int32)
    head = [len(base), len(owner), len(words), len(flat), max(map(len, words), default=0)]
    return np.concatenate([np.array(head, np.int32), base, np.array([final[s] for s in order], np.int32), owner, target, number, starts, flat])


class Transducer:
    """A compiled lexicon; `memory` may be a mapped file."""

    def __init__(self, memory: np.ndarray):
        states, cells, words, ids, self.longest = memory[:5].tolist()
        cut = np.split(memory[5:], np.cumsum([states, states, cells, cells, cells, words + 1]))
        self.base, self.final, self.owner, self.target, self.number, self.starts, self.flat = cut
        assert len(self.flat) == ids
        self.states, self.words = states, words

    def ranks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rank of each word (bytes of data between offsets), -1 where it isn't in the lexicon; all words take their
        steps side by side."""
        n = len(offsets) - 1
        out, length = np.full(n, -1, np.int64), np.diff(offsets)
        at = np.flatnonzero((length <= self.longest) & (length > 0))
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step in range(self.longest):
            if not len(at):
                break
            cell = self.base[state].astype(np.int64) + data[offsets[at] + step]
            ok = self.owner[cell] == state
            at, cell, total = at[ok], cell[ok], total[ok]
            state, total = self.target[cell].astype(np.int64), total + self.number[cell]
            done = length[at] == step + 1
            ends = done & (self.final[state] != 0)
            out[at[ends]] = total[ends]
            at, state, total = at[~done], state[~done], total[~done]
        return out
