"""A minimal acyclic transducer from words to id sequences, memory-mapped from one file.

The words are the paths of a deterministic automaton whose equal suffixes share states.
Each arc carries how many words of its state sort before it; their sum along a path is
the word's rank, which points at its ids. So outputs never keep suffixes apart.
"""

from __future__ import annotations

import numpy as np

_FIELDS = ("arcs", "targets", "skips", "final", "begins", "ids")


def compile_lexicon(words: dict[bytes, np.ndarray]) -> np.ndarray:
    """One int64 array that holds the automaton and the outputs of `words` (no empty word)."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # path[k] is the unfinished state after k bytes: [final, [(byte, state), ...]].
    path: list[list] = [[False, []]]
    last = b""
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for k in range(len(last), same, -1):
            done = freeze(path.pop())
            path[-1][1].append((last[k - 1], done))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        done = freeze(path.pop())
        path[-1][1].append((last[k - 1], done))
    root = freeze(path.pop())

    # States are numbered so that the root is 0; children were frozen before their parents.
    number = {s: len(states) - 1 - s for s in range(len(states))}
    if number[root] != 0:
        raise AssertionError("the root is frozen last")
    below = [0] * len(states)
    arcs, targets, skips = [], [], []
    for s, (final, out) in enumerate(states):
        below[s] = int(final)
        for byte, to in out:
            arcs.append((number[s] << 8) | byte)
            targets.append(number[to])
            skips.append(below[s])
            below[s] += below[to]
    by = np.argsort(np.array(arcs, np.int64)) if arcs else np.zeros(0, np.int64)
    outputs = [np.asarray(words[w], np.int64) for w in order]
    fields = {
        "arcs": np.array(arcs, np.int64)[by],
        "targets": np.array(targets, np.int64)[by],
        "skips": np.array(skips, np.int64)[by],
        "final": np.array([f for f, _ in reversed(states)], np.int64),
        "begins": np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64),
        "ids": np.concatenate(outputs) if outputs else np.zeros(0, np.int64),
    }
    head = np.array([len(fields[k]) for k in _FIELDS], np.int64)
    return np.concatenate([head, *(fields[k] for k in _FIELDS)])


class Lexicon:
    """Look-ups in a compiled lexicon: an array, or the path of an .npy file to map."""

    def __init__(self, source: np.ndarray | str):
        data = np.load(source, mmap_mode="r") if isinstance(source, str) else source
        at = np.concatenate([[0], np.cumsum(data[: len(_FIELDS)])]) + len(_FIELDS)
        for k, name in enumerate(_FIELDS):
            setattr(self, name, data[at[k] : at[k + 1]])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon lacks it; all words step together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.arcs):
            return np.full(len(words), -1)
        live, depth = np.arange(len(words)), 0
        while len(live := live[size[live] > depth]):
            key = (state[live] << 8) | raw[begin[live] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live] = self.targets[arc]
            rank[live] += self.skips[arc]
            depth += 1
        hit = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(hit, rank, -1)

    def output(self, rank: int) -> np.ndarray:
        return self.ids[self.begins[rank] : self.begins[rank + 1]]
