"""A minimal acyclic transducer from words to token ids, in one file that workers map into memory.

States that accept the same endings are one state (built word by word from a sorted list).
Each arc carries how many words come before those behind it, so the sum along a word's path
is the word's number, and the number selects its ids. Many words walk through the automaton
at once, one byte a step.
"""

from __future__ import annotations

import mmap
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_MAGIC = 0x58454C4F44
_FIELDS = ("classes", "table", "target", "before", "final", "offsets", "ids")


class Lexicon:
    def __init__(self, classes: np.ndarray, table: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.classes, self.table, self.target, self.before, self.final, self.offsets, self.ids = classes, table, target, before, final, offsets, ids
        self.width = int(classes.max(initial=0)) + 1

    @property
    def states(self) -> int:
        return len(self.final)

    @classmethod
    def build(cls, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Lexicon:
        """words: distinct; any order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of finished states: (final, ((byte, state), ...))

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        labels = b""
        for k in order:
            word = words[k]
            common = 0
            while common < min(len(word), len(labels)) and word[common] == labels[common]:
                common += 1
            while len(path) > common + 1:
                node = path.pop()
                path[-1][1].append((labels[len(path) - 1], freeze(node)))
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            labels = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((labels[len(path) - 1], freeze(node)))
        root = freeze(path[0])
        below = np.zeros(len(arcs), np.int64)  # children are finished before their parents
        target, before, at = [], [], {}
        used = sorted({b for _, out in arcs for b, _ in out})
        classes = np.zeros(256, np.int32)  # 0: no word has this byte
        classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        table = np.full((len(arcs), width), -1, np.int32)
        for state, (final, out) in enumerate(arcs):
            passed = int(final)
            for byte, to in out:
                table[state, classes[byte]] = len(target)
                target.append(to)
                before.append(passed)
                passed += int(below[to])
            below[state] = passed
        del at
        final = np.array([f for f, _ in arcs], np.uint8)
        lengths = np.array([len(ids[k]) for k in order], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.array([i for k in order for i in ids[k]], np.int32)
        # The root comes first, so that every walk begins at 0.
        swap = np.arange(len(arcs))
        swap[0], swap[root] = root, 0
        return cls(classes, np.ascontiguousarray(table[swap]), swap[np.array(target, np.int64)].astype(np.int32), np.array(before, np.int32), final[swap], offsets, flat)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each byte span's number, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.offsets) - 1 or not len(starts):
            return out
        which = np.argsort(-lengths, kind="stable")
        state, number = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size, begin = lengths[which], starts[which]
        flat, step = self.table.reshape(-1), 0
        while True:
            over = int(np.searchsorted(-size, -step, "left"))  # spans longer than step come first
            ended = slice(over, len(which))
            ok = self.final[state[ended]].astype(bool)
            out[which[ended][ok]] = number[ended][ok]
            which, state, number, size, begin = (x[:over] for x in (which, state, number, size, begin))
            if not over:
                return out
            arc = flat[state * self.width + self.classes[data[begin + step]]]
            alive = arc >= 0
            if not alive.all():
                arc, which, number, size, begin = arc[alive], which[alive], number[alive], size[alive], begin[alive]
            number = number + self.before[arc]
            state = self.target[arc].astype(np.int64)
            step += 1

    def save(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, f)).reshape(-1) for f in _FIELDS]
        head = np.array([_MAGIC, *(n for a in arrays for n in (a.itemsize, a.size))], np.int64).tobytes()
        return b"".join([head, *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)])

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        head = data[: 8 * (1 + 2 * len(_FIELDS))].view(np.int64)
        if head[0] != _MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        at, arrays = head.nbytes, []
        kinds = {"final": np.uint8, "offsets": np.int64}
        for k, field in enumerate(_FIELDS):
            item, size = (int(x) for x in head[1 + 2 * k : 3 + 2 * k])
            arrays.append(data[at : at + item * size].view(kinds.get(field, np.int32)))
            at += item * size + -item * size % 8
        arrays[1] = arrays[1].reshape(len(arrays[4]), -1)
        return cls(*arrays)


@lru_cache(2)
def opened(path: str) -> Lexicon:
    """The worker's own map of the file."""
    return Lexicon.open(path)
