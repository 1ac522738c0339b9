"""A HAT-trie over word ids: hash containers under a shallow trie of ranges.

A phrase is a path of up to three word ids.  Nodes hold containers side by side, each
for a range of the next word.  A container that outgrows ``burst`` splits its range in
two; one whose range is a single word becomes a node for the word after it.  Phrases are
one whole number each, ``BITS`` bits a word and 0 where a shorter phrase has ended.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np

BITS = 21
DEPTH = 3
MAX_ID = (1 << BITS) - 1


def path_keys(first: np.ndarray, second: np.ndarray | int = 0, third: np.ndarray | int = 0) -> np.ndarray:
    """One number per phrase; the order of the numbers is the order of the paths."""
    return (first.astype(np.int64) << (2 * BITS)) | (np.int64(1) * second << BITS) | third


def path_words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keys >> (2 * BITS), (keys >> BITS) & MAX_ID, keys & MAX_ID


class _Node:
    """Children in order of the word at ``level``; ``starts[i]`` is the first key of child i."""

    def __init__(self, level: int, start: int, child: Counter) -> None:
        self.level = level
        self.starts = [start]
        self.children: list[Counter | _Node] = [child]

    def add(self, keys: np.ndarray, burst: int) -> None:
        """Count sorted keys, all of which lie below this node."""
        cuts = [0, *np.searchsorted(keys, self.starts[1:]).tolist(), len(keys)]
        grown = []
        for i, child in enumerate(self.children):
            part = keys[cuts[i]:cuts[i + 1]]
            if not len(part):
                continue
            if isinstance(child, _Node):
                child.add(part, burst)
            else:
                child.update(part.tolist())
                if len(child) > burst:
                    grown.append(i)
        for i in reversed(grown):
            self._burst(i, burst)

    def _burst(self, at: int, burst: int) -> None:
        """Split a container by range until all of its parts fit, or turn it into a node."""
        child, shift = self.children[at], (DEPTH - 1 - self.level) * BITS
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        keys, counts = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        words = keys >> shift
        if words[0] == words[-1]:
            if self.level + 1 < DEPTH:  # one word: the next word tells its phrases apart
                node = _Node(self.level + 1, self.starts[at], child)
                self.children[at] = node
                node._burst(0, burst)
            return
        cut = np.searchsorted(words, words[len(words) // 2])
        if cut == 0:
            cut = np.searchsorted(words, words[0], "right")
        border = int(words[cut]) << shift
        low, high = (Counter(dict(zip(keys[part].tolist(), counts[part].tolist())))
                     for part in (slice(cut), slice(cut, None)))
        self.children[at:at + 1] = [low, high]
        self.starts[at:at + 1] = [self.starts[at], border]
        for i, part in ((at + 1, high), (at, low)):
            if len(part) > burst:
                self._burst(i, burst)

    def containers(self):
        for child in self.children:
            if isinstance(child, _Node):
                yield from child.containers()
            else:
                yield child

    def size(self) -> int:
        return sum(map(len, self.containers()))


class HatTrie:
    def __init__(self, burst: int = 1 << 14) -> None:
        self.burst = burst
        self.root = _Node(0, 0, Counter())

    def add(self, keys: np.ndarray) -> None:
        """Count each occurrence; ``keys`` are sorted."""
        self.root.add(keys, self.burst)

    def __len__(self) -> int:
        return self.root.size()

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees of the root out, the largest first, until ``keep`` phrases are left.

        Gives keys and counts of the phrases taken out.
        """
        sizes = [c.size() if isinstance(c, _Node) else len(c) for c in self.root.children]
        held, taken = sum(sizes), []
        for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
            if held <= keep:
                break
            child = self.root.children[i]
            taken += child.containers() if isinstance(child, _Node) else [child]
            self.root.children[i] = Counter()
            held -= sizes[i]
        total = sum(map(len, taken))
        return (np.fromiter(chain.from_iterable(taken), np.int64, total),
                np.fromiter(chain.from_iterable(c.values() for c in taken), np.int64, total))
