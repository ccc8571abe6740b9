"""A prefix tree of ordered sets, with a similarity search that shares partial overlaps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Jaccard:
    """Sets are linked when 100 * |intersection| >= percent * |union|."""

    percent: int

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def needed(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """Linked sets share one of so many first elements, in any order common to all sets."""
        return n + (-self.percent * n // 100) + 1

    def sizes(self, n: int) -> tuple[int, int]:
        """The least and the largest size of a set linked to one of size n."""
        return -(-self.percent * n // 100), 100 * n // self.percent

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sets of these sizes: the band, a number that is equal or one apart for linked
        sets, and at how many first places an element may stand that is the first one shared
        with a linked set of the next band."""
        begins = [0, 1]
        while begins[-2] <= n.max(initial=0):
            begins.append(self.sizes(begins[-1])[1] + 1)  # the least that a set as small as the one before is not linked to
        band = np.searchsorted(begins, n, side="right") - 1
        return band, np.maximum(0, n - self.needed(n, np.array(begins)[band + 1]) + 1)


@dataclass
class _Node:
    run: np.ndarray  # the elements on the way here
    children: dict[int, _Node] = field(default_factory=dict)
    members: list[int] = field(default_factory=list)
    shortest: int = 1 << 60  # of the sets that end here or below
    longest: int = 0


class PrefixTree:
    """Sets as ascending arrays. Sets that begin alike share a path, and what a search
    has counted along it."""

    def __init__(self) -> None:
        self.root = _Node(np.zeros(0, np.uint64))

    def insert(self, elements: np.ndarray, member: int) -> None:
        node, at, n = self.root, 0, len(elements)
        while True:
            node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
            if at == n:
                node.members.append(member)
                return
            child = node.children.get(int(elements[at]))
            if child is None:
                node.children[int(elements[at])] = _Node(elements[at:], {}, [member], n, n)
                return
            size = min(len(child.run), n - at)
            differs = child.run[:size] != elements[at : at + size]
            same = int(differs.argmax()) if differs.any() else size
            if same < len(child.run):
                upper = _Node(child.run[:same], {int(child.run[same]): child}, [], child.shortest, child.longest)
                child.run = child.run[same:]
                node.children[int(elements[at])] = upper
                child = upper
            node, at = child, at + same

    def search(self, elements: np.ndarray, jaccard: Jaccard) -> list[int]:
        """The members linked to a set. A subtree is left out when the elements counted so
        far and those that remain on either side cannot reach what its sizes need."""
        n, found = len(elements), []
        least, most = jaccard.sizes(n)
        stack = [(self.root, 0, 0, 0)]  # node, elements of it above, common ones, place in the probe
        while stack:
            node, depth, common, place = stack.pop()
            if node.longest < least or node.shortest > most:
                continue
            if len(node.run):
                at = np.searchsorted(elements, node.run)
                common += int((elements[np.minimum(at, n - 1)] == node.run).sum()) if n else 0
                depth += len(node.run)
                place = int(np.searchsorted(elements, node.run[-1], side="right"))
            found += [m for m in node.members if jaccard.linked(common, n, depth)]
            reach = common + min(n - place, node.longest - depth)
            if reach >= jaccard.needed(n, max(node.shortest, least)):
                stack += [(child, depth, common, place) for child in node.children.values()]
        return found
