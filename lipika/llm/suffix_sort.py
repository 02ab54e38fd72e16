"""Deep-shallow sorting of byte strings, with the longest common prefixes of neighbours.

Shallow: multikey quicksort whose characters are 8-byte words. Each segment is split three ways by a pivot's word; the
equal part goes on with the next word, the others with the same one; all open segments are split in one vector step.
Deep: segments that tie for SHALLOW words are ordered by a blind trie, which looks at the bytes where strings branch and
compares each string in full just once; strings equal to the segment's first are its twins without an insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 4
WORD = 8


class BlindTrie:
    """A compact trie that keeps only branching places; ``order`` lists the strings sorted, with common prefixes."""

    def __init__(self, strings: list[bytes], skip: int):
        self.strings = strings
        self.root: list = [0]
        self.twins: dict[int, list[int]] = {}
        for i in range(1, len(strings)):
            self._insert(i, skip)

    def _insert(self, i: int, skip: int) -> None:
        s = self.strings[i]
        node = self.root
        while node[0] is None:  # an inner node: (None, place, children)
            node = node[2].get(s[node[1]] if node[1] < len(s) else -1) or next(iter(node[2].values()))
        leaf = node[0]
        common = _common(s, self.strings[leaf], skip)
        if common == len(s) == len(self.strings[leaf]):
            self.twins.setdefault(leaf, []).append(i)
            return
        above, edge, node = None, None, self.root
        while node[0] is None and node[1] < common:
            above, edge = node, s[node[1]] if node[1] < len(s) else -1
            node = node[2][edge]
        mine = s[common] if common < len(s) else -1
        if node[0] is None and node[1] == common:
            node[2][mine] = [i]
            return
        # Any string below shows the byte at the new place.
        down = node
        while down[0] is None:
            down = next(iter(down[2].values()))
        old = self.strings[down[0]]
        fresh = [None, common, {mine: [i], (old[common] if common < len(old) else -1): node}]
        if above is None:
            self.root = fresh
        else:
            above[2][edge] = fresh

    def order(self) -> tuple[list[int], list[int]]:
        """(strings in order, common prefix of each with the one before it; 0 for the first)"""
        out, lcp = [], []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                for k, b in enumerate(sorted(node[2], reverse=True)):
                    last = k == len(node[2]) - 1  # popped first: it follows what came before this node
                    stack.append((node[2][b], before if last else node[1]))
                continue
            out.append(node[0])
            lcp.append(before)
            for t in self.twins.get(node[0], ()):
                out.append(t)
                lcp.append(len(self.strings[t]))
        return out, lcp


def _common(a: bytes, b: bytes, skip: int) -> int:
    n = min(len(a), len(b))
    if a[skip:n] == b[skip:n]:
        return n
    x = int.from_bytes(a[skip:n], "big") ^ int.from_bytes(b[skip:n], "big")
    return skip + (8 * (n - skip) - x.bit_length()) // 8


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of every row of the segments."""
    segment = np.repeat(np.arange(len(start)), size)
    return segment, np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _multikey(words: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts ``order`` within segments by up to ``deepest`` words; returns the segments (start, size) that still tie."""
    depth = np.zeros(len(start), np.int64)
    tied: list[np.ndarray] = []
    while len(start):
        segment, place = _spread(start, size)
        w = words[order[place], depth[segment]]
        # The pivot: the median of a segment's first, middle and last word.
        first = np.cumsum(size) - size
        three = np.sort(np.stack([w[first], w[first + size // 2], w[first + size - 1]]), axis=0)
        pivot = three[1][segment]
        side = (w > pivot).astype(np.int64) - (w < pivot) + 1
        key = segment * 3 + side
        by = np.argsort(key, kind="stable")
        order[place] = order[place[by]]
        parts = np.bincount(key, minlength=3 * len(start))
        at = np.repeat(start, 3) + (np.cumsum(parts) - parts) - np.repeat(first, 3)
        deep = np.repeat(depth, 3) + (np.arange(len(parts)) % 3 == 1)
        several = parts > 1
        done = several & (deep == deepest)
        tied.append(np.column_stack([at[done], parts[done]]))
        go = several & ~done
        start, size, depth = at[go], parts[go], deep[go]
    rest = np.concatenate([np.zeros((0, 2), np.int64), *tied])
    return rest[:, 0], rest[:, 1]


def deep_shallow(rows: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows sorted by (group, bytes), and each one's common prefix with the one before; -1 at a group's start.

    ``rows`` is a byte matrix padded with zeros, ``length`` the true lengths.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-max(width, 1) // WORD) * WORD), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    head = np.ones(n, bool)
    head[1:] = group[order][1:] != group[order][:-1]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, n))
    start, size = _multikey(words, order, first[size > 1], size[size > 1], min(SHALLOW, words.shape[1]))
    # Twins of a segment's first string need no trie.
    segment, place = _spread(start, size)
    leader = order[start][segment] if len(start) else segment
    other = (words[order[place]] != words[leader]).any(axis=1) | (length[order[place]] != length[leader])
    for g in np.flatnonzero(np.bincount(segment, other, minlength=len(start)) > 0):
        a, k = start[g], size[g]
        part = order[a : a + k]
        alike = (words[part] == words[part[0]]).all(axis=1) & (length[part] == length[part[0]])
        twins, rest = part[alike], np.append(part[:1], part[~alike])
        by, _ = BlindTrie([rows[i, : length[i]].tobytes() for i in rest], 0).order()
        where = by.index(0)
        order[a : a + k] = np.concatenate([rest[by[:where]], twins, rest[by[where + 1 :]]])
    lcp = np.full(n, -1, np.int64)
    inside = np.flatnonzero(~head)
    for lo in range(0, len(inside), 1 << 16):
        k = inside[lo : lo + (1 << 16)]
        differ = padded[order[k]] != padded[order[k - 1]]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), padded.shape[1])
        lcp[k] = np.minimum(common, np.minimum(length[order[k]], length[order[k - 1]]))
    return order, lcp
