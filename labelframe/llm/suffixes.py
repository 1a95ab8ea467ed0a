"""Deep-shallow sorting of byte strings, and what of a group of strings around a common place repeats.

Strings are sorted by multikey quicksort, several bytes at a time, to a shallow depth.  Groups
that agree so far have long common prefixes, which quicksort would read again and again; they are
ordered by a blind trie instead: it branches at the bytes that tell its strings apart, so a new
string walks down without being read and is compared with one leaf.
"""

from __future__ import annotations

from labelframe.llm.anchors import GRAM, LENGTH

#: Bytes that quicksort compares at once, and the depth at which blind tries take over.
CHUNK, SHALLOW = 8, 96


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Nodes are [depth, children by byte]; leaves are lists of equal strings' numbers.  A string's end counts as byte -1."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        leaf = self.strings[node[1][0]]
        depth = common(s, leaf)
        if depth == len(s) == len(leaf):
            node[1].append(i)
            return
        node, above = self.root, None
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][self._at(s, node[0])]
        if node[0] == depth:
            node[1][self._at(s, depth)] = [None, [i]]
            return
        branch = [depth, {self._at(leaf, depth): node, self._at(s, depth): [None, [i]]}]
        if above is None:
            self.root = branch
        else:
            above[1][self._at(s, above[0])] = branch

    def sorted(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], depth: int = 0) -> list[int]:
    """The numbers of the strings in their order; all agree in their first ``depth`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            out += trie.sorted()
        else:
            word = [strings[i][depth : depth + CHUNK] for i in group]
            pivot = sorted((word[0], word[len(word) // 2], word[-1]))[1]
            less = [i for i, w in zip(group, word, strict=True) if w < pivot]
            more = [i for i, w in zip(group, word, strict=True) if w > pivot]
            same = [i for i, w in zip(group, word, strict=True) if w == pivot]
            if len(pivot) < CHUNK:  # the strings end here
                stack += [(more, depth), (same, SHALLOW), (less, depth)]
            else:
                stack += [(more, depth), (same, depth + CHUNK), (less, depth)]
    return out


def intervals(strings: list[bytes], order: list[int], least: int) -> list[tuple[int, list[int]]]:
    """(depth, members) of all sets of strings that share a prefix of ``depth`` bytes, at least ``least``, and no more all together."""
    out: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, int]] = []  # depth, first place in the order
    for place in range(1, len(order) + 1):
        depth = common(strings[order[place - 1]], strings[order[place]]) if place < len(order) else -1
        first = place - 1
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            if deep >= least:
                out.append((deep, order[first:place]))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def extents(zones: list[tuple[bytes, int]], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int] | None]:
    """For each zone (bytes, place of the anchor in them) the first and last start of a window that another zone has too.

    Zones are different; windows of ``length`` bytes contain the anchor's ``gram`` bytes.  Windows of
    two zones are equal if ``k`` bytes before their anchors and ``length - k`` from there on are, so
    the suffixes from the anchors are sorted, and in each set that shares ``d`` bytes the parts
    before the anchors, read backwards, are sorted too: neighbours that share ``length - d``
    or more have a window in common.
    """
    right = [body[at:] for body, at in zones]
    left = [body[:at][::-1] for body, at in zones]
    rank = [0] * len(zones)
    for place, i in enumerate(deep_shallow(left)):
        rank[i] = place
    most, least = [-1] * len(zones), [length] * len(zones)
    for depth, members in intervals(right, deep_shallow(right), gram):
        able = sorted((i for i in members if len(left[i]) >= length - depth), key=rank.__getitem__)
        for a, b in zip(able, able[1:], strict=False):
            shared = common(left[a], left[b])
            if shared >= length - depth:
                for i in (a, b):
                    most[i] = max(most[i], shared)
                    least[i] = min(least[i], length - depth)
    return [(at - k, at - j) if k >= 0 else None for (_, at), k, j in zip(zones, most, least, strict=True)]
