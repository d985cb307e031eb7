"""Compressed tries of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving: slices are compared, not single bytes."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """A radix tree over byte strings: edges carry strings, and terminals what the texts that end there have put together.

    A node is ``[label, children by first byte, terminal or None]``.
    """

    def __init__(self, merge: Callable):
        self.root: list = [b"", {}, None]
        self.merge, self.bytes, self.terminals = merge, 0, 0

    def insert(self, text: bytes, value) -> None:
        """Put ``value`` at the terminal of ``text``, merged with what is there."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:] if at else text, {}, value]
                self.bytes += len(text) - at
                self.terminals += 1
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common_length(label, text[at : at + len(label)])
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][text[at]] = middle
            node, at = middle, at + same
        if node[2] is None:
            node[2] = value
            self.terminals += 1
        else:
            node[2] = self.merge(node[2], value)

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """Every text that was inserted, once, in the order of bytes, with its terminal."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            stack += [(node[1][k], text) for k in sorted(node[1], reverse=True)]

    def values(self) -> Iterator:
        """The terminals, without putting the texts together."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack += node[1].values()
