"""Adaptive radix tree over byte strings of whole turn ids."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

SMALL, MEDIUM, LARGE = 4, 16, 48  # children that a layout holds at most; the next one has a slot for every byte


class Node:
    """A node behind ``label``, the bytes that lead to it from its parent (path compression), with the value of the key
    that ends here, if any.

    Up to 16 children stand in two sorted lists (layouts of 4 and 16), up to 48 behind an index of 256 bytes, more in
    256 slots. A node takes the next layout when it is full.
    """

    __slots__ = ("label", "value", "layout", "bytes", "children")

    def __init__(self, label: bytes, value: Any = None) -> None:
        self.label, self.value, self.layout = label, value, SMALL
        self.bytes: Any = bytearray()
        self.children: list[Any] = []

    def child(self, byte: int) -> Node | None:
        if self.layout <= MEDIUM:
            at = bisect_left(self.bytes, byte)
            return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None
        if self.layout == LARGE:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Adds a child, or replaces the one behind this byte."""
        if self.layout <= MEDIUM:
            at = bisect_left(self.bytes, byte)
            if at < len(self.bytes) and self.bytes[at] == byte:
                self.children[at] = node
                return
            if len(self.bytes) == self.layout:
                self._grow()
                self.put(byte, node)
                return
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.layout == LARGE:
            if self.bytes[byte]:
                self.children[self.bytes[byte] - 1] = node
            elif len(self.children) == LARGE:
                self._grow()
                self.put(byte, node)
            else:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        held = list(self.items())
        if self.layout == SMALL:
            self.layout = MEDIUM
        elif self.layout == MEDIUM:
            self.layout, self.bytes, self.children = LARGE, bytearray(256), []
            for byte, node in held:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
        else:
            self.layout, self.bytes, self.children = 256, None, [None] * 256
            for byte, node in held:
                self.children[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) in the order of the bytes."""
        if self.layout <= MEDIUM:
            yield from zip(self.bytes, self.children, strict=True)
        elif self.layout == LARGE:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at)
        else:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size  # the first difference lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Keys are told apart byte by byte; a key may be the beginning of another."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: Any) -> None:
        """``value`` may not be None; a key that is there already gets the new value."""
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], value))
                return
            same = shared(below.label, key[at : at + len(below.label)])
            if same < len(below.label):
                middle = Node(below.label[:same])
                below.label = below.label[same:]
                middle.put(below.label[0], below)
                node.put(key[at], middle)
                below = middle
            node, at = below, at + same
        node.value = value

    def get(self, key: bytes) -> Any:
        node, at = self.root, 0
        while at < len(key):
            node = node.child(key[at])
            if node is None or key[at : at + len(node.label)] != node.label:
                return None
            at += len(node.label)
        return node.value

    def bottom_up(self) -> Iterator[tuple[Node, int, list[Any]]]:
        """(node, depth in bytes of its end, results of its children) with children before parents, where the caller sends
        each node's result back. The walk keeps a stack of its own, so depth has no limit."""
        stack: list[tuple[Node, int, Iterator, list]] = [(self.root, 0, self.root.items(), [])]
        while stack:
            node, depth, rest, results = stack[-1]
            step = next(rest, None)
            if step is not None:
                below = step[1]
                stack.append((below, depth + len(below.label), below.items(), []))
                continue
            stack.pop()
            result = yield node, depth, results
            if stack:
                stack[-1][3].append(result)
