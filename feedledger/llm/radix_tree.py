"""An adaptive radix tree over keys of bytes: node layouts that grow, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left

from feedledger.llm.worker import ship

ship(__name__)


class SortedLayout:
    """Up to 4, then up to 16 children beside their sorted bytes."""

    __slots__ = ("keys", "room", "slots")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.slots = room, bytearray(), []

    def find(self, byte: int):
        at = self.keys.find(byte)
        return self.slots[at] if at >= 0 else None

    def put(self, byte: int, node) -> SortedLayout | IndexedLayout:
        """Adds or replaces a child; returns the layout that holds it, a larger one where this is full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.slots[at] = node
            return self
        if len(self.keys) == self.room:
            larger = SortedLayout(16) if self.room == 4 else IndexedLayout()
            for key, child in self.items():
                larger.put(key, child)
            return larger.put(byte, node)
        self.keys.insert(at, byte)
        self.slots.insert(at, node)
        return self

    def items(self):
        return zip(self.keys, self.slots)


class IndexedLayout:
    """Up to 48 children found through an index of 256 bytes; 0 in it means none."""

    __slots__ = ("index", "slots")

    def __init__(self):
        self.index, self.slots = bytearray(256), []

    def find(self, byte: int):
        at = self.index[byte]
        return self.slots[at - 1] if at else None

    def put(self, byte: int, node) -> IndexedLayout | DirectLayout:
        at = self.index[byte]
        if at:
            self.slots[at - 1] = node
        elif len(self.slots) < 48:
            self.slots.append(node)
            self.index[byte] = len(self.slots)
        else:
            larger = DirectLayout()
            for key, child in self.items():
                larger.put(key, child)
            return larger.put(byte, node)
        return self

    def items(self):
        return ((byte, self.slots[at - 1]) for byte, at in enumerate(self.index) if at)


class DirectLayout:
    """One place for each byte."""

    __slots__ = ("slots",)

    def __init__(self):
        self.slots = [None] * 256

    def find(self, byte: int):
        return self.slots[byte]

    def put(self, byte: int, node) -> DirectLayout:
        self.slots[byte] = node
        return self

    def items(self):
        return ((byte, node) for byte, node in enumerate(self.slots) if node is not None)


class RadixNode:
    """The keys that begin alike up to byte ``end``.

    ``prefix`` holds the bytes between the byte that leads here and ``end``. ``n`` keys pass or
    end here; ``first`` and ``last`` are the places of the first and last inserted, ``lowest``
    the smallest of their values, ``ends`` the values of the keys that end here, and ``sample``
    what came with one of the keys.
    """

    __slots__ = ("children", "end", "ends", "first", "last", "lowest", "n", "prefix", "sample")

    def __init__(self, prefix: bytes, end: int, sample):
        self.prefix, self.end, self.sample = prefix, end, sample
        self.children, self.ends, self.n, self.first, self.last, self.lowest = None, [], 0, None, None, None

    def child(self, byte: int):
        return self.children.find(byte) if self.children else None

    def put(self, byte: int, node: RadixNode) -> None:
        self.children = (self.children or SortedLayout()).put(byte, node)

    def below(self) -> list[RadixNode]:
        """The children in the order of their bytes."""
        return [node for _, node in self.children.items()] if self.children else []

    def count(self, place: int, value) -> None:
        if self.n == 0:
            self.first, self.lowest = place, value
        self.last, self.lowest, self.n = place, min(self.lowest, value), self.n + 1


def _alike(a: bytes, b: bytes) -> int:
    """How many bytes two keys have in common at their beginning."""
    n = min(len(a), len(b))
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root, self.size = RadixNode(b"", 0, None), 0

    def insert(self, key: bytes, value, sample) -> None:
        node, place = self.root, self.size
        self.size += 1
        while True:
            node.count(place, value)
            if node.end == len(key):
                node.ends.append(value)
                return
            byte, after = key[node.end], node.end + 1
            child = node.child(byte)
            if child is None:
                child = RadixNode(key[after:], len(key), sample)
                node.put(byte, child)
            elif key[after:child.end] != child.prefix:
                # The compressed path is cut where the key leaves it.
                same = _alike(child.prefix, key[after:])
                upper = RadixNode(child.prefix[:same], after + same, child.sample)
                upper.n, upper.first, upper.last, upper.lowest = child.n, child.first, child.last, child.lowest
                upper.put(child.prefix[same], child)
                child.prefix = child.prefix[same + 1:]
                node.put(byte, upper)
                child = upper
            node = child
