"""Bins ordered by remaining capacity in a balanced search tree."""

from __future__ import annotations

from collections.abc import Iterable


class CapacityTree:
    """An AVL tree over (remaining, bin): finds the tightest bin that still takes a size in logarithmic time."""

    def __init__(self) -> None:
        self.root = None  # a node is [key, left, right, height]

    def add(self, remaining: int, bin_: int) -> None:
        self.root = self._add(self.root, (remaining, bin_))

    def remove(self, remaining: int, bin_: int) -> None:
        self.root = self._remove(self.root, (remaining, bin_))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The (remaining, bin) with the least remaining >= size, the smallest bin of equals; None if there is none."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    def widest(self) -> tuple[int, int] | None:
        node = self.root
        while node and node[2]:
            node = node[2]
        return node[0] if node else None

    def _add(self, node, key):
        if not node:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._balanced(node)

    def _remove(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        elif not node[1] or not node[2]:
            return node[1] or node[2]
        else:
            next_ = node[2]
            while next_[1]:
                next_ = next_[1]
            node[0], node[2] = next_[0], self._remove(node[2], next_[0])
        return self._balanced(node)

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _balanced(self, node):
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) > 1:
            low, high = (1, 2) if lean > 1 else (2, 1)
            if self._height(node[low][high]) > self._height(node[low][low]):
                node[low] = self._turned(node[low], high)
            return self._turned(node, low)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turned(self, node, up: int):
        """Lifts the child on side up over node."""
        child = node[up]
        node[up], child[3 - up] = child[3 - up], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child


def best_fit_decreasing(sizes: Iterable[tuple[object, int]], capacity: int, bins: int | None = None) -> dict[object, int]:
    """Bin of each item. Items in descending size enter the tightest bin with room.

    bins None: a new bin opens when none has room; an item over the capacity has a bin to itself. Otherwise there
    are so many bins, and what fits nowhere enters the one with most room left and overfills it.
    """
    tree, out, opened = CapacityTree(), {}, bins or 0
    for b in range(opened):
        tree.add(capacity, b)
    for item, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        at = tree.tightest(size)
        if at is None and bins is None:
            at, opened = (capacity, opened), opened + 1
        else:
            at = at or tree.widest()
            tree.remove(*at)
        out[item] = at[1]
        if bins is not None or at[0] > size:
            tree.add(at[0] - size, at[1])
    return out


def pack_histogram(histogram: dict[int, int], capacity: int, bins: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """What best_fit_decreasing does with so many items of each size, in runs (size, rank, bin, each), and the number of bins.

    Of a size's items, those from rank on fill bins from bin on, each items in each. Successive bins with equal room
    are one entry of the tree; a bin that takes an item and has room for another stays the tightest, so it is filled
    at once.
    """
    tree, many, rows, opened = CapacityTree(), {}, [], bins or 0

    def put(room: int, first: int, count: int) -> None:
        if count > 0 and (room > 0 or bins is not None):
            tree.add(room, first)
            many[first] = count

    put(capacity, 0, opened)
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            at = tree.tightest(size)
            if at is not None:
                tree.remove(*at)
            elif bins is not None:  # overfills the one with most room
                room, first = tree.widest()
                tree.remove(room, first)
                rows.append((size, rank, first, 1))
                put(room, first + 1, many.pop(first) - 1)
                put(room - size, first, 1)
                rank, left = rank + 1, left - 1
                continue
            elif size > capacity:  # each has a bin to itself
                rows.append((size, rank, opened, 1))
                opened += left
                break
            else:
                at = (capacity, opened)
                many[opened] = -(-left // (capacity // size))
                opened += many[opened]
            room, first = at
            count, each = many.pop(first), room // size
            whole = min(count, left // each)
            rest = left - whole * each if whole < count else 0
            if whole:
                rows.append((size, rank, first, each))
                put(room - each * size, first, whole)
            if rest:
                rows.append((size, rank + whole * each, first + whole, rest))
                put(room - rest * size, first + whole, 1)
            put(room, first + whole + (rest > 0), count - whole - (rest > 0))
            rank, left = rank + whole * each + rest, left - whole * each - rest
    return rows, opened
