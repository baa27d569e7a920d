"""Shape of the search trees that the topic keys would make: balanced (AVL) and plain.

A table needs no tree; these figures are for the report on balancing. Searches
are first counted by key and by the number of keys known then, so that a task
which grows the tree reads at most a row for each two distinct keys.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A node is (key, left, right, height); None is the empty tree.
Node = tuple


def height(node: Node | None) -> int:
    return node[3] if node else 0


def _node(key, left, right) -> Node:
    return key, left, right, 1 + max(height(left), height(right))


@dataclass
class Balanced:
    """AVL tree of keys, of nodes that never change, with counts of rotations and comparisons."""

    root: Node | None = None
    size: int = 0
    comparisons: int = 0
    rotations: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("LL", "RR", "LR", "RL"), 0))

    def find(self, key) -> bool:
        node = self.root
        while node:
            self.comparisons += 1
            if key == node[0]:
                return True
            node = node[1] if key < node[0] else node[2]
        return False

    def add(self, key) -> bool:
        """Whether the key is new; new keys go in at a leaf, and the path to it is built anew, balanced."""
        if self.find(key):
            return False
        path, node = [], self.root
        while node:
            self.comparisons += 1
            path.append(node)
            node = node[1] if key < node[0] else node[2]
        made = _node(key, None, None)
        for k, left, right, _ in reversed(path):
            made = self._balanced(*((k, made, right) if key < k else (k, left, made)))
        self.root = made
        self.size += 1
        return True

    def _balanced(self, key, left, right) -> Node:
        tilt = height(left) - height(right)
        if abs(tilt) < 2:
            return _node(key, left, right)
        if tilt > 0:
            k, a, b, _ = left
            if height(a) >= height(b):
                self.rotations["LL"] += 1
                return _node(k, a, _node(key, b, right))
            self.rotations["LR"] += 1
            return _node(b[0], _node(k, a, b[1]), _node(key, b[2], right))
        k, a, b, _ = right
        if height(b) >= height(a):
            self.rotations["RR"] += 1
            return _node(k, _node(key, left, a), b)
        self.rotations["RL"] += 1
        return _node(a[0], _node(key, left, a[1]), _node(k, a[2], b))

    def walk(self, order: str) -> list:
        """Keys in order, pre or post order."""
        out: list = []
        stack: list = [self.root]
        while stack:
            item = stack.pop()
            if item is None:
                continue
            if len(item) == 1:
                out.append(item[0])
                continue
            key, left, right, _ = item
            stack += reversed({"pre": [(key,), left, right], "in": [left, (key,), right], "post": [left, right, (key,)]}[order])
        return out

    def serialize(self) -> list:
        """Keys in pre-order with None for each missing child."""

        def listed(node: Node | None) -> Iterator:
            yield node[0] if node else None
            if node:
                yield from listed(node[1])
                yield from listed(node[2])

        return list(listed(self.root))

    @classmethod
    def deserialize(cls, keys: list) -> Balanced:
        rest = iter(keys)

        def built() -> Node | None:
            key = next(rest, None)
            return None if key is None else _node(key, built(), built())

        return cls(built(), sum(k is not None for k in keys))

    def destroy(self) -> list:
        """Keys in the order in which they are freed, children first; the tree is empty then."""
        freed = self.walk("post")
        self.root, self.size = None, 0
        return freed


class Plain:
    """Unbalanced search tree."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.comparisons = 0
        self.height = 0

    def add(self, key) -> None:
        if self.root is None:
            self.root, self.height = [key, None, None], 1
            return
        node, depth = self.root, 1
        while True:
            self.comparisons += 1
            if key == node[0]:
                return
            side = 1 if key < node[0] else 2
            depth += 1
            if node[side] is None:
                node[side] = [key, None, None]
                self.height = max(self.height, depth)
                return
            node = node[side]


SHAPE = "height int, size int, comparisons long, ll int, rr int, lr int, rl int, best int, pre array<string>, post array<string>, serialized array<string>"


def counted(lookups: DataFrame) -> DataFrame:
    """(known, key, n) of lookups (ord, key): searches for a key while `known` keys were there, its own first one included. ord may be a struct; equal ones go by key."""
    place = F.struct("ord", "key")
    firsts = lookups.groupBy("key").agg(F.min(place).alias("at")).agg(F.array_sort(F.collect_list("at")).alias("firsts"))  # a place a distinct key
    known = F.when(place >= F.element_at("firsts", -1), F.size("firsts")).otherwise(F.size(F.filter("firsts", lambda x: x <= place)))
    return lookups.crossJoin(F.broadcast(firsts)).groupBy(known.alias("known"), "key").agg(F.count("*").alias("n"))


def _in_order(pdf: pd.DataFrame) -> Iterator[tuple[str, dict[str, int]]]:
    """(new key, searches by key until the next one) in order of first sight."""
    seen: set[str] = set()
    for _, some in pdf.groupby("known", sort=True):
        searches = dict(zip(some["key"], some["n"].astype(int), strict=True))
        new = next(k for k in searches if k not in seen)
        seen.add(new)
        searches[new] -= 1
        yield new, searches


def tree_shape(lookups: DataFrame) -> DataFrame:
    """One row of figures of the balanced tree that the keys of lookups (ord, key) make, in that order.

    Each row is a search, and a new key an insertion. For n keys the least height
    is ceil(log2(n + 1)).
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Balanced()
        for new, searches in _in_order(pdf):
            tree.add(new)
            for key, n in searches.items():
                before = tree.comparisons
                tree.find(key)
                tree.comparisons = before + n * (tree.comparisons - before)
        r = tree.rotations
        row = (height(tree.root), tree.size, tree.comparisons, r["LL"], r["RR"], r["LR"], r["RL"], math.ceil(math.log2(tree.size + 1)), tree.walk("pre"), tree.walk("post"), tree.serialize())
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHAPE.split(", ")])

    return counted(lookups).groupBy(F.lit(1).alias("one")).applyInPandas(grow, SHAPE)


def plain_depths(first: DataFrame) -> DataFrame:
    """(key, depth) in the unbalanced tree of keys inserted in the order of ord (distinct keys): a key goes under the deeper of the two that it falls between."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        keys: list[str] = []
        depth: dict[str, int] = {}
        for key in pdf.sort_values("place")["key"]:
            at = bisect_left(keys, key)
            depth[key] = 1 + max((depth[k] for k in keys[max(0, at - 1) : at + 1]), default=0)
            keys.insert(at, key)
        return pd.DataFrame({"key": list(depth), "depth": list(depth.values())})

    rows = first.groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("rows"))  # a row a distinct key
    return rows.select(F.posexplode("rows").alias("place", "r")).select("place", F.col("r.key").alias("key")).groupBy(F.lit(1).alias("one")).applyInPandas(grow, "key string, depth int")


def heights(lookups: DataFrame) -> DataFrame:
    """One row: balanced, plain and best height of the keys of lookups (ord, key)."""
    first = lookups.groupBy("key").agg(F.min("ord").alias("ord"))
    plain = plain_depths(first).agg(F.max("depth").cast("int").alias("plain"))
    return tree_shape(lookups).select(F.col("height").alias("balanced"), "best").crossJoin(F.broadcast(plain))


def lookups(mentions: DataFrame) -> DataFrame:
    """(ord, key) of every search that counting the mentions makes."""
    return mentions.select(F.struct("doc", "paper", "q", "pos").alias("ord"), "key")
