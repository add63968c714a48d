"""Boosted trees over counted rows of small whole features: histograms by SQL, trees as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf with a value, or a split: rows whose feature is at most `least` go left."""

    value: float = 0.0
    feature: int | None = None
    least: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()

    def column(self, features: Column, of) -> Column:
        """of(leaf), for the leaf that a row's features lead to."""
        if self.feature is None:
            return F.lit(of(self))
        left, right = self.left.column(features, of), self.right.column(features, of)
        return F.when(F.get(features, F.lit(self.feature)) <= self.least, left).otherwise(right)


@dataclass
class Boosted:
    """A first log-odds value and trees; the margin is their sum."""

    first: float
    trees: list[Node]

    def margin(self, features: Column) -> Column:
        total = F.lit(self.first)
        for tree in self.trees:
            total = total + tree.column(features, lambda leaf: float(leaf.value))
        return total


def _halves(bins: list[tuple], smooth: float) -> tuple[float, int, int] | None:
    """The best split of a node by gain: gain, feature, least; bins are (feature, value, g, h)."""
    best = None
    by_feature: dict[int, list[tuple]] = {}
    for feature, value, g, h in bins:
        by_feature.setdefault(feature, []).append((value, g, h))
    score = lambda g, h: g * g / (h + smooth)
    for feature, rows in sorted(by_feature.items()):
        rows.sort()
        all_g, all_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        g = h = 0.0
        for value, own_g, own_h in rows[:-1]:
            g, h = g + own_g, h + own_h
            gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, feature, value)
    return best


def fit(cells: DataFrame, rounds: int = 8, depth: int = 3, rate: float = 0.5, smooth: float = 1.0) -> Boosted | None:
    """Trees fitted by Newton steps on the log loss; None if the rows have one label only.

    cells: features (array of whole numbers), n (rows), good (of these, with label 1). Each level of a tree is one
    aggregation to a histogram per node, feature and value; the driver sees these histograms only.
    """
    n, good = cells.agg(F.sum("n"), F.sum("good")).first()
    if not n or not good or good == n:
        return None
    model = Boosted(math.log(good / (n - good)), [])
    for _ in range(rounds):
        chance = 1 / (1 + F.exp(-model.margin(F.col("features"))))
        rows = cells.select(
            "features", (F.col("good") - F.col("n") * chance).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h")
        )
        tree = Node()
        for level in range(depth + 1):
            leaves = {id(leaf): i for i, leaf in enumerate(tree.leaves())}
            at = rows.withColumn("node", tree.column(F.col("features"), lambda leaf: leaves[id(leaf)]))
            sums = at.select("node", "g", "h", F.posexplode("features").alias("feature", "value"))
            found = sums.groupBy("node", "feature", "value").agg(F.sum("g"), F.sum("h")).collect()  # a histogram
            for i, leaf in enumerate(tree.leaves()):
                bins = [tuple(r)[1:] for r in found if r["node"] == i]
                g, h = (sum(b[k] for b in bins if b[0] == 0) for k in (2, 3))
                leaf.value = rate * g / (h + smooth)
                split = _halves(bins, smooth) if level < depth else None
                if split and split[0] > 1e-6:
                    leaf.feature, leaf.least = split[1:]
                    leaf.left, leaf.right = Node(leaf.value), Node(leaf.value)
        model.trees.append(tree)
    return model
