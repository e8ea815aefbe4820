"""A fitted tree or forest as one column of built-in conditions.

The nodes that the model saves become nested conditions, so scoring is part of
the generated code of a scan and needs no vector, no assembler and no model at
hand.  The same nodes can be written as SQL.  A leaf gives the shares of its
training rows by class; a forest the mean of its trees' shares; the class is
the first with the largest share, as in the model's own ``transform``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.plans.models import saved_nodes


class Node(NamedTuple):
    """``counts`` by class; an inner node also has a feature, and either a threshold (rows up to it go left) or categories
    (rows with one of them go left), and its children's numbers."""
    counts: list[float]
    feature: int = -1
    threshold: float | None = None
    categories: tuple[float, ...] = ()
    left: int = -1
    right: int = -1


def trees_of(model) -> list[dict[int, Node]]:
    """The nodes of a fitted tree (one) or forest, by number; node 0 is the root."""
    table = saved_nodes(model)
    forest = "treeID" in table.columns
    trees: dict[int, dict[int, Node]] = {}
    for row in table.select(*(["treeID", "nodeData.*"] if forest else ["*"])).collect():
        split, inner = row["split"], row["leftChild"] >= 0
        values = tuple(split["leftCategoriesOrThreshold"]) if inner else ()
        numeric = inner and split["numCategories"] < 0
        trees.setdefault(row["treeID"] if forest else 0, {})[row["id"]] = Node(
            list(row["impurityStats"]), split["featureIndex"] if inner else -1, values[0] if numeric else None, () if numeric else values,
            row["leftChild"], row["rightChild"])
    return [trees[t] for t in sorted(trees)]


def _shares(node: Node) -> list[float]:
    total = sum(node.counts)
    return [c / total if total else 0.0 for c in node.counts]


def _column(tree: dict[int, Node], features: list[Column], at: int = 0) -> Column:
    node = tree[at]
    if node.left < 0:
        return F.array(*map(F.lit, _shares(node)))
    x = features[node.feature]
    goes_left = x <= F.lit(node.threshold) if node.threshold is not None else x.isin(*node.categories)
    return F.when(goes_left, _column(tree, features, node.left)).otherwise(_column(tree, features, node.right))


def probabilities(trees: list[dict[int, Node]], features: list[Column]) -> Column:
    """The shares of the classes as an array."""
    features = [x.cast("double") for x in features]
    total = _column(trees[0], features)
    for tree in trees[1:]:
        total = F.zip_with(total, _column(tree, features), lambda a, b: a + b)
    return total if len(trees) == 1 else F.transform(total, lambda x: x / F.lit(float(len(trees))))


def prediction(shares: Column) -> Column:
    """The first class with the largest share."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")


def sql(tree: dict[int, Node], names: list[str], value, at: int = 0) -> str:
    """One tree as an SQL expression; ``value(shares)`` writes a leaf."""
    node = tree[at]
    if node.left < 0:
        return f"CAST({value(_shares(node))} AS DOUBLE)"
    x = names[node.feature]
    test = f"{x} <= {node.threshold!r}" if node.threshold is not None else f"{x} IN ({', '.join(map(repr, node.categories))})"
    return f"CASE WHEN {test} THEN {sql(tree, names, value, node.left)} ELSE {sql(tree, names, value, node.right)} END"
