"""Connected components: random contraction by DataFrames until few edges are left, which are solved in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, looked_up, superseded, written

MAX_ROUNDS = 60
#: Edges up to which a graph is solved in the driver's memory: as many rows as a table that is broadcast may have.
FEW = BROADCAST_ROWS
#: Shares into which the nodes of one label are dealt when labels are looked up: a component may hold most nodes.
SALTS = 16


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges from a to b, and for each the smallest node that is reachable."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        after, low = root.copy(), np.minimum(root[x], root[y])
        for end in (x, y):
            np.minimum.at(after, root[end], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return nodes, nodes[root]
        root = after


def _in_memory(edges: DataFrame) -> DataFrame:
    """(node, root) of a few edges (a, b)."""
    found = edges.toArrow()
    kind = found.schema.field("a").type
    solved = _solved(*(found.column(c).to_numpy() for c in ("a", "b")))
    return written(edges.sparkSession.createDataFrame(pa.table([pa.array(x, kind) for x in solved], names=["node", "root"])))


def _nearest(edges: DataFrame, turn: int) -> DataFrame:
    """(node, root): of each node and its neighbours, the first in an order of the turn's own."""

    def order(c: str) -> Column:
        return F.xxhash64(c, F.lit(turn))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("b"))
    return written(first.select("node", F.when(order("b") < order("node"), F.col("b")).otherwise(F.col("node")).alias("root")))


def _distinct(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, each once in one direction."""
    return written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between their ends' labels. Edges to an end that many share are dealt anew by the next join."""
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"__{x}")) for x in "ab")
    return _distinct(edges.join(a, "a").join(b, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b")))


def _followed(labels: DataFrame, roots: DataFrame, few: bool) -> DataFrame:
    """Labels replaced by their own roots, if they have any: by a broadcast of few, else salted on both sides."""
    moved = roots.filter("node <> root").select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    if few:
        found = labels.join(F.broadcast(moved), labels["root"] == moved["__n"], "left")
    else:
        moved = moved.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        found = salted.join(moved, (salted["root"] == moved["__n"]) & (salted["salt"] == moved["__salt"]), "left")
    return written(found.select("node", F.coalesce("__r", "root").alias("root")))


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that is reachable.

    While there are more than FEW edges, each node takes the label of itself or a neighbour, whichever comes first in a
    random order, and edges between different labels are left: what was connected still is, and a share of the nodes goes
    in each round whatever their numbers, so long chains take a logarithmic number of rounds. The few edges left are
    solved in the driver's memory, and labels are followed back. No large component is gathered anywhere. Each round's
    tables are deleted when they have been read. Raises if more than FEW edges are left after max_rounds.
    """
    left, rounds = _distinct(edges.select("a", "b")), []
    while left.count() > FEW:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        rounds.append(_nearest(left, len(rounds)))
        before, left = left, _contracted(left, rounds[-1])
        superseded(before)
    labels = _in_memory(left)
    superseded(left)
    for at, nearest in enumerate(reversed(rounds)):
        before, labels = labels, _followed(nearest, labels, at == 0)
        superseded(before)
        superseded(nearest)
    if not rounds:
        return labels
    least = written(labels.groupBy("root").agg(F.min("node").alias("__least"), F.count("*").alias("n")))
    named = written(looked_up(labels, least, ["root"]).select("node", F.col("__least").alias("root")))
    superseded(labels)
    superseded(least)
    return named
