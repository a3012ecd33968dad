"""Connected components of an edge table in rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import settle


# So many edges of a round make one task of the next.
TASK_EDGES = 500_000


def contract(batches):
    """Edges (u, v) that connect what the edges of one task do: each node with the smallest one of its part."""
    u, v = [], []
    for b in batches:
        u.append(b.column("u").to_numpy())
        v.append(b.column("v").to_numpy())
    if u:
        u, v = np.concatenate(u), np.concatenate(v)
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        label = spanning_labels(at[: len(u)], at[len(u) :], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def connect(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it reaches.

    Before anything moves, and again in each round, the edges of a task become a spanning forest in which each node
    hangs on the smallest of its part; a round has a task for ``TASK_EDGES`` edges, so few edges make few files. Then
    every node hands its smallest neighbour to its larger neighbours, then to its smaller ones, until nothing moves. A
    chain of n nodes takes about log2(n) rounds at most. Each round is settled in the shared folder and the round
    before it is let go.
    """
    both = edges.filter("a != b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    forest = lambda df: df.mapInArrow(contract, "u long, v long")

    def mark(df):
        """Number of distinct rows and parity of their hashes: tells one set of edges from the next."""
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    def tasks(df, told):
        return df.coalesce(max(1, -(-told[0] // TASK_EDGES)))

    now = settle(forest(both))
    told = mark(now)
    while told[0]:
        # One task sees all that is left: what it makes of it is the answer.
        last = told[0] <= TASK_EDGES
        now = settle(forest(tasks(now, told)))
        if last:
            break
        sides = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours move to the smallest of the neighbourhood
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").filter("w != m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        nxt = small.union(low2.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = settle(tasks(nxt, told))
        before, told = told, mark(now)
        if told == before:
            break
    labels = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.select(F.col("u").alias("node"), "component").union(roots.join(labels, roots["node"] == labels["u"], "left_anti"))


def spanning_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (i, j) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
