"""Connected components of a graph that is kept as a DataFrame of edges.

Each round every node takes the neighbour (or itself) of least random rank as its
representative, and the graph shrinks to the representatives. Ranks change every
round, so a constant share of the nodes goes each time, whatever the shape of the
graph. Nothing but a row count reaches the driver, and plans don't grow from round to round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_unsized


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the pairs (a, b) connect: a star for each component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not (root[root] == root).all():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[leaf]], nodes[leaf]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge: nodes share a root exactly if edges connect them.

    Loops, repeated edges and either direction may occur; edges with a null end are
    ignored. A node without edges is not returned. root is one of the nodes, not
    the smallest: take the least of what you need over each root.
    """
    e = cut_unsized(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    names = None
    for k in range(most_rounds):
        if e.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("v"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        up = cut_unsized(up.select(F.col("a").alias("u"), F.least("m", rank("a"))["v"].alias("p")))
        if names is None:
            names = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            names = names.join(up, names["root"] == up["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
        names = cut_unsized(names)
        left, right = up.select(F.col("u").alias("a"), F.col("p").alias("x")), up.select(F.col("u").alias("b"), F.col("p").alias("y"))
        moved = e.join(left, "a").join(right, "b").where("x <> y")
        e = cut_unsized(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    if names is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
