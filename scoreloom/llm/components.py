"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoreloom.llm.runtime import stored

LOCAL = 100_000             # links that are solved on the driver (two numbers each)


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a bounded number of links, and the least node each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return nodes, nodes[np.array([top(x) for x in range(len(nodes))], dtype=np.int64)]


def components(links: DataFrame, local: int | None = None) -> DataFrame:
    """node, component (least node reachable) for every node of ``links`` (a, b).

    Randomised contraction: in every round each node takes the name of the
    first node of its closed neighbourhood, in an order drawn anew for the
    round, and links are kept between different names only. Whatever the shape
    of the graph and its ids, the expected number of names falls by a constant
    factor per round, so rounds are logarithmic and need no cap. Once at most
    ``local`` links are left, they are solved on the driver.

    Rounds are written to the shared folder; first nodes are combined before
    the shuffle, so a node with any number of links is no hot spot.
    """
    local = LOCAL if local is None else local
    spark = links.sparkSession
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stored(links.where("a <> b").select(*ends).distinct(), "links")
    named = []
    while (n := left.count()) > local:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def drawn(c, seed=len(named)):
            return F.struct(F.xxhash64(F.lit(seed), c).alias("draw"), F.col(c).alias("name"))

        names = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("first"))
                       .select("node", F.least("first", drawn("node"))["name"].alias("name")), "names")
        named.append(names)
        left = stored(left.join(names.select(F.col("node").alias("a"), F.col("name").alias("x")), "a")
                      .join(names.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
                      .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    rest = left.toArrow()
    nodes, least = _solved(rest["a"].to_numpy(), rest["b"].to_numpy())
    found = spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "name": pa.array(least, pa.int64())}))
    if not named:
        return found.withColumnRenamed("name", "component")
    # Names of the rounds, last round first: a name without a later one is final.
    for names in reversed(named):
        later = found.select(F.col("node").alias("name"), F.col("name").alias("later"))
        found = stored(names.join(later, "name", "left").select("node", F.coalesce("later", "name").alias("name")), "found")
    least = found.groupBy("name").agg(F.min("node").alias("component"))
    return stored(found.join(least, "name").select("node", "component"), "components")
