"""Connected components over a table of links, without collecting any of it on the driver.

Up to SMALL links (16 bytes each) are joined up in one task. Beyond that it alternates the large-star and small-star steps (Kiveris et al., 2014): each step is a grouped minimum, summed in the
tasks first, and a join with one row for each node on one side, which adaptive execution can split where a hub is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

SMALL = 500_000


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, comp: the smallest node reachable, for every node of a link that isn't itself the smallest. Links with a null
    end, and of a node to itself, count for nothing."""
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links", slim=True)
    if now.count() <= SMALL:
        out = cut(now.coalesce(1).mapInArrow(_at_once, "node long, comp long"), "stars")
        discard(now)
        return out
    while True:
        new = cut(_small(_large(now)).distinct(), "stars", slim=True)
        discard(now)
        now = new
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _at_once(batches):
    """What components() gives, from all links of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.array(list(root), np.int64)
    tops = np.array([find(x) for x in root], np.int64)
    up = nodes != tops
    for at in range(0, int(up.sum()), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[up][at : at + 100_000]), pa.array(tops[up][at : at + 100_000])], ["node", "comp"])


def _stars(e: DataFrame) -> bool:
    """Whether each node has one link up, to a node that has none."""
    ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("hub")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).where("up > 1 or (up = 1 and hub = 1)").isEmpty()


def joined(comps: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """comps (of components()) with more links (a table, not a plan): only what these touch is worked on."""
    if links.isEmpty():
        return comps

    def top(t: DataFrame, node: str) -> DataFrame:
        return t.join(comps.select(F.col("node").alias(node), F.col("comp").alias("__c")), node, "left").withColumn(node, F.coalesce("__c", node)).drop("__c")

    more = components(top(top(links.select(a, b), a), b), a, b)
    moved = comps.join(more.toDF("comp", "__c"), "comp", "left").select("node", F.coalesce("__c", "comp").alias("comp"))
    return cut(moved.union(more), "components", slim=True)
