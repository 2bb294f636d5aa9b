"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum by node (combined map-side) and a join in which a node with many edges is dealt over several tasks,
so no node's edges are gathered in one; every step's edges are written to the shared folder, which cuts the lineage. A table
of few edges, counted first, is one task's union-find instead of some ten jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textatlas.llm.common import copied, dealt, drop, staged

#: Edges of a node in one task.
MOST = 100_000


def _joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges and their u's row of least. With n edges in all, no node has more."""
    if n <= MOST:
        return edges.join(least, "u")
    mine, large = dealt(edges, "u", MOST)
    return mine.join(copied(least, "u", large), ["u", "part"])


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = _joined(both, least, 2 * n).where("v > u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = _joined(edges, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    yield pd.DataFrame({"node": nodes, "root": np.array([find(x) for x in nodes.tolist()], dtype=np.int64)})


def connected_components(edges: DataFrame, in_one_task: int = 200_000) -> DataFrame:
    """node, root for edges(u, v) of long ids: every node of an edge with the least node of its component.

    Nulls, loops and repeated edges don't count; no edges, no rows. Up to in_one_task distinct edges (16 bytes each) are
    solved in a task; for more, it goes on until a round changes nothing, which takes a number of rounds in the order of the
    logarithm of the longest chain. The rows are the same."""
    now = edges.where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = staged(now, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= in_one_task:
            return now.repartition(1).mapInPandas(_union_find, "node long, root long")
        if mark == before:
            break
        before, last = mark, now
        now = staged(_small_star(_large_star(now, mark[0]), mark[0]), "edges")
        drop(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
