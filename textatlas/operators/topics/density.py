"""Density clustering: the tree of clusters over mutual reachability distances, and of it the clusters of most excess of mass.

(Campello, Moulavi and Sander, 2013.) The tree is built over a bounded sample in the driver's memory; every point gets the
cluster of its nearest neighbour in the sample, if it is as close as the cluster's own points are, else it is an outlier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: neighbours, the point itself among them, within a point's core distance.
MIN_SAMPLES = 5


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0))


def core_distances(x: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row of x to its k-th nearest row of `to` (the farthest if there are fewer)."""
    k = min(k, len(to))
    blocks = [np.partition(_distances(x[i : i + 512], to), k - 1, axis=1)[:, k - 1] for i in range(0, len(x), 512)]
    return np.concatenate(blocks) if blocks else np.zeros(0)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """(distance, i, j): the edges of a minimum spanning tree over mutual reachability, the shortest first."""
    n = len(x)
    near, by, free, at, edges = np.full(n, np.inf), np.zeros(n, dtype=int), np.ones(n, dtype=bool), 0, []
    for _ in range(n - 1):
        free[at] = False
        reach = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        closer = free & (reach < near)
        near[closer], by[closer] = reach[closer], at
        at = int(np.where(free, near, np.inf).argmin())
        edges.append((float(near[at]), int(by[at]), at))
    return sorted(edges)


@dataclass
class _Node:
    size: int
    distance: float = 0.0
    left: int = -1
    right: int = -1


def _merges(n: int, edges: list[tuple[float, int, int]]) -> list[_Node]:
    """The binary tree of single linkage: n leaves, then a node for each edge; the last is the root."""
    nodes, top, parent = [_Node(1) for _ in range(n)], list(range(n)), list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, i, j in edges:
        a, b = find(i), find(j)
        nodes.append(_Node(nodes[top[a]].size + nodes[top[b]].size, d, top[a], top[b]))
        parent[a], top[b] = b, len(nodes) - 1
    return nodes


def _leaves(nodes: list[_Node], at: int) -> list[int]:
    out, todo = [], [at]
    while todo:
        i = todo.pop()
        if nodes[i].left < 0:
            out.append(i)
        else:
            todo += [nodes[i].left, nodes[i].right]
    return out


def density_labels(x: np.ndarray, min_size: int, min_samples: int = MIN_SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (-1: outlier), the core distances, and the greatest distance at which each label's cluster holds together.

    A split of the tree makes two clusters if both sides have min_size points; else the smaller side's points fall out of the
    cluster, each at its density, one over the distance. A cluster is chosen if its mass over its birth's density exceeds
    that of the clusters chosen below it; the whole is never one."""
    n = len(x)
    core = core_distances(x, x, min_samples)
    labels, held = np.full(n, -1), []
    if n < max(2, min_size):
        return labels, core, np.zeros(0)
    nodes = _merges(n, spanning_tree(x, core))
    density = lambda d: 1 / max(d, 1e-12)
    top = [len(nodes) - 1]  # a cluster: the tree's node where it begins
    born, mass, below, lost = [0.0], [0.0], [[]], [[]]
    c = 0
    while c < len(top):  # clusters come before those that split from them
        at = top[c]
        while nodes[at].left >= 0:
            a, b = nodes[at].left, nodes[at].right
            if nodes[a].size < nodes[b].size:
                a, b = b, a
            at_density = density(nodes[at].distance)
            if nodes[b].size >= min_size:
                mass[c] += (at_density - born[c]) * nodes[at].size
                for child in (a, b):
                    below[c].append(len(top))
                    top.append(child), born.append(at_density), mass.append(0.0), below.append([]), lost.append([])
                break
            fallen = nodes[b].size if nodes[a].size >= min_size else nodes[at].size
            mass[c] += (at_density - born[c]) * fallen
            if nodes[a].size < min_size:
                break
            at = a
        c += 1
    best, chosen = mass.copy(), [True] * len(top)
    for c in range(len(top) - 1, -1, -1):
        inside = sum(best[k] for k in below[c])
        chosen[c] = c > 0 and (not below[c] or mass[c] >= inside)
        if not chosen[c]:
            best[c] = inside
    todo = [0]
    while todo:
        c = todo.pop()
        if chosen[c]:
            labels[_leaves(nodes, top[c])] = len(held)
            held.append(1 / born[c])
        else:
            todo += below[c]
    return labels, core, np.array(held)


def placed_among(v: np.ndarray, x: np.ndarray, labels: np.ndarray, core: np.ndarray, held: np.ndarray, min_samples: int, block: int = 32) -> np.ndarray:
    """Labels of the rows of v by their nearest of x in mutual reachability, of equals by the nearest in distance.

    In blocks: a few arrays of block times len(x) are all that is in memory, whatever the number of rows."""
    out, k = np.full(len(v), -1), min(min_samples, len(x)) - 1
    for i in range(0, len(v), block):
        d = _distances(v[i : i + block], x)
        reach = np.maximum(np.maximum(d, np.partition(d, k, axis=1)[:, k][:, None]), core)
        least = reach.min(axis=1)
        near = np.where(reach == least[:, None], d, np.inf).argmin(axis=1)
        label = labels[near]
        out[i : i + block] = np.where(least <= np.where(label < 0, -1, held[label]) * (1 + 1e-9), label, -1)
    return out


def cluster_density(points: DataFrame, vector: str, min_size: int, min_samples: int = MIN_SAMPLES, most_sample: int = 5000) -> DataFrame:
    """points and topic (int from 0 by falling size, -1 for outliers), by the densities of `vector`, an array of a few numbers.

    The tree is of at most most_sample points, by hash of the vector, in which min_size counts; every point is then placed, in
    batches. Null vectors are outliers; equal ones get the same topic. An empty table gives no rows."""
    values = points.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    sample = [r[0] for r in values.orderBy(F.xxhash64("v")).limit(most_sample).collect()]
    x = np.array(sample or np.zeros((0, 1)), dtype=float)
    labels, core, held = density_labels(x, min_size, min_samples)

    @F.pandas_udf("int")
    def place(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1)
        known = np.flatnonzero(vectors.notna().to_numpy())
        if len(held) and len(known):
            for i in range(0, len(known), 512):  # the lists of a batch are copied by parts
                rows = known[i : i + 512]
                out[rows] = placed_among(np.stack(vectors.iloc[rows].to_list()).astype(float), x, labels, core, held, min_samples)
        return pd.Series(out, dtype="int32")

    placed = points.withColumn("__c", place(F.col(vector).cast("array<double>")))
    sizes = placed.where("__c >= 0").groupBy("__c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__c").collect()  # a row a cluster
    order = [x for i, r in enumerate(sizes) for x in (F.lit(r[0]), F.lit(i))]
    topic = F.coalesce(F.try_element_at(F.create_map(*order), F.col("__c")), F.lit(-1)) if order else F.lit(-1)
    return placed.withColumn("topic", topic.cast("int")).drop("__c")
