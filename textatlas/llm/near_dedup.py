"""Near-duplicates of a stated similarity: Jaccard of the sets of five-word shingles >= 0.8, every link checked exactly.

SimHash fingerprints of the shingles are searched in BK-trees, as in simhash.links. At similarity 0.8 they are some 10 of 64
bits apart (standard deviation 3), too far to be dealt to shards by bit blocks, so least hashes of the shingles deal them:
20 shards a document, each named by 5 least hashes. Two documents at 0.8 meet in a shard with probability
1 - (1 - 0.8^5)^20 = 0.9996, closer ones with more.

1. A node for each distinct shingle set, so exact copies never meet in pairs.
2. In the BK-tree of a shard, each node is paired with its nearest within the radius among those before it: as many pairs as
   nodes. Pairs are compared by their shingle sets; components of those that reach the similarity.
3. Shards that still hold nodes of different components get the shingle sets. There, every pair within the radius is compared
   unless a union-find has it in one component by now, or an earlier shard of both compares it. Only links leave the
   task. So every two nodes that meet in a shard are compared or linked already, in shards of any size: a large one is
   split into parts, each searched in the tree of every other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textatlas.llm import simhash
from textatlas.llm.common import copied, dealt, drop, small_batches, staged
from textatlas.llm.components import connected_components
from textatlas.llm.simhash import MASK, BKTree, fingerprint_of, over_shards, rooted, shingle_hashes
from textatlas.plans.sizing import broadcast_if_small

_RANDOM = np.random.default_rng(42)
_ODD = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, 1024, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """Signed 64-bit names of the shards of a set that isn't empty."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 10):  # bounds the memory that long texts take
        part = hashes[i : i + (1 << 10)]
        least = np.minimum(least, (part[None, :] * _ODD[: bands * rows, None] + _ADD[: bands * rows, None]).min(axis=1))
    signed = lambda b, x: int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), b)).astype(np.int64))
    return [signed(b, x) for b, x in enumerate(least.reshape(bands, rows))]


def _signed_udf(shingle: int, bands: int, rows: int):
    @F.pandas_udf("struct<node: long, fp: long, n: long, bands: array<long>>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            found = np.unique(hashes)
            node = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))
            out.append((node, fingerprint_of(hashes), len(found), band_keys(found, bands, rows) if len(found) else []))
        return pd.DataFrame(out, columns=["node", "fp", "n", "bands"])

    return signed


def _alike_udf(shingle: int, similarity: float):
    @F.pandas_udf(T.BooleanType())
    def alike(ours: pd.Series, theirs: pd.Series) -> pd.Series:
        known = lru_cache(64)(lambda text: shingle_set(text, shingle))  # rows come by the second text
        return pd.Series([_alike(known(a), known(b), similarity) for a, b in zip(ours, theirs)], dtype=bool)

    return alike


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def meetings(nodes: DataFrame) -> DataFrame:
    """shard, times, node, fp, n: the shards of over one node, of nodes(node, fp, n, bands)."""
    keyed = nodes.select("node", F.explode("bands").alias("shard"))
    shared = keyed.groupBy("shard").agg(F.count("*").alias("times")).where("times > 1")
    return keyed.join(shared, "shard").join(nodes.select("node", "fp", "n"), "node").select("shard", "times", "node", "fp", "n")


def _in_order(sharded: DataFrame) -> DataFrame:
    return sharded.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b", "node")


def _pairs(part: pd.DataFrame, find) -> Iterator[tuple[int, int]]:
    """(i, j), places in part, for every j that find(tree, fingerprint of i) gives: among side 0, or of side 1 in side 0."""
    fps, side, same = [int(x) & MASK for x in part["fp"]], part["side"].to_numpy(), part["a"].iat[0] == part["b"].iat[0]
    own, tree = np.flatnonzero(side == 0), BKTree()
    if not same:
        for i in own:
            tree.add(fps[i])
    for i in own if same else np.flatnonzero(side == 1):
        for at in find(tree, fps[i]):
            yield i, own[at]
        if same:
            tree.add(fps[i])


def nearest_pairs(sharded: DataFrame, radius: int) -> DataFrame:
    """u > v: distinct pairs of a node and its nearest in the trees of its shards, within the radius."""

    def solve(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        nodes = part["node"].to_numpy()
        for i, j in _pairs(part, lambda tree, fp: [at for at in [tree.nearest(fp, radius)] if at is not None]):
            yield max(nodes[i], nodes[j]), min(nodes[i], nodes[j])

    return _in_order(sharded).mapInPandas(lambda batches: over_shards(batches, solve), "u long, v long").distinct()


def links_across(sharded: DataFrame, radius: int, similarity: float) -> DataFrame:
    """u, v: links between nodes of different `root`, of sharded(shard, a, b, side, node, fp, n, root, bands, hashes)."""

    def solve(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        nodes, n, bands = part["node"].to_numpy(), part["n"].to_numpy(), np.stack(part["bands"].to_list())
        _, parent = np.unique(part["root"].to_numpy(), return_inverse=True)
        if not parent.any():
            return
        first: dict[int, int] = {}
        parent = [first.setdefault(r, i) for i, r in enumerate(parent.tolist())]
        sets, shard = [np.frombuffer(x, dtype="<u8") for x in part["hashes"]], part["shard"].iat[0]
        for i, j in _pairs(part, lambda tree, fp: tree.within(fp, radius)):
            a, b = rooted(parent, i), rooted(parent, j)
            if a == b or min(n[i], n[j]) < similarity * max(n[i], n[j]) or bands[i][np.argmax(bands[i] == bands[j])] != shard:
                continue
            if _alike(sets[i], sets[j], similarity):
                parent[a] = b
                yield nodes[i], nodes[j]

    return _in_order(sharded).mapInPandas(lambda batches: over_shards(batches, solve), "u long, v long")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, most: int = 1000) -> DataFrame:
    """The pairs(u, v) whose texts(node, text) reach the similarity. A node of many pairs is dealt over tasks."""
    for c, named in (("u", "ours"), ("v", "theirs")):
        rows, large = dealt(pairs, c, most)
        side = copied(texts.select(F.col("node").alias(c), F.col("text").alias(named)), c, large)
        pairs = rows.join(side, [c, "part"]).drop("part")
    return pairs.where(_alike_udf(shingle, similarity)("ours", "theirs")).select("u", "v")


def linked(docs: DataFrame, signed: DataFrame, shingle: int, similarity: float, radius: int, shard_rows: int) -> DataFrame:
    """node, root for the nodes of signed(doc_id, key, node, fp, n, bands) that have a link. A task holds shard_rows nodes,
    or in the second step as many hashes as that many sets of 512 have."""
    nodes = signed.groupBy("node").agg(simhash.first_row().alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    nodes = staged(nodes, "nodes")
    met = staged(meetings(nodes), "shards")
    keys = met.select("node").distinct().join(nodes, "node").select("node", F.col("first.key").alias("__key"))
    keys = broadcast_if_small(staged(keys, "keys"), 500_000)  # else all texts are shuffled
    texts = docs.select(simhash.row_key(docs).alias("__key"), "text").join(keys, "__key").dropDuplicates(["node"])
    texts = staged(texts.select("node", "text"), "texts")
    pairs = staged(nearest_pairs(simhash.dealt_shards(met, shard_rows), radius), "nearest")
    near = staged(similar(pairs, texts, shingle, similarity), "links")
    roots = connected_components(near)
    rooted_rows = met.where("times > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted_rows.groupBy("shard").agg((F.min("root") < F.max("root")).alias("several")).where("several").select("shard")
    open_rows = staged(rooted_rows.join(several, "shard").drop("times"), "open")
    hashes = F.udf(lambda text: shingle_set(text, shingle).astype("<u8").tobytes(), "binary", useArrow=True)
    sets = texts.join(open_rows.select("node").distinct(), "node").select("node", hashes("text").alias("hashes"))
    sets = staged(sets.join(nodes.select("node", "bands"), "node"), "sets")
    weighed = simhash.dealt_shards(open_rows, 512 * shard_rows, F.greatest("n", F.lit(512)))
    more = staged(links_across(weighed.join(sets, "node"), radius, similarity), "links")
    if not more.isEmpty():
        roots = connected_components(near.unionByName(more))
    drop(nodes, met, texts, pairs, near, open_rows, sets, more)
    return roots


def dedup(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 20, rows: int = 5, radius: int = 24, shard_rows: int = 4096
) -> DataFrame:
    """One row of docs(doc_id, text) for each component of documents linked by the similarity, as simhash.dedup chooses it.

    Texts without a word are one group; texts of fewer than `shingle` words are alike only if equal but for blanks and A-Z.
    A radius of 24 bits is five standard deviations over the mean at similarity 0.8. Null ids and repeated rows: see
    simhash.keep_rows. An empty table gives no rows."""
    told = small_batches(docs).select("doc_id", simhash.row_key(docs).alias("key"), _signed_udf(shingle, bands, rows)("text").alias("s"))
    signed = staged(told.select("doc_id", "key", "s.*"), "signatures")
    return simhash.keep_rows(docs, signed, linked(docs, signed, shingle, similarity, radius, shard_rows))
