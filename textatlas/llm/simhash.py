"""SimHash near-duplicates, with BK-trees for the search within a Hamming radius.

1. A fingerprint per document; documents with the same one are one node.
2. Fingerprints within radius r agree in all but r of `blocks` bit blocks, so each goes, once for every choice of
   blocks - r blocks, to the shard of the bits in them. Nothing within the radius is missed.
3. In a shard, a BK-tree (children keyed by integer Hamming distance to the parent) takes the fingerprints in turn;
   each is searched for first, following only edges within the radius. A union-find keeps a spanning forest of the
   shard's links, so a shard gives fewer links than it has fingerprints, however dense.
4. Shards over `shard_rows` fingerprints are split: one tree for each part, and each part's fingerprints searched in
   every tree, in tasks of their own.
5. Components of the links over all shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textatlas.llm.common import copied, dealt, small_batches, staged
from textatlas.llm.components import connected_components

BITS = 64
MASK = (1 << BITS) - 1


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of the text with A-Z lower-cased, repeats included; a text of fewer words is one shingle, a
    blank one none."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and blanks 0x20 and 0x09 to 0x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, shingles = xxhash.xxh64_intdigest, zip(*(words[i:] for i in range(shingle)))
    if len(words) < shingle:
        shingles = [words] if words else []
    return np.fromiter((digest(b" ".join(s), seed) for s in shingles), dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash, as a signed integer: a bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the memory that long texts take
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return fingerprint_of(shingle_hashes(text, shingle, seed))


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


class BKTree:
    """Nodes are fingerprints; a node's children are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for e, child in self.children[at].items():
                if d - radius <= e <= d + radius:
                    todo.append(child)
        return found


    def nearest(self, value: int, radius: int) -> int | None:
        """The place of a value at the least distance, if that is within the radius."""
        best, found, todo = radius + 1, None, [0] if self.values else []
        while todo and best:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d < best:
                best, found = d, at
            todo += [child for e, child in self.children[at].items() if d - best < e < d + best]
        return found


def rooted(parent: list[int], i: int) -> int:
    """The root of i in a union-find, whose paths are halved on the way."""
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(own: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning links among own (others None), or between own and others, within the radius. Unsigned values."""
    values = own + (others or [])
    parent = list(range(len(values)))
    tree, links = BKTree(), []

    def link(i: int, j: int) -> None:
        a, b = rooted(parent, i), rooted(parent, j)
        if a != b:
            parent[a] = b
            links.append((values[i], values[j]))

    for i, value in enumerate(own):
        if others is None:
            for j in tree.within(value, radius):
                link(i, j)
        tree.add(value)
    for i, value in enumerate(others or []):
        for j in tree.within(value, radius):
            link(len(own) + i, j)
    return links


def over_shards(batches: Iterator[pd.DataFrame], solve: Callable[[pd.DataFrame], Iterator[tuple[int, int]]]) -> Iterator[pd.DataFrame]:
    """The pairs (u, v) that solve(rows) gives for every shard (shard, a, b) of over one row; rows come sorted by shard."""

    def solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k = rows[["shard", "a", "b"]].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = np.concatenate([[0], cuts, [len(k)]])
        # one fingerprint alone has no link
        found = (x for i in np.flatnonzero(np.diff(edges) > 1) for x in solve(rows.iloc[edges[i] : edges[i + 1]]))
        while out := list(islice(found, 1 << 16)):
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[["shard", "a", "b"]].to_numpy()
        at = int((~(k == k[-1]).all(axis=1)).sum())  # the last shard may go on in the next batch
        if rest and at == 0 and (rest[-1][["shard", "a", "b"]].to_numpy()[-1] == k[-1]).all():
            rest.append(batch)
            continue
        done = pd.concat([*rest, batch.iloc[:at]]) if rest else batch.iloc[:at]
        rest = [batch.iloc[at:]]
        if len(done):
            yield from solved(done)
    if rest:
        yield from solved(pd.concat(rest))


def _search(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of the shards: side 0 builds the tree, 1 searches."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x

    def solve(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        fps, side = part["fp"].to_numpy(), part["side"].to_numpy()
        own = [int(x) & MASK for x in fps[side == 0]]
        others = None if part["a"].iat[0] == part["b"].iat[0] else [int(x) & MASK for x in fps[side == 1]]
        return ((signed(x), signed(y)) for x, y in _forest(own, others, radius))

    return over_shards(batches, solve)


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of longs: for every choice of blocks - radius blocks, its number and the bits in them."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for c in chosen:
            width = cuts[c + 1] - cuts[c]
            bits = F.shiftrightunsigned(fp, cuts[c]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def dealt_shards(keyed: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """keyed(shard, ...) with a, b and side: a shard of a weight (rows, by default) over `most` is split into parts by hash,
    each pair of parts (a, b), a <= b, is a shard of its own, with the rows of a on side 0 and those of b on side 1."""
    of = F.count("*") if weight is None else F.sum(weight)
    large = keyed.groupBy("shard").agg(of.alias("w")).where(F.col("w") > most).select("shard", F.ceil(F.col("w") / most).cast("int").alias("parts"))
    names = [c for c in keyed.columns if c != "shard"]
    own = F.pmod(F.xxhash64("node" if "node" in names else "fp"), F.coalesce("parts", F.lit(1))).cast("int")
    split = keyed.join(F.broadcast(large), "shard", "left").withColumn("own", own)
    placed = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    return placed.select("shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side, *names)


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4096) -> DataFrame:
    """u, v: links that span each component of the distinct fingerprints nodes(fp) within the radius."""
    keyed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("shard"))
    dealt = dealt_shards(keyed, shard_rows).repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    return dealt.mapInPandas(lambda batches: _search(batches, radius), "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4096) -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits), component_id: a row per document of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, itself included. Null,
    empty and blank texts have fingerprint zero, linked like any other. A null doc_id takes part; a component with no
    other id has a null component_id. Repeated rows each get their row. Other columns are ignored."""
    fps = staged(small_batches(docs).select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(links(nodes, radius, blocks, shard_rows))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.join(least, "root").select("fp", "component_id")
    return fps.join(found, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def row_key(docs: DataFrame) -> Column:
    """MD5 of id and text: rows with the same one are copies of one another. Never null."""
    doc_id, text = docs["doc_id"].cast("string"), docs["text"]
    told = [F.coalesce(F.concat(F.length(doc_id).cast("string"), F.lit(":"), doc_id), F.lit("-")), F.coalesce(F.concat(F.lit("t"), text), F.lit("-"))]
    return F.md5(F.concat(*told))


def first_row() -> Column:
    """Of rows (doc_id, key), the key of the one with the smallest id (null last), ties by key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))


def keep_rows(docs: DataFrame, signed: DataFrame, roots: DataFrame, most_broadcast: int = 500_000, most: int = 100_000) -> DataFrame:
    """One row of docs for each component: the one with the smallest id, null last, ties by key.

    signed(doc_id, key, node): a row per row of docs, key being row_key. roots(node, root): the nodes that are linked; the
    others are components of their own. The rows that go and those that are repeated are told by key: up to
    most_broadcast keys are broadcast and no text is shuffled, more are joined. A node's rows are dealt over tasks."""
    nodes = signed.groupBy("node").agg(first_row().alias("first"), F.count("*").alias("n"))
    named = nodes.join(roots, "node", "left").where((F.col("n") > 1) | F.col("root").isNotNull())
    named = staged(named.select("node", "first", F.coalesce("root", "node").alias("root")), "groups")
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    best = named.select("node", "root").join(best, "root").select("node", F.col("best.key").alias("stays"))
    dealt_rows, large = dealt(signed.select("node", "key", "doc_id"), "node", most)
    told = dealt_rows.join(copied(best, "node", large), ["node", "part"]).groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.col("key") == F.col("stays")).alias("stays")
    )
    told = staged(told.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("key").alias("__key"), "stays"), "told")
    n, repeated = told.agg(F.count("*"), F.count_if("stays")).first()
    hint = F.broadcast if n <= most_broadcast else lambda x: x
    keyed = docs.withColumn("__key", row_key(docs))
    out = keyed.join(hint(told.select("__key")), "__key", "left_anti")
    if repeated:  # rows that are copies of one another in id and text
        out = out.unionByName(keyed.join(hint(told.where("stays").select("__key")), "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(docs.columns)


def dedup(docs: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4096) -> DataFrame:
    """One row of docs for each component of simhash_groups: the one with the smallest doc_id, null last.

    It is told by id and text, so a text stays that shares its id, or the lack of one, with rows of other components."""
    signed = staged(small_batches(docs).select("doc_id", row_key(docs).alias("key"), fingerprint_udf("text").alias("node")), "fingerprints")
    roots = connected_components(links(signed.select(F.col("node").alias("fp")).distinct(), radius, blocks, shard_rows))
    return keep_rows(docs, signed, roots)
