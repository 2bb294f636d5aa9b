"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of `window` consecutive words; an item of fewer words is one window. Patterns of one
length make one searcher: the shift table, keyed by a block of two words, tells how far the search may go on; where it
gives 0, the bucket of the block that ends a pattern holds the patterns to compare, first by their first block, then
word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textatlas.llm.common import small_batches, staged
from textatlas.plans.sizing import broadcast_if_small

#: After A-Z are lower-cased: runs of digits, a-z and non-ASCII characters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = re.compile("[A-Z]+")

Window = tuple[str, ...]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)
    return WORD.findall(text)


def windows_of(words: list[str], window: int) -> list[Window]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class WuManber:
    """All places of equally long patterns in a list of words."""

    def __init__(self, patterns: dict[Window, list]) -> None:
        """patterns: window -> what to report for it."""
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, payload in patterns.items():
            for end in range(b, m + 1):
                key = p[end - b : end] if b > 1 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            key = p[m - b :] if b > 1 else p[-1]
            self.bucket.setdefault(key, {}).setdefault(p[:b], []).append((p, payload))
        self.far = m - b + 1

    def places(self, words: list[str]) -> Iterator[tuple[int, list]]:
        """(start, payload) of every occurrence, in order of place."""
        m, n, far, shift = self.length, len(words), self.far, self.shift.get
        at = m - 1  # the last word of the window
        pair = self.block > 1
        while at < n:
            block = (words[at - 1], words[at]) if pair else words[at]
            step = shift(block, far)
            if step:
                at += step
                continue
            start = at - m + 1
            for p, payload in self.bucket[block].get(tuple(words[start : start + self.block]), ()):
                if tuple(words[start : at + 1]) == p:
                    yield start, payload
            at += 1


class Searcher:
    """Wu-Manber searchers over the windows of items (item_id, text), one for each window length."""

    def __init__(self, items: list[tuple], window: int) -> None:
        by_length: dict[int, dict[Window, list]] = {}
        for item_id, text in items:
            for w in windows_of(words_of(text), window):
                ids = by_length.setdefault(len(w), {}).setdefault(w, [])
                if item_id not in ids:
                    ids.append(item_id)
        self.searchers = [WuManber(p) for p in by_length.values()]

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [start, end) of occurrences, and the ids of the items they are of."""
        spans, items = [], set()
        for s in self.searchers:
            for start, ids in s.places(words):
                spans.append((start, start + s.length))
                items.update(ids)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


FOUND = "struct<n_words: long, spans: array<struct<a: int, b: int>>, item_ids: array<string>>"


def _searched(items: list[tuple], window: int):
    """A pandas UDF of texts that gives FOUND for these items. The items go to the executors; a worker builds the tables once."""
    made: list[Searcher] = []

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Searcher(items, window))
        rows = []
        for text in texts:
            words = words_of(text)
            spans, ids = made[0].search(words)
            rows.append((len(words), [{"a": a, "b": b} for a, b in merged(spans)], sorted("" if i is None else str(i) for i in ids)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "item_ids"])

    return search


def item_shards(benchmark: DataFrame, shard_chars: int) -> tuple[DataFrame, int]:
    """Items (item_id, text, shard) and the number of shards of about `shard_chars` characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // shard_chars) or 1
    dealt = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("shard"))
    return (staged(dealt, "items") if n > 1 else dealt), n


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_chars: int = 2_000_000) -> DataFrame:
    """docs with a column `found` (FOUND): the text's words, the spans of words inside occurrences, and their items' ids.

    Items go to the driver and on to the executors in shards of about `shard_chars` characters. A benchmark of one shard is a
    search in one pass, without a shuffle. One of several is a search of all texts for each, one at a time, which writes only
    what it finds, by text; that is joined with docs at the end, by broadcast if it is small.
    Null and wordless texts and items have no windows. Items alike in id are one item, a null id is the empty text.
    Other columns pass through; one named `found` is replaced."""
    names = [c for c in small_batches(docs).columns if c != "found"]
    dealt, n = item_shards(benchmark, shard_chars)
    items = lambda i: [tuple(r) for r in dealt.where(F.col("shard") == i).select("item_id", "text").collect()]
    if n == 1:
        return docs.select(*names, _searched(items(0), window)("text").alias("found"))
    hits, key = None, [F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2")]
    for i in range(n):
        found = docs.select(*key, _searched(items(i), window)("text").alias("f")).where(F.size("f.spans") > 0)
        found = staged(found.groupBy("__h1", "__h2").agg(F.first("f.spans").alias("spans"), F.first("f.item_ids").alias("ids")), "found")
        hits = found if hits is None else hits.unionByName(found)
    merge = F.pandas_udf(
        lambda spans: spans.map(lambda x: [{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in x])]),
        "array<struct<a: int, b: int>>",
    )
    # of a text, at most one row a shard
    per_text = hits.groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    per_text = staged(per_text.select("__h1", "__h2", merge("spans").alias("spans"), "ids"), "found")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    none = F.struct(n_words.alias("n_words"), F.coalesce("spans", F.array()).alias("spans"), F.coalesce("ids", F.array()).alias("item_ids"))
    both = docs.select(*names, *key).join(broadcast_if_small(per_text), ["__h1", "__h2"], "left")
    return both.select(*names, none.cast(FOUND).alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **parameters) -> DataFrame:
    """doc_id, n_words, n_hit, n_items (long), items_sha256, contaminated, spans, item_ids: a row per document.

    n_hit: words inside any occurrence of a window. items_sha256: of the ids of items with occurring windows, sorted as
    strings and comma-joined (of the empty text if there are none). Repeated rows and null ids each get their row; empty
    tables of documents give no rows, of items no occurrence."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark, window, **parameters)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
        F.col("found.spans").alias("spans"),
        F.col("found.item_ids").alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **parameters) -> DataFrame:
    """The rows of docs without an occurrence of a benchmark window: null and wordless texts stay, repeated rows too."""
    wrapped = docs.select("text", F.struct(*docs.columns).alias("__row"))
    found = find_benchmark(wrapped, benchmark, window, **parameters)
    return found.where(F.size("found.spans") == 0).select("__row.*")
