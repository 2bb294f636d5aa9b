"""Cross-tabulations with totals, distributions with entropy, shading and sorting.

Results are long: one row per cell, with null for "all" made explicit as `Total`; widen() pivots them where a table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textatlas.plans.sizing import with_every

TOTAL = "Total"
ALL = "Alle"


def _key(is_total: Column, value: Column) -> Column:
    """What rows and columns are told apart by: a category that is named like the total stays one of its own."""
    return F.struct(is_total.alias("is_total"), value.cast("string").alias("value"))


def crosstab(df: DataFrame, a: str, b: str, dedup: list[str] | None = None, total: str = TOTAL) -> DataFrame:
    """a, b, n (long): counts of every pair that occurs and 0 for the others, the marginals and the grand total.

    dedup: columns whose distinct combinations are counted instead of rows. Rows with a null in a or b don't count. A category
    that is named `total` has its row beside the total's."""
    rows = (df.select(*dedup).distinct() if dedup else df).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cubed = rows.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3 or n > 0")
    named = cubed.select(
        *[_key(flag := F.col("g").bitwiseAND(F.lit(bit)) > 0, F.when(flag, F.lit(total)).otherwise(F.col(c).cast("string"))).alias(c) for c, bit in ((a, 2), (b, 1))],
        "n",
    )
    return zero_filled(named, a, b, "n").select(F.col(f"{a}.value").alias(a), F.col(f"{b}.value").alias(b), "n")


def zero_filled(cells: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A row for every pair of the values of a and b that occur: missing cells are 0. For tables of categories."""
    grid = with_every(cells.select(a).distinct(), cells, b)
    return grid.join(cells, [a, b], "left").select(a, b, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def widen(cells: DataFrame, rows: str, columns: str, value: str, names: list) -> DataFrame:
    """One row per `rows`, one column per name; explicit names save the job that looks for them."""
    return cells.groupBy(rows).pivot(columns, names).agg(F.first(value))


def distribution(df: DataFrame, row: str, column: str, total_row: bool = False, total: str = TOTAL, places: int = 4) -> DataFrame:
    """row, column, n, share, entropy, row_total, row_proportion: each row's distribution over columns.

    entropy in bits over the row's shares; row_proportion of all rows. Only pairs that occur. With total_row, the marginal
    distribution over columns under the name `total`, its own entropy and proportion 1. Rows with nulls don't count."""
    some = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = some.groupBy(F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n"))
    if total_row:
        margin = counts.groupBy(column).agg(F.sum("n").alias("n")).select(F.lit(total).alias(row), column, "n", F.lit(True).alias("is_total"))
        counts = counts.withColumn("is_total", F.lit(False)).unionByName(margin)
    else:
        counts = counts.withColumn("is_total", F.lit(False))
    per_row = W.partitionBy("is_total", row)
    everything = counts.where(~F.col("is_total")).agg(F.sum("n").alias("n")).scalar()
    share = F.col("n") / F.col("row_total")
    return (
        counts.withColumn("row_total", F.sum("n").over(per_row))
        .withColumn("entropy", F.sum(-share * F.log2(share)).over(per_row))
        .withColumn("row_proportion", F.col("row_total") / everything)
        .select(
            row,
            column,
            F.col("n").cast("long").alias("n"),
            F.round(share, places).alias("share"),
            F.abs(F.round("entropy", places)).alias("entropy"),
            F.col("row_total").cast("long").alias("row_total"),
            F.round("row_proportion", places).alias("row_proportion"),
        )
    )


def olap_matrix(
    matches: DataFrame,
    word_counts: DataFrame,
    a: str,
    b: str,
    file: str = "file",
    filters: dict[str, str] | None = None,
    relative: bool = True,
    per_words: int = 10_000,
    total: str = "Gesamt",
) -> DataFrame:
    """a, b, n_matches, n_words, value: a match matrix with row, column and grand totals.

    value: the count, or matches per per_words words, rounded to 2 places. The words are those of the distinct files
    with a match in the cell, row, column or table, so totals are computed anew and not summed. filters: column ->
    value, "Alle" filters nothing. word_counts(file, word_count): with repeated files the largest counts, missing files
    count 0 words. Null and empty values of a or b make no row or column, but count in the totals they belong to; a value
    that is named like `total` is a row or column of its own. Without a match there are no rows.

    One pass: each (a, b, file) pair goes to its cell, row, column and the table, and distinct files are summed there, so
    that no task sees more than partial sums of a group."""
    rows = matches
    for column, value in (filters or {}).items():
        if value != ALL:
            rows = rows.where(F.col(column).cast("string") == value)
    words = word_counts.groupBy(file).agg(F.max("word_count").alias("__words"))
    pairs = rows.groupBy(F.nullif(F.col(a).cast("string"), F.lit("")).alias("a"), F.nullif(F.col(b).cast("string"), F.lit("")).alias("b"), file).agg(
        F.count("*").alias("n")
    )
    pairs = pairs.join(words, file, "left").select("a", "b", F.col(file).alias("f"), "n", F.coalesce("__words", F.lit(0)).alias("w"))

    cell = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    row, column, every = _key(F.lit(False), F.col("a")), _key(F.lit(False), F.col("b")), _key(F.lit(True), F.lit(total))
    sets = F.array(cell(row, column), cell(row, every), cell(every, column), cell(every, every))
    placed = pairs.select(F.explode(sets).alias("s"), "f", "n", "w").select("s.a", "s.b", "f", "n", "w")
    per_file = placed.where(F.col("a.value").isNotNull() & F.col("b.value").isNotNull()).groupBy("a", "b", "f").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    # the table itself, read three times below: kept, so that the search is not run again
    cells = per_file.groupBy("a", "b").agg(F.sum("n").alias("n_matches"), F.sum("w").alias("n_words")).persist()
    grid = with_every(cells.select("a").distinct(), cells, "b")
    out = grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_words", F.lit(0)).alias("n_words"))
    value = F.col("n_matches") / F.greatest("n_words", F.lit(1)) * per_words if relative else F.col("n_matches").cast("double")
    return out.select(
        F.col("a.value").alias(a), F.col("b.value").alias(b if b != a else b + "_2"), F.col("n_matches").cast("long").alias("n_matches"),
        F.col("n_words").cast("long").alias("n_words"), F.round(value, 2).alias("value"),
    )


def shade(cells: DataFrame, row: str, column: str, value: str, scope: str = "table") -> DataFrame:
    """cells and `shade`: the value's share of the largest in the table, its column or its row, from 0.14 to 0.9."""
    over = {"table": W.partitionBy(), "column": W.partitionBy(column), "row": W.partitionBy(row)}[scope]
    if scope == "table":
        most = F.greatest(F.lit(1.0), cells.agg(F.max(value).cast("double")).scalar())
    else:
        most = F.greatest(F.lit(1.0), F.max(value).over(over).cast("double"))
    return cells.withColumn("shade", F.greatest(F.lit(0.14), F.least(F.lit(0.9), F.col(value) / most)))


def plain_shade(value: Column) -> Column:
    return F.least(F.lit(0.8), 0.15 + value / 30)


def document_shade(value: Column, most: Column) -> Column:
    return F.least(F.lit(0.85), 0.12 + value / F.greatest(most, F.lit(1)) * 0.6)


def sort_table(df: DataFrame, key: str, descending: bool = False, label: str | None = None, pinned: str = "Gesamt", numeric: bool = True) -> DataFrame:
    """Sorted by key with the total row last; a value that isn't a number counts as below all others."""
    value = F.coalesce(F.col(key).try_cast("double"), F.lit(float("-inf"))) if numeric else F.col(key).cast("string")
    first = [F.col(label) == pinned] if label else []
    return df.orderBy(*first, value.desc() if descending else value.asc())


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group and their rank from 1. `order` should end in a key that tells rows apart."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def capped_legend(counts: DataFrame, label: str, n: str = "n", most: int = 18) -> DataFrame:
    """label, n: the `most` most common categories, and one row "Weitere (k)" for the k others. A list of categories."""
    ranked = counts.withColumn("__r", F.row_number().over(W.orderBy(F.desc(n), label)))
    own = ranked.where(F.col("__r") <= most).select(label, n)
    rest = ranked.where(F.col("__r") > most).agg(F.count("*").alias("k"), F.sum(n).alias(n)).where("k > 0")
    return own.unionByName(rest.select(F.format_string("Weitere (%d)", "k").alias(label), n))
