"""Chat formatting by multi-party perspective rotation. DataFrame functions only.

For every participant, the dialogue is rendered with that speaker as assistant, the others as named users, and a mask over
the assistant's words alone. A conversation is rendered whole, as one row for a participant; a caller may ask for parts.
Marks of the format that stand in a text or a name are broken up, so that no text can end its turn or begin another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """The text with a blank inside every `<|` and `|>`."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def numbered(turns: DataFrame, range_turns: int = 1024) -> DataFrame:
    """turns and `place`, each turn's number in its conversation from 0, by (turn, role, text), nulls first.

    Turn numbers are cut into ranges of range_turns: a running count inside a range and the counts of the ranges before."""
    ranged = turns.withColumn("range", F.floor(F.col("turn") / range_turns))
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    local = ranged.withColumn("local", F.row_number().over(inside) - 1)
    on = local["conv_id"].eqNullSafe(offsets["conv_id"]) & local["range"].eqNullSafe(offsets["range"])
    return local.join(offsets, on).select(
        local["conv_id"], "turn", "role", "text", (F.col("local") + F.col("offset")).alias("place")
    )


def _header(role: Column, perspective: Column, system: str) -> Column:
    return (
        F.when(role == perspective, F.lit(f"{START}assistant\n"))
        .when(role == system, F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), F.regexp_replace(escaped(role), r"[\x00-\x1F]", " "), F.lit("\n")))
    )


def rotate_perspectives(turns: DataFrame, system: str = "system", unknown: str = "unknown", part_turns: int | None = None) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_assistant, rendered, mask: a row per conversation, participant and part.

    Of turns(conv_id, turn, role, text). Participants are the conversation's distinct roles without `system`, whose turns
    are rendered as such from every perspective; a null or empty role is the participant `unknown`. rendered: the part's
    turns in order of (turn, role, text), nulls first. mask: the spans "start-end" of characters to learn from, counted
    from the part's start, comma-joined: the texts of the perspective's own turns with their end marks. A null text counts
    as empty. Repeated rows are turns of their own. Rows with a null conv_id are one conversation. A conversation of
    system turns alone has no participant and so no row. Other columns are ignored; an empty table gives no rows.

    part: 0; with part_turns, a conversation of more turns is cut into parts of that many, each a row without the others'
    turns. Control characters in a role's name are blanks in the rendering."""
    turns = turns.select(
        "conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit(unknown)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    part = F.floor(F.col("place") / part_turns) if part_turns else F.lit(0)
    placed = numbered(turns).withColumn("part", part)
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    people = turns.where(F.col("role") != system).select("conv_id", F.col("role").alias("perspective")).distinct()
    both = parts.join(people, parts["conv_id"].eqNullSafe(people["conv_id"])).select(parts["conv_id"], "part", "perspective", "turns")
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["role"], F.col("perspective"), system).alias("head"),
            F.concat(escaped(t["text"]), F.lit(END)).alias("body"),
            (t["role"] == F.col("perspective")).alias("own"),
        ),
    )
    shaped = both.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.array(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))
        return F.struct(b.alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return shaped.select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        "n_turns",
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_assistant"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask"),
    )
