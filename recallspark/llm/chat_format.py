"""Chat formatting of logged conversations, in DataFrame operations only.

Logs often hold one conversation again and again, each time with a few more turns. Every
conversation gets a rolling hash of its turns (the exclusive or of two 64-bit hashes of each turn
with its number, over all turns so far); conversations whose whole hash is the hash of a proper
prefix of another one leave by an anti-join, of equal ones the smallest id stays. The 128 bits and the
number of turns decide alone; dropped conversations are not compared turn by turn. What is left is
rendered turn by turn.

The running hash is taken over blocks of 256 turn numbers and inside the blocks, and long
conversations are rendered in one part per block. Blocks of more than ``part_rows`` rows, as of a null
id or one repeated turn number, are cut by the rank of their rows, so no group is of unbounded size.

Defined cases: a null turn comes first, a null role or text is empty, rows of a null id form one
conversation; repeated rows count once; rows that share a turn are ordered by role and text; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.scale import with_position
from .common import stored

BLOCK_BITS = 8
FIRST = -(1 << 62)


def _turns(chats: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = chats.select(F.col(id_col).alias("id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(FIRST)).alias("turn"),
                        text(role_col).alias("role"), text(text_col).alias("text"))
    return rows.select("*", F.shiftright("turn", BLOCK_BITS).alias("block"), F.xxhash64("turn", "role", "text").alias("h1"),
                       F.xxhash64(F.lit(1), "text", "turn", "role").alias("h2"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(id, turn, h1, h2, n): hash and number of the turns up to and including ``turn``."""
    steps = turns.select("id", "block", "turn", "h1", "h2").distinct().groupBy("id", "block", "turn").agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n"))
    blocks = steps.groupBy("id", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("n").alias("n"))
    w = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("id").alias("__id"), F.col("block").alias("__block"), F.bit_xor("h1").over(w).alias("b1"),
                           F.bit_xor("h2").over(w).alias("b2"), F.sum("n").over(w).alias("bn"))
    w = Window.partitionBy("id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = steps.select("id", "block", "turn", F.bit_xor("h1").over(w).alias("h1"), F.bit_xor("h2").over(w).alias("h2"),
                         F.sum("n").over(w).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = inner.join(before, inner["id"].eqNullSafe(before["__id"]) & (inner["block"] == before["__block"]))
    return out.select("id", "turn", F.col("h1").bitwiseXOR(zero("b1")).alias("h1"), F.col("h2").bitwiseXOR(zero("b2")).alias("h2"),
                      (F.col("n") + zero("bn")).alias("n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(id, n_turns) of the conversations that are no prefix of another one."""
    prefixes = prefix_hashes(turns)
    ends = prefixes.groupBy("id").agg(F.max_by(F.struct("h1", "h2", "n", "turn"), "turn").alias("e")).select("id", "e.*")
    last = ends.select(F.col("id").alias("__id"), F.col("turn").alias("__last"))
    proper = prefixes.join(last, prefixes["id"].eqNullSafe(last["__id"]) & (prefixes["turn"] < last["__last"]))
    proper = proper.select("h1", "h2", "n").distinct()
    alike = ends.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"))  # copies are one row before they meet the prefixes
    return alike.join(proper, ["h1", "h2", "n"], "left_anti").select("id", F.col("n").alias("n_turns"))


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 template: str = "<|im_start|>%s\n%s<|im_end|>\n", part_rows: int = 4096) -> DataFrame:
    """(id, part, n_turns, rendered) for every maximal conversation; ``template`` takes role and text,
    parts are numbered from 0."""
    turns = _turns(chats, id_col, turn_col, role_col, text_col)
    kept = maximal_conversations(turns).withColumnRenamed("id", "__id")
    rows = stored(turns.join(kept, turns["id"].eqNullSafe(kept["__id"])).select(
        "id", "n_turns", "block", "turn", "role", "text").distinct(), "rows")
    sizes = rows.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    sizes = stored(sizes.select(F.col("id").alias("__id"), F.col("block").alias("__block")), "sizes")
    same = rows["id"].eqNullSafe(sizes["__id"]) & (rows["block"] == sizes["__block"])
    pieces = rows.join(sizes, same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    if not sizes.isEmpty():
        placed = with_position(rows.join(sizes, same, "left_semi"), [F.col(c) for c in ("id", "block", "turn", "role", "text")], "__pos")
        placed = stored(placed, "placed")
        first = placed.groupBy("id", "block").agg(F.min("__pos").alias("__first")).toDF("__id", "__block", "__first")
        placed = placed.join(first, placed["id"].eqNullSafe(first["__id"]) & (placed["block"] == first["__block"]))
        pieces = pieces.unionByName(placed.select(*rows.columns, F.floor((F.col("__pos") - F.col("__first")) / part_rows).alias("piece")))
    rows = pieces.groupBy("id", "n_turns", "block", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    one = F.transform("t", lambda t: F.format_string(template, t["role"], t["text"]))
    # parts are numbered without their text: a conversation has few of them, however long it is
    part = F.row_number().over(Window.partitionBy("id").orderBy("block", "piece")) - 1
    numbers = pieces.select("id", "block", "piece").distinct().withColumn("part", part.cast("long")).toDF("__id", "__block", "__piece", "part")
    same = rows["id"].eqNullSafe(numbers["__id"]) & (rows["block"] == numbers["__block"]) & (rows["piece"] == numbers["__piece"])
    return rows.join(numbers, same).select(F.col("id").alias(id_col), "part", "n_turns", F.array_join(one, "").alias("rendered"))
