"""Chat formatting by cumulative-snapshot collapse, native DataFrame operations only.

Chat logs often hold every snapshot of a growing conversation. Each turn gets a 128-bit digest of
(place, role, text); the running XOR of those digests is the rolling hash of the turn prefix that
ends there. A conversation whose whole hash is also the hash of a proper prefix of a longer one is a
snapshot of it and goes (anti-join); of equal conversations the smallest conv_id stays. What is left
is rendered as one text.

Defined cases: turns are taken by turn, then role, then text, so ties and gaps in turn numbers do
not matter; repeated rows are turns of their own; a null role is rendered as "unknown", a null
text as empty; rows with a null conv_id form one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversation_table(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, prefixes, chat): one row per conversation, over one shuffle by conv_id."""
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = clean.withColumn("place", F.row_number().over(order))
    digest = placed.withColumns(
        {
            "a": F.xxhash64("place", "role", "text"),
            "b": F.xxhash64(F.lit("second digest"), "text", "role", "place"),
        }
    )
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = digest.withColumns({"a": F.bit_xor("a").over(run), "b": F.bit_xor("b").over(run)})
    turn = F.struct("place", "a", "b", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("said"))
    listed = rolled.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: F.struct(t["place"].alias("n"), t["a"].alias("a"), t["b"].alias("b"))).alias("prefixes"),
        F.array_join(F.transform("turns", lambda t: t["said"]), "\n").alias("chat"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, n_chars, chat.

    n_copies counts the equal conversations it stands for, itself included. n_chars is the length
    of chat in code points.
    """
    table = conversation_table(turns)
    whole = table.withColumn("last", F.element_at("prefixes", -1)).select(
        "conv_id", "n_turns", F.col("last.a").alias("a"), F.col("last.b").alias("b"), "chat"
    )
    proper = (
        table.select(F.explode(F.slice("prefixes", 1, F.greatest(F.col("n_turns") - 1, F.lit(0)))).alias("p"))
        .select(F.col("p.n").alias("n_turns"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .distinct()
    )
    # equal conversations: only ids and counts meet, combined before the shuffle
    copies = whole.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    maximal = copies.join(proper, ["n_turns", "a", "b"], "left_anti")
    kept = maximal.select(F.col("conv_id").alias("__id"), "n_copies")
    return whole.join(kept, whole["conv_id"].eqNullSafe(kept["__id"])).select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies", F.char_length("chat").cast("bigint").alias("n_chars"), "chat"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' AS said
  FROM conversations),
p AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(said, chr(10)) OVER (PARTITION BY conv_id ORDER BY place) AS chat FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat FROM p WHERE place = n_turns GROUP BY n_turns, chat)
SELECT conv_id, n_turns, n_copies, length(chat) AS n_chars, chat FROM whole
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = whole.n_turns AND p.n_turns > p.place AND p.chat = whole.chat)
"""
