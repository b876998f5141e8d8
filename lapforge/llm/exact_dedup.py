"""Exact deduplication by skew-safe combining, native DataFrame operations only.

Stages: copies are first combined inside each input partition (partial aggregation), then the
survivors of one digest meet in SALTS separate groups, then the salt winners are combined
globally. The grouping keys hold the whole normalised text beside its digest, so content is
compared in full at every stage and a digest collision could not merge different texts. No stage
gathers the members of a group: only a fixed-size (best row, count) pair is carried.

Defined cases: a null text counts as empty, all empty texts form one group; of rows that repeat
doc_id and text one stays, the others are reported as dropped; a null doc_id loses every tie and is
reported as null; an empty table gives an empty result; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.storage import written

SALTS = 16
WHITESPACE = r"[\x20\x09-\x0D]+"
_TOP = 9223372036854775807  # the largest doc_id
_STEP = "100000000000000000000"  # above any doc_id distance


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _rank(length: Column, doc_id: Column) -> Column:
    """One fixed-width number whose maximum is the longest original, then the smallest doc_id."""
    back = F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + F.lit(1)
    return (
        length.cast("decimal(11,0)") * F.lit(_STEP).cast("decimal(21,0)") + F.coalesce(back, F.lit(0).cast("decimal(20,0)"))
    ).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, fingerprint, n_norm, keep_id, keep_len, group_size): one row per distinct text."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("len"),
        normalised(F.col("text")).alias("content"),
    ).select(
        F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        "content",
        _rank(F.col("len"), F.col("doc_id")).alias("rank"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    step = F.lit(_STEP).cast("decimal(38,0)")
    low = F.col("rank") % step
    return whole.select(
        "digest",
        F.xxhash64("content").alias("fingerprint"),
        F.octet_length("content").alias("n_norm"),
        F.when(low > 0, F.lit(_TOP).cast("decimal(20,0)") - low + F.lit(1)).cast("bigint").alias("keep_id"),
        F.floor(F.col("rank") / step).cast("int").alias("keep_len"),
        "group_size",
    )


def exact_decisions(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, salts)
    members = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.char_length(F.coalesce("text", F.lit(""))).alias("len"),
            normalised(F.col("text")).alias("content"),
        )
        .select(
            "doc_id",
            "len",
            F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
            F.xxhash64("content").alias("fingerprint"),
            F.octet_length("content").alias("n_norm"),
        )
        .groupBy("doc_id", "len", "digest", "fingerprint", "n_norm")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    joined = members.join(groups, ["digest", "fingerprint", "n_norm"])
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (best & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decided = written(exact_decisions(docs, salts), "decisions")
    by_id = decided.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("__kept"), F.bool_and("kept").alias("__all"))
    gone = by_id.filter("not __all").drop("__all")
    marked = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["__id"]), "left")
    untouched = marked.filter(F.col("__kept").isNull()).drop("__id", "__kept")
    if gone.filter("__kept").isEmpty():
        return untouched
    # a doc_id of which one row stays and another goes: rows that repeat a doc_id
    stays = decided.filter("kept").select(F.col("doc_id").alias("__stays"), F.col("text_sha256").alias("__digest"))
    repeated = marked.filter("__kept").withColumn("__sha", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    here = repeated["__id"].eqNullSafe(stays["__stays"]) & (repeated["__sha"] == stays["__digest"])
    one = Window.partitionBy("__id", "__sha").orderBy(F.desc(F.char_length(F.coalesce("text", F.lit("")))))
    first = repeated.join(stays, here, "left_semi").withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    return untouched.unionByName(first.drop("__id", "__kept", "__sha", "__n"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
