"""Filter interaction audit: what each quality filter removes in every order, from one SQL CUBE.

Five failure flags are computed per document; documents are counted by (part, flags), and a CUBE over part
and the flags turns those counts into subset survivors: in the grouping set of a subset of filters, the
row whose selected flags are all false counts the documents that pass every filter of the subset. A step
of a filter order is a pair of subsets, before and after its filter, so every order is answered by joining
the survivors of the two; no order scans the documents again.

Filters (words: maximal runs outside ASCII white space, case-sensitive; a null text counts as empty):
A under MIN_WORDS words; B 100 * distinct words < DISTINCT_PCT * words; C 100 * `[A-Z]` characters >
CAPITALS_PCT * code points; D holds any of MARKS; E the same text stands under a smaller doc_id anywhere.

Defined cases: a null source is the part ''; an empty text fails A only (and E where it repeats), having no
words, capitals or marks; rows that repeat the smallest doc_id of a text are no copies of each other; a
null doc_id is smaller than nothing and greater than nothing, so such a row never fails E and has no
label; a document with several label rows counts as good or toxic if one of them says so; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.storage import written

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PCT = 65
CAPITALS_PCT = 5
MARKS = "#$%&*|"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("docs", "good", "toxic")


def text_flags(text: Column) -> list[Column]:
    """Failure flags A to D of a text, which must not be null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PCT,
        capitals.cast("bigint") * 100 > F.char_length(text).cast("bigint") * CAPITALS_PCT,
        text != F.translate(text, MARKS, ""),
    ]


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, a boolean failure flag per filter, good, toxic. Reads the texts once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        *[flag.alias(name) for flag, name in zip(text_flags(text), FILTERS, strict=False)],
    )
    rows = written(rows, "filter_flags")
    # the first holder of each text; documents meet it by their own id, so that a text with many copies is no hot key
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    joined = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return joined.select(
        "part",
        *FILTERS[:4],
        (F.col("is_first").isNull() & F.col("doc_id").isNotNull()).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def survivors(flags: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents that pass every filter whose bit is in mask (bit 0 is A), for all 32 masks of every part.

    Documents are counted by (part, flags) first, so the CUBE expands at most 33 rows a part. A row of no documents
    and no failures per part keeps a grouping set that nothing survives.
    """
    counted = flags.groupBy("part", *FILTERS).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    zero = counted.select("part").distinct().select("part", *[F.lit(False).alias(f) for f in FILTERS], *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    cube = counted.unionByName(zero).cube("part", *FILTERS).agg(
        F.grouping("part").alias("over_parts"),
        sum((F.lit(1 << i) * (1 - F.grouping(f).cast("int")) for i, f in enumerate(FILTERS)), F.lit(0)).alias("mask"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    passed = ~F.coalesce(F.greatest(*FILTERS), F.lit(False))  # an unselected flag is null and greatest skips it
    return cube.filter((F.col("over_parts") == 0) & passed).select("part", "mask", *COUNTS)


def _edges(spark) -> DataFrame:
    """The 80 pairs of subsets that differ by one filter: before, after, filter, and how many orders pass through."""
    n = len(FILTERS)
    found = [
        (mask, mask | 1 << i, f, math.factorial(mask.bit_count()) * math.factorial(n - 1 - mask.bit_count()))
        for mask in range(ALL + 1)
        for i, f in enumerate(FILTERS)
        if not mask >> i & 1
    ]
    return spark.createDataFrame(found, "before int, after int, filter string, orders int")


def _steps(spark) -> DataFrame:
    """The 600 steps of all filter orders: filter_order, step, before, filter."""
    found = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            found.append(("".join(order), k, before, f))
            before |= 1 << FILTERS.index(f)
    return spark.createDataFrame(found, "filter_order string, step int, before int, filter string")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step, with what the step keeps, removes and loses."""
    spark = docs.sparkSession
    lattice = written(survivors(document_flags(docs, labels)), "filter_survivors")
    after = lattice.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    pairs = (
        lattice.join(F.broadcast(_edges(spark)), F.col("mask") == F.col("before"))
        .join(after, ["part", "after"])
        .select("part", "before", "after", "filter", "orders", F.col("docs_after").alias("kept"), *[(F.col(c) - F.col(f"{c}_after")).alias(c) for c in COUNTS])
    )
    by_filter = Window.partitionBy("part", "filter")
    pairs = pairs.select(
        "part",
        "before",
        "filter",
        "kept",
        F.col("docs").alias("removed"),
        (F.max(F.when(F.col("before") == 0, F.col("docs"))).over(by_filter) - F.col("docs")).alias("redundant"),
        F.max(F.when(F.col("after") == ALL, F.col("docs"))).over(by_filter).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum(F.col("docs") * F.col("orders")).over(by_filter).alias("shapley"),
    )
    return pairs.join(F.broadcast(_steps(spark)), ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
f AS (
  SELECT part,
         CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_PCT} * len(words) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITALS_PCT} * length(text) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
  FROM t),
g AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
s AS (
  SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS bit,
         list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, k)]) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
m AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(docs) FILTER (fails & (coalesce(before, 0) | bit)::BIGINT = 0), 0) AS kept,
         coalesce(sum(docs) FILTER (fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit <> 0), 0) AS removed,
         coalesce(sum(docs) FILTER (fails & coalesce(before, 0)::BIGINT <> 0 AND fails & bit <> 0), 0) AS redundant,
         coalesce(sum(docs) FILTER (fails = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit <> 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM m
"""
