"""Benchmark decontamination by spaced-seed hashing.

Texts become words (lower case, letters and digits). Each of MASKS is laid at every word and hashes
only the words under its ones, so a substitution under a zero leaves the seed intact. Seeds of
documents and of benchmark items are joined on their hash; around each hit the two word sequences
are aligned without gaps and the best stretch is scored, +1 for an equal word and -3 for another, so more
than three quarters of its words are equal. A document is contaminated by an item if that stretch has at
least least_match equal words. Every such pattern of 8 to 16 words holds at least one mask, so it
is proposed even if nothing around it is equal. An item of fewer than 8 words counts when all its words
stand in the document in a row: its one seed is the whole item, laid in its own length. An item of fewer
than LEAST_WORDS words ("yes", "the") says nothing about where a text comes from: by default it makes no document
contaminated, drop_contaminated never looks for it, and the query counts it in a column of its own.

Before the join, document seeds are tested against a bit table of the benchmark's seeds; its size is
fixed, so it can be broadcast however large the benchmark is: a fuller table only lets
more seeds through to the join. Seeds that pass carry no text; the words around them go out once per
stretch of hits. Both joins that a seed or an item in very many documents makes uneven are followed by a shuffle
on other keys, so Spark may split their large partitions (adaptive skew join).

Defined cases: null and empty texts and items have no seeds; a text shorter than an item's masks cannot
match it; rows that repeat a doc_id share one decision; a null doc_id is reported as its own row;
empty tables give an empty result, or clean documents; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm import bitfilter
from lapforge.llm.textkit import U64, mix, passes, utf8, words

MASKS = ("11011011", "1101100111", "1110010111", "10110101011", "111101111")
SHORTEST = min(map(len, MASKS))
LEAST_MATCH = 8
LEAST_WORDS = 5  # an item needs so many words to make a document contaminated
IDENTITY_PENALTY = 3  # a stretch with positive score everywhere has three quarters of its words equal
MARGIN = 64
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _seeds(hashed: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every word of one sequence where the mask fits."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, int(mask, 2), U64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out *= U64(0xD1342543DE82EF95)
                out += hashed[k : k + n]
                out ^= out >> U64(29)
    return mix(out)


def _word_rows(column: pa.Array):
    """For each pass of a column: (first row, word hashes, word offsets of its rows)."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    for i, j in passes(offsets):
        hashed, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _OUTSIDE, lower=False)
        yield i, hashed, at


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words array<bigint>)."""

    def run(batches):
        for batch in batches:
            rows = [h[s:e].view(np.int64) for _, h, at in _word_rows(batch.column(1)) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "item_words"])

    return benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, item_words array<bigint>")


def masks_for(items: DataFrame) -> tuple[str, ...]:
    """MASKS, and a mask of ones for each length of item that none of them fits: 7 more at most."""
    short = items.select(F.size("item_words").alias("n")).filter(F.col("n").between(1, SHORTEST - 1)).distinct()
    return (*MASKS, *("1" * r["n"] for r in short.collect()))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_at) of the table benchmark_words gives."""

    def run(batches):
        for batch in batches:
            seed, item, at = [], [], []
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashed = np.array(row or [], np.int64).view(U64)
                for mask in MASKS if len(hashed) >= SHORTEST else ["1" * len(hashed)]:
                    s = _seeds(hashed, mask) if mask else np.zeros(0, U64)
                    seed.append(s.view(np.int64))
                    item += [k] * len(s)
                    at.append(np.arange(len(s), dtype=np.int32))
            if seed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(seed)), pa.array(item, pa.int64()), pa.array(np.concatenate(at))], ["seed", "item_id", "item_at"]
                )

    return items.mapInArrow(run, "seed bigint, item_id bigint, item_at int")


def document_hits(docs: DataFrame, bits: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, stretch, from_word, words, hits): stretches of text around seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # bitfilter.BITS bits
    widest = max(map(len, MASKS))

    def run(batches):
        table = shared.value
        for batch in batches:
            ids = batch.column(0)
            out = []
            for first, hashed, at in _word_rows(batch.column(1)):
                found = [(s := _seeds(hashed, mask), np.flatnonzero(bitfilter.may_hold(table, s)), len(mask)) for mask in masks]
                place = np.concatenate([p for _, p, _ in found])
                seed = np.concatenate([s[p] for s, p, _ in found])
                size = np.concatenate([np.full(len(p), n) for _, p, n in found])
                row = np.searchsorted(at, place, "right") - 1
                keep = place + size <= at[row + 1]
                order = np.argsort(place[keep], kind="stable")
                place, seed, row = place[keep][order], seed[keep][order], row[keep][order]
                if not len(place):
                    continue
                cut = np.flatnonzero((np.diff(place) > MARGIN) | (np.diff(row) > 0)) + 1
                for a, b in zip([0, *cut], [*cut, len(place)], strict=True):
                    r = int(row[a])
                    start = max(int(at[r]), int(place[a]) - MARGIN)
                    stop = min(int(at[r + 1]), int(place[b - 1]) + widest + MARGIN)
                    hits = [{"seed": s, "at": p} for s, p in zip(seed[a:b].view(np.int64).tolist(), (place[a:b] - start).tolist(), strict=True)]
                    out.append((first + r, start - int(at[r]), hashed[start:stop].view(np.int64), hits))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([o[0] for o in out], pa.int64())),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.list_(pa.int64())),
                    pa.array([o[3] for o in out], pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))),
                ],
                ["doc_id", "from_word", "words", "hits"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, from_word int, words array<bigint>, hits array<struct<seed:bigint,at:int>>")


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, start, stop) of the stretch with the best score."""
    score = np.where(equal, 1, -IDENTITY_PENALTY)
    total = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    stop = int(np.argmax(total - low))
    start = int(np.argmin(total[: stop + 1]))
    return int(equal[start:stop].sum()), start, stop


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_match: int = LEAST_MATCH, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, n_item_words, from_word, n_equal, n_words): the best verified stretch of each document and item.

    Items of fewer than least_words words are not looked for.
    """
    items = benchmark_words(benchmark).filter(F.size("item_words") >= least_words)
    seeds = benchmark_seeds(items)
    hits = document_hits(docs, bitfilter.build(seeds.select("seed")), masks_for(items)).withColumn("stretch", F.xxhash64("doc_id", "from_word", "words"))
    near = (
        hits.select("doc_id", "from_word", "stretch", F.explode("hits").alias("h"))
        .join(seeds, F.col("h.seed") == F.col("seed"))
        .select("doc_id", "from_word", "stretch", "item_id", (F.col("h.at") - F.col("item_at")).alias("shift"))
        .groupBy("doc_id", "from_word", "stretch", "item_id")
        .agg(F.collect_set("shift").alias("shifts"))  # at most the words of a stretch and an item
    )
    sides = hits.select("doc_id", "from_word", "stretch", "words").dropDuplicates(["doc_id", "from_word", "stretch"])
    same = near["doc_id"].eqNullSafe(sides["doc_id"]) & (near["from_word"] == sides["from_word"]) & (near["stretch"] == sides["stretch"])
    full = near.join(sides, same).select(near["doc_id"], near["from_word"], near["item_id"], "shifts", "words").join(items, "item_id")

    def check(batches):
        for batch in batches:
            out = []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 6)), batch.column(1).to_pylist(), strict=True)):
                shifts, text, item, base = row
                text, item = np.array(text, np.int64), np.array(item, np.int64)
                best = (0, 0, 0)
                for shift in shifts:
                    a, b = max(0, shift), min(len(text), shift + len(item))
                    n, s, e = best_stretch(text[a:b] == item[a - shift : b - shift])
                    best = max(best, (n, -(a + s), e - s))
                if best[0] >= min(least_match, len(item)):
                    out.append((k, base - best[1], best[0], best[2], len(item)))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3, 4))],
                ["doc_id", "item_id", "from_word", "n_equal", "n_words", "n_item_words"],
            )

    found = full.select("doc_id", "from_word", "item_id", "shifts", "words", "item_words").mapInArrow(
        check, "doc_id bigint, item_id bigint, from_word bigint, n_equal bigint, n_words bigint, n_item_words bigint"
    )
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("short"), (-F.col("from_word")).alias("early"))).alias("b")
    return found.groupBy("doc_id", "item_id", "n_item_words").agg(best).select(
        "doc_id", "item_id", "n_item_words", (-F.col("b.early")).alias("from_word"), F.col("b.n_equal").alias("n_equal"), (-F.col("b.short")).alias("n_words")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the documents that overlap an item of at least least_words words. A null doc_id cannot be told apart and stays."""
    gone = find_overlaps(docs, benchmark, least_words=least_words).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__id"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    long_enough = F.col("n_item_words") >= LEAST_WORDS
    best = F.max_by(F.struct("item_id", "n_equal", "n_words"), F.when(long_enough, F.struct("n_equal", (-F.col("item_id")).alias("first"))))
    by_doc = found.groupBy(F.col("doc_id").alias("__id")).agg(
        F.count_if(long_enough).alias("n_items"), F.count_if(~long_enough).alias("n_short_items"), best.alias("b")
    )
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return every.join(by_doc, every["doc_id"].eqNullSafe(by_doc["__id"]), "left").select(
        "doc_id",
        F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("n_short_items", F.lit(0)).cast("bigint").alias("n_short_items"),
        F.col("b.item_id").alias("item_id"),
        F.col("b.n_equal").alias("n_equal"),
        F.col("b.n_words").alias("n_words"),
    )


ORACLE = None
