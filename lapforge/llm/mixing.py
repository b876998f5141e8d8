"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are the source token shares raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. The exponent is bisected: the largest that still reaches the target entropy,
then no smaller than the one at which no source is read more than max_repeats times. The target is a share of
the entropy of equal weights, which natural shares may reach as they are; or, with close_gap, the natural
entropy and that part of what it lacks, which binds whenever the sources differ in size. The shares
stay in Spark: each step of the search is one aggregate over the table of sources.

A source's weight gives its token budget. Whole passes over the source come first; the rest is filled
from a permutation of its blocks, in the block where the budget ends from a permutation of its cells, and in the cell where it ends from a
permutation of its documents. Documents are dealt to blocks and cells by hash, about BLOCK_TOKENS each; at most MAX_BLOCKS blocks a source and cells a
block are put in order, so a cell stays that small up to 3 * 10^11 tokens a source and grows slowly beyond.

What is read of the last pass is all up to one key a source: (block, cell, document), each in its order. That key comes
from ids and counts alone; texts and other carried columns meet the table of sources and never go through a shuffle or a window of
this operator, unless there are too many sources for Spark to broadcast them.

The budget is met to within one document a source: the document that crosses it is the last one.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are read
once in each whole pass; a source without tokens gets weight 0 and is left out; rows that repeat both doc_id and text
are read together, as often as they stand there; a null doc_id is kept and dealt by its text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.storage import written

BLOCK_TOKENS = 20_000
MAX_BLOCKS = 4096
STEPS = 40
KEY = ("turn", "block", "cell_turn", "cell", "place", "tie")


@dataclass(frozen=True)
class Mixture:
    """What the weights are to meet. entropy_share: of the entropy of equal weights; close_gap, if given, in its place: of
    the difference between the natural entropy and that of equal weights (0: as it is, 1: equal weights)."""

    entropy_share: float = 0.97
    close_gap: float | None = None
    max_repeats: float = 4.0
    budget_share: float = 1.0  # of all tokens there are
    seed: int = 42


#: The registered mixture: half of the way from natural shares to equal ones, as entropy goes.
EVENER = Mixture(close_gap=0.5)


def n_tokens(text: Column) -> Column:
    """Tokens counted as runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).filter("tokens > 0")


def find_exponent(sources: DataFrame, mixture: Mixture) -> float:
    """Bisect the exponent over the table (source, tokens)."""
    known = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens")).first()
    if not known[0]:
        return 1.0
    total, n, least = float(known[0]), known[1], float(known[2])
    share = F.col("tokens") / F.lit(total)

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repeats) at each exponent, in one pass over the sources."""
        sums = []
        for a in exponents:
            sums += [F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))]
        got = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        out = []
        for k, a in enumerate(exponents):
            z, weighted = got[2 * k], got[2 * k + 1]
            entropy = math.log(z) - a * weighted / z
            repeats = mixture.budget_share * (least / total) ** (a - 1) / z
            out.append((entropy, repeats))
        return out

    def bisect(too_small) -> float:
        """The least exponent that is not too small (too_small holds below it and fails above)."""
        low, high = 0.0, 1.0
        for _ in range(STEPS // 5):  # five halvings a pass: the 31 points that they could visit
            grid = [low + (high - low) * i / 32 for i in range(1, 32)]
            found = measure(grid)
            step = next((i for i, m in enumerate(found) if not too_small(m)), 31)
            low, high = low + (high - low) * step / 32, low + (high - low) * (step + 1) / 32
        return high

    at_zero, at_one = measure([0.0, 1.0])
    goal = mixture.entropy_share * math.log(n)
    if mixture.close_gap is not None:
        goal = at_one[0] + mixture.close_gap * max(0.0, math.log(n) - at_one[0])
    # entropy falls as the exponent grows; natural shares are kept where they reach the goal
    exponent = 1.0 if at_one[0] >= goal else bisect(lambda m: m[0] > goal)
    flattest = 0.0 if at_zero[1] <= mixture.max_repeats else bisect(lambda m: m[1] > mixture.max_repeats)
    return max(exponent, flattest)


def source_budgets(sources: DataFrame, exponent: float, mixture: Mixture) -> DataFrame:
    """(source, n_blocks, n_cells, weight, whole, rest, budget): passes over the whole source, tokens beyond them."""
    size = F.greatest("tokens", "n_docs")
    known = sources.agg(F.sum("tokens"), F.sum(F.pow(F.col("tokens") / 1.0, F.lit(exponent)))).first()
    total, z = float(known[0] or 0), float(known[1] or 1)
    weight = F.pow(F.col("tokens") / 1.0, F.lit(exponent)) / F.lit(z)
    return (
        sources.withColumn("weight", weight)
        .withColumn("target", F.round(F.col("weight") * total * mixture.budget_share).cast("bigint"))
        .withColumn("whole", F.expr("target div tokens"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
        .withColumn("n_blocks", F.least(F.ceil(size / BLOCK_TOKENS), F.lit(MAX_BLOCKS)).cast("int"))
        .withColumn("n_cells", F.least(F.ceil(size / F.col("n_blocks") / BLOCK_TOKENS), F.lit(MAX_BLOCKS)).cast("int"))
        .select("source", "n_blocks", "n_cells", "weight", "whole", "rest", F.col("target").alias("budget"))
    )


def _placed(rows: DataFrame, budgets: DataFrame, seed: Column) -> DataFrame:
    """rows with their source's budget, block and cell, and where these and the document stand in the pass in which the budget ends."""
    dealt = rows.alias("d").join(budgets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", *(f"s.{c}" for c in budgets.columns if c != "source"))
    dealt = dealt.withColumns(
        {
            "block": F.pmod(F.xxhash64(seed, "id"), F.col("n_blocks")).cast("int"),
            "cell": F.pmod(F.xxhash64(seed, F.lit("cell"), "id"), F.col("n_cells")).cast("int"),
        }
    )
    return dealt.withColumns(
        {
            "turn": F.xxhash64(seed, "source", "whole", "block"),
            "cell_turn": F.xxhash64(seed, "source", "whole", "block", "cell"),
            "place": F.xxhash64(seed, "source", "whole", "id"),
        }
    )


def _fill(parts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(source, end): the last of parts (source, room, all, size and the columns order) that is read, with what of room is left for it; all: read every part."""
    before = F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = parts.withColumn("room", F.col("room") - F.coalesce(before, F.lit(0))).filter(F.col("all") | (F.col("room") > 0))
    end = F.struct(*order, "room", (F.col("all") | (F.col("size") <= F.col("room"))).alias("all"))
    return left.groupBy("source").agg(F.max(end).alias("end"))


def _inside(slim: DataFrame, ends: DataFrame, part: str) -> DataFrame:
    """The rows of the part in which each source's budget ends, with the room left there."""
    at = slim["source"].eqNullSafe(ends["source"]) & (slim[part] == ends[f"end.{part}"])
    return slim.join(ends, at).select(slim["*"], ends["end.room"].alias("room"), ends["end.all"].alias("all"))


def last_keys(slim: DataFrame) -> DataFrame:
    """(source, last): the key of the last document that the budget of each source reaches in the pass in which it ends."""
    some = slim.filter("rest > 0")
    size = F.sum("tokens").alias("size")
    blocks = some.groupBy("source", "turn", "block", F.col("rest").alias("room"), F.lit(False).alias("all")).agg(size)
    in_block = _inside(some, _fill(blocks, ("turn", "block")), "block")
    cells = in_block.groupBy("source", "room", "all", "cell_turn", "cell").agg(size)
    in_cell = _inside(in_block.drop("room", "all"), _fill(cells, ("cell_turn", "cell")), "cell")
    documents = in_cell.groupBy("source", "room", "all", "turn", "block", "cell_turn", "cell", "place", "tie").agg(size)
    # one block and one cell a source are left, so the whole key orders as (place, tie) does
    return _fill(documents, KEY).select("source", F.struct(*(F.col(f"end.{c}").alias(c) for c in KEY)).alias("last"))


def mix_sources(docs: DataFrame, mixture: Mixture = Mixture(), carry: tuple[str, ...] = (), explain: bool = False) -> DataFrame:
    """One row per reading of a document: doc_id, source, n_tokens, epoch, block, cell, place, and the columns carry.

    Within an epoch of a source documents are read by block, cell and place. explain adds exponent, and the source's weight and
    budget in tokens.
    """
    seed = F.lit(mixture.seed)
    doc_id = F.col("doc_id").cast("bigint")
    tie = F.xxhash64("text")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_tokens(F.col("text")).alias("tokens"),
        F.coalesce(doc_id, tie).alias("id"),
        tie.alias("tie"),
        (F.struct(*carry) if carry else F.lit(True)).alias("carried"),
    )
    slim = written(rows.drop("doc_id", "carried"), "mix-documents")
    sources = written(_sources(slim), "mix-sources")  # one row a source
    exponent = find_exponent(sources, mixture)
    budgets = source_budgets(sources, exponent, mixture)
    last = last_keys(_placed(slim, budgets, seed))
    plan = budgets.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    placed = _placed(rows, written(plan, "mix-plan"), seed)
    reached = F.coalesce(F.struct(*KEY) <= F.col("last"), F.lit(False))
    epochs = F.col("whole") + reached.cast("bigint")
    read = placed.withColumn("epochs", epochs).filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    return read.select(
        "doc_id",
        "source",
        F.col("tokens").alias("n_tokens"),
        "epoch",
        F.xxhash64(seed, "source", "epoch", "block").alias("block"),
        F.xxhash64(seed, "source", "epoch", "block", "cell").alias("cell"),
        F.xxhash64(seed, "source", "epoch", "id").alias("place"),
        *(F.col(f"carried.`{c}`").alias(c) for c in carry),
        *([F.lit(exponent).alias("exponent"), "weight", "budget"] if explain else []),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), EVENER, explain=True)


ORACLE = None
