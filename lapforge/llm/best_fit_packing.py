"""Best-fit packing of whole documents into sequences under token, document-count and attention-cost limits.

A piece of L tokens asks for the vector (L, 1, L * L): its tokens, one document, and its attention cost. Pieces
of one length are equal vectors, so vector best-fit runs over lengths: bins that hold the same pieces form one class
with a count, lengths go from long to short, and a length's pieces go to the class whose residual vector fits best
(least weighted norm after placing, or largest weighted dot-product), under every limit; new bins are opened only when
no class fits. That gives the bins that placing piece after piece in the same order gives, from a histogram of at most
`tokens` counts, however many documents there are. Spark then places the pieces: each has a rank within its length
(counted by task, offsets by prefix sums over tasks), a class holds an interval of ranks, and the rest is arithmetic.

What the driver and the tasks share is bounded by the token limit alone: placing a length adds at most two classes and so
does opening bins, so there are at most 4 * tokens classes, each with at most sqrt(2 * tokens) different lengths.

Defined cases: a null or empty text is one piece, the end id alone; invalid UTF-8 is replaced; rows that repeat a
doc_id are documents of their own; a null doc_id stays null; documents longer than a bin's limits allow are cut into pieces
of the longest length that fits an empty bin; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.storage import written
from lapforge.llm.textkit import passes
from lapforge.llm.token_count import byte_symbols

TOKENS = 4096
END_ID = 1
#: Runs whose ids a Python worker remembers (about 200 bytes each), the longest such run in bytes, and runs that meet the library in one string.
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64
TOGETHER = 100
#: Bytes of text whose runs are looked up at a time.
PASS_BYTES = 8_000_000
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, block int, place bigint"


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weight of each in the choice of a bin. Without figures, documents and cost only follow from tokens."""

    tokens: int = TOKENS
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def capacity(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.cost or self.tokens**2

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that an empty bin takes."""
        return min(self.tokens, math.isqrt(self.capacity[2]))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each byte, kind of each byte after 0xC3)."""
    kind = np.full(256, WHOLE, np.uint8)
    kind[0x21:0x7F] = SYMBOL
    kind[list(b" \t\n\x0b\x0c\r")] = SPACE
    kind[list(b"0123456789")] = DIGIT
    kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
    kind[list(b"'<")] = WHOLE  # contractions and special tokens cross the kinds
    after = np.full(256, WHOLE, np.uint8)
    after[0x80:0xC0] = LETTER
    after[[0x97, 0xB7]] = WHOLE  # the signs of multiplication and division
    return kind, after


SPACE, LETTER, DIGIT, SYMBOL, WHOLE = range(5)
_KIND, _KIND_AFTER_C3 = _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Byte-level symbols, and the space that parts words.
_SYMBOLS = "".join(" " if i == 32 else s for i, s in enumerate(byte_symbols()))


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without spaces, offsets of the runs in them, starts of the runs in data).

    A word of ASCII and of letters up to U+00FF falls into runs of letters (in lower case), single digits and runs of
    symbols, as in the library; any other word (apostrophes, <, other characters, invalid UTF-8) is one run as it stands.
    """
    kind = _KIND[data]
    first = np.flatnonzero(data[:-1] == 0xC3)
    first = first[_KIND_AFTER_C3[data[first + 1]] == LETTER]
    kind[first] = kind[first + 1] = LETTER
    inside = kind != SPACE
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    hard = np.flatnonzero(kind == WHOLE)
    if len(hard):
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = np.unique(np.searchsorted(starts, hard, "right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[words]] = 1
        step[ends[words]] = -1
        kind[np.cumsum(step[:-1], dtype=np.int8).view(bool)] = WHOLE
    low = np.where(kind == LETTER, _LOWER[data], data)
    upper = first[(kind[first] == LETTER) & (data[first + 1] < 0x9F)] + 1
    low[upper] += 32
    begins = inside.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(begins)
    return low[inside], np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int64), at


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, run by run.

    This tokenizer drops white space and never joins symbols across it, nor across letters, digits and symbols, so a
    text's ids are those of its runs; each distinct run meets the library once. Runs of letters go to the library's
    model many in a string, in the byte-level symbols that it knows: every run ends with an end-of-word symbol, so if
    a string has as many ends as runs, the ends bound the runs. Other runs meet the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = _tokenizer(path)
        self.encode = tokenizer.encode_batch_fast
        model = Tokenizer(tokenizer.model)
        model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.merge = model.encode_batch_fast
        self.known: dict[bytes, bytes] = {}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True

    def _each(self, words: list[bytes]):
        found = self.encode([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return zip(words, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True)

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, chunks = {}, range(0, len(words), TOGETHER)
        joined = [codecs.charmap_decode(b" ".join(words[i : i + TOGETHER]), "strict", _SYMBOLS)[0] for i in chunks]
        for at, e in zip(chunks, self.merge(joined, add_special_tokens=False), strict=True):
            some, ids = words[at : at + TOGETHER], np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some):
                raw, bounds = ids.tobytes(), ((ends + 1) * 4).tolist()
                out.update(zip(some, [raw[i:j] for i, j in zip([0, *bounds], bounds, strict=False)], strict=True))
            else:
                out.update(self._each(some))
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        letters = [w for w in words if w.isalpha() or _LETTERS(w)]
        learnt = self._letters(letters)
        if len(learnt) < len(words):
            learnt.update(self._each([w for w in words if w not in learnt]))
        return learnt

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        raw, bounds, starts = runs(data)
        n = len(starts)
        if not n:
            return [b""] * len(texts)
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        which, (_, at, distinct) = coded.indices.to_numpy(), coded.dictionary.buffers()
        at, distinct = np.frombuffer(at, np.int64, len(coded.dictionary) + 1).tolist(), distinct.to_pybytes()
        words = [distinct[i:j] for i, j in zip(at, at[1:], strict=False)]  # to_pylist takes several times as long
        ids = list(map(self.known.get, words))
        fresh = self._learn([w for w, x in zip(words, ids, strict=True) if x is None])
        ids = [fresh[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        self.known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST_REMEMBERED)
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        size = sizes[which]
        upto = np.append(0, np.cumsum(size))
        found = flat[np.repeat(first[which] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))] * 4
        out = found.tobytes()
        return [out[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory of words per Python worker, which serves task after task."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, longest: int = TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task (block) that made it and its place among the task's pieces of that length."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        block, seen, ids_of = TaskContext.get().partitionId(), [0] * (longest + 1), word_ids(path or default_tokenizer())
        step = 4 * longest
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, texts)])
            found = (ids for i, j in passes(offsets, PASS_BYTES) for ids in ids_of(texts[i:j]))
            for doc_id, raw in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = memoryview(raw + end)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    length = len(part) // 4
                    rows.append((doc_id, k, at // 4, length, zlib.crc32(part), block, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Classes of equal bins: how many bins, and the pieces of one bin as (length, how many)."""

    bins: list[int] = field(default_factory=list)
    content: list[list[tuple[int, int]]] = field(default_factory=list)

    def total(self) -> int:
        return sum(self.bins)


class _Classes:
    """Open classes in arrays: residuals (class by limit), counts, contents."""

    def __init__(self, limits: Limits):
        self.full = np.array(limits.capacity, np.int64)
        self.weight = np.array(limits.weights, float) / self.full.astype(float) ** 2
        self.left = np.zeros((64, 3), np.int64)
        self.count = np.zeros(64, np.int64)
        self.content: list[list[tuple[int, int]]] = []

    def add(self, left: np.ndarray, count: int, content: list[tuple[int, int]]) -> None:
        n = len(self.content)
        if n == len(self.count):
            self.left, self.count = np.vstack([self.left, np.zeros_like(self.left)]), np.append(self.count, np.zeros_like(self.count))
        self.left[n], self.count[n] = left, count
        self.content.append(content)

    def best(self, item: np.ndarray, rule: str) -> int:
        """The class that takes the item best, the earliest of equals; -1 if none can."""
        n = len(self.content)
        left = self.left[:n]
        at = np.flatnonzero((self.count[:n] > 0) & (left >= item).all(1))
        if not len(at):
            return -1
        if rule == "norm":
            rest = (left[at] - item).astype(float)
            return int(at[np.argmin((rest * rest) @ self.weight)])
        return int(at[np.argmax((left[at] * item.astype(float)) @ self.weight)])

    def put(self, c: int, bins: int, item: np.ndarray, k: int) -> None:
        """Move `bins` bins of class c to a class that holds k more of the item."""
        old = self.content[c]
        length = int(item[0])
        grown = [*old[:-1], (length, old[-1][1] + k)] if old and old[-1][0] == length else [*old, (length, k)]
        if bins == self.count[c]:  # the whole class moves
            self.left[c] -= k * item
            self.content[c] = grown
        else:
            self.count[c] -= bins
            self.add(self.left[c] - k * item, bins, grown)


def plan_bins(histogram: dict[int, int], limits: Limits | None = None, rule: str = "norm") -> Plan:
    """Vector best-fit decreasing over a histogram {length: pieces}."""
    limits = limits or Limits()
    open_bins = _Classes(limits)
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        item, rest = np.array([length, 1, length * length], np.int64), histogram[length]
        if (item > open_bins.full).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while rest:
            c = open_bins.best(item, rule)
            if c < 0:  # the empty bin
                open_bins.add(open_bins.full, -(-rest // int((open_bins.full // item).min())), [])
                c = len(open_bins.content) - 1
                k = int((open_bins.full // item).min())
            else:
                # by norm a bin that was best stays best until it is full; by dot-product its like are better after one
                k = int((open_bins.left[c] // item).min()) if rule == "norm" else 1
            bins, over = min(int(open_bins.count[c]), rest // k), 0
            if bins < int(open_bins.count[c]) and rest - bins * k and k > 1:
                over = rest - bins * k  # one bin takes what is left of this length
            if bins:
                open_bins.put(c, bins, item, k)
            if over:
                open_bins.put(c, 1, item, over)
            rest -= bins * k + over
    live = [i for i in range(len(open_bins.content)) if open_bins.count[i] > 0]
    return Plan([int(open_bins.count[i]) for i in live], [open_bins.content[i] for i in live])


def best_plan(histogram: dict[int, int], limits: Limits | None = None) -> Plan:
    """The plan with the fewer bins of the two rules (of equals: residual norm)."""
    return min((plan_bins(histogram, limits, rule) for rule in ("norm", "dot")), key=Plan.total)


def rank_intervals(plan: Plan) -> dict[str, np.ndarray]:
    """For each (length, class): the first rank it takes, pieces a bin, first bin number, tokens before; sorted by (length, rank)."""
    next_rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, content in zip(plan.bins, plan.content, strict=True):
        before = 0
        for length, k in content:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, k, first_bin, before))
            next_rank[length] = rank + bins * k
            before += length * k
        first_bin += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i].copy() for i, name in enumerate(("length", "rank", "k", "bin", "before"))}


def place(lengths: np.ndarray, ranks: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    lo = np.searchsorted(table["length"], lengths, "left")
    hi = np.searchsorted(table["length"], lengths, "right")
    while (open_ := hi - lo > 1).any():  # the last interval of the length that begins at or before the rank
        mid = (lo + hi) // 2
        right = open_ & (table["rank"][np.minimum(mid, len(table["rank"]) - 1)] <= ranks)
        lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
    inside = ranks - table["rank"][lo]
    k = table["k"][lo]
    return table["bin"][lo] + inside // k, table["before"][lo] + inside % k * lengths


def pack(docs: DataFrame, limits: Limits | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every document."""
    limits = limits or Limits()
    made = written(pieces(docs, path, limits.longest, end_id), "packing_pieces")
    counts = made.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limits.longest rows
    table = rank_intervals(best_plan(histogram, limits))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = made.join(base, ["length", "block"]).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def assign(batches):
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = place(lengths, ranks, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
