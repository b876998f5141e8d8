"""Token counts by rank-synchronous array merging of byte-level BPE.

Texts are cut into pre-tokens; the distinct ones a task has not met before are held as one ragged
numpy array of symbols. In each round every sequence finds its lowest-ranked adjacent pair and merges
all its occurrences at once; a sequence without a mergeable pair is finished and what is left of it
is counted. A merged symbol's own pairs always rank later than the pair it came from, so merging
one rank at a time gives what merging pair by pair gives.

Counts of pre-tokens are remembered per task (at most REMEMBERED of them), so common words are merged
once.

Defined cases: a null text counts as empty and has no tokens; a special token's string inside a text
is that one token; texts are never cut; repeated rows repeat their counts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000
LIMIT = 1024
NEVER = np.int64(1 << 40)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs as a sorted array of packed pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        packed = (left << 32) | right
        order = np.argsort(packed, kind="stable")
        self.packed, self.rank, self.made = packed[order], order.astype(np.int64), made[order]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; NEVER where it does not merge."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.packed, want), len(self.packed) - 1)
        hit = self.packed[at] == want
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each byte sequence ends with."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        out = sizes.copy()
        symbol = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        while len(symbol) > 1:
            rank, made = self.find(symbol[:-1], symbol[1:])
            rank[owner[:-1] != owner[1:]] = NEVER
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(np.append(rank, NEVER), start)
            size = np.diff(np.append(start, len(symbol)))
            live = least < NEVER
            out[owner[start[~live]]] = size[~live]
            wanted = np.repeat(least, size)[:-1]
            hit = (rank == wanted) & (rank < NEVER)
            # of touching occurrences (a a a) every second one, from the left
            at = np.flatnonzero(hit)
            if not len(at):
                break
            fresh = np.append(True, np.diff(at) > 1)
            run_start = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run_start) % 2 == 0]
            symbol[at] = made[at]
            keep = np.repeat(live, size)
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        if len(symbol):
            left, n = np.unique(owner, return_counts=True)
            out[left] = n
        return out


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Counter:
    """Token counts of texts, with a memory of pre-tokens."""

    def __init__(self, path: str):
        self.table, self.known = merge_table(path), {}
        self.cut = regex.compile(PATTERN).findall
        marks = sorted(self.table.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, marks))).split if marks else (lambda t: [t])

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [[(len(parts := self.split(t))) - 1, [w for p in parts for w in self.cut(p)]] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*(w for _, w in cut)) - self.known.keys())
        if new:
            self.known.update(zip(new, self.table.count([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        know = self.known.__getitem__
        return [marks + sum(map(know, w)) for marks, w in cut]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); path: as executors see it."""

    def run(batches):
        counter = Counter(path or default_tokenizer())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens: list[int] = []
            i = 0
            while i < len(texts):  # about a million characters at a time
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1_000_000):
                    size += len(texts[j])
                    j += 1
                tokens += counter(texts[i:j])
                i = j
            n = pa.array(tokens, pa.int64())
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
