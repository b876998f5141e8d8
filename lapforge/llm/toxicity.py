"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts to Latin and reads
digits and signs inside words as the letters they stand for ("1d10t"). The lexicon holds whole
words and word beginnings, learned from labelled rows: what turns up in toxic texts far more often than
in others, weighted by its log odds; a beginning may also show by how many different words of toxic texts have it. Phrases around a term that only turn up in texts that are not toxic
are exceptions and take its match back. A text's matches, summed and relative to its length, go through
a logistic curve fitted on the same rows.

Learning uses at most about `bound` labelled rows, picked by a hash of doc_id; texts that share their
least shingles in four orders count once, so a crowd of near copies cannot make its words terms. Scoring is one map over
the table.

Defined cases: null and empty texts are scored as texts without matches; repeated rows repeat their
score; without labelled rows of both kinds every score is the share of toxic ones (0 if none are
known); several labels of one doc_id count as their largest; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm.textkit import mix, passes, sequence_hash, shingles, utf8, words

BOUND = 20_000
LEXICON_SIZE = 4000
THRESHOLD = 0.3
LEAST_Z, LEAST_SHARE = 4.0, 0.5
#: Toxic texts that a word beginning must stand in to be judged by its different words.
LEAST_TEXTS = 3
STEMS = range(4, 10)
#: Texts are near copies here when they share the least shingle under each of these orders; one common line is not enough.
MINIMA = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 5)]
#: Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(zip("асеорхуіјѕԁһкмтвнαεικνορτυχ", "aceopxyijsdhkmtbhaeiknoptux", strict=True))
#: Signs that stand for a letter when one follows.
LEET = dict(zip("013457@$", "oieastas", strict=True))
_LOOK = str.maketrans(LOOKALIKES)
_LEET = str.maketrans(LEET)
_sign = re.compile(r"[013457@$]+(?=[^\W\d_])")
_marks = re.compile(r"[̀-ͯ]+")
_gap = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The folded words of a text, two spaces around each."""
    t = text.lower()
    if not t.isascii():
        t = _marks.sub("", unicodedata.normalize("NFKD", t.translate(_LOOK)))
    t = _sign.sub(lambda m: m.group().translate(_LEET), t)
    return f"  {_gap.sub('  ', t)}  "


def terms_of(folded: str) -> dict[str, int]:
    """Candidate terms, whole words (" word ") and word beginnings (" wor"), each with the number of different words of the
    text that have it; under "" the number of all different words."""
    words_here = set(folded.split())
    out = Counter(f" {w[:k]}" for w in words_here for k in STEMS if k < len(w))
    out.update(f" {w} " for w in words_here if 3 <= len(w) <= 24)
    out[""] = len(words_here)
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: np.ndarray | None = None
    base: float = 0.0

    def matcher(self):
        if not self.lexicon:
            return None
        automaton = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            automaton.add_word(term, (len(term), weight))
        automaton.make_automaton()
        return automaton

    def matches(self, automaton, folded: str):
        """(weight, phrases around) of each match, the longest term at each place."""
        if automaton is None:
            return
        for end, (size, weight) in automaton.iter_long(folded):
            start = end - size + 1
            yield weight, phrases(folded, start, end)

    def features(self, automaton, folded: str) -> list[float]:
        total, most, n = 0.0, 0.0, 0
        for weight, around in self.matches(automaton, folded):
            if self.exceptions and not self.exceptions.isdisjoint(around):
                continue
            total, most, n = total + weight, max(most, weight), n + 1
        length = folded.count("  ")
        return [1.0, math.log1p(max(total, 0.0)), most, 100.0 * n / (length + 20), total / math.sqrt(length + 20)]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.curve is None or not rows:
            return np.full(len(rows), self.base)
        return 1.0 / (1.0 + np.exp(-np.clip(np.array(rows) @ self.curve, -35, 35)))


def phrases(folded: str, start: int, end: int) -> tuple[str, str]:
    """The matched word with the word before it, and with the word after it."""
    close = folded.find(" ", start + 1)
    word = folded[start:close].strip() if close > 0 else folded[start:].strip()
    left = folded[max(0, start - 40) : start].split()
    right = folded[max(end, close) : max(end, close) + 40].split()
    return f"{left[-1] if left else ''} {word}", f"{word} {right[0] if right else ''}"


def _counted(rows: DataFrame, of_text) -> DataFrame:
    """(term, p, n, pw, nw): in how many toxic and other texts of rows (text, toxic) each key of of_text(text) is, and the sums of its numbers there.

    of_text is made by a function without arguments, once a task."""

    def run(batches):
        terms, texts, sums = of_text(), (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                texts[bool(toxic)].update(found.keys())
                sums[bool(toxic)].update(found)
        every = list(texts[0].keys() | texts[1].keys())
        counts = [pa.array([seen[k][t] for t in every], pa.int64()) for seen in (texts, sums) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *counts], ["term", "p", "n", "pw", "nw"])

    counts = rows.select("text", "toxic").mapInArrow(run, "term string, p bigint, n bigint, pw bigint, nw bigint")
    return counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("p", "n", "pw", "nw")])


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, text, toxic): about bound labelled rows at most, near copies once."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, bound / max(n, 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    met = rows.join(F.broadcast(picked), F.col("__id") == F.col("doc_id")).select("doc_id", "text", "toxic")  # about bound rows

    def least(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for i, j in passes(offsets):
                hashed, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                runs = shingles(hashed, 5)
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    part = runs[s : e - 4] if e - s >= 5 else hashed[s:e]
                    least_of = [mix(part ^ key).min() for key in MINIMA] if len(part) else [np.uint64(0)]
                    out.append(int(sequence_hash(np.array(least_of, np.uint64)) & ((1 << 63) - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "least"])

    marked = met.mapInArrow(least, "doc_id bigint, text string, toxic int, least bigint")
    first = Window.partitionBy("least", "toxic").orderBy("doc_id")
    return marked.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> ToxicityModel:
    rows = training_rows(docs, labels, bound).persist()  # about bound rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    model = ToxicityModel(base=pos / max(1, pos + neg))
    if not pos or not neg:
        return model

    counts = _counted(rows.repartition(16), lambda: lambda text: terms_of(fold(text))).persist()
    total = counts.filter("term = ''").agg(F.sum("pw").alias("pw"), F.sum("nw").alias("nw")).first()

    def excess(p: str, n: str, share: float) -> Column:
        expected = (F.col(p) + F.col(n)) * share
        return (F.col(p) - expected) / F.sqrt(expected * (1 - share) + 1)

    # a beginning that few toxic texts have, but in many different words, is known by those words
    by_text = excess("p", "n", pos / (pos + neg))
    by_word = F.when(~F.col("term").endswith(" ") & (F.col("p") >= LEAST_TEXTS), excess("pw", "nw", (total["pw"] or 0) / max(1, (total["pw"] or 0) + (total["nw"] or 0))))
    z = F.when(by_text >= LEAST_Z, by_text).otherwise(by_word)
    odds = (F.col("p") + 0.5) * (neg + 1.0) / ((F.col("n") + 0.5) * (pos + 1.0))
    strong = counts.filter("term <> ''").withColumns({"z": z, "odds": odds}).filter((F.col("z") >= LEAST_Z) & (F.col("p") >= LEAST_SHARE * (F.col("p") + F.col("n"))))
    top = strong.orderBy(F.desc("z"), "term").limit(LEXICON_SIZE).collect()
    counts.unpersist()
    model.lexicon = {r["term"]: math.log(r["odds"]) for r in top}
    plain = model

    def phrases_of():
        automaton = plain.matcher()
        return lambda text: dict.fromkeys((p for _, around in plain.matches(automaton, fold(text)) for p in around), 1)

    around = _counted(rows, phrases_of).filter("n >= 3 and p = 0").orderBy(F.desc("n"), "term").limit(LEXICON_SIZE)
    model.exceptions = {r["term"] for r in around.collect()}

    def featured(batches):
        automaton = plain.matcher()
        for batch in batches:
            x = [plain.features(automaton, fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(featured, "x array<double>, toxic int").collect()  # about bound rows of five numbers
    model.curve = logistic(np.array([r["x"] for r in table]), np.array([float(bool(r["toxic"])) for r in table]))
    rows.unpersist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant.

    Columns are brought to one spread first, so that the penalty does not favour those with large numbers.
    """
    spread = x.std(axis=0)
    spread[spread == 0] = 1.0
    x = x / spread
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta / spread


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted: one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON_SIZE terms and phrases

    def run(batches):
        m = shared.value
        automaton = m.matcher()
        for batch in batches:
            x = [m.features(automaton, fold(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ORACLE = None
