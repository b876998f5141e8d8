"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts, per language, how often each hashed n-gram (orders 1 to 3) occurs; the counts are
summed in Spark and only languages x CELLS numbers reach the driver. The log-probability matrix is
broadcast, and each task scores its texts in batches with numpy: hash, gather, add up per text.

Letters are lower-cased, every other character becomes a space, so digits, punctuation and markup
carry no evidence.

Defined cases: null texts, empty texts and texts without a letter are predicted "und" with score 0;
ties go to the language that sorts first; repeated rows repeat their prediction; an empty table
gives an empty result; with no labelled rows every text is "und"; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.llm.textkit import passes, utf8

ORDERS = (1, 2, 3)
CELLS = 1 << 16
UNKNOWN = "und"
#: Below this posterior the pipeline takes a document's language as unknown.
LEAST_SCORE = 0.5
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For one pass: (cells, start of each text) per order, and how many letters each text has.

    A text is its letters with a space before and after; n-grams never cross texts, and those that
    would are given the cell CELLS.
    """
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    letter = _letter_table()[points]
    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    n_letters = total[at[1:]] - total[at[:-1]]
    n = len(at) - 1
    line = np.full(len(points) + n + 1, 32, np.uint32)
    place = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(at))
    line[place] = np.where(letter, points, 32)
    starts = at[:-1] + np.arange(n)  # the space before each text
    stop = at[1:] + np.arange(1, n + 1)  # the space after it
    until = np.repeat(stop, np.diff(np.append(starts, stop[-1])))
    out = []
    hashed = np.full(len(line) - 1, 0x811C9DC5, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            char = line[k : k + len(hashed)] if k + len(hashed) <= len(line) else np.append(line[k:], np.full(k + len(hashed) - len(line), 32, np.uint32))
            hashed = (hashed ^ char) * np.uint32(0x01000193)
            hashed ^= hashed >> np.uint32(15)
            if k + 1 in ORDERS:
                cells = ((hashed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
                cells[np.arange(len(hashed)) + k > until] = CELLS
                if k == 0:
                    cells[line[:-1] == 32] = CELLS
                out.append(cells)
    return out, starts, n_letters


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


@dataclass
class LanguageModel:
    """languages in order; weights: (languages, CELLS + 1) log-probabilities; prior per language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows (text, lang); rows without a language or text add nothing."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = utf8(_lowered(batch.column(0)))
            for i, j in passes(offsets):
                orders, starts, _ = _grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = len(orders[0])
                here, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                owner = np.repeat(code, np.diff(np.append(starts, size)))
                for k, lang in enumerate(here):
                    mine = owner == k
                    kept = total.setdefault(lang, np.zeros(CELLS + 1, np.int64))
                    for cells in orders:
                        kept += np.bincount(cells[mine], minlength=CELLS + 1)
        for lang, n in total.items():
            full = np.flatnonzero(n[:CELLS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(n[full])], ["lang", "cell", "n"]
            )

    rows = labelled.select("text", "lang").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(shares)
    number = {lang: k for k, lang in enumerate(languages)}
    table = counts.toArrow()  # languages x CELLS at most
    full = np.zeros((len(languages), CELLS))
    if table.num_rows:
        lang = np.array([number[x] for x in table.column("lang").to_pylist()])
        full[lang, table.column("cell").to_numpy()] = table.column("n").to_numpy()
    weights = np.zeros((len(languages), CELLS + 1), np.float32)
    if languages:
        smooth = full + smoothing
        weights[:, :CELLS] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values())))
    return LanguageModel(languages, weights, prior)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with lang_pred and score, the posterior of the predicted language."""
    found = _identified(docs, model, keep)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"))


def _identified(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...]) -> DataFrame:
    """k0, k1, ...: the columns keep, then __pred and __score: names that no column of docs can clash with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CELLS numbers
    kept = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    rows = kept.drop("__text").withColumnRenamed(f"k{keep.index('text')}", "__text") if "text" in keep else kept
    at_text = rows.columns.index("__text")

    def scored(m, data, offsets):
        """(languages, posteriors) of the texts of one pass."""
        n = len(offsets) - 1
        if not len(data) or not m.languages:
            return [UNKNOWN] * n, np.zeros(n)
        orders, starts, n_letters = _grams(data, offsets)
        sums = np.tile(m.prior, (n, 1))
        for k in range(len(m.languages)):
            row = m.weights[k]
            for cells in orders:
                sums[:, k] += np.add.reduceat(row[cells], starts, dtype=np.float64)
        top = sums.argmax(axis=1)
        sure = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        known = n_letters > 0
        names = [m.languages[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, sure, 0.0)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = utf8(_lowered(batch.column(at_text)))
            for i, j in passes(offsets):
                names, score = scored(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score)], [*[f"k{i}" for i in range(len(keep))], "__pred", "__score"]
                )

    return rows.mapInArrow(run, f"{ddl}, __pred string, __score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows whose language stays unknown: no letter, or no language likelier than least."""
    model = fit(docs)
    found = _identified(docs, model, tuple(docs.columns)).filter((F.col("__pred") != UNKNOWN) & (F.col("__score") >= least))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


ORACLE = None
