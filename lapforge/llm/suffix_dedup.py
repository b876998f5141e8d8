"""Repeated substrings by a depth-limited radix sort of suffixes, most significant digit first.

Two places hold the same string of DEPTH bytes exactly if their suffixes fall into one group when
suffixes are ordered through DEPTH bytes and no further. The order inside a group is of no use here, so
each pass only refines groups: by the fingerprint of the next digit of the suffix. A suffix that is
alone in its group is finished and leaves; what shares a group at full depth is a repeated window.

Passing every suffix through the shuffle would cost many times the text. Neighbouring windows are
therefore led through the first passes by one suffix, their anchor: the place with the least
hash of K bytes among the first SPREAD places of the window. It depends on the window's bytes
alone, so equal windows have equal anchors at equal distance, and one anchor leads a range of
adjacent windows.

Pass 1, digit = the bytes behind the anchor that all windows of any anchor have in common (CORE of
them): unique ones leave with all their windows.
Pass 2, digit = everything that the anchor's windows cover: if two are equal, all windows are repeated.
Anchors that share the first digit with another but not the second are settled in
pass 3, digit = the whole window: one context of each class is compared window by window with those of
its group.
A last step merges the repeated windows of each text into spans and cuts them out.

Groups of copies end in pass 2 as counts. A group that is large for another reason (a passage that very
many texts share) is known from a table of fixed size that counts first digits over all texts: its
rows go through aggregations that combine before the shuffle and joins that split, and in place of
pass 3 through two more digits, so no task holds such a group: the windows of an anchor are cut into
BLOCKS blocks by their distance from it. What all windows of a block have in common is one digit: alone,
they leave. What they cover together is the other: met again, they are all repeated. Only blocks
between the two send their windows one by one.

The same passes run over two kinds of tokens: bytes with a depth of 400, which decide what is removed,
and words with a depth of 50, which only count the words of passages that stand elsewhere too, be they
shorter than 400 bytes.

Fingerprints of classes and windows have 128 bits. A row is known by its doc_id and a hash of its text
(a null doc_id: by two hashes).

Defined cases: a null text counts as empty; texts shorter than a depth have no windows of it; windows
never cross texts; a window repeated inside one text counts; rows that repeat a doc_id are texts of
their own, and equal rows are repeats of each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm import bitfilter, celltable
from lapforge.llm.storage import written
from lapforge.llm.textkit import _P, _P_INVERSE, U64, _powers, passes, utf8, words

BLOCKS = 8
CELLS = 1 << 18
LARGE_GROUP = 2000
SALTS = 64


@dataclass(frozen=True)
class Tokens:
    """A kind of tokens: depth of the sort, places that share an anchor at most, tokens hashed to pick it, bytes of a token."""

    kind: int
    depth: int
    spread: int
    gram: int
    width: int

    @property
    def core(self) -> int:
        return self.depth - self.spread + 1


BYTES, WORDS = KINDS = Tokens(0, 400, 128, 16, 1), Tokens(1, 50, 32, 3, 8)


def window_anchors(data: np.ndarray, offsets: np.ndarray, t: Tokens = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every anchor of one pass, as places in data."""
    n, depth, spread = len(data), t.depth, t.spread
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none
    total = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * _powers(n, _P, 1), out=total[1:])
        gram = (total[t.gram :] - total[: -t.gram]) * _powers(n - t.gram + 1, _P_INVERSE, 2)
        gram = (gram ^ (gram >> U64(31))) * U64(0x9E3779B97F4A7C15)
    # hash above, place below: the least is the leftmost of the least hashes
    gram = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    fill = np.full(-len(gram) % spread + spread, U64(0xFFFFFFFFFFFFFFFF))
    block = np.concatenate([gram, fill]).reshape(-1, spread)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - depth + 1
    least = np.minimum(behind[:count], ahead[spread - 1 : spread - 1 + count])
    stop = np.repeat(offsets[1:], np.diff(offsets))[:count]
    place = np.flatnonzero(np.arange(count) + depth <= stop)
    if not len(place):
        return none, none, none
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)[place]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(place) != 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(place)]]) - 1
    return anchor[first], place[first], place[last]


def _cores(raw: bytes, anchors: np.ndarray, t: Tokens) -> np.ndarray:
    digest, w, size = xxhash.xxh3_64_intdigest, t.width, t.core * t.width
    return np.fromiter((digest(raw[a * w : a * w + size], t.kind) for a in anchors.tolist()), U64, len(anchors))


def _digests(parts) -> np.ndarray:
    """128-bit fingerprints as (n, 2) int64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


def _cell(cores: np.ndarray) -> np.ndarray:
    return (cores & U64(CELLS - 1)).astype(np.int64)


def _token_passes(column: pa.Array):
    """For each pass and kind of a text column: (kind, first row, offsets, tokens)."""
    data, offsets = utf8(column)
    for i, j in passes(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield BYTES, i, at, part
        hashed, by_word = words(part, at, lower=False)
        yield WORDS, i, by_word, hashed


def _anchor_passes(column: pa.Array):
    """For each pass and kind: (kind, first row, offsets, bytes of the tokens, anchors, first and last windows)."""
    for t, i, at, tokens in _token_passes(column):
        yield t, i, at, tokens.tobytes(), *window_anchors(tokens, at, t)


def large_groups(texts: DataFrame) -> np.ndarray:
    """Which cells of first digits may hold a large group: CELLS flags, counted over all texts."""

    def cells(batch):
        for t, _, _, raw, anchors, _, _ in _anchor_passes(batch.column(0)):
            yield _cell(_cores(raw, anchors, t))

    out = celltable.counted(texts.select("text"), cells, CELLS)
    return out > out.mean() + max(LARGE_GROUP, 8 * out.mean() ** 0.5)


# A place: first window << 16 | kind << 15 | (anchor - first window) << 8 | (last window - first window)
_ROW = "doc bigint, key bigint"


def _kind(spot):
    return F.shiftright(spot, 15).bitwiseAND(F.lit(1))


def _range(start, width, kind):
    """(doc, key, kind, start, stop) of windows from start to start + width, as columns."""
    return ["doc", "key", kind.alias("kind"), start.alias("start"), (start + width + F.when(kind == 0, BYTES.depth).otherwise(WORDS.depth)).alias("stop")]


def anchor_table(texts: DataFrame, large: np.ndarray) -> DataFrame:
    """(core, salt, f1, f2, doc, key, spot) of every anchor of texts (doc, key, text); salt > 0 in large groups."""
    shared = texts.sparkSession.sparkContext.broadcast(large)  # CELLS flags

    def run(batches):
        for batch in batches:
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for t, row, at, raw, anchors, first, last in _anchor_passes(batch.column(2)):
                if not len(anchors):
                    continue
                core, w = _cores(raw, anchors, t), t.width
                ranges = zip(first.tolist(), last.tolist(), anchors.tolist(), strict=True)
                whole = _digests(bytes((a - f, e - f)) + raw[f * w : (e + t.depth) * w] for f, e, a in ranges)
                owner = np.searchsorted(at, first, "right") - 1
                doc, key = docs[row + owner], keys[row + owner]
                spot = ((first - at[owner]) << 16) | (t.kind << 15) | ((anchors - first) << 8) | (last - first)
                salt = np.where(shared.value[_cell(core)], key % SALTS + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (core.view(np.int64), salt, whole[:, 0], whole[:, 1], doc, key, spot)],
                    ["core", "salt", "f1", "f2", "doc", "key", "spot"],
                )

    return texts.select("doc", "key", "text").mapInArrow(run, f"core bigint, salt int, f1 bigint, f2 bigint, {_ROW}, spot bigint")


def _grouped(anchors: DataFrame) -> DataFrame:
    """Passes 1 and 2: the anchors that share their first digit; n: size of the class, lead: one a class
    of a group with several. In large groups n counts the copies under one salt, and lead is still open."""
    group = Window.partitionBy("core", "salt")
    same = Window.partitionBy("core", "salt", "f1", "f2")
    leader = same.orderBy("doc", "key", "spot")
    marked = anchors.withColumns(
        {
            "n": F.count(F.lit(1)).over(same),
            "place": F.row_number().over(leader),
            "least": F.min(F.struct("f1", "f2")).over(group),
            "most": F.max(F.struct("f1", "f2")).over(group),
        }
    )
    lead = (F.col("least") != F.col("most")) & (F.col("place") == 1)
    large = F.col("salt") > 0
    return marked.select("core", large.alias("large"), "f1", "f2", "doc", "key", "spot", "n", lead.alias("lead")).filter("large or n > 1 or lead")


def _with_texts(texts: DataFrame, rows: DataFrame, item: str) -> DataFrame:
    """(doc, key, text, items): the texts that rows (doc, key, <item>) name, with their items. Of the others, hardly any travel."""
    named = rows.select("doc", "key", F.expr(f"struct({item})").alias("item"))
    bits = bitfilter.build(named.select(F.xxhash64("doc", "key")))
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # bitfilter.BITS bits

    def run(batches):
        for batch in batches:
            wanted = batch.filter(pa.array(bitfilter.may_hold(shared.value, batch.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays(wanted.columns[:3], ["doc", "key", "text"])

    some = texts.select("doc", "key", "text", F.xxhash64("doc", "key").alias("row")).mapInArrow(run, f"{_ROW}, text string")
    return some.join(named.groupBy("doc", "key").agg(F.collect_list("item").alias("items")), ["doc", "key"]).select("doc", "key", "text", "items")


def _raw_tokens(column: pa.Array):
    """For each row of a text column its tokens' bytes by kind."""
    data, offsets = utf8(column)
    for r in range(len(column)):
        part = data[offsets[r] : offsets[r + 1]]
        yield part.tobytes(), words(part, np.array([0, len(part)]), lower=False)[0].tobytes()


def _contexts(met: DataFrame) -> DataFrame:
    """(core, doc, key, start, n, kind, context): the tokens that an anchor's windows cover, for items (core, spot, n)."""

    def run(batches):
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for r, (raw, here) in enumerate(zip(_raw_tokens(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                for x in here:
                    start, t = x["spot"] >> 16, KINDS[(x["spot"] >> 15) & 1]
                    context = raw[t.kind][start * t.width : (start + (x["spot"] & 255) + t.depth) * t.width]
                    out.append((x["core"], docs[r], keys[r], start, x["n"], t.kind, context))
                    if len(out) >= 4096:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    def pack(out):
        columns = list(zip(*out, strict=True))
        arrays = [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["core", "doc", "key", "start", "n", "kind", "context"])

    return met.mapInArrow(run, f"core bigint, {_ROW}, start bigint, n bigint, kind bigint, context binary")


def _blocks(met: DataFrame) -> DataFrame:
    """(c1, c2, v1, v2, doc, key, kind, start, width, n): the blocks of windows of items (spot, n), with the
    fingerprints of what a block's windows have in common and of what they cover together."""

    def run(batches):
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            common, cover, out = [], [], []
            for r, (raw, here) in enumerate(zip(_raw_tokens(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                for x in here:
                    first, t = x["spot"] >> 16, KINDS[(x["spot"] >> 15) & 1]
                    ahead, size, w, text = (x["spot"] >> 8) & 127, t.spread // BLOCKS, t.width, raw[t.kind]
                    anchor = first + ahead
                    for i in range((ahead - (x["spot"] & 255)) // size, ahead // size + 1):
                        near, far = max(ahead - (x["spot"] & 255), i * size), min(ahead, i * size + size - 1)  # distances from the anchor
                        left = anchor - i * size
                        common.append(bytes((t.kind, i)) + text[left * w : (left - size + 1 + t.depth) * w])
                        cover.append(bytes((t.kind, near, far)) + text[(anchor - far) * w : (anchor - near + t.depth) * w])
                        out.append((docs[r], keys[r], t.kind, anchor - far, far - near, x["n"]))
                        if len(out) >= 4096:
                            yield pack(common, cover, out)
                            common, cover, out = [], [], []
            if out:
                yield pack(common, cover, out)

    def pack(common, cover, out):
        c, v = _digests(common), _digests(cover)
        columns = [c[:, 0], c[:, 1], v[:, 0], v[:, 1], *zip(*out, strict=True)]
        names = ["c1", "c2", "v1", "v2", "doc", "key", "kind", "start", "width", "n"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    shape = f"c1 bigint, c2 bigint, v1 bigint, v2 bigint, {_ROW}, kind bigint, start bigint, width bigint, n bigint"
    return met.mapInArrow(run, shape)


def _windows(met: DataFrame) -> DataFrame:
    """(w1, w2, doc, key, kind, start, n): each window of the items (kind, start, width, n)."""

    def run(batches):
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts, out = [], []
            for r, (raw, here) in enumerate(zip(_raw_tokens(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                for x in here:
                    t = KINDS[x["kind"]]
                    for p in range(x["start"], x["start"] + x["width"] + 1):
                        parts.append(bytes((t.kind,)) + raw[t.kind][p * t.width : (p + t.depth) * t.width])
                        out.append((docs[r], keys[r], t.kind, p, x["n"]))
                    if len(out) >= 4096:
                        yield pack(parts, out)
                        parts, out = [], []
            if out:
                yield pack(parts, out)

    def pack(parts, out):
        d = _digests(parts)
        columns = [d[:, 0], d[:, 1], *zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["w1", "w2", "doc", "key", "kind", "start", "n"])

    return met.mapInArrow(run, f"w1 bigint, w2 bigint, {_ROW}, kind bigint, start bigint, n bigint")


def repeated_in_group(rows: list[tuple]) -> list[tuple]:
    """Pass 3 over whole groups: rows (core, doc, key, start, n, kind, context); ranges (doc, key, kind,
    start, stop) of tokens that repeated windows of the contexts with n = 1 cover."""
    kinds = [KINDS[r[5]] for r in rows]
    sizes = np.array([len(r[6]) // t.width - t.depth + 1 for r, t in zip(rows, kinds, strict=True)])
    digests = _digests(
        r[6][p * t.width : (p + t.depth) * t.width] for r, t, size in zip(rows, kinds, sizes.tolist(), strict=True) for p in range(size)
    )
    _, number = np.unique(np.ascontiguousarray(digests).view(np.complex128).ravel().view("V16"), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    n = np.array([r[4] for r in rows])
    times = np.bincount(number, weights=n[owner])
    hit = np.flatnonzero((times[number] > 1) & (n[owner] == 1))
    if not len(hit):
        return []
    place = hit - (np.cumsum(sizes) - sizes)[owner[hit]]
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
    out = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(hit)], strict=True):
        r = rows[owner[hit[a]]]
        out.append((r[1], r[2], r[5], r[3] + int(place[a]), r[3] + int(place[b - 1]) + KINDS[r[5]].depth))
    return out


def _compared(contexts: DataFrame) -> DataFrame:
    """Pass 3 for groups of bounded size: (doc, key, kind, start, stop)."""

    def pack(found):
        columns = zip(*found, strict=True) if found else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "key", "kind", "start", "stop"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if len(held) >= 1024 and row[0] != held[-1][0]:
                    yield pack(repeated_in_group(held))
                    held = []
                held.append(row)
        if held:
            yield pack(repeated_in_group(held))

    ordered = contexts.repartition("core").sortWithinPartitions("core")
    return ordered.mapInArrow(run, f"{_ROW}, kind bigint, start bigint, stop bigint")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(doc, key, kind, start, stop): token ranges of texts (doc, key, text) that repeated windows cover."""
    marked = written(_grouped(anchor_table(texts, large_groups(texts))), "anchors")
    width = F.col("spot").bitwiseAND(F.lit(255))
    span = _range(F.shiftright("spot", 16), width, _kind("spot"))
    small, large = marked.filter("not large"), marked.filter("large")
    out = marked.filter("n > 1").select(*span)  # a copy under one salt is enough
    out = out.unionByName(_compared(_contexts(_with_texts(texts, small.filter("lead"), "core, spot, n"))))
    if large.isEmpty():
        return out
    classes = large.groupBy("core", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "key", "spot")).alias("first"))
    classes = written(classes, "classes")
    several = written(classes.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("core"), "several")
    copies = large.filter("n = 1").drop("n").join(classes.filter("n > 1").select("core", "f1", "f2"), ["core", "f1", "f2"])
    leads = classes.join(several, "core").select("first.*", "n")

    blocks = written(_blocks(_with_texts(texts, written(leads, "leads"), "spot, n")), "blocks")
    one = F.min(F.struct("doc", "key", "kind", "start", "width")).alias("one")
    covers = written(blocks.groupBy("c1", "c2", "v1", "v2").agg(F.sum("n").alias("n"), one), "covers")
    again = blocks.filter("n = 1").drop("n").join(covers.filter("n > 1").select("v1", "v2"), ["v1", "v2"])
    shared = written(covers.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("c1", "c2"), "shared")
    between = written(covers.join(shared, ["c1", "c2"]).select("one.*", "n"), "between")

    windows = written(_windows(_with_texts(texts, between, "kind, start, width, n")), "windows")
    times = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1").select("w1", "w2")
    singles = windows.filter("n = 1").join(times, ["w1", "w2"])
    whole = _range(F.col("start"), F.col("width"), F.col("kind"))
    return (
        out.unionByName(copies.select(*span))
        .unionByName(again.select(*whole))
        .unionByName(singles.withColumn("width", F.lit(0)).select(*whole))
    )


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.append(True, starts[1:] > stops[:-1])
    first = np.flatnonzero(fresh)
    return list(zip(starts[first].tolist(), stops[np.append(first[1:], len(stops)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_words, n_passage_words, and kept text.

    spans are the removed byte ranges, "start:stop" joined by commas. n_passage_words counts the words in
    passages of 50 words or more that stand elsewhere too; of these, only what 400-byte windows cover is
    removed. The kept bytes need not be whole characters where two texts differ inside one; kept is
    then decoded with replacement marks.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    other = F.xxhash64(F.lit("another"), "text")
    texts = texts.select(F.coalesce("doc_id", other).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    ranges = repeated_ranges(texts).groupBy("doc", "key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("ranges"))
    met = texts.join(ranges, ["doc", "key"], "left").select("doc_id", "text", "ranges")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            n_words = [k for i, j in passes(offsets) for k in np.diff(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)[1])]
            out = []
            ranges = batch.column(2)
            for r in range(batch.num_rows):
                text = raw[offsets[r] : offsets[r + 1]]
                spans, passages = _by_kind(ranges[r].values)
                kept, at = [], 0
                for start, stop in spans:
                    kept.append(text[at:start])
                    at = stop
                left = b"".join([*kept, text[at:]])
                out.append(
                    (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans))
                    + (int(n_words[r]), sum(b - a for a, b in passages))
                    + ((left.decode("utf-8", "replace"),) if with_text else ())
                )
            kinds = [*[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 2, *[pa.string()] * with_text]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_words", "n_passage_words"] + ["kept"] * with_text
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, n_words bigint, n_passage_words bigint"
    return met.mapInArrow(run, shape + ", kept string" * with_text)


def _by_kind(ranges) -> tuple[list, list]:
    """Merged spans of bytes and of words from one row's ranges."""
    if ranges is None or not len(ranges):
        return [], []
    kind, start, stop = (ranges.field(i).to_numpy() for i in range(3))
    return tuple(_merged(start[kind == t.kind], stop[kind == t.kind]) if (kind == t.kind).any() else [] for t in KINDS)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
