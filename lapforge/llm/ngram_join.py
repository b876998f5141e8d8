"""N-gram Jaccard self-join by rare-first prefix filtering, and the groups its links make.

1. Each text becomes the set of its distinct five-word shingles. Texts with equal sets form one
   class; from here on only classes are joined, copies come back at the end by membership.
2. Shingle frequencies are counted over all texts into a fixed number of cells. The order (cell
   count, hash) is the same everywhere and puts rare shingles first; it is part of each shingle's
   64-bit key, so sorting a set's keys sorts it rare-first.
3. Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of each (prefix filter).
   Only those go out, keyed by shingle; shingles met by one class alone end there.
4. Candidates pass the length and positional filters, then each distinct pair is verified once:
   bitmap filter, suffix filter, then exact intersection. The bitmap of a set has a bit for the
   parity of each of its cells; two sets differ in at least as many shingles as their bitmaps do in
   bits, so pairs that differ too much end before their sets travel, and no link is lost.
   What is asked for is every component, not every pair: in a small posting list all pairs are
   candidates, in a long one each member meets the list's hub. Hub links join most of a crowd of near
   copies in linear work. Lists whose members are still in different components after that get
   further hubs while there are many such rows, and in the end every remaining pair across components is
   verified, so no link that could join two components is left out, whatever the list's length.
   A pair that shares several shingles meets once: where the shingle before is not shared by both. A list
   whose members all share the shingle before is left out whole.

Sets larger or lists longer than memory are not gathered: long lists are joined with one hub row,
very frequent shingles are dealt out by (shingle, salt). A class is known by 64 bits, after sets have
been told apart by 128.

Defined cases: null and empty texts, and texts of white space alone, have the empty set and link with
nothing; fewer words than five make one shingle of the whole sequence; rows with a null doc_id take
part, their component is the least known doc_id (null if none); rows that repeat a doc_id are each
reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapforge.llm import bitfilter, celltable
from lapforge.llm.components import connected_components
from lapforge.llm.storage import release, written
from lapforge.llm.textkit import U64, mix, passes, sequence_hash, shingles, utf8, words

SIZE = 5
NUM, DEN = 75, 100  # the least similarity as a fraction
CELLS = 1 << 20
SMALL_LIST = 8
HUB_ROUNDS = 2
#: Rows across components are all compared once that takes at most so many comparisons a row; else further hubs come first.
CROSS_FACTOR = 500
SALTS = 64
BITMAP_BITS = 1024
NO_ID = (1 << 63) - 1  # stands for a null doc_id inside, after all others


def least_overlap(total):
    """Least intersection of two sets of total elements together that links them."""
    return -(-NUM * total // (NUM + DEN))


def prefix_length(n):
    return n - (-(-NUM * n // DEN)) + 1


def text_sets(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column; an empty array for no words."""
    data, offsets = utf8(column)
    for i, j in passes(offsets):
        part = offsets[i : j + 1] - offsets[i]
        hashed, at = words(data[offsets[i] : offsets[j]], part)
        runs = shingles(hashed, size)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s >= size:
                yield np.unique(runs[s : e - size + 1])
            elif e > s:
                yield np.array([sequence_hash(hashed[s:e])], U64)
            else:
                yield np.zeros(0, U64)


def _cells(keys: np.ndarray) -> np.ndarray:
    return ((keys >> U64(20)) & U64(CELLS - 1)).astype(np.int64)


def shingle_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each cell: CELLS numbers, over all documents."""

    def cells(batch):
        waiting: list[np.ndarray] = []
        for keys in text_sets(batch.column(0)):
            waiting.append(_cells(keys))
            if len(waiting) >= 512:
                yield np.concatenate(waiting)
                waiting.clear()
        if waiting:
            yield np.concatenate(waiting)

    return celltable.counted(docs.select("text"), cells, CELLS)


def frequency_ranks(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(a byte per cell that grows with its count, the byte from which a shingle counts as very frequent).

    What a cell holds beyond the mean load comes from frequent shingles.
    """
    above = np.maximum(counts - int(counts.mean()), 0)
    rank = np.minimum(np.floor(8 * np.log2(above + 1.0)), 255).astype(np.uint8)
    return rank, int(8 * np.log2(20_000))


def ordered(keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys as (rank byte, 56 bits of the hash), ascending: rare first."""
    out = (rank[_cells(keys)].astype(U64) << U64(56)) | (keys >> U64(8))
    out.sort()
    return out


def _identity(keys: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not len(keys):
        return 0, 0
    with np.errstate(over="ignore"):
        h, other = int(mix(keys).sum(dtype=U64)), int(mix(keys ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
    h = (h + len(keys) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h, other - (1 << 64) if other >> 63 else other


def _class_of(keys: np.ndarray, again: frozenset[int]) -> int:
    """The id of a set; again holds the first hashes that different sets have in common."""
    first, second = _identity(keys)
    return second if first in again else first


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """The parities of a set's cells, as BITMAP_BITS / 64 numbers."""
    odd = np.bincount((keys & U64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _membership(docs: DataFrame, again: frozenset[int]) -> DataFrame:
    """(id, mark, cls, other, n, bits) for every row; id: doc_id, a null last; mark: a hash of the text."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in text_sets(batch.column(2)):
                first, second = _identity(k)
                rows.append((*((second, first) if first in again else (first, second)), len(k), _bitmap(k)))
            columns = [pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1, 2)]
            bits = pa.array([x[3] for x in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, bits], ["id", "mark", "cls", "other", "n", "bits"])

    rows = docs.select(_id(), _mark(), "text")
    return rows.mapInArrow(run, "id bigint, mark bigint, cls bigint, other bigint, n bigint, bits array<bigint>")


def _id():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id")


def _mark():
    return F.xxhash64("text").alias("mark")


def members_and_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(rows with their class, one row per class with its node, first hashes that had to be replaced).

    A class is known by 64 bits from here on. Sets are compared by 128 bits once; should different
    sets have their 64 bits in common (about 70 pairs in 5e10 texts), they get the other 64.
    """
    again: frozenset[int] = frozenset()
    for _ in range(4):
        members = written(_membership(docs, again), "members")
        node = F.min(F.struct("id", "mark", "cls")).alias("node")  # the row that stands for the class
        every = members.filter("n > 0").groupBy("cls").agg(
            node, F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("other").alias("o0"), F.max("other").alias("o1")
        )
        classes = written(every, "classes")
        clash = frozenset(r[0] for r in classes.filter("o0 <> o1").select("cls").collect())  # see above: hardly any
        if not clash:
            return members, classes.drop("o0", "o1"), again
        again |= clash
    raise RuntimeError("sets cannot be told apart")


def _close(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (u, v), as nodes, whose bitmaps differ in no more bits than linked sets may differ in shingles."""
    with_a = pairs.join(maps.withColumnsRenamed({"cls": "a", "n": "n_a", "bits": "bits_a", "node": "u"}), "a")
    full = with_a.join(maps.withColumnsRenamed({"cls": "b", "n": "n_b", "bits": "bits_b", "node": "v"}), "b")
    apart = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k
    )
    total = F.col("n_a") + F.col("n_b")
    return full.filter(apart <= total - 2 * F.ceil(total * NUM / (NUM + DEN) - 1e-9)).select("u", "v")


def _prefixes(docs: DataFrame, rank: np.ndarray, frequent: int, again: frozenset[int]) -> DataFrame:
    """(key, salt, cls, at): the prefix shingles of each class, once per class and task; at: n * 2^32 + pos."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # CELLS bytes

    def pack(held):
        heads, ids, sizes = zip(*held, strict=True)
        lengths = np.array([len(h) for h in heads])
        key = np.concatenate(heads)
        cls, n = np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
        at = (n << 32) + np.concatenate([np.arange(k) for k in lengths])  # one number, as these are the most rows that travel
        salt = np.where((key >> U64(56)) >= frequent, cls % SALTS + 1, 0).astype(np.int32)
        columns = [pa.array(x) for x in (key.view(np.int64), salt, cls, at)]
        return pa.RecordBatch.from_arrays(columns, ["key", "salt", "cls", "at"])

    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []
        for batch in batches:
            for keys in text_sets(batch.column(0)):
                cls, n = _class_of(keys, again), len(keys)
                if not n or cls in seen:
                    continue
                seen.add(cls)
                held.append((ordered(keys, shared.value)[: prefix_length(n)], cls, n))
                if len(held) == 512:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return docs.select("text").mapInArrow(run, "key bigint, salt int, cls bigint, at bigint")


def _postings(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose shingle another class has too, each class once per shingle.

    alone: how many shingles of its prefix a class shares with no other prefix (picks hubs, filters
    nothing). prev: the shingle before this one among those that the class shares.
    """
    place = Window.partitionBy("key", "salt")
    met = prefixes.withColumns({"least": F.min("cls").over(place), "most": F.max("cls").over(place)})
    shared = met.filter("least <> most or salt > 0").select("key", "cls", "at", "salt")
    # copies that several tasks have sent: same key and class
    once = shared.groupBy("key", "salt", "cls").agg(F.first("at").alias("at"))
    once = once.select("key", "cls", F.shiftright("at", 32).cast("int").alias("n"), F.expr("at & 4294967295").cast("int").alias("pos"))
    own = Window.partitionBy("cls")
    size = F.expr(f"n - ((n * {NUM} + {DEN - 1}) div {DEN}) + 1")
    alone = (size - F.count(F.lit(1)).over(own)).cast("int").alias("alone")
    return once.select("key", "cls", "n", "pos", alone, F.lag("key").over(own.orderBy("pos")).alias("prev"))


def _in_lists(postings: DataFrame) -> DataFrame:
    """The postings of the lists to look at, with the list's m members and small, its least set size.

    A list all of whose members have the same shared shingle before this one is left out: its pairs
    meet in the list of that shingle, at a place that the filters let more through. So is a list of two
    whose pair does not pass the length and positional filters.
    """
    before = F.coalesce("prev", "key")  # the key itself stands for no shingle before it
    prev = [F.min(before).alias("p0"), F.max(before).alias("p1")]
    size = [F.min("n").alias("small"), F.max("n").alias("large"), F.min(F.col("n") - F.col("pos")).alias("room")]
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *prev, *size).filter("m > 1 and (p0 = key or p0 <> p1)")
    total = F.col("small") + F.col("large")  # of a list of two: its only pair
    pair = (F.col("small") * DEN >= F.col("large") * NUM) & (F.col("room") >= F.ceil(total * NUM / (NUM + DEN) - 1e-9))
    lists = lists.filter((F.col("m") > 2) | pair).select("key", "m", "small")
    lists = written(lists, "lists")  # written, so that a list of any length can be split
    wanted = postings.sparkSession.sparkContext.broadcast(bitfilter.build(lists.select("key")))  # bitfilter.BITS bits

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(bitfilter.may_hold(wanted.value, batch.column(0).to_numpy())))

    # most postings are in no such list: they do not travel
    found = written(postings.mapInArrow(some, postings.schema).join(lists, "key"), "postings")
    release(lists)
    return found


def _can_link(least_partner, pos):
    """Whether a posting has shingles enough, from place pos on, to link with a partner of that size (the smallest there is)."""
    return F.ceil((F.col("n") + least_partner) * NUM / (NUM + DEN) - 1e-9) <= F.col("n") - pos


def _need(a, b):
    """The least overlap of two posting structs that links them."""
    return F.ceil((a["n"] + b["n"]) * NUM / (NUM + DEN) - 1e-9)


def _passes_filters(a, b):
    """Length and positional filters of two posting structs (cls, n, pos) of one shingle."""
    most = F.least(a["pos"], b["pos"]) + 1 + F.least(a["n"] - a["pos"] - 1, b["n"] - b["pos"] - 1)
    return (F.least(a["n"], b["n"]) * DEN >= F.greatest(a["n"], b["n"]) * NUM) & (most >= _need(a, b))


def _passes_first(a, b):
    """The filters for the first shingle that two classes share: nothing is shared before it.

    A pair that links passes there; at other shingles that they share it may not.
    """
    most = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (F.least(a["n"], b["n"]) * DEN >= F.greatest(a["n"], b["n"]) * NUM) & (most >= _need(a, b))


_POSTING = ("cls", "n", "pos", "prev")


def _meet_first(a, b):
    """Whether two postings of a shingle have no shared shingle just before it in common; else they have met there."""
    return F.coalesce(a["prev"] != b["prev"], F.lit(True))


def _as_pair(a, b):
    return F.struct(F.least(a["cls"], b["cls"]).alias("a"), F.greatest(a["cls"], b["cls"]).alias("b"))


def _star(rows: DataFrame, hub_rows: DataFrame) -> DataFrame:
    """(a, b) of every row with the hub of its list, which is picked from hub_rows."""
    hubs = hub_rows.groupBy("key").agg(F.min(F.struct("alone", *_POSTING)).alias("hub"))
    me, hub = F.struct(*_POSTING), F.col("hub")
    met = rows.join(hubs, "key").withColumn("me", me).filter(F.col("cls") != hub["cls"]).filter(_passes_filters(F.col("me"), hub))
    return met.select(_as_pair(F.col("me"), hub).alias("p")).select("p.*")


def _first_pairs(postings: DataFrame) -> DataFrame:
    small, large = postings.filter(F.col("m") <= SMALL_LIST), postings.filter(F.col("m") > SMALL_LIST)
    listed = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*_POSTING))).alias("list"))  # SMALL_LIST at most
    pairs = listed.select(
        F.explode(
            F.flatten(
                F.transform(
                    "list",
                    lambda x: F.transform(
                        F.filter("list", lambda y: (y["cls"] > x["cls"]) & _meet_first(x, y) & _passes_first(x, y)),
                        lambda y: _as_pair(x, y),
                    ),
                )
            )
        ).alias("p")
    ).select("p.*")
    return pairs.unionByName(_star(large, large)).distinct()


def suffix_allows(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter: halve both sorted sets around a pivot and bound the overlap by the parts' sizes."""

    def bound(p, q, level):
        if not len(p) or not len(q):
            return 0
        if level == 0:
            return min(len(p), len(q))
        pivot = p[len(p) // 2]
        i, j = len(p) // 2, int(np.searchsorted(q, pivot))
        hit = int(j < len(q) and q[j] == pivot)
        return bound(p[:i], q[:j], level - 1) + hit + bound(p[i + 1 :], q[j + hit :], level - 1)

    return bound(x, y, depth) >= need


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link, by the suffix filter and the exact overlap."""
    need = least_overlap(len(x) + len(y))
    if min(len(x), len(y)) < need or not suffix_allows(x, y, need):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verify(docs: DataFrame, maps: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): the candidates that link.

    Only texts that stand for a class in a pair with close bitmaps travel: as texts, since a set of
    hashes is larger and does not compress.
    """
    pairs = written(_close(candidates, maps), "close")
    row = F.xxhash64("id", "mark").alias("row")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).select("node.*").select(row)
    wanted = docs.sparkSession.sparkContext.broadcast(bitfilter.build(ends))  # bitfilter.BITS bits

    def some(batches):
        for batch in batches:
            picked = batch.filter(pa.array(bitfilter.may_hold(wanted.value, batch.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays(picked.columns[:3], ["id", "mark", "text"])

    texts = docs.select(_id(), _mark(), "text").select("id", "mark", "text", row).mapInArrow(some, "id bigint, mark bigint, text string")
    named = pairs.select("u.id", "u.mark", F.col("u.cls").alias("a"), "v")
    with_a = named.join(texts, ["id", "mark"]).select("a", F.col("v.cls").alias("b"), "v.id", "v.mark", F.col("text").alias("text_a"))
    full = with_a.join(texts, ["id", "mark"]).select("a", "b", "text_a", "text")

    def check(batches):
        for batch in batches:
            ok = [links(x, y) for x, y in zip(text_sets(batch.column(2)), text_sets(batch.column(3)), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return full.mapInArrow(check, "a bigint, b bigint")


def _unsettled(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings (with comp) of the lists whose members are in more than one component, without those
    that cannot first meet a partner there, be it the list's smallest member."""
    able = postings.filter(F.col("m") > SMALL_LIST).filter(
        _can_link(F.greatest(F.col("small"), F.ceil(F.col("n") * NUM / DEN - 1e-9)), F.col("pos"))
    )
    known = roots.withColumnsRenamed({"node": "cls", "root": "comp"})
    labelled = able.join(known, "cls", "left").select("key", "alone", *_POSTING, F.coalesce("comp", "cls").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    return labelled.join(mixed.filter("c0 <> c1").select("key"), "key")


def _across(open_rows: DataFrame, outside: DataFrame) -> DataFrame:
    """Every pair (a, b) across components that may link, found where it first meets."""
    o, r = outside.alias("o"), open_rows.alias("r")
    each = [{c: F.col(f"{side}.{c}") for c in _POSTING} for side in "or"]
    met = o.join(
        r,
        (F.col("o.key") == F.col("r.key"))
        & (F.col("o.comp") != F.col("r.comp"))
        & ((F.col("r.comp") == F.col("o.main")) | (F.col("o.cls") < F.col("r.cls")))
        & _meet_first(*each)
        & _passes_first(*each),
    )
    return met.select(_as_pair(*each).alias("p")).select("p.*").distinct()


def class_components(docs: DataFrame, classes: DataFrame, again: frozenset[int]) -> DataFrame:
    """(node, root), as cls, over the classes that link with another one."""
    rank, frequent = frequency_ranks(shingle_frequencies(docs))
    every = written(_postings(_prefixes(docs, rank, frequent, again)), "prefixes")
    postings = _in_lists(every)
    release(every)
    maps = written(classes.join(postings.select("cls").distinct(), "cls", "left_semi"), "maps")
    checked = written(_first_pairs(postings), "pairs")
    roots = connected_components(_verify(docs, maps, checked))
    for turn in range(HUB_ROUNDS + 1):
        open_rows = written(_unsettled(postings, roots), "open")
        # the commonest component of a list needs no pairs of its own
        by_comp = open_rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = by_comp.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"))
        cost = main.agg(F.sum((F.col("m") - F.col("main.k")) * F.col("m")), F.sum("m")).first()
        if not cost[0]:
            release(open_rows)
            break
        outside = open_rows.join(main.select("key", F.col("main.comp").alias("main")), "key").filter("comp <> main")
        last = turn == HUB_ROUNDS or cost[0] <= CROSS_FACTOR * cost[1]
        pairs = _across(open_rows, outside) if last else _star(open_rows, outside).distinct()
        fresh = written(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        release(open_rows)
        more = written(_verify(docs, maps, fresh), "found")
        if not more.isEmpty():
            # what is joined already goes in as stars
            stars = roots.filter("node <> root").withColumnsRenamed({"node": "a", "root": "b"})
            roots = connected_components(stars.unionByName(more))
        if last:
            break
        checked = checked.unionByName(fresh)
    release(postings, maps)
    return roots


def _placed(docs: DataFrame) -> DataFrame:
    """(id, mark, n, node, root) for every row of docs; node stands for its class, root for its component. Null for the empty set."""
    members, classes, again = members_and_classes(docs)
    roots = class_components(docs, classes, again).withColumnRenamed("node", "cls")
    nodes = classes.select("cls", "node")
    linked = written(roots.join(nodes, "cls"), "linked")
    least = written(linked.groupBy("root").agg(F.min("node").alias("least")), "least")
    known = linked.join(least, "root").select("cls", F.col("least").alias("root"))
    placed = nodes.join(known, "cls", "left").select("cls", "node", F.coalesce("root", "node").alias("root"))
    return members.join(written(placed, "placed"), "cls", "left").select("id", "mark", "n", "node", "root")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id.

    class_id is the smallest doc_id with the same set, component_id the smallest doc_id that links
    reach. Documents with the empty set stand alone.
    """

    def named(column):
        return F.nullif(F.coalesce(column, F.col("id")), F.lit(NO_ID))

    return _placed(docs).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        named(F.col("node.id")).alias("class_id"),
        named(F.col("root.id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, a null after all others.

    A document is a doc_id with a text: rows that repeat both stay or go together, a doc_id with two
    texts is two documents. Documents with the empty set stay.
    """
    placed = _placed(docs).filter("n > 0 and (id <> root.id or mark <> root.mark)")
    gone = placed.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__mark"])
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
