"""Filter audit, whitening and packing against brute force, the tokenizer library and SQL."""

from __future__ import annotations

import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest_llm import ODD, frame, prose

from lapforge.llm import best_fit_packing as packing
from lapforge.llm import embedding_whitening as whitening
from lapforge.llm import filter_audit as audit

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# filter interaction audit ---------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and x == 1 for i, _, x in labels if i is not None)
        docs.append((source or "", fails, good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                failing = sum(d[1][f] for d in mine)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def label_frame(spark, labels):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id bigint, quality int, toxic int, part string")


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def test_filter_audit_brute(spark):
    r = random.Random(5)
    texts, sources, ids = [], [], []
    for i in range(120):
        words = prose(i, r.choice([3, 49, 50, 80]))
        if r.random() < 0.3:
            words = words[:10] * (len(words) // 10 + 1)
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        if r.random() < 0.2:
            words.append(r.choice("#$%&*|"))
        texts.append(r.choice(texts) if texts and r.random() < 0.3 else " ".join(words))
        sources.append(r.choice(["a", "a", "a", "b", None, ""]))
        ids.append(i)
    texts += [*ODD, texts[0], texts[1]]
    sources += ["odd"] * (len(ODD) + 1) + [None]
    ids += [*range(200, 200 + len(ODD)), 0, None]  # a repeated id, a null id
    r.shuffle(order := list(range(len(ids))))
    ids, texts, sources = ([x[i] for i in order] for x in (ids, texts, sources))
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1, None])) for i in range(0, 130, 2)] + [(0, 0, 1), (2, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(
        [(i, t, s, "clash", True) for i, t, s in zip(ids, texts, sources, strict=True)], "doc_id bigint, text string, source string, part string, A boolean"
    )
    assert audited(audit.filter_interactions(docs, label_frame(spark, labels))) == audit_by_hand(list(zip(ids, texts, sources, strict=True)), labels)


def test_filter_audit_odd_and_empty(spark, odd, empty):
    none = label_frame(spark, [])
    got = audited(audit.filter_interactions(odd, none))
    assert len(got) == 600 and all(row[4] == row[5] == 0 for row in got.values())
    assert audit.filter_interactions(empty, none).collect() == []
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert got == audit_by_hand(rows, [])


@needs_data
def test_filter_audit_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(tuple, audit.query(spark, DATA).collect())) == sorted(db.execute(audit.ORACLE).fetchall())


# whitening ------------------------------------------------------------------------------------------------------------


def vectors_frame(spark, vectors, ids=None):
    return spark.createDataFrame(
        [(ids[i] if ids else i, v, 0, 1, "x") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int, n int, component string"
    )


def check_whitening(got, ids, vectors, keep=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True).reshape(x.shape[1], x.shape[1])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(keep, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(vectors)
    want = (x - s / n) @ v[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        mine = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1)
        theirs = sorted(((i if i is not None else -1, int(d)), float(w)) for i, d, w in zip(ids, ((n * x - s) ** 2).sum(1), want[:, c], strict=True))
        assert [m[0] for m in mine] == [t[0] for t in theirs]
        a, b = np.array([m[1] for m in mine]), np.array([t[1] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    for r in got:
        assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("fan_in", [2, 16])
def test_whitening_brute(spark, fan_in):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(200, 12)) * np.linspace(4, 0.5, 12) + 30).astype(np.float32)
    vectors = [*base.tolist(), *base[:50].tolist(), *[base[0].tolist()] * 100]
    ids = [*range(300), *[7] * 50][: len(vectors)]
    table = vectors_frame(spark, vectors, ids).repartition(7)
    check_whitening(whitening.whiten(table, fan_in=fan_in).collect(), ids, vectors)


def test_whitening_odd_vectors(spark):
    good = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 2.0, -0.0], [-4.0, 0.125, 1.0], [-4.0, 0.125, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    ids = [1, None, 3, 4, 4]
    got = whitening.whiten(vectors_frame(spark, [*good, *bad], [*ids, *range(50, 57)])).collect()
    check_whitening(got, ids, good)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_frame(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(vectors_frame(spark, [])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [None, []])).collect() == []
    one_way = [[float(i), 2.0 * i, 5.0] for i in range(6)]
    got = whitening.whiten(vectors_frame(spark, one_way)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_whitening_wide_numbers(spark):
    """Deviations beyond 64 bits are null, those within stay exact."""
    big = [[1e12, 0.0], [-1e12, 1.0], [0.0, 0.0]]
    got = whitening.whiten(vectors_frame(spark, big)).collect()
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    for r in got:
        want = exact[r["vec_id"]]
        assert r["deviation"] == (want if want < 2**63 else None)


@needs_data
def test_whitening_tables(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(whitening.query(spark, DATA).collect(), [r[0] for r in rows], [r[1] for r in rows])


# packing --------------------------------------------------------------------------------------------------------------


def best_fit_by_hand(lengths, limits, rule):
    """One piece after the other, longest first, into the best of all open bins."""
    full, weights = np.array(limits.capacity, float), limits.weights
    bins: list[list[int]] = []
    for length in sorted(lengths, reverse=True):
        item, best = np.array([length, 1, length * length], float), None
        for i, b in enumerate(bins):
            left = full - [sum(b), len(b), sum(x * x for x in b)]
            if (left < item).any():
                continue
            if rule == "norm":
                score = sum(w * ((r - t) / f) ** 2 for w, r, t, f in zip(weights, left, item, full, strict=True))
            else:
                score = -sum(w * r * t / f**2 for w, r, t, f in zip(weights, left, item, full, strict=True))
            if best is None or score < best[0] - 1e-12:
                best = (score, i)
        if best is None:
            bins.append([length])
        else:
            bins[best[1]].append(length)
    return sorted(tuple(sorted(b)) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, 3), packing.Limits(64, 5, 1500), packing.Limits(64, None, 900, (1.0, 0.5, 2.0))])
def test_packing_plan_brute(rule, limits):
    for seed in range(6):
        r = random.Random(seed)
        lengths = [min(r.choice([1, 2, 64, r.randint(1, 64), r.randint(1, 20)]), limits.longest) for _ in range(r.choice([1, 20, 150]))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.plan_bins(histogram, limits, rule)
        mine = sorted(tuple(sorted(x for x, k in content for _ in range(k))) for bins, content in zip(plan.bins, plan.content, strict=True) for _ in range(bins))
        assert sorted(x for b in mine for x in b) == sorted(lengths)
        theirs = best_fit_by_hand(lengths, limits, rule)
        assert len(mine) == len(theirs)
        if rule == "norm":
            assert mine == theirs
        assert len(plan.bins) <= 4 * limits.tokens


def test_packing_places_ranks():
    histogram = {5: 100, 3: 41, 2: 7, 1: 300}
    table = packing.rank_intervals(packing.best_plan(histogram, packing.Limits(16)))
    lengths = np.array([x for x, k in histogram.items() for _ in range(k)])
    ranks = np.array([i for k in histogram.values() for i in range(k)])
    sequence, offset = packing.place(lengths, ranks, table)
    used = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        for at in range(o, o + n):
            assert at < 16 and (s, at) not in used
            used[s, at] = True
    assert set(sequence.tolist()) == set(range(max(sequence) + 1))
    assert max(sequence) + 1 == -(-int(lengths.sum()) // 16)


def check_packing(rows, texts_of, limits):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in texts_of:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for k, at in enumerate(range(0, len(ids), limits.longest)):
            part = ids[at : at + limits.longest]
            want.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokens, documents, cost = limits.capacity
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= tokens and len(b) <= documents and sum(n * n for _, n in b) <= cost
    return len(bins)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(128), packing.Limits(128, 4, 9000)])
def test_packing_documents(spark, limits):
    texts = [*ODD, *[" ".join(prose(i, 3 + i * 7 % 90)) for i in range(150)], *["same words again"] * 200]
    texts += ["a\x0bb\x0cc", "é x̧́", "nb sp em", "\x1cunit\x1dsep\x85next", "<|endoftext|> x <|startoftext|>y", "I'LL don't THEY'RE", "ΑΣ ΑΣ", "İstanbul", "a ́b", "12345 6,7"]
    ids = [*range(len(texts) - 2), None, 3]
    rows = packing.pack(frame(spark, texts, ids).repartition(5), limits).collect()
    check_packing(rows, list(zip(ids, texts, strict=True)), limits)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_ids_of_odd_words():
    """Runs are cut from words as the library cuts them, on both sides of every boundary of kinds."""
    parts = [*"aZéÉßÿÀÞ×÷ªºµ019.,&*#|>-_~ \t\n'<", "the", "Straße", "'s", "'LL", "<|endoftext|>", "e\u0301", "\u0301", "İ", "ſ", "K", "Σ", "中", "½", "٣", "\x00", "\x1c", "\x7f", "\x85", "\xa0", "\u3000", "😀"]
    r = random.Random(5)
    texts = ["".join(r.choices(parts, k=r.choice([0, 1, 2, 3, 8, 40]))) for _ in range(4000)]
    ids_of, tokenizer = packing.WordIds(packing.default_tokenizer()), library()
    for chunk in (texts[:1], texts[1:3000], texts[2000:]):
        got = [np.frombuffer(x, "<u4").tolist() for x in ids_of([t.encode() for t in chunk])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in chunk]
    broken = [b"ab\xc3 c", b"\xc3\xa9\xff", b"\xa9x", b"\xe2\xc3\xa9", b"\xc3", b"\xc3\xc3\xa9Q", b""]
    got = [np.frombuffer(x, "<u4").tolist() for x in ids_of(broken)]
    assert got == [tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def test_packing_asks_library_by_runs():
    """Words that differ by capitals, digits or marks are one run of letters; none of them meets the whole tokenizer by itself."""
    ids_of, asked = packing.WordIds(packing.default_tokenizer()), []
    encode = ids_of.encode
    ids_of.encode = lambda texts, **more: (asked.extend(texts), encode(texts, **more))[1]
    words = [" ".join(prose(i, 1)) + chr(97 + i % 26) * (i % 5) + "qé" * (i % 3) for i in range(400)]
    text = " ".join(form for w in words for form in (w, w.capitalize(), f"{w}***", f"{w}7,", f"({w})"))
    assert np.frombuffer(ids_of([text.encode()])[0], "<u4").tolist() == library().encode(text, add_special_tokens=False).ids
    assert len(asked) <= 20 and len(ids_of.known) <= len(set(words)) + 20


def test_packing_empty(spark, empty):
    assert packing.pack(empty).collect() == []


@needs_data
def test_packing_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = packing.query(spark, DATA).collect()
    assert check_packing(rows, docs, packing.Limits()) == -(-sum(r["length"] for r in rows) // packing.TOKENS)
