"""Exact dedup, repeated substrings and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from conftest_llm import ODD, frame, prose, rows_of
from lapforge.llm import exact_dedup, ngram_join, suffix_dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_brute(rows):
    best = {}
    for i, t in rows:
        best.setdefault(plain(t), []).append((-len(t or ""), i if i is not None else 1 << 63, i))
    return {k: (min(v)[2], len(v)) for k, v in best.items()}


def test_exact_decisions(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = exact_brute(rows)
    got = exact_dedup.exact_decisions(odd).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_hot_group_and_ties(spark):
    docs = frame(spark, ["a b"] * 500 + ["a  b", "ab ", "c"], list(range(503)))
    got = rows_of(exact_dedup.exact_decisions(docs))
    assert got[0]["keep_id"] == 500 and got[0]["group_size"] == 502 and not got[0]["kept"]
    assert got[500]["kept"] and got[502]["kept"]
    assert exact_dedup.drop_exact_copies(docs).count() == 2


def test_exact_drop_with_repeated_ids(spark):
    docs = frame(spark, ["p", "p", "q", "r", "p"], [1, None, None, 1, 9])
    kept = exact_dedup.drop_exact_copies(docs)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "p"), ("1", "r"), ("None", "q")]
    assert kept.columns == docs.columns


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_decisions(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.near_duplicate_groups(empty).count() == 0
    assert ngram_join.drop_near_copies(empty).count() == 0


def suffix_brute(texts, depth=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - depth + 1):
            seen.setdefault(b[i : i + depth], []).append((d, i))
    hit = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i : i + depth] = True
    out = []
    for b, h in zip(raw, hit, strict=True):
        left = bytes(np.frombuffer(b, np.uint8)[~h])
        runs = int((np.diff(np.concatenate([[0], h.astype(int)])) == 1).sum())
        out.append((len(b), int(h.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def passage_brute(texts, depth=50):
    """Words of each text in runs of depth words or more that stand elsewhere too."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for i in range(len(w) - depth + 1):
            seen.setdefault(tuple(w[i : i + depth]), []).append((d, i))
    hit = [np.zeros(len(w), bool) for w in split]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i : i + depth] = True
    return [(len(w), int(h.sum())) for w, h in zip(split, hit, strict=True)]


def check_suffix(spark, texts):
    got = rows_of(suffix_dedup.remove_repeats(frame(spark, texts)))
    for i, (want, words) in enumerate(zip(suffix_brute(texts), passage_brute(texts), strict=True)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert (r["n_words"], r["n_passage_words"]) == words, i


def suffix_texts():
    shared = " ".join(prose(1, 200))
    texts = [" ".join(prose(10 + i, 150)) for i in range(12)]
    texts += [" ".join(prose(40 + i, 60)) + shared[i : 500 + 7 * i] + " ".join(prose(70 + i, 60)) for i in range(10)]
    texts += [shared[:400], shared[:399], shared[1:400], "é" * 350, "x" + "é" * 300, "ab" * 500, "z" * 399, "z" * 800, texts[0], texts[3], None, "", "k" * 401]
    cut = shared[100:700]
    short = " ".join(f"{x}" for x in random.Random(8).choices("abcdefghijklmnopqrstuvwxyz", k=56))  # over 50 words, under 400 bytes
    texts += [" ".join([*prose(500 + i, 9 * i), short[2 * i :], *prose(600 + i, 40)]) for i in range(6)]
    texts += [f"{short} {short}", short[:99], "w " * 49, "w " * 50, "w " * 51]
    return [*texts, cut[:399] + "Q" + cut[400:], cut + "R" + cut]


def test_suffix_against_brute_force(spark):
    check_suffix(spark, suffix_texts())


def test_suffix_with_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "large_groups", lambda texts: np.ones(suffix_dedup.CELLS, bool))
    check_suffix(spark, suffix_texts())


def test_suffix_rows_that_repeat(spark):
    """Long rows that repeat doc_id and text, a doc_id with two texts, and null ids, against brute force."""
    shared = " ".join(prose(1, 200))
    texts = [" ".join(prose(10 + i, 150)) for i in range(8)]
    rows = [*zip([0, 1, 1, 1, 2, None, None, None], texts, strict=True)]
    rows += [(0, texts[0]), (0, texts[0]), (None, texts[5]), (5, f"{texts[4][:700]} {shared}"), (6, f"x {shared}"), (6, f"x {shared}")]
    got = suffix_dedup.remove_repeats(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = [(i, *w, *p) for (i, _), w, p in zip(rows, suffix_brute([t for _, t in rows]), passage_brute([t for _, t in rows]), strict=True)]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_words", "n_passage_words")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)


def test_suffix_odd_rows(spark, odd):
    got = suffix_dedup.remove_repeats(odd, with_text=True).collect()
    assert len(got) == len(ODD) + 1
    long_run = next(r for r in got if r["n_bytes"] == 70_000)
    assert long_run["n_removed"] == 70_000 and long_run["kept"] == ""


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def jaccard_brute(texts):
    sets = word_sets(texts)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(words, seed, n):
    r = random.Random(seed)
    out = list(words)
    for _ in range(n):
        k = r.randrange(len(out))
        r.choice([lambda: out.__setitem__(k, r.choice(out)), lambda: out.insert(k, f"new{r.random()}"), lambda: out.pop(k)])()
    return " ".join(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_join_against_brute_force(spark, seed):
    texts = []
    for g in range(25):
        base = prose(1000 * seed + g, random.Random(g).randrange(6, 150))
        texts += [edited(base, 17 * g + k, k) for k in range(random.Random(g).randrange(1, 14))]
    texts += [texts[0].upper(), f"  {texts[1]}\n", None, "", " \t", "a b c", "A b  c", "a b", "a b c d e", "Ä b c d e", "ä b c d e"]
    random.Random(seed).shuffle(texts)
    got = rows_of(ngram_join.near_duplicate_groups(frame(spark, texts)))
    for i, want in enumerate(jaccard_brute(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == want, texts[i]


def test_join_crowd_of_near_copies(spark):
    """More members than a small posting list, in chains whose ends are not alike."""
    base = prose(5, 120)
    texts = [" ".join(base[: 120 - k] + prose(9000 + k, k // 3)) for k in range(60)]
    got = rows_of(ngram_join.near_duplicate_groups(frame(spark, texts)))
    for i, want in enumerate(jaccard_brute(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == want


def test_join_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "frequency_ranks", lambda counts, f=ngram_join.frequency_ranks: (f(counts)[0], 8))
    common = prose(77, 30)
    texts = [" ".join([*common, *prose(300 + k, 6 + k % 9)]) for k in range(50)] + [" ".join(prose(600 + k, 40)) for k in range(20)]
    got = rows_of(ngram_join.near_duplicate_groups(frame(spark, texts)))
    for i, want in enumerate(jaccard_brute(texts)):
        assert got[i]["component_id"] == want[1]


def test_join_common_passage(spark):
    """A passage in 300 texts, at every share of their words, and near copies among them."""
    common = prose(78, 60)
    texts = [" ".join([*prose(4000 + k, k % 31), *common, *prose(5000 + k, k % 7)]) for k in range(280)]
    texts += [" ".join([*common[k % 5 :], *prose(6000, 12), *prose(7000 + k, k % 3)]) for k in range(20)]
    got = rows_of(ngram_join.near_duplicate_groups(frame(spark, texts)))
    for i, want in enumerate(jaccard_brute(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == want


def test_join_sets_that_share_a_hash(spark, monkeypatch):
    """Sets whose 64-bit ids are equal are told apart by their other 64 bits."""
    real = ngram_join._identity
    monkeypatch.setattr(ngram_join, "_identity", lambda keys: (len(keys) % 3, real(keys)[1]) if len(keys) else (0, 0))
    texts = [" ".join(prose(k, 12 + k % 9)) for k in range(30)] + [" ".join(prose(k, 12 + k % 9)) + " end" for k in range(9)]
    members, classes, again = ngram_join.members_and_classes(frame(spark, texts))
    assert again and classes.count() == len({frozenset(s) for s in word_sets(texts)})


def test_join_drops_by_row(spark):
    """A doc_id with two texts is two documents; of two near copies with one doc_id, one stays; null ids are decided too."""
    a, b = prose(1, 60), prose(2, 60)
    near = " ".join([*a, "x"])
    docs = frame(spark, [" ".join(a), near, " ".join(b), " ".join(a), near, "other words"], [1, 1, 1, None, None, 2])
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(docs).select("doc_id", "text").collect()]
    assert len(kept) == 3 and (1, " ".join(b)) in kept and (2, "other words") in kept
    assert {i for i, _ in kept} == {1, 2}


def test_join_odd_rows(spark, odd):
    got = ngram_join.near_duplicate_groups(odd).collect()
    assert len(got) == len(ODD) + 1
    assert {r["n_shingles"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and 8 not in {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_suffix_filter_never_loses_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(r.integers(0, 120, r.integers(1, 90)).astype(np.uint64))
        y = np.unique(r.integers(0, 120, r.integers(1, 90)).astype(np.uint64))
        both, whole = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert ngram_join.links(x, y) == (100 * both >= 75 * whole)
