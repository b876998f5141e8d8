"""Decontamination, mixing, chat formatting and the pipeline."""

from __future__ import annotations

import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD, frame, prose, rows_of
from lapforge.llm import chat_format, decontaminate, mixing

DATA = "/root/testdata/sf0.001"


def benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def test_decontamination_finds_planted_passages(spark):
    items = [" ".join(prose(50 + k, 30)) for k in range(5)]
    texts, want = [], []
    r = random.Random(1)
    for k in range(20):
        clean = prose(500 + k, 120)
        texts.append(" ".join(clean))
        want.append(None)
        passage = items[k % 5].split()[2:26]
        for at in r.sample(range(len(passage)), k % 3):  # up to two words replaced
            passage[at] = "changed"
        texts.append(" ".join(clean[:40] + passage + clean[40:]))
        want.append(k % 5)
    found = decontaminate.find_overlaps(frame(spark, texts), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, w) for i, w in enumerate(want) if w is not None}
    kept = decontaminate.drop_contaminated(frame(spark, texts), benchmark(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if w is None}


def test_seeds_tolerate_substitutions_under_zeros():
    import numpy as np

    words = np.arange(1, 40, dtype=np.uint64)
    mask = decontaminate.MASKS[0]
    seeds = decontaminate._seeds(words, mask)
    zero = mask.index("0")
    changed = words.copy()
    changed[10 + zero] = np.uint64(999)
    assert decontaminate._seeds(changed, mask)[10] == seeds[10]
    assert decontaminate._seeds(changed, mask)[10 + zero] != seeds[10 + zero]


def test_every_accepted_pattern_holds_a_mask():
    import numpy as np

    masks = [(int(m, 2), len(m)) for m in decontaminate.MASKS]
    missed = []
    for n in range(8, 17):
        for inner in range(1 << (n - 2)):
            p = (1 << (n - 1)) | (inner << 1) | 1
            if 4 * p.bit_count() < 3 * n or p.bit_count() < decontaminate.LEAST_MATCH:
                continue
            if any((p >> k) & m == m for m, size in masks for k in range(n - size + 1)):
                continue
            equal = np.array([c == "1" for c in f"{p:b}"])
            if decontaminate.best_stretch(equal) == (p.bit_count(), 0, n):
                missed.append(f"{p:b}")
    assert missed == []


def test_four_words_a_substitution_and_four_words_are_found(spark):
    item, clean = prose(60, 30), prose(600, 40)
    passage = [*item[10:14], "changed", *item[15:19]]
    found = decontaminate.find_overlaps(frame(spark, [" ".join(["before", *passage, "after"]), " ".join(clean)]), benchmark(spark, [" ".join(item)])).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal"], r["n_words"]) for r in found] == [(0, 0, 8, 9)]


def test_decontamination_odd_rows(spark, odd, empty):
    items = benchmark(spark, ["", None, "short", "one two three four five six seven eight nine ten"])
    assert decontaminate.find_overlaps(odd, items).count() == 0
    assert decontaminate.drop_contaminated(odd, items).count() == len(ODD) + 1
    assert decontaminate.find_overlaps(empty, items).count() == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == len(ODD) + 1


def mixed(spark, sizes):
    texts, sources = [], []
    for name, n in sizes.items():
        for k in range(n):
            texts.append(" ".join(["t"] * (5 + k % 11)))
            sources.append(name)
    return frame(spark, texts, sources=sources)


def test_mixture_meets_entropy_and_budget(spark):
    docs = mixed(spark, {"big": 600, "mid": 200, "low": 100, None: 60})
    mixture = mixing.Mixture(entropy_share=0.95, max_repeats=10.0)
    got = mixing.mix_sources(docs, mixture).collect()
    tokens, available = {}, {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    for r in docs.collect():
        available[r["source"]] = available.get(r["source"], 0) + len(r["text"].split())
    total = sum(available.values())
    assert abs(sum(tokens.values()) - total) <= 16 * len(available)
    share = [v / sum(tokens.values()) for v in tokens.values()]
    assert -sum(p * math.log(p) for p in share) >= 0.95 * math.log(4) - 0.01
    assert sorted(available, key=lambda s: available[s]) == sorted(tokens, key=lambda s: tokens[s])


def mixture_by_hand(rows, mixture):
    """Exponent, budgets and the documents read, by plain Python. rows: (doc_id, source, tokens)."""
    per = {}
    for _, s, k in rows:
        per[s] = per.get(s, 0) + k
    per = {s: k for s, k in per.items() if k}
    total = sum(per.values())

    def weights(a):
        raw = {s: (k / total) ** a for s, k in per.items()}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    goal = mixture.entropy_share * math.log(len(per))
    if mixture.close_gap is not None:
        goal = entropy(weights(1.0)) + mixture.close_gap * (math.log(len(per)) - entropy(weights(1.0)))
    repeats = lambda a: max(mixture.budget_share * weights(a)[s] * total / per[s] for s in per)

    def least(wrong):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if wrong(mid) else (low, mid)
        return high

    exponent = 1.0 if entropy(weights(1.0)) >= goal else least(lambda a: entropy(weights(a)) > goal)
    exponent = max(exponent, 0.0 if repeats(0.0) <= mixture.max_repeats else least(lambda a: repeats(a) > mixture.max_repeats))
    return exponent, {s: w * total * mixture.budget_share for s, w in weights(exponent).items()}, per


@pytest.mark.parametrize("mixture", [mixing.Mixture(close_gap=0.5), mixing.Mixture(entropy_share=0.99, budget_share=1.6), mixing.Mixture(close_gap=0.8, max_repeats=1.5, budget_share=0.7)])
def test_mixture_brute(spark, mixture, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)  # several blocks a source
    r = random.Random(11)
    sizes = {"big": 160, "mid": 40, "small": 9}
    texts, sources = [], []
    for s, k in sizes.items():
        for _ in range(k):
            texts.append(" ".join(prose(len(texts), r.randint(5, 40))))
            sources.append(s)
    docs = frame(spark, texts, sources=sources)
    rows = [(i, s, len(t.split())) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    exponent, budgets, per = mixture_by_hand(rows, mixture)
    got = mixing.mix_sources(docs, mixture, explain=True).collect()
    assert 0 < exponent < 1
    longest = max(k for _, _, k in rows)
    for s, budget in budgets.items():
        mine = [x for x in got if x["source"] == s]
        assert mine[0]["exponent"] == pytest.approx(exponent, abs=1e-6) and mine[0]["budget"] == pytest.approx(budget, abs=1)
        read = sum(x["n_tokens"] for x in mine)
        assert mine[0]["budget"] <= read < mine[0]["budget"] + longest
        whole = mine[0]["budget"] // per[s]
        ids = {i for i, t, _ in rows if t == s}
        for epoch in range(whole):
            assert {x["doc_id"] for x in mine if x["epoch"] == epoch} == ids and sum(x["epoch"] == epoch for x in mine) == len(ids)
        last = [x for x in mine if x["epoch"] == whole]
        assert len({x["doc_id"] for x in last}) == len(last)
        # the last epoch is a run of whole blocks in the permutation's order, then the first documents of one block
        everyone = {}
        for x in mixing.mix_sources(docs, mixing.Mixture(entropy_share=0.0, budget_share=float(whole + 1), max_repeats=1e9)).collect():
            if x["source"] == s and x["epoch"] == whole:
                everyone.setdefault(x["block"], []).append((x["place"], x["doc_id"]))
        order = sorted((x["place"], x["doc_id"], x["block"]) for x in last)
        cut = [b for b in {x["block"] for x in last} if len(everyone[b]) > sum(x["block"] == b for x in last)]
        assert len(cut) <= 1
        for b in cut:
            assert [d for _, d, k in order if k == b] == [d for _, d in sorted(everyone[b])[: sum(k == b for _, _, k in order)]]
            assert b == max(x["block"] for x in last)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_registered_mixture_binds(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = mixing.query(spark, f"/root/testdata/{sf}")
        row = got.first()
        assert 0 < row["exponent"] < 1
        share = got.groupBy("source").agg({"weight": "first", "epoch": "max", "n_tokens": "sum"}).collect()
        assert sum(r[1] for r in share) == pytest.approx(1) and {r[2] for r in share} == {0, 1}


def test_mixture_obeys_the_repetition_limit(spark):
    docs = mixed(spark, {"big": 900, "tiny": 10})
    got = mixing.mix_sources(docs, mixing.Mixture(entropy_share=1.0, max_repeats=3.0)).filter("source = 'tiny'").collect()
    per_doc = {}
    for r in got:
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + 1
    assert len(per_doc) == 10 and max(per_doc.values()) <= 3 and min(per_doc.values()) >= 2


def test_mixture_whole_passes_and_repeatable(spark):
    docs = mixed(spark, {"a": 50, "b": 50})
    one = mixing.mix_sources(docs, carry=("text", "lang")).collect()
    two = mixing.mix_sources(docs.repartition(7), carry=("text", "lang")).collect()
    assert sorted(one) == sorted(two)
    assert {r["doc_id"] for r in one} == set(range(100)) and all(len(r["text"].split()) == r["n_tokens"] for r in one)


def test_mixture_odd_rows(spark, odd, empty):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd).count() == len(ODD) + 1
    blank = frame(spark, ["", None, "a b c"], sources=["none", "none", "some"])
    assert {r["source"] for r in mixing.mix_sources(blank).collect()} == {"some"}


@pytest.mark.parametrize("blocks", [1, 3])
def test_mixture_with_cells_reads_a_prefix(spark, monkeypatch, blocks):
    """So many tokens a block that cells split it: the last pass is a prefix in the order (block, cell, place)."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(mixing, "MAX_BLOCKS", blocks + 3)
    docs = mixed(spark, {"big": 700, "small": 90, None: 40})
    for share in (0.3, 0.7):
        got = mixing.mix_sources(docs, mixing.Mixture(entropy_share=0.0, budget_share=share), explain=True).collect()
        every = mixing.mix_sources(docs, mixing.Mixture(entropy_share=0.0, budget_share=1.0)).collect()
        for s in ("big", "small", None):
            order = [(x["block"], x["cell"], x["place"], x["doc_id"], x["n_tokens"]) for x in every if x["source"] == s]
            total, want = 0, []
            for row in sorted(order):
                if total >= round(share * sum(r[4] for r in order)):
                    break
                want.append(row[3])
                total += row[4]
            assert sorted(want) == sorted(x["doc_id"] for x in got if x["source"] == s)
        assert len({(x["block"], x["cell"]) for x in every if x["source"] == "big"}) > blocks + 3


def test_mixture_rows_without_id_and_repeats(spark):
    texts = [f"word {k} of a text" for k in range(200)] + ["the same again"] * 100
    docs = frame(spark, texts, [None] * 150 + list(range(50)) + [7000] * 100, sources=["a"] * 300)
    got = mixing.mix_sources(docs, mixing.Mixture(budget_share=0.5)).collect()
    again = sum(r["doc_id"] == 7000 for r in got)
    read = sum(r["n_tokens"] for r in got)
    assert again in (0, 100) and 650 <= read < 650 + (300 if again else 5)
    assert len({r["place"] for r in got if r["doc_id"] is None}) == sum(r["doc_id"] is None for r in got) > 30


TURNS = "conv_id bigint, turn bigint, role string, text string, a string, chat int"


def chats(spark, convs):
    rows = [(c, t, role, text, "x", 0) for c, turns in convs for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


def chat_brute(convs):
    said = {c: tuple((role or "unknown", text or "") for role, text in turns) for c, turns in convs}
    groups = {}
    for c, s in said.items():
        groups.setdefault(s, []).append(c)
    proper = {s[:k] for s in said.values() for k in range(1, len(s))}
    return {min(ids): (len(s), len(ids)) for s, ids in groups.items() if s not in proper}


def test_chats_keep_maximal_conversations(spark):
    r = random.Random(4)
    convs, c = [], 0
    for k in range(40):
        turns = [(r.choice(["user", "assistant", None]), r.choice(["hi", f"t{k}", "", None, "long " * 50])) for _ in range(r.randrange(1, 7))]
        for n in sorted({len(turns), r.randrange(1, len(turns) + 1)}):
            convs.append((c, turns[:n]))
            c += 1
    convs += [(c, convs[0][1]), (c + 1, convs[0][1])]
    got = rows_of(chat_format.format_chats(chats(spark, convs)), "conv_id")
    assert {k: (v["n_turns"], v["n_copies"]) for k, v in got.items()} == chat_brute(convs)


def test_chat_rendering_and_odd_rows(spark):
    got = rows_of(chat_format.format_chats(chats(spark, [(None, [(None, None)]), (2, [("user", "a"), ("assistant", "b")])])), "conv_id")
    assert got[2]["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>"
    assert got[None]["chat"] == "<|im_start|>unknown\n<|im_end|>" and got[None]["n_chars"] == len(got[None]["chat"])
    assert chat_format.format_chats(chats(spark, [])).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_dedup import exact_brute, jaccard_brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        at[name] = docs
        if name != "source_mixing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    first = sorted((r["doc_id"], r["text"]) for r in at["language_id"].select("doc_id", "text").collect())
    assert {r["doc_id"] for r in at["exact_dedup"].collect()} == {keep for keep, _ in exact_brute(first).values()}
    second = sorted((r["doc_id"], r["text"]) for r in at["exact_dedup"].select("doc_id", "text").collect())
    root = jaccard_brute([t for _, t in second])
    assert {r["doc_id"] for r in at["ngram_jaccard"].collect()} == {second[i][0] for i, (n, c) in enumerate(root) if c == i}
    known = {r["doc_id"] for r in at["decontaminate"].collect()}
    assert {r["doc_id"] for r in at["source_mixing"].collect()} <= known


def test_pipeline_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    benchmark(spark, ["some benchmark text that is long enough to have seeds in it"]).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert "doc_id" in docs.columns


def overlap_brute(text, item):
    """Most equal words of the best stretch, +1 for an equal word and -3 for another, of any gapless alignment, by trying all."""
    a, b = (re.findall(r"[a-z0-9]+", x.lower()) for x in (text, item))
    most = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [a[i] == b[i - shift] for i in range(max(0, shift), min(len(a), shift + len(b)))]
        stretches = [(sum(1 if x else -3 for x in same[s:e]), -e, -s, sum(same[s:e])) for s in range(len(same)) for e in range(s + 1, len(same) + 1)]
        most = max(most, max(stretches, default=(0, 0, 0, 0))[3])
    return most


def test_decontamination_brute(spark):
    """Substitutions at every rate, against an aligner that tries everything."""
    r = random.Random(4)
    items = [" ".join(prose(50 + k, 20)) for k in range(4)]
    texts = []
    for k in range(60):
        passage = items[k % 4].split()[k % 5 : 20 - k % 3]
        for at in r.sample(range(len(passage)), r.randrange(0, 9)):
            passage[at] = f"other{r.random()}".replace(".", "")
        texts.append(" ".join([*prose(700 + k, 30), *passage, *prose(800 + k, 20)]))
    found = {(f["doc_id"], f["item_id"]) for f in decontaminate.find_overlaps(frame(spark, texts), benchmark(spark, items)).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if overlap_brute(t, item) >= decontaminate.LEAST_MATCH}
    assert found == want


def test_decontamination_short_items(spark):
    items = ["the quick brown fox", "seven words in a row are one", "Alone!", "", "the quick brown"]
    texts = ["see The quick, brown fox run", "the quick red brown fox", "here seven words in a row are one item", "seven words in a row are", "all alone here", None]
    found = {(f["doc_id"], f["item_id"]) for f in decontaminate.find_overlaps(frame(spark, texts), benchmark(spark, items)).collect()}
    assert found == {(0, 0), (0, 4), (2, 1), (4, 2)}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, texts), benchmark(spark, items)).collect()}
    assert kept == {0, 1, 3, 4, 5}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, texts), benchmark(spark, items), least_words=4).collect()}
    assert kept == {1, 3, 4, 5}


def test_decontamination_item_in_every_document(spark, tmp_path):
    """A one-word item that stands everywhere drops nothing and is reported in its own column."""
    passage = " ".join(prose(500, 30))
    texts = [" ".join([*prose(k, 40), "the", *prose(k + 100, 10)]) for k in range(60)] + ["the " + passage]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark, ["the", passage]).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r["doc_id"]: r for r in decontaminate.query(spark, str(tmp_path)).collect()}
    assert all(r["n_short_items"] == 1 for r in rows.values())
    assert [k for k, r in rows.items() if r["contaminated"]] == [60]
    assert (rows[60]["n_items"], rows[60]["item_id"], rows[60]["n_equal"]) == (1, 1, 30)
    assert (rows[0]["n_items"], rows[0]["item_id"], rows[0]["n_equal"]) == (0, None, None)
    docs, items = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))
    assert decontaminate.drop_contaminated(docs, items).count() == 60


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named like those that stages use inside come through every stage but the last."""
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(prose(1, 20)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ("score", "lang_pred", "k0", "__text", "id", "mark", "row", "kept", "item_id", "cls")
    docs = frame(spark, [" ".join(prose(k, 30)) for k in range(12)], langs=["en", "de"] * 6)
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.select(*dict.fromkeys(docs.columns))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert set(names) <= set(docs.columns)
    assert docs.select("score", "lang_pred").distinct().collect() == [("score", "lang_pred")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
