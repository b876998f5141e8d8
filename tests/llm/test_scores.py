"""Language, tokens, personal data and toxicity."""

from __future__ import annotations

import hashlib
import math
import re
from pathlib import Path

import pytest

from conftest_llm import ODD, frame, prose, rows_of
from lapforge.llm import language_id, pii, token_count, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
WORDS = {
    "en": "the house and water with there which would people about through because".split(),
    "de": "das haus und wasser mit dort welche würde leute über durch weil".split(),
    "fr": "la maison et eau avec là lequel serait gens environ travers parce".split(),
}


def language_docs(spark, per=60):
    texts, langs = [], []
    for lang, words in WORDS.items():
        for k in range(per):
            texts.append(" ".join(words[(k * 7 + j * (k + 1)) % len(words)] for j in range(12)))
            langs.append(lang)
    return frame(spark, [*texts, None, "", "123 456 !!!"], langs=[*langs, "en", None, "en"])


def test_language_of_small_corpus(spark):
    docs = language_docs(spark)
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        want = r["lang"] if r["text"] and re.search("[a-z]", r["text"]) else "und"
        assert got[r["doc_id"]]["lang_pred"] == want
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    assert got[180]["score"] == 0


def grams_by_hand(text):
    """Cells of all n-grams of a text's letters, a space before and after, letter by letter."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    for k in language_id.ORDERS:
        for at in range(len(line) - k + 1):
            gram = line[at : at + k]
            if gram == " ":
                continue
            h = 0x811C9DC5
            for c in gram:
                h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            yield ((h * 0x9E3779B1) & 0xFFFFFFFF) >> 16


def test_language_brute(spark):
    """The same naive Bayes with dictionaries, one text after the other."""
    docs = language_docs(spark, 12)
    learnt = [(r["text"], r["lang"]) for r in docs.collect() if r["text"] is not None and r["lang"] is not None]
    counts, shares = {}, {}
    for text, lang in learnt:
        shares[lang] = shares.get(lang, 0) + 1
        cells = counts.setdefault(lang, {})
        for c in grams_by_hand(text):
            cells[c] = cells.get(c, 0) + 1
    size = {lang: sum(n.values()) + 0.5 * language_id.CELLS for lang, n in counts.items()}
    texts = [*[t for t, _ in learnt[::5]], "Straße über 12 Brücken", "l'été où", "x", "the und les", "a-b c.d", "?!"]
    got = rows_of(language_id.identify(frame(spark, texts), language_id.fit(docs)))
    for i, text in enumerate(texts):
        sums = {
            lang: math.log(shares[lang] / len(learnt)) + sum(math.log((counts[lang].get(c, 0) + 0.5) / size[lang]) for c in grams_by_hand(text)) for lang in counts
        }
        best = max(sorted(sums), key=sums.get)
        sure = 1 / sum(math.exp(v - sums[best]) for v in sums.values())
        if not any(c.isalpha() for c in text):
            best, sure = "und", 0.0
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(sure, abs=1e-4)


def test_language_text_does_not_depend_on_its_neighbours(spark):
    docs = language_docs(spark)
    model = language_id.fit(docs)
    alone = rows_of(language_id.identify(docs.filter("doc_id = 5"), model))[5]
    among = rows_of(language_id.identify(docs, model))[5]
    assert alone["score"] == pytest.approx(among["score"], abs=1e-9)


def test_language_odd_rows(spark, odd, empty):
    model = language_id.fit(language_docs(spark))
    assert language_id.identify(odd, model).count() == len(ODD) + 1
    assert language_id.identify(empty, model).count() == 0
    unlearned = language_id.identify(odd, language_id.fit(empty)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert language_id.keep_identified(empty).columns == empty.columns


@needs_data
def test_language_held_out_accuracy(spark):
    langs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").filter("lang is not null")
    got = language_id.query(spark, DATA).filter("held_out and lang_pred <> 'und'").join(langs, "doc_id")
    right = got.filter("lang = lang_pred").count() / got.count()
    assert right > 0.95


def test_tokens_equal_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = token_count.default_tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    texts = [r["text"] for r in odd.collect()]
    texts += ["Hello  world\n\n  it's   fine, isn't it?", "a" * 3000, "<|endoftext|>x <|endoftext|>", "  x\x00y", "ⅷ x² 漢字かな交じり文 🙂🙃", "aaaa aaab\tzz", "THE the ThE", "'S 'll'"]
    docs = frame(spark, texts)
    got = rows_of(token_count.count_tokens(docs))
    for i, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_tokens"] == want, t and t[:40]
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (want > 1024)


@needs_data
def test_tokens_equal_the_library_on_documents(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_count.default_tokenizer())
    library.no_truncation()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in token_count.query(spark, DATA).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_tokens_of_an_empty_table(empty):
    assert token_count.count_tokens(empty).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


PRIVATE = [
    "mail me: a.b+c@ex-ample.co.uk, or x@y.z@q.r; @no.local a@b",
    "a@b.c.@d.e _x@d.e%y@z.w a@b.c_x@d.e",
    "ip 1.2.3.4.5.6.7.8 and 999.1.1.1 1.2.3 010.0.0.255 1.2.3.256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 0",
    "tail 378282246310005 1 4111  1111 1111 1111 30569309025904",
    "call +1 (212) 555-0100 or +49 30 123456 or ++123456789012 +1",
    "🙂 +44 20 7946 0958 🙂 u@v.io é 10.0.0.1",
    "iban DE89 3704 0044 0532 0130 00, bank GB82WEST12345698765432 no DE89370400440532013001",
]


def test_pii_base_spans(spark, odd):
    texts = [*PRIVATE, *[r["text"] for r in odd.collect()], "+1 " * 2000, "a" * 5000 + "@", "1." * 3000, "1 " * 3000]
    got = rows_of(pii.find_pii(frame(spark, texts)))
    for i, t in enumerate(texts):
        base = [(s["start"], s["rank"], s["end"], s["kind"]) for s in got[i]["found"] if s["rank"] < 4]
        assert base == base_spans(t or ""), t and t[:60]
    kinds = [s["kind"] for s in got[7]["found"]]
    assert kinds.count("iban") == 2


@needs_data
def test_pii_query_on_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.query(spark, DATA).collect():
        want = base_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[3] == k for w in want) for k in BASE]


def test_pii_secrets(spark):
    token = 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'
    texts = [f"the {token} of it", f"{token} {token}", 'api_key: "x1"', "token = abcdefghijklmnopqrst", "a token of 1234567890123456 x"]
    got = rows_of(pii.find_pii(frame(spark, texts)))
    for i, text in enumerate(texts):
        want = [(m.start(), m.end()) for m in re.finditer('token = "[0-9a-f]{40}', text)]
        assert [(s["start"], s["end"]) for s in got[i]["found"] if s["kind"] == "secret"] == want, text


@needs_data
def test_pii_secrets_on_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in pii.query(spark, DATA).collect()}
    for i, text in texts.items():
        assert got[i]["n_secret"] == len(re.findall('\\btoken = "(?=[0-9a-f]{40}")', text))
        assert got[i]["n_spans"] == sum(got[i][f"n_{k}"] for k in pii.KINDS)


def test_pii_mask_and_empty(spark, empty):
    docs = frame(spark, ["write to a@b.co now", None])
    got = rows_of(pii.mask_pii(docs))
    assert got[0]["text"] == "write to [email] now" and got[1]["text"] == ""
    assert pii.find_pii(empty).count() == 0 and pii.mask_pii(empty).columns == empty.columns


def test_fold():
    assert toxicity.fold("1D10T Ídіot x2") .split() == ["idiot", "idiot", "x"]


def toxic_docs(spark):
    calm = ["the garden is calm and green today", "we walk along the river in spring", "bread and butter for the morning"]
    rude = ["you zorgid fool go away", "what a zorgid mess you are", "zorgid people everywhere here"]
    texts = [f"{(rude if k % 2 else calm)[k // 2 % 3]} number{k} alpha{k * 7} beta{k * 13} gamma{k * 3}" for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400)], "doc_id bigint, toxic int")
    return frame(spark, [*texts, "so z0rg1d again", None, ""]), labels


def test_toxicity_learns_a_word(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    assert any("zorgid".startswith(t.strip()[:4]) for t in model.lexicon)
    got = rows_of(toxicity.score_toxicity(docs, model))
    assert got[1]["predicted"] == 1 and got[0]["predicted"] == 0 and got[400]["predicted"] == 1
    assert got[401]["score"] == got[402]["score"] and got[401]["predicted"] == 0


def test_toxicity_odd_rows(spark, odd, empty):
    docs, labels = toxic_docs(spark)
    none = labels.filter("doc_id < 0")
    assert toxicity.score_toxicity(odd, toxicity.fit(docs, labels)).count() == len(ODD) + 1
    assert {r["score"] for r in toxicity.score_toxicity(odd, toxicity.fit(odd, none)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, none)).count() == 0


def test_toxicity_several_labels_of_one_document(spark):
    docs, labels = toxic_docs(spark)
    bad = labels.filter("toxic = 1").first()["doc_id"]
    more = labels.unionByName(spark.createDataFrame([(bad, 0, 0)], labels.schema) if len(labels.columns) == 3 else spark.createDataFrame([(bad, 0)], labels.schema))
    once = {r["doc_id"]: r["toxic"] for r in toxicity.training_rows(docs, labels).collect()}
    twice = {r["doc_id"]: r["toxic"] for r in toxicity.training_rows(docs, more).collect()}
    assert once == twice


def test_toxicity_common_line_is_no_near_copy(spark):
    line = "this very same licence line stands at the end of every text here"
    texts = [" ".join(prose(i, 60)) + " " + line for i in range(30)] + [" ".join(prose(0, 60)) + " " + line]
    labels = spark.createDataFrame([(i, 0) for i in range(31)], "doc_id bigint, toxic int")
    got = {r["doc_id"] for r in toxicity.training_rows(frame(spark, texts), labels).collect()}
    assert got == set(range(30))


def test_toxicity_matches_brute():
    """The longest term at each place, against a plain search."""
    model = toxicity.ToxicityModel(lexicon={" foul ": 2.0, " fou": 1.0, " vile ": 3.0, " vilest": 4.0}, exceptions={"not foul"})
    automaton = model.matcher()
    for text in ("foul", "a foul fountain of VILE v1lest", "not foul but foul", "", "vile vile", "f0ul\u0301 thing"):
        folded = toxicity.fold(text)
        found, at = [], 0
        while at < len(folded):
            here = [t for t in model.lexicon if folded.startswith(t, at)]
            if here:
                term = max(here, key=len)
                found.append(model.lexicon[term])
                at += len(term)
            else:
                at += 1
        assert [w for w, _ in model.matches(automaton, folded)] == found
    kept = [w for w, around in model.matches(automaton, toxicity.fold("not foul but foul")) if model.exceptions.isdisjoint(around)]
    assert kept == [2.0]


def test_toxicity_beginnings_count_words():
    terms = toxicity.terms_of(toxicity.fold("snarl snarling snarled ox"))
    assert terms[" snar"] == 3 and terms[" snarl"] == 2 and terms[" snarl "] == 1 and terms[""] == 4 and " ox " not in terms


@needs_data
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.query(spark, DATA).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit >= 0.7 * sum(r["toxic"] == 1 for r in got)
    assert hit >= 0.7 * sum(r["predicted"] == 1 for r in got)
