"""Personal data by patterns, checksums and context, native DataFrame operations only.

Patterns propose spans, validators (octet range, Luhn, digit counts, mod-97, mix of letters and digits) drop the false ones,
and words near a span raise its score. Everything is one map over the table: no shuffle.

Positions come from cutting the text at the matches: the lengths of the pieces and of the matches
add up to the offsets. The patterns are written so that a run of characters is tried once
(possessive quantifiers, and a look-behind that only lets a run start at its first character), so
time stays linear in the text; the matches are those of the plain patterns in their docstrings.

Defined cases: a null text counts as empty; an empty text has no spans; rows are independent, so
repeated rows repeat their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMED = r"""(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20{0,3}[=:]\x20{0,3}["']?"""
#: kind -> (pattern, cheap test that any matching text passes, base score, context words)
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
        0.8,
        r"(?i)\b(e-?mail|mail|contact|kontakt|contacto|correo|courriel|write|from|to)\b",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]{1,}+\.[0-9]{1,}+\.[0-9]",
        0.6,
        r"(?i)\b(ip|host|server|address|client|login|addr)\b",
    ),
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits: only whole chains of that many digits are taken
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        r"[0-9](?:[\x20-]?[0-9]){13}",
        0.7,
        r"(?i)\b(card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta|payment)\b",
    ),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        0.5,
        r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone)\b",
    ),
    # an account number of ISO 13616 shape, in one piece or in groups of four
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        0.8,
        r"(?i)\b(iban|account|konto|compte|cuenta|bank|bic|swift)\b",
    ),
    # a value of 16 or more characters given to a name such as token, the name included
    "secret": (
        rf"(?i)\b{_NAMED}[A-Za-z0-9+/_=.-]{{16,}}+",
        rf"(?i)\b{_NAMED}[A-Za-z0-9+/_=.-]{{16}}",
        0.7,
        r"(?i)\b(login|auth|authorization|bearer|credentials?|config|env|export)\b",
    ),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_BONUS = 48, 0.2
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod97(match)
    if kind == "secret":  # random values mix letters and digits, names and prose do not
        value = F.regexp_replace(match, f"^(?i){_NAMED}", "")
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(kind: str, text: Column) -> Column:
    """Valid spans of one kind, in order."""
    pattern, hint, score, words = KINDS[kind]
    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")),
    )
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    good = F.filter(found, lambda s: _valid(kind, s["m"]))

    def scored(s):
        before = F.substring(text, F.greatest(s["start"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        near = before.rlike(words) | after.rlike(words)
        return F.struct(
            s["start"].alias("start"),
            F.lit(list(KINDS).index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        )

    return F.when(text.rlike(hint), F.transform(good, scored)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def find_pii(docs: DataFrame) -> DataFrame:
    """docs' doc_id with one array column: found, structs (start, rank, end, kind, score) by start, then kind."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = rows.select("doc_id", *(_spans(k, F.col("text")).alias(k) for k in KINDS))
    return each.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("found"), *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS))


def mask_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with each span of at least that score replaced in text by its kind in brackets.

    Spans that begin inside an earlier one are covered by the earlier one's mask.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    each = rows.select(*rest, "text", F.array_sort(F.concat(*(_spans(k, F.col("text")) for k in KINDS))).alias("__found"))

    def step(acc, s):
        hit = (s["score"] >= least) & (s["start"] >= acc["at"])
        text = F.concat(
            acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")
        )
        return F.struct(F.when(hit, s["end"]).otherwise(acc["at"]).alias("at"), F.when(hit, text).otherwise(acc["text"]).alias("text"))

    masked = F.aggregate(
        "__found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        step,
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return each.withColumn("text", masked).select(*docs.columns)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in BASE),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        "n_iban",
        "n_secret",
        F.size("found").cast("bigint").alias("n_spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


ORACLE = None
