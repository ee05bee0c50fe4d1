"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.  DataFrame operations only.

Base kinds (email, ip, card, phone) follow the query's contract.  Added: ``iban``, confirmed by mod-97.  Every span has a
score: a prior by kind, raised where a context word of its kind stands within CONTEXT characters before it.  The score
ranks spans for redaction; it drops no span.

Edge cases: null texts count as empty; empty tables give no rows; rows repeating an id are scanned row by row; extra
columns are ignored; ids may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .secrets import CONTEXT, span_sql
from .spans import digits, keep, listed, luhn, matches

# The base patterns, with a possessive form that finds the same matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# Priors and context words.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
WORDS = {
    "email": "e-?mail|contact|courriel|correo",
    "ip": "ip.?addr|address|server|host",
    "card": "card|visa|master|carte|karte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
KINDS = ("email", "ip", "card", "phone", "iban")


def mod97(text: Column) -> Column:
    """Whether an IBAN's rearranged digits leave 1 when divided by 97."""
    flat = F.translate(text, " ", "")
    moved = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)) == 1


def rules(text: Column) -> dict[str, Column]:
    n_digits = lambda m: F.length(digits(m))
    parts = lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    # A text without a run of twelve digits has no card; the cheap test spares most texts the list of all numbers.
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), keep(matches(text, CARD), lambda m: n_digits(m).between(12, 19) & F.when(n_digits(m).between(12, 19), luhn(m)).otherwise(False)))
    return {
        "email": matches(text, EMAIL),
        "ip": keep(matches(text, IP), parts),
        "card": F.coalesce(card, F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")),
        "phone": keep(matches(text, PHONE), lambda m: n_digits(m).between(9, 15)),
        "iban": keep(matches(text, IBAN), mod97),
    }


def raised(kind: str) -> float:
    return 1 - (1 - PRIOR[kind]) / 2


def scored(text: Column, kind: str, spans: Column) -> Column:
    """The spans with a score; context words within CONTEXT characters before a span raise it."""
    def one(s):
        lead = F.lower(text.substr(F.greatest(s["start"].cast("int") + 1 - CONTEXT, F.lit(1)), F.least(s["start"].cast("int"), F.lit(CONTEXT))))
        near = F.when(lead.rlike(WORDS[kind]), raised(kind)).otherwise(PRIOR[kind])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), near.alias("score"))

    return F.transform(spans, one)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, one array of confirmed spans per kind); one projection over the texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rules(F.col("text"))
    return rows.select("id", "text", *(found[k].alias(k) for k in KINDS))


def scored_spans(found: DataFrame) -> DataFrame:
    """(id, spans): all spans of a text with kind, place and score, by place."""
    return found.select("id", F.array_sort(F.concat(*(scored(F.col("text"), k, F.col(k)) for k in KINDS)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    base = [(k, F.col(k)) for k in KINDS[:4]]
    best = F.array_max(F.concat(*(F.transform(scored(F.col("text"), k, F.col(k)), lambda s: s["score"]) for k in KINDS)))
    return found.select(
        F.col("id").alias("doc_id"), *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base),
        F.sha2(listed(base), 256).alias("base_sha256"), listed([(k, F.col(k)) for k in KINDS]).alias("spans"), F.coalesce(best, F.lit(0.0)).alias("top_score"))


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE (substr(reverse({_DIGITS}), i, 1)::INT * 2) // 10 + (substr(reverse({_DIGITS}), i, 1)::INT * 2) % 10 END)) % 10 = 0"
_IBAN_SQL = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
_FLAT = "replace(m, ' ', '')"
_MOD97 = f"list_reduce([0] || list_transform(string_split(substr({_FLAT}, 5) || substr({_FLAT}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
OP7_SQL = span_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    ("phone", PHONE, f"len({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", _IBAN_SQL, _MOD97),
], 4, {k: (PRIOR[k], raised(k), WORDS[k]) for k in KINDS})
