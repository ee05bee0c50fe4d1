"""Spans of pattern matches as DataFrame expressions, shared by the secret and PII scans.

A match list is array<struct<start,end,m>>: code point offsets, end exclusive, and the matched text.  Splitting a text at a
pattern gives the gaps, extracting gives the matches, and running sums of their lengths give the places; both use the same
leftmost non-overlapping search.  Patterns here are possessive where they loop over groups, so that no text, however long,
makes the engine recurse or backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in ``text`` with their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPAN))


def keep(spans: Column, test) -> Column:
    """The spans whose matched text passes ``test`` (a function from Column to Column)."""
    return F.filter(spans, lambda s: test(s["m"]))


def listed(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, by start, then by the order of kinds, comma-joined."""
    def tag(i: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("t"))

    tagged = [F.transform(spans, tag(i, kind)) for i, (kind, spans) in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: s["t"]), ",")


def digits(text: Column) -> Column:
    return F.translate(text, " -+().", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn checksum."""
    back = F.transform(F.split(F.reverse(digits(text)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0
