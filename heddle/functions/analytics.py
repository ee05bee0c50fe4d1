"""Numbers and counts of one blob; ``operators.aggregates`` has the same over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import SPACE, big_endian, lines, numbers, raw, text
from ..registry import native


def number_text(c):
    """A double as text, whole numbers without a fraction."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _some(arr, value, what):
    return F.when(F.size(arr) > 0, value).otherwise(F.raise_error(F.lit(f"{what}: no numbers")).cast("double"))


def total(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


@native("byte_count")
def byte_count(cols, p):
    return big_endian(F.octet_length(raw(cols[0])), 8)


@native("line_count", "line_count_acc")
def line_count(cols, p):
    """Line feeds, as decimal text."""
    t = text(cols[0])
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("string")


@native("word_count", "word_count_acc")
def word_count(cols, p):
    return F.regexp_count(text(cols[0]), F.lit(f"[^{SPACE[1:]}+")).cast("string")


def byte_runs(c, *more):
    """The bytes of ``c``, and those of the arrays of hex pairs ``more``, as one string of hex pairs for each value that occurs, in order."""
    pairs = F.regexp_extract_all(F.hex(raw(c)), F.lit(".."), F.lit(0))
    # Equal bytes are neighbours once sorted, so a run's length is its count.  array_sort would compare through a lambda.
    joined = F.array_join(F.sort_array(F.concat(pairs, *more) if more else pairs), "")
    return F.regexp_extract_all(joined, F.lit(r"(..)\1*"), F.lit(0))


def byte_counts(c):
    """How often each of the 256 bytes occurs, as array<bigint>."""
    every = F.array(*(F.lit(f"{i:02X}") for i in range(256)))
    return F.transform(byte_runs(c, every), lambda r: (F.length(r) / 2 - 1).cast("bigint"))


@native("histogram")
def histogram(cols, p):
    """256 counts of eight bytes each, big-endian."""
    return F.unhex(F.array_join(F.transform(byte_counts(cols[0]), lambda n: F.lpad(F.hex(n), 16, "0")), ""))


def entropy_bits(c):
    """Shannon entropy in bits a byte; 0 for an empty blob."""
    n = F.octet_length(raw(c))
    # Only bytes that occur add to the sum, so their runs alone are walked.
    part = lambda r: -(F.length(r) / 2 / n) * F.log2(F.length(r) / 2 / n)
    return F.when(n == 0, 0.0).otherwise(total(F.transform(byte_runs(c), part)))


@native("entropy")
def entropy(cols, p):
    """As a double; see ``entropy_score`` for text."""
    return entropy_bits(cols[0])


@native("min_max")
def min_max(cols, p):
    pairs = F.regexp_extract_all(F.hex(raw(cols[0])), F.lit(".."), F.lit(0))
    return F.when(F.size(pairs) > 0, F.unhex(F.concat(F.array_min(pairs), F.array_max(pairs)))).otherwise(F.raise_error(F.lit("min_max: empty input")).cast("binary"))


@native("sum")
def sum_(cols, p):
    return number_text(total(numbers(cols[0])))


@native("average", "mean")
def average(cols, p):
    arr = numbers(cols[0])
    return number_text(_some(arr, total(arr) / F.size(arr), "average"))


def percentile_of(arr, p: float):
    """Linear interpolation at rank p/100 * (n - 1)."""
    ordered = F.array_sort(arr)
    rank = (F.size(arr) - 1) * (p / 100)
    low = F.floor(rank).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (rank - low)


@native("percentile")
def percentile(cols, p):
    arr = numbers(cols[0])
    return number_text(_some(arr, percentile_of(arr, p.float("p", low=0, high=100)), "percentile"))


@native("median")
def median(cols, p):
    arr = numbers(cols[0])
    return number_text(_some(arr, percentile_of(arr, 50), "median"))


@native("min")
def min_(cols, p):
    arr = numbers(cols[0])
    return number_text(_some(arr, F.array_min(arr), "min"))


@native("max")
def max_(cols, p):
    arr = numbers(cols[0])
    return number_text(_some(arr, F.array_max(arr), "max"))


@native("frequency")
def frequency(cols, p):
    """Counts of non-empty lines as a JSON object, most frequent first, then by line."""
    ordered = F.array_sort(F.filter(lines(cols[0]), lambda x: x != ""))
    found = F.array_distinct(ordered)
    counted = F.transform(found, lambda v: F.struct((-F.size(F.filter(ordered, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(counted), lambda s: F.struct(s["v"], -s["n"]))))


@native("dedup_count")
def dedup_count(cols, p):
    return F.size(F.array_distinct(F.filter(lines(cols[0]), lambda x: x != ""))).cast("string")


@native("cardinality")
def cardinality(cols, p):
    """Distinct byte values."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.hex(raw(cols[0])), F.lit(".."), F.lit(0)))).cast("string")
