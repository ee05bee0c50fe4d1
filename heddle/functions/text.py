"""Text by lines and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import lines, text, unlines
from ..registry import native, python



@native("replace", "regex_replace")
def replace(cols, p):
    return F.regexp_replace(text(cols[0]), p.text("pattern"), p.text("replacement"))


@native("grep")
def grep(cols, p):
    pattern = p.text("pattern")
    return unlines(F.filter(lines(cols[0]), lambda x: x.rlike(pattern)))


@native("grep_invert")
def grep_invert(cols, p):
    pattern = p.text("pattern")
    return unlines(F.filter(lines(cols[0]), lambda x: ~x.rlike(pattern)))


@native("prefix")
def prefix(cols, p):
    return F.concat(F.lit(p.text("prefix")), text(cols[0]))


@native("suffix")
def suffix(cols, p):
    return F.concat(text(cols[0]), F.lit(p.text("suffix")))


@native("line_prefix")
def line_prefix(cols, p):
    return unlines(F.transform(lines(cols[0]), lambda x: F.concat(F.lit(p.text("prefix")), x)))


@native("line_number")
def line_number(cols, p):
    """Numbers from 1, right-aligned to six places, a tab, the line."""
    number = lambda i: F.when(i < 999999, F.lpad((i + 1).cast("string"), 6, " ")).otherwise((i + 1).cast("string"))
    return unlines(F.transform(lines(cols[0]), lambda x, i: F.concat(number(i), F.lit("\t"), x)))


def cut_bytes(x, n: int):
    """The longest start of a string that has at most ``n`` bytes and ends between characters."""
    cut = F.substring(F.encode(x, "UTF-8"), 1, F.lit(n))
    return F.when(F.octet_length(x) <= n, x).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+\\z", ""))


@native("truncate_lines")
def truncate_lines(cols, p):
    n = p.int("max_line_bytes", low=0)
    return unlines(F.transform(lines(cols[0]), lambda x: cut_bytes(x, n)))


@python("charset_convert")
def charset_convert(x, p):
    return x[0].decode(p.text("from")).encode(p.text("to"))


@native("split")
def split(cols, p):
    """Parts between literal delimiters, joined by NUL."""
    return F.replace(text(cols[0]), F.lit(p.text("delimiter")), F.lit("\0"))


@native("join", inputs=(1, None))
def join(cols, p):
    return F.concat_ws(p.text("separator", ""), *(text(c) for c in cols))


def _end(c):
    return F.when(F.endswith(text(c), F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))


@native("sort_lines")
def sort_lines(cols, p):
    """Sorted lines; a final line feed stays."""
    return F.concat(unlines(F.array_sort(lines(cols[0]))), _end(cols[0]))


def adjacent_unique(arr):
    return F.filter(arr, lambda x, i: (i == 0) | (x != F.get(arr, i - 1)))


@native("unique_lines")
def unique_lines(cols, p):
    """Lines without adjacent repeats; a final line feed stays."""
    return F.concat(unlines(adjacent_unique(lines(cols[0]))), _end(cols[0]))
