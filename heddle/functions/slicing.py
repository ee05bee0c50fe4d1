"""Slices, samples and combinations of blobs."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from ..layout import big_endian, lines, raw, unlines
from ..params import InvalidParam
from ..registry import native, python
from .text import adjacent_unique


@native("take")
def take(cols, p):
    return F.substring(raw(cols[0]), 1, F.lit(p.int("bytes", low=1)))


@native("skip")
def skip(cols, p):
    return F.substring(raw(cols[0]), p.int("bytes", low=1) + 1, F.lit(2**31 - 1))


@native("slice")
def slice_(cols, p):
    return F.substring(raw(cols[0]), p.int("offset", low=0) + 1, F.lit(p.int("length", low=0)))


@native("sort")
def sort(cols, p):
    return unlines(F.array_sort(lines(cols[0])))


@native("unique")
def unique(cols, p):
    """Without adjacent repeats."""
    return unlines(adjacent_unique(lines(cols[0])))


@native("sort_unique")
def sort_unique(cols, p):
    return unlines(F.array_sort(F.array_distinct(lines(cols[0]))))


def _dealt(arr, seed: int):
    """Lines with their places, in an order fixed by the seed."""
    keyed = F.transform(arr, lambda x, i: F.struct(F.xxhash64(i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("x")))
    return F.array_sort(keyed)


@native("shuffle")
def shuffle(cols, p):
    return unlines(F.transform(_dealt(lines(cols[0]), p.int("seed", 0)), lambda s: s["x"]))


@native("sample", "reservoir_sample")
def sample(cols, p):
    """A seeded sample of lines in input order; the choice is by hash, so it does not depend on partitions."""
    n = p.int("lines" if "lines" in p else "k", low=0)
    chosen = F.slice(_dealt(lines(cols[0]), p.int("seed", 0)), 1, n)
    return unlines(F.transform(F.array_sort(F.transform(chosen, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"]))


@native("head")
def head(cols, p):
    return unlines(F.slice(lines(cols[0]), 1, p.int("n", low=0)))


@native("tail")
def tail(cols, p):
    n = p.int("n", low=0)
    arr = lines(cols[0])
    return unlines(F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, F.lit(n)))


@native("nth")
def nth(cols, p):
    """The line at ``index`` (from 0); beyond the end an error."""
    arr, i = lines(cols[0]), p.int("index", low=0)
    return F.when(F.size(arr) > i, F.get(arr, i)).otherwise(F.raise_error(F.lit(f"nth: no line {i}")).cast("string"))


def pieces(c, size: int):
    """The chunks of ``size`` bytes of a binary, as hex strings."""
    return F.regexp_extract_all(F.hex(raw(c)), F.lit(f".{{1,{2 * size}}}"), F.lit(0))


@native("chunk_split", "split_by_size")
def chunk_split(cols, p):
    """Chunks of ``size`` bytes joined by NUL."""
    size = p.int("size" if "size" in p else "chunk_size", low=1)
    return F.unhex(F.array_join(pieces(cols[0], size), "00"))


@native("zip", inputs=2)
def zip_(cols, p):
    """Lines joined pairwise; the longer input is cut."""
    a, b = lines(cols[0]), lines(cols[1])
    n = F.least(F.size(a), F.size(b))
    return unlines(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.concat(x, F.lit(p.text("separator", "\t")), y)))


@native("alternate", inputs=2)
def alternate(cols, p):
    """Lines of two inputs in turn; the rest of the longer one follows."""
    pairs = F.zip_with(lines(cols[0]), lines(cols[1]), lambda x, y: F.filter(F.array(x, y), lambda v: v.isNotNull()))
    return unlines(F.flatten(pairs))


@native("zip_concat", inputs=2)
def zip_concat(cols, p):
    """Both lengths as four bytes, then both inputs."""
    a, b = raw(cols[0]), raw(cols[1])
    return F.concat(big_endian(F.octet_length(a), 4), big_endian(F.octet_length(b), 4), a, b)


@native("merge_sorted", "merge", inputs=(1, None))
def merge_sorted(cols, p):
    """Sorted lines of all inputs in one order; equal lines are equal, so which input wins does not show."""
    return unlines(F.array_sort(F.concat(*(lines(c) for c in cols))))


@native("select", "select_input", inputs=(1, None))
def select(cols, p):
    i = p.int("index", low=0)
    if i >= len(cols):
        raise InvalidParam(f"select: no input {i}")
    return cols[i]


def _interleaved(x, size):
    out, at = [], 0
    while any(at < len(b) for b in x):
        out += [b[at : at + size] for b in x]
        at += size
    return b"".join(out)


@python("interleave", inputs=(1, None))
def interleave(x, p):
    return _interleaved(x, p.int("block_size", 1, low=1))


@python("interleave_bytes", inputs=(1, None))
def interleave_bytes(x, p):
    return _interleaved(x, 1)


@python("diff", inputs=2, returns="string")
def diff(x, p):
    """Unified diff with three lines of context."""
    a, b = (v.decode().splitlines() for v in x)
    return "\n".join(difflib.unified_diff(a, b, "a", "b", lineterm="")) + ("\n" if a != b else "")


@python("patch", inputs=2, returns="string")
def patch(x, p):
    """Apply a unified diff; context that does not match is an error."""
    import re

    text, old = x[0].decode(), x[0].decode().splitlines()
    out, at = [], 0
    hunks = x[1].decode().splitlines()
    i = 0
    while i < len(hunks):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", hunks[i])
        i += 1
        if not m:
            continue
        start = max(int(m[1]) - (m[2] != "0"), 0)
        out += old[at:start]
        at = start
        while i < len(hunks) and not hunks[i].startswith("@@"):
            mark, line = hunks[i][:1], hunks[i][1:]
            if mark in (" ", "-"):
                if at >= len(old) or old[at] != line:
                    raise ValueError(f"context does not match at line {at + 1}")
                out += [line] if mark == " " else []
                at += 1
            elif mark == "+":
                out.append(line)
            i += 1
    out += old[at:]
    return "\n".join(out) + ("\n" if text.endswith("\n") and out else "")
