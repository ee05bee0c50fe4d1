"""Stream functions over chunk tables (stream_id, chunk_idx, content).

Chunk tables are the faithful form of chunked streams: a map is a projection, a fold an aggregate, and what depends on
order a window over chunk_idx.  Projections and filters work on streaming DataFrames as they are; see ``live`` for
functions that need event time or state there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..layout import big_endian, lenient_numbers, lines, raw, text
from ..params import InvalidParam, Params

KEY, IDX, BODY = "stream_id", "chunk_idx", "content"
COLUMNS = (KEY, IDX, BODY)
_functions: dict[str, Callable] = {}


def streaming(*names: str):
    def wrap(f):
        for n in names:
            _functions[n] = f
        return f

    return wrap


def names() -> list[str]:
    return sorted(_functions)


def apply(name: str, df: DataFrame, *others: DataFrame, **params) -> DataFrame:
    """The stream that function ``name`` makes of chunk tables."""
    if name not in _functions:
        raise KeyError(f"no stream function {name}")
    inputs = [d.select(KEY, F.col(IDX).cast("bigint").alias(IDX), raw(F.col(BODY)).alias(BODY)) for d in (df, *others)]
    return _functions[name](inputs, Params(params))


def _order():
    return Window.partitionBy(KEY).orderBy(IDX)


def _mapped(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(BODY, raw(fn(F.col(BODY))))


def whole(df: DataFrame) -> DataFrame:
    """(stream_id, content): the chunks of each stream joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(IDX, F.hex(BODY).alias("h"))))
    return df.groupBy(KEY).agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), "")).alias(BODY))


def _one(df: DataFrame, value: Column) -> DataFrame:
    """A stream of one chunk for each row of (stream_id, ...)."""
    return df.select(KEY, F.lit(0).cast("bigint").alias(IDX), raw(value).alias(BODY))


def _renumbered(df: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(*(order or (IDX,)))
    return df.withColumn(IDX, (F.row_number().over(w) - 1).cast("bigint")).select(*COLUMNS)


# Functions of one chunk: the batch function of a name, with default parameters.
for _name, _batch, _defaults in (
    ("identity", "identity", {}), ("reverse", "reverse", {}), ("base64_encode", "base64_encode", {}), ("base64_decode", "base64_decode", {}), ("xor", "xor", {"key": 255}),
    ("compress", "compress", {}), ("decompress", "decompress", {}), ("bitwise_and", "bitwise_and", {"mask": 255}), ("bitwise_or", "bitwise_or", {"mask": 0}), ("bitwise_not", "bitwise_not", {}),
    ("byte_swap", "byte_swap", {"word_size": 2}), ("hex_encode", "hex_encode", {}), ("hex_decode", "hex_decode", {}), ("base32_encode", "base32_encode", {}), ("base32_decode", "base32_decode", {}),
    ("zstd_compress", "zstd_compress", {}), ("zstd_decompress", "zstd_decompress", {}), ("lz4_compress", "lz4_compress", {}), ("lz4_decompress", "lz4_decompress", {}), ("snappy_compress", "snappy_compress", {}),
    ("snappy_decompress", "snappy_decompress", {}), ("brotli_compress", "brotli_compress", {}), ("brotli_decompress", "brotli_decompress", {}), ("trim", "trim", {}), ("line_ending", "line_ending", {"target": "lf"}),
):
    def _per_chunk(x, p, batch=_batch, defaults=_defaults):
        return _mapped(x[0], lambda c: registry.call(batch, c, **(defaults | dict(p))))

    streaming("streaming_" + _name)(_per_chunk)


# Functions of a whole stream that the batch library has: joined, applied, one chunk.
for _name, _batch, _defaults in (
    ("sha256", "sha256", {}), ("sha512", "sha512", {}), ("md5", "md5", {}), ("blake3", "blake3", {}), ("checksum", "crc32", {}), ("hmac_sha256", "hmac_sha256", {}), ("histogram", "histogram", {}),
    ("json_pretty_print", "pretty_json", {}), ("json_minify", "minify_json", {}), ("json_lines", "json_lines", {}), ("json_validate", "json_validate", {}), ("schema_validate", "schema_validate", {}), ("charset_convert", "charset_convert", {}),
    ("sha256_verify", "sha256_verify", {}), ("checksum_verify", "crc32_verify", {}), ("utf8_validate", "utf8_validate", {}), ("encrypt", "encrypt", {}), ("decrypt", "decrypt", {}),
    ("caddr_embed", "caddr_embed", {}), ("caddr_verify", "caddr_verify", {}), ("entropy", "entropy_score", {}), ("magic_bytes", "magic_bytes", {}), ("size_limit", "size_limit", {}), ("non_empty", "non_empty", {}),
):
    def _per_stream(x, p, batch=_batch, defaults=_defaults):
        return _one(w := whole(x[0]), registry.call(batch, w[BODY], **(defaults | dict(p))))

    streaming("streaming_" + _name)(_per_stream)


@streaming("streaming_uppercase")
def _uppercase(x, p):
    """ASCII letters; bytes pass as single characters, as a chunk may end inside one of several bytes."""
    from ..functions.encodings import ascii_upper

    return _mapped(x[0], lambda c: F.encode(ascii_upper(F.decode(c, "iso-8859-1")), "iso-8859-1"))


@streaming("streaming_lowercase")
def _lowercase(x, p):
    from ..functions.encodings import ascii_lower

    return _mapped(x[0], lambda c: F.encode(ascii_lower(F.decode(c, "iso-8859-1")), "iso-8859-1"))


@streaming("streaming_pad")
def _pad(x, p):
    """Chunks filled up to whole blocks with one byte; aligned ones stay."""
    size, fill = p.int("block_size", 16, low=1), p.int("padding_byte", 0, 0, 255)
    return _mapped(x[0], lambda c: F.concat(c, F.unhex(F.repeat(F.lit(f"{fill:02x}"), F.pmod(-F.octet_length(c), F.lit(size))))))


@streaming("streaming_chunk_hash")
def _chunk_hash(x, p):
    """Each chunk followed by its SHA-256."""
    return _mapped(x[0], lambda c: F.concat(c, F.unhex(F.sha2(c, 256))))


def _counted(df: DataFrame, value: Column) -> DataFrame:
    return _one(df.groupBy(KEY).agg(F.sum(value).cast("bigint").alias("n")), big_endian(F.col("n"), 8))


@streaming("streaming_byte_count")
def _byte_count(x, p):
    return _counted(x[0], F.octet_length(BODY))


@streaming("streaming_line_count")
def _line_count(x, p):
    return _counted(x[0], F.octet_length(BODY) - F.octet_length(F.unhex(F.regexp_replace(F.hex(BODY), "\\G((?:(?!0A)..)*)0A", "$1"))))


@streaming("streaming_word_count")
def _word_count(x, p):
    """Words may span chunks: a chunk's first word is no new one if it goes on from the chunk before."""
    t = F.decode(F.col(BODY), "iso-8859-1")  # one character for each byte
    words = F.regexp_count(t, F.lit(r"[^ \t\n\r]+"))
    inside = lambda c, rx: c.rlike(rx)
    filled = x[0].where(F.octet_length(BODY) > 0).withColumn("_t", t)
    goes_on = F.coalesce(F.lag(inside(F.col("_t"), r"[^ \t\n\r]\z")).over(_order()), F.lit(False)) & inside(F.col("_t"), r"\A[^ \t\n\r]")
    return _counted(filled.withColumn("_n", words - goes_on.cast("int")), F.col("_n"))


@streaming("streaming_min_max")
def _min_max(x, p):
    """Least and greatest byte; FF 00 for an empty stream."""
    pairs = F.regexp_extract_all(F.hex(BODY), F.lit(".."), F.lit(0))
    g = x[0].groupBy(KEY).agg(F.min(F.array_min(pairs)).alias("a"), F.max(F.array_max(pairs)).alias("b"))
    return _one(g, F.unhex(F.concat(F.coalesce("a", F.lit("FF")), F.coalesce("b", F.lit("00")))))


@streaming("streaming_concat")
def _concat(x, p):
    """The chunks of all inputs, input after input."""
    tagged = [d.withColumn("_i", F.lit(i)) for i, d in enumerate(x)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return _renumbered(out, "_i", IDX)


@streaming("streaming_merge")
def _merge(x, p):
    """All inputs by chunk number: the order of arrival has no meaning in a table."""
    tagged = [d.withColumn("_i", F.lit(i)) for i, d in enumerate(x)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return _renumbered(out, IDX, "_i")


def _wholes(x: list[DataFrame]) -> DataFrame:
    """(stream_id, c0, c1, ...) of several streams."""
    out = whole(x[0]).withColumnRenamed(BODY, "c0")
    for i, d in enumerate(x[1:], 1):
        out = out.join(whole(d).withColumnRenamed(BODY, f"c{i}"), KEY, "full")
    return out.select(KEY, *(F.coalesce(f"c{i}", F.lit(b"")).alias(f"c{i}") for i in range(len(x))))


@streaming("streaming_interleave")
def _interleave(x, p):
    both = _wholes(x)
    return _one(both, registry.call("interleave", *(both[f"c{i}"] for i in range(len(x))), block_size=p.int("block_size", 1, low=1)))


@streaming("streaming_zip_concat")
def _zip_concat(x, p):
    """Lines of two inputs joined in pairs; a missing one is empty."""
    both = _wholes(x)
    join = F.zip_with(lines(F.col("c0")), lines(F.col("c1")), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return _one(both, F.array_join(join, "\n"))


@streaming("streaming_chunk_resizer")
def _resize(x, p):
    from ..layout import explode_chunks

    return explode_chunks(whole(x[0]), KEY, BODY, p.int("target_size", 65536, low=1)).select(*COLUMNS)


def _before() -> Column:
    """Bytes before a chunk in its stream."""
    return F.coalesce(F.sum(F.octet_length(BODY)).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


@streaming("streaming_take")
def _take(x, p):
    n = p.int("bytes", low=0)
    cut = x[0].withColumn("_b", _before()).where(F.col("_b") < n)
    return cut.withColumn(BODY, F.substring(BODY, F.lit(1), (F.lit(n) - F.col("_b")).cast("int"))).select(*COLUMNS)


@streaming("streaming_skip")
def _skip(x, p):
    n = p.int("bytes", low=0)
    cut = x[0].withColumn("_b", _before()).where(F.col("_b") + F.octet_length(BODY) > n)
    return cut.withColumn(BODY, F.substring(BODY, (F.greatest(F.lit(n) - F.col("_b"), F.lit(0)) + 1).cast("int"), F.lit(2**31 - 1))).select(*COLUMNS)


@streaming("streaming_repeat")
def _repeat(x, p):
    again = x[0].withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(p.int("count", low=1)))))
    return _renumbered(again, "_r", IDX)


@streaming("streaming_tee_count")
def _tee_count(x, p):
    """The stream, then its size as text."""
    n = x[0].groupBy(KEY).agg((F.max(IDX) + 1).alias(IDX), F.sum(F.octet_length(BODY)).cast("string").cast("binary").alias(BODY))
    return x[0].unionByName(n)


def chunk_predicate(rule: str) -> Column:
    """non_empty, contains:TEXT or min_size:N; anything else keeps all."""
    if rule == "non_empty":
        return F.octet_length(BODY) > 0
    if rule.startswith("contains:"):
        return F.contains(F.hex(BODY), F.lit(rule[9:].encode().hex().upper())) & F.contains(F.col(BODY), F.lit(rule[9:].encode()))
    if rule.startswith("min_size:"):
        try:
            return F.octet_length(BODY) >= int(rule[9:])
        except ValueError:
            raise InvalidParam(f"bad size in {rule}") from None
    return F.lit(True)


@streaming("streaming_filter")
def _filter(x, p):
    return x[0].where(chunk_predicate(p.text("predicate", "")))


@streaming("streaming_partition")
def _partition(x, p):
    """Of the two streams that a predicate parts a stream into, the one that ``side`` names."""
    rule = chunk_predicate(p.text("predicate", ""))
    return x[0].where(rule if p.choice("side", ("matching", "other"), "matching") == "matching" else ~rule)


@streaming("streaming_sample")
def _sample(x, p):
    return x[0].withColumn("_n", F.row_number().over(_order()) - 1).where(F.col("_n") % p.int("rate", 10, low=1) == 0).drop("_n")


@streaming("streaming_head")
def _head(x, p):
    return x[0].withColumn("_n", F.row_number().over(_order())).where(F.col("_n") <= p.int("chunks", 1)).drop("_n")


@streaming("streaming_tail")
def _tail(x, p):
    w = Window.partitionBy(KEY).orderBy(F.col(IDX).desc())
    return x[0].withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= p.int("chunks", 1)).drop("_n")


@streaming("streaming_deduplicate")
def _deduplicate(x, p):
    """The first of equal chunks."""
    return x[0].groupBy(KEY, BODY).agg(F.min(IDX).alias(IDX)).select(*COLUMNS)


@streaming("streaming_sort")
def _sort(x, p):
    return _renumbered(x[0], BODY, IDX)


@streaming("streaming_unique")
def _unique(x, p):
    """Distinct chunks in order of their bytes."""
    return _renumbered(x[0].select(KEY, BODY).distinct().withColumn(IDX, F.lit(0)), BODY)


@streaming("streaming_batch")
def _batch(x, p):
    """Every ``batch_size`` chunks joined into one."""
    n = p.int("batch_size", 4, low=1)
    numbered = x[0].withColumn("_g", F.floor((F.row_number().over(_order()) - 1) / n))
    ordered = F.array_sort(F.collect_list(F.struct(IDX, F.hex(BODY).alias("h"))))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), ""))
    return numbered.groupBy(KEY, "_g").agg(joined.alias(BODY)).select(KEY, F.col("_g").alias(IDX), BODY)


@streaming("streaming_tee", "streaming_broadcast")
def _tee(x, p):
    """The primary output; other sinks read the same DataFrame (see ``live.fan_out``)."""
    p.int("outputs", 2, low=1)
    return x[0]


@streaming("streaming_rate_limit", "streaming_delay", "streaming_timeout", "streaming_retry")
def _timing(x, p):
    """Timing has no meaning in a table; ``live`` maps these to source options, triggers and timers."""
    return x[0]


@streaming("streaming_debounce")
def _debounce(x, p):
    """Of a table, the last chunk of each stream: after it comes no other."""
    return x[0].groupBy(KEY).agg(F.max_by(BODY, IDX).alias(BODY), F.max(IDX).alias(IDX)).select(*COLUMNS)


@streaming("streaming_sum")
def _sum(x, p):
    """Lines that are no numbers are skipped."""
    w = whole(x[0])
    return _one(w, F.aggregate(lenient_numbers(w[BODY]), F.lit(0.0), lambda a, v: a + v).cast("string"))


@streaming("streaming_average")
def _average(x, p):
    w = whole(x[0])
    arr = lenient_numbers(w[BODY])
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)
    return _one(w, F.when(F.size(arr) > 0, mean).otherwise(F.raise_error(F.lit("streaming_average: no numbers")).cast("double")).cast("string"))


def rolling_hash(data: bytes, window: int, state: tuple[int, bytes] = (0, b"")) -> tuple[int, bytes]:
    """Hash (base 257 modulo 2^61 - 1) and bytes of the last ``window`` bytes."""
    prime = (1 << 61) - 1
    h, tail = state
    drop = pow(257, window, prime)
    for b in data:
        tail += bytes([b])
        h = (h * 257 + b) % prime
        if len(tail) > window:
            h = (h - tail[0] * drop) % prime
            tail = tail[1:]
    return h, tail


@streaming("streaming_rolling_hash")
def _rolling_hash(x, p):
    """Each chunk followed by the hash of the last bytes so far, which may span chunks."""
    window = p.int("window_size", 48, low=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values(IDX), (0, b""), []
        for body in pdf[BODY]:
            state = rolling_hash(bytes(body), window, state)
            out.append(bytes(body) + state[0].to_bytes(8, "big"))
        return pdf.assign(**{BODY: out})

    return x[0].groupBy(KEY).applyInPandas(run, f"{KEY} {x[0].schema[KEY].dataType.simpleString()}, {IDX} long, {BODY} binary")


def _lines_through(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """A function of the whole text of a stream: lines may span chunks."""
    w = whole(df)
    return _one(w, fn(w[BODY]))


@streaming("streaming_replace")
def _replace(x, p):
    """A regular expression if ``find`` has any of its marks, else a literal."""
    find, put = p.text("find"), p.text("replace", "")
    marked = any(c in find for c in r".^$*+?()[]{}|\\"[:-1])
    return _lines_through(x[0], lambda c: F.regexp_replace(text(c), find, put) if marked else F.replace(text(c), F.lit(find), F.lit(put)))


@streaming("streaming_sed")
def _sed(x, p):
    return _lines_through(x[0], lambda c: F.regexp_replace(text(c), p.text("pattern"), p.text("replacement", "")))


@streaming("streaming_prefix")
def _prefix(x, p):
    head = x[0].select(KEY).distinct().select(KEY, F.lit(-1).cast("bigint").alias(IDX), F.lit(p.text("prefix").encode()).alias(BODY))
    return _renumbered(head.unionByName(x[0]))


@streaming("streaming_suffix")
def _suffix(x, p):
    tail = x[0].groupBy(KEY).agg((F.max(IDX) + 1).alias(IDX)).select(KEY, IDX, F.lit(p.text("suffix").encode()).alias(BODY))
    return x[0].unionByName(tail)


def _each_line(c: Column, fn) -> Column:
    """A function of each line; line feeds stay."""
    parts = F.regexp_extract_all(text(c), F.lit(r"[^\n]*+\n|[^\n]++\z"), F.lit(0))
    return F.array_join(fn(parts), "")


@streaming("streaming_line_prefix")
def _line_prefix(x, p):
    return _lines_through(x[0], lambda c: _each_line(c, lambda a: F.transform(a, lambda v: F.concat(F.lit(p.text("prefix")), v))))


@streaming("streaming_grep")
def _grep(x, p):
    rx, invert = p.text("pattern"), p.bool("invert")
    return _lines_through(x[0], lambda c: _each_line(c, lambda a: F.filter(a, lambda v: ~v.rlike(rx) if invert else v.rlike(rx))))


@streaming("streaming_truncate_lines")
def _truncate_lines(x, p):
    from ..functions.text import cut_bytes

    n = p.int("max_line_bytes", 1024, low=0)
    cut = lambda v: F.concat(cut_bytes(F.regexp_replace(v, "\n\\z", ""), n), F.when(F.endswith(v, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")))
    return _lines_through(x[0], lambda c: _each_line(c, lambda a: F.transform(a, cut)))


# What is redacted by default (e-mail, phone, US social security number).
REDACT = (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{3}-\d{2}-\d{4}\b")


@streaming("streaming_redact")
def _redact(x, p):
    patterns = p.list("patterns", list(REDACT))

    def fn(c):
        c = text(c)
        for rx in patterns:
            c = F.regexp_replace(c, rx, "[REDACTED]")
        return c

    return _lines_through(x[0], fn)


@streaming("streaming_csv_to_json")
def _csv_to_json(x, p):
    """A stream of CSV as NDJSON."""
    w = whole(x[0])
    rows = registry.call("csv_parse", w[BODY], delimiter=p.text("delimiter", ","))
    return _one(w, F.concat(registry.call("json_lines", rows), F.lit("\n")))


def _nonce(prefix: bytes) -> Column:
    """Eight fixed bytes and the chunk number."""
    return F.concat(F.lit(prefix), big_endian(F.col(IDX), 4))


@streaming("streaming_aead_encrypt")
def _aead_encrypt(x, p):
    """AES-256-GCM for each chunk under a nonce of its own."""
    key, prefix = p.hex("key", (32,)), p.hex("nonce_prefix", (8,))
    sealed = F.aes_encrypt(F.col(BODY), F.lit(key), F.lit("GCM"), F.lit("NONE"), _nonce(prefix))
    return x[0].withColumn(BODY, F.substring(sealed, 13, F.lit(2**31 - 1)))


@streaming("streaming_aead_decrypt")
def _aead_decrypt(x, p):
    key, prefix = p.hex("key", (32,)), p.hex("nonce_prefix", (8,))
    return x[0].withColumn(BODY, F.aes_decrypt(F.concat(_nonce(prefix), F.col(BODY)), F.lit(key), F.lit("GCM")))


@streaming("streaming_diff", "streaming_patch")
def _diff(x, p):
    """Chunks of two streams combined by exclusive or, the shorter filled with zeros; applied twice it is undone."""
    @F.pandas_udf("binary")
    def xor(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(u, v):
            u, v = bytes(u or b""), bytes(v or b"")
            n = max(len(u), len(v))
            return (np.frombuffer(u.ljust(n, b"\0"), np.uint8) ^ np.frombuffer(v.ljust(n, b"\0"), np.uint8)).tobytes()

        return pd.Series([one(u, v) for u, v in zip(a, b, strict=True)], dtype=object)

    both = x[0].join(x[1].withColumnRenamed(BODY, "_o"), [KEY, IDX], "full")
    return both.select(KEY, IDX, xor(F.col(BODY), F.col("_o")).alias(BODY))


@streaming("streaming_merkle_tree")
def _merkle_tree(x, p):
    """SHA-256 root over the chunks; an odd node is doubled.  Levels halve, each one aggregation over the level before."""
    level = x[0].select(KEY, (F.row_number().over(_order()) - 1).alias("i"), F.sha2(BODY, 256).alias("h"))
    for _ in range(p.int("levels", 32)):
        size = level.groupBy(KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if size <= 1:
            break
        n = F.count("*").over(Window.partitionBy(KEY))
        pair = level.withColumn("n", n).groupBy(KEY, F.floor(F.col("i") / 2).alias("j")).agg(F.max("n").alias("n"), F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        joined = F.sha2(F.unhex(F.concat("a", "b")), 256)
        level = pair.select(KEY, F.col("j").alias("i"), F.when(F.col("n") == 1, F.col("a")).otherwise(joined).alias("h"))
    return _one(level, F.unhex("h"))


def head_text(c: Column) -> Column:
    """A chunk without the bytes of a character that it does not end."""
    return F.unhex(F.regexp_replace(F.hex(c), r"(?:F[0-7](?:[89AB].){0,2}|E.(?:[89AB].){0,1}|[CD].)\z", ""))


@streaming("streaming_content_type")
def _content_type(x, p):
    """A header line with the type of the first chunk, then the stream.

    A character cut at the end of the chunk does not make a text binary.
    """
    from ..functions.checks import sniffed

    first = x[0].groupBy(KEY).agg(F.min_by(BODY, IDX).alias("_f"))
    head = first.select(KEY, F.lit(-1).cast("bigint").alias(IDX), raw(F.concat(F.lit("Content-Type: "), sniffed(head_text(F.col("_f"))), F.lit("\n"))).alias(BODY))
    return _renumbered(head.unionByName(x[0]))
