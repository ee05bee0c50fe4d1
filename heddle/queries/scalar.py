"""Scalar functions over whole texts, each against the same expression in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry
from .common import LINES, digest, read

QUERIES: dict = {}
_JOIN = "array_to_string({}, chr(10))"


def _text(name: str, sql: str, function: str | None = None, table: str = "documents", key: str = "doc_id", column: str = "text", inputs: int = 1, **params) -> None:
    """A query (key, out): the digest of a function of a text column."""
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        c = F.coalesce(F.col(column), F.lit(""))
        return df.select(key, digest(registry.call(function or name, *[c] * inputs, **params)).alias("out"))

    QUERIES[name] = (run, f"SELECT {key}, md5({sql}) AS out FROM (SELECT {key}, coalesce({column}, '') AS t FROM {table})")


def _blob(name: str, sql: str, function: str | None = None, table: str = "documents", key: str = "doc_id", column: str = "text", **params) -> None:
    """A query (key, out): a function's bytes as hex."""
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table)
        return df.select(key, F.lower(F.hex(registry.call(function or name, F.coalesce(F.col(column), F.lit("")), **params))).alias("out"))

    QUERIES[name] = (run, f"SELECT {key}, {sql} AS out FROM (SELECT {key}, coalesce({column}, '') AS t FROM {table})")


def _back(name: str, there: str, back: str, table: str = "documents", key: str = "doc_id", column: str = "text", back_params: dict | None = None, **params) -> None:
    """A query (key, out): the digest of a text sent there and back again."""
    def run(spark, sf_dir):
        c = F.coalesce(F.col(column), F.lit(""))
        return read(spark, sf_dir, table).select(key, digest(registry.call(back, registry.call(there, c, **params), **(params if back_params is None else back_params))).alias("out"))

    QUERIES[name] = (run, f"SELECT {key}, md5(coalesce({column}, '')) AS out FROM {table}")


# Encodings and transforms
_text("identity", "t")
_text("concat", "t || t", inputs=2)
_text("lowercase", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_text("uppercase", "upper(t)", table="part", key="p_partkey", column="p_name")
_text("repeat", "repeat(t, 3)", count=3)
_text("reverse", "reverse(t)", table="part", key="p_partkey", column="p_name")
_text("sort_bytes", "array_to_string(list_sort(string_split(t, '')), '')", table="part", key="p_partkey", column="p_name")
_text("base64_encode", "base64(encode(t))")
_text("base64url_encode", "rtrim(translate(base64(encode(t)), '+/', '-_'), '=')")
_text("hex_encode", "lower(hex(encode(t)))")
_text("trim", r"regexp_replace(t, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')", table="pages", key="page_id", column="html")
_text("line_ending", r"replace(replace(t, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))", target="crlf")
_text("url_encode", "url_encode(t)")
_text("html_encode", "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')", table="pages", key="page_id", column="html")
_blob("pad", "lower(hex(encode(t))) || repeat(printf('%02x', 16 - octet_length(encode(t)) % 16), (16 - octet_length(encode(t)) % 16)::INT)", table="part", key="p_partkey", column="p_name", block_size=16)
_back("base64_roundtrip", "base64_encode", "base64_decode")
_back("base64url_roundtrip", "base64url_encode", "base64url_decode")
_back("hex_roundtrip", "hex_encode", "hex_decode")
_back("base32_roundtrip", "base32_encode", "base32_decode")
_back("base58_roundtrip", "base58_encode", "base58_decode", table="part", key="p_partkey", column="p_name")
_back("url_roundtrip", "url_encode", "url_decode")
_back("html_roundtrip", "html_encode", "html_decode", table="pages", key="page_id", column="html")
_back("bitwise_not_roundtrip", "bitwise_not", "bitwise_not")
_back("reverse_roundtrip", "reverse", "reverse_bytes")


def _xor(spark, sf_dir):
    c = F.coalesce(F.col("text"), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", digest(registry.call("xor", registry.call("xor", c, key=90), key=90)).alias("out"))


QUERIES["xor_roundtrip"] = (_xor, "SELECT doc_id, md5(coalesce(text, '')) AS out FROM documents")

# Digests and addresses
_blob("sha256", "sha256(t)")
_blob("md5", "md5(t)")
_blob("hmac_sha256", "sha256(unhex('" + (bytes(b ^ 0x5C for b in b"key".ljust(64, b"\0"))).hex() + "') || unhex(sha256(unhex('" + (bytes(b ^ 0x36 for b in b"key".ljust(64, b"\0"))).hex() + "') || encode(t))))", key="doc_id")
_blob("caddr_compute", "sha256(t)")
_blob("caddr_embed", "lower(hex(encode(t))) || sha256(t)", table="part", key="p_partkey", column="p_name")
_blob("chunk_hash", "array_to_string(list_transform(range(0, octet_length(encode(t)), 1024), lambda i: sha256(unhex(substr(hex(encode(t)), i * 2 + 1, 2048)))), '')", block_size=1024)
_blob("embed_metadata", "'00000007' || lower(hex(encode('{\"a\":1}'))) || lower(hex(encode(t)))", table="part", key="p_partkey", column="p_name", metadata='{"a":1}')
_back("metadata_roundtrip", "embed_metadata", "strip_metadata", metadata="m", back_params={})


def _hmac(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(registry.call("hmac_sha256", F.coalesce(F.col("text"), F.lit("")), key=b"key".hex()))).alias("out"))


QUERIES["hmac_sha256"] = (_hmac, QUERIES["hmac_sha256"][1])


def _merkle(spark, sf_dir):
    df = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select("n_nationkey", F.lower(F.hex(registry.call("merkle_root", "n_name", "r_name", "n_name"))).alias("out"))


QUERIES["merkle_root"] = (_merkle, "SELECT n_nationkey, sha256(unhex(sha256(unhex(sha256(n_name) || sha256(r_name)))) || unhex(sha256(n_name))) AS out FROM nation JOIN region ON n_regionkey = r_regionkey")

# Codecs and ciphers, there and back
for _a, _b, _p in (
    ("compress", "decompress", {}), ("zstd_compress", "zstd_decompress", {}), ("lz4_compress", "lz4_decompress", {}), ("snappy_compress", "snappy_decompress", {}), ("brotli_compress", "brotli_decompress", {}),
    ("gzip_compress", "gzip_decompress", {}), ("bzip2_compress", "bzip2_decompress", {}), ("xz_compress", "xz_decompress", {}), ("rs_encode", "rs_decode", {"missing": "1,4"}), ("xor_parity", "xor_reconstruct", {"missing": 1}),
    ("replication_split", "replication_verify", {}), ("stripe_split", "stripe_assemble", {"stripe_size": 512}), ("aead_encrypt", "aead_decrypt", {"key": "11" * 32, "nonce": "22" * 12}), ("aes_gcm_encrypt", "aes_gcm_decrypt", {"key": "11" * 16, "nonce": "22" * 12}),
    ("aes_ctr_encrypt", "aes_ctr_decrypt", {"key": "11" * 16, "nonce": "22" * 16}), ("encrypt", "decrypt", {"key": "11" * 32, "nonce": "ff" * 16}), ("chacha20_encrypt", "chacha20_decrypt", {"key": "11" * 32, "nonce": "22" * 12}),
    ("unixfs_chunk", "unixfs_assemble", {"chunk_size": 1000}),
):
    def _codec(spark, sf_dir, a=_a, b=_b, p=_p):
        c = F.coalesce(F.col("text"), F.lit(""))
        return read(spark, sf_dir, "documents").select("doc_id", digest(registry.call(b, registry.call(a, c, **p), **p)).alias("out"))

    QUERIES[f"{_a}_roundtrip"] = (_codec, "SELECT doc_id, md5(coalesce(text, '')) AS out FROM documents")

# Text
_text("replace", r"regexp_replace(t, '([a-z])the', '\1THE', 'g')", pattern="([a-z])the", replacement="$1THE")
_text("grep", _JOIN.format(f"list_filter({LINES}, lambda x: regexp_matches(x, '[0-9]'))"), pattern="[0-9]")
_text("grep_invert", _JOIN.format(f"list_filter({LINES}, lambda x: NOT regexp_matches(x, 'th'))"), pattern="th")
_text("prefix", "'> ' || t", prefix="> ")
_text("suffix", "t || ' <'", suffix=" <")
_text("line_prefix", _JOIN.format(f"list_transform({LINES}, lambda x: '> ' || x)"), prefix="> ")
_text("line_number", _JOIN.format(f"list_transform({LINES}, lambda x, i: lpad(i::VARCHAR, 6, ' ') || chr(9) || x)"))
_text("truncate_lines", _JOIN.format(f"list_transform({LINES}, lambda x: substr(x, 1, 20))"), table="pages", key="page_id", column="url", max_line_bytes=20)
_text("split", "replace(t, '. ', chr(0))", delimiter=". ")
_text("join", "t || '|' || t", inputs=2, separator="|")
_text("sort_lines", _JOIN.format(f"list_sort({LINES})") + " || CASE WHEN t LIKE '%' || chr(10) THEN chr(10) ELSE '' END")
_text("unique_lines", _JOIN.format(f"list_filter({LINES}, lambda x, i: i = 1 OR x <> {LINES}[i - 1])") + " || CASE WHEN t LIKE '%' || chr(10) THEN chr(10) ELSE '' END")
_text("redact", r"regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+', '[REDACTED]', 'g'), '[0-9]{4}', '[REDACTED]', 'g')", patterns=["[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+", "[0-9]{4}"])

# Slices
_text("sort", _JOIN.format(f"list_sort({LINES})"))
_text("unique", _JOIN.format(f"list_filter({LINES}, lambda x, i: i = 1 OR x <> {LINES}[i - 1])"))
_text("sort_unique", _JOIN.format(f"list_sort(list_distinct({LINES}))"))
_text("head", _JOIN.format(f"{LINES}[1:3]"), n=3)
_text("tail", _JOIN.format(f"{LINES}[greatest(len({LINES}) - 2, 1):]"), n=3)
_text("nth", f"{LINES}[1]", index=0, table="part", key="p_partkey", column="p_name")
_blob("take", "lower(substr(hex(encode(t)), 1, 200))", bytes=100)
_blob("skip", "lower(substr(hex(encode(t)), 201))", bytes=100)
_blob("slice", "lower(substr(hex(encode(t)), 21, 60))", offset=10, length=30)
_blob("chunk_split", "lower(array_to_string(list_transform(range(0, octet_length(encode(t)), 8), lambda i: substr(hex(encode(t)), i * 2 + 1, 16)), '00'))", table="part", key="p_partkey", column="p_name", size=8)
_text("zip", _JOIN.format(f"list_transform({LINES}, lambda x: x || '=' || x)"), inputs=2, separator="=")
_text("alternate", _JOIN.format(f"flatten(list_transform({LINES}, lambda x: [x, x]))"), inputs=2)
_text("merge_sorted", _JOIN.format(f"list_sort({LINES} || {LINES})"), inputs=2)
_text("select_input", "t", inputs=2, index=1)

# Counts
_blob("byte_count", "printf('%016x', octet_length(encode(t)))")
_text("line_count", "(length(t) - length(replace(t, chr(10), '')))::VARCHAR")
_text("word_count", r"len(regexp_extract_all(t, '[^ \t\n\f\r]+'))::VARCHAR")
_text("dedup_count", f"len(list_distinct(list_filter({LINES}, lambda x: x <> '')))::VARCHAR")
_text("cardinality", "len(list_distinct(list_transform(range(0, octet_length(encode(t))), lambda i: substr(hex(encode(t)), i * 2 + 1, 2))))::VARCHAR", table="part", key="p_partkey", column="p_name")
_blob("min_max", "lower(list_min(list_transform(range(0, octet_length(encode(t))), lambda i: substr(hex(encode(t)), i * 2 + 1, 2))) || list_max(list_transform(range(0, octet_length(encode(t))), lambda i: substr(hex(encode(t)), i * 2 + 1, 2))))", table="part", key="p_partkey", column="p_name")


def _entropy(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(registry.call("entropy", "p_name"), 6).alias("entropy"))


QUERIES["entropy"] = (_entropy, "SELECT p_partkey, round((SELECT entropy(c) FROM (SELECT unnest(string_split(p_name, '')) AS c)), 6) AS entropy FROM part")


def _numbers(name: str, sql: str, **params) -> None:
    """A query over the quantities of each order, as lines of text."""
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_quantity")), "\n").alias("t"))
        return df.select("l_orderkey", F.round(registry.call(name, "t", **params).cast("double"), 6).alias("value"))

    QUERIES[f"lines_{name}"] = (run, f"SELECT l_orderkey, round({sql}, 6)::DOUBLE AS value FROM lineitem GROUP BY l_orderkey")


_numbers("sum", "sum(l_quantity)")
_numbers("average", "avg(l_quantity)")
_numbers("median", "median(l_quantity)")
_numbers("min", "min(l_quantity)")
_numbers("max", "max(l_quantity)")
_numbers("percentile", "quantile_cont(l_quantity, 0.9)", p=90)

# Checks: what passes comes back
for _name, _params in (("utf8_validate", {}), ("size_limit", {"max_bytes": 10**9}), ("size_check", {"min": 0}), ("content_type_check", {"expected": "text/plain"})):
    _text(_name, "t", **_params)
_text("json_validate", "t", table="events", key="event_id", column="props")
_text("schema_validate", "t", table="events", key="event_id", column="props", schema='{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0}}}')
_text("regex_match", "t", table="part", key="p_partkey", column="p_name", pattern=".+")
_text("non_empty", "t", table="part", key="p_partkey", column="p_name")
_text("content_type", "'text/plain'")

# JSON and HTML
_text("minify_json", "json(t)", table="events", key="event_id", column="props")
_text("jsonpath_extract", "'[' || (t->>'$.k') || ']'", table="events", key="event_id", column="props", path="$.k")
_text("json_merge", "json_merge_patch(t, t)", inputs=2, table="events", key="event_id", column="props")
_text("json_flatten", "json(t)", table="events", key="event_id", column="props")
_text("html_extract_links", r"""to_json(regexp_extract_all(t, '(?i)<a\s[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1))""", table="pages", key="page_id", column="html")
_text("html_extract_images", r"""to_json(regexp_extract_all(t, '(?i)<img\s[^>]*?\bsrc\s*=\s*["'']([^"'']*)["'']', 1))""", table="pages", key="page_id", column="html")
