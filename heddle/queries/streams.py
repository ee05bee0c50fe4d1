"""Stream functions over chunk tables, and Structured Streaming over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..layout import explode_chunks
from ..staging import shared_dir
from ..streaming import chunks as C
from ..streaming import live
from .common import digest, read

QUERIES: dict = {}
SIZE = 700
_TEXT = "(SELECT doc_id, text AS t FROM documents WHERE octet_length(encode(text)) > 0)"


def chunked(spark, sf_dir):
    return explode_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", SIZE).select(F.col("doc_id").alias("stream_id"), "chunk_idx", "content")


def _stream(name: str, sql: str, inputs: int = 1, **params) -> None:
    """A query (doc_id, out): the digest of the joined output stream."""
    def run(spark, sf_dir):
        x = chunked(spark, sf_dir)
        out = C.whole(C.apply(name, *[x] * inputs, **params))
        return out.select(F.col("stream_id").alias("doc_id"), digest(F.col("content")).alias("out"))

    QUERIES[name] = (run, f"SELECT doc_id, md5({sql}) AS out FROM {_TEXT}")


_UNHEX = "unhex({})"
_stream("streaming_identity", "t")
_stream("streaming_uppercase", "translate(t, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")
_stream("streaming_lowercase", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_stream("streaming_hex_encode", "lower(hex(encode(t)))")
_stream("streaming_sha256", "unhex(sha256(t))")
_stream("streaming_md5", "unhex(md5(t))")
_stream("streaming_byte_count", "unhex(printf('%016x', octet_length(encode(t))))")
_stream("streaming_line_count", "unhex(printf('%016x', length(t) - length(replace(t, chr(10), ''))))")
_stream("streaming_word_count", r"unhex(printf('%016x', len(regexp_extract_all(t, '[^ \t\n\r]+'))))")
_stream("streaming_concat", "t || t", inputs=2)
_stream("streaming_chunk_resizer", "t", target_size=100)
_stream("streaming_take", "unhex(substr(hex(encode(t)), 1, 2000))", bytes=1000)
_stream("streaming_repeat", "t || t", count=2)
_stream("streaming_tee_count", "encode(t) || encode(octet_length(encode(t))::VARCHAR)")
_stream("streaming_filter", "t", predicate="non_empty")
_stream("streaming_head", f"unhex(substr(hex(encode(t)), 1, {4 * SIZE}))", chunks=2)
_stream("streaming_batch", "t", batch_size=3)
_stream("streaming_prefix", "'>' || t", prefix=">")
_stream("streaming_suffix", "t || '<'", suffix="<")
_stream("streaming_replace", "replace(t, 'the', 'THE')", find="the", replace="THE")
_stream("streaming_sed", r"regexp_replace(t, '([a-z])ing', '\1ED', 'g')", pattern="([a-z])ing", replacement="$1ED")
_stream("streaming_tee", "t", outputs=2)
_stream("streaming_utf8_validate", "t")
_stream("streaming_size_limit", "t", max_bytes=10**9)
_stream("streaming_non_empty", "t")
_stream("streaming_content_type", "'Content-Type: text/plain' || chr(10) || t")
_redacted = "t"
for _rx in C.REDACT:
    _redacted = f"regexp_replace({_redacted}, '{_rx}', '[REDACTED]', 'g')"
_stream("streaming_redact", _redacted)


def _skip(spark, sf_dir):
    out = C.whole(C.apply("streaming_skip", chunked(spark, sf_dir), bytes=1000))
    return out.select(F.col("stream_id").alias("doc_id"), digest(F.col("content")).alias("out"))


QUERIES["streaming_skip"] = (_skip, f"SELECT doc_id, md5(unhex(substr(hex(encode(t)), 2001))) AS out FROM {_TEXT} WHERE octet_length(encode(t)) > 1000")

for _a, _b, _params in (("base64_encode", "base64_decode", {}), ("compress", "decompress", {}), ("zstd_compress", "zstd_decompress", {}), ("lz4_compress", "lz4_decompress", {}), ("snappy_compress", "snappy_decompress", {}),
                        ("brotli_compress", "brotli_decompress", {}), ("hex_encode", "hex_decode", {}), ("xor", "xor", {}), ("bitwise_not", "bitwise_not", {}), ("base32_encode", "base32_decode", {}), ("reverse", "reverse", {}),
                        ("encrypt", "decrypt", {"key": "01" * 32, "nonce": "02" * 16}), ("aead_encrypt", "aead_decrypt", {"key": "01" * 32, "nonce_prefix": "03" * 8})):
    def _back(spark, sf_dir, a=_a, b=_b, params=_params):
        out = C.whole(C.apply(f"streaming_{b}", C.apply(f"streaming_{a}", chunked(spark, sf_dir), **params), **params))
        return out.select(F.col("stream_id").alias("doc_id"), digest(F.col("content")).alias("out"))

    QUERIES[f"streaming_{_a}_roundtrip"] = (_back, f"SELECT doc_id, md5(t) AS out FROM {_TEXT}")

# Chunk rows
_CHUNKS = f"(SELECT doc_id, i AS chunk_idx, substr(hex(encode(t)), i * {2 * SIZE} + 1, {2 * SIZE}) AS h FROM (SELECT doc_id, t, unnest(range(0, (octet_length(encode(t)) + {SIZE - 1}) // {SIZE})) AS i FROM {_TEXT}))"


def _rows(name: str, sql: str, **params) -> None:
    def run(spark, sf_dir):
        out = C.apply(name, chunked(spark, sf_dir), **params)
        return out.select(F.col("stream_id").alias("doc_id"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"), digest(F.col("content")).alias("out"))

    QUERIES[f"{name}_rows"] = (run, f"SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, md5(unhex(h)) AS out FROM ({sql})")


_rows("streaming_sample", f"SELECT * FROM {_CHUNKS} WHERE chunk_idx % 2 = 0", rate=2)
_rows("streaming_tail", f"SELECT * FROM {_CHUNKS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx DESC) <= 2", chunks=2)
_rows("streaming_deduplicate", f"SELECT doc_id, min(chunk_idx) AS chunk_idx, h FROM {_CHUNKS} GROUP BY doc_id, h")
_rows("streaming_sort", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY h, chunk_idx) - 1 AS chunk_idx, h FROM {_CHUNKS}")
_rows("streaming_unique", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS chunk_idx, h FROM (SELECT DISTINCT doc_id, h FROM {_CHUNKS})")
_rows("streaming_debounce", f"SELECT * FROM {_CHUNKS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx DESC) = 1")
_rows("streaming_partition", f"SELECT * FROM {_CHUNKS} WHERE length(h) >= 1000", predicate="min_size:500")
_rows("streaming_chunk_hash", f"SELECT doc_id, chunk_idx, h || sha256(unhex(h)) AS h FROM {_CHUNKS}")
_rows("streaming_pad", f"SELECT doc_id, chunk_idx, h || repeat('00', ((16 - (length(h) // 2) % 16) % 16)::INT) AS h FROM {_CHUNKS}")


def _events(spark, sf_dir):
    """The events table as a file stream."""
    schema = read(spark, sf_dir, "events").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(df, mode: str):
    """All rows of a stream that has been read to its end: appended rows are a table, complete results counts of bounded size."""
    spark = df.sparkSession
    name = f"q_{uuid.uuid4().hex}"
    if mode == "append":
        path = f"{shared_dir(spark)}/heddle/{name}"
        live.run_to_table(df, f"{path}/rows", f"{path}/checkpoint")
        return spark.read.schema(df.schema).parquet(f"{path}/rows")
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def stream_window_counts(spark, sf_dir):
    return _finished(live.window_counts(_events(spark, sf_dir), "ts", "1 day", ["event_type"]), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")


QUERIES["stream_window_counts"] = (stream_window_counts, "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def stream_deduplicate(spark, sf_dir):
    seen = live.deduplicate(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "36500 days")
    return _finished(seen.select("user_id", "event_type"), "append")


QUERIES["stream_deduplicate"] = (stream_deduplicate, "SELECT DISTINCT user_id, event_type FROM events")


def stream_filter(spark, sf_dir):
    return _finished(_events(spark, sf_dir).where("event_type = 'purchase'").select("event_id"), "append")


QUERIES["stream_filter"] = (stream_filter, "SELECT event_id FROM events WHERE event_type = 'purchase'")


def session_counts(spark, sf_dir):
    """The batch form of the same operator."""
    return live.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["user_id"]).select("user_id", "n")


QUERIES["session_counts"] = (session_counts, """SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")


def debounced(spark, sf_dir):
    return live.debounce(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["user_id"], "value").select("user_id", F.round("value", 6).alias("value"))


QUERIES["debounce_events"] = (debounced, """SELECT user_id, round(arg_max(value, ts), 6) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
