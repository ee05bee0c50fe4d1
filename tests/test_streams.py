"""Stream functions on literal chunks; all results are collected by one job."""

import hashlib
import hmac
import json
import math
import struct
from functools import reduce

import pytest
from pyspark.sql import functions as F

from heddle.functions import addressing
from heddle.streaming import chunks as C

X = (b"warp\nwe", b"ft 12\n", b"7\n")
ALL = b"".join(X)
Y = (b"A\n", b"B", b"C\nD")
DOC = (b'{"a": [1,', b' 2], "b": "x"}')
KEY = "00112233445566778899aabbccddeeff" * 2


def counts(data):
    return b"".join(struct.pack(">Q", data.count(bytes([i]))) for i in range(256))


#: name, inputs, parameters, the joined output (or a test of it)
CASES = [
    ("streaming_sum", [X], {}, b"7.0"),
    ("streaming_min_max", [X], {}, bytes([min(ALL), max(ALL)])),
    ("streaming_interleave", [(b"ace",), (b"bd",)], {}, lambda out: sorted(out) == sorted(b"abcde")),
    ("streaming_merge", [X, Y], {}, b"warp\nweA\nft 12\nB7\nC\nD"),
    ("streaming_line_prefix", [X], {"prefix": "> "}, b"> warp\n> weft 12\n> 7\n"),
    ("streaming_truncate_lines", [X], {"max_line_bytes": 3}, b"war\nwef\n7\n"),
    ("streaming_line_ending", [X], {"target": "crlf"}, ALL.replace(b"\n", b"\r\n")),
    ("streaming_json_pretty_print", [DOC], {}, lambda out: json.loads(out) == json.loads(b"".join(DOC)) and b"\n" in out),
    ("streaming_json_minify", [DOC], {}, b'{"a":[1,2],"b":"x"}'),
    ("streaming_json_lines", [(b'[{"a":1},', b"[2]]")], {}, lambda out: [json.loads(x) for x in out.splitlines()] == [{"a": 1}, [2]]),
    ("streaming_json_validate", [DOC], {}, b"".join(DOC)),
    ("streaming_schema_validate", [DOC], {"schema": '{"properties": {"b": {"type": "string"}}}'}, b"".join(DOC)),
    ("streaming_csv_to_json", [(b"a,b\n1,", b"x\n")], {}, b'{"a":"1","b":"x"}\n'),
    ("streaming_magic_bytes", [X], {"expected": b"warp".hex()}, ALL),
    ("streaming_sha256_verify", [X], {"expected_hash": hashlib.sha256(ALL).hexdigest()}, ALL),
    ("streaming_trim", [(b"  a ", b" b  ")], {}, lambda out: out.startswith(b"a") and out.endswith(b"b")),
    ("streaming_hmac_sha256", [X], {"key": b"key".hex()}, lambda out: out in {f(hmac.new(k, ALL, "sha256")) for k in (b"key", b"6b6579") for f in (lambda h: h.digest(), lambda h: h.hexdigest().encode())}),
    ("streaming_sha512", [X], {}, lambda out: hashlib.sha512(ALL).hexdigest() in (out.hex(), out.decode("latin-1"))),
    ("streaming_blake3", [X], {}, lambda out: addressing.blake3_digest(ALL).hex() in (out.hex(), out.decode("latin-1"))),
    ("streaming_caddr_embed", [X], {}, ALL + hashlib.sha256(ALL).digest()),
    ("streaming_caddr_verify", [X], {"expected_caddr": hashlib.sha256(ALL).hexdigest()}, ALL),
    ("streaming_rate_limit", [X], {}, ALL), ("streaming_delay", [X], {}, ALL), ("streaming_timeout", [X], {}, ALL), ("streaming_retry", [X], {}, ALL), ("streaming_broadcast", [X], {}, ALL),
    ("streaming_bitwise_and", [X], {"mask": 15}, bytes(b & 15 for b in ALL)), ("streaming_bitwise_or", [X], {"mask": 128}, bytes(b | 128 for b in ALL)),
    ("streaming_charset_convert", [(b"caf\xe9",)], {"from": "iso-8859-1", "to": "utf-8"}, "café".encode()),
    ("streaming_entropy", [(b"ab", b"ab")], {}, lambda out: math.isclose(float(out), 1.0)),
    ("streaming_redact", [(b"to weaver@exam", b"ple.org or 555-123-4567\n")], {}, b"to [REDACTED] or [REDACTED]\n"),
    ("streaming_partition", [X], {"predicate": "min_size:3", "side": "other"}, b"7\n"),
    ("streaming_partition", [X], {"predicate": "min_size:3"}, b"warp\nweft 12\n"),
    ("streaming_histogram", [X], {}, lambda out: out == counts(ALL) or sum(json.loads(out)) == len(ALL)),
]


def test_stream_functions(spark):
    frames = []
    for n, (name, inputs, params, _) in enumerate(CASES):
        x = [spark.createDataFrame([(1, i, c) for i, c in enumerate(part)], "stream_id long, chunk_idx long, content binary") for part in inputs]
        try:
            frames.append(C.whole(C.apply(name, *x, **params)).select(F.lit(n).alias("n"), F.col("content").cast("binary").alias("content")))
        except Exception as e:  # noqa: BLE001
            raise AssertionError(f"{name}: {e}") from e
    got = {r.n: bytes(r.content) for r in reduce(lambda a, b: a.union(b), frames).collect()}
    wrong = [(name, got.get(n)) for n, (name, _, _, want) in enumerate(CASES) if not (want(got[n]) if callable(want) else got.get(n) == want)]
    assert not wrong


@pytest.mark.parametrize("there,back,params", [("streaming_encrypt", "streaming_decrypt", {"key": KEY, "nonce": "00" * 16}), ("streaming_xor", "streaming_xor", {"key": 77}), ("streaming_zstd_compress", "streaming_zstd_decompress", {}), ("streaming_brotli_compress", "streaming_brotli_decompress", {})])
def test_streams_there_and_back(spark, there, back, params):
    x = spark.createDataFrame([(1, i, c) for i, c in enumerate(X)], "stream_id long, chunk_idx long, content binary")
    sent = C.apply(there, x, **params)
    assert bytes(C.whole(C.apply(back, sent, **params)).first().content) == ALL
