"""What a query costs as its table grows, and that results stay the same."""

import math
import time
from collections import Counter

from pyspark.sql import functions as F

from heddle import registry


def test_entropy_of_many_rows(spark):
    df = spark.range(0, 20000, 1, 1).select("id", F.concat(F.lit("aab"), F.col("id").cast("string"), F.lit(" part name")).alias("t"))
    began = time.time()
    got = df.select("t", registry.call("entropy", "t").alias("e")).collect()
    assert time.time() - began < 15  # 256 steps a row took more than a millisecond
    for r in got[::97]:
        n = len(r.t)
        assert math.isclose(r.e, -sum(k / n * math.log2(k / n) for k in Counter(r.t).values()), rel_tol=1e-12)


def test_byte_counts_of_odd_blobs(spark):
    blobs = [b"", b"\0", bytes(range(256)), b"\xff" * 3000, b"\x11\x11\x01\x10" * 5]
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    for r in df.select("b", registry.call("histogram", "b").alias("h"), registry.call("entropy", "b").alias("e")).collect():
        counts = [int.from_bytes(r.h[8 * i : 8 * i + 8], "big") for i in range(256)]
        n = len(r.b)
        assert counts == [bytes(r.b).count(i) for i in range(256)]
        assert math.isclose(r.e, -sum(k / n * math.log2(k / n) for k in counts if k), abs_tol=1e-12)


def test_python_functions_hold_few_rows(spark):
    def rss(x, p):
        with open("/proc/self/statm") as f:
            return str(int(f.read().split()[1]) * 4096 >> 20)

    registry.python("rss_for_test", returns="string")(rss)
    df = spark.range(0, 10000, 1, 1).select(F.repeat(F.lit("x"), 20000).alias("t"))
    try:
        most = lambda d: d.select(registry.call("rss_for_test", "t").cast("int").alias("mb")).agg(F.max("mb")).first()[0]
        base = most(df.limit(1))  # first, as workers are used again
        assert most(df) - base < 60  # 200 MB of texts in one task
    finally:
        registry._functions.pop(registry.FunctionId("rss_for_test"))


def test_python_functions_give_plain_values(spark):
    import numpy as np

    for returns, value, want in (("binary", np.bytes_(b"ab"), b"ab"), ("binary", "é", "é".encode()), ("string", b"ab", "ab"), ("string", np.str_("ab"), "ab"), ("boolean", np.bool_(True), True), ("binary", None, None)):
        got = registry.plain_value(value, returns)
        assert got == want and type(got) is type(want)


def test_key_streams_are_made_once(monkeypatch):
    import numpy as np

    from heddle.functions import ciphers as C

    made = []
    blocks = C.aes_blocks
    monkeypatch.setattr(C, "aes_blocks", lambda key, b: made.append(len(b)) or blocks(key, b))
    key, nonce = bytes(range(32)), b"\xff" * 16
    texts = [bytes([i % 251]) * n for i, n in enumerate((0, 1, 15, 16, 17, C.PIECE - 1, C.PIECE, C.PIECE + 1, 3 * C.PIECE + 5, *[2000] * 500))]
    sealed = [C.aes_ctr(t, key, nonce) for t in texts]
    assert sum(made) <= 5 * C.PIECE // 16  # a stream for each row took its whole length each time
    low = (2**64 - 1 + np.arange(4 * C.PIECE // 16, dtype=object)) % 2**64
    plain = np.array([list(b"\xff" * 8 + int(n).to_bytes(8, "big")) for n in low], np.uint8)
    stream = blocks(key, plain).tobytes()
    for t, c in zip(texts, sealed, strict=True):
        assert c == bytes(a ^ b for a, b in zip(t, stream, strict=False))
    whole = C._chacha(key, nonce[:12], 1, 4 * C.PIECE // 64)
    for t in texts[:9]:
        assert C._chacha_xor(t, key, nonce[:12]) == bytes(a ^ b for a, b in zip(t, whole, strict=False))


def test_coded_letter_counts(spark):
    from heddle.llm import line_dedup as L

    period = 2 * L.LANE
    for a in range(60):
        for b in range(60):
            bits = (L.CODES[a % period] ^ L.CODES[b % period]).bit_count()
            assert bits <= abs(a - b) and (abs(a - b) > L.LANE or bits == abs(a - b))
    lines = ["e" * n + "xz q" * (n % 3) for n in range(30)]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, norm string").selectExpr("node", "norm", "length(norm) as size", *L.counts_of("norm"))
    assert len(L.marks(texts, "a").columns) <= 8  # what is shuffled for each end of a pair: 25 columns before
    pairs = L.marks(texts, "a").crossJoin(L.marks(texts, "b"))
    may = {(r.a, r.b) for r in pairs.where(L.may_link("a", "b")).select("a", "b").collect()}
    links = texts.alias("x").crossJoin(texts.alias("y")).where("levenshtein(x.norm, y.norm) <= floor(greatest(x.size, y.size) * 0.1)").selectExpr("x.node as a", "y.node as b").collect()
    assert {(r.a, r.b) for r in links} <= may and len(may) < len(lines) ** 2 / 2
