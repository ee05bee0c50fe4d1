"""Content addresses.

The engine's address is SHA-256, a Spark expression; ``algorithm="blake3"`` gives BLAKE3 addresses, in Python.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import raw
from ..params import InvalidParam
from ..registry import get, native, python
from .hashing import sha
from .slicing import pieces

# Fixed values of BLAKE3: initial state and the order in which a round's words go on.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_M = 0xFFFFFFFF


def _squeeze(cv, block: bytes, count: int, size: int, flags: int) -> list[int]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    s = [*cv, *_IV[:4], count & _M, count >> 32, size, flags]
    quarters = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(quarters):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                s[a] = (s[a] + s[b] + word) & _M
                t = s[d] ^ s[a]
                s[d] = (t >> r1 | t << (32 - r1)) & _M
                s[c] = (s[c] + s[d]) & _M
                t = s[b] ^ s[c]
                s[b] = (t >> r2 | t << (32 - r2)) & _M
        m = [m[i] for i in _ORDER]
    return [s[i] ^ s[i + 8] for i in range(8)]


def blake3_digest(data: bytes) -> bytes:
    """The 32-byte BLAKE3 digest: chunks of 1024 bytes in a left-heavy binary tree."""
    def chunk(part: bytes, index: int, root: int) -> list[int]:
        cv = list(_IV)
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, b in enumerate(blocks):
            flags = (_START if i == 0 else 0) | (_END | root if i == len(blocks) - 1 else 0)
            cv = _squeeze(cv, b.ljust(64, b"\0"), index, len(b), flags)
        return cv

    def tree(lo: int, hi: int, root: int) -> list[int]:
        if hi - lo == 1:
            return chunk(data[lo * 1024 : hi * 1024], lo, root)
        left = 1 << (hi - lo - 1).bit_length() - 1
        both = tree(lo, lo + left, 0) + tree(lo + left, hi, 0)
        return _squeeze(list(_IV), b"".join(w.to_bytes(4, "little") for w in both), 0, 64, _PARENT | root)

    return b"".join(w.to_bytes(4, "little") for w in tree(0, max(1, -(-len(data) // 1024)), _ROOT))


@python("blake3", "blake3_acc")
def blake3(x, p):
    return blake3_digest(x[0])


def digest(c, algorithm: str):
    if algorithm == "blake3":
        return get("blake3")(raw(c))
    if algorithm == "md5":
        return F.unhex(F.md5(raw(c)))
    if algorithm in ("sha256", "sha512"):
        return sha(c, int(algorithm[3:]))
    raise InvalidParam(f"unknown algorithm {algorithm}")


@native("caddr_compute", "caddr_of_leaf")
def caddr_compute(cols, p):
    return digest(cols[0], p.text("algorithm", "sha256"))


@native("caddr_verify")
def caddr_verify(cols, p):
    good = digest(cols[0], p.text("algorithm", "sha256")) == F.lit(p.hex("expected_caddr", (32,)))
    return F.when(good, raw(cols[0])).otherwise(F.raise_error(F.lit("caddr_verify: other address")).cast("binary"))


@native("caddr_embed")
def caddr_embed(cols, p):
    return F.concat(raw(cols[0]), digest(cols[0], p.text("algorithm", "sha256")))


def root_of(leaves, algorithm: str, odd: str):
    """Merkle root over a list of digest Columns; an odd node is promoted or doubled."""
    level = list(leaves)
    while len(level) > 1:
        rest = [level[-1]] if len(level) % 2 else []
        up = [digest(F.concat(a, b), algorithm) for a, b in zip(level[::2], level[1::2], strict=False)]
        if rest:
            up.append(rest[0] if odd == "promote" else digest(F.concat(rest[0], rest[0]), algorithm))
        level = up
    return level[0]


@native("merkle_root", inputs=(2, None))
def merkle_root(cols, p):
    algorithm = p.text("algorithm", "sha256")
    return root_of([digest(c, algorithm) for c in cols], algorithm, "promote")


@native("chunk_hash")
def chunk_hash(cols, p):
    """SHA-256 digests of all chunks, one after another."""
    return F.unhex(F.array_join(F.transform(pieces(cols[0], p.int("block_size", 65536, low=1)), lambda h: F.sha2(F.unhex(h), 256)), ""))


@python("dedup_analyze", returns="string")
def dedup_analyze(x, p):
    """Content-defined chunk boundaries as a JSON list."""
    import json

    return json.dumps(boundaries(x[0], p.int("window_size", 48, low=1)))


def boundaries(data: bytes, window: int = 48, low: int = 2048, high: int = 65536, mask: int = 0x1FFF) -> list[int]:
    """Ends of chunks where a rolling hash (base 31, modulo 2^32) over ``window`` bytes has the bits of ``mask`` zero."""
    out, start, h = [], 0, 0
    drop = pow(31, window, 1 << 32)
    for i, b in enumerate(data):
        h = (h * 31 + b - (data[i - window] * drop if i - start >= window else 0)) & _M
        size = i + 1 - start
        if size >= low and h & mask == 0 or size >= high:
            out.append(i + 1)
            start, h = i + 1, 0
    return out + ([len(data)] if start < len(data) else [])


@native("embed_metadata")
def embed_metadata(cols, p):
    meta = p.text("metadata").encode()
    return F.concat(F.lit(len(meta).to_bytes(4, "big") + meta), raw(cols[0]))


@native("strip_metadata")
def strip_metadata(cols, p):
    body = raw(cols[0])
    n = F.conv(F.hex(F.substring(body, 1, F.lit(4))), 16, 10).cast("bigint")
    good = (F.octet_length(body) >= 4) & (n + 4 <= F.octet_length(body))
    return F.when(good, F.substring(body, (n + 5).cast("int"), F.lit(2**31 - 1))).otherwise(F.raise_error(F.lit("strip_metadata: header out of bounds")).cast("binary"))


@native("content_hash")
def content_hash(cols, p):
    return digest(cols[0], p.choice("algorithm", ("sha256", "sha512", "blake3", "md5"), "sha256"))
