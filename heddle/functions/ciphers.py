"""Ciphers and signatures that Spark lacks, from their published specifications."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

from ..registry import python

_M = 0xFFFFFFFF


def _gf(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _sbox() -> np.ndarray:
    """The AES substitution by its rule: the inverse in GF(2^8), then an affine map."""
    out = np.zeros(256, np.uint8)
    for v in range(256):
        inv = next((w for w in range(256) if _gf(v, w) == 1), 0)
        r = 0x63
        for k in range(5):
            r ^= (inv << k | inv >> (8 - k)) & 255
        out[v] = r
    return out


_SBOX = _sbox()
_DOUBLE = np.array([_gf(v, 2) for v in range(256)], np.uint8)
_ROWS = np.array([(4 * ((i // 4 + i % 4) % 4) + i % 4) for i in range(16)])


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    con = 1
    for i in range(n, 4 * (n + 7)):
        t = list(w[i - 1])
        if i % n == 0:
            t = [int(_SBOX[b]) for b in t[1:] + t[:1]]
            t[0] ^= con
            con = _gf(con, 2)
        elif n > 6 and i % n == 4:
            t = [int(_SBOX[b]) for b in t]
        w.append([a ^ b for a, b in zip(w[i - n], t, strict=True)])
    return np.array(w, np.uint8).reshape(-1, 16)


def aes_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """AES of n x 16 bytes, all blocks at once."""
    keys = _round_keys(key)
    s = blocks ^ keys[0]
    for r, k in enumerate(keys[1:], 1):
        s = _SBOX[s][:, _ROWS]
        if r < len(keys) - 1:
            c = s.reshape(-1, 4, 4)
            nxt = np.roll(c, -1, 2)
            s = (_DOUBLE[c] ^ _DOUBLE[nxt] ^ nxt ^ np.roll(c, -2, 2) ^ np.roll(c, -3, 2)).reshape(-1, 16)
        s = s ^ k
    return s


#: Bytes of a key stream that are made and kept at a time.  Key and nonce are parameters, so all rows of a query share a stream.
PIECE = 1 << 14


def _with_stream(data: bytes, piece) -> bytes:
    """``data`` xor the key stream whose part ``i`` of PIECE bytes is ``piece(i)``."""
    parts = [piece(i) for i in range(-(-len(data) // PIECE))]
    stream = parts[0] if len(parts) == 1 else b"".join(parts)
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8, len(data))).tobytes() if data else b""


@lru_cache(256)
def _ctr_piece(key: bytes, nonce: bytes, i: int) -> bytes:
    n = PIECE // 16
    high, low = struct.unpack(">QQ", nonce)
    with np.errstate(over="ignore"):
        count = np.uint64(low) + np.arange(i * n, i * n + n, dtype=np.uint64)
    block = np.empty((n, 2), ">u8")
    block[:, 0], block[:, 1] = high, count
    return aes_blocks(key, block.view(np.uint8).reshape(n, 16)).tobytes()


def aes_ctr(data: bytes, key: bytes, nonce: bytes) -> bytes:
    """CTR mode; the low 64 bits of the counter count, modulo 2^64."""
    return _with_stream(data, lambda i: _ctr_piece(key, nonce, i))


def _ctr(sizes):
    def f(x, p):
        return aes_ctr(x[0], p.hex("key", sizes), p.hex("nonce", (16,)))

    f.check = lambda p: (p.hex("key", sizes), p.hex("nonce", (16,)))
    return f


python("encrypt", "decrypt")(_ctr((32,)))
python("aes_ctr_encrypt", "aes_ctr_decrypt")(_ctr((16, 32)))


def _chacha(key: bytes, nonce: bytes, first: int, count: int) -> bytes:
    s = np.zeros((16, count), np.uint32)
    s[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    s[4:12] = np.frombuffer(key, "<u4")[:, None]
    s[12] = np.arange(first, first + count, dtype=np.uint64).astype(np.uint32)
    s[13:] = np.frombuffer(nonce, "<u4")[:, None]
    x = s.copy()

    def turn(a, b, c, d):
        for i, j, k, r in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[i] += x[j]
            t = x[k] ^ x[i]
            x[k] = t << np.uint32(r) | t >> np.uint32(32 - r)

    with np.errstate(over="ignore"):
        for _ in range(10):
            for i in range(4):
                turn(i, 4 + i, 8 + i, 12 + i)
            for i in range(4):
                turn(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
        return (x + s).T.astype("<u4").tobytes()


def _poly1305(key: bytes, msg: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    acc, prime = 0, (1 << 130) - 5
    for i in range(0, len(msg), 16):
        acc = (acc + int.from_bytes(msg[i : i + 16] + b"\1", "little")) * r % prime
    return ((acc + int.from_bytes(key[16:], "little")) & (1 << 128) - 1).to_bytes(16, "little")


@lru_cache(16)
def _tag_key(key: bytes, nonce: bytes) -> bytes:
    return _chacha(key, nonce, 0, 1)[:32]


def _tag(key: bytes, nonce: bytes, ct: bytes) -> bytes:
    return _poly1305(_tag_key(key, nonce), ct + b"\0" * (-len(ct) % 16) + struct.pack("<QQ", 0, len(ct)))


@lru_cache(256)
def _chacha_piece(key: bytes, nonce: bytes, i: int) -> bytes:
    return _chacha(key, nonce, 1 + i * (PIECE // 64), PIECE // 64)


def _chacha_xor(data: bytes, key: bytes, nonce: bytes) -> bytes:
    return _with_stream(data, lambda i: _chacha_piece(key, nonce, i))


@python("chacha20_encrypt")
def chacha20_encrypt(x, p):
    """ChaCha20-Poly1305: ciphertext, then the tag."""
    key, nonce = p.hex("key", (32,)), p.hex("nonce", (12,))
    ct = _chacha_xor(x[0], key, nonce)
    return ct + _tag(key, nonce, ct)


@python("chacha20_decrypt")
def chacha20_decrypt(x, p):
    key, nonce = p.hex("key", (32,)), p.hex("nonce", (12,))
    ct, tag = x[0][:-16], x[0][-16:]
    if len(x[0]) < 16 or _tag(key, nonce, ct) != tag:
        raise ValueError("tag does not match")
    return _chacha_xor(ct, key, nonce)


_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P


def _recover(y: int, sign: int):
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - xx) % _P or y >= _P or not x and sign:
        return None
    return (_P - x if x & 1 != sign else x), y


def _plus(a, b):
    (x1, y1, z1, t1), (x2, y2, z2, t2) = a, b
    p, q, r, s = (y1 - x1) * (y2 - x2) % _P, (y1 + x1) * (y2 + x2) % _P, 2 * t1 * t2 * _D % _P, 2 * z1 * z2 % _P
    e, f, g, h = q - p, s - r, s + r, q + p
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point):
    out = (0, 1, 1, 0)
    while n:
        out = _plus(out, point) if n & 1 else out
        point, n = _plus(point, point), n >> 1
    return out


def _full(xy):
    return xy[0], xy[1], 1, xy[0] * xy[1] % _P


_BASE = _full(_recover(4 * pow(5, -1, _P) % _P, 0))


def _pack(point) -> bytes:
    inv = pow(point[2], -1, _P)
    x, y = point[0] * inv % _P, point[1] * inv % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes):
    n = int.from_bytes(b, "little")
    xy = _recover(n & (1 << 255) - 1, n >> 255)
    return _full(xy) if xy else None


def _h(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


@python("ed25519_sign")
def ed25519_sign(x, p):
    seed = hashlib.sha512(p.hex("private_key", (32,))).digest()
    a = int.from_bytes(seed[:32], "little") & (1 << 254) - 8 | 1 << 254
    public = _pack(_times(a, _BASE))
    r = _h(seed[32:], x[0]) % _L
    R = _pack(_times(r, _BASE))
    return R + ((r + _h(R, public, x[0]) * a) % _L).to_bytes(32, "little")


@python("ed25519_verify")
def ed25519_verify(x, p):
    public, sig = p.hex("public_key", (32,)), p.hex("signature", (64,))
    A, R, s = _unpack(public), _unpack(sig[:32]), int.from_bytes(sig[32:], "little")
    if A is None or R is None or s >= _L or _pack(_times(s, _BASE)) != _pack(_plus(R, _times(_h(sig[:32], public, x[0]) % _L, A))):
        raise ValueError("signature does not match")
    return b"\1"


def _g(v, a, b, c, d):
    with np.errstate(over="ignore"):
        for i, j, k, r in ((a, b, d, 32), (c, d, b, 24), (a, b, d, 16), (c, d, b, 63)):
            low = (v[i] & np.uint64(_M)) * (v[j] & np.uint64(_M))
            v[i] = v[i] + v[j] + low + low
            t = v[k] ^ v[i]
            v[k] = t >> np.uint64(r) | t << np.uint64(64 - r)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Argon2's compression of two 1 KiB blocks."""
    r = x ^ y
    z = r.reshape(8, 8, 2).copy()

    def permute(v):  # v: 16 arrays
        for q in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            _g(v, *q)

    rows = [z[:, i // 2, i % 2].copy() for i in range(16)]
    permute(rows)
    for i in range(16):
        z[:, i // 2, i % 2] = rows[i]
    cols = [z[i // 2, :, i % 2].copy() for i in range(16)]
    permute(cols)
    for i in range(16):
        z[i // 2, :, i % 2] = cols[i]
    return z.reshape(-1) ^ r


def _long_hash(data: bytes, size: int) -> bytes:
    head = struct.pack("<I", size)
    if size <= 64:
        return hashlib.blake2b(head + data, digest_size=size).digest()
    out, v = b"", hashlib.blake2b(head + data).digest()
    while size - len(out) > 64:
        out += v[:32]
        rest = size - len(out)
        v = hashlib.blake2b(v, digest_size=min(64, rest) if rest <= 64 else 64).digest()
    return out + v


def argon2id(password: bytes, salt: bytes, passes: int, memory_kb: int, size: int = 32) -> bytes:
    """Argon2id, version 1.3, with one lane."""
    m = 4 * (memory_kb // 4)
    h0 = hashlib.blake2b(struct.pack("<6I", 1, size, memory_kb, passes, 0x13, 2) + struct.pack("<I", len(password)) + password + struct.pack("<I", len(salt)) + salt + struct.pack("<II", 0, 0)).digest()
    block = lambda b: np.frombuffer(b, "<u8").copy()
    mem = np.zeros((m, 128), np.uint64)
    for i in (0, 1):
        mem[i] = block(_long_hash(h0 + struct.pack("<II", i, 0), 1024))
    seg, zero = m // 4, np.zeros(128, np.uint64)
    for t in range(passes):
        for part in range(4):
            fixed = t == 0 and part < 2
            counter = np.zeros(128, np.uint64)
            counter[:6] = (t, 0, part, m, passes, 2)
            addresses = zero
            for i in range(seg):
                if fixed and i % 128 == 0:
                    counter[6] += np.uint64(1)
                    addresses = _mixed(zero, _mixed(zero, counter))
                if t == 0 and part == 0 and i < 2:
                    continue
                at = part * seg + i
                prev = mem[at - 1]
                j1 = int(addresses[i % 128] if fixed else prev[0]) & _M
                area = (part * seg + i - 1) if t == 0 else (m - seg + i - 1)
                back = area - 1 - (area * (j1 * j1 >> 32) >> 32)
                start = 0 if t == 0 or part == 3 else (part + 1) * seg
                new = _mixed(prev, mem[(start + back) % m])
                mem[at] = new if t == 0 else new ^ mem[at]
    return _long_hash(mem[m - 1].tobytes(), size)


@python("argon2_hash")
def argon2_hash(x, p):
    """32 bytes; one lane."""
    return argon2id(x[0], p.hex("salt"), p.int("iterations", 3, low=1), p.int("memory_kb", 65536, low=8))


def _argon_check(p):
    if len(p.hex("salt")) < 16:
        from ..params import InvalidParam

        raise InvalidParam("salt must have 16 bytes or more")


argon2_hash.check = _argon_check
