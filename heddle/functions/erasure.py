"""Erasure coding over GF(2^8), parity, replication and striping."""

from __future__ import annotations

import struct

import numpy as np

from ..registry import python

# Logarithms over GF(2^8) with the polynomial x^8 + x^4 + x^3 + x^2 + 1 and generator 2, from the rule itself.
_EXP = np.zeros(512, np.int64)
_LOG = np.zeros(256, np.int64)
_v = 1
for _i in range(255):
    _EXP[_i] = _EXP[_i + 255] = _v
    _LOG[_v] = _i
    _v = _v << 1 ^ (0x11D if _v & 128 else 0)


def mul(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + _LOG[b]])


def inverse(m: np.ndarray) -> np.ndarray:
    """Matrix inverse by elimination."""
    n = len(m)
    a = np.concatenate([m.copy(), np.eye(n, dtype=np.int64)], 1)
    for i in range(n):
        pivot = next((r for r in range(i, n) if a[r, i]), None)
        if pivot is None:
            raise ValueError("matrix has no inverse")
        a[[i, pivot]] = a[[pivot, i]]
        a[i] = mul(a[i], _EXP[255 - _LOG[a[i, i]]])
        for r in range(n):
            if r != i and a[r, i]:
                a[r] ^= mul(a[i], a[r, i])
    return a[:, n:]


def matmul(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), x.shape[1]), np.int64)
    for j in range(m.shape[1]):
        out ^= mul(m[:, j : j + 1], x[j][None])
    return out


def matrix(data: int, parity: int) -> np.ndarray:
    """Vandermonde rows, reduced so that the first ``data`` rows are the identity."""
    total = data + parity
    v = np.array([[1 if c == 0 else 0 if r == 0 else int(_EXP[_LOG[r] * c % 255]) for c in range(data)] for r in range(total)], np.int64)
    return matmul(v, inverse(v[:data]))


def _split(d: bytes, n: int) -> np.ndarray:
    """Length (four bytes, little-endian) and data, zero-padded, as n rows."""
    body = struct.pack("<I", len(d)) + d
    size = -(-len(body) // n)
    return np.frombuffer(body.ljust(size * n, b"\0"), np.uint8).reshape(n, size).astype(np.int64)


def _joined(rows: np.ndarray) -> bytes:
    body = rows.astype(np.uint8).tobytes()
    (n,) = struct.unpack_from("<I", body)
    if n > len(body) - 4:
        raise ValueError("bad length")
    return body[4 : 4 + n]


def _shards(d: bytes, n: int) -> np.ndarray:
    if len(d) % n or not d:
        raise ValueError(f"length is no multiple of {n} shards")
    return np.frombuffer(d, np.uint8).reshape(n, -1).astype(np.int64)


def _counts(p) -> tuple[int, int]:
    return p.int("data_shards", 4, 1, 128), p.int("parity_shards", 2, 1, 127)


@python("rs_encode")
def rs_encode(x, p):
    k, m = _counts(p)
    rows = _split(x[0], k)
    return np.concatenate([rows, matmul(matrix(k, m)[k:], rows)]).astype(np.uint8).tobytes()


@python("rs_decode")
def rs_decode(x, p):
    k, m = _counts(p)
    rows, lost = _shards(x[0], k + m), {int(i) for i in p.list("missing", [])}
    have = [i for i in range(k + m) if i not in lost][:k]
    if len(have) < k:
        raise ValueError("too many shards are missing")
    return _joined(matmul(inverse(matrix(k, m)[have]), rows[have]))


@python("rs_verify")
def rs_verify(x, p):
    k, m = _counts(p)
    rows = _shards(x[0], k + m)
    if (matmul(matrix(k, m)[k:], rows[:k]) != rows[k:]).any():
        raise ValueError("parity does not match")
    return x[0]


@python("xor_parity")
def xor_parity(x, p):
    rows = _split(x[0], p.int("shard_count", 3, low=1))
    return np.concatenate([rows, np.bitwise_xor.reduce(rows, 0)[None]]).astype(np.uint8).tobytes()


@python("xor_reconstruct")
def xor_reconstruct(x, p):
    n = p.int("shard_count", 3, low=1)
    rows, lost = _shards(x[0], n + 1).copy(), p.int("missing", low=0, high=n)
    rows[lost] = 0
    rows[lost] = np.bitwise_xor.reduce(rows, 0)
    return _joined(rows[:n])


@python("replication_split")
def replication_split(x, p):
    return x[0] * p.int("replicas", 3, low=1)


@python("replication_verify")
def replication_verify(x, p):
    n = p.int("replicas", 3, low=1)
    size = len(x[0]) // n
    if len(x[0]) % n or x[0] != x[0][:size] * n:
        raise ValueError("replicas differ")
    return x[0][:size]


def _stripes(p) -> tuple[int, int]:
    return p.int("stripe_count", 4, low=1), p.int("stripe_size", 65536, low=1)


@python("stripe_split")
def stripe_split(x, p):
    """Blocks dealt in turn to the stripes; the stripes follow each other, padded with zeros."""
    n, size = _stripes(p)
    body = struct.pack("<I", len(x[0])) + x[0]
    rounds = -(-len(body) // (n * size))
    return np.frombuffer(body.ljust(rounds * n * size, b"\0"), np.uint8).reshape(rounds, n, size).transpose(1, 0, 2).tobytes()


@python("stripe_assemble")
def stripe_assemble(x, p):
    n, size = _stripes(p)
    return _joined(np.frombuffer(x[0], np.uint8).reshape(n, -1, size).transpose(1, 0, 2))
