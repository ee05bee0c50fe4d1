"""Digests, MACs and AEAD ciphers that Spark has; see ``ciphers`` for the others."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..layout import big_endian, raw, text
from ..registry import native, python


def sha(c, bits):
    return F.unhex(F.sha2(raw(c), bits))


@native("sha256", "sha256_acc")
def sha256(cols, p):
    return sha(cols[0], 256)


@native("sha384")
def sha384(cols, p):
    return sha(cols[0], 384)


@native("sha512", "sha512_acc")
def sha512(cols, p):
    return sha(cols[0], 512)


@native("md5")
def md5(cols, p):
    return F.unhex(F.md5(raw(cols[0])))


@native("crc32", "crc32_acc")
def crc32(cols, p):
    """Four bytes, big-endian."""
    return big_endian(F.crc32(raw(cols[0])), 4)


@python("checksum_adler32")
def adler32(x, p):
    return zlib.adler32(x[0]).to_bytes(4, "big")


def hmac_of(c, key: bytes):
    """HMAC-SHA-256 from two nested digests; the padded keys are literals."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return sha(F.concat(F.lit(outer), sha(F.concat(F.lit(inner), raw(c)), 256)), 256)


@native("hmac_sha256", "hmac")
def hmac_sha256(cols, p):
    return hmac_of(cols[0], p.hex("key"))


def gcm_encrypt(c, key: bytes, nonce: bytes):
    """Ciphertext and tag; Spark puts the nonce in front, which is cut off."""
    return F.substring(F.aes_encrypt(raw(c), F.lit(key), F.lit("GCM"), F.lit("NONE"), F.lit(nonce)), 13, F.lit(2**31 - 1))


def gcm_decrypt(c, key: bytes, nonce: bytes):
    return F.aes_decrypt(F.concat(F.lit(nonce), raw(c)), F.lit(key), F.lit("GCM"), F.lit("NONE"))


@native("aead_encrypt")
def aead_encrypt(cols, p):
    return gcm_encrypt(cols[0], p.hex("key", (32,)), p.hex("nonce", (12,)))


@native("aead_decrypt")
def aead_decrypt(cols, p):
    return gcm_decrypt(cols[0], p.hex("key", (32,)), p.hex("nonce", (12,)))


@native("aes_gcm_encrypt")
def aes_gcm_encrypt(cols, p):
    return gcm_encrypt(cols[0], p.hex("key", (16, 32)), p.hex("nonce", (12,)))


@native("aes_gcm_decrypt")
def aes_gcm_decrypt(cols, p):
    return gcm_decrypt(cols[0], p.hex("key", (16, 32)), p.hex("nonce", (12,)))


@native("redact")
def redact(cols, p):
    c = text(cols[0])
    for pattern in p.list("patterns"):
        c = F.regexp_replace(c, pattern, "[REDACTED]")
    return c
