"""Byte transforms and encodings."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import functions as F

from ..layout import raw, text, to_hex
from ..params import InvalidParam
from ..registry import native, python

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIM = r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z"


def ascii_lower(c):
    return F.translate(text(c), UPPER, LOWER)


def ascii_upper(c):
    return F.translate(text(c), LOWER, UPPER)


@native("identity")
def identity(cols, p):
    return cols[0]


@native("concat", inputs=(0, None))
def concat(cols, p):
    return F.concat(*(raw(c) for c in cols)) if cols else F.lit(b"")


@native("uppercase")
def uppercase(cols, p):
    return F.upper(text(cols[0]))


@native("lowercase")
def lowercase(cols, p):
    """ASCII letters only."""
    return ascii_lower(cols[0])


@native("repeat")
def repeat(cols, p):
    return F.repeat(text(cols[0]), p.int("count", low=1))


def reversed_bytes(c):
    pairs = F.regexp_extract_all(F.hex(raw(c)), F.lit("..", ), F.lit(0))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


@native("reverse", "reverse_bytes")
def reverse(cols, p):
    """Bytes in reverse order."""
    return reversed_bytes(cols[0])


@native("sort_bytes")
def sort_bytes(cols, p):
    return F.unhex(F.array_join(F.array_sort(F.regexp_extract_all(F.hex(raw(cols[0])), F.lit(".."), F.lit(0))), ""))


def flat_base64(c):
    """Base64 on one line; Spark may break lines at 76 characters."""
    return F.regexp_replace(F.base64(raw(c)), "\r\n", "")


@native("base64_encode")
def base64_encode(cols, p):
    return flat_base64(cols[0])


@native("base64_decode")
def base64_decode(cols, p):
    return F.to_binary(text(cols[0]), F.lit("base64"))


@native("base64url_encode")
def base64url_encode(cols, p):
    return F.regexp_replace(F.translate(flat_base64(cols[0]), "+/", "-_"), "=+$", "")


@native("base64url_decode")
def base64url_decode(cols, p):
    t = F.translate(text(cols[0]), "-_", "+/")
    return F.to_binary(F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)))), F.lit("base64"))


@native("hex_encode")
def hex_encode(cols, p):
    return to_hex(cols[0])


@native("hex_decode")
def hex_decode(cols, p):
    t = text(cols[0])
    good = t.rlike(r"^([0-9a-fA-F]{2})*\z")
    return F.when(good, F.unhex(t)).otherwise(F.raise_error(F.lit("hex_decode: no hex string")).cast("binary"))


@python("base32_encode")
def base32_encode(x, p):
    return base64.b32encode(x[0])


@python("base32_decode")
def base32_decode(x, p):
    return base64.b32decode(x[0])



def _byte(key, default=None):
    return lambda p: p.int(key, default, 0, 255)


def _bytewise(name, key, fn):
    def f(x, p):
        return fn(np.frombuffer(x[0], np.uint8), np.uint8(p.int(key, low=0, high=255))).tobytes()

    f.check = _byte(key)
    f.__doc__ = f"Every byte combined with the byte ``{key}``."
    python(name)(f)
    return f


xor = _bytewise("xor", "key", np.bitwise_xor)
bitwise_and = _bytewise("bitwise_and", "mask", np.bitwise_and)
bitwise_or = _bytewise("bitwise_or", "mask", np.bitwise_or)


@native("bitwise_not")
def bitwise_not(cols, p):
    return F.unhex(F.translate(F.hex(raw(cols[0])), "0123456789ABCDEF", "FEDCBA9876543210"))


@native("byte_swap")
def byte_swap(cols, p):
    """Bytes reversed within words of 2, 4 or 8 bytes."""
    size = p.int("word_size")
    if size not in (2, 4, 8):
        raise InvalidParam("word_size must be 2, 4 or 8")
    body = raw(cols[0])
    pattern = "".join("(..)" for _ in range(size))
    swapped = F.unhex(F.regexp_replace(F.hex(body), pattern, "".join(f"${i}" for i in range(size, 0, -1))))
    return F.when(F.octet_length(body) % size == 0, swapped).otherwise(F.raise_error(F.lit("byte_swap: length is no multiple of the word size")).cast("binary"))


@native("trim")
def trim(cols, p):
    return F.regexp_replace(text(cols[0]), _TRIM, "")


@native("pad")
def pad(cols, p):
    """PKCS#7 padding."""
    size = p.int("block_size", low=1, high=255)
    body = raw(cols[0])
    n = F.lit(size) - F.octet_length(body) % size
    return F.concat(body, F.unhex(F.repeat(F.lpad(F.hex(n.cast("bigint")), 2, "0"), n)))


@native("line_ending")
def line_ending(cols, p):
    target = p.choice("target", ("lf", "crlf"))
    return F.regexp_replace(text(cols[0]), "\r\n", "\n") if target == "lf" else F.regexp_replace(text(cols[0]), "(?<!\r)\n", "\r\n")


@native("url_encode")
def url_encode(cols, p):
    """RFC 3986: all but unreserved characters as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text(cols[0])), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


@python("url_decode")
def url_decode(x, p):
    """Lenient: what is no %XX stays."""
    from urllib.parse import unquote_to_bytes

    return unquote_to_bytes(x[0])


@native("html_encode")
def html_encode(cols, p):
    c = text(cols[0])
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@python("html_decode", returns="string")
def html_decode(x, p):
    """Five named entities and numeric ones; any other ampersand is an error."""
    import re

    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m):
        body = m[1]
        if body is None:
            raise ValueError("entity does not end")
        if body[:2] in ("#x", "#X"):
            return chr(int(body[2:], 16))
        if body[:1] == "#":
            return chr(int(body[1:]))
        if body not in names:
            raise ValueError(f"unknown entity {body}")
        return names[body]

    return re.sub(r"&(?:([^&;\s]{1,32});)?", one, x[0].decode())


_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"  # fixed value


@python("base58_encode", returns="string")
def base58_encode(x, p):
    return b58(x[0])


def b58(raw_bytes: bytes) -> str:
    n, out = int.from_bytes(raw_bytes, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = _B58[r] + out
    return "1" * (len(raw_bytes) - len(raw_bytes.lstrip(b"\0"))) + out


@python("base58_decode")
def base58_decode(x, p):
    return unb58(x[0].decode())


def unb58(s: str) -> bytes:
    n = 0
    for c in s:
        if c not in _B58:
            raise ValueError(f"bad base58 character {c!r}")
        n = n * 58 + _B58.index(c)
    return b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
