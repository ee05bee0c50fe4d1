"""Validation: the input passes unchanged, or the task fails with the reason."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..layout import raw, text, to_hex
from ..registry import native, python


def require(c, good, why: str, kind: str = "binary"):
    return F.when(good, c).otherwise(F.raise_error(F.lit(why)).cast(kind))


@native("utf8_validate")
def utf8_validate(cols, p):
    body = raw(cols[0])
    return require(body, F.is_valid_utf8(body.cast("string")), "utf8_validate: no UTF-8")


@native("json_validate")
def json_validate(cols, p):
    return require(raw(cols[0]), F.try_parse_json(text(cols[0])).isNotNull(), "json_validate: no JSON")


@native("magic_bytes")
def magic_bytes(cols, p):
    want = p.hex("expected")
    body = raw(cols[0])
    return require(body, F.substring(body, 1, F.lit(len(want))) == F.lit(want), "magic_bytes: other start")


@native("size_limit")
def size_limit(cols, p):
    return require(raw(cols[0]), F.octet_length(raw(cols[0])) <= p.int("max_bytes", low=0), "size_limit: too large")


@native("non_empty", "not_empty")
def non_empty(cols, p):
    return require(raw(cols[0]), F.octet_length(raw(cols[0])) > 0, "non_empty: empty")


@native("sha256_verify")
def sha256_verify(cols, p):
    return require(raw(cols[0]), F.sha2(raw(cols[0]), 256) == p.hex("expected_hash", (32,)).hex(), "sha256_verify: other digest")


@native("crc32_verify")
def crc32_verify(cols, p):
    return require(raw(cols[0]), F.crc32(raw(cols[0])) == int(p.hex("expected_crc32", (4,)).hex(), 16), "crc32_verify: other checksum")


@native("size_check")
def size_check(cols, p):
    n, high = F.octet_length(raw(cols[0])), p.get("max", "unlimited")
    good = n >= p.int("min", 0, low=0)
    return require(raw(cols[0]), good if high == "unlimited" else good & (n <= p.int("max", low=0)), "size_check: size out of range")


@native("regex_match")
def regex_match(cols, p):
    return require(text(cols[0]), text(cols[0]).rlike(rf"\A(?:{p.text('pattern')})\z"), "regex_match: no match", "string")


# First bytes (hex) and the type they mark.
SNIFF = (("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"),
         ("25504446", "application/pdf"), ("504b0304", "application/zip"), ("1f8b", "application/gzip"), ("7f454c46", "application/x-elf"), ("0061736d", "application/wasm"))


def sniffed(c):
    """MIME type by first bytes, then text/plain for UTF-8, else application/octet-stream."""
    head, out = to_hex(F.substring(raw(c), 1, F.lit(16))), None
    for magic, mime in SNIFF:
        out = F.when(head.startswith(magic), mime) if out is None else out.when(head.startswith(magic), mime)
    return out.when(F.is_valid_utf8(raw(c).cast("string")), "text/plain").otherwise("application/octet-stream")


@native("content_type")
def content_type(cols, p):
    return sniffed(cols[0])


@native("content_type_check")
def content_type_check(cols, p):
    return require(raw(cols[0]), sniffed(cols[0]) == p.text("expected"), "content_type_check: other type")


def schema_errors(value, schema, at: str = "$") -> list[str]:
    """Where a JSON value breaks a JSON Schema (the common keywords)."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{at}: nothing is allowed"]
    out = []
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "number": is_number,
             "integer": is_number and float(value).is_integer() if is_number else False, "boolean": isinstance(value, bool), "null": value is None}
    want = schema.get("type")
    if want and not any(kinds.get(w, False) for w in ([want] if isinstance(want, str) else want)):
        return [f"{at}: is no {want}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not among the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: other constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], f"{at}.{k}")
            elif not any(re.search(rx, k) for rx in schema.get("patternProperties", {})):
                extra = schema.get("additionalProperties", True)
                out += schema_errors(v, extra, f"{at}.{k}")
        for rx, sub in schema.get("patternProperties", {}).items():
            for k, v in value.items():
                if re.search(rx, k):
                    out += schema_errors(v, sub, f"{at}.{k}")
        out += [f"{at}: too few properties"] if len(value) < schema.get("minProperties", 0) else []
        out += [f"{at}: too many properties"] if len(value) > schema.get("maxProperties", len(value)) else []
    if isinstance(value, list):
        if isinstance(schema.get("items"), (dict, bool)):
            for i, v in enumerate(value):
                out += schema_errors(v, schema["items"], f"{at}[{i}]")
        out += [f"{at}: too few items"] if len(value) < schema.get("minItems", 0) else []
        out += [f"{at}: too many items"] if len(value) > schema.get("maxItems", len(value)) else []
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{at}: items repeat")
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: does not match {schema['pattern']}")
    if is_number:
        for key, bad in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b), ("exclusiveMinimum", lambda v, b: v <= b), ("exclusiveMaximum", lambda v, b: v >= b)):
            if key in schema and bad(value, schema[key]):
                out.append(f"{at}: {key} {schema[key]}")
        if "multipleOf" in schema and value % schema["multipleOf"]:
            out.append(f"{at}: no multiple of {schema['multipleOf']}")
    for sub in schema.get("allOf", []):
        out += schema_errors(value, sub, at)
    if "anyOf" in schema and all(schema_errors(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not schema_errors(value, s, at) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: not exactly one of oneOf")
    if "not" in schema and not schema_errors(value, schema["not"], at):
        out.append(f"{at}: matches not")
    return out


@python("schema_validate")
def schema_validate(x, p):
    errors = schema_errors(json.loads(x[0]), json.loads(p.text("schema")))
    if errors:
        raise ValueError("; ".join(errors))
    return x[0]
