"""Format detection, schemas and conversion between text formats."""

from __future__ import annotations

import json
import re

import numpy as np

from ..registry import python
from .config import plain, toml_dump, yaml_dump, yaml_load
from .json_formats import column_label, csv_of, dumps, ndjson_of, ndjson_rows, rows_of

# Format, MIME type, category and first bytes.
MAGIC = (
    ("png", "image/png", "image", b"\x89PNG\r\n\x1a\n"), ("jpeg", "image/jpeg", "image", b"\xff\xd8\xff"), ("gif", "image/gif", "image", b"GIF8"), ("bmp", "image/bmp", "image", b"BM"),
    ("tiff", "image/tiff", "image", b"II*\0"), ("tiff", "image/tiff", "image", b"MM\0*"), ("pdf", "application/pdf", "document", b"%PDF"), ("zip", "application/zip", "archive", b"PK\x03\x04"),
    ("gzip", "application/gzip", "archive", b"\x1f\x8b"), ("bzip2", "application/x-bzip2", "archive", b"BZh"), ("xz", "application/x-xz", "archive", b"\xfd7zXZ\0"), ("zstd", "application/zstd", "archive", b"(\xb5/\xfd"),
    ("7z", "application/x-7z-compressed", "archive", b"7z\xbc\xaf'\x1c"), ("parquet", "application/vnd.apache.parquet", "columnar", b"PAR1"), ("orc", "application/x-orc", "columnar", b"ORC"), ("avro", "application/avro", "columnar", b"Obj\x01"),
    ("sqlite", "application/vnd.sqlite3", "database", b"SQLite format 3\0"), ("elf", "application/x-elf", "executable", b"\x7fELF"), ("wasm", "application/wasm", "executable", b"\0asm"), ("flac", "audio/flac", "audio", b"fLaC"), ("ogg", "audio/ogg", "audio", b"OggS"))
# File extensions and MIME types.
MIME = {"json": "application/json", "csv": "text/csv", "tsv": "text/tab-separated-values", "xml": "application/xml", "yaml": "application/yaml", "toml": "application/toml", "html": "text/html", "txt": "text/plain", "md": "text/markdown",
        "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff",
        "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4", "parquet": "application/vnd.apache.parquet", "avro": "application/avro", "ndjson": "application/x-ndjson", "js": "text/javascript", "css": "text/css", "wasm": "application/wasm"}
TEXT = {"json": "application/json", "ndjson": "application/x-ndjson", "csv": "text/csv", "tsv": "text/tab-separated-values", "xml": "application/xml", "html": "text/html", "yaml": "application/yaml", "toml": "application/toml", "text": "text/plain"}


def detect(d: bytes) -> tuple[str, str, str, float]:
    """(format, MIME type, category, confidence) by first bytes, else by the look of the first 4 KB."""
    for name, mime, kind, magic in MAGIC:
        if d.startswith(magic):
            return name, mime, kind, 0.95
    if d[128:132] == b"DICM":
        return "dicom", "application/dicom", "medical", 0.95
    if b"\0" in d[:4096] or not is_text(d):
        return "unknown", "application/octet-stream", "binary", 0.1
    t = d[:4096].decode(errors="ignore").strip()
    rows = t.splitlines()
    guess = lambda name, kind, c: (name, TEXT[name], kind, c)
    if re.match(r"(?i)<!doctype html|<html", t):
        return guess("html", "document", 0.9)
    if t.startswith("<"):
        return guess("xml", "data", 0.85)
    if re.match(r"\[[\w.\"-]+\]\s*$", rows[0] if rows else "") and len(rows) > 1 and "=" in t:
        return guess("toml", "config", 0.8)
    if t.startswith("{") and len(rows) > 1:
        return guess("ndjson", "data", 0.8) if all(r.strip().startswith("{") and r.strip().endswith("}") for r in rows[:5]) else guess("json", "data", 0.9)
    if t[:1] in ("{", "["):
        return guess("json", "data", 0.9)
    if re.match(r"---(\s|$)|[\w.-]+:(\s|$)", t):
        return guess("yaml", "config", 0.7)
    if len(rows) > 1 and rows[0].count(",") and all(r.count(",") == rows[0].count(",") for r in rows[1:4]):
        return guess("csv", "data", 0.75)
    if len(rows) > 1 and rows[0].count("\t") and all(r.count("\t") == rows[0].count("\t") for r in rows[1:4]):
        return guess("tsv", "data", 0.75)
    return guess("text", "text", 0.5)


def entropy(d: bytes) -> float:
    if not d:
        return 0.0
    n = np.bincount(np.frombuffer(d, np.uint8), minlength=256)
    q = n[n > 0] / len(d)
    return float(-(q * np.log2(q)).sum()) + 0.0


def is_text(d: bytes) -> bool:
    """UTF-8 without NUL, or more than 85 % printable bytes in the first 8 KB."""
    try:
        d.decode()
        return b"\0" not in d
    except UnicodeDecodeError:
        a = np.frombuffer(d[:8192], np.uint8)
        return bool(len(a)) and float(((a >= 32) & (a < 127) | np.isin(a, (9, 10, 13))).mean()) > 0.85


def is_compressed(d: bytes) -> bool:
    return d.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\0", b"(\xb5/\xfd", b"PK\x03\x04", b"7z\xbc\xaf'\x1c", b"Rar!")) or len(d) > 64 and entropy(d) > 7.9


def is_encrypted(d: bytes) -> bool:
    return len(d) >= 16 and not is_compressed(d) and detect(d)[2] == "binary" and not is_text(d) and entropy(d) >= 7.5


@python("format_detect", returns="string")
def format_detect(x, p):
    return dumps(dict(zip(("format", "mime", "category", "confidence"), detect(x[0]), strict=True)))


def parse_as(d: bytes, fmt: str):
    """A JSON value of a text format."""
    t = d.decode()
    readers = {"json": json.loads, "ndjson": ndjson_rows, "csv": rows_of, "tsv": lambda s: rows_of(s, "\t"), "yaml": lambda s: plain(yaml_load(s))}
    if fmt == "toml":
        import tomllib

        return plain(tomllib.loads(t))
    if fmt not in readers:
        raise ValueError(f"no reader for {fmt}")
    return readers[fmt](t)


def write_as(v, fmt: str) -> str:
    table = v if isinstance(v, list) else [v]
    writers = {"json": lambda: dumps(v, 2), "ndjson": lambda: ndjson_of(table), "csv": lambda: csv_of(table), "tsv": lambda: csv_of(table, delimiter="\t"), "yaml": lambda: yaml_dump(v), "toml": lambda: toml_dump(v)}
    if fmt not in writers:
        raise ValueError(f"no writer for {fmt}")
    return writers[fmt]()


@python("format_validate")
def format_validate(x, p):
    fmt = p.choice("format", ("json", "csv", "yaml", "toml", "xml", "parquet", "gzip", "zip", "png", "jpeg", "pdf"))
    if fmt == "xml":
        from xml.etree import ElementTree

        ElementTree.fromstring(x[0])
    elif fmt in ("json", "csv", "yaml", "toml"):
        parse_as(x[0], fmt)
    elif detect(x[0])[0] != fmt:
        raise ValueError(f"no {fmt}")
    return x[0]


@python("universal_metadata", returns="string")
def universal_metadata(x, p):
    fmt, mime, kind, sure = detect(x[0])
    more: dict = {}
    if fmt == "json":
        more = {"type": type_name(json.loads(x[0]))}
    elif fmt in ("csv", "tsv"):
        rows = parse_as(x[0], fmt)
        more = {"columns": list(rows[0]) if rows else [], "row_count": len(rows)}
    elif fmt == "toml":
        more = {"keys": sorted(parse_as(x[0], fmt))}
    return dumps({"format": fmt, "mime": mime, "category": kind, "confidence": sure, "size": len(x[0]), "metadata": more})


def type_name(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


@python("universal_to_json", returns="string")
def universal_to_json(x, p):
    fmt = detect(x[0])[0]
    if fmt not in ("json", "ndjson", "csv", "tsv", "yaml", "toml"):
        return dumps({"format": fmt, "size": len(x[0])})
    v = parse_as(x[0], fmt)
    return dumps(v[: p.int("max_records", 1000)] if isinstance(v, list) else v)


@python("universal_to_text", returns="string")
def universal_to_text(x, p):
    return x[0].decode(errors="replace") if detect(x[0])[0] in TEXT else ""


@python("format_convert", returns="string")
def format_convert(x, p):
    return write_as(parse_as(x[0], p.text("from", detect(x[0])[0])), p.text("to"))


@python("schema_infer", returns="string")
def schema_infer(x, p):
    fmt = detect(x[0])[0]
    v = parse_as(x[0], fmt)
    rows = (v if isinstance(v, list) else [v])[: p.int("sample_rows", 1000)]
    if fmt in ("csv", "tsv"):
        names = {"float": "number"}
        got = {n: names.get(k := column_label([r[n] for r in rows]), k) for n in (rows[0] if rows else {})}
    else:
        got = {k: type_name(w) for k, w in rows[0].items()} if rows and isinstance(rows[0], dict) else {}
    return dumps({"format": fmt, "fields": [{"name": k, "type": t} for k, t in got.items()]})


@python("schema_compare", inputs=2, returns="string")
def schema_compare(x, p):
    a, b = ({f["name"]: f["type"] for f in json.loads(v)["fields"]} for v in x)
    out = [{"change": "removed", "field": k} for k in a if k not in b] + [{"change": "added", "field": k} for k in b if k not in a]
    out += [{"change": "changed", "field": k, "from": a[k], "to": b[k]} for k in a if k in b and a[k] != b[k]]
    return dumps({"compatible": not any(c["change"] != "added" for c in out), "changes": out})


@python("mime_type_map", returns="string")
def mime_type_map(x, p):
    key = x[0].decode().strip().lstrip(".").lower()
    table = MIME if p.choice("direction", ("ext_to_mime", "mime_to_ext"), "ext_to_mime") == "ext_to_mime" else {v: k for k, v in reversed(MIME.items())}
    if key not in table:
        raise ValueError(f"unknown: {key}")
    return table[key]


@python("encoding_detect", returns="string")
def encoding_detect(x, p):
    d = x[0]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if d.startswith(mark):
            return dumps({"encoding": name, "confidence": 1.0})
    if d.isascii() and b"\0" not in d:
        return dumps({"encoding": "ascii", "confidence": 1.0})
    a = np.frombuffer(d, np.uint8)
    if len(a) > 3:
        even, odd = (float((a[i::2] == 0).mean()) for i in (0, 1))
        if max(even, odd) > 0.4 > min(even, odd):
            return dumps({"encoding": "utf-16be" if even > odd else "utf-16le", "confidence": 0.8})
    try:
        d.decode()
        return dumps({"encoding": "utf-8", "confidence": 0.95})
    except UnicodeDecodeError:
        return dumps({"encoding": "iso-8859-1", "confidence": 0.5})


for _name, _test in (("is_text", is_text), ("is_binary", lambda d: not is_text(d)), ("is_compressed", is_compressed), ("is_encrypted", is_encrypted)):
    python(_name, returns="boolean")(lambda x, p, test=_test: bool(test(x[0])))


@python("byte_histogram", returns="string")
def byte_histogram(x, p):
    if not x[0]:
        raise ValueError("empty input")
    return dumps(np.bincount(np.frombuffer(x[0], np.uint8), minlength=256).tolist())


@python("entropy_score", returns="string")
def entropy_score(x, p):
    return f"{entropy(x[0]):.3f}"


@python("structure_heuristic", returns="string")
def structure_heuristic(x, p):
    d, known = x[0], detect(x[0])[2]
    kind, sure = ("compressed", 0.95) if is_compressed(d) else ("text", 0.9) if is_text(d) else ("encrypted", 0.75) if is_encrypted(d) else ("structured_binary", 0.85) if known != "binary" else ("binary", 0.7)
    return dumps({"structure": kind, "confidence": sure, "entropy": round(entropy(d), 3)})
