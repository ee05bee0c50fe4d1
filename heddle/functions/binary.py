"""Executables, meshes and other binaries: headers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import byte_at, raw, to_hex
from ..registry import native, unsupported


def _json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _le32(c, at: int):
    return sum((byte_at(c, F.lit(at + i)).cast("bigint") * (1 << (8 * i)) for i in range(1, 4)), byte_at(c, F.lit(at)).cast("bigint"))


def _must(c, good, why, value, kind="string"):
    return F.when(good, value).otherwise(F.raise_error(F.lit(why)).cast(kind))


@native("wasm_validate")
def wasm_validate(cols, p):
    c = raw(cols[0])
    return _must(c, to_hex(F.substring(c, 1, F.lit(4))).eqNullSafe("0061736d") & (F.octet_length(c) >= 8), "wasm_validate: no module", c, "binary")


@native("wasm_metadata")
def wasm_metadata(cols, p):
    c = raw(cols[0])
    return _must(c, to_hex(F.substring(c, 1, F.lit(4))) == "0061736d", "wasm_metadata: no module", _json(version=_le32(c, 4), size=F.octet_length(c)))


@native("elf_metadata")
def elf_metadata(cols, p):
    c = raw(cols[0])
    of = lambda i, names: F.when(byte_at(c, F.lit(i)) == 1, names[0]).when(byte_at(c, F.lit(i)) == 2, names[1]).otherwise("unknown")
    good = to_hex(F.substring(c, 1, F.lit(4))) == "7f454c46"
    return _must(c, good, "elf_metadata: no ELF file", F.to_json(F.struct(of(4, ("ELF32", "ELF64")).alias("class"), of(5, ("little", "big")).alias("endianness"), F.octet_length(c).alias("size"))))


@native("stl_read")
def stl_read(cols, p):
    """Format and triangles; ASCII files count their facets."""
    c = raw(cols[0])
    ascii_stl = F.trim(F.substring(c, 1, F.lit(6)).cast("string")).startswith("solid")
    facets = F.regexp_count(c.cast("string"), F.lit(r"\bfacet\s+normal\b")).cast("bigint")
    return F.when(ascii_stl, _json(format=F.lit("ascii"), triangle_count=facets)).otherwise(_json(format=F.lit("binary"), triangle_count=_le32(c, 80)))


@native("stl_convert")
def stl_convert(cols, p):
    return raw(cols[0])


unsupported("font_metadata", "woff_to_otf", "otf_to_woff2", "gltf_metadata", "gltf_validate", "dicom_metadata", "dicom_to_image", "dicom_anonymize", why="there is no codec for this format here")
