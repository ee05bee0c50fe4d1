"""Machine-learning containers."""

from __future__ import annotations

import json
import struct

import numpy as np

from ..registry import python, unsupported
from .image import decode_png
from .json_formats import dumps, ndjson_of
from .science import npy_load


def tfrecords(d: bytes):
    at = 0
    while at + 12 <= len(d):
        (n,) = struct.unpack_from("<Q", d, at)
        if at + 16 + n > len(d):
            raise ValueError("record does not end")
        yield d[at + 12 : at + 12 + n]
        at += 16 + n


@python("tfrecord_read", "tfrecord_to_parquet", returns="string")
def tfrecord_read(x, p):
    """Records as NDJSON with hex data; checksums are not looked at."""
    return ndjson_of({"data": r.hex()} for r in tfrecords(x[0]))


_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0x82F63B78 if _c & 1 else 0)
    _CRC[_i] = _c


def masked_crc(d: bytes) -> bytes:
    c = 0xFFFFFFFF
    for b in d:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return struct.pack("<I", ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF)


@python("tfrecord_write")
def tfrecord_write(x, p):
    """One record with its checksums."""
    n = struct.pack("<Q", len(x[0]))
    return n + masked_crc(n) + x[0] + masked_crc(x[0])


def safetensors_header(d: bytes) -> tuple[dict, int]:
    (n,) = struct.unpack_from("<Q", d)
    if 8 + n > len(d):
        raise ValueError("header out of bounds")
    return json.loads(d[8 : 8 + n]), 8 + n


def safetensors(name: str, dtype: str, shape: list[int], data: bytes) -> bytes:
    head = json.dumps({name: {"dtype": dtype, "shape": shape, "data_offsets": [0, len(data)]}}, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    return struct.pack("<Q", len(head)) + head + data


@python("safetensors_read")
def safetensors_read(x, p):
    head, at = safetensors_header(x[0])
    if "tensor" not in p:
        return x[0][at:]
    if p.text("tensor") not in head:
        raise ValueError("no such tensor")
    a, b = head[p.text("tensor")]["data_offsets"]
    return x[0][at + a : at + b]


@python("safetensors_metadata", returns="string")
def safetensors_metadata(x, p):
    return dumps(safetensors_header(x[0])[0])


@python("safetensors_write")
def safetensors_write(x, p):
    return safetensors(p.text("name", "tensor"), p.text("dtype", "F32"), [int(n) for n in p.list("shape", [len(x[0]) // 4])], x[0])


@python("numpy_to_safetensors")
def numpy_to_safetensors(x, p):
    a = npy_load(x[0]).astype("<f4")
    return safetensors(p.text("name", "tensor"), "F32", list(a.shape), a.tobytes())


@python("gguf_metadata", returns="string")
def gguf_metadata(x, p):
    if x[0][:4] != b"GGUF":
        raise ValueError("no GGUF")
    return dumps({"magic": "GGUF", "file_size": len(x[0])})


@python("image_to_tensor")
def image_to_tensor(x, p):
    """PNG pixels as channels x height x width in 32-bit floats, from 0 to 1 if ``normalize``."""
    a = decode_png(x[0])[..., :3].astype("<f4")
    if p.int("channels", 3) == 1:
        a = (a @ np.array([0.299, 0.587, 0.114], "<f4"))[..., None]
    return np.ascontiguousarray((a / 255 if p.bool("normalize", True) else a).transpose(2, 0, 1), "<f4").tobytes()


unsupported("onnx_metadata", "onnx_validate", "pickle_to_json", why="models and pickles are not opened")
