"""Compression codecs over blobs."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib

import pyarrow as pa

from ..registry import python


@python("compress")
def compress(x, p):
    return zlib.compress(x[0])


@python("decompress")
def decompress(x, p):
    return zlib.decompress(x[0])


@python("zstd_compress", "zstd_frame_compress")
def zstd_compress(x, p):
    import zstandard

    return zstandard.ZstdCompressor(level=p.int("level", 3, 1, 22)).compress(x[0])


@python("zstd_decompress", "zstd_frame_decompress")
def zstd_decompress(x, p):
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(x[0])


@python("lz4_compress")
def lz4_compress(x, p):
    """An LZ4 block after its uncompressed size (four bytes, little-endian)."""
    return struct.pack("<I", len(x[0])) + (pa.compress(x[0], "lz4_raw", asbytes=True) if x[0] else b"\0")


@python("lz4_decompress")
def lz4_decompress(x, p):
    (n,) = struct.unpack_from("<I", x[0])
    return pa.decompress(x[0][4:], n, "lz4_raw", asbytes=True) if n else b""


@python("snappy_compress")
def snappy_compress(x, p):
    return pa.compress(x[0], "snappy", asbytes=True)


@python("snappy_decompress")
def snappy_decompress(x, p):
    n = shift = at = 0
    while True:  # the uncompressed size is a varint in front
        b = x[0][at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return pa.decompress(x[0], n, "snappy", asbytes=True)


@python("brotli_compress")
def brotli_compress(x, p):
    return pa.Codec("brotli", compression_level=p.int("quality", 4, 0, 11)).compress(x[0], asbytes=True)


@python("brotli_decompress")
def brotli_decompress(x, p):
    return pa.CompressedInputStream(pa.BufferReader(x[0]), "brotli").read()


@python("gzip_compress")
def gzip_compress(x, p):
    return gzip.compress(x[0], p.int("level", 6, 0, 9), mtime=0)


@python("gzip_decompress")
def gzip_decompress(x, p):
    return gzip.decompress(x[0])


@python("bzip2_compress")
def bzip2_compress(x, p):
    return bz2.compress(x[0], p.int("level", 6, 1, 9))


@python("bzip2_decompress")
def bzip2_decompress(x, p):
    return bz2.decompress(x[0])


@python("xz_compress")
def xz_compress(x, p):
    return lzma.compress(x[0], preset=p.int("level", 6, 0, 9))


@python("xz_decompress")
def xz_decompress(x, p):
    return lzma.open(io.BytesIO(x[0])).read()
