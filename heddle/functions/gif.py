"""GIF frames: LZW decoding, interlacing, transparency and disposal."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np

from ..registry import python
from .image import encode_png
from .json_formats import dumps


def unpacked(codes: bytes, first_bits: int, size: int) -> np.ndarray:
    """Up to ``size`` palette indices of an LZW stream whose roots take ``first_bits`` bits."""
    clear, stop = 1 << first_bits, (1 << first_bits) + 1
    table: list[bytes] = []
    out, bits, held, have, last = bytearray(), first_bits + 1, 0, 0, b""
    for byte in codes:
        held |= byte << have
        have += 8
        while have >= bits:
            code = held & ((1 << bits) - 1)
            held >>= bits
            have -= bits
            if code == clear:
                table, bits, last = [bytes([i]) for i in range(clear)] + [b"", b""], first_bits + 1, b""
                continue
            if code == stop or len(out) >= size:
                return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)
            if not table or code > len(table) or code == len(table) and not last:
                raise ValueError("bad LZW code")
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last and len(table) < 4096:
                table.append(last + word[:1])
            if len(table) == 1 << bits and bits < 12:
                bits += 1
            last = word
    return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)


def frames(d: bytes) -> Iterator[np.ndarray]:
    """Height x width x 4 pixels of each frame, as it is shown."""
    if d[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", d, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        colours = np.frombuffer(d, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while d[at]:
            parts.append(d[at + 1 : at + 1 + d[at]])
            at += 1 + d[at]
        at += 1
        return b"".join(parts)

    common = palette(flags) if flags & 128 else np.zeros((256, 3), np.uint8)
    canvas, clear, disposal = np.zeros((height, width, 4), np.uint8), None, 0
    while at < len(d) and d[at] != 0x3B:
        kind = d[at]
        at += 1
        if kind == 0x21:
            label = d[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                disposal, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("bad block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", d, at)
        at += 9
        colours = palette(flags) if flags & 128 else common
        bits = d[at]
        at += 1
        index = unpacked(blocks(), bits, w * h).reshape(h, w)
        if flags & 64:
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            index = index[np.argsort(order)]
        before = canvas.copy()
        shown = np.ones((h, w), bool) if clear is None else index != clear
        area = canvas[top : top + h, left : left + w]
        rgba = np.dstack([colours[np.minimum(index, len(colours) - 1)], np.full((h, w), 255, np.uint8)])[: area.shape[0], : area.shape[1]]
        shown = shown[: area.shape[0], : area.shape[1]]
        area[shown] = rgba[shown]
        yield canvas.copy()
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        clear, disposal = None, 0


@python("gif_extract_frames", returns="string")
def gif_extract_frames(x, p):
    return dumps({"frames": [{"frame": i, "data_base64": base64.b64encode(encode_png(px)).decode()} for i, px in enumerate(frames(x[0]))]})
