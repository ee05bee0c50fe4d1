"""Images: headers of common formats, and PNG pixels by a codec of zlib and numpy."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from ..registry import python, unsupported
from .json_formats import dumps

PNG = b"\x89PNG\r\n\x1a\n"
_COLORS = {0: "L8", 2: "Rgb8", 3: "Palette", 4: "La8", 6: "Rgba8"}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_MIME = (("png", "image/png", PNG), ("jpeg", "image/jpeg", b"\xff\xd8\xff"), ("gif", "image/gif", b"GIF8"), ("bmp", "image/bmp", b"BM"), ("tiff", "image/tiff", b"II*\0"), ("tiff", "image/tiff", b"MM\0*"))


def _chunks(d: bytes):
    at = 8
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        yield kind, d[at + 8 : at + 8 + n]
        at += 12 + n


def decode_png(d: bytes) -> np.ndarray:
    """Height x width x 4 of a non-interlaced PNG with 8-bit samples."""
    if not d.startswith(PNG):
        raise ValueError("only PNG is decoded")
    parts = list(_chunks(d))
    w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or lace:
        raise ValueError("only 8-bit PNG without interlacing is decoded")
    bpp = _CHANNELS[color]
    rows = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    above = np.zeros(w * bpp, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(w, bpp), 0, dtype=np.uint8).ravel()
        else:
            cur = [0] * bpp + [0] * (w * bpp)
            up = [0] * bpp + above.tolist()
            for i, v in enumerate(line.tolist(), bpp):
                a, b, c = cur[i - bpp], up[i], up[i - bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (v + guess) & 255
            out[y] = cur[bpp:]
        above = out[y]
    px = out.reshape(h, w, bpp)
    if color == 3:
        table = np.frombuffer(next(b for k, b in parts if k == b"PLTE"), np.uint8).reshape(-1, 3)
        px = table[px[..., 0]]
    if px.shape[2] in (1, 2):
        px = np.concatenate([np.repeat(px[..., :1], 3, 2), px[..., 1:]], 2)
    return px if px.shape[2] == 4 else np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], 2)


def encode_png(px: np.ndarray) -> bytes:
    """PNG of height x width (gray), x 3 or x 4 pixels."""
    px = np.ascontiguousarray(px, np.uint8)
    px = px[..., None] if px.ndim == 2 else px
    h, w, n = px.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * n)], 1).tobytes()
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 9)) + chunk(b"IEND", b"")


def kind_of(d: bytes) -> tuple[str, str]:
    for name, mime, magic in _MIME:
        if d.startswith(magic):
            return name, mime
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        return "webp", "image/webp"
    if re.match(rb"\s*(<\?xml[^>]*>\s*)?<svg", d):
        return "svg", "image/svg+xml"
    return "unknown", "application/octet-stream"


@python("image_detect_format", returns="string")
def image_detect_format(x, p):
    return dumps(dict(zip(("format", "mime"), kind_of(x[0]), strict=True)))


@python("image_metadata", returns="string")
def image_metadata(x, p):
    d, (kind, _) = x[0], kind_of(x[0])
    color = "Rgb8"
    if kind == "png":
        w, h, _, c = struct.unpack_from(">IIBB", d, 16)
        color = _COLORS.get(c, "unknown")
    elif kind == "gif":
        w, h = struct.unpack_from("<HH", d, 6)
    elif kind == "bmp":
        w, h = struct.unpack_from("<ii", d, 18)
    elif kind == "jpeg":
        at = 2
        while not (0xC0 <= d[at + 1] <= 0xCF and d[at + 1] not in (0xC4, 0xC8, 0xCC)):
            at += 2 + struct.unpack_from(">H", d, at + 2)[0]
        h, w, n = struct.unpack_from(">HHB", d, at + 5)
        color = "L8" if n == 1 else "Rgb8"
    else:
        raise ValueError(f"no header reader for {kind}")
    return dumps({"width": w, "height": abs(h), "format": kind, "color_type": color})


def resized(px: np.ndarray, w: int, h: int, smooth: bool = True) -> np.ndarray:
    """Bilinear (pixel centres), or nearest."""
    y = (np.arange(h) + 0.5) * px.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * px.shape[1] / w - 0.5
    if not smooth:
        return px[np.clip(np.rint(y), 0, px.shape[0] - 1).astype(int)][:, np.clip(np.rint(x), 0, px.shape[1] - 1).astype(int)]
    y, x = np.clip(y, 0, px.shape[0] - 1), np.clip(x, 0, px.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, px.shape[0] - 1), np.minimum(x0 + 1, px.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = px.astype(float)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


@python("image_resize")
def image_resize(x, p):
    how = p.choice("filter", ("nearest", "bilinear", "lanczos3"), "bilinear")
    if how == "lanczos3":
        raise ValueError("lanczos3 is not supported")
    return encode_png(resized(decode_png(x[0]), p.int("width", low=1), p.int("height", low=1), how == "bilinear"))


@python("image_crop")
def image_crop(x, p):
    px, (a, b, w, h) = decode_png(x[0]), (p.int(k, low=0) for k in ("x", "y", "width", "height"))
    if a + w > px.shape[1] or b + h > px.shape[0] or not w or not h:
        raise ValueError("crop is out of bounds")
    return encode_png(px[b : b + h, a : a + w])


@python("image_rotate")
def image_rotate(x, p):
    return encode_png(np.rot90(decode_png(x[0]), -int(p.choice("degrees", ("90", "180", "270"))) // 90))


@python("image_thumbnail")
def image_thumbnail(x, p):
    px, most = decode_png(x[0]), p.int("max_dimension", 128, low=1)
    s = min(1.0, most / max(px.shape[:2]))
    return encode_png(resized(px, max(1, round(px.shape[1] * s)), max(1, round(px.shape[0] * s))))


@python("image_strip_metadata", "png_optimize")
def image_strip_metadata(x, p):
    """Decoded and encoded again, so only pixels stay."""
    return encode_png(decode_png(x[0]))


@python("image_convert")
def image_convert(x, p):
    if p.choice("format", ("png", "bmp", "jpeg", "gif", "webp", "tiff")) == "png":
        return encode_png(decode_png(x[0]))
    if p.text("format") != "bmp":
        raise ValueError("only PNG and BMP are encoded")
    px = decode_png(x[0])[::-1, :, 2::-1]
    h, w = px.shape[:2]
    body = np.concatenate([px.reshape(h, w * 3), np.zeros((h, -w * 3 % 4), np.uint8)], 1).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def gray(px: np.ndarray) -> np.ndarray:
    return np.rint(px[..., :3] @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


@python("image_to_grayscale")
def image_to_grayscale(x, p):
    return encode_png(gray(decode_png(x[0])))


@python("image_watermark", inputs=2)
def image_watermark(x, p):
    base, mark = (decode_png(v).astype(float) for v in x)
    (H, W), (h, w) = base.shape[:2], mark.shape[:2]
    where = p.choice("position", ("center", "bottom-right", "tile"), "bottom-right")
    spots = [(y, c) for y in range(0, H, h) for c in range(0, W, w)] if where == "tile" else [((H - h) // 2, (W - w) // 2)] if where == "center" else [(H - h, W - w)]
    for y, c in spots:
        y0, c0, y1, c1 = max(y, 0), max(c, 0), min(y + h, H), min(c + w, W)
        part = mark[y0 - y : y1 - y, c0 - c : c1 - c]
        a = part[..., 3:] / 255
        base[y0:y1, c0:c1, :3] = base[y0:y1, c0:c1, :3] * (1 - a) + part[..., :3] * a
    return encode_png(np.rint(base).astype(np.uint8))


@python("image_hash", returns="string")
def image_hash(x, p):
    """64 bits as hex: ahash and dhash of shrunken gray pixels, phash of their low DCT frequencies."""
    how, px = p.choice("algorithm", ("phash", "dhash", "ahash"), "phash"), gray(decode_png(x[0]))[..., None]
    if how == "dhash":
        small = resized(px, 9, 8)[..., 0].astype(int)
        bits = small[:, 1:] > small[:, :-1]
    elif how == "ahash":
        small = resized(px, 8, 8)[..., 0].astype(float)
        bits = small > small.mean()
    else:
        small = resized(px, 32, 32)[..., 0].astype(float)
        k = np.arange(32)
        basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
        low = (basis @ small @ basis.T)[:8, :8]
        bits = low > np.median(low.ravel()[1:])
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


@python("svg_minify", returns="string")
def svg_minify(x, p):
    """Comments and white space between tags go."""
    return re.sub(r">\s+<", "><", re.sub(r"<!--.*?-->", "", x[0].decode(), flags=re.S)).strip()


unsupported("jpeg_optimize", "svg_to_png", "tiff_split", "tiff_merge", why="there is no codec for this format here")
