"""WAV audio by the standard library and numpy; other codecs are not decoded."""

from __future__ import annotations

import io
import json
import struct
import wave

import numpy as np

from ..registry import python, unsupported
from .image import encode_png
from .json_formats import dumps

KINDS = ((b"fLaC", 0, "flac"), (b"ID3", 0, "mp3"), (b"\xff\xfb", 0, "mp3"), (b"OggS", 0, "ogg"), (b"ftyp", 4, "mp4"), (b"\x1aE\xdf\xa3", 0, "mkv"))


def load(d: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, frames x channels in -1..1)."""
    with wave.open(io.BytesIO(d)) as w:
        size, raw = w.getsampwidth(), w.readframes(w.getnframes())
        rate, channels = w.getframerate(), w.getnchannels()
    if size == 1:
        a = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif size == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        a = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        a = np.frombuffer(raw, f"<i{size}") / 2.0 ** (8 * size - 1)
    return rate, a.reshape(-1, channels)


def dump(rate: int, a: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(a.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(a * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


@python("audio_metadata", returns="string")
def audio_metadata(x, p):
    with wave.open(io.BytesIO(x[0])) as w:
        return dumps({"codec": f"pcm_s{8 * w.getsampwidth()}le", "sample_rate": w.getframerate(), "channels": w.getnchannels(), "duration_ms": w.getnframes() * 1000 // w.getframerate(), "tags": {}})


@python("audio_convert", "audio_strip_metadata")
def audio_convert(x, p):
    """WAV with 16-bit samples."""
    return dump(*load(x[0]))


@python("audio_trim")
def audio_trim(x, p):
    rate, a = load(x[0])
    start, end = p.int("start_ms", 0, low=0), p.get("end_ms")
    return dump(rate, a[start * rate // 1000 : None if end is None else int(end) * rate // 1000])


@python("audio_normalize")
def audio_normalize(x, p):
    rate, a = load(x[0])
    peak = np.abs(a).max(initial=0)
    return dump(rate, a * (10 ** (p.float("target_db", -3.0) / 20) / peak) if peak else a)


@python("audio_waveform")
def audio_waveform(x, p):
    """PNG with a column of the loudest sample for each slice of time."""
    a = np.abs(load(x[0])[1]).max(1)
    w, h = p.int("width", 800, low=1), p.int("height", 200, low=1)
    px = np.full((h, w), 255, np.uint8)
    for i, part in enumerate(np.array_split(a, w)):
        n = int(round(part.max(initial=0) * h / 2))
        px[h // 2 - n : h // 2 + n + 1, i] = 0
    return encode_png(px)


@python("audio_silence_detect", returns="string")
def audio_silence_detect(x, p):
    rate, a = load(x[0])
    quiet = np.abs(a).max(1) < 10 ** (p.float("threshold_db", -40.0) / 20)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(int), [0]])))
    spans = [(int(s) * 1000 // rate, int(e) * 1000 // rate) for s, e in edges.reshape(-1, 2)]
    return dumps([{"start_ms": s, "end_ms": e} for s, e in spans if e - s >= p.int("min_duration_ms", 500)])


@python("wav_to_raw_pcm")
def wav_to_raw_pcm(x, p):
    """A JSON line with the format, then the samples."""
    with wave.open(io.BytesIO(x[0])) as w:
        head = {"sample_rate": w.getframerate(), "channels": w.getnchannels(), "bits_per_sample": 8 * w.getsampwidth()}
        return json.dumps(head).encode() + b"\n" + w.readframes(w.getnframes())


@python("raw_pcm_to_wav")
def raw_pcm_to_wav(x, p):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(p.int("channels", 1, low=1))
        w.setsampwidth(p.int("bits_per_sample", 16) // 8)
        w.setframerate(p.int("sample_rate", 44100, low=1))
        w.writeframes(x[0])
    return out.getvalue()


@python("media_detect_format", returns="string")
def media_detect_format(x, p):
    d = x[0]
    kind = "wav" if d[:4] == b"RIFF" and d[8:12] == b"WAVE" else next((k for magic, at, k in KINDS if d[at : at + len(magic)] == magic), "unknown")
    return dumps({"format": kind})


def boxes(d: bytes, at: int = 0, end: int | None = None):
    """(kind, start of the body, end) of the boxes of an ISO media file."""
    end = len(d) if end is None else end
    while at + 8 <= end:
        size, kind = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8]
        head = 16 if size == 1 else 8
        size = int.from_bytes(d[at + 8 : at + 16], "big") if size == 1 else size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _box(d: bytes, path: tuple[bytes, ...], at: int, end: int) -> tuple[int, int] | None:
    for kind, a, b in boxes(d, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _box(d, path[1:], a, b)
    return None


@python("video_metadata", returns="string")
def video_metadata(x, p):
    """Tracks of an ISO media file (MP4, MOV): number, sample format, and rate and channels of sound."""
    d, tracks = x[0], []
    movie = _box(d, (b"moov",), 0, len(d))
    if movie is None:
        raise ValueError("no ISO media file")
    for kind, a, b in boxes(d, *movie):
        if kind != b"trak":
            continue
        head, entry = _box(d, (b"tkhd",), a, b), _box(d, (b"mdia", b"minf", b"stbl", b"stsd"), a, b)
        number = int.from_bytes(d[head[0] + (20 if d[head[0]] else 12) :][:4], "big") if head else None
        first = next(boxes(d, entry[0] + 8, entry[1]), None) if entry else None
        sound = first is not None and _box(d, (b"mdia", b"minf", b"smhd"), a, b) is not None
        channels, rate = struct.unpack_from(">H6xI", d, first[1] + 16) if sound else (None, None)
        tracks.append({"id": number, "codec": first[0].decode("latin-1") if first else None, "sample_rate": rate >> 16 if sound else None, "channels": channels})
    return json.dumps({"tracks": tracks, "track_count": len(tracks)}, indent=2)


unsupported("video_thumbnail", "video_extract_audio", "video_strip_audio", "video_resolution", "subtitle_extract", why="video is not decoded")
