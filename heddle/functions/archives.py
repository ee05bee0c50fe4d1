"""Archives; listings and manifests are JSON, ``sources.archives`` gives members as rows."""

from __future__ import annotations

import base64
import gzip
import io
import tarfile
import zipfile

from ..registry import python, unsupported
from .json_formats import dumps


def tar_members(data: bytes):
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                yield m.name, m.mode, t.extractfile(m).read()


def make_tar(files) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data, mode in files:
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(data), mode, 0
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _named(x, p):
    names = p.list("files")
    if len(names) != len(x):
        raise ValueError(f"{len(names)} names for {len(x)} inputs")
    return list(zip(names, x, strict=True))


def _manifest(members, path):
    members = dict(members)
    if path is not None:
        if path not in members:
            raise ValueError(f"no member {path}")
        return members[path]
    return dumps({k: {"size": len(v), "content_b64": base64.b64encode(v).decode()} for k, v in members.items()}).encode()


@python("tar_create", inputs=(1, None))
def tar_create(x, p):
    return make_tar((n, d, 0o644) for n, d in _named(x, p))


@python("tar_extract")
def tar_extract(x, p):
    return _manifest(((n, d) for n, _, d in tar_members(x[0])), p.get("path"))


@python("tar_list", returns="string")
def tar_list(x, p):
    return dumps([{"path": n, "size": len(d), "mode": m} for n, m, d in tar_members(x[0])])


@python("tar_append", inputs=2)
def tar_append(x, p):
    return make_tar([*((n, d, m) for n, m, d in tar_members(x[0])), (p.text("filename"), x[1], 0o644)])


@python("tar_gz_create", inputs=(1, None))
def tar_gz_create(x, p):
    return gzip.compress(tar_create(x, p), p.int("level", 6, 1, 9), mtime=0)


@python("tar_gz_extract")
def tar_gz_extract(x, p):
    return tar_extract([gzip.decompress(x[0])], p)


@python("zip_create", inputs=(1, None))
def zip_create(x, p):
    how = zipfile.ZIP_DEFLATED if p.text("compression", "deflate") == "deflate" else zipfile.ZIP_STORED
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in _named(x, p):
            z.writestr(zipfile.ZipInfo(n), d, how)
    return out.getvalue()


def zip_members(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, z.read(i)


@python("zip_extract")
def zip_extract(x, p):
    return _manifest(zip_members(x[0]), p.get("path"))


@python("zip_extract_single")
def zip_extract_single(x, p):
    return _manifest(zip_members(x[0]), p.text("path"))


@python("zip_list", returns="string")
def zip_list(x, p):
    with zipfile.ZipFile(io.BytesIO(x[0])) as z:
        return dumps([{"path": i.filename, "size": i.file_size, "compressed_size": i.compress_size} for i in z.infolist()])


unsupported("sevenz_extract", why="there is no 7z decoder here")
unsupported("rar_extract", why="RAR is not supported")
