"""Content identifiers, dag-pb, dag-cbor, CAR files, UnixFS chunks and Merkle paths."""

from __future__ import annotations

import base64
import hashlib
import io
import json

from ..registry import python
from .addressing import blake3_digest
from .encodings import b58, unb58
from .json_formats import dumps
from .serialization import cbor, uncbor

# Multicodec numbers.
CODECS = {"raw": 0x55, "dag-pb": 0x70, "dag-cbor": 0x71}
HASHES = {"sha2-256": 0x12, "blake3": 0x1E}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_varint(d: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (d[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if d[at - 1] < 128:
            return n, at


def digest(data: bytes, name: str) -> bytes:
    return hashlib.sha256(data).digest() if name == "sha2-256" else blake3_digest(data)


def make_cid(data: bytes, codec: str = "raw", hash_: str = "sha2-256", version: int = 1) -> bytes:
    d = digest(data, hash_)
    multi = varint(HASHES[hash_]) + varint(len(d)) + d
    return multi if version == 0 else b"\1" + varint(CODECS[codec]) + multi


def show(cid: bytes) -> str:
    return b58(cid) if cid[:2] == b"\x12\x20" else "b" + base64.b32encode(cid).decode().lower().rstrip("=")


def parse(text: str) -> bytes:
    if text.startswith("Qm") and len(text) == 46:
        return unb58(text)
    if text.startswith("z"):
        return unb58(text[1:])
    if not text.startswith("b"):
        raise ValueError(f"no CID: {text}")
    body = text[1:].upper()
    return base64.b32decode(body + "=" * (-len(body) % 8))


def fields(cid: bytes) -> dict:
    """version, codec, hash and digest."""
    if cid[:2] == b"\x12\x20":
        return {"version": 0, "codec": "dag-pb", "hash": "sha2-256", "digest": cid[2:]}
    v, at = get_varint(cid, 0)
    codec, at = get_varint(cid, at)
    hash_, at = get_varint(cid, at)
    n, at = get_varint(cid, at)
    if v != 1 or at + n != len(cid):
        raise ValueError("no CID")
    name = lambda table, k: next((a for a, b in table.items() if b == k), hex(k))
    return {"version": v, "codec": name(CODECS, codec), "hash": name(HASHES, hash_), "digest": cid[at:]}


def matches(cid: bytes, data: bytes) -> bool:
    f = fields(cid)
    return f["hash"] in HASHES and digest(data, f["hash"]) == f["digest"]


@python("cid_compute", returns="string")
def cid_compute(x, p):
    return show(make_cid(x[0], p.choice("codec", tuple(CODECS), "raw"), p.choice("hash", tuple(HASHES), "sha2-256"), p.int("version", 1, 0, 1)))


@python("cid_verify")
def cid_verify(x, p):
    if not matches(parse(p.text("expected_cid")), x[0]):
        raise ValueError("other content")
    return x[0]


@python("cid_parse", returns="string")
def cid_parse(x, p):
    f = fields(parse(x[0].decode().strip()))
    return dumps(f | {"digest": f["digest"].hex()})


def _pb(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def _pb_fields(d: bytes):
    at = 0
    while at < len(d):
        tag, at = get_varint(d, at)
        n, at = get_varint(d, at)
        if tag & 7 == 0:
            yield tag >> 3, n
        else:
            yield tag >> 3, d[at : at + n]
            at += n


def dag_pb(links: list[dict], data: bytes | None) -> bytes:
    """Links (cid, name, size) before data, as the canonical form has it."""
    out = b"".join(_pb(2, _pb(1, parse(k["cid"])) + _pb(2, k.get("name", "").encode()) + varint(3 << 3) + varint(k.get("size", 0))) for k in links)
    return out + (_pb(1, data) if data is not None else b"")


def undag_pb(d: bytes) -> tuple[list[dict], bytes]:
    links, data = [], b""
    for n, v in _pb_fields(d):
        if n == 1:
            data = v
        elif n == 2:
            f = dict(_pb_fields(v))
            links.append({"cid": show(f[1]), "name": f.get(2, b"").decode(), "size": f.get(3, 0)})
    return links, data


@python("dag_pb_encode")
def dag_pb_encode(x, p):
    v = json.loads(x[0])
    return dag_pb(v.get("links", []), v["data"].encode() if v.get("data") is not None else None)


@python("dag_pb_decode", returns="string")
def dag_pb_decode(x, p):
    links, data = undag_pb(x[0])
    return dumps({"links": links, "data": data.decode(errors="replace")})


def _linked(v):
    """JSON with {"/": cid} links as CBOR values; keys by length, then bytes."""
    if isinstance(v, dict):
        if set(v) == {"/"} and isinstance(v["/"], str):
            return (42, b"\0" + parse(v["/"]))
        if set(v) == {"/"}:
            return base64.b64decode(v["/"]["bytes"] + "==")
        return {k: _linked(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
    return [_linked(w) for w in v] if isinstance(v, list) else v


def _tag(n, v):
    return {"/": show(v[1:])} if n == 42 else {"$tag": n, "value": v}


def _shown(v):
    if isinstance(v, bytes):
        return {"/": {"bytes": base64.b64encode(v).decode().rstrip("=")}}
    if isinstance(v, dict):
        return {k: _shown(w) for k, w in v.items()}
    return [_shown(w) for w in v] if isinstance(v, list) else v


@python("dag_cbor_encode")
def dag_cbor_encode(x, p):
    return cbor(_linked(json.loads(x[0])))


def undag_cbor(d: bytes):
    return _shown(uncbor(io.BytesIO(d), _tag))


@python("dag_cbor_decode", returns="string")
def dag_cbor_decode(x, p):
    return dumps(undag_cbor(x[0]))


def car(roots: list[bytes], blocks: list[tuple[bytes, bytes]]) -> bytes:
    head = cbor({"roots": [(42, b"\0" + r) for r in roots], "version": 1})
    return varint(len(head)) + head + b"".join(varint(len(c) + len(b)) + c + b for c, b in blocks)


def uncar(d: bytes) -> tuple[list[str], list[tuple[bytes, bytes]]]:
    n, at = get_varint(d, 0)
    head = undag_cbor(d[at : at + n])
    at, blocks = at + n, []
    while at < len(d):
        n, at = get_varint(d, at)
        part, at = d[at : at + n], at + n
        if part[:2] == b"\x12\x20":
            cut = 34
        else:
            cut = 0
            for _ in range(3):
                _, cut = get_varint(part, cut)
            size, cut = get_varint(part, cut)
            cut += size
        blocks.append((part[:cut], part[cut:]))
    return [r["/"] for r in head["roots"]], blocks


@python("car_create", inputs=(1, None))
def car_create(x, p):
    blocks = [(make_cid(b), b) for b in x]
    roots = [parse(r) for r in p.list("roots", [])] or [blocks[0][0]]
    return car(roots, blocks)


@python("car_extract")
def car_extract(x, p):
    blocks = {show(c): b for c, b in uncar(x[0])[1]}
    if "cid" in p:
        if p.text("cid") not in blocks:
            raise ValueError("no such block")
        return blocks[p.text("cid")]
    return dumps({c: {"size": len(b), "content_b64": base64.b64encode(b).decode()} for c, b in blocks.items()}).encode()


@python("car_list", returns="string")
def car_list(x, p):
    return dumps([{"cid": show(c), "size": len(b)} for c, b in uncar(x[0])[1]])


@python("car_verify")
def car_verify(x, p):
    for c, b in uncar(x[0])[1]:
        if not matches(c, b):
            raise ValueError(f"block {show(c)} has other content")
    return x[0]


@python("unixfs_chunk")
def unixfs_chunk(x, p):
    """A CAR with one leaf for each chunk and a root that links them."""
    size = p.int("chunk_size", 262144, low=1)
    parts = [x[0][i : i + size] for i in range(0, len(x[0]), size)] or [b""]
    meta = lambda body, sizes: varint(1 << 3) + varint(2) + (_pb(2, body) if body is not None else b"") + varint(3 << 3) + varint(len(body) if body is not None else sum(sizes)) + b"".join(varint(4 << 3) + varint(s) for s in sizes)
    leaves = [dag_pb([], meta(part, [])) for part in parts]
    cids = [make_cid(b, "dag-pb") for b in leaves]
    root = dag_pb([{"cid": show(c), "name": "", "size": len(b)} for c, b in zip(cids, leaves, strict=True)], meta(None, [len(q) for q in parts]))
    top = make_cid(root, "dag-pb")
    return car([top], [(top, root), *zip(cids, leaves, strict=True)])


@python("unixfs_assemble")
def unixfs_assemble(x, p):
    roots, blocks = uncar(x[0])
    table = {show(c): b for c, b in blocks}

    def body(cid):
        links, data = undag_pb(table[cid])
        return b"".join(body(k["cid"]) for k in links) if links else dict(_pb_fields(data)).get(2, b"")

    return body(roots[0])


def _links(codec: str, d: bytes) -> list[str]:
    if codec == "dag-pb":
        return [k["cid"] for k in undag_pb(d)[0]]
    out: list[str] = []

    def walk(v):
        if isinstance(v, dict):
            out.append(v["/"]) if set(v) == {"/"} and isinstance(v["/"], str) else [walk(w) for w in v.values()]
        elif isinstance(v, list):
            [walk(w) for w in v]

    if codec == "dag-cbor":
        walk(undag_cbor(d))
    return out


@python("merkle_proof_generate", returns="string")
def merkle_proof_generate(x, p):
    """The path of CIDs from the root of a CAR to a target."""
    roots, blocks = uncar(x[0])
    table, want = {show(c): (fields(c)["codec"], b) for c, b in blocks}, p.text("target_cid")
    todo, seen = [[r] for r in roots], set()
    while todo:
        path = todo.pop()
        if path[-1] == want:
            return dumps({"root": path[0], "target": want, "path": path})
        if path[-1] in table and path[-1] not in seen:
            seen.add(path[-1])
            todo += [[*path, c] for c in reversed(_links(*table[path[-1]]))]
    raise ValueError("target is not reachable")


@python("merkle_proof_verify", returns="string")
def merkle_proof_verify(x, p):
    """A structural check: CIDs parse and the path starts at the given root."""
    path = json.loads(x[0])["path"]
    for c in path:
        fields(parse(c))
    if not path or path[0] != p.text("root_cid"):
        raise ValueError("path starts at another root")
    return dumps({"valid": True, "length": len(path)})
