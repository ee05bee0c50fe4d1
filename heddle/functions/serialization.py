"""Avro, Protobuf, MessagePack, CBOR and BSON."""

from __future__ import annotations

import base64
import io
import json
import struct
import zlib

from ..registry import python, unsupported
from .json_formats import dumps, ndjson_of, ndjson_rows


class _Avro:
    """Binary encoding of Avro values by a schema."""

    def __init__(self, schema):
        self.named: dict = {}
        self.schema = self.learn(schema)

    def learn(self, s):
        if isinstance(s, list):
            return [self.learn(b) for b in s]
        if isinstance(s, dict):
            if s["type"] in ("record", "enum", "fixed"):
                self.named[s["name"]] = s
                for f in s.get("fields", []):
                    f["type"] = self.learn(f["type"])
            elif s["type"] == "array":
                s["items"] = self.learn(s["items"])
            elif s["type"] == "map":
                s["values"] = self.learn(s["values"])
            elif isinstance(s["type"], (dict, list)):
                return self.learn(s["type"])
        return s

    def kind(self, s):
        s = self.named.get(s, s) if isinstance(s, str) else s
        return ("union" if isinstance(s, list) else s["type"] if isinstance(s, dict) else s), s

    @staticmethod
    def get_long(f) -> int:
        n = shift = 0
        while True:
            b = f.read(1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n >> 1 ^ -(n & 1)

    @staticmethod
    def put_long(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def blocks(self, f):
        while n := self.get_long(f):
            if n < 0:
                self.get_long(f)
            yield from range(abs(n))

    def get(self, f, s):
        kind, s = self.kind(s)
        if kind == "null":
            return None
        if kind == "boolean":
            return f.read(1) == b"\1"
        if kind in ("int", "long"):
            return self.get_long(f)
        if kind == "float":
            return struct.unpack("<f", f.read(4))[0]
        if kind == "double":
            return struct.unpack("<d", f.read(8))[0]
        if kind == "string":
            return f.read(self.get_long(f)).decode()
        if kind == "bytes":
            return f.read(self.get_long(f)).decode("latin-1")
        if kind == "fixed":
            return f.read(s["size"]).decode("latin-1")
        if kind == "enum":
            return s["symbols"][self.get_long(f)]
        if kind == "union":
            return self.get(f, s[self.get_long(f)])
        if kind == "array":
            return [self.get(f, s["items"]) for _ in self.blocks(f)]
        if kind == "map":
            return {f.read(self.get_long(f)).decode(): self.get(f, s["values"]) for _ in self.blocks(f)}
        return {x["name"]: self.get(f, x["type"]) for x in s["fields"]}

    def fits(self, v, s) -> bool:
        kind, s = self.kind(s)
        whole = isinstance(v, int) and not isinstance(v, bool)
        return {"null": v is None, "boolean": isinstance(v, bool), "int": whole, "long": whole, "float": whole or isinstance(v, float), "double": whole or isinstance(v, float), "array": isinstance(v, list)}.get(
            kind, isinstance(v, dict) if kind in ("record", "map") else v in s["symbols"] if kind == "enum" else isinstance(v, str))

    def put(self, v, s) -> bytes:
        kind, s = self.kind(s)
        if kind == "union":
            i = next((i for i, b in enumerate(s) if self.fits(v, b)), None)
            if i is None:
                raise ValueError(f"no branch for {v!r}")
            return self.put_long(i) + self.put(v, s[i])
        if not self.fits(v, s):
            raise ValueError(f"{v!r} is no {kind}")
        if kind == "null":
            return b""
        if kind == "boolean":
            return b"\1" if v else b"\0"
        if kind in ("int", "long"):
            return self.put_long(v)
        if kind in ("float", "double"):
            return struct.pack("<f" if kind == "float" else "<d", v)
        if kind in ("string", "bytes"):
            b = v.encode("utf-8" if kind == "string" else "latin-1")
            return self.put_long(len(b)) + b
        if kind == "fixed":
            return v.encode("latin-1")
        if kind == "enum":
            return self.put_long(s["symbols"].index(v))
        if kind in ("array", "map"):
            items = [self.put(w, s["items"]) for w in v] if kind == "array" else [self.put(k, "string") + self.put(w, s["values"]) for k, w in v.items()]
            return (self.put_long(len(items)) + b"".join(items) if items else b"") + b"\0"
        return b"".join(self.put(v.get(f["name"], f.get("default")), f["type"]) for f in s["fields"])


_HEAD = {"type": "map", "values": "bytes"}


def avro_open(d: bytes):
    """(writer's schema as text, codec, rest of the file, sync marker)."""
    if d[:4] != b"Obj\1":
        raise ValueError("no Avro file")
    f = io.BytesIO(d)
    f.seek(4)
    meta = _Avro(dict(_HEAD)).get(f, dict(_HEAD))
    return meta["avro.schema"].encode("latin-1").decode(), meta.get("avro.codec", "null"), f, f.read(16)


def avro_records(d: bytes) -> list:
    text, codec, f, sync = avro_open(d)
    a, out = _Avro(json.loads(text)), []
    while f.tell() < len(d):
        n, size = a.get_long(f), a.get_long(f)
        body = f.read(size)
        block = io.BytesIO(zlib.decompress(body, -15) if codec == "deflate" else body)
        out += [a.get(block, a.schema) for _ in range(n)]
        if f.read(16) != sync:
            raise ValueError("bad sync marker")
    return out


def avro_file(rows: list, schema: str, codec: str = "null") -> bytes:
    import hashlib

    a, sync = _Avro(json.loads(schema)), hashlib.md5(schema.encode()).digest()
    body = b"".join(a.put(r, a.schema) for r in rows)
    if codec == "deflate":
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(body) + z.flush()
    head = a.put({"avro.schema": schema.encode().decode("latin-1"), "avro.codec": codec}, dict(_HEAD))
    block = a.put_long(len(rows)) + a.put_long(len(body)) + body + sync if rows else b""
    return b"Obj\1" + head + sync + block


@python("avro_read", returns="string")
def avro_read(x, p):
    return dumps(avro_records(x[0]))


@python("avro_to_json", returns="string")
def avro_to_json(x, p):
    return ndjson_of(avro_records(x[0]))


@python("avro_write", inputs=2)
def avro_write(x, p):
    return avro_file(json.loads(x[0]), x[1].decode(), p.choice("codec", ("null", "deflate"), "null"))


@python("json_to_avro", inputs=2)
def json_to_avro(x, p):
    return avro_file(ndjson_rows(x[0].decode()), x[1].decode())


@python("avro_schema_extract", returns="string")
def avro_schema_extract(x, p):
    return dumps(json.loads(avro_open(x[0])[0]))


@python("avro_schema_evolve", inputs=2)
def avro_schema_evolve(x, p):
    """Written again by a new record schema: fields by name, new ones by default."""
    new = json.loads(x[1])
    known = {f["name"]: f.get("default") for f in new["fields"]}
    return avro_file([{k: r.get(k, v) for k, v in known.items()} for r in avro_records(x[0])], x[1].decode(), p.choice("codec", ("null", "deflate"), "null"))


@python("avro_to_parquet")
def avro_to_parquet(x, p):
    import pyarrow as pa

    from .columnar import to_parquet

    return to_parquet(pa.Table.from_pylist(avro_records(x[0])))


@python("parquet_to_avro")
def parquet_to_avro(x, p):
    """Columns of booleans, integers, floats and strings; all nullable."""
    import pyarrow as pa

    from .columnar import parquet

    t = parquet(x[0])
    kind = lambda c: "boolean" if pa.types.is_boolean(c) else "long" if pa.types.is_integer(c) else "double" if pa.types.is_floating(c) else "string"
    schema = json.dumps({"type": "record", "name": "row", "fields": [{"name": f.name, "type": ["null", kind(f.type)], "default": None} for f in t.schema]})
    return avro_file(t.to_pylist(), schema)


def _message(p):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(base64.b64decode(p.text("descriptor"))).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(p.text("message_type")))


@python("protobuf_decode", returns="string")
def protobuf_decode(x, p):
    from google.protobuf import json_format

    return dumps(json_format.MessageToDict(_message(p).FromString(x[0]), preserving_proto_field_name=True))


@python("protobuf_encode")
def protobuf_encode(x, p):
    from google.protobuf import json_format

    return json_format.Parse(x[0].decode(), _message(p)()).SerializeToString(deterministic=True)


@python("protobuf_schema_extract", returns="string")
def protobuf_schema_extract(x, p):
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet.FromString(x[0]).file
    kinds = descriptor_pb2.FieldDescriptorProto.Type
    return dumps({m.name: {f.name: {"number": f.number, "kind": kinds.Name(f.type).removeprefix("TYPE_").lower()} for f in m.field} for d in files for m in d.message_type})


def msgpack(v) -> bytes:
    def sized(n, small, limit, codes, sizes):
        if small is not None and n < limit:
            return bytes([small | n])
        i = next(i for i, s in enumerate(sizes) if n < 1 << 8 * s)
        return bytes([codes[i]]) + n.to_bytes(sizes[i], "big")

    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if -32 <= v < 128:
            return struct.pack("b", v) if v < 0 else bytes([v])
        if v > 0:
            return sized(v, None, 0, (0xCC, 0xCD, 0xCE, 0xCF), (1, 2, 4, 8))
        i = next(i for i in range(4) if v >= -(1 << (8 << i) - 1))
        return bytes([0xD0 + i]) + v.to_bytes(1 << i, "big", signed=True)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        b = v.encode()
        return sized(len(b), 0xA0, 32, (0xD9, 0xDA, 0xDB), (1, 2, 4)) + b
    if isinstance(v, list):
        return sized(len(v), 0x90, 16, (0xDC, 0xDD), (2, 4)) + b"".join(map(msgpack, v))
    return sized(len(v), 0x80, 16, (0xDE, 0xDF), (2, 4)) + b"".join(msgpack(k) + msgpack(w) for k, w in v.items())


def unmsgpack(f):
    b = f.read(1)[0]
    num = lambda n: int.from_bytes(f.read(n), "big")
    items = lambda n: [unmsgpack(f) for _ in range(n)]
    pairs = lambda n: {(k if isinstance(k, str) else dumps(k)): unmsgpack(f) for _ in range(n) for k in [unmsgpack(f)]}
    if b < 0x80 or b >= 0xE0:
        return b if b < 0x80 else b - 256
    if b < 0xC0:
        return pairs(b & 15) if b < 0x90 else items(b & 15) if b < 0xA0 else f.read(b & 31).decode()
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b]
    if 0xC4 <= b <= 0xC6:
        return {"$bytes": base64.b64encode(f.read(num(1 << b - 0xC4))).decode()}
    if b in (0xCA, 0xCB):
        return struct.unpack(">f" if b == 0xCA else ">d", f.read(4 if b == 0xCA else 8))[0]
    if 0xCC <= b <= 0xCF:
        return num(1 << b - 0xCC)
    if 0xD0 <= b <= 0xD3:
        return int.from_bytes(f.read(1 << b - 0xD0), "big", signed=True)
    if 0xD9 <= b <= 0xDB:
        return f.read(num(1 << b - 0xD9)).decode()
    if b in (0xDC, 0xDD):
        return items(num(2 if b == 0xDC else 4))
    if b in (0xDE, 0xDF):
        return pairs(num(2 if b == 0xDE else 4))
    raise ValueError(f"type {b:#x} is not supported")


def cbor(v) -> bytes:
    def head(major, n):
        if n < 24:
            return bytes([major << 5 | n])
        i = next(i for i in range(4) if n < 1 << (8 << i))
        return bytes([major << 5 | 24 + i]) + n.to_bytes(1 << i, "big")

    if v is None or isinstance(v, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[v]
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, bytes):
        return head(2, len(v)) + v
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(cbor, v))
    if isinstance(v, tuple):  # (tag, value)
        return head(6, v[0]) + cbor(v[1])
    if set(v) == {"$bytes"}:
        return cbor(base64.b64decode(v["$bytes"]))
    if set(v) == {"$tag", "value"}:
        return cbor((v["$tag"], v["value"]))
    return head(5, len(v)) + b"".join(cbor(k) + cbor(w) for k, w in v.items())


def uncbor(f, tags=None):
    b = f.read(1)[0]
    major, low = b >> 5, b & 31
    if major == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True}.get(low)
        fmt = {25: ">e", 26: ">f", 27: ">d"}.get(low)
        if fmt is None:
            raise ValueError(f"simple value {low} is not supported")
        return struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]
    if low > 27:
        raise ValueError("indefinite lengths are not supported")
    n = low if low < 24 else int.from_bytes(f.read(1 << low - 24), "big")
    if major < 2:
        return n if major == 0 else -1 - n
    if major == 2:
        return f.read(n) if tags else {"$bytes": base64.b64encode(f.read(n)).decode()}
    if major == 3:
        return f.read(n).decode()
    if major == 4:
        return [uncbor(f, tags) for _ in range(n)]
    if major == 5:
        return {(k if isinstance(k, str) else dumps(k)): uncbor(f, tags) for _ in range(n) for k in [uncbor(f, tags)]}
    v = uncbor(f, tags)
    return tags(n, v) if tags else {"$tag": n, "value": v}


def bson(v: dict) -> bytes:
    def item(k, w):
        key = k.encode() + b"\0"
        if w is None:
            return b"\x0a" + key
        if isinstance(w, bool):
            return b"\x08" + key + bytes([w])
        if isinstance(w, int):
            return (b"\x10" + key + struct.pack("<i", w)) if -(2**31) <= w < 2**31 else b"\x12" + key + struct.pack("<q", w)
        if isinstance(w, float):
            return b"\x01" + key + struct.pack("<d", w)
        if isinstance(w, str):
            return b"\x02" + key + struct.pack("<i", len(w.encode()) + 1) + w.encode() + b"\0"
        if isinstance(w, list):
            return b"\x04" + key + bson({str(i): u for i, u in enumerate(w)})
        return b"\x03" + key + bson(w)

    if not isinstance(v, dict):
        raise ValueError("BSON needs an object")
    body = b"".join(item(k, w) for k, w in v.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def unbson(d: bytes, at: int = 0) -> tuple[dict, int]:
    end, out = at + struct.unpack_from("<i", d, at)[0], {}
    at += 4
    while d[at]:
        kind, stop = d[at], d.index(b"\0", at + 1)
        key, at = d[at + 1 : stop].decode(), stop + 1
        if kind in (3, 4):
            v, at = unbson(d, at)
            v = list(v.values()) if kind == 4 else v
        elif kind == 2:
            n = struct.unpack_from("<i", d, at)[0]
            v, at = d[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind == 5:
            n = struct.unpack_from("<i", d, at)[0]
            v, at = {"$binary": {"base64": base64.b64encode(d[at + 5 : at + 5 + n]).decode(), "subType": f"{d[at + 4]:02x}"}}, at + 5 + n
        elif kind == 7:
            v, at = {"$oid": d[at : at + 12].hex()}, at + 12
        elif kind == 8:
            v, at = bool(d[at]), at + 1
        elif kind == 9:
            v, at = {"$date": struct.unpack_from("<q", d, at)[0]}, at + 8
        elif kind == 10:
            v = None
        elif kind in (1, 16, 18):
            fmt = {1: "<d", 16: "<i", 18: "<q"}[kind]
            v, at = struct.unpack_from(fmt, d, at)[0], at + struct.calcsize(fmt)
        else:
            raise ValueError(f"type {kind} is not supported")
        out[key] = v
    return out, end


@python("msgpack_encode")
def msgpack_encode(x, p):
    return msgpack(json.loads(x[0]))


@python("msgpack_decode", returns="string")
def msgpack_decode(x, p):
    return dumps(unmsgpack(io.BytesIO(x[0])))


@python("cbor_encode")
def cbor_encode(x, p):
    return cbor(json.loads(x[0]))


@python("cbor_decode", returns="string")
def cbor_decode(x, p):
    return dumps(uncbor(io.BytesIO(x[0])))


@python("bson_encode")
def bson_encode(x, p):
    return bson(json.loads(x[0]))


@python("bson_decode", returns="string")
def bson_decode(x, p):
    return dumps(unbson(x[0])[0])


unsupported("thrift_decode", "thrift_encode", why="Thrift needs generated code")
