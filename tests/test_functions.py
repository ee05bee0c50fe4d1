"""Plain functions against published vectors and literal fixtures."""

import base64
import io
import json
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle import registry
from heddle.functions import addressing, ciphers, erasure, image
from heddle.params import InputCount, InvalidParam, Params, Unsupported


def run(name, *inputs, **params):
    return registry.get(name).plain([x.encode() if isinstance(x, str) else x for x in inputs], Params(params))


def test_registry_is_complete():
    assert len(registry.names()) == 447
    assert registry.contains("sha256") and not registry.contains("sha256", "2.0.0")


def test_errors_are_raised_while_planning(spark):
    with pytest.raises(InputCount):
        registry.call("zip", "a")
    with pytest.raises(Unsupported):
        registry.call("rar_extract", "a")
    with pytest.raises(InvalidParam):
        Params(key="xyz").hex("key")
    with pytest.raises(InvalidParam):
        Params(n="-1").int("n", low=0)
    with pytest.raises(KeyError):
        registry.get("nothing")


def test_published_vectors():
    assert addressing.blake3_digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    key, counter = "2b7e151628aed2a6abf7158809cf4f3c", "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"
    assert ciphers.aes_ctr(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), bytes.fromhex(key), bytes.fromhex(counter)).hex() == "874d6191b620e3261bef6864990db6ce"
    seed, public = "9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = run("ed25519_sign", b"", private_key=seed)
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert run("ed25519_verify", b"", public_key=public, signature=sig.hex()) == b"\1"
    with pytest.raises(ValueError):
        run("ed25519_verify", b"x", public_key=public, signature=sig.hex())
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    assert ciphers._chacha_xor(plain, bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")).hex().startswith("d31a8d34648e60db7b86afbc53ef7ec2")


def test_argon2id_has_the_shape_of_its_output():
    a, b = (ciphers.argon2id(b"password", b"somesalt" * 2, 1, 64) for _ in range(2))
    assert a == b and len(a) == 32 and a != ciphers.argon2id(b"passwore", b"somesalt" * 2, 1, 64)


YARN = "colour,metres,skeins,mill\nochre,120.5,17,North\nindigo,80,9,South\nmadder,64.25,140,North\n"


def test_csv():
    assert json.loads(run("csv_parse", YARN))[1] == {"colour": "indigo", "metres": "80", "skeins": "9", "mill": "South"}
    assert json.loads(run("csv_parse", "weft,41\n", has_header="false")) == [{"col0": "weft", "col1": "41"}]
    assert run("csv_filter", YARN, column="skeins", op="lt", value="2").count("\n") == 3  # as strings: '17' and '140'
    assert run("csv_sort", YARN, column="skeins").splitlines()[1].startswith("indigo")
    assert run("csv_aggregate", YARN, column="skeins", function="sum") == "166.0"
    assert run("csv_aggregate", YARN, column="mill", function="min") == "inf"
    assert run("csv_join", "id,name\n1,a\n2,b\n3,c\n", "id,score\n1,9\n4,8\n", join_column="id", join_type="full").splitlines() == ["id,name,score", "1,a,9", "2,b,", "3,c,", "4,,8"]
    assert run("csv_deduplicate", "n,a\nx,1\nx,1\ny,2\n").count("\n") == 3
    with pytest.raises(ValueError):
        run("csv_parse", "a,b\n1\n")


def test_json():
    doc = '{"a": {"b": [1, {"c": 2}]}, "d": [{"n": 5}, {"n": 9}]}'
    assert json.loads(run("jsonpath_extract", doc, path="$..c")) == [2]
    assert json.loads(run("jsonpath_extract", doc, path="$.d[?(@.n > 6)].n")) == [9]
    assert json.loads(run("json_unflatten", run("json_flatten", '{"a": {"b": 1}}'))) == {"a": {"b": 1}}
    assert json.loads(run("json_merge", '{"a": {"x": 1}}', '{"a": {"y": 2}}', strategy="deep")) == {"a": {"x": 1, "y": 2}}
    assert json.loads(run("xml_parse", '<r id="1"><a>x</a></r>')) == {"r": {"@id": "1", "a": "x"}}
    with pytest.raises(ValueError):
        run("schema_validate", '{"a": "x"}', schema='{"properties": {"a": {"type": "integer"}}}')


def test_config():
    assert json.loads(run("toml_parse", run("toml_write", '{"a": 1, "t": {"b": [1, 2]}}'))) == {"a": 1, "t": {"b": [1, 2]}}
    assert json.loads(run("ini_parse", "[s]\nk=v\n")) == {"s": {"k": "v"}}
    assert json.loads(run("env_parse", "export A=1\n# c\nB='x y'\n")) == {"A": "1", "B": "x y"}
    assert json.loads(run("properties_parse", "db.host=localhost\nlong=a\\\n  b\n")) == {"db.host": "localhost", "long": "ab"}
    assert json.loads(run("hcl_parse", 'resource "aws" "web" {\n  ami = "x"\n  tags = { a = 1 }\n}\n')) == {"resource.aws.web": {"ami": "x", "tags": {"a": 1}}}
    assert "b: 2" in run("yaml_merge", "a: 1\n", "b: 2\n")


def test_logs():
    r = json.loads(run("syslog_parse", "<77>1 2031-05-06T07:08:09Z loom7 shuttle 42 WEFT - thread broke at pick 9"))
    assert (r["facility"], r["severity"], r["message"]) == (9, 5, "thread broke at pick 9")
    r = json.loads(run("cef_parse", "CEF:0|Mill|Gate|2.4|9|Door forced|3|src=192.0.2.7 dst=192.0.2.8"))
    assert r["extensions"] == {"src": "192.0.2.7", "dst": "192.0.2.8"}
    r = json.loads(run("apache_log_parse", '203.0.113.9 - weaver [06/May/2031:07:08:09 +0000] "GET /warp HTTP/1.1" 404 77 "-" "spindle"'))
    assert (r["status"], r["path"]) == ("404", "/warp")
    assert run("log_timestamp_normalize", "[10/Oct/2000:13:55:36 -0700] x") == "[2000-10-10T20:55:36Z] x"
    assert run("log_anonymize", "from 10.0.0.1").startswith("from REDACTED_IP_")


def test_domain_formats():
    assert json.loads(run("vcf_parse", "#h\nchr1\t100\trs1\tA\tT,C\t30\tPASS\tDP=1\n"))["alt"] == ["T", "C"]
    assert json.loads(run("geojson_bbox", '{"type": "LineString", "coordinates": [[1, 2], [3, 4]]}')) == [1, 2, 3, 4]
    assert run("geojson_to_wkt", run("wkt_to_geojson", "POINT (1 2)\nPOLYGON ((0 0, 1 0, 1 1, 0 0))")) == "POINT (1 2)\nPOLYGON ((0 0, 1 0, 1 1, 0 0))"
    assert run("postgres_copy_parse", "a\t\\N\n") == "a,\n"
    assert json.loads(run("har_parse", '{"log": {"entries": [{"request": {"url": "u", "method": "GET"}, "response": {"status": 200, "bodySize": 1024}, "time": 5}]}}', summary="true"))["total_size"] == 1024
    assert "<h1>T</h1>" in run("markdown_to_html", "# T\n\n- a\n- b\n") and run("html_to_markdown", "<h1>T</h1><p><b>x</b></p>").startswith("# T")


def test_binary_round_trips():
    v = '{"a":[1,-2,300,70000,2.5,null,true],"s":"é"}'
    for a, b in (("msgpack_encode", "msgpack_decode"), ("cbor_encode", "cbor_decode"), ("bson_encode", "bson_decode"), ("dag_cbor_encode", "dag_cbor_decode")):
        assert json.loads(run(b, run(a, v))) == json.loads(v), a
    schema = '{"type":"record","name":"u","fields":[{"name":"name","type":"string"},{"name":"age","type":["null","int"]}]}'
    rows = '[{"name":"A","age":1},{"name":"B","age":null}]'
    assert json.loads(run("avro_read", run("avro_write", rows, schema, codec="deflate"))) == json.loads(rows)
    car = run("unixfs_chunk", b"x" * 5000, chunk_size=1000)
    assert run("unixfs_assemble", car) == b"x" * 5000 and run("car_verify", car) == car
    cid = run("cid_compute", b"hello")
    assert cid == "bafkreibm6jg3ux5qumhcn2b3flc3tyu6dmlb4xa7u5bf44yegnrjhc4yeq" and run("cid_verify", b"hello", expected_cid=cid) == b"hello"
    npy = run("numpy_write", np.arange(6, dtype="<f8").tobytes(), shape="2,3")
    assert run("arrow_to_numpy", run("numpy_read", npy)) == run("numpy_write", np.arange(6, dtype="<f8").tobytes())
    assert json.loads(run("tfrecord_read", run("tfrecord_write", b"\1\2"))) == {"data": "0102"}


def test_media():
    px = np.random.default_rng(0).integers(0, 255, (9, 7, 3), dtype=np.uint8)
    png = image.encode_png(px)
    assert (image.decode_png(png)[..., :3] == px).all()
    assert json.loads(run("image_metadata", png))["width"] == 7
    assert (image.decode_png(run("image_rotate", run("image_rotate", png, degrees=90), degrees=270))[..., :3] == px).all()
    assert run("image_hash", png, algorithm="dhash") == run("image_hash", run("png_optimize", png), algorithm="dhash")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\0\0" * 8000 + (np.sin(np.arange(8000)) * 9000).astype("<i2").tobytes())
    assert json.loads(run("audio_silence_detect", out.getvalue()))[0] == {"start_ms": 0, "end_ms": 1000}
    assert json.loads(run("audio_metadata", run("audio_trim", out.getvalue(), start_ms=500)))["duration_ms"] == 1500


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([("0", "3"), ("1", "5"), ("2", "4"), ("4", "5")]))
def test_erasure_recovers(data, lost):
    code = np.frombuffer(run("rs_encode", data), np.uint8).reshape(6, -1).copy()
    for i in lost:
        code[int(i)] = 0
    assert run("rs_decode", code.tobytes(), missing=",".join(lost)) == data
    assert run("xor_reconstruct", run("xor_parity", data), missing=2) == data
    assert run("stripe_assemble", run("stripe_split", data, stripe_size=7), stripe_size=7) == data


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    for a, b in (("compress", "decompress"), ("zstd_compress", "zstd_decompress"), ("lz4_compress", "lz4_decompress"), ("snappy_compress", "snappy_decompress"), ("brotli_compress", "brotli_decompress"), ("gzip_compress", "gzip_decompress"),
                 ("bzip2_compress", "bzip2_decompress"), ("xz_compress", "xz_decompress"), ("base32_encode", "base32_decode"), ("base58_encode", "base58_decode")):
        assert run(b, run(a, data)) == data, a
    key = {"key": "01" * 32, "nonce": "02" * 12}
    assert run("chacha20_decrypt", run("chacha20_encrypt", data, **key), **key) == data
    cuts = addressing.boundaries(data * 3)
    assert not data or cuts[-1] == 3 * len(data)


def test_gf_inverse():
    m = erasure.matrix(4, 3)[[0, 2, 4, 6]]
    assert (erasure.matmul(m, erasure.inverse(m)) == np.eye(4, dtype=int)).all()


def test_protobuf():
    from google.protobuf import descriptor_pb2

    f = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="Person")
    m.field.add(name="name", number=1, type=9, label=1)
    m.field.add(name="age", number=2, type=5, label=1)
    raw = descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString()
    p = {"descriptor": base64.b64encode(raw).decode(), "message_type": "t.Person"}
    assert json.loads(run("protobuf_decode", run("protobuf_encode", '{"name": "A", "age": 3}', **p), **p)) == {"name": "A", "age": 3}
    assert json.loads(run("protobuf_schema_extract", raw))["Person"]["age"] == {"number": 2, "kind": "int32"}
