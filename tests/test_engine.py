"""Recipes, lineage, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import registry
from heddle.operators import relational as R
from heddle.params import InvalidParam
from heddle.plans import lineage as G
from heddle.plans.recipes import TABLE_FUNCTIONS, NotDeterministic, NotFound, Policy, Recipe, Store, Verification
from heddle.sources import archives, files, logs
from heddle.streaming import chunks as C
from heddle.streaming import live


def test_addresses_depend_on_input_order_not_on_parameter_order():
    a, b = Recipe.of("join", ["x", "y"], {"on": "k", "how": "left"}), Recipe.of("join", ["x", "y"], {"how": "left", "on": "k"})
    assert a.address == b.address != Recipe.of("join", ["y", "x"], {"on": "k", "how": "left"}).address


def test_store(spark):
    s = Store(spark)
    ten = spark.range(10).withColumn("v", F.col("id") % 3)
    leaf = s.put_leaf(ten)
    assert s.put_leaf(ten.orderBy(F.desc("id")).repartition(3)) == leaf != s.put_leaf(ten.withColumn("v", F.col("id") % 2))
    one = s.put_recipe("filter", [leaf], {"column": "v", "op": "eq", "value": "1"})
    two = s.put_recipe("frequency", [one], {"column": "v"})
    assert s.put_recipe("filter", [leaf], {"column": "v", "op": "eq", "value": "1"}) == one
    assert [r.n for r in s.materialise(two, keep=True).collect()] == [3]
    assert [r.n for r in s.materialise(two).collect()] == [3] and s.status()["hit_rate"] == 0.5 and s.status()["cached_bytes"] > 0
    assert s.order(two) == [leaf, one, two] and s.status()["cached"] == 1
    assert s.verify(two) and s.invalidate(leaf, dry_run=True) == [two]
    assert s.cascade(leaf, Policy.NONE) == [] and [(r["addr"], r["depth"]) for r in s.cascade(leaf)] == [(two, 2)] and s.invalidate(leaf) == []
    with pytest.raises(NotFound):
        s.put_recipe("filter", ["nowhere"], {})
    with pytest.raises(NotFound):
        s.materialise(s.put_recipe("nothing", [leaf]))
    s.remove(two)
    assert s.resolve(two) is None and s.resolve(one) is not None


def test_store_survives_in_its_folder(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    s = Store(spark, root)
    blobs = spark.createDataFrame([(1, b"ab"), (2, b"c")], "key long, content binary")
    leaf, other = s.put_leaf(blobs), s.put_leaf(spark.range(3))
    upper = s.put_recipe("uppercase", [leaf])
    joined = s.put_recipe("concat", [upper, leaf])
    s.pin(other), s.pin(leaf), s.unpin(leaf)
    again = Store(spark, root)
    assert again.list_pins() == [other] and again.resolve(joined) == s.resolve(joined)
    assert {r.key: bytes(r.content) for r in again.materialise(joined).collect()} == {1: b"ABab", 2: b"Cc"}
    assert s.collect_garbage() == [] and s.unpin(other) and not s.unpin(other)
    assert s.collect_garbage(dry_run=True) == [other] == s.collect_garbage() and Store(spark, root).leaf(other) is None


def test_sampled_verification_goes_by_the_address(spark):
    s = Store(spark)
    leaf = s.put_leaf(spark.range(5))
    chosen = [f"{i:02x}" + "0" * 62 for i in range(256)]
    assert sum(s.sampled(a, 0.5) for a in chosen) == 128 and not any(s.sampled(a, 0.0) for a in chosen) and all(s.sampled(a, 1.0) for a in chosen)
    TABLE_FUNCTIONS["noisy"] = lambda x, p: x[0].withColumn("r", F.rand())
    try:
        noisy = s.put_recipe("noisy", [leaf])
        assert s.materialise(noisy).count() == 5
        with pytest.raises(NotDeterministic):
            s.materialise(noisy, verification=Verification.DUAL)
    finally:
        del TABLE_FUNCTIONS["noisy"]


def test_eviction_spares_pins(spark):
    s = Store(spark)
    leaf = s.put_leaf(spark.range(2000))
    kept = [s.put_recipe("filter", [leaf], {"column": "id", "op": "gt", "value": str(i)}) for i in range(4)]
    for a in kept:
        s.materialise(a, keep=True)
    s.pin(kept[0])
    lost = s.evict(1, 0.8, 0.6)
    assert lost == sorted(kept[1:]) and set(s.cache) == {kept[0]} and s.evict(1 << 40) == []


def test_eviction_order(spark):
    rows = [(f"e{i}", 10, float((i * 37) % 50), i % 3, i % 7 == 0) for i in range(400)]
    got = {r.addr for r in G.eviction(spark.createDataFrame(rows, "addr string, size long, cpu_ms double, hits int, pinned boolean"), 4000).collect()}
    free, want = 4000, set()
    for _, a in sorted((c * (h + 1) / n, a) for a, n, c, h, p in rows if not p):
        if free <= 2400:
            break
        want.add(a)
        free -= 10
    assert got == want


def test_joins_of_unmatched_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k int, r string")
    for how, want in (("inner", {(2, "b", "x")}), ("left", {(1, "a", ""), (2, "b", "x")}), ("right", {(2, "b", "x"), (3, "", "y")}), ("full", {(1, "a", ""), (2, "b", "x"), (3, "", "y")})):
        assert {tuple(r) for r in R.join_tables(left, right, "k", how, fill="").select("k", "l", "r").collect()} == want


def test_exact_percentiles(spark, monkeypatch):
    from heddle.operators import aggregates as A

    monkeypatch.setattr(A, "FEW", 50)
    values = [float(i % 97) ** 3 for i in range(5000)] + [1e12] * 3
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert A.exact_percentiles(df, "v", [0, 25, 50, 99, 100]) == pytest.approx(list(np.percentile(values, [0, 25, 50, 99, 100])))
    assert A.exact_percentiles(df.where("v is null"), "v", [50]) == [None]


def test_lineage(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "c")], "addr string, input string")
    root = spark.createDataFrame([("a",)], "addr string")
    assert {(r.addr, r.depth) for r in G.dependents(e, root).collect()} == {("b", 1), ("c", 2), ("d", 2)}
    assert {(r.addr, r.depth) for r in G.depth(e).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    with pytest.raises(ValueError):
        G.depth(spark.createDataFrame([("a", "b"), ("b", "a")], "addr string, input string"))


def test_relational_edges(spark):
    df = spark.createDataFrame([("9",), ("10",), ("x",), ("2",)], "v string")
    assert [r.v for r in R.sort_rows(df, "v").collect()] == ["2", "9", "10", "x"]
    assert [r.v for r in R.filter_rows(df, "v", "gt", "10").collect()] == ["9", "x", "2"]
    empty = df.where("false")
    assert R.aggregate(empty, "v", "avg").first().value == 0 and R.aggregate(empty, "v", "min").first().value == float("inf")
    with pytest.raises(InvalidParam):
        R.select_columns(df, ["w"])


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = R.select_columns(R.filter_rows(files.read_parquet(spark, f"{sf}/lineitem.parquet"), "l_quantity", "gt", 40.0, typed=True), ["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a,b", "1"), ('q"', "")], "x string, y string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c")).collect()} == {("a,b", "1"), ('q"', "")}
    files.write_orc(df, str(tmp_path / "o"))
    files.write_ndjson(df, str(tmp_path / "n"))
    assert files.read_orc(spark, str(tmp_path / "o")).count() == files.read_ndjson(spark, str(tmp_path / "n")).count() == 2
    (tmp_path / "f.fa").write_text(">s1 d\nAC\nGT\n>s2\nTT\n")
    assert {tuple(r) for r in files.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {("s1", "ACGT", 4), ("s2", "TT", 2)}
    line = spark.createDataFrame([("<34>Mar  3 04:05:06 loom7 shuttle: thread broke",), ("junk",)], "line string")
    assert [r.facility for r in logs.syslog(line, fmt="rfc3164").orderBy("line").collect()] == [4, None]
    packed = registry.get("zip_create").plain([b"1", b"22"], __import__("heddle.params", fromlist=["Params"]).Params(files="a,b"))
    got = archives.members(spark.createDataFrame([("z", packed)], "path string, content binary")).collect()
    assert {(r.member, r.size) for r in got} == {("a", 1), ("b", 2)}


def _chunks(spark, *parts):
    return spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "stream_id long, chunk_idx long, content binary")


def _out(df):
    return [bytes(r.content) for r in df.orderBy("chunk_idx").collect()]


def test_chunk_streams(spark):
    x = _chunks(spark, b"ab c", b"d\ne", b"", b"f")
    assert _out(C.apply("streaming_reverse", x)) == [b"c ba", b"e\nd", b"", b"f"]
    assert _out(C.apply("streaming_word_count", x)) == [(3).to_bytes(8, "big")]
    assert _out(C.apply("streaming_take", x, bytes=5)) == [b"ab c", b"d"]
    assert b"".join(_out(C.apply("streaming_skip", x, bytes=5))) == b"\nef"
    assert _out(C.apply("streaming_zip_concat", x, _chunks(spark, b"1\n2\n3"))) == [b"ab cd1\nef2\n3"]
    assert _out(C.apply("streaming_diff", C.apply("streaming_diff", x, _chunks(spark, b"zz", b"zzz", b"z", b"z")), _chunks(spark, b"zz", b"zzz", b"z", b"z")))[0] == b"ab c"
    assert _out(C.apply("streaming_average", _chunks(spark, b"1\nx\n", b"2\n"))) == [b"1.5"]
    assert _out(C.apply("streaming_grep", _chunks(spark, b"the c", b"at\nno\n"), pattern="cat")) == [b"the cat\n"]
    import hashlib

    h = [hashlib.sha256(c).digest() for c in (b"a", b"b", b"c")]
    top = hashlib.sha256(hashlib.sha256(h[0] + h[1]).digest() + hashlib.sha256(h[2] + h[2]).digest()).digest()
    assert _out(C.apply("streaming_merkle_tree", _chunks(spark, b"a", b"b", b"c"))) == [top]
    tail = _out(C.apply("streaming_rolling_hash", _chunks(spark, b"ab", b"c"), window_size=2))
    assert tail[1][1:] == (98 * 257 + 99).to_bytes(8, "big")


def test_live_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 01:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(src))
    df = live.read_stream(spark, str(src), "k int, ts timestamp", max_files=1)
    live.run_to_table(live.deduplicate(df, ["k"], "ts"), str(out), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(out)).collect()) == [1, 2]
    seen = []
    live.fan_out(df, [lambda b, i: seen.append(b.count()), lambda b, i: seen.append(-b.count())], str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 0 and max(seen) >= 1


def test_python_functions_run_over_arrow(spark):
    df = spark.createDataFrame([("a: 1",), (None,)], "t string")
    got = [r[0] for r in df.select(registry.call("yaml_to_json", "t")).collect()]
    assert json.loads(got[0]) == {"a": 1} and got[1] is None
