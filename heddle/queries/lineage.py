"""Lineage over a graph of keys: customers need nations, nations need regions, orders need customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import explode_chunks, join_chunks
from ..plans import lineage as G
from .common import digest, read

QUERIES: dict = {}
_EDGES = "(SELECT 'n' || n_nationkey AS addr, 'r' || n_regionkey AS input FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
_DOWN = f"WITH RECURSIVE e AS {_EDGES}, d(addr, depth) AS (SELECT 'r1' AS addr, 0 AS depth UNION SELECT e.addr, d.depth + 1 FROM d JOIN e ON e.input = d.addr)"
_UP = f"WITH RECURSIVE e AS {_EDGES}, d(addr, depth) AS (SELECT 'o' || o_orderkey AS addr, 0 AS depth FROM orders UNION SELECT e.input, d.depth + 1 FROM d JOIN e ON e.addr = d.addr)"


def edges(spark, sf_dir):
    pair = lambda t, a, b, x, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("addr"), F.concat(F.lit(b), F.col(y).cast("string")).alias("input"))
    return pair("nation", "n", "r", "n_nationkey", "n_regionkey").union(pair("customer", "c", "n", "c_custkey", "c_nationkey")).union(pair("orders", "o", "c", "o_orderkey", "o_custkey"))


def query(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = (f, sql)
        return f

    return wrap


@query("transitive_dependents", f"{_DOWN} SELECT addr, min(depth) AS depth FROM d WHERE depth > 0 GROUP BY addr")
def transitive_dependents(spark, sf_dir):
    return G.dependents(edges(spark, sf_dir), spark.createDataFrame([("r1",)], "addr string"))


@query("dependents_to_depth", f"{_DOWN} SELECT addr, min(depth) AS depth FROM d WHERE depth BETWEEN 1 AND 2 GROUP BY addr")
def dependents_to_depth(spark, sf_dir):
    return G.dependents(edges(spark, sf_dir), spark.createDataFrame([("r1",)], "addr string"), max_depth=2)


@query("direct_dependents", f"SELECT addr FROM {_EDGES} WHERE input = 'n3'")
def direct_dependents(spark, sf_dir):
    return edges(spark, sf_dir).where("input = 'n3'").select("addr")


@query("transitive_inputs", f"{_UP} SELECT addr, min(depth) AS depth FROM d WHERE depth > 0 GROUP BY addr")
def transitive_inputs(spark, sf_dir):
    roots = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("addr"))
    return G.ancestors(edges(spark, sf_dir), roots)


@query("dag_depth", f"SELECT addr, max(depth) AS depth FROM (SELECT DISTINCT input AS addr, CASE substr(input, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS depth FROM {_EDGES} UNION SELECT addr, CASE substr(addr, 1, 1) WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END FROM {_EDGES}) GROUP BY addr")
def dag_depth(spark, sf_dir):
    return G.depth(edges(spark, sf_dir)).select("addr", F.col("depth").cast("int").alias("depth"))


@query("gc_live", f"SELECT DISTINCT addr FROM (SELECT addr FROM {_EDGES} UNION SELECT input FROM {_EDGES} UNION SELECT 'p1')")
def gc_live(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.live_set(e, e.select("addr").distinct(), spark.createDataFrame([("p1",)], "addr string"))


_OPEN = "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O')"


def _open_orders(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("addr")).distinct()


@query("gc_garbage", f"SELECT 'o' || o_orderkey AS addr, o_custkey AS size, (o_custkey % 1000)::INT AS age_seconds FROM orders WHERE o_orderkey NOT IN {_OPEN} AND o_custkey % 1000 >= 300")
def gc_garbage(spark, sf_dir):
    """Orders as leaves, in use while a line of them is open; ages are made up from customer keys."""
    leaves = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("addr"), F.col("o_custkey").alias("size"), (F.col("o_custkey") % 1000).cast("int").alias("age_seconds"))
    return G.garbage(leaves, _open_orders(spark, sf_dir), grace_seconds=300)


@query("gc_orphans", f"SELECT DISTINCT addr FROM {_EDGES} WHERE input IN ('n1', 'n2')")
def gc_orphans(spark, sf_dir):
    return G.orphan_recipes(edges(spark, sf_dir), spark.createDataFrame([("n1",), ("n2",)], "addr string"))


@query("repair_missing", f"SELECT 'o' || o_orderkey AS addr FROM orders WHERE o_orderkey NOT IN {_OPEN}")
def repair_missing(spark, sf_dir):
    return G.missing_from(edges(spark, sf_dir).where("addr like 'o%'").select("addr"), _open_orders(spark, sf_dir))


@query("remove_nodes", f"SELECT addr, input FROM {_EDGES} WHERE addr NOT IN (SELECT 'o' || l_orderkey FROM {_OPEN}) AND input NOT IN (SELECT 'o' || l_orderkey FROM {_OPEN})")
def remove_nodes(spark, sf_dir):
    return G.remove_nodes(edges(spark, sf_dir), _open_orders(spark, sf_dir))


@query("cache_eviction", """WITH e AS (SELECT p_partkey, p_size::BIGINT AS size, p_retailprice AS cpu, (p_partkey % 7)::INT AS hits FROM part),
s AS (SELECT p_partkey, size, cpu * (hits + 1) / size AS score FROM e WHERE p_partkey % 10 <> 0),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY score, 'p' || p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s), t AS (SELECT sum(size) AS total FROM e)
SELECT 'p' || p_partkey AS addr, round(score, 6) AS score, size FROM b, t WHERE total > 10000 * 0.8 AND total - before > 10000 * 0.6""")
def cache_eviction(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("addr"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("cpu_ms"), (F.col("p_partkey") % 7).cast("int").alias("hits"), (F.col("p_partkey") % 10 == 0).alias("pinned"))
    return G.eviction(e, 10000).withColumn("score", F.round("score", 6))


@query("range_read", "SELECT doc_id, lower(substr(hex(encode(text)), 1001, 3000)) AS content FROM documents WHERE octet_length(encode(text)) > 500")
def range_read(spark, sf_dir):
    chunks = explode_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 300)
    got = join_chunks(G.range_read(chunks, 500, 1500), "doc_id")
    return got.select("doc_id", F.lower(F.hex("content")).alias("content"))


@query("chunk_roundtrip", "SELECT doc_id, md5(text) AS out FROM documents WHERE octet_length(encode(text)) > 0")
def chunk_roundtrip(spark, sf_dir):
    return join_chunks(explode_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 1000), "doc_id").select("doc_id", digest(F.col("content")).alias("out"))
