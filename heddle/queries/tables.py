"""Relational operators and aggregates over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lines as L
from ..operators import relational as R
from ..layout import explode_chunks, explode_lines
from ..plans.recipes import Store, Verification
from ..streaming.chunks import whole
from .common import LINES, read

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def wrap(f):
        QUERIES[name] = (f, sql)
        return f

    return wrap


def flagship(spark, sf_dir):
    """Finished orders by market segment, as a chain of recipes."""
    s = Store(spark)
    orders, customers = s.put_leaf(read(spark, sf_dir, "orders")), s.put_leaf(read(spark, sf_dir, "customer"))
    done = s.put_recipe("filter", [orders], {"column": "o_orderstatus", "op": "eq", "value": "F"})
    keyed = s.put_recipe("rename", [done], {"mapping": {"o_custkey": "c_custkey"}})
    joined = s.put_recipe("join", [keyed, customers], {"on": "c_custkey"})
    return s.materialise(s.put_recipe("frequency", [joined], {"column": "c_mktsegment"}))


QUERIES["recipe_flagship"] = (flagship, "SELECT c_mktsegment AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")

@query("recipe_functions", "SELECT doc_id AS key, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS content FROM documents")
def recipe_functions(spark, sf_dir):
    """Registered functions of blobs, named by recipes."""
    s = Store(spark)
    leaf = s.put_leaf(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    lower = s.put_recipe("lowercase", [leaf])
    return s.materialise(s.put_recipe("sha256", [lower])).select("key", F.lower(F.hex("content")).alias("content"))


@query("recipe_streams", "SELECT doc_id, lower(hex(encode(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')))) AS content FROM documents WHERE octet_length(encode(text)) > 0")
def recipe_streams(spark, sf_dir):
    """Stream functions over chunk tables, named by recipes, with sampled verification and a kept result."""
    s = Store(spark)
    chunks = explode_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 500).select(F.col("doc_id").alias("stream_id"), "chunk_idx", "content")
    upper = s.put_recipe("streaming_uppercase", [s.put_leaf(chunks)])
    out = s.materialise(upper, keep=True, verification=Verification.SAMPLED, rate=0.5)
    return whole(out).select(F.col("stream_id").alias("doc_id"), F.lower(F.hex("content")).alias("content"))


for _op, _column, _value, _sql in (
    ("eq", "o_orderstatus", "F", "o_orderstatus = 'F'"), ("ne", "o_orderstatus", "F", "o_orderstatus <> 'F'"), ("lt", "o_custkey", "5", "o_custkey::VARCHAR < '5'"), ("le", "o_custkey", "50", "o_custkey::VARCHAR <= '50'"),
    ("gt", "o_custkey", "7", "o_custkey::VARCHAR > '7'"), ("ge", "o_custkey", "70", "o_custkey::VARCHAR >= '70'"), ("contains", "o_orderpriority", "IG", "contains(o_orderpriority, 'IG')"),
    ("starts_with", "o_orderpriority", "1", "starts_with(o_orderpriority, '1')"), ("ends_with", "o_orderpriority", "T", "ends_with(o_orderpriority, 'T')"), ("regex", "o_orderpriority", "[1-3]-[HU]", "regexp_matches(o_orderpriority, '[1-3]-[HU]')"),
):
    def _filter(spark, sf_dir, op=_op, column=_column, value=_value):
        return R.select_columns(R.filter_rows(read(spark, sf_dir, "orders"), column, op, value), ["o_orderkey", column])

    QUERIES[f"csv_filter_{_op}"] = (_filter, f"SELECT o_orderkey, {_column} FROM orders WHERE {_sql}")


@query("parquet_filter_typed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def parquet_filter_typed(spark, sf_dir):
    return R.select_columns(R.filter_rows(read(spark, sf_dir, "lineitem"), "l_quantity", "gt", 45.0, typed=True), ["l_orderkey", "l_linenumber", "l_quantity"])


@query("parquet_filter_null", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL")
def parquet_filter_null(spark, sf_dir):
    return R.filter_rows(read(spark, sf_dir, "customer"), "c_mktsegment", "is_not_null").agg(F.count("*").alias("n"))


@query("csv_column_select", "SELECT c_custkey, c_name FROM customer")
def csv_column_select(spark, sf_dir):
    return R.select_columns(read(spark, sf_dir, "customer"), ["c_custkey", "nowhere", "c_name"])


@query("csv_column_rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def csv_column_rename(spark, sf_dir):
    return R.rename_columns(read(spark, sf_dir, "nation"), {"n_nationkey": "id", "n_name": "name"})


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    def _joined(spark, sf_dir, how=_how):
        left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
        right = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority").distinct()
        return R.join_tables(left, right, "k", how, fill="")

    QUERIES[f"csv_join_{_how}"] = (_joined, f"SELECT coalesce(l.k, r.k) AS k, coalesce(c_mktsegment, '') AS c_mktsegment, coalesce(o_orderpriority, '') AS o_orderpriority FROM (SELECT c_custkey AS k, c_mktsegment FROM customer) l {_join} (SELECT DISTINCT o_custkey AS k, o_orderpriority FROM orders) r ON l.k = r.k")

for _fn, _sql in (("count", "count(l_extendedprice)::DOUBLE"), ("sum", "sum(l_extendedprice)"), ("avg", "avg(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)")):
    def _aggregate(spark, sf_dir, fn=_fn):
        return R.aggregate(read(spark, sf_dir, "lineitem"), "l_extendedprice", fn).select(F.round("value", 2).alias("value"))

    def _keyed(spark, sf_dir, fn=_fn):
        return R.aggregate(read(spark, sf_dir, "lineitem"), "l_extendedprice", fn, ["l_returnflag", "l_linestatus"]).withColumn("value", F.round("value", 2))

    QUERIES[f"csv_aggregate_{_fn}"] = (_aggregate, f"SELECT round({_sql}, 2) AS value FROM lineitem")
    QUERIES[f"csv_aggregate_{_fn}_by"] = (_keyed, f"SELECT l_returnflag, l_linestatus, round({_sql}, 2) AS value FROM lineitem GROUP BY ALL")


@query("csv_sort_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def csv_sort_top(spark, sf_dir):
    return R.sort_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "desc", ["o_orderkey"]).limit(20)


@query("csv_deduplicate", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def csv_deduplicate(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return R.deduplicate(df, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("csv_deduplicate_all", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def csv_deduplicate_all(spark, sf_dir):
    return R.deduplicate(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("parquet_merge", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def parquet_merge(spark, sf_dir):
    return R.union(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("table_nth", "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 2")
def table_nth(spark, sf_dir):
    return R.nth_per_key(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], 1).select("l_orderkey", "l_partkey")


@query("table_tail", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 10")
def table_tail(spark, sf_dir):
    return R.tail(read(spark, sf_dir, "customer").select("c_custkey"), 10, ["c_custkey"])


@query("ndjson_filter", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), 'null') > '5'")
def ndjson_filter(spark, sf_dir):
    return R.ndjson_filter(read(spark, sf_dir, "events"), "props", "k", "gt", "5").select("event_id")


@query("ndjson_project", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.x.y') AS \"x.y\" FROM events")
def ndjson_project(spark, sf_dir):
    return R.ndjson_project(read(spark, sf_dir, "events"), "props", ["k", "x.y"], ["event_id"])


_KIND = "CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'float' ELSE 'string' END"


def _inferred(spark, sf_dir, table):
    """Types as the values of all rows, taken as strings, have them."""
    df = read(spark, sf_dir, table)
    return R.infer_schema(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)))


@query("schema_infer", f"""SELECT column_name AS "column", {_KIND} AS type FROM (DESCRIBE SELECT * FROM customer)""")
def schema_infer(spark, sf_dir):
    return _inferred(spark, sf_dir, "customer")


@query("partition_manifest", "SELECT o_orderstatus AS value, count(*) AS num_rows FROM orders GROUP BY 1")
def partition_manifest(spark, sf_dir):
    return R.partition_manifest(read(spark, sf_dir, "orders"), "o_orderstatus")


@query("column_statistics", "SELECT 'n_nationkey' AS \"column\", min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max, count(*) - count(n_nationkey) AS null_count, count(*) AS num_values FROM nation UNION ALL SELECT 'n_name', min(n_name), max(n_name), count(*) - count(n_name), count(*) FROM nation UNION ALL SELECT 'n_regionkey', min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR, count(*) - count(n_regionkey), count(*) FROM nation")
def column_statistics(spark, sf_dir):
    return R.column_statistics(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("columnar_to_row", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS row FROM region")
def columnar_to_row(spark, sf_dir):
    return R.columnar_to_row(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


_BARE = "SELECT substr(column_name, 3) AS c, {} AS t FROM (DESCRIBE SELECT * FROM {})"


@query("schema_compare", f"SELECT coalesce(a.c, b.c) AS field, CASE WHEN b.c IS NULL THEN 'removed' WHEN a.c IS NULL THEN 'added' ELSE 'changed' END AS change FROM ({_BARE.format(_KIND, 'customer')}) a FULL JOIN ({_BARE.format(_KIND, 'part')}) b ON a.c = b.c WHERE a.t IS DISTINCT FROM b.t")
def schema_compare(spark, sf_dir):
    bare = lambda table: _inferred(spark, sf_dir, table).select(F.expr("substr(column, 3)").alias("column"), "type")
    return R.compare_schemas(bare("customer"), bare("part"))


@query("frequency", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS value, count(*) AS n FROM lineitem GROUP BY 1")
def frequency(spark, sf_dir):
    return A.frequency(read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")), "d")


@query("table_entropy", "SELECT round(entropy(l_partkey), 6) AS entropy FROM lineitem")
def table_entropy(spark, sf_dir):
    return A.entropy(read(spark, sf_dir, "lineitem"), "l_partkey").select(F.round("entropy", 6).alias("entropy"))


@query("histogram", "SELECT b::INT AS byte, count(h)::BIGINT AS n FROM range(256) r(b) LEFT JOIN (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) ON h = printf('%02X', b) GROUP BY b")
def histogram(spark, sf_dir):
    return A.byte_histogram(read(spark, sf_dir, "documents"), "text")


@query("percentile", "SELECT round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(median(l_extendedprice), 4) AS p50 FROM lineitem")
def percentile(spark, sf_dir):
    p90, p50 = A.exact_percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", [90, 50])
    return spark.range(1).select(F.round(F.lit(p90), 4).alias("p90"), F.round(F.lit(p50), 4).alias("p50"))


@query("table_cardinality", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def table_cardinality(spark, sf_dir):
    return A.cardinality(read(spark, sf_dir, "lineitem"), "l_partkey")


# Lines as rows
_ROWS = f"(SELECT doc_id, unnest(range(0, len({LINES}))) AS pos, unnest({LINES}) AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


def _lines(spark, sf_dir):
    return explode_lines(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")


_hash = lambda df: df.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line"))


def _line_query(name: str, fn, sql: str) -> None:
    QUERIES[f"rows_{name}"] = (lambda spark, sf_dir: _hash(fn(_lines(spark, sf_dir))), f"SELECT doc_id, pos::BIGINT AS pos, md5(line) AS line FROM ({sql})")


_line_query("grep", lambda d: L.grep(d, "[0-9]{3}"), f"SELECT * FROM {_ROWS} WHERE regexp_matches(line, '[0-9]{{3}}')")
_line_query("grep_invert", lambda d: L.grep(d, "th", invert=True), f"SELECT * FROM {_ROWS} WHERE NOT regexp_matches(line, 'th')")
_line_query("unique", lambda d: L.unique(d, "doc_id"), f"SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM {_ROWS}) WHERE p IS DISTINCT FROM line")
_line_query("line_number", L.number_lines, f"SELECT doc_id, pos, lpad((pos + 1)::VARCHAR, 6, ' ') || chr(9) || line AS line FROM {_ROWS}")
_line_query("line_prefix", lambda d: L.prefix_lines(d, "# "), f"SELECT doc_id, pos, '# ' || line AS line FROM {_ROWS}")
_line_query("head", lambda d: L.head(d, 2), f"SELECT * FROM {_ROWS} WHERE pos < 2")
_line_query("tail", lambda d: L.tail(d, "doc_id", 2), f"SELECT * FROM {_ROWS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 2")
_line_query("nth", lambda d: L.nth(d, 1), f"SELECT * FROM {_ROWS} WHERE pos = 1")
_line_query("zip", lambda d: L.zip_lines(d, L.prefix_lines(d, "+"), "doc_id"), f"SELECT doc_id, pos, line || chr(9) || '+' || line AS line FROM {_ROWS}")
_line_query("alternate", lambda d: L.alternate(d, L.head(d, 1), "doc_id"), f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS pos, line FROM (SELECT *, 0 AS i FROM {_ROWS} UNION ALL SELECT *, 1 FROM {_ROWS} WHERE pos < 1)")


@query("rows_frequency", f"SELECT md5(line) AS line, count(*) AS n FROM {_ROWS} WHERE line <> '' GROUP BY 1")
def rows_frequency(spark, sf_dir):
    return L.frequency(_lines(spark, sf_dir)).select(F.md5(F.col("line").cast("binary")).alias("line"), "n")


@query("rows_text", f"SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS out FROM {_ROWS} GROUP BY doc_id")
def rows_text(spark, sf_dir):
    return L.text(_lines(spark, sf_dir), "doc_id").select("doc_id", F.md5(F.col("content").cast("binary")).alias("out"))


@query("rows_diff", f"SELECT doc_id, md5(line) AS line, 'removed' AS change, count(*) AS n FROM {_ROWS} WHERE pos >= 3 GROUP BY ALL")
def rows_diff(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("line", F.concat("line", F.lit(""), F.lit("")))
    cut = L.diff(d, L.head(d, 3), "doc_id")
    return cut.select("doc_id", F.md5(F.col("line").cast("binary")).alias("line"), "change", "n")
