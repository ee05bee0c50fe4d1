"""Format functions: texts built from tables, parsed and compared with the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry
from .common import digest, read

QUERIES: dict = {}


def _nation_csv(spark, sf_dir):
    """One CSV text per region: name and key of its nations."""
    rows = F.array_sort(F.collect_list(F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string"))))
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("name,key\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("csv"))


def _parsed(fn: str, *chain: str, **params):
    """Nations read back from what a chain of functions makes of the CSV."""
    def run(spark, sf_dir):
        c = registry.call(fn, "csv", **params)
        for step in chain:
            c = registry.call(step, c)
        rows = F.from_json(c.cast("string"), "array<struct<name:string,key:string>>")
        return _nation_csv(spark, sf_dir).select("n_regionkey", F.explode(rows).alias("r")).select("n_regionkey", F.col("r.name").alias("n_name"), F.col("r.key").cast("int").alias("n_nationkey"))

    return run


_NATIONS = "SELECT n_regionkey, n_name, n_nationkey FROM nation"
QUERIES["csv_parse"] = (_parsed("csv_parse"), _NATIONS)
QUERIES["csv_to_json"] = (_parsed("csv_to_json"), _NATIONS)
QUERIES["universal_to_json"] = (_parsed("universal_to_json"), _NATIONS)
for _name, _chain in (("msgpack", ("msgpack_encode", "msgpack_decode")), ("cbor", ("cbor_encode", "cbor_decode")), ("yaml", ("json_to_yaml", "yaml_to_json")), ("dag_cbor", ("dag_cbor_encode", "dag_cbor_decode")),
                      ("csv_write", ("csv_write", "csv_parse")), ("ndjson", ("ndjson_write", "ndjson_parse")), ("json_pretty", ("pretty_json", "minify_json"))):
    QUERIES[f"{_name}_nations"] = (_parsed("csv_parse", *_chain), _NATIONS)


def csv_filter_text(spark, sf_dir):
    c = registry.call("csv_parse", registry.call("csv_filter", "csv", column="name", op="gt", value="M"))
    rows = F.from_json(c, "array<struct<name:string,key:string>>")
    return _nation_csv(spark, sf_dir).select(F.explode(rows).alias("r")).select(F.col("r.name").alias("n_name"))


QUERIES["csv_filter_text"] = (csv_filter_text, "SELECT n_name FROM nation WHERE n_name > 'M'")


def format_detect(spark, sf_dir):
    return _nation_csv(spark, sf_dir).select("n_regionkey", F.get_json_object(registry.call("format_detect", "csv"), "$.format").alias("format"))


QUERIES["format_detect"] = (format_detect, "SELECT DISTINCT n_regionkey, 'csv' AS format FROM nation")


def sqlite_roundtrip(spark, sf_dir):
    c = registry.call("sqlite_query", registry.call("csv_to_sqlite", "csv"), query="SELECT count(*) AS n FROM data")
    return _nation_csv(spark, sf_dir).select("n_regionkey", F.regexp_extract(c, r"(\d+)", 1).cast("int").alias("n"))


QUERIES["sqlite_roundtrip"] = (sqlite_roundtrip, "SELECT n_regionkey, count(*)::INT AS n FROM nation GROUP BY 1")


def archive_roundtrip(create: str, extract: str):
    def run(spark, sf_dir):
        packed = registry.call(create, "n_name", F.col("n_regionkey").cast("string"), files="a.txt,b.txt")
        return read(spark, sf_dir, "nation").select("n_nationkey", registry.call(extract, packed, path="a.txt").cast("string").alias("n_name"))

    return run


for _a, _b in (("tar_create", "tar_extract"), ("tar_gz_create", "tar_gz_extract"), ("zip_create", "zip_extract_single")):
    QUERIES[f"{_a}_roundtrip"] = (archive_roundtrip(_a, _b), "SELECT n_nationkey, n_name FROM nation")


def fasta_parse(spark, sf_dir):
    fasta = F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit("\n"), F.regexp_replace("p_name", "[^A-Za-z]", "N"), F.lit("\n"))
    return read(spark, sf_dir, "part").select("p_partkey", F.get_json_object(registry.call("fasta_parse", fasta), "$.length").cast("int").alias("n"))


QUERIES["fasta_parse"] = (fasta_parse, "SELECT p_partkey, length(p_name)::INT AS n FROM part")


def syslog_parse(spark, sf_dir):
    line = F.concat(F.lit("<"), (F.col("event_id") % 190).cast("string"), F.lit(">1 2024-01-15T10:30:00Z host app "), F.col("user_id").cast("string"), F.lit(" ID - "), F.col("event_type"))
    got = registry.call("syslog_parse", line)
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(got, "$.facility").cast("int").alias("facility"), F.get_json_object(got, "$.message").alias("message"))


QUERIES["syslog_parse"] = (syslog_parse, "SELECT event_id, ((event_id % 190) // 8)::INT AS facility, event_type AS message FROM events")


def log_level_filter(spark, sf_dir):
    line = F.concat(F.when(F.col("event_type") == "error", "ERROR ").otherwise("INFO "), "event_type")
    return read(spark, sf_dir, "events").select("event_id", registry.call("log_level_filter", line, min_level="warn").alias("kept"))


QUERIES["log_level_filter"] = (log_level_filter, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR error' ELSE '' END AS kept FROM events")


def cid_compute(spark, sf_dir):
    c = registry.call("cid_parse", registry.call("cid_compute", "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", F.get_json_object(c, "$.digest").alias("digest"))


QUERIES["cid_compute"] = (cid_compute, "SELECT p_partkey, sha256(p_name) AS digest FROM part")


def avro_roundtrip(spark, sf_dir):
    schema = '{"type": "record", "name": "e", "fields": [{"name": "k", "type": "long"}]}'
    got = registry.call("avro_to_json", registry.call("json_to_avro", "props", F.lit(schema)))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(got, "$.k").cast("long").alias("k"))


QUERIES["avro_roundtrip"] = (avro_roundtrip, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")


def diff_patch(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    new = F.concat(registry.call("line_prefix", t, prefix="+ "), F.lit("\n"))
    old = F.concat(t, F.lit("\n"))
    return read(spark, sf_dir, "documents").select("doc_id", (digest(registry.call("patch", old, registry.call("diff", old, new))) == digest(new)).alias("same"))


QUERIES["diff_patch"] = (diff_patch, "SELECT doc_id, true AS same FROM documents")
