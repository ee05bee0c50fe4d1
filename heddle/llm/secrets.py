"""Secret scan with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed (SHA-256 of its text).  The ledger is a table keyed by (blob, rule, version of
the rule) with the spans found, none included.  A run scans only the pairs of blob and rule version that the ledger lacks: a blob
with many paths is read from one of them, and a rule with a new version runs alone over old blobs.  Findings are joined
back to all paths by address.  Texts are scanned where they are read; only addresses and findings are shuffled.

Rules: assign, access and hex as in the query's contract; added: ``pem`` private key headers, ``jwt`` tokens and ``url``
credentials.  Rules are plain patterns without checksums.

Edge cases: null texts count as empty; empty tables give no rows; rows repeating an id are all reported, rows of a null id too;
extra columns are ignored; the ledger may be absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, read, stage, union_all
from .spans import SPAN, keep, listed, matches

CONTEXT = 48  # characters before a span in which context words count
# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
# A token starts where a run of its characters starts, so a long run is read once.
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
URL = r"[a-z][a-z0-9+]{1,20}://[^\x00-\x20/:@]++:[^\x00-\x20/:@]++@"

KINDS = ("assign", "access", "hex", "pem", "jwt", "url")
RULE_VERSIONS = {"assign": "1", "access": "1", "hex": "1", "pem": "1", "jwt": "2", "url": "2"}


def rules(text: Column) -> dict[str, Column]:
    return {
        "assign": keep(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
        "pem": matches(text, PEM),
        "jwt": matches(text, JWT),
        "url": matches(text, URL),
    }


def address(text: Column) -> Column:
    return F.sha2(text, 256)


LEDGER = f"blob string, rule string, rule_version string, spans {SPAN}"


def pending(paths: DataFrame, ledger: DataFrame | None, versions: dict[str, str]) -> DataFrame:
    """(blob, id, rules): for each blob that some rule has not seen in its present version, the path to read it from."""
    one = paths.groupBy("blob").agg(F.min("id").alias("id"))
    every = F.array(*(F.lit(k) for k in versions))
    if ledger is None:
        return one.withColumn("rules", every)
    current = F.map_from_arrays(every, F.array(*(F.lit(v) for v in versions.values())))
    done = ledger.where(F.col("rule_version") == current[F.col("rule")]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    left = one.join(done, "blob", "left").select("blob", "id", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
    return left.where(F.size("rules") > 0)


def scan_versions(versions: DataFrame, id_col: str, text_col: str, ledger: DataFrame | None = None, rule_versions: dict[str, str] = RULE_VERSIONS):
    """(findings per path: id, blob and an array of spans per rule; the ledger rows that this run adds)."""
    texts = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
    paths = stage(texts.select("id", "blob"), "paths")
    todo = stage(pending(paths, ledger, rule_versions), "pending")
    place = F.xxhash64(F.col("id").cast("string"), "blob")
    fresh = []
    # Blobs that lack the same rules are scanned together; there are as many such sets as there have been changes of rules.
    for row in todo.select("rules").distinct().collect():
        wanted = todo.where(F.col("rules") == F.array(*(F.lit(k) for k in row["rules"]))).select("blob", "id").withColumn("place", place)
        spans = rules(F.col("text"))
        found = bit_filter(texts.withColumn("place", place), "place", wanted, "place").select("place", "blob", *(spans[k].alias(k) for k in row["rules"]))
        # The bit table lets some other paths through: the exact join.
        found = found.join(wanted.select("place", "blob"), ["place", "blob"], "left_semi").dropDuplicates(["blob"])
        entries = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(rule_versions[k]).alias("rule_version"), F.col(k).alias("spans")) for k in row["rules"])))
        fresh.append(found.select("blob", entries.alias("e")).select("blob", "e.*"))
    # The ledger is a table: findings come from what is written in it.
    added = stage(union_all(fresh), "ledger") if fresh else paths.sparkSession.createDataFrame([], LEDGER)
    book = added if ledger is None else ledger.select("blob", "rule", "rule_version", "spans").union(added)
    current = book.where(" or ".join(f"rule = '{k}' and rule_version = '{v}'" for k, v in rule_versions.items()))
    by_blob = current.groupBy("blob").agg(*(F.max(F.when(F.col("rule") == k, F.col("spans"))).alias(k) for k in rule_versions))
    return paths.join(by_blob, "blob"), added


def op5_secret_scan(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    findings, _ = scan_versions(read(spark, sf_dir, "documents"), "doc_id", "text", ledger)
    base = [(k, F.col(k)) for k in KINDS[:3]]
    return findings.select(
        F.col("id").alias("doc_id"), *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base),
        F.sha2(listed(base), 256).alias("base_sha256"), listed([(k, F.col(k)) for k in KINDS]).alias("spans"))


def span_sql(kinds: list[tuple[str, str, str]], base: int, context: dict | None = None, lead: dict | None = None) -> str:
    """DuckDB SQL of span lists; kinds: (name, pattern without groups, SQL condition on the match m).

    ``lead``: by kind how many characters before the span its pattern takes, for want of look-behind.
    ``context``: by kind its prior, its raised score and the pattern of its context words; adds top_score.
    """
    def score(name: str) -> str:
        if context is None:
            return "NULL"
        prior, raised, words = context[name]
        return f"CASE WHEN regexp_matches(lower(substr(t, greatest(start - {CONTEXT - 1}, 1), least(start, {CONTEXT}))), '{words}') THEN {raised!r}::DOUBLE ELSE {prior!r}::DOUBLE END"

    length = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: len(x))), 0)"
    parts = "\nUNION ALL ".join(
        f"SELECT r, {i} AS k, '{name}' AS kind, start + {(lead or {}).get(name, 0)} AS start, start + len(m) AS stop, {score(name)} AS score FROM ("
        f"SELECT r, t, m, ({length('g[1:j]')} + {length('f[1:j - 1]')})::BIGINT AS start FROM ("
        f"SELECT r, t, f, g, unnest(f) AS m, unnest(range(1, len(f) + 1)) AS j FROM ("
        f"SELECT r, t, regexp_extract_all(t, '{p}') AS f, regexp_split_to_array(t, '{p}') AS g FROM d))) WHERE {cond}"
        for i, (name, p, cond) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n, _, _ in kinds[:base])
    names = ", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n, _, _ in kinds[:base])
    text = "kind || ':' || start || ':' || stop"
    top = "" if context is None else ", coalesce(top, 0.0)::DOUBLE AS top_score"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({parts}),
a AS (SELECT r, {counts}, max(score) AS top, string_agg({text}, ',' ORDER BY start, k) FILTER (k < {base}) AS base, string_agg({text}, ',' ORDER BY start, k) AS spans FROM s GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans{top} FROM d LEFT JOIN a USING (r)"""


_PLAIN = "true"
_ASSIGN_SQL = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE_SQL = r"""len(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""
OP5_SQL = span_sql([
    ("assign", _ASSIGN_SQL, _VALUE_SQL),
    ("access", "AKIA[A-Z0-9]+", "len(m) >= 20"),
    ("hex", "[0-9a-f]+", "len(m) >= 24"),
    ("pem", PEM, _PLAIN),
    ("jwt", "(?:^|[^A-Za-z0-9_-])" + JWT[JWT.index("eyJ"):].replace("++", "+"), _PLAIN),
    ("url", URL.replace("++", "+"), _PLAIN),
], 3, lead={"jwt": "CASE WHEN m LIKE 'eyJ%' THEN 0 ELSE 1 END"})
