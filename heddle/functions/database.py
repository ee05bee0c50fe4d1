"""Database dumps and files."""

from __future__ import annotations

import csv
import io
import re
import sqlite3

from ..registry import python, unsupported
from .json_formats import dumps, ndjson_of, rows_of


def _open(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _csv(cursor) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow([d[0] for d in cursor.description])
    w.writerows([["" if v is None else v for v in r] for r in cursor])
    return out.getvalue()


@python("sqlite_query", returns="string")
def sqlite_query(x, p):
    """Rows of a query over an SQLite file, as CSV."""
    return _csv(_open(x[0]).execute(p.text("query")))


@python("sqlite_table_list", returns="string")
def sqlite_table_list(x, p):
    return dumps([r[0] for r in _open(x[0]).execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")])


@python("sqlite_to_csv", returns="string")
def sqlite_to_csv(x, p):
    return _csv(_open(x[0]).execute(f"SELECT * FROM {_quoted(p.text('table'))}"))


@python("csv_to_sqlite")
def csv_to_sqlite(x, p):
    rows, con = rows_of(x[0].decode()), sqlite3.connect(":memory:")
    names = list(rows[0]) if rows else ["col0"]
    table = _quoted(p.text("table", "data"))
    con.execute(f"CREATE TABLE {table} ({', '.join(_quoted(n) + ' TEXT' for n in names)})")
    con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", [tuple(r.values()) for r in rows])
    con.commit()
    return con.serialize()


_UNESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "\\": "\\"}


@python("postgres_copy_parse", returns="string")
def postgres_copy_parse(x, p):
    """COPY text to CSV; \\N becomes the empty field."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for line in x[0].decode().splitlines():
        if line == "\\.":
            break
        w.writerow(["" if f == "\\N" else re.sub(r"\\(.)", lambda m: _UNESCAPE.get(m[1], m[1]), f) for f in line.split("\t")])
    return out.getvalue()


@python("postgres_copy_write", returns="string")
def postgres_copy_write(x, p):
    put = lambda f: "\\N" if f == "" else f.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "".join("\t".join(put(f) for f in r) + "\n" for r in csv.reader(io.StringIO(x[0].decode())))


@python("wal_parse", returns="string")
def wal_parse(x, p):
    fmt = p.choice("format", ("postgres", "mysql"), "postgres")
    kinds = ("INSERT", "UPDATE", "DELETE")
    return ndjson_of({"operation": k, "format": fmt, "raw": line} for line in x[0].decode().splitlines() for k in [next((k for k in kinds if k in line.upper()), None)] if k)


@python("sql_dump_parse", returns="string")
def sql_dump_parse(x, p):
    """Statements with their kind; lines that start with -- are comments."""
    text = "\n".join(line for line in x[0].decode().splitlines() if not line.lstrip().startswith("--"))
    kinds = (("create_table", r"CREATE\s+TABLE"), ("insert", "INSERT"), ("copy", "COPY"))
    parts = [s.strip() for s in re.split(r";[ \t]*(?:\n|$)", text)]
    return ndjson_of({"type": next((k for k, rx in kinds if re.match(rx, s, re.I)), "other"), "statement": s} for s in parts if s)


unsupported("sst_metadata", "sst_scan", why="there is no SST reader here")
