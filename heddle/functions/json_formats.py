"""JSON, NDJSON, CSV and XML documents held in one blob each; tables are read with ``sources`` instead."""

from __future__ import annotations

import csv
import io
import json
import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from ..registry import python


def dumps(value, indent=None) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"), sort_keys=True)


def rows_of(text: str, delimiter: str = ",", header: bool = True) -> list[dict[str, str]]:
    """CSV rows as objects of strings; a row of another length is an error."""
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter, strict=True) if r]
    if not rows:
        return []
    names = rows[0] if header else [f"col{i}" for i in range(len(rows[0]))]
    for r in rows[1 if header else 0 :]:
        if len(r) != len(names):
            raise ValueError(f"row has {len(r)} fields, not {len(names)}")
    return [dict(zip(names, r, strict=True)) for r in rows[1 if header else 0 :]]


def csv_of(rows: list[dict], names: list[str] | None = None, delimiter: str = ",") -> str:
    names = names if names is not None else list(rows[0]) if rows else []
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    if names:
        w.writerow(names)
    cell = lambda v: v if isinstance(v, str) else "" if v is None else dumps(v)
    w.writerows([[cell(r.get(n)) for n in names] for r in rows])
    return out.getvalue()


def ndjson_of(rows) -> str:
    return "\n".join(dumps(r) for r in rows)


def ndjson_rows(text: str) -> list:
    return [json.loads(line) for line in text.splitlines() if line.strip()]


@python("pretty_json", returns="string")
def pretty_json(x, p):
    return dumps(json.loads(x[0]), 2)


@python("minify_json", returns="string")
def minify_json(x, p):
    return dumps(json.loads(x[0]))


@python("csv_parse", returns="string")
def csv_parse(x, p):
    return dumps(rows_of(x[0].decode(), p.text("delimiter", ","), p.bool("has_header", True)))


@python("tsv_parse", returns="string")
def tsv_parse(x, p):
    return dumps(rows_of(x[0].decode(), "\t", p.bool("has_header", True)))


@python("csv_write", returns="string")
def csv_write(x, p):
    return csv_of(json.loads(x[0]), delimiter=p.text("delimiter", ","))


@python("csv_to_json", returns="string")
def csv_to_json(x, p):
    """Header CSV to a JSON array; fields beyond the header are col_i."""
    rows = [r for r in csv.reader(io.StringIO(x[0].decode())) if r]
    name = lambda i: rows[0][i] if i < len(rows[0]) else f"col_{i}"
    return dumps([{name(i): v for i, v in enumerate(r)} for r in rows[1:]], 2)


@python("json_to_csv", returns="string")
def json_to_csv(x, p):
    rows = json.loads(x[0])
    return csv_of(rows, sorted({k for r in rows for k in r}))


@python("json_lines", "ndjson_write", returns="string")
def json_lines(x, p):
    return ndjson_of(json.loads(x[0]))


@python("ndjson_parse", returns="string")
def ndjson_parse(x, p):
    return dumps(ndjson_rows(x[0].decode()))


def column_label(values: list[str]) -> str:
    """integer, float, boolean or string: the first that all non-empty values fit."""
    seen = [v for v in values if v != ""]
    tests = (("integer", r"[+-]?\d+"), ("float", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), ("boolean", r"true|false"))
    return next((n for n, rx in tests if seen and all(re.fullmatch(rx, v) for v in seen)), "string")


@python("csv_schema_infer", returns="string")
def csv_schema_infer(x, p):
    rows = rows_of(x[0].decode(), p.text("delimiter", ","))[: p.int("sample_rows", 100)]
    return dumps({n: column_label([r[n] for r in rows]) for n in (rows[0] if rows else {})})


def compare(value: str, op: str, want: str) -> bool:
    """String comparison: '9' is greater than '10'."""
    tests = {"eq": value == want, "ne": value != want, "lt": value < want, "le": value <= want, "gt": value > want, "ge": value >= want,
             "contains": want in value, "starts_with": value.startswith(want), "ends_with": value.endswith(want)}
    if op == "regex":
        return re.search(want, value) is not None
    if op not in tests:
        raise ValueError(f"unknown op {op}")
    return tests[op]


@python("csv_column_select", returns="string")
def csv_column_select(x, p):
    rows = rows_of(x[0].decode())
    names = [c for c in p.list("columns") if rows and c in rows[0]]
    if not names:
        raise ValueError("no such column")
    return csv_of(rows, names)


@python("csv_column_rename", returns="string")
def csv_column_rename(x, p):
    names = json.loads(p.text("mapping"))
    return csv_of([{names.get(k, k): v for k, v in r.items()} for r in rows_of(x[0].decode())])


@python("csv_filter", returns="string")
def csv_filter(x, p):
    rows = rows_of(x[0].decode())
    return csv_of([r for r in rows if compare(r[p.text("column")], p.text("op"), p.text("value"))], list(rows[0]) if rows else [])


def _number(v: str):
    try:
        return float(v)
    except ValueError:
        return None


@python("csv_sort", returns="string")
def csv_sort(x, p):
    """Numbers before other strings, so that the order is total; desc is the reverse."""
    rows = rows_of(x[0].decode())
    key = lambda r: (_number(r[p.text("column")]) is None, _number(r[p.text("column")]) or 0.0, r[p.text("column")])
    done = sorted(rows, key=key)
    return csv_of(done[::-1] if p.text("order", "asc") == "desc" else done, list(rows[0]) if rows else [])


@python("csv_aggregate", returns="string")
def csv_aggregate(x, p):
    values = [v for r in rows_of(x[0].decode()) if (v := _number(r.get(p.text("column"), ""))) is not None]
    name = p.choice("function", ("count", "sum", "avg", "min", "max"))
    got = {"count": len(values), "sum": sum(values), "avg": sum(values) / len(values) if values else 0.0, "min": min(values, default=float("inf")), "max": max(values, default=float("-inf"))}[name]
    return str(got)


@python("csv_join", inputs=2, returns="string")
def csv_join(x, p):
    left, right = (rows_of(v.decode()) for v in x)
    on, how = p.text("join_column"), p.choice("join_type", ("inner", "left", "right", "full"), "inner")
    if any(rows and on not in rows[0] for rows in (left, right)):
        raise ValueError(f"no column {on}")
    l_names, r_names = (list(rows[0]) if rows else [on] for rows in (left, right))
    extra = [n for n in r_names if n != on]
    table: dict[str, list[dict]] = {}
    for r in right:
        table.setdefault(r[on], []).append(r)
    out, used = [], set()
    for r in left:
        for m in table.get(r[on], [{}] if how in ("left", "full") else []):
            used.add(r[on])
            out.append(r | {n: m.get(n, "") for n in extra})
    if how in ("right", "full"):
        out += [{n: "" for n in l_names} | r for r in right if r[on] not in {v[on] for v in left}]
    return csv_of(out, l_names + extra)


@python("csv_deduplicate", returns="string")
def csv_deduplicate(x, p):
    rows = rows_of(x[0].decode())
    names = p.list("columns", list(rows[0]) if rows else [])
    seen: set = set()
    return csv_of([r for r in rows if (k := tuple(r[n] for n in names)) not in seen and not seen.add(k)], list(rows[0]) if rows else [])


def at_path(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def as_string(v) -> str:
    return v if isinstance(v, str) else dumps(v)


@python("ndjson_filter", returns="string")
def ndjson_filter(x, p):
    keep = [line for line in x[0].decode().splitlines() if line.strip() and compare(as_string(at_path(json.loads(line), p.text("path"))), p.text("op"), p.text("value"))]
    return "\n".join(keep)


@python("ndjson_project", returns="string")
def ndjson_project(x, p):
    return ndjson_of({path: at_path(r, path) for path in p.list("paths")} for r in ndjson_rows(x[0].decode()))


def json_path(value, path: str) -> list:
    """Matches of a JSONPath: names, indices, slices, wildcards, recursive descent and simple filters."""
    steps = re.findall(r"\.\.(?:\[[^\]]*\]|[\w*-]+)?|\.[\w*-]+|\[\?\(.*?\)\]|\[[^\]]*\]", path.strip().removeprefix("$"))
    found = [value]

    def deep(v):
        yield v
        for w in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from deep(w)

    def pick(v, key: str):
        if key.startswith("?"):
            m = re.fullmatch(r"\?\(@\.([\w.]+)\s*(?:(==|!=|<=|>=|<|>)\s*(.+?))?\)", key)
            if not m:
                raise ValueError(f"filter {key} is not supported")
            for w in v if isinstance(v, list) else v.values() if isinstance(v, dict) else ():
                got = at_path(w, m[1])
                want = json.loads(m[3].replace("'", '"')) if m[3] else None
                ok = got is not None if not m[2] else {"==": lambda: got == want, "!=": lambda: got != want, "<": lambda: got < want, ">": lambda: got > want, "<=": lambda: got <= want, ">=": lambda: got >= want}[m[2]]() if got is not None or m[2] in ("==", "!=") else False
                if ok:
                    yield w
        elif key == "*":
            yield from v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        elif isinstance(v, dict) and key in v:
            yield v[key]
        elif isinstance(v, list) and re.fullmatch(r"-?\d+", key) and -len(v) <= int(key) < len(v):
            yield v[int(key)]
        elif isinstance(v, list) and ":" in key:
            yield from v[slice(*(int(n) if n else None for n in key.split(":")))]

    for step in steps:
        if step.startswith(".."):
            found = [w for v in found for w in deep(v)]
            step = step[2:] if step[2:].startswith("[") else "." + step[2:]
            if step == ".":
                continue
        keys = step[1:].split("|") if step.startswith(".") else [k.strip().strip("'\"") for k in (step[1:-1].split(",") if not step.startswith("[?") else [step[1:-1]])]
        found = [w for v in found for k in keys for w in pick(v, k)]
    return found


@python("jsonpath_extract", returns="string")
def jsonpath_extract(x, p):
    return dumps(json_path(json.loads(x[0]), p.text("path")))


def merged(a, b, deep: bool, lists: bool = False):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merged(a[k], v, deep, lists) if deep and k in a else v for k, v in b.items()}
    return a + b if lists and isinstance(a, list) and isinstance(b, list) else b


@python("json_merge", inputs=2, returns="string")
def json_merge(x, p):
    return dumps(merged(json.loads(x[0]), json.loads(x[1]), p.choice("strategy", ("shallow", "deep"), "shallow") == "deep"))


@python("json_flatten", returns="string")
def json_flatten(x, p):
    sep, out = p.text("separator", "."), {}

    def walk(v, at):
        for k, w in v.items() if isinstance(v, dict) else enumerate(v):
            key = f"{at}{sep}{k}" if at else str(k)
            walk(w, key) if isinstance(w, (dict, list)) else out.update({key: w})

    walk(json.loads(x[0]), "")
    return dumps(out)


@python("json_unflatten", returns="string")
def json_unflatten(x, p):
    out: dict = {}
    for key, v in json.loads(x[0]).items():
        at, (*path, last) = out, key.split(p.text("separator", "."))
        for k in path:
            at = at.setdefault(k, {})
            if not isinstance(at, dict):
                raise ValueError(f"{key} conflicts with another key")
        if isinstance(at.get(last), dict):
            raise ValueError(f"{key} conflicts with another key")
        at[last] = v
    return dumps(out)


def xml_value(e: ElementTree.Element):
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        out[child.tag] = xml_value(child)
    body = (e.text or "").strip()
    if not out:
        return body
    return out | ({"#text": body} if body else {})


@python("xml_parse", returns="string")
def xml_parse(x, p):
    """Attributes as @name, text as #text; of siblings with one name the last stays."""
    e = ElementTree.fromstring(x[0])
    return dumps({e.tag: xml_value(e)})


def xml_text(name: str, v) -> str:
    if isinstance(v, list):
        return "".join(xml_text(name, w) for w in v)
    if not isinstance(v, dict):
        return f"<{name}>{'' if v is None else escape(as_string(v))}</{name}>"
    attrs = "".join(f' {k[1:]}="{escape(as_string(w), {chr(34): "&quot;"})}"' for k, w in v.items() if k.startswith("@"))
    body = "".join(escape(as_string(w)) if k == "#text" else xml_text(k, w) for k, w in v.items() if not k.startswith("@"))
    return f"<{name}{attrs}>{body}</{name}>"


@python("xml_write", returns="string")
def xml_write(x, p):
    return xml_text(p.text("root_element", "root"), json.loads(x[0]))


@python("xml_xpath_extract", returns="string")
def xml_xpath_extract(x, p):
    """A slash path over the JSON form; 'null' if nothing is there."""
    e = ElementTree.fromstring(x[0])
    v = {e.tag: xml_value(e)}
    for part in p.text("xpath").strip("/").split("/"):
        v = v.get(part) if isinstance(v, dict) else None
    return as_string(v)


@python("xml_xslt_transform", "xml_validate_dtd", "xml_validate_xsd")
def xml_validate(x, p):
    """Well-formed XML passes unchanged; stylesheets and schemas are not applied."""
    ElementTree.fromstring(x[0])
    return x[0]
