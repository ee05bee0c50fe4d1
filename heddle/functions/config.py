"""Configuration formats to and from JSON."""

from __future__ import annotations

import configparser
import json
import plistlib
import re
import tomllib

from ..registry import python
from .json_formats import as_string, dumps, merged


def yaml_load(text):
    import yaml

    return yaml.safe_load(text)


def yaml_dump(v) -> str:
    import yaml

    return yaml.safe_dump(v, allow_unicode=True, sort_keys=True, default_flow_style=False)


def plain(v):
    """Dates and times as ISO strings, so that JSON can hold what YAML and TOML give."""
    if isinstance(v, dict):
        return {str(k): plain(w) for k, w in v.items()}
    if isinstance(v, list):
        return [plain(w) for w in v]
    return v if v is None or isinstance(v, (str, int, float, bool)) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def toml_dump(v: dict) -> str:
    """TOML of a JSON object: scalars first, then tables; lists of objects are arrays of tables."""
    def key(k):
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)

    def value(w):
        if isinstance(w, bool):
            return "true" if w else "false"
        if isinstance(w, dict):
            return "{ " + ", ".join(f"{key(k)} = {value(u)}" for k, u in w.items()) + " }"
        if isinstance(w, list):
            return "[" + ", ".join(value(u) for u in w) + "]"
        if w is None:
            raise ValueError("TOML has no null")
        return json.dumps(w, ensure_ascii=False)

    def table(t, path):
        flat = {k: w for k, w in t.items() if not isinstance(w, dict) and not (isinstance(w, list) and w and all(isinstance(u, dict) for u in w))}
        out = [f"{key(k)} = {value(w)}" for k, w in flat.items()]
        for k, w in t.items():
            if k in flat:
                continue
            name = ".".join([*path, key(k)])
            for u in [w] if isinstance(w, dict) else w:
                out += ["", f"[{name}]" if isinstance(w, dict) else f"[[{name}]]", *table(u, [*path, key(k)])]
        return out

    if not isinstance(v, dict):
        raise ValueError("TOML needs an object")
    return "\n".join(table(v, [])).lstrip("\n") + "\n"


def ini_load(text: str) -> dict:
    """Sections of keys; keys before any section belong to section default."""
    c = configparser.RawConfigParser(allow_no_value=True, strict=False)
    head = re.match(r"(?:\s*(?:[#;].*)?\n)*\s*\[", text)
    c.read_string(text if head else "[default]\n" + text)
    return {s: dict(c[s]) for s in c.sections()}


def ini_dump(v: dict) -> str:
    out = [f"{k}={as_string(w)}" for k, w in v.items() if not isinstance(w, dict)]
    for s, t in v.items():
        if isinstance(t, dict):
            out += [f"[{s}]", *(f"{k}={'' if w is None else as_string(w)}" for k, w in t.items())]
    return "\n".join(out) + "\n"


def env_load(text: str) -> dict:
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            v = v.strip()
            out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


def env_dump(v: dict) -> str:
    quote = lambda s: '"' + s.replace('"', '\\"') + '"' if re.search(r"[\s\"']", s) else s
    return "\n".join(f"{k}={quote(as_string(w))}" for k, w in v.items()) + "\n"


def properties_load(text: str) -> dict:
    out, joined = {}, re.sub(r"\\\r?\n[ \t]*", "", text)
    for line in joined.splitlines():
        line = line.lstrip()
        if line and line[0] not in "#!":
            m = re.match(r"((?:\\.|[^=:\s\\])*)\s*[=:]?\s*(.*)", line)
            out[m[1]] = m[2]
    return out


def properties_dump(v: dict) -> str:
    return "\n".join(f"{k}={as_string(w)}" for k, w in v.items()) + "\n"


LOAD = {"yaml": yaml_load, "toml": tomllib.loads, "json": json.loads, "ini": ini_load, "env": env_load, "properties": properties_load}
DUMP = {"yaml": yaml_dump, "toml": toml_dump, "json": lambda v: dumps(v, 2), "ini": ini_dump, "env": env_dump, "properties": properties_dump}


def _reader(fmt):
    return lambda x, p: dumps(plain(LOAD[fmt](x[0].decode())), 2)


def _writer(fmt):
    return lambda x, p: DUMP[fmt](json.loads(x[0]))


for _fmt, _read, _write in (("yaml", ("yaml_parse", "yaml_to_json"), ("yaml_write", "json_to_yaml")), ("toml", ("toml_parse", "toml_to_json"), ("toml_write", "json_to_toml")),
                            ("ini", ("ini_parse",), ("ini_write",)), ("env", ("env_parse",), ("env_write",)), ("properties", ("properties_parse",), ("properties_write",))):
    python(*_read, returns="string")(_reader(_fmt))
    python(*_write, returns="string")(_writer(_fmt))


@python("yaml_validate")
def yaml_validate(x, p):
    yaml_load(x[0].decode())
    return x[0]


@python("yaml_merge", inputs=(1, None), returns="string")
def yaml_merge(x, p):
    """Later documents win; deep merging joins lists."""
    deep = p.choice("strategy", ("deep", "shallow"), "deep") == "deep"
    out = {}
    for v in x:
        out = merged(out, yaml_load(v.decode()) or {}, deep, lists=deep)
    return yaml_dump(out)


@python("plist_parse", returns="string")
def plist_parse(x, p):
    return dumps(plain(plistlib.loads(x[0])), 2)


@python("plist_write", returns="string")
def plist_write(x, p):
    return plistlib.dumps(json.loads(x[0])).decode()


@python("config_format_convert", returns="string")
def config_format_convert(x, p):
    return DUMP[p.choice("to", tuple(DUMP))](plain(LOAD[p.choice("from", tuple(LOAD))](x[0].decode())))


@python("hcl_parse", returns="string")
def hcl_parse(x, p):
    """Attributes, nested blocks (keyed by name and labels joined with dots), lists and objects; expressions stay text."""
    toks = re.findall(r'"(?:\\.|[^"\\])*"|<<-?\w+[\s\S]*?\n\s*\w+(?=\n|$)|[{}\[\]=,:]|\n|(?:#|//)[^\n]*|/\*[\s\S]*?\*/|[^\s{}\[\]=,:"]+', x[0].decode())
    toks = [t for t in toks if not t.startswith(("#", "//", "/*"))]
    at = 0

    def skip(marks="\n,"):
        nonlocal at
        while at < len(toks) and toks[at] in marks:
            at += 1

    def value():
        nonlocal at
        t = toks[at]
        at += 1
        if t == "[":
            out = []
            skip()
            while toks[at] != "]":
                out.append(value())
                skip()
            at += 1
            return out
        if t == "{":
            return body("}")
        if t.startswith('"'):
            return json.loads(t)
        words = [t]
        while at < len(toks) and toks[at] not in ("\n", ",", "]", "}"):
            words.append(toks[at])
            at += 1
        text = " ".join(words)
        try:
            return json.loads(text)
        except ValueError:
            return text

    def body(end):
        nonlocal at
        out = {}
        skip()
        while at < len(toks) and toks[at] != end:
            names = []
            while toks[at] not in ("=", ":", "{"):
                names.append(toks[at].strip('"'))
                at += 1
            mark = toks[at]
            at += 1
            out[".".join(names)] = body("}") if mark == "{" else value()
            skip()
        at += 1
        return out

    return dumps(body(None), 2)
