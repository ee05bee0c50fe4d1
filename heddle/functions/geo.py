"""GeoJSON, WKT, KML, GPX, shapefiles and GeoTIFF headers."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from xml.etree import ElementTree

from ..registry import python, unsupported
from .json_formats import as_string, dumps


def features(v: dict) -> list[dict]:
    if v.get("type") == "FeatureCollection":
        return v["features"]
    return [v] if v.get("type") == "Feature" else [{"type": "Feature", "properties": {}, "geometry": v}]


def collection(items) -> str:
    return dumps({"type": "FeatureCollection", "features": list(items)})


def feature(kind: str, coords, **props) -> dict:
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}


def points(v):
    if v and isinstance(v[0], (int, float)):
        yield v
    else:
        for w in v:
            yield from points(w)


def _coords(g):
    if g is None:
        return
    for sub in g.get("geometries", [g]):
        yield from points(sub.get("coordinates") or [])


@python("geojson_validate")
def geojson_validate(x, p):
    kinds = ("FeatureCollection", "Feature", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
    if json.loads(x[0]).get("type") not in kinds:
        raise ValueError("no GeoJSON type")
    return x[0]


@python("geojson_filter", returns="string")
def geojson_filter(x, p):
    op, want = p.choice("op", ("eq", "ne", "gt", "lt", "contains")), p.text("value")

    def keep(f):
        v = (f.get("properties") or {}).get(p.text("property"))
        if v is None:
            return op == "ne"
        if op in ("gt", "lt"):
            return isinstance(v, (int, float)) and (v > float(want) if op == "gt" else v < float(want))
        return {"eq": as_string(v) == want, "ne": as_string(v) != want, "contains": want in as_string(v)}[op]

    return collection(f for f in features(json.loads(x[0])) if keep(f))


@python("geojson_bbox", returns="string")
def geojson_bbox(x, p):
    xy = [c for f in features(json.loads(x[0])) for c in _coords(f.get("geometry"))]
    if not xy:
        raise ValueError("no coordinates")
    return dumps([min(c[0] for c in xy), min(c[1] for c in xy), max(c[0] for c in xy), max(c[1] for c in xy)])


def simplified(line: list, tolerance: float) -> list:
    """Douglas-Peucker, with a stack instead of recursion."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = line[a][:2], line[b][:2]
        size = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        best, at = 0.0, None
        for i in range(a + 1, b):
            px, py = line[i][:2]
            d = abs((x2 - x1) * (y1 - py) - (x1 - px) * (y2 - y1)) / size if size else ((px - x1) ** 2 + (py - y1) ** 2) ** 0.5
            if d > best:
                best, at = d, i
        if at is not None and best > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[i] for i in sorted(keep)]


@python("geojson_simplify", returns="string")
def geojson_simplify(x, p):
    t = p.float("tolerance", 0.001)

    def thin(g):
        if g and g["type"] == "LineString":
            return g | {"coordinates": simplified(g["coordinates"], t)}
        if g and g["type"] in ("Polygon", "MultiLineString"):
            return g | {"coordinates": [simplified(r, t) for r in g["coordinates"]]}
        if g and g["type"] == "MultiPolygon":
            return g | {"coordinates": [[simplified(r, t) for r in poly] for poly in g["coordinates"]]}
        return g

    return collection(f | {"geometry": thin(f.get("geometry"))} for f in features(json.loads(x[0])))


def wkt(g: dict) -> str:
    def body(v):
        return " ".join(f"{n:g}" if isinstance(n, float) else str(n) for n in v) if v and isinstance(v[0], (int, float)) else ", ".join(body(w) if isinstance(w[0], (int, float)) else f"({body(w)})" for w in v)

    return f"{g['type'].upper()} ({body(g['coordinates'])})"


@python("geojson_to_wkt", returns="string")
def geojson_to_wkt(x, p):
    return "\n".join(wkt(f["geometry"]) for f in features(json.loads(x[0])) if f.get("geometry"))


def geometry(text: str) -> dict:
    names = {n.upper(): n for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(\(.*\))\s*", text)
    if not m or m[1].upper() not in names:
        raise ValueError(f"no WKT: {text[:40]}")
    s = re.sub(r"(-?[\d.]+(?:[eE][+-]?\d+)?)((?:\s+-?[\d.]+(?:[eE][+-]?\d+)?)+)", lambda n: "[" + ",".join([n[1], *n[2].split()]) + "]", m[2])
    v = json.loads(s.replace("(", "[").replace(")", "]"))
    return {"type": names[m[1].upper()], "coordinates": v[0] if m[1].upper() == "POINT" else v}


@python("wkt_to_geojson", returns="string")
def wkt_to_geojson(x, p):
    return collection({"type": "Feature", "properties": {}, "geometry": geometry(line)} for line in x[0].decode().splitlines() if line.strip())


@python("shapefile_to_geojson", returns="string")
def shapefile_to_geojson(x, p):
    """A ZIP with one .shp and, for properties, one .dbf."""
    with zipfile.ZipFile(io.BytesIO(x[0])) as z:
        get = lambda end: next((z.read(n) for n in z.namelist() if n.lower().endswith(end)), None)
        shp, dbf = get(".shp"), get(".dbf")
    if shp is None:
        raise ValueError("no .shp member")
    rows = list(_dbf(dbf)) if dbf else []
    out, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        rec, at = shp[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack_from("<i", rec)[0]
        g = None
        if kind in (1, 11, 21):
            g = {"type": "Point", "coordinates": list(struct.unpack_from("<2d", rec, 4))}
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, n = struct.unpack_from("<2i", rec, 36)
            starts = [*struct.unpack_from(f"<{parts}i", rec, 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", rec, 44 + 4 * parts)
            rings = [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            g = {"type": "Polygon", "coordinates": rings} if kind % 10 == 5 else {"type": "LineString", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiLineString", "coordinates": rings}
        elif kind in (8, 18, 28):
            n = struct.unpack_from("<i", rec, 36)[0]
            xy = struct.unpack_from(f"<{2 * n}d", rec, 40)
            g = {"type": "MultiPoint", "coordinates": [[xy[2 * i], xy[2 * i + 1]] for i in range(n)]}
        out.append({"type": "Feature", "properties": rows[len(out)] if len(out) < len(rows) else {}, "geometry": g})
    return collection(out)


def _dbf(d: bytes):
    n, head, size = struct.unpack_from("<IHH", d, 4)
    fields = [(d[o : o + 11].split(b"\0")[0].decode(), chr(d[o + 11]), d[o + 16]) for o in range(32, head - 1, 32)]
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, kind, width in fields:
            v = d[at : at + width].decode("latin-1").strip()
            at += width
            row[name] = (float(v) if "." in v else int(v)) if kind in "NF" and re.fullmatch(r"[+-]?[\d.]+", v) else v
        yield row


def _xml(x):
    root = ElementTree.fromstring(x)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


@python("kml_to_geojson", returns="string")
def kml_to_geojson(x, p):
    out = []
    for mark in _xml(x[0]).iter("Placemark"):
        for kind in ("Point", "LineString", "Polygon"):
            for g in mark.iter(kind):
                xy = [[float(n) for n in c.split(",")[:2]] for c in "".join(g.itertext()).split()]
                out.append(feature(kind, xy[0] if kind == "Point" else xy if kind == "LineString" else [xy], name=mark.findtext("name") or ""))
    return collection(out)


@python("gpx_to_geojson", returns="string")
def gpx_to_geojson(x, p):
    root = _xml(x[0])
    at = lambda e: [float(e.get("lon")), float(e.get("lat"))]
    out = [feature("Point", at(w), name=w.findtext("name") or "") for w in root.iter("wpt")]
    return collection(out + [feature("LineString", [at(q) for q in t.iter("trkpt")], name=t.findtext("name") or "") for t in root.iter("trk")])


@python("geotiff_metadata", returns="string")
def geotiff_metadata(x, p):
    """Size and bands from the first image directory."""
    d = x[0]
    end = {b"II": "<", b"MM": ">"}.get(d[:2])
    if end is None or struct.unpack_from(end + "H", d, 2)[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack_from(end + "I", d, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(end + "H", d, at)[0]):
        tag, kind, _ = struct.unpack_from(end + "HHI", d, at + 2 + 12 * i)
        tags[tag] = struct.unpack_from(end + ("H" if kind == 3 else "I"), d, at + 10 + 12 * i)[0]
    return dumps({"width": tags.get(256, 0), "height": tags.get(257, 0), "bands": tags.get(277, 1)})


unsupported("geotiff_crop", "geotiff_resample", why="there is no raster codec here")
unsupported("flatgeobuf_read", "flatgeobuf_write", why="there is no FlatGeobuf codec here")
