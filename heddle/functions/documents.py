"""Office documents, HTML, Markdown, LaTeX and EPUB."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape, unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from ..layout import text
from ..registry import native, python, unsupported
from .json_formats import csv_of, dumps


def _zip(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _runs(xml: str, tag: str) -> str:
    return "".join(unescape(t) for t in re.findall(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.S))


def _tag(xml: str, name: str) -> str:
    m = re.search(rf"<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", xml, re.S)
    return unescape(m[1].strip()) if m else ""


@python("docx_extract_text", returns="string")
def docx_extract_text(x, p):
    with _zip(x[0]) as z:
        xml = z.read("word/document.xml").decode()
    return "\n".join(_runs(par, "w:t") for par in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))


@python("docx_metadata", returns="string")
def docx_metadata(x, p):
    with _zip(x[0]) as z:
        xml = z.read("docProps/core.xml").decode() if "docProps/core.xml" in z.namelist() else ""
    return dumps({k: _tag(xml, k) for k in ("title", "creator", "revision")})


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets, in order."""
    book = z.read("xl/workbook.xml").decode()
    names = [unescape(n) for n in re.findall(r'<sheet [^>]*?name="([^"]*)"', book)]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    return list(zip(names, files, strict=False))


@python("xlsx_sheet_list", returns="string")
def xlsx_sheet_list(x, p):
    with _zip(x[0]) as z:
        return dumps([n for n, _ in sheets(z)])


@python("xlsx_read", "xlsx_to_csv", returns="string")
def xlsx_to_csv(x, p):
    with _zip(x[0]) as z:
        found, want = sheets(z), p.text("sheet", "0")
        member = next((m for i, (n, m) in enumerate(found) if n == want or str(i) == want), None)
        if member is None:
            raise ValueError(f"no sheet {want}")
        shared = [_runs(s, "t") for s in re.findall(r"<si>.*?</si>", z.read("xl/sharedStrings.xml").decode(), re.S)] if "xl/sharedStrings.xml" in z.namelist() else []
        xml = z.read(member).decode()
    rows = []
    for row in re.findall(r"<row[^>]*?>.*?</row>", xml, re.S):
        cells = {}
        for attrs, body in re.findall(r"<c([^>]*?)>(.*?)</c>", row, re.S):
            ref = re.search(r'r="([A-Z]+)', attrs)
            col = 0
            for ch in ref[1] if ref else "":
                col = col * 26 + ord(ch) - 64
            v = _tag(body, "v")
            cells[col - 1 if ref else len(cells)] = shared[int(v)] if 't="s"' in attrs else _runs(body, "t") if 't="inlineStr"' in attrs else v
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    out = csv_of([dict(enumerate(r)) for r in rows], list(range(max(map(len, rows), default=0)))) if rows else ""
    return out.split("\n", 1)[1] if out else ""


def _slides(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))


@python("pptx_extract_text", returns="string")
def pptx_extract_text(x, p):
    with _zip(x[0]) as z:
        return "\n".join(" ".join(unescape(t) for t in re.findall(r"<a:t>(.*?)</a:t>", z.read(n).decode(), re.S)) for n in _slides(z))


@python("pptx_slide_count", returns="string")
def pptx_slide_count(x, p):
    with _zip(x[0]) as z:
        return dumps({"slides": len(_slides(z))})


@native("html_to_text")
def html_to_text(cols, p):
    """Text between tags, scripts and styles left out, white space collapsed."""
    c = F.regexp_replace(text(cols[0]), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def attribute_values(c, tag: str, attribute: str):
    """The values of an attribute in all tags of one name, as an array."""
    return F.regexp_extract_all(text(c), F.lit(rf"""(?i)<{tag}\s[^>]*?\b{attribute}\s*=\s*["']([^"']*)["']"""), F.lit(1))


@native("html_extract_links")
def html_extract_links(cols, p):
    return F.to_json(attribute_values(cols[0], "a", "href"))


@native("html_extract_images")
def html_extract_images(cols, p):
    return F.to_json(attribute_values(cols[0], "img", "src"))


@native("html_minify")
def html_minify(cols, p):
    """Runs of white space outside tags become one space."""
    return F.regexp_replace(text(cols[0]), r"\s+(?![^<]*+>)", " ")


class _Markdown(HTMLParser):
    MARK = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self):
        super().__init__()
        self.out, self.links = [], []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href", ""))
            self.out.append("[")
        else:
            self.out.append({"br": "\n", "li": "- ", "p": "\n"}.get(tag, self.MARK.get(tag, "")))

    def handle_endtag(self, tag):
        if tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        else:
            self.out.append("\n" if re.fullmatch("h[1-6]|p|li", tag) else self.MARK.get(tag, ""))

    def handle_data(self, data):
        self.out.append(data)


@python("html_to_markdown", returns="string")
def html_to_markdown(x, p):
    m = _Markdown()
    m.feed(x[0].decode())
    return re.sub(r"\n{3,}", "\n\n", "".join(m.out)).strip()


def _inline(s: str, strike: bool) -> str:
    s = escape(s, quote=False)
    s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
    s = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1" />', s)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)
    s = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", s)
    s = re.sub(r"(?<!\w)[*_](?!\s)(.+?)(?<!\s)[*_](?!\w)", r"<em>\1</em>", s)
    return re.sub(r"~~(.+?)~~", r"<del>\1</del>", s) if strike else s


@python("markdown_to_html", returns="string")
def markdown_to_html(x, p):
    """Headings, paragraphs, lists, quotes, code, rules, tables and inline marks."""
    ext = p.list("extensions", "all")
    tables, strike = (bool({"all", n} & set(ext)) for n in ("tables", "strikethrough"))
    rows, out, i = x[0].decode().splitlines(), [], 0
    while i < len(rows):
        line = rows[i]
        if not line.strip():
            i += 1
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2], strike)}</h{len(m[1])}>")
            i += 1
        elif line.startswith("```"):
            j = next((k for k in range(i + 1, len(rows)) if rows[k].startswith("```")), len(rows))
            out.append("<pre><code>" + escape("".join(r + "\n" for r in rows[i + 1 : j]), quote=False) + "</code></pre>")
            i = j + 1
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            out.append("<hr />")
            i += 1
        elif m := re.match(r"\s*([-*+]|\d+[.)])\s+", line):
            tag, items = "ol" if m[1][0].isdigit() else "ul", []
            while i < len(rows) and (m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", rows[i])):
                items.append(f"<li>{_inline(m[1], strike)}</li>")
                i += 1
            out.append(f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>")
        elif line.startswith(">"):
            j = i
            while j < len(rows) and rows[j].startswith(">"):
                j += 1
            out.append("<blockquote>\n<p>" + _inline("\n".join(r[1:].strip() for r in rows[i:j]), strike) + "</p>\n</blockquote>")
            i = j
        elif tables and "|" in line and i + 1 < len(rows) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", rows[i + 1]):
            cut = lambda r: [_inline(c.strip(), strike) for c in r.strip().strip("|").split("|")]
            j = i + 2
            while j < len(rows) and "|" in rows[j]:
                j += 1
            row = lambda r, t: "<tr>" + "".join(f"<{t}>{c}</{t}>" for c in cut(r)) + "</tr>"
            out.append("<table><thead>" + row(line, "th") + "</thead><tbody>" + "".join(row(r, "td") for r in rows[i + 2 : j]) + "</tbody></table>")
            i = j
        else:
            j = i
            while j < len(rows) and rows[j].strip() and not re.match(r"#{1,6}\s|```|>", rows[j]):
                j += 1
            out.append(f"<p>{_inline(chr(10).join(rows[i:j]), strike)}</p>")
            i = j
    return "\n".join(out) + "\n"


@python("latex_to_text", returns="string")
def latex_to_text(x, p):
    t = re.sub(r"(?<!\\)%.*", "", x[0].decode())
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}", "", t)
    t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", "", t)
    return re.sub(r"[ \t]+", " ", re.sub(r"[{}$]", "", t.replace("\\\\", "\n").replace("\\%", "%"))).strip()


def _strip_tags(t: str) -> str:
    return re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style|head)\b.*?</\1>", " ", t)))).strip()


@python("epub_extract_text", returns="string")
def epub_extract_text(x, p):
    with _zip(x[0]) as z:
        return "\n".join(_strip_tags(z.read(n).decode(errors="replace")) for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))


@python("epub_metadata", returns="string")
def epub_metadata(x, p):
    with _zip(x[0]) as z:
        opf = next((z.read(n).decode() for n in z.namelist() if n.endswith(".opf")), "")
        chapters = sum(n.lower().endswith((".xhtml", ".html", ".htm")) for n in z.namelist())
    return dumps({k: _tag(opf, k) for k in ("title", "creator", "language")} | {"chapters": chapters})
