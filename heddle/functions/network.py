"""Network captures, zones, HAR files and mail."""

from __future__ import annotations

import base64
import json
import re
from email import message_from_bytes
from email.policy import default

from ..registry import python, unsupported
from .json_formats import dumps, ndjson_of

unsupported("pcap_read", "pcap_filter", "pcap_statistics", why="there is no packet decoder here")


@python("dns_record_parse", returns="string")
def dns_record_parse(x, p):
    out = []
    for line in x[0].decode().splitlines():
        f = line.split(";")[0].split()
        if len(f) >= 5 and not line.startswith("$"):
            out.append({"name": f[0], "ttl": int(f[1]) if f[1].isdigit() else f[1], "class": f[2], "type": f[3], "rdata": " ".join(f[4:])})
    return ndjson_of(out)


@python("har_parse", returns="string")
def har_parse(x, p):
    entries = json.loads(x[0])["log"]["entries"]
    if p.bool("summary"):
        return dumps({"total_requests": len(entries), "total_size": sum(max(0, e["response"].get("bodySize", 0)) for e in entries), "total_time": sum(e.get("time", 0) for e in entries)})
    return ndjson_of({"url": e["request"]["url"], "method": e["request"]["method"], "status": e["response"]["status"], "time": e.get("time", 0)} for e in entries)


@python("mbox_split", returns="string")
def mbox_split(x, p):
    """Sender line and size of each message."""
    parts = re.split(r"(?m)^(?=From )", x[0].decode(errors="replace"))
    return ndjson_of({"from": s.split("\n", 1)[0][5:].strip(), "size": len(s.encode())} for s in parts if s.startswith("From "))


@python("email_parse", returns="string")
def email_parse(x, p):
    m = message_from_bytes(x[0], policy=default)
    body = m.get_body(preferencelist=("plain", "html"))
    return dumps({"from": str(m["from"] or ""), "to": str(m["to"] or ""), "subject": str(m["subject"] or ""), "date": str(m["date"] or ""), "body": body.get_content() if body else ""})


@python("email_extract_attachments", returns="string")
def email_extract_attachments(x, p):
    m = message_from_bytes(x[0], policy=default)
    return dumps([{"filename": a.get_filename(), "content_type": a.get_content_type(), "content_b64": base64.b64encode(a.get_payload(decode=True) or b"").decode()} for a in m.iter_attachments()])
