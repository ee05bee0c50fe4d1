"""Sequence formats."""

from __future__ import annotations

from ..registry import python, unsupported
from .json_formats import ndjson_of


def fasta(text: str):
    name, seq = None, []
    for line in text.splitlines():
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(seq)
            name, seq = line[1:].split(maxsplit=1)[0] if line[1:].split() else "", []
        elif name is not None:
            seq.append(line.strip())
    if name is not None:
        yield name, "".join(seq)


def fastq(text: str):
    rows = [line for line in text.splitlines() if line]
    for i in range(0, len(rows) - 3, 4):
        if not rows[i].startswith("@") or not rows[i + 2].startswith("+") or len(rows[i + 1]) != len(rows[i + 3]):
            raise ValueError(f"bad record at line {i + 1}")
        yield rows[i][1:], rows[i + 1], rows[i + 3]


def _fastq(records) -> str:
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)


def _table(text: str, mark: str, least: int):
    return (f for line in text.splitlines() if line and not line.startswith(mark) and len(f := line.split("\t")) >= least)


@python("fasta_parse", returns="string")
def fasta_parse(x, p):
    return ndjson_of({"id": n, "sequence": s, "length": len(s)} for n, s in fasta(x[0].decode()))


@python("fastq_parse", returns="string")
def fastq_parse(x, p):
    return ndjson_of({"id": n, "sequence": s, "quality": q, "length": len(s)} for n, s, q in fastq(x[0].decode()))


@python("fastq_trim_quality", returns="string")
def fastq_trim_quality(x, p):
    """Bases of low quality go from the end; empty reads go."""
    low, out = p.int("min_quality", 20), []
    for n, s, q in fastq(x[0].decode()):
        k = len(q)
        while k and ord(q[k - 1]) - 33 < low:
            k -= 1
        out += [(n, s[:k], q[:k])] if k else []
    return _fastq(out)


@python("fastq_filter", returns="string")
def fastq_filter(x, p):
    return _fastq(r for r in fastq(x[0].decode()) if len(r[1]) >= p.int("min_length", 0))


@python("sam_parse", returns="string")
def sam_parse(x, p):
    return ndjson_of({"qname": f[0], "flag": int(f[1]), "rname": f[2], "pos": int(f[3]), "mapq": int(f[4]), "cigar": f[5], "seq": f[9], "qual": f[10]} for f in _table(x[0].decode(), "@", 11))


@python("vcf_parse", returns="string")
def vcf_parse(x, p):
    return ndjson_of({"chrom": f[0], "pos": int(f[1]), "id": f[2], "ref": f[3], "alt": f[4].split(","), "qual": None if f[5] == "." else float(f[5]), "filter": f[6], "info": f[7]} for f in _table(x[0].decode(), "#", 8))


@python("vcf_filter", returns="string")
def vcf_filter(x, p):
    return "".join(line + "\n" for line in x[0].decode().splitlines() if line.startswith("#") or line.split("\t")[0] == p.text("chrom"))


@python("bed_parse", returns="string")
def bed_parse(x, p):
    return ndjson_of({"chrom": f[0], "start": int(f[1]), "end": int(f[2]), "name": f[3] if len(f) > 3 else ".", "score": f[4] if len(f) > 4 else "0", "strand": f[5] if len(f) > 5 else "."} for f in _table(x[0].decode(), "#", 3) if not f[0].startswith(("track", "browser")))


@python("gff_parse", returns="string")
def gff_parse(x, p):
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
    return ndjson_of(dict(zip(names, f, strict=False)) | {"start": int(f[3]), "end": int(f[4])} for f in _table(x[0].decode(), "#", 9))


@python("fasta_to_fastq", returns="string")
def fasta_to_fastq(x, p):
    return _fastq((n, s, p.text("default_quality", "I") * len(s)) for n, s in fasta(x[0].decode()))


unsupported("bam_read", "bam_to_sam", why="there is no BAM decoder here")
