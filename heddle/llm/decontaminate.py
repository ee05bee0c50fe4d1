"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents inside one task.  Its words are projected on the benchmark's vocabulary: words that no
test phrase has, and places where two neighbours are no neighbours in any phrase, cannot lie inside an occurrence and
become separators; stretches shorter than the shortest phrase go.  Over the rest the shard builds a suffix order, the
Burrows-Wheeler transform in a wavelet matrix, and positions sampled every 16 symbols.  All phrases are searched
backwards at once, occurrences located by walking to a sampled position, and merged into removal spans.
One pass over the documents, no shuffle; nothing is kept per corpus.

Phrases: 8 consecutive words of a test item (all of them, if fewer).  Words: see ``textkit`` rule ``alnum``.

Edge cases: null or empty texts have no words and no hits; items without words are ignored, items with a null id are searched and
hit words but are not named, items that repeat an id are one item; an empty benchmark hits nothing; rows repeating a doc_id
are handled row by row.
The phrases are broadcast in blocks of about BLOCK_BYTES of item text, of which the driver holds one at a time; more text means more
passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .common import read, stage, union_all

WINDOW = 8
SAMPLE = 16
BLOCK_BYTES = 4 << 20


class Phrases:
    """The distinct windows of some test items, as rows of words numbered from 1: arrays only, some 50 bytes a word."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        h, bounds = T.words(pa.array(texts, pa.string()), "alnum")
        self.vocab, sym = np.unique(h, return_inverse=True)
        sym = np.concatenate([sym.astype(np.int32) + 1, np.zeros(window, np.int32)])
        size = np.diff(bounds)
        count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - bounds[:-1], count)
        lens = np.minimum(size, window)[item]
        table = sym[start[:, None] + np.arange(window)]
        table[np.arange(window) >= lens[:, None]] = 0
        order = np.lexsort((item, *table.T[::-1]))
        table, item, lens = table[order], item[order], lens[order]
        first = np.ones(len(table), bool)
        first[1:] = (table[1:] != table[:-1]).any(1)
        self.table, self.lens = table[first], lens[first]
        self.item, self.cuts = item, np.append(np.flatnonzero(first), len(table))  # the items of each window
        self.ids = ids
        self.shortest = int(self.lens.min()) if len(self.lens) else 0
        pairs = self.table[:, :-1].astype(np.int64) * (len(self.vocab) + 1) + self.table[:, 1:]
        self.pairs = np.unique(pairs[self.table[:, 1:] > 0])

    def items(self, p: int) -> set[str]:
        """Ids of the items that have window p; items without an id are not named."""
        return {i for k in self.item[self.cuts[p] : self.cuts[p + 1]].tolist() if (i := self.ids[k]) is not None}

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The number of each word hash, 0 where no phrase has it."""
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class ShardIndex:
    """FM-index of a symbol sequence whose stretches each end with the separator 0."""

    def __init__(self, seq: np.ndarray):
        self.n = n = len(seq)
        order = self._suffixes(seq)
        bwt = seq[order - 1]  # the sequence is circular: before its first symbol stands its last separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 1))])
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.is_sampled, self.places = sampled, order[sampled]
        self.bwt, self.levels, self.zeros = bwt, [], []
        self.depth = max(1, int(seq.max()).bit_length())
        s = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (s >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix order by doubling; every separator counts as a symbol of its own, ordered by place."""
        n, gaps = len(seq), seq == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, seq + int(gaps.sum()))
        step = 1
        while True:
            tail = np.zeros(n, np.int64)
            tail[: max(n - step, 0)] = rank[step:] + 1
            key = rank * (int(rank.max()) + int(tail.max()) + 2) + np.where(gaps, 0, tail)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            step *= 2

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i of the transform."""
        lo = np.zeros_like(i)
        for level, (ones, zero) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (c >> (self.depth - 1 - level)) & 1
            lo = np.where(bit == 1, zero + ones[lo], lo - ones[lo])
            i = np.where(bit == 1, zero + ones[i], i - ones[i])
        return i - lo

    def search(self, table: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase its range of suffixes, found from its last word to its first."""
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        for step in range(int(lens.max())):
            live = np.flatnonzero((lens > step) & (lo < hi))
            c = table[live, lens[live] - 1 - step]
            known = c < len(self.first) - 1
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes: walk back to a sampled one and add the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.is_sampled[rows])
        while len(walk):
            c = self.bwt[rows[walk]]
            rows[walk] = self.first[c] + self.rank(c, rows[walk])
            steps[walk] += 1
            walk = walk[~self.is_sampled[rows[walk]]]
        return self.places[self.sampled[rows]] + steps


def occurrences(h: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word index, phrase number) of every occurrence in a shard; ``bounds``: words before each document."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not phrases.shortest or not len(h):
        return none
    sym = phrases.symbols(h)
    inside = sym > 0
    joined = np.zeros(len(h), bool)  # to the word before
    joined[1:] = inside[1:] & inside[:-1]
    joined[bounds[bounds < len(h)]] = False
    at = np.flatnonzero(joined)
    joined[at] = _among(sym[at - 1] * (len(phrases.vocab) + 1) + sym[at], phrases.pairs)
    starts = np.flatnonzero(inside & ~joined)
    stops = np.ones(len(h), bool)
    stops[:-1] = ~joined[1:]
    ends = np.flatnonzero(inside & stops) + 1
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    size = ends - starts + 1
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads - starts, size)
    seq = sym[np.minimum(place, len(h) - 1)]
    seq[heads + size - 1] = 0
    index = ShardIndex(seq)
    lo, hi = index.search(phrases.table, phrases.lens)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)
    return place[index.locate(rows)], which


ADDED = ("n_words", "n_hit", "items", "spans")
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _shard(col: pa.Array, phrases: Phrases) -> list[pa.Array]:
    h, b, starts, ends, _ = T.words(col, "alnum", places=True)
    place, which = occurrences(h, b, phrases)
    n = len(b) - 1
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + phrases.lens[which], -1)
    hit = np.cumsum(cover)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    doc = np.searchsorted(b, place, "right") - 1
    items: list[list[str]] = [[] for _ in range(n)]
    pairs = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else np.zeros((0, 2), int)
    names: dict[int, set] = {}
    for d, p in pairs.tolist():
        names.setdefault(d, set()).update(phrases.items(p))
    for d, found in names.items():
        items[d] = sorted(found)
    doc_of = np.repeat(np.arange(n), np.diff(b))
    opens = hit.copy()
    opens[1:] &= ~(hit[:-1] & (doc_of[1:] == doc_of[:-1]))
    shuts = hit.copy()
    shuts[:-1] &= ~(hit[1:] & (doc_of[1:] == doc_of[:-1]))
    first, last = np.flatnonzero(opens), np.flatnonzero(shuts)
    offsets, _ = T._buffers(col)
    base = offsets[doc_of[first]]
    spans = pa.StructArray.from_arrays([pa.array(starts[first] - base), pa.array(ends[last] - base)], fields=list(_SPAN))
    cuts = np.searchsorted(first, b)
    return [pa.array(np.diff(b)), pa.array(total[b[1:]] - total[b[:-1]]), pa.array(items, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)]


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator]:
    """(number of blocks, the test items as phrase tables of about BLOCK_BYTES of text each, made when asked for; one item may exceed it)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    parts = (rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect() for k in range(n))
    return n, (Phrases([r["id"] for r in part], [r["text"] for r in part]) for part in parts)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids, sorted as strings) and removal spans (UTF-8 byte offsets in the text)."""
    def scan(df: DataFrame, phrases) -> DataFrame:
        def run(batches):
            for batch in T.docs_in_batch(batches, "_text", T.SLICE):
                col = batch.column(batch.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_shard(col, phrases.value)], [*batch.schema.names[:-1], "n_words", "n_hit", "items", "spans"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(run, f"{fields}, {SCHEMA}")

    docs = docs.drop(*ADDED)
    sc = docs.sparkSession.sparkContext
    n, blocks = phrase_blocks(benchmark)
    if n == 1:
        return scan(docs, sc.broadcast(next(blocks)))
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    keyed = stage(keyed, "rows")
    hits = []
    for phrases in blocks:
        shared = sc.broadcast(phrases)
        hits.append(stage(scan(keyed.select("_row", text_col), shared).where("n_hit > 0").select("_row", "items", "spans"), "hits"))
        shared.destroy()
    found = union_all(hits)
    found = found.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> case when size(a) > 0 and s.start <= element_at(a, -1).end then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) else concat(a, array(s)) end)"
    found = found.withColumn("spans", F.expr(merged))
    words = scan(keyed, sc.broadcast(Phrases([], []))).drop("items", "spans", "n_hit")  # no phrases: counts words only
    both = words.join(found, "_row", "left")

    def count(batches):
        for batch in batches:
            texts, spans = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("_text", "spans"))
            n = [sum(len(w) for w in T.hash_words([(t or "").encode()[s["start"] : s["end"]].decode() for s in sp or []], "alnum")) for t, sp in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*[c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f not in ("_text", "_row", "spans", "items")], pa.array(n, pa.int64()), batch.column(batch.schema.get_field_index("items")), batch.column(batch.schema.get_field_index("spans"))], [*[f for f in batch.schema.names if f not in ("_text", "_row", "spans", "items")], "n_hit", "items", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields if f.name != "_row")
    empty = F.array().cast("array<string>")
    both = both.withColumn("items", F.coalesce("items", empty)).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).withColumn("_text", F.col(text_col).cast("string"))
    return both.mapInArrow(count, f"{fields}, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def cut_spans(text: str | None, spans: list) -> str | None:
    """The text without the spans; where a span goes, the text around it is joined by one space."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    out.append(raw[at:])
    return b" ".join(x.strip(b" ") for x in out).decode().strip(" ")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with test passages cut out of the texts; a document that has no word left goes."""
    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            texts = [cut_spans(t, s) for t, s in zip(batch.column(k).to_pylist(), spans, strict=True)] if any(spans) else batch.column(k)
            cols = [pa.array(texts, pa.string()) if any(spans) and i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).select(names)

    # Columns of docs may have the names of those that the search adds.
    names = [f"_kept_{c}" if c in ADDED else c for c in docs.columns]
    found = contamination(docs.toDF(*names), benchmark, text_col).where("n_hit = 0 or n_hit < n_words")
    return found.mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 8 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')) END) AS p FROM iw),
pats AS (SELECT DISTINCT p, len(string_split(p, ' ')) AS m FROM wins),
sizes AS (SELECT DISTINCT m FROM pats),
grams AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
occ AS (SELECT g.r, g.i, g.m, g.p FROM grams g JOIN pats USING (p)),
hits AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + m)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM occ JOIN wins USING (p) WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(len(l), 0) >= 2 AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
