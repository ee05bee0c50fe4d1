"""Token counts by a map-side two-tier lookup of pre-token lengths.

A byte-level BPE tokenizer encodes every pre-token on its own, so a text's count is the sum of its pre-tokens' lengths.
Tier 1 is a broadcast table of the frequent pre-tokens, bounded by the vocabulary: the vocabulary entries that are whole
pre-tokens, which is what training on frequent pre-tokens leaves.  Tier 2 is a cache in each worker process, filled by encoding
the pre-tokens of a slice that neither tier has; it outlives the task, as does the parsed tokenizer, and over CACHE_LIMIT
entries it starts anew.  Nothing is shuffled.

Strings of special tokens inside a text are split off first and count one each, as the library does by default.
Texts with characters outside SAFE are cut into pre-tokens by the library, as Unicode versions of regex engines differ.
Tokenizers that are not plain byte-level BPE are applied to whole texts.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a text of any length is read in bounded runs of pre-tokens;
an empty table gives no rows; repeated rows are counted row by row.
"""

from __future__ import annotations

import json
import os
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .common import read

CACHE_LIMIT = 400_000
RUN = 200_000
# The pre-token pattern of byte-level BPE, and characters on which regex engines agree.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = r"[\t\n\r\x20-\x7e¡-¬®-ſ]*"


def _simple(spec: dict) -> bool:
    """Plain byte-level BPE, whose added tokens are cut out of the raw text as they stand."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", []))
    return bool(plain) and not odd and spec.get("normalizer") is None and len(spec.get("added_tokens", [])) <= 1


class Counter:
    """Counts tokens in a worker; made there from the tokenizer's JSON and the table of tier 1."""

    def __init__(self, text: str, table: dict[str, int] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(text)
        self.simple = _simple(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.find, self.safe = regex.compile(PRE_TOKEN), regex.compile(SAFE)
        self.table = table or {}
        self.known = dict(self.table)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def pre_tokens(self, text: str) -> list[str]:
        if self.safe.fullmatch(text):
            return self.find.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, seen: set[str]) -> None:
        new = list(seen.difference(self.known))
        if len(self.known) + len(new) > CACHE_LIMIT:
            self.known = dict(self.table)
            new = list(seen.difference(self.known))
        self.known.update(zip(new, self.lengths(new), strict=True))

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        for s in self.special:
            total += text.count(s)
            parts = text.split(s)
        for part in parts:
            if len(part) > 4 * RUN and self.safe.fullmatch(part):
                found = self.find.finditer(part)
                while run := [m[0] for m in islice(found, RUN)]:
                    self.learn(set(run))
                    total += sum(map(self.known.__getitem__, run))
            elif part:
                run = self.pre_tokens(part)
                self.learn(set(run))
                total += sum(map(self.known.__getitem__, run))
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.simple:
            return [len(self.tok.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
        out: list[int] = []
        short, places = [], []
        for i, t in enumerate(texts):
            out.append(0)
            if t and (len(t) > RUN or any(s in t for s in self.special)):
                out[i] = self.count(t)
            elif t:
                short.append(self.pre_tokens(t))
                places.append(i)
        self.learn(set().union(*short))
        get = self.known.__getitem__
        for i, run in zip(places, short, strict=True):
            out[i] = sum(map(get, run))
        return out


_kept: dict[int, Counter] = {}


def worker_counter(text: str, table: dict[str, int]) -> Counter:
    """The worker process's counter for a tokenizer: made by its first task, kept for the next ones."""
    key = hash(text)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Counter(text, table)
    return _kept[key]


def frequent_lengths(text: str) -> dict[str, int]:
    """Tier 1: the vocabulary's entries that are one pre-token, with their lengths in tokens."""
    counter = Counter(text, None)
    if not counter.simple:
        return {}
    back = {c: b for b, c in _byte_chars().items()}
    words = []
    for entry in counter.tok.get_vocab(with_added_tokens=False):
        try:
            word = bytes(back[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word not in counter.special and counter.safe.fullmatch(word) and counter.find.findall(word) == [word]:
            words.append(word)
    return dict(zip(words, counter.lengths(words), strict=True))


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next character from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text."""
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    sc = docs.sparkSession.sparkContext
    if tokenizer_path.endswith(".model"):
        model = sc.broadcast(raw)

        def run(batches):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
            for batch in batches:
                n = [len(sp.encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], out])
    else:
        spec = raw.decode()
        shared = sc.broadcast((spec, frequent_lengths(spec)))

        def run(batches):
            counter = worker_counter(*shared.value)
            for batch in T.docs_in_batch(batches, "_text", 1 << 20):
                n = counter.counts(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], out])

    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(run, f"{fields}, {out} long")


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"))
    # The text itself need not come back from Python.
    counted = count_tokens(docs.select("doc_id", "n_bytes", "text"), tokenizer_path).select("doc_id", "n_bytes", "n_tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
