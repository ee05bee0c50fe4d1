"""Hidden Markov language model: Baum-Welch training over partitions, exact sequence likelihood by scaled forward passes.

Tokens are words (textkit rule ``space``) and one end token per text.  Word counts of all training texts come from one
map-side combined aggregation.  The FREQUENT most frequent words are symbols of their own; every other word belongs to one
of RARE symbols by its hash.  The end token is a symbol too.  Given its symbol a rare word has the probability
(c + 0.5) / (sum of c + 0.5 * (words of the symbol + 1)), so unseen words have a share and a text's probability is

    P(symbols of the text by the HMM) * product of P(word | rare symbol).

Frequent words are looked up in a broadcast table of fixed size; counts of the rest come by an equi-join on word hash.
Each EM iteration sums expected counts per task and merges them in a tree, MERGE of them in a task; counts are smoothed.

Edge cases: null and empty texts consist of the end token; a null doc_id is a training row and not held out; an empty
table gives no rows; without training tokens counts are 0 and every base probability is 1 (N = V = 0); rows repeating a
doc_id are scored row by row; texts of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .common import read, stage

STATES = 8
FREQUENT = 8192
RARE = 256
LOOKUP = 1 << 17  # words whose counts are broadcast
ITERATIONS = 3
MERGE = 16
CELLS = 1 << 19  # tokens times states held at once is CELLS * STATES
END = -1  # the "hash" of the end token; a word hash is the unsigned hash shifted to 63 bits, so never negative


def word_keys(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, b = T.words(col, "space")
    return (h >> np.uint64(1)).astype(np.int64), b


class Symbols:
    """Tables for mapping words to symbols: bounded by LOOKUP entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.lexsort((keys, -counts))
        top = keys[order][:FREQUENT]
        by_key = np.argsort(keys)
        self.keys, self.counts = keys[by_key], counts[by_key]
        place = np.full(len(keys), -1)
        place[order[: len(top)]] = np.arange(len(top))
        self.place = place[by_key]
        self.size = len(top) + RARE + 1
        self.end = self.size - 1
        self.first_rare = len(top)

    def map(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count or -1 where the table has none)."""
        rare = self.first_rare + keys % RARE
        if not len(self.keys):
            return rare.astype(np.uint16), np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        own = np.where(known, self.place[at], -1)
        return np.where(own >= 0, own, rare).astype(np.uint16), np.where(known, self.counts[at], -1)


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, unigram: np.ndarray, states: int = STATES) -> Hmm:
        """Unigram emissions, disturbed by fixed noise, and states that last, so that the states can part."""
        rng = np.random.Generator(np.random.PCG64(11))
        emit = (unigram + 0.5)[None, :] * (rng.exponential(1, (states, len(unigram))) + 1e-3)
        move = rng.uniform(0.5, 1.5, (states, states)) + 40 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, c: np.ndarray, states: int, symbols: int) -> Hmm:
        start, move, emit = np.split(c, [states, states + states * states])
        start, move, emit = start + 0.5, move.reshape(states, states) + 0.5, emit.reshape(states, symbols) + 1e-2
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _batches(seqs: list[np.ndarray]):
    """Texts of like length, padded: (their places, lengths, symbols by step)."""
    order = np.argsort([len(s) for s in seqs], kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(seqs[order[to]]) <= CELLS:
            to += 1
        part = order[at:to]
        lens = np.array([len(seqs[i]) for i in part])
        grid = np.zeros((lens.max(), len(part)), np.int64)
        for k, i in enumerate(part):
            grid[: lens[k], k] = seqs[i]
        yield part, lens, grid
        at = to


def forward(seqs: list[np.ndarray], m: Hmm) -> np.ndarray:
    """Natural log-likelihood of each symbol sequence."""
    out, by_symbol = np.zeros(len(seqs)), np.ascontiguousarray(m.emit.T)
    for part, lens, grid in _batches(seqs):
        total, alpha, was = np.zeros(len(part)), None, 0
        lows = np.searchsorted(lens, np.arange(len(grid)), "right")  # sorted by length: those still running are a suffix
        for t in range(len(grid)):
            lo = lows[t]
            seen = by_symbol.take(grid[t, lo:], 0)
            alpha = seen * m.start if alpha is None else (alpha[lo - was :] @ m.move) * seen
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[lo:] += np.log(scale)
            was = lo
        out[part] = total
    return out


def expected_counts(seqs: list[np.ndarray], m: Hmm) -> np.ndarray:
    """Baum-Welch counts of starts, moves and emissions, in one vector.

    Scaled passes, so that alpha * beta is the posterior at every step.
    """
    k, v = m.emit.shape
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, v))
    # Single precision will do for posteriors, which are scaled at every step; sums are double.
    by_symbol, ahead, back = (np.ascontiguousarray(x, np.float32) for x in (m.emit.T, m.move, m.move.T))
    begin, ones = m.start.astype(np.float32), np.ones(k, np.float32)
    for part, lens, grid in _batches(seqs):
        steps, n = grid.shape
        alpha = np.zeros((steps, n, k), np.float32)
        scaled = np.zeros((steps, n, k), np.float32)  # emissions over scales
        lows = np.searchsorted(lens, np.arange(steps), "right")
        for t in range(steps):
            lo = lows[t]
            seen = by_symbol.take(grid[t, lo:], 0)
            a = seen * begin if t == 0 else (alpha[t - 1, lo:] @ ahead) * seen
            scale = (a @ ones)[:, None]
            np.divide(a, scale, out=alpha[t, lo:])
            np.divide(seen, scale, out=scaled[t, lo:])
        beta = np.ones((n, k), np.float32)
        for t in range(steps - 1, 0, -1):
            lo = lows[t]
            after = scaled[t, lo:] * beta[lo:]
            alpha[t, lo:] *= beta[lo:]
            move += alpha[t - 1, lo:].T @ after
            np.matmul(after, back, out=beta[lo:])
        alpha[0] *= beta
        start += alpha[0].sum(0, dtype=np.float64)
        live = np.flatnonzero((np.arange(steps)[:, None] < lens[None, :]).ravel())
        symbols, post = grid.ravel()[live], alpha.reshape(-1, k)[live]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        heads = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        emit[:, symbols[heads]] += np.add.reduceat(post[order], heads, axis=0, dtype=np.float64).T
    return np.concatenate([start, (move * m.move).ravel(), emit.ravel()])


def word_counts(docs: DataFrame, usable: Column, text_col: str = "text") -> DataFrame:
    """(key, c) over the words and end tokens of all usable texts; summed per slice before the shuffle."""
    def run(batches):
        for batch in T.docs_in_batch(batches, "_text"):
            keys, _ = word_keys(batch.column(0))
            u, c = np.unique(np.concatenate([keys, np.full(batch.num_rows, END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], ["key", "c"])

    texts = docs.where(usable).select(F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def train(encoded: DataFrame, symbols: int, unigram: np.ndarray, iterations: int = ITERATIONS, states: int = STATES) -> Hmm:
    """EM over all rows of ``encoded`` (seq: symbols as 16-bit numbers); each iteration is one distributed pass."""
    sc = encoded.sparkSession.sparkContext
    model = Hmm.begin(unigram, states)
    for _ in range(iterations):
        shared = sc.broadcast(model)

        def count(batches, shared=shared):
            total = None
            for batch in batches:
                seqs = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
                if seqs:
                    c = expected_counts(seqs, shared.value)
                    total = c if total is None else total + c
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["c"])

        def merge(batches):
            total = None
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["c"])

        sums = encoded.select("seq").mapInArrow(count, "c binary")
        width = sums._jdf.queryExecution().toRdd().getNumPartitions()
        while width > MERGE:
            width = -(-width // MERGE)
            sums = sums.repartition(width).mapInArrow(merge, "c binary")
        parts = sums.collect()
        if parts:
            model = Hmm.from_counts(np.sum([np.frombuffer(r["c"]) for r in parts], axis=0), states, symbols)
        shared.unpersist()
    return model


def score(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 of the base and HMM probabilities."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    counts = stage(word_counts(docs, usable, text_col), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    ends = counts.where(F.col("key") == END).first()
    ends = int(ends["c"]) if ends else 0
    top = counts.where(F.col("key") != END).orderBy(F.desc("c"), "key").limit(LOOKUP).collect()
    table = Symbols(np.array([r["key"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64))
    bucket = counts.where(F.col("key") != END).groupBy((F.col("key") % RARE).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(RARE), np.zeros(RARE)
    for r in bucket:
        mass[r["b"]], kinds[r["b"]] = r["c"], r["v"]
    own = table.place >= 0
    np.subtract.at(mass, table.keys[own] % RARE, table.counts[own])
    np.subtract.at(kinds, table.keys[own] % RARE, 1)
    unigram = np.zeros(table.size)
    unigram[table.place[own]] = table.counts[own]
    unigram[table.first_rare : -1] = mass
    unigram[-1] = ends
    rare_log = np.log10(mass + 0.5 * (kinds + 1))
    base_log = np.log10(n + 0.5 * (v + 1))
    shared = sc.broadcast((table, rare_log, base_log, ends))

    def encode(batches):
        table, rare_log, base_log, ends = shared.value
        for batch in T.docs_in_batch(batches, "_text"):
            keys, b = word_keys(batch.column(2))
            sym, c = table.map(keys)
            rare = sym >= table.first_rare
            seen = np.maximum(c, 0)
            # Misses of the table count as unseen here; the join adds what their counts change.
            doc = np.repeat(np.arange(batch.num_rows), np.diff(b))
            per_doc = lambda x: np.bincount(doc, x, batch.num_rows)
            base = per_doc(np.log10(seen + 0.5) - base_log)
            inside = per_doc(np.where(rare, np.log10(seen + 0.5) - rare_log[keys % RARE], 0.0))
            known = per_doc(c > 0).astype(np.int64)
            missed = np.flatnonzero(c < 0)
            cuts = np.searchsorted(missed, b)
            with_end = np.insert(sym, b[1:], table.end)
            spots = b + np.arange(len(b))
            tail = np.log10(ends + 0.5) - base_log
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(b) + 1), pa.array(known + (1 if ends else 0)),
                pa.array(base + tail), pa.array(inside),
                pa.array([with_end[lo:hi].astype("<u2").tobytes() for lo, hi in zip(spots[:-1], spots[1:], strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys[missed]))],
                ["id", "held_out", "n_tokens", "n_known", "base", "inside", "seq", "missed"])

    rows = docs.select(F.col(id_col).alias("id"), (~usable).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, inside double, seq binary, missed array<long>")
    encoded = stage(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = sc.broadcast(train(encoded.where(~F.col("held_out")), table.size, unigram))

    def likelihood(batches):
        for batch in batches:
            seqs = [np.frombuffer(x, "<u2") for x in batch.column(batch.num_columns - 1).to_pylist()]
            if seqs:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forward(seqs, model.value) / np.log(10))], [*batch.schema.names[:-1], "hmm"])

    # A missed word that has a count was taken as unseen: log10(c + 0.5) replaces log10(0.5), in both scores.
    beyond = counts if len(top) == LOOKUP else counts.limit(0)
    missed = encoded.select("row", F.explode("missed").alias("key")).groupBy("row", "key").count()
    fix = (
        missed.join(beyond.select("key", "c"), "key")
        .groupBy("row").agg(F.sum(F.col("count") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("fix"), F.sum("count").alias("more"))
    )
    scored = encoded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "inside", "seq").mapInArrow(
        likelihood, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, inside double, hmm double")
    fix_of = F.coalesce("fix", F.lit(0.0))
    return scored.join(fix, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + fix_of).alias("base_score"), (F.col("hmm") + F.col("inside") + fix_of).alias("score"))


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), ~held_out())
