"""Mixing sources to target weights with soft membership.

A naive Bayes classifier, fitted on rows of the labelled table, gives every document posteriors over domains.  Rates
r >= 0 are then fitted per document so that the expected tokens of each domain, sum of r_i * t_i * p_i, match the targets:
projected gradient on the least squares of the domain totals, each weighed by 1 / sum of t_i * p_id^2.

The state of an iteration is a vector of one number per domain.  A document's rate is the projection folded over the
vectors so far, so each pass over the staged (tokens, posteriors) recomputes it and returns one partial sum per task;
nothing per document is kept between iterations, and lost tasks are simply run again.

The classifier is fitted on at most MAX_LABELLED labelled rows, those with the smallest hash of their id, and at most
MAX_FEATURES words; posteriors, tokens and totals cover every whole text.  Evidence counts as that of at most EVIDENCE
words, which keeps posteriors of long texts soft.

Edge cases: null and empty texts have 0 tokens, the prior as posterior, and the start rate 1; domains without labelled
rows do not exist; targets for unknown domains are ignored, the others scaled to sum 1; without labelled rows or tokens
all rates are 1; rows repeating an id are separate; extra columns pass through.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .common import read, stage, unstage

MAX_LABELLED = 8000
MAX_FEATURES = 16384
EVIDENCE = 32
ITERATIONS = 60
TOLERANCE = 1e-6
MISS = 1e-3
log = logging.getLogger(__name__)


class Classifier:
    """Log-likelihoods of words by domain."""

    def __init__(self, domains: list[str], prior: np.ndarray, keys: np.ndarray, table: np.ndarray):
        self.domains, self.prior, self.keys, self.table = domains, prior, keys, table

    @classmethod
    def fit(cls, texts: list[np.ndarray], marks: list[str]) -> Classifier:
        domains = sorted(set(marks))
        if not domains:
            return cls(["all"], np.zeros(1), np.zeros(0, np.uint64), np.zeros((0, 1)))
        number = np.array([domains.index(m) for m in marks])
        flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
        domain = np.repeat(number, [len(x) for x in texts])
        keys, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        top = np.sort(np.argsort(-n, kind="stable")[:MAX_FEATURES])
        counts = np.stack([np.bincount(at[domain == d], minlength=len(keys))[top] for d in range(len(domains))], 1) + 0.5
        prior = np.bincount(number, minlength=len(domains)) + 0.5
        return cls(domains, np.log(prior / prior.sum()), keys[top], np.log(counts / counts.sum(0)))

    def posteriors(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of each text."""
        h, b = T.words(col, "space")
        n = len(b) - 1
        score = np.zeros((n, len(self.domains)))
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            here = np.flatnonzero(self.keys[at] == h)
            doc = np.repeat(np.arange(n), np.diff(b))[here]
            known = np.bincount(doc, minlength=n)
            for d in range(len(self.domains)):
                score[:, d] = np.bincount(doc, self.table[at[here], d], n)
            score *= np.minimum(1, EVIDENCE / np.maximum(known, 1))[:, None]
        score += self.prior
        p = np.exp(score - score.max(1, keepdims=True))
        return np.diff(b), p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on documents that the labelled table covers; the sample's size is bounded."""
    ids = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    ids = ids.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(6)), "_id").limit(MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_mark"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.where("_mark is not null and _text is not null").join(F.broadcast(ids), "_id")
    rows = rows.groupBy("_id").agg(F.min(F.struct("_mark", "_text")).alias("r")).select("r._mark", "r._text")  # an id that documents repeat counts once

    def run(batches):
        for batch in T.docs_in_batch(batches, "_text", T.SLICE):
            h, b = T.words(batch.column(1), "space")
            # Words of a text beyond the evidence that counts would only weigh long texts more: distinct words once.
            sets = [np.unique(h[b[i] : b[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["mark", "words"])

    got = sorted((r["mark"], r["words"]) for r in rows.mapInArrow(run, "mark string, words binary").collect())
    return Classifier.fit([np.frombuffer(w, np.uint64) for _, w in got], [m for m, _ in got])


def fold(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the gradient steps so far, from rate 1."""
    r = np.ones(len(p))
    for y in history:
        r = np.maximum(0, r - p @ y)
    return r


def fit_rates(members: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradient steps, last totals) for rows (tokens long, p array<double>)."""
    size = len(targets)

    def moments(batches):
        total, gram = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            t, p = _members(batch, size)
            total += t @ p
            gram += (p * t[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, gram.ravel()]).tolist()], pa.list_(pa.float64()))], ["x"])

    def summed(df: DataFrame, width: int) -> np.ndarray:
        r = df.agg(*(F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(width))).first()
        return np.array([r[i] or 0.0 for i in range(width)])

    first = summed(members.mapInArrow(moments, "x array<double>"), size + size * size)
    s, gram = first[:size], first[size:].reshape(size, size)
    want, weigh = targets * s.sum(), np.diag(gram).copy()
    live = weigh > 0
    if not live.any():
        return [], s
    weigh[~live] = np.inf
    root = 1 / np.sqrt(weigh)
    step = 1 / max(np.linalg.eigvalsh(gram * root[:, None] * root[None, :]).max(), 1e-12)
    history: list[np.ndarray] = []
    for _ in range(ITERATIONS):
        if np.abs(s - want)[live].max() <= TOLERANCE * want.sum():
            break
        history.append(step * (s - want) / weigh)
        steps = list(history)

        def totals(batches, steps=steps):
            out = np.zeros(size)
            for batch in batches:
                t, p = _members(batch, size)
                out += (t * fold(p, steps)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["x"])

        s = summed(members.mapInArrow(totals, "x array<double>"), size)
    return history, s


def _members(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column(1)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(float), p.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, posteriors (map from domain) and rate; targets: weights by domain, equal by default.

    The shares of tokens reached are the frame's attribute ``shares`` (domain to share and target); where one misses its target by
    more than MISS, as when a domain has no tokens, a warning says so.
    """
    sc = docs.sparkSession.sparkContext
    model = train(docs, labels, domain_col, id_col, text_col)
    weights = np.array([max(0.0, (targets or {}).get(d, 0.0 if targets else 1.0)) for d in model.domains])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))
    shared = sc.broadcast(model)

    def classify(batches):
        for batch in T.docs_in_batch(batches, "_text", T.SLICE):
            t, p = shared.value.posteriors(batch.column(0))
            keep = t > 0
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), _lists(p[keep])], ["tokens", "p"])

    members = stage(docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(classify, "tokens long, p array<double>"), "members")
    history, totals = fit_rates(members, weights)
    unstage(members)
    reached = totals / totals.sum() if totals.sum() > 0 else weights
    shares = {d: (float(x), float(w)) for d, x, w in zip(model.domains, reached, weights, strict=True)}
    if any(abs(x - w) > MISS for x, w in shares.values()):
        log.warning("targets missed; shares reached and wanted: %s", shares)

    def rate(batches):
        for batch in T.docs_in_batch(batches, "_text", T.SLICE):
            t, p = shared.value.posteriors(batch.column(batch.num_columns - 1))
            r = np.where(t > 0, fold(p, history), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(t), _lists(p), pa.array(r)], [*batch.schema.names[:-1], "n_words", "posteriors", "rate"])

    docs = docs.drop("n_words", "posteriors", "rate")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(rate, f"{fields}, n_words long, posteriors array<double>, rate double")
    names = F.array(*(F.lit(d) for d in model.domains))
    out = out.withColumn("posteriors", F.map_from_arrays(names, "posteriors"))
    out.shares = shares  # type: ignore[attr-defined]
    return out


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return mix(docs, read(spark, sf_dir, "labels")).select("doc_id", "n_words", "posteriors", "rate")
