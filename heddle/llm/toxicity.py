"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U: any documents, whose labels, if they have some, are not looked at) train a
sparse linear classifier in numpy.  The risk is corrected by the class prior pi:

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

with logistic loss, so the score is an estimate of the posterior.  When the bracket turns negative, the step is taken
against its gradient, as usual for the non-negative estimator.  An L1 proximal step keeps the weights sparse.

The classifier is fitted on at most MAX_POSITIVE toxic and MAX_UNLABELLED other ids, those with the smallest hash of the id;
an id that documents repeat counts once, with its smallest text; pi is the share of toxic rows among the labelled rows that may be
learned from.  Scoring covers every whole text.

Edge cases: null and empty texts score as a text without features; rows with a null doc_id are scored and not held out;
several labels of one id count as toxic if one is; without positives every score is 0; labels, lang, source and ids are
never features; rows repeating an id are scored row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .common import read

MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
MAX_FEATURES = 4096
L1 = 2e-4
STEPS = 300


class Model:
    """Weights of word hashes; a text's score is the logistic of the bias and the weights of its distinct words."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def scores(self, col: pa.Array) -> np.ndarray:
        h, b = T.words(col, "alnum")
        out = np.full(len(b) - 1, self.bias)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            here = np.flatnonzero(self.keys[at] == h)
            doc = np.searchsorted(b, here, "right") - 1
            pairs = np.unique(doc * len(self.keys) + at[here])
            out += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(out))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def distinct_words(col: pa.Array) -> list[np.ndarray]:
    h, b = T.words(col, "alnum")
    return [np.unique(h[b[i] : b[i + 1]]) for i in range(len(b) - 1)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, l1: float = L1, steps: int = STEPS) -> Model:
    """Sets of word hashes of P and U to a model.  Full-batch gradient steps with momentum; results do not vary."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    np_, nu = len(positive), len(unlabelled)
    p_words, p_count = np.unique(np.concatenate(positive), return_counts=True)
    u_words, u_count = np.unique(np.concatenate(unlabelled), return_counts=True)
    keys = np.union1d(p_words, u_words)
    in_p, in_u = np.zeros(len(keys)), np.zeros(len(keys))
    in_p[np.searchsorted(keys, p_words)] = p_count / np_
    in_u[np.searchsorted(keys, u_words)] = u_count / nu
    # Features: the words whose share differs most between P and U, in standard errors.
    mean = (in_p * np_ + in_u * nu) / (np_ + nu)
    z = np.abs(in_p - in_u) / np.sqrt(mean * (1 - mean) * (1 / np_ + 1 / nu) + 1e-12)
    z[(in_p * np_ + in_u * nu) < 3] = 0
    keep = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])
    keys = keys[keep[z[keep] > 2]]
    rows, cols = [], []
    for i, x in enumerate((*positive, *unlabelled)):
        at = np.searchsorted(keys, x)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == x)] if len(keys) else at[:0]
        rows.append(np.full(len(at), i, np.int32))
        cols.append(at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    is_p = np.arange(np_ + nu) < np_
    w, bias = np.zeros(len(keys)), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    v, vb, seen, seen_b = np.zeros(len(keys)), 0.0, np.zeros(len(keys)), 0.0
    rate = 0.05
    for step in range(1, steps + 1):
        score = bias + np.bincount(row, w[col], np_ + nu)
        sig = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        neg = np.logaddexp(0, score)  # loss of calling a text toxic when it is not
        gap = neg[~is_p].mean() - prior * neg[is_p].mean()
        up = np.where(is_p, -prior * (1 - sig) / np_, 0.0)  # gradient of pi E_P[loss(+)]
        down = np.where(is_p, -prior * sig / np_, sig / nu)  # gradient of the bracket
        g = up + down if gap >= 0 else -down
        gw, gb = np.bincount(col, g[row], len(keys)), g.sum()
        v, vb = 0.9 * v + 0.1 * gw, 0.9 * vb + 0.1 * gb
        seen, seen_b = 0.99 * seen + 0.01 * gw**2, 0.99 * seen_b + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        scale = rate / (np.sqrt(seen / fix2) + 1e-5)
        w = w - scale * v / fix1
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        bias -= rate * (vb / fix1) / (np.sqrt(seen_b / fix2) + 1e-5)
        if step % 100 == 0:
            rate /= 2
    used = w != 0
    return Model(keys[used], w[used], bias)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on rows that ``usable`` (over the id) allows; the sample is bounded, its features go to the driver."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    count = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    if not count["p"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    order = F.xxhash64(F.col("_id").cast("string"), F.lit(3))
    pos = marks.where("_y = 1").orderBy(order, "_id").limit(MAX_POSITIVE).select("_id", F.lit(1).alias("_p"))
    any_ = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & usable).select(F.col(id_col).alias("_id")).distinct()
    unl = any_.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(4)), "_id").limit(MAX_UNLABELLED).select("_id", F.lit(0).alias("_p"))
    sample = pos.union(unl)

    def run(batches):
        for batch in T.docs_in_batch(batches, "_text", T.SLICE):
            sets = distinct_words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["_p", "words"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    # At most MAX_POSITIVE + MAX_UNLABELLED ids: a bounded broadcast.
    found = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_p").agg(F.min("_text").alias("_text"))
    rows = found.select("_p", "_text").mapInArrow(run, "_p int, words binary").toArrow()
    sets = [[np.frombuffer(w, np.uint64) for w in sorted(rows.filter(pc.equal(rows["_p"], p))["words"].to_pylist())] for p in (1, 0)]
    model = fit(sets[0], sets[1], count["p"] / count["n"])
    del rows, sets
    T.give_back()  # the sample's sets would stay with the driver through all later stages
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of scores, in one pass without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in T.docs_in_batch(batches, "_text", T.SLICE):
            s = shared.value.scores(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], out])

    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(run, f"{fields}, {out} double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
