"""Nearest neighbours by a block matrix join.

Queries are dealt to rows, candidates to columns of a grid by a hash of their place in the input; each tile multiplies a block of at most
about QUERY_BLOCK queries with one of about CANDIDATE_BLOCK candidates.  Unit vectors are quantised to int8; the integer
products (exact in float arithmetic) give each cosine with an error bound from the lengths of the quantisation errors.
Tiles get codes only.  Pairs whose upper bound reaches the k-th largest lower bound, first of their tile, then of all tiles, survive,
are joined to the original vectors and recomputed in double precision; heaps merge them.  The bounds hold, so the
result is exact (recall 1).

Edge cases: vectors null, empty, zero, or holding null or non-finite components take no part, nor do null ids.  Vectors
of another length than the query's are no candidates.  Rows that repeat a vec_id are each a candidate (and a query, their
results ranked together); no row is a candidate of a query of its own id.  Ties go to the smaller vec_id.  No queries or candidates: no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, read, stage, unstage

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
LANES = 4096  # candidates multiplied at a time


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, step sizes, lengths of the errors."""
    step = np.abs(x).max(1) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    err = np.sqrt(((x - code * step[:, None]) ** 2).sum(1))
    return code, step, err


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, times a power of two, which changes no cosine; others as they are."""
    top = np.abs(x).max(1)
    odd = (top > 1e100) | (top < 1e-100)
    if not odd.any():
        return x
    x = x.copy()
    x[odd] = np.ldexp(x[odd], -np.frexp(top[odd])[1][:, None])
    return x


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Double cosines of the rows of q with those of x, summed in component order; extreme vectors are scaled by powers of two."""
    q, x = _scaled(q), _scaled(x)
    dot, nq, nx = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot += x[:, d] * q[:, d]
        nq += q[:, d] * q[:, d]
        nx += x[:, d] * x[:, d]
    return np.clip(dot / np.sqrt(nx * nq), -1, 1)


def _tile(query: tuple, block: tuple, k: int) -> list[tuple]:
    """(query row, candidate rows, lower bounds, upper bounds) of a tile; each side: ids, rows, codes, steps, errors."""
    qid, qrow, qcode, qstep, qerr = query
    ids, rows, code, step, err = block
    if qcode.shape[1] != code.shape[1]:
        return []
    wide = np.float32 if code.shape[1] * 127 * 127 < 2**24 else np.float64
    # |q.v - q'.v'| <= |q'||v - v'| + |q - q'||v|, with |v| = 1 and |q'| <= 1 + |q - q'|; a little for rounding
    dots = (qcode.astype(wide) @ code.T.astype(wide)).astype(np.float64) * qstep[:, None] * step[None, :]
    slack = (1 + qerr)[:, None] * err[None, :] + qerr[:, None] + 1e-9
    dots[qid[:, None] == ids[None, :]] = -np.inf
    low = dots - slack
    cut = np.partition(low, len(ids) - k, 1)[:, len(ids) - k] if len(ids) > k else np.full(len(qid), -np.inf)
    out = []
    for i, q in enumerate(qrow):
        near = np.flatnonzero((dots[i] + slack[i] >= cut[i]) & (dots[i] > -np.inf))
        if len(near):
            out.append((int(q), rows[near].tolist(), low[i][near].tolist(), (dots[i] + slack[i])[near].tolist()))
    return out


_BLOCK = "side int, r int, c int, dim int, ids binary, rows binary, code binary, step binary, err binary"


def _pack(side: int):
    """One row per grid row or column and dimension: its vectors, quantised, as packed arrays."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.groupby("dim"):
            raw = np.array(part["v"].tolist(), np.float64)
            unit = raw / np.abs(raw).max(1)[:, None]
            code, step, err = quantise(unit / np.sqrt((unit**2).sum(1))[:, None])
            ids, rows = part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
            out.append((side, int(key[0]), int(key[0]), int(dim), *(a.tobytes() for a in (ids, rows, code, step, err))))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _BLOCK.split(", ")])

    return run


def _survivors(k: int):
    """Of the pairs of all tiles, by query those whose upper bound reaches the k-th largest lower bound."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for q, *parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found.setdefault(q, []).append([np.array(x) for x in parts])
        qs, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, parts in found.items():
            row, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            rows.append(row[high >= cut].astype(np.int64))
            qs.append(np.full(len(rows[-1]), q))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(rows))], ["qrow", "row"])

    return run


def _measured(batches):
    """(query_id, vec_id, score) of rows (query_id, qv, vec_id, v)."""
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dim in np.unique(size):
            part = batch.filter(pa.array(size == dim))
            q, x = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i in (1, 3))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cosines(q, x))], ["query_id", "vec_id", "score"])


def _unpack(row) -> tuple:
    ids, rows = np.frombuffer(row.ids, np.int64), np.frombuffer(row.rows, np.int64)
    return ids, rows, np.frombuffer(row.code, np.int8).reshape(-1, row.dim), np.frombuffer(row.step), np.frombuffer(row.err)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest other rows of each row that ``is_query`` (a Column) selects."""
    v = F.col(vec_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(
        "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    # A row is known by its place in the written table's input, as ids may repeat.
    clean = stage(clean.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = clean.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    rows, cols = max(1, -(-n["q"] // QUERY_BLOCK)), max(1, -(-n["n"] // CANDIDATE_BLOCK))
    slot = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    query = clean.where("q").withColumn("slot", slot(rows)).groupBy("slot").applyInPandas(_pack(0), _BLOCK)
    cand = clean.withColumn("slot", slot(cols)).groupBy("slot").applyInPandas(_pack(1), _BLOCK)
    blocks = stage(query.unionByName(cand), "blocks")
    left = blocks.where("side = 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    right = blocks.where("side = 1").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queries, cands = ([_unpack(x) for x in pdf[pdf.side == s].itertuples()] for s in (0, 1))
        found = []
        for block in cands:
            for at in range(0, len(block[0]), LANES):
                part = tuple(a[at : at + LANES] for a in block)
                found += [r for q in queries for i in range(0, len(q[0]), 256) for r in _tile(tuple(a[i : i + 256] for a in q), part, k)]
        return pd.DataFrame(found, columns=["qrow", "rows", "low", "high"])

    tiles = left.unionByName(right).groupBy("r", "c").applyInPandas(tile, "qrow long, rows array<long>, low array<double>, high array<double>")
    pairs = stage(tiles.repartition("qrow").mapInArrow(_survivors(k), "qrow long, row long"), "survivors")
    unstage(blocks)
    queries = clean.where("q").select(F.col("row").alias("qrow"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    originals = bit_filter(clean.select("row", F.col("id").alias("vec_id"), "v"), "row", pairs, "row")
    both = pairs.join(originals, "row").join(queries, "qrow").select("query_id", "qv", "vec_id", "v")

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                heap = heaps.setdefault(q, [])
                heapq.heappush(heap, (s, -i)) if len(heap) < k else heapq.heappushpop(heap, (s, -i))
        flat = [(q, rank, -i, s) for q, heap in heaps.items() for rank, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        cols = list(zip(*flat, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    scored = both.mapInArrow(_measured, "query_id long, vec_id long, score double")
    return scored.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
