"""Lineage over edge tables (addr, input): closures, depths, liveness, garbage, eviction.

Closures run level by level as equi-joins against the frontier, so each level is one shuffle of what is new; a level
count bounds the work.  The recursive SQL form is the same and is what the oracle queries use.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, unstage

STEPS = 256


def dependents(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(addr, depth) of all that depends on the roots (column addr), at the smallest depth."""
    return _closure(edges.select(F.col("input").alias("a"), F.col("addr").alias("b")), roots, max_depth)


def ancestors(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(addr, depth) of all inputs of the roots, direct and indirect."""
    return _closure(edges.select(F.col("addr").alias("a"), F.col("input").alias("b")), roots, max_depth)


def _closure(step: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    step = step.distinct()
    front = roots.select("addr").distinct().withColumn("depth", F.lit(0))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(step, front["addr"] == step["a"]).select(F.col("b").alias("addr")).distinct()
        # A written table cuts the lineage, survives lost executors and holds no memory.
        new = stage(new.join(seen, "addr", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if new.isEmpty():
            break
        seen, front = seen.union(new), new
    return seen.where("depth > 0")


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (addr, input) without those from or to the addresses that go."""
    left = edges.join(gone.select("addr"), "addr", "left_anti")
    return left.join(gone.select(F.col("addr").alias("input")), "input", "left_anti").select("addr", "input")


def depth(edges: DataFrame) -> DataFrame:
    """(addr, depth): the longest path from a node down to a leaf; leaves have 0.

    Level k is set again for all that use a node of level k - 1, until no node moves; a cycle would move for ever and is
    an error after as many levels as there are nodes.
    """
    nodes = edges.select("addr").union(edges.select("input")).distinct()
    limit = nodes.count()
    level = stage(nodes.withColumn("depth", F.lit(0)), "depth")
    moved = level
    for _ in range(limit + 1):
        # Only nodes that moved can move others.
        up = edges.join(moved.select(F.col("addr").alias("input"), "depth"), "input").groupBy("addr").agg((F.max("depth") + 1).alias("up"))
        new = stage(level.join(up, "addr", "left").select("addr", F.greatest("depth", F.coalesce("up", F.lit(0))).alias("depth"), F.expr("coalesce(up > depth, false)").alias("moved")), "depth")
        unstage(level)
        level, moved = new.select("addr", "depth"), new.where("moved")
        level.staged_path = new.staged_path
        if moved.isEmpty():
            return level
    raise ValueError("the graph has a cycle")


def live_set(edges: DataFrame, recipes: DataFrame, pins: DataFrame) -> DataFrame:
    """Addresses in use: recipes, their inputs and pins."""
    return recipes.select("addr").union(edges.select(F.col("input").alias("addr"))).union(pins.select("addr")).distinct()


def garbage(leaves: DataFrame, live: DataFrame, grace_seconds: int = 0, max_removals: int | None = None) -> DataFrame:
    """Leaves (addr, size, age_seconds) that nothing uses and that are older than the grace period; oldest first."""
    old = leaves.join(live, "addr", "left_anti").where(F.col("age_seconds") >= grace_seconds)
    return old if max_removals is None else old.orderBy(F.col("age_seconds").desc(), "addr").limit(max_removals)


def orphan_recipes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Recipes that lost an input."""
    return edges.join(removed.select(F.col("addr").alias("input")), "input", "left_semi").select("addr").distinct()


def missing_from(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Stored recipes that the graph does not know."""
    return stored.join(known, "addr", "left_anti")


def eviction(entries: DataFrame, budget: int, pressure: float = 0.8, target: float = 0.6) -> DataFrame:
    """Cache entries (addr, size, cpu_ms, hits, pinned) to evict.

    Nothing while the total is below ``pressure`` of the budget; else the lowest scores cpu_ms * (hits + 1) / size go
    until ``target`` is reached.  Pinned entries stay.
    """
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    scored = entries.where("not pinned").withColumn("score", F.col("cpu_ms") * (F.col("hits") + 1) / F.col("size"))
    if total <= budget * pressure:
        return scored.where("false").select("addr", "score", "size")
    # Scores are cut into steps at quantiles; sums of whole steps come first, and ranks only matter within a step.
    cuts = scored.approxQuantile("score", [i / STEPS for i in range(1, STEPS)], 1 / STEPS / 4) if STEPS > 1 else []
    step = F.aggregate(F.array(*(F.lit(c) for c in sorted(set(cuts)))), F.lit(0), lambda n, c: n + (F.col("score") > c).cast("int")) if cuts else F.lit(0)
    scored = scored.withColumn("step", step)
    sums = sorted((r["step"], r["size"]) for r in scored.groupBy("step").agg(F.sum("size").alias("size")).collect())
    ahead = dict(zip((k for k, _ in sums), [0, *accumulate(n for _, n in sums)], strict=False))
    lost = [k for k in ahead if total - ahead[k] > budget * target]
    w = Window.partitionBy("step").orderBy("score", "addr").rowsBetween(Window.unboundedPreceding, -1)
    known = F.create_map(*(F.lit(x) for k in lost for x in (k, ahead[k]))) if lost else F.lit(None)
    part = scored.where(F.col("step").isin(lost)).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)) + (known[F.col("step")] if lost else F.lit(0)))
    return part.where(F.lit(total) - F.col("before") > budget * target).select("addr", "score", "size")


def range_read(chunks: DataFrame, start: int, length: int) -> DataFrame:
    """Bytes [start, start + length) of chunk rows (key, chunk_idx, offset, content): only chunks that overlap."""
    end = start + length
    hit = chunks.where((F.col("offset") < end) & (F.col("offset") + F.octet_length("content") > start))
    lo = F.greatest(F.lit(start) - F.col("offset"), F.lit(0)).cast("int")
    hi = F.least(F.lit(end) - F.col("offset"), F.octet_length("content").cast("bigint")).cast("int")
    return hit.withColumn("content", F.substring("content", lo + 1, hi - lo))
