"""N-gram Jaccard self-join of documents by vertical partitioning.

The distinct word n-grams of a text are 64-bit hashes; their numeric order is the global n-gram order, the same for
every document.  Cutting that order into fragments cuts every document's set into segments:

1. *Candidates.*  Two sets with 100*I >= p*U differ in at most d = (|x|+|y|)*(100-p)/(100+p) n-grams, so of d+1+s
   fragments at least s+1 hold the same segment in both.  Documents are therefore grouped by segment hash
   (per size class, as d depends on size).  Segments of one n-gram or none are shared by unlike sets: a set with at most s of them
   does without, since one of the s+1 is longer.  No link can be missed.  Below PREFIX_BELOW percent the segments would be short
   and often empty, and so shared by unlike sets; there the first |x| - ceil(p|x|) + 1 n-grams in the global order are
   the keys instead, of which two linked sets share one.  That holds for any order that is the same for all sets; there n-grams
   that are frequent in a sample of SAMPLE rows come last, as each of them would make a group of many unlike sets.
2. *Stars.*  Equal sets form one class first.  A segment group of m classes proposes m-1 pairs (member, leader),
   not m^2.
3. *Bound.*  Each set carries how many n-grams it has in each of 256 fragments; the sum of the smaller counts bounds
   the overlap from above.  Pairs whose bound is too low are no links.
4. *Verification.*  For the others the overlaps are counted fragment by fragment and summed:
   I = sum of partial overlaps, U = |x|+|y|-I.  Each set's pair with the smallest of its leaders goes first; of the other pairs
   those follow whose ends are not connected by then.
5. *Rest.*  In segment groups that still hold several components, members of different ones are compared by a join whose
   condition lets few pairs out: their sizes allow a link, bitmaps of BITS bits bound the n-grams that only one of them has from
   below, and the first EARLY keys of both show no earlier group in which they meet.  What passes goes through 3 and 4 too: where there are
   many more pairs than nodes, each node's pair with the smallest of its partners goes first and pairs connected by that go out, again and
   again while it pays; then all others.  So every pair that shares a segment is either verified, ruled out by a
   bound, or inside one component already.

Disk: keys are shuffled, open groups joined and overlaps counted in passes over parts of the keys or pairs, each of them staged and
its shuffles released before the next.  Passes leave nothing out.

Components over verified links and equal sets are exact.

Edge cases: null or empty text, or text without words: n_shingles 0, linked with nothing.  Null doc_id: the row stays,
component_id is null and it links nothing.  Rows repeating a doc_id: each row's text is a set of its own with its own n_shingles,
and the id has the links of all of them.  Extra input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import bit_filter, components, release, stage, union_all, unstage

FRAGMENTS = 8  # of the verification
CELLS = 256  # of the bound
SLICE = 1 << 20  # bytes of text handled at once
BITS = 512  # of the bitmaps
PASSES = 4  # over the keys, so that a part of them is shuffled at a time
FEW = 1 << 22  # n-grams of all sets; up to so many one pass does
EARLY = 8  # keys of a set that tell where a pair has met before
DENSE = 4  # pairs of open groups for each that goes first; up to so many all go at once
PAYS = 4  # while one pair in so many that go first is a link, the others wait
PREFIX_BELOW = 85
SAMPLE = 8192  # rows, about; the n-grams that OFTEN of them hold are frequent, LIST of them at most
OFTEN = 3
LIST = 1 << 16
SLOTS = 1 << 20  # of the table of frequent n-grams
_K = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)


def shingle_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram."""
    h, b = T.words(col, "space")
    with np.errstate(over="ignore"):
        s = T.mix(h + np.uint64(n))
        for i in range(1, n):
            s = T.mix(s[: max(len(h) - i, 0)] * _K[0] + h[i:] * _K[1])
        for lo, hi in zip(b[:-1], b[1:], strict=True):
            if hi - lo >= n:
                yield np.unique(s[lo : hi - n + 1])
            elif hi > lo:
                whole = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    whole = T.mix(np.array([whole * _K[0] + x * _K[1]], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_digest(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def size_classes(percent: int) -> list[tuple[int, int, int]]:
    """(smallest size, smallest size of the next class, fragments): sizes grow by half from class to class."""
    out, low = [], 1
    while low < 1 << 40:
        high = (100 + percent) // (2 * (100 - percent)) + 1 if low == 1 and percent < 100 else low + max(low // 2, 1)
        out.append((low, high, (2 * (high - 1) * (100 - percent)) // (100 + percent) + 1))
        low = high
    return out


def spare(fragments: int) -> int:
    """How many fragments there are beyond those needed; as many segments of one n-gram or none may be left out."""
    return 1 + fragments // 16 if fragments > 1 else 0


def frequent(texts: DataFrame, n: int) -> np.ndarray:
    """For each of SLOTS remainders whether an n-gram with it is frequent among sampled rows of ``texts`` (node, text).

    This tells a place in an order and nothing else: n-grams that share a remainder, or that the sample does not show, change no result.
    """
    def run(batches):
        for batch in T.docs_in_batch(batches, "text", SLICE):
            sets = list(shingle_sets(batch.column(1), n))
            if sets:
                grams, rows = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(rows, pa.int64())], ["gram", "rows"])

    share = -(-SAMPLE * SLOTS // max(texts.count(), 1))
    some = texts.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SLOTS)) < share).mapInArrow(run, "gram long, rows long")
    top = some.groupBy("gram").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= OFTEN).orderBy(F.desc("rows"), "gram").limit(LIST)
    table = np.zeros(SLOTS, bool)
    table[top.select("gram").toArrow().column(0).to_numpy().view(np.uint64) % np.uint64(SLOTS)] = True
    return table


def segment_keys(u: np.ndarray, percent: int, classes: list[tuple[int, int, int]], starts: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """A hash for each (size class, fragment, segment) of a set; also of the next class if a partner may lie in it."""
    n = len(u)
    if percent < PREFIX_BELOW:
        if often is not None:
            last = often[(u % np.uint64(SLOTS)).astype(np.int64)]
            u = np.concatenate([u[~last], u[last]])
        return T.mix(u[: n - -(-n * percent // 100) + 1] + np.uint64(11))
    k = int(np.searchsorted(starts, n, "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(u + np.uint64(7)), dtype=np.uint64)])
    out = []
    for j in (k, k + 1):
        _, _, f = classes[j]
        if j > k and 100 * n < percent * classes[j][0]:
            break
        if f > 1:
            s = spare(f)
            f += s
            cuts = np.searchsorted(u, (np.arange(1, f, dtype=np.float64) * (2.0**64 / f)).astype(np.uint64))
            cuts = np.concatenate([[0], cuts, [n]])
            with np.errstate(over="ignore"):
                seg = sums[cuts[1:]] - sums[cuts[:-1]]
                keys = T.mix(seg * _K[0] + (np.arange(f, dtype=np.uint64) + np.uint64(j << 32)) * _K[1])
            weak = np.diff(cuts) <= 1
            out.append(keys[~weak] if weak.sum() <= s else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fragment_counts(u: np.ndarray) -> bytes:
    """How many n-grams lie in each of CELLS fragments of the global order."""
    return np.minimum(np.bincount((u >> np.uint64(56)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes()


def bitmap(u: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers; that of each n-gram's lowest bits is set."""
    bits = np.zeros(BITS, np.uint8)
    bits[(u % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100*I >= percent*U is possible for rows of fragment counts and set sizes."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    full = (x.max(1) == 65535) | (y.max(1) == 65535)
    most = np.where(full, np.minimum(nx, ny), np.minimum(most, np.minimum(nx, ny)))
    return most * (100 + percent) >= percent * (nx + ny)


def _counts(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(-1, CELLS)


def slim(sets: DataFrame) -> DataFrame:
    """(node, n, bitmap as columns w0, w1 and so on) of ``sets``."""
    return sets.select("node", F.col("n_shingles").alias("n"), *(F.col("bits")[i].alias(f"w{i}") for i in range(BITS // 64)))


def fits(percent: int) -> str:
    """SQL: whether sizes n, n_b and bitmaps w, v allow a link."""
    # 100 * I >= percent * U leaves each side at most n - I n-grams of its own, with I = percent * (n + n_b) / (100 + percent).
    own = lambda x, y: " + ".join(f"bit_count({x}{i} & ~{y}{i})" for i in range(BITS // 64))
    least = f"{percent} * (n + n_b)"
    return f"100 * least(n, n_b) >= {percent} * greatest(n, n_b) and (n - ({own('w', 'v')})) * {100 + percent} >= {least} and (n_b - ({own('v', 'w')})) * {100 + percent} >= {least}"


def fitting(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out: most go before their counts are shuffled."""
    one, other = slim(sets).withColumnRenamed("node", "a"), slim(sets).withColumnsRenamed({"node": "b", "n": "n_b"} | {f"w{i}": f"v{i}" for i in range(BITS // 64)})
    return pairs.join(one, "a").join(other, "b").where(fits(percent)).select("a", "b")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound does not rule out; sets: node, n_shingles, counts."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4)]
                keep = may_link(_counts(batch.column(3)), _counts(batch.column(5)), *n, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "c_a", "n_b", "c_b")
    return both.mapInArrow(run, "a long, b long")


def row_node(doc: str, text: str) -> Column:
    """What a row is known by: texts are found again by it, so it hashes the text too; an unlucky pair of rows only loses a link."""
    return F.xxhash64(F.col(doc).cast("string"), F.col(text))


def signatures(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, node, n_shingles, digest, keys, counts, bits): one Python pass over the texts, no shuffle."""
    classes = size_classes(percent)
    starts = np.array([c[0] for c in classes])
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    often = np.packbits(frequent(rows.select(row_node("doc", "text").alias("node"), "text"), n)) if percent < PREFIX_BELOW else None

    def run(batches):
        last = None if often is None else np.unpackbits(often).astype(bool)
        for batch in T.docs_in_batch(batches, "text", SLICE):
            sizes, digests, keys, counts, bits = [], [], [], [], []
            for u in shingle_sets(batch.column(1), n):
                sizes.append(len(u))
                digests.append(set_digest(u) if len(u) else None)
                keys.append(segment_keys(u, percent, classes, starts, last).tobytes() if len(u) else b"")
                counts.append(fragment_counts(u) if len(u) else b"")
                bits.append(bitmap(u))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["of", "n_shingles", "digest", "keys", "counts", "bits"])

    rows = rows.select(F.struct("doc", row_node("doc", "text").alias("node")).alias("of"), "text")
    out = rows.mapInArrow(run, "of struct<doc:long,node:long>, n_shingles long, digest binary, keys binary, counts binary, bits array<long>")
    return out.select("of.*", "n_shingles", "digest", "keys", "counts", "bits")


def _local_stars(batches, part: int, passes: int):
    """Per batch, of the keys of ``part``: each once with its first node (leader null), and (key, node, that first node) for the others."""
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        raw = [x[x % np.uint64(passes) == part] for x in (np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist())]
        if not raw or not sum(map(len, raw)):
            continue
        keys, node = np.concatenate(raw), np.repeat(nodes, [len(x) for x in raw])
        order = np.lexsort((node, keys))
        keys, node = keys[order].view(np.int64), node[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        lead = node[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        keep = first | (lead != node)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(node[keep]), pa.array(lead[keep], mask=first[keep])], ["key", "node", "leader"])


def _global_stars(batches):
    """Rows sorted by key, then node: links (key, node, first node of the key); rows that have a leader pass."""
    last_key = last_node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        local = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        yield batch.select(["key", "node", "leader"]).filter(pa.array(local))
        key, node = key[~local], node[~local]
        if not len(key):
            continue
        first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        lead = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        if not first[0]:
            lead[: int(np.argmax(first)) if first.any() else len(key)] = last_node
        last_key, last_node = key[-1], lead[-1]
        use = ~first & (lead != node)
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(node[use]), pa.array(lead[use])], ["key", "node", "leader"])


def verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    """Of ``pairs`` (a, b) of class representatives, those linked; overlaps are counted per fragment and summed per pair.  total: the sizes of all sets."""
    def run(batches):
        for batch in T.docs_in_batch(batches, "text", SLICE):
            node, frag, size, toks = [], [], [], []
            for i, digest, u in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if set_digest(u) != digest:  # another text under the same id
                    continue
                cuts = np.searchsorted(u, (np.arange(1, FRAGMENTS, dtype=np.float64) * (2.0**64 / FRAGMENTS)).astype(np.uint64))
                for f, part in enumerate(np.split(u.view(np.int64), cuts)):
                    if len(part) or not f:
                        node.append(i), frag.append(f), size.append(len(u)), toks.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.array(size, pa.int64()), pa.array(toks, pa.list_(pa.int64()))], ["node", "frag", "size", "toks"])

    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = ids.join(classes.select(F.col("rep").alias("node"), "digest"), "node")
    wanted = bit_filter(texts, "node", ids, "node").join(ids.hint("shuffle_hash"), "node").dropDuplicates(["node", "text"])
    seg = stage(wanted.select("node", "text", "digest").mapInArrow(run, "node long, frag int, size long, toks array<long>"), "segments")
    side = lambda x: seg.select(F.col("node").alias(x), "frag", F.col("size").alias(f"size_{x}"), F.col("toks").alias(f"toks_{x}"))
    sizes = seg.where("frag = 0").select(F.col("node").alias("b"), F.col("size").alias("size_b"))
    # Each pair ships a set.  All pairs at once would need room that grows with them, not with the input.
    weight = pairs.join(seg.where("frag = 0").select(F.col("node").alias("a"), "size"), "a").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    turns = max(1, -(-PASSES * weight // max(total, PASSES * FEW)))
    found = []
    for turn in range(turns):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn) if turns > 1 else pairs
        overlap = (
            some.join(side("a"), "a").join(side("b").select("b", "frag", F.col("toks_b")), ["b", "frag"], "left")
            .withColumn("part", F.coalesce(F.size(F.array_intersect("toks_a", "toks_b")), F.lit(0)))
            .groupBy("a", "b").agg(F.sum("part").alias("i"), F.max("size_a").alias("size_a"))
        )
        good = overlap.join(sizes, "b").where(F.col("i") * 100 >= F.lit(percent) * (F.col("size_a") + F.col("size_b") - F.col("i")))
        found.append(stage(good.select("a", "b"), "links"))
        release(pairs.sparkSession)
    unstage(seg)
    return union_all(found)


def first_pairs(links: DataFrame) -> DataFrame:
    """The pair (a, b) of each node with the smallest of its leaders."""
    return links.groupBy("node").agg(F.min("leader").alias("b")).select(F.col("node").alias("a"), "b")


def other_pairs(links: DataFrame, comp: DataFrame) -> DataFrame:
    """The other pairs (a, b) with leaders whose ends ``comp`` leaves apart."""
    return apart(links.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct().join(first_pairs(links), ["a", "b"], "left_anti"), comp)


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components of ``comp``."""
    ends = pairs.join(comp.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(comp.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    return ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) for each node that of the smallest node with which it has one."""
    both = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("end"))
    return both.groupBy("end.node").agg(F.min_by(F.struct("a", "b"), "end.other").alias("pair")).select("pair.a", "pair.b").distinct()


def open_members(links: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, root) of every member of a segment group that holds several components."""
    lead = comp.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    open_keys = (
        links.join(comp, "node", "left").join(lead, "leader", "left")
        .where(F.coalesce("root", "node") != F.coalesce("leader_root", "leader")).select("key").distinct()
    )
    member = links.select("key", "node").union(links.select("key", F.col("leader").alias("node"))).distinct()
    return member.join(open_keys, "key", "left_semi").join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def open_pairs(member: DataFrame, sets: DataFrame, percent: int, part: int = 0, passes: int = 1) -> DataFrame:
    """Pairs (a, b) of different components that share a segment group and that sizes and bitmaps allow to be linked; those met at the keys of ``part``."""
    early = member.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, EARLY).alias("early"))
    side = member.where(F.pmod("key", F.lit(passes)) == part).join(early, "node").join(slim(sets), "node")
    other = side.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("early").alias("early_b"), F.col("n").alias("n_b"), *(F.col(f"w{i}").alias(f"v{i}") for i in range(BITS // 64)))
    # A pair shares many keys.  Where both sets have an earlier one among their first it meets there; at its first of all it always gets out.
    anew = F.coalesce(F.array_min(F.array_intersect("early", "early_b")) >= F.col("key"), F.lit(True))
    return side.withColumnRenamed("node", "a").join(other, "key").where(F.expr(f"root < root_b and {fits(percent)}") & anew).select("a", "b")


def linked(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """((doc, node, n_shingles, digest) of every row; (doc, node, rep) of rows with words and an id; links (a, b) of class representatives; their components)."""
    sigs = stage(signatures(docs, n, percent, id_col, text_col), "signatures")
    full = sigs.where("doc is not null and n_shingles > 0")
    classes = stage(full.groupBy("digest").agg(F.min("node").alias("rep")), "classes")
    reps = full.join(classes.select("digest", F.col("rep").alias("node")).hint("shuffle_hash"), ["digest", "node"], "left_semi")
    sets = stage(reps.select("node", "n_shingles", "counts", "bits").dropDuplicates(["node"]), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    passes = PASSES if total > FEW else 1
    release(docs.sparkSession)
    stars = []
    for part in range(passes):
        found = (
            reps.select("node", "keys").mapInArrow(partial(_local_stars, part=part, passes=passes), "key long, node long, leader long")
            .withColumn("deal", F.when(F.col("leader").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node")))
            .repartition("deal").sortWithinPartitions("key", "node").drop("deal")
            .mapInArrow(_global_stars, "key long, node long, leader long")
        )
        stars.append(stage(found, "stars"))
        release(docs.sparkSession)
    links = union_all(stars)
    # Keys, counts and bits of all rows need not lie on disk while pairs are verified.
    wide, sigs = sigs, stage(sigs.select("doc", "node", "n_shingles", "digest"), "rows")
    full = sigs.where("doc is not null and n_shingles > 0")
    unstage(wide)
    release(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).select(row_node("doc", "text").alias("node"), "text")

    def bound(pairs: DataFrame) -> DataFrame:
        out = stage(bounded(pairs, sets, percent), "pairs")
        unstage(pairs)
        return out

    def check(pairs: DataFrame) -> DataFrame:
        good = verified(texts, classes, pairs, n, percent, total)
        unstage(pairs)
        release(docs.sparkSession)
        return good

    edges = check(bound(stage(fitting(first_pairs(links), sets, percent), "fitting")))
    comp = stage(components(edges), "components")
    edges = edges.union(check(bound(stage(fitting(other_pairs(links, comp).distinct(), sets, percent), "fitting"))))
    unstage(comp)
    comp = stage(components(edges), "components")
    member = stage(open_members(links, comp), "open")
    release(docs.sparkSession)
    if not member.isEmpty():
        met = []
        for part in range(passes):
            met.append(stage(open_pairs(member, sets, percent, part, passes), "met"))
            release(docs.sparkSession)
        pairs = bound(stage(union_all(met).distinct(), "fitting"))  # their sizes and bitmaps are looked at already
        unstage(*met)
        pays = True
        while pays:
            some = stage(nearest_pairs(pairs), "nearest")
            tried = some.count()
            if pairs.count() <= DENSE * tried:
                unstage(some)
                break
            good = verified(texts, classes, some, n, percent, total)
            pays = good.count() * PAYS >= tried
            edges = edges.union(good)
            unstage(comp)
            comp = stage(components(edges), "components")
            rest = stage(apart(pairs.join(some, ["a", "b"], "left_anti"), comp), "pairs")
            unstage(some, pairs)
            pairs = rest
            release(docs.sparkSession)
        if not pairs.isEmpty() and not (good := check(pairs)).isEmpty():
            edges = edges.union(good)
            unstage(comp)
            comp = stage(components(edges), "components")
    unstage(member)
    unstage(*stars, sets)
    release(docs.sparkSession)
    of = stage(full.select("doc", "node", "digest").join(classes, "digest").select("doc", "node", "rep"), "classes-of")
    unstage(classes)
    return sigs, of, edges, comp


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    sigs, of, edges, comp = linked(docs, n, percent, id_col, text_col)
    # An id with several texts is in the classes of all of them, which it ties together.
    tied = of.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b <> hi").select("doc", "b")
    tied = stage(of.join(tied, "doc").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "tied")
    if not tied.isEmpty():
        comp = stage(components(edges.union(tied)), "components")
    of = of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc", F.coalesce("root", "rep").alias("root"))
    least = of.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_doc = of.distinct().join(least, "root").where("doc <> component_id").select("doc", "component_id")
    return (
        sigs.select("doc", "n_shingles").join(by_doc, "doc", "left")
        .select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked rows one, that of the smallest id (then of the smallest row hash); of rows with equal id and text one.

    Rows go one by one: a row whose id has a copy elsewhere under another text stays.  Rows without words or id link nothing.
    """
    sigs, of, _, comp = linked(docs, n, percent, id_col, text_col)
    of = of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "node", F.coalesce("root", "rep").alias("root"))
    first = of.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first"))
    lost = of.join(first, "root").where("node <> first.node").select("node").distinct()
    again = sigs.groupBy("node").count().where("count > 1").select("node")
    touched = stage(lost.withColumn("lost", F.lit(True)).unionByName(again.withColumn("lost", F.lit(False))).groupBy("node").agg(F.max("lost").alias("lost")), "touched")
    keyed = docs.withColumn("_doc", F.col(id_col).cast("long")).withColumn("_text", F.col(text_col).cast("string")).withColumn("_node", row_node("_doc", "_text")).drop("_doc", "_text")
    # Rows that the bit table leaves out are untouched and need no shuffle.
    clean = bit_filter(keyed, "_node", touched, "node", inside=False)
    near = bit_filter(keyed, "_node", touched, "node").join(touched.withColumnRenamed("node", "_node"), "_node", "left").where("lost is null or not lost")
    near = near.where("lost is null").select(keyed.columns).unionByName(near.where("lost is not null").dropDuplicates(["_node"]).select(keyed.columns))
    return clean.unionByName(near).select(docs.columns)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM toks),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT x.r AS x, y.r AS y, x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT DISTINCT a, b FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m.m, t.doc_id)) AS component_id
FROM toks t LEFT JOIN sizes s USING (r) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) m USING (doc_id)
"""
