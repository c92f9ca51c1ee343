"""Near-duplicate records with small edits: an exact set-similarity join.

A record is its set of distinct words; two records are alike if the Jaccard similarity of their sets reaches a
threshold t, that is, if the Hamming distance of their indicator vectors is at most (1-t)/(1+t) times the sum of their
sizes.

1. Candidates come from a prefix filter. With the words ordered from rare to frequent, a set enters the shards of its first
   ``size - ceil(t*size) + 1`` words; two sets that share none of these cannot be alike. This replaces a vantage-point tree
   over all records: in that tree, with its fingerprints, records of one sentence pattern lie at nearly equal distances from
   every vantage point, so the triangle bound prunes next to nothing (README, problem 4, has the measured figures).
2. Within a shard records are compared through 256-bit parity fingerprints of their sets, whose Hamming distance never
   exceeds that of the sets. A vantage-point tree splits shards of more than LEAF members at the median distance to a vantage
   point; the two halves are joined only where their boundary bands overlap. Smaller shards are compared directly. Fingerprint
   candidates are verified on the exact sets.

Both bounds are exact, so no pair is lost. Identical sets are collapsed first and expanded at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.pytext import words
from corpusloom.tables import broadcast_if_small, cut_lineage

#: At most this many words count as frequent; the bound of the broadcast word table.
HEAVY_WORDS = 65_536
#: Members of a shard that one task compares with each other; larger shards are compared block by block.
BLOCK = 4_096
#: Points below which a tree node is compared directly.
LEAF = 64
FP_WORDS = 4


def word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of FP_WORDS 64-bit numbers per set: bit b is the parity of the number of words that hash to b."""
    fp = np.zeros((len(sets), FP_WORDS), dtype=np.uint64)
    if sets:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bits = (np.concatenate(sets).astype(np.int64) & (FP_WORDS * 64 - 1)).astype(np.uint64)
        np.bitwise_xor.at(fp, (owner, (bits >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
    return fp


class VantageJoin:
    """All pairs of points whose fingerprint distance is within ``factor * (size_a + size_b)``."""

    def __init__(self, fp: np.ndarray, sizes: np.ndarray, factor: float, leaf: int = LEAF):
        self.fp, self.sizes, self.factor, self.leaf = fp, sizes, factor, leaf

    def _distances(self, a: int, to: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[to] ^ self.fp[a]).sum(axis=1, dtype=np.int64)

    def _compare(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(a), 256):
            for j in range(0, len(b), 256):
                x, y = a[i : i + 256], b[j : j + 256]
                near = np.bitwise_count(self.fp[x][:, None, :] ^ self.fp[y][None, :, :]).sum(axis=2, dtype=np.int64)
                p, q = np.nonzero(near <= self.factor * (self.sizes[x][:, None] + self.sizes[y][None, :]) + 1e-9)
                if len(p):
                    yield x[p], y[q]

    def within(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b) among the points; a pair of distinct points comes once, in either order."""
        if len(points) <= self.leaf:
            for a, b in self._compare(points, points):
                yield a[a < b], b[a < b]
            return
        d = self._distances(points[0], points)
        cut = np.median(d)
        inner, outer = points[d <= cut], points[d > cut]
        if not len(outer):  # equidistant points: nothing to prune
            for i in range(0, len(points), self.leaf):
                block = points[i : i + self.leaf]
                yield from self.within(block)
                yield from self._compare(block, points[i + self.leaf :])
            return
        yield from self.within(inner)
        yield from self.within(outer)
        yield from self._across_boundary(inner, d[d <= cut], outer, d[d > cut])

    def _across_boundary(self, a, da, b, db) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points from both sides of a split, only those whose balls reach the other side."""
        if not (len(a) and len(b)):
            return
        reach = self.factor * (self.sizes[a].max() + self.sizes[b].max())
        yield from self.across(a[da + reach >= db.min()], b[db - reach <= da.max()])

    def across(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with one point of each of two disjoint sets."""
        if len(a) * len(b) <= self.leaf**2:
            if len(a) and len(b):
                yield from self._compare(a, b)
            return
        da, db = self._distances(a[0], a), self._distances(a[0], b)
        cut = np.median(np.concatenate([da, db]))
        ai, ao, bi, bo = da <= cut, da > cut, db <= cut, db > cut
        if max(ai.sum() * bi.sum(), ao.sum() * bo.sum(), ai.sum() * bo.sum(), ao.sum() * bi.sum()) == len(a) * len(b):
            yield from self._compare(a, b)
            return
        yield from self.across(a[ai], b[bi])
        yield from self.across(a[ao], b[bo])
        yield from self._across_boundary(a[ai], da[ai], b[bo], db[bo])
        yield from self._across_boundary(b[bi], db[bi], a[ao], da[ao])


def word_sets(rows: DataFrame) -> DataFrame:
    """(_id, _set, _words): each text's set key and the hashes of its distinct words. Texts without words are keyed by text."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets, keys = [], []
            for text in b["_text"].to_pylist():
                ws = sorted(set(words(text)))
                said = " ".join(ws) if ws else "\0" + (text or "")
                keys.append(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                for w in ws:
                    if w not in known:
                        known[w] = word_hash(w)
                sets.append([known[w] for w in ws])
            if len(known) > 500_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_set", "_words"])

    return rows.select("_id", "_text").mapInArrow(task, "_id string, _set binary, _words array<bigint>")


def frequent_words(sets: DataFrame) -> dict[int, int]:
    """Words with at least 1/HEAVY_WORDS of all word occurrences in distinct sets, with their counts: at most HEAVY_WORDS."""
    total = sets.agg(F.sum(F.size("_words"))).first()[0] or 0
    least = max(2, -(-total // HEAVY_WORDS))
    counts = sets.select(F.explode("_words").alias("w")).groupBy("w").count().filter(F.col("count") >= least)
    return {r["w"]: r["count"] for r in counts.collect()}


def _prefixes(frequent: dict[int, int], t: float):
    """Task: (_shard, _set, _order) for each prefix word; _order is the set, rare words first."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, keys, orders = [], [], []
            for key, ws in zip(b["_set"].to_pylist(), b["_words"].to_pylist()):
                order = [h for _, h in sorted([(frequent.get(h, 0), h) for h in ws])]
                for h in order[: len(order) - math.ceil(t * len(order) - 1e-9) + 1]:
                    shard.append(h)
                    keys.append(key)
                    orders.append(order)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(keys, pa.binary()), pa.array(orders, pa.list_(pa.int64()))], ["_shard", "_set", "_order"])

    return task


def _pairs_of_shards(t: float):
    factor = (1 - t) / (1 + t)

    def pairs(shard: int, keys: list[bytes], sets: list[np.ndarray], side: np.ndarray, mixed: bool) -> list[tuple[bytes, bytes]]:
        join = VantageJoin(fingerprints(sets), np.array([len(s) for s in sets]), factor)
        found = join.across(np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if mixed else join.within(np.arange(len(sets)))
        asset: dict[int, set] = {}
        out = []
        for a, b in found:
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = sets[i], sets[j]
                if not asset.get(i):
                    asset[i] = set(x.tolist())
                if not asset.get(j):
                    asset[j] = set(y.tolist())
                common = asset[i] & asset[j]
                if len(common) < t * (len(x) + len(y) - len(common)) - 1e-9:
                    continue
                if next(h for h in x.tolist() if h in common) == shard:  # each pair comes out of one shard only
                    out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
        return out

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets, side = None, [], [], []
        out: list[tuple[bytes, bytes]] = []

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["_a", "_b"])
            out.clear()
            return b

        for b in batches:
            columns = [b[c].to_pylist() for c in ("_shard", "_i", "_j", "_chunk", "_set")]
            offsets, values = b["_order"].offsets.to_numpy(), b["_order"].values.to_numpy()
            for n, (shard, i, j, chunk, key) in enumerate(zip(*columns)):
                if (shard, i, j) != at:
                    if len(keys) > 1:
                        out += pairs(at[0], keys, sets, np.array(side), at[1] != at[2])
                    at, keys, sets, side = (shard, i, j), [], [], []
                    if len(out) > 10_000:
                        yield batch()
                keys.append(key)
                sets.append(values[offsets[n] : offsets[n + 1]])
                side.append(int(chunk != i))
        if len(keys) > 1:
            out += pairs(at[0], keys, sets, np.array(side), at[1] != at[2])
        yield batch()

    return task


def _blocks(rows: DataFrame, key: str, chunk_of: str) -> DataFrame:
    """Rows with ``_i`` <= ``_j``, the pair of blocks of their key's rows that a task compares, and their own ``_chunk``.

    Keys with at most BLOCK rows are one block. In larger ones every row is copied to the pairs its block takes part in.
    """
    hot = cut_lineage(rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_k")).filter(F.col("_k") > 1))
    rows = rows.join(broadcast_if_small(hot), key, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(chunk_of), F.col("_k")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumns({"_i": F.least("_chunk", "_other"), "_j": F.greatest("_chunk", "_other")}).drop("_other", "_k")


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """(_a, _b), _a < _b: keys of different word sets with a similarity of at least t. ``sets`` has unique _set."""
    sets = sets.filter(F.size("_words") > 0)
    entries = sets.mapInArrow(_prefixes(frequent_words(sets), t), "_shard bigint, _set binary, _order array<bigint>")
    blocks = _blocks(entries, "_shard", "_set").repartition("_shard", "_i", "_j").sortWithinPartitions("_shard", "_i", "_j")
    return blocks.select("_shard", "_i", "_j", "_chunk", "_set", "_order").mapInArrow(_pairs_of_shards(t), "_a binary, _b binary")


def near_duplicates(rows: DataFrame, *, ident: str = "id", text: str = "text", t: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (_a, _b) between similar word sets, and each record's set, members (_id, _set).

    Every pair of records with similarity >= t is either two members of one set or members of two linked sets.
    Defined results: rows with a null identifier are ignored; null texts count as empty; texts without any word are
    alike only if equal; records sharing an identifier count once each set; an empty table gives no links. Only the two
    named columns are read, so other columns play no part. Word sets are compared by 64-bit word hashes.
    """
    read = rows.select(F.col(ident).cast("string").alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull())
    every = cut_lineage(word_sets(read))
    sets = every.groupBy("_set").agg(F.first("_words").alias("_words"))
    return similar_sets(sets, t), every.select("_id", "_set").distinct()


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all record pairs behind links and shared sets. Large sets are paired block by block."""
    m = members
    across = links.join(m.select(F.col("_set").alias("_a"), F.col("_id").alias("x")), "_a").join(m.select(F.col("_set").alias("_b"), F.col("_id").alias("y")), "_b")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter(F.col("id_a") < F.col("id_b"))
    shared = m.join(m.groupBy("_set").count().filter(F.col("count") > 1).select("_set"), "_set", "left_semi")
    blocks = _blocks(shared, "_set", "_id")
    left = blocks.select("_set", "_i", "_j", F.col("_chunk").alias("_c"), F.col("_id").alias("id_a"))
    right = blocks.select("_set", "_i", "_j", F.col("_chunk").alias("_d"), F.col("_id").alias("id_b"))
    once = (F.col("_i") == F.col("_j")) | (F.col("_c") != F.col("_d"))  # rows of one chunk meet in its own block only
    within = left.join(right, ["_set", "_i", "_j"]).filter((F.col("id_a") < F.col("id_b")) & once).select("id_a", "id_b")
    return across.unionByName(within)


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): each record's class, the connected component of its set, and its number of similar sets.

    ``class_id`` is the least identifier in the class. Components come from rounds of large-star and small-star
    contraction over word sets; each round is kept in the checkpoint folder, and the number of rounds is logarithmic. The
    class is known for each set before records are looked up, so no row is joined by its component.
    """
    # the node of a linked set is its least identifier with its key, so that the least node of a component names the class
    links = cut_lineage(links.distinct())
    linked = links.select(F.explode(F.array("_a", "_b")).alias("_set")).distinct()
    nodes = cut_lineage(members.join(linked, "_set", "left_semi").groupBy("_set").agg(F.min(F.struct("_id", "_set")).alias("node")))
    ends = [nodes.select(F.col("_set").alias(c), F.col("node").alias(n)) for c, n in (("_a", "u"), ("_b", "v"))]
    edges = cut_lineage(links.join(ends[0], "_a").join(ends[1], "_b").select("u", "v"))
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    degree = both.groupBy("u").agg(F.count("*").alias("links"))
    before = None
    while True:
        near = both.groupBy("u").agg(F.min("v").alias("least"))
        large = both.join(near, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("least"))
        parents = large.join(small, "u")
        star = parents.select("u", F.col("least").alias("v")).union(parents.filter(F.col("v") != F.col("least")).select("v", "least")).toDF("u", "v").filter(F.col("u") != F.col("v")).distinct()
        star = cut_lineage(star)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = star.union(star.select("v", "u")).toDF("u", "v")
    about = nodes.join(star, nodes["node"] == star["u"], "left").select("_set", "node", F.coalesce("v", "node")["_id"].alias("_class"))
    about = about.join(degree.withColumnRenamed("u", "node"), "node", "left").select("_set", "_class", "links")
    alone = members.groupBy("_set").agg(F.min("_id").alias("_first"))
    every = members.join(alone, "_set").join(about, "_set", "left")
    return every.select(F.col("_id").alias("id"), F.coalesce("_class", "_first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
