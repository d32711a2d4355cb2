"""SimHash near-duplicates with a pigeonring search.

Fingerprints: each shingle's XXH64 votes on 64 bits. Two fingerprints within r bits, cut into m = r + 1 segments on a
ring, must have a segment from which every chain of consecutive segments keeps within its proportional budget: the
differences of the first l segments are at most l * r / m. The first two links of that chain (no difference, then at
most one) are a join key: the first segment and the second with up to one bit flipped; flips are laid out on one side
only, told apart by the parity of the second segment. What meets under a key is held against the longer chains and
then the full distance.

Equal fingerprints are one node, so copies cost nothing; within a key a spanning forest is given, not all pairs. Keys
with many fingerprints are split into block pairs over many tasks. Components are then found over the whole table.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other; null ids take
part, but a component's id is its smallest id that isn't null; repeated rows get the same answer; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import nearcopies
from loomtext.llm.common import arrow_rows, small_batches, spill, table
from loomtext.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: A key with more fingerprints than this is split into block pairs.
BLOCK = 2048
#: The list of split keys is broadcast only when it was counted to be at most this long (12 bytes each).
BROADCAST_KEYS = 100_000
#: Up to this size a key's fingerprints are compared pairwise in one vector step for all such keys.
SMALL_GROUP = 24

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text (ASCII lower-cased words between ASCII white space)."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    bounds = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], seed) for s, e in bounds], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, how many of the hashes set it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> int:
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, hash, fp): a hash of the text and the fingerprint as a signed long. One pass, no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            found = np.array([majority(shingle_hashes(t, shingle)) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "hash", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash long, fp long")


class Ring:
    """The segments of a 64-bit ring for one radius."""

    def __init__(self, radius: int):
        if not 1 <= radius <= 7:
            raise ValueError("radius is 1 to 7")
        self.radius, self.m = radius, radius + 1
        cuts = [round(64 * i / self.m) for i in range(self.m + 1)]
        self.low, self.width = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]

    def segment(self, fps: np.ndarray, i: int) -> np.ndarray:
        i %= self.m
        return (fps >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)

    def mask(self, i: int, links: int) -> int:
        return sum(((1 << self.width[j % self.m]) - 1) << self.low[j % self.m] for j in range(i, i + links))

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, index of the fingerprint, and whether it lies under its own segments (or under a flip)."""
        keys, rows, own = [], [], []
        index = np.arange(len(fps))
        for i in range(self.m):
            head = np.uint64(i) << np.uint64(60) | self.segment(fps, i) << np.uint64(28)
            after = self.segment(fps, i + 1)
            keys.append(head | after)
            rows.append(index)
            own.append(np.ones(len(fps), bool))
            if (2 * self.radius) // self.m:  # the second link allows one difference
                even = np.flatnonzero(np.bitwise_count(after) % 2 == 0)
                for bit in range(self.width[(i + 1) % self.m]):
                    keys.append(head[even] | (after[even] ^ np.uint64(1 << bit)))
                    rows.append(even)
                    own.append(np.zeros(len(even), bool))
        return np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(own)

    def close(self, keys: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether the chain from the key's segment keeps its budgets, and then the whole distance."""
        start = (keys.view(np.uint64) >> np.uint64(60)).astype(np.int64)
        ok = np.ones(len(differ), bool)
        for links in range(2, self.m):
            masks = np.array([self.mask(i, links) for i in range(self.m)], np.uint64)
            ok &= np.bitwise_count(differ & masks[start]) <= links * self.radius // self.m
        ok[ok] = np.bitwise_count(differ[ok]) <= self.radius
        return ok


def forest(ring: Ring, key: int, fps: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the links among the fingerprints under one key. Each one found leaves the pool."""
    edges, pool = [], np.arange(len(fps))
    keys = np.array([key], np.int64)
    while len(pool):
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            at = todo.pop()
            near = ring.close(np.broadcast_to(keys, len(pool)), fps[pool] ^ fps[at]) & (own[pool] | own[at])
            if near.any():
                found, pool = pool[near], pool[~near]
                edges += [(int(fps[at]), int(x)) for x in fps[found]]
                todo += found.tolist()
    return edges


def link_sorted(ring: Ring, keys: np.ndarray, fps: np.ndarray, own: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Edges among rows that stand together by group (equal keys and cell)."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    found = [np.zeros((0, 2), np.uint64)]
    for lag in range(1, min(SMALL_GROUP, int(sizes.max(initial=1)))):
        fit = (sizes > lag) & (sizes <= SMALL_GROUP)
        if not fit.any():
            break
        count = sizes[fit] - lag
        left = np.repeat(starts[fit] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        left = left[own[left] | own[left + lag]]
        left = left[ring.close(keys[left], fps[left] ^ fps[left + lag])]
        found.append(np.stack([fps[left], fps[left + lag]], 1))
    for k in np.flatnonzero(sizes > SMALL_GROUP):
        part = slice(starts[k], starts[k] + sizes[k])
        if own[part].any():
            found.append(np.array(forest(ring, int(keys[starts[k]]), fps[part], own[part]), np.uint64).reshape(-1, 2))
    return np.concatenate(found)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints within the radius, as forests that span each key's links; a table. distinct has one column fp."""
    ring = Ring(radius)
    spark = distinct.sparkSession

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, rows, own = ring.keys(fps)
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(fps[rows[part]].view(np.int64)), pa.array(own[part])], ["key", "fp", "own"])

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, _, own = ring.keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys[own])], ["key"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield edges([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield edges(held)

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, cell, fp, own = cols
        changed = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]
        out = link_sorted(ring, key.astype(np.int64), fp.astype(np.int64).view(np.uint64), own.astype(bool), np.cumsum(changed)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    def linked() -> DataFrame:
        rows = distinct.mapInArrow(lay_out, "key long, fp long, own boolean")
        counted = distinct.mapInArrow(own_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        large = spill(counted.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-keys")
        many = large.count()
        if many:
            large = F.broadcast(large) if many <= BROADCAST_KEYS else large
            rows = rows.join(large, "key", "left")
            mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
            cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j) * F.col("blocks") + F.greatest(mine, j))
            rows = rows.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cells)))
        else:
            rows = rows.withColumn("cell", F.lit(0))
        dealt = rows.select("key", "cell", "fp", "own").repartition("key", "cell").sortWithinPartitions("key", "cell")
        return dealt.mapInArrow(link, "a long, b long")

    with arrow_rows(spark, 20_000):
        return spill(linked(), "links")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id that it reaches."""
    rows = spill(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    nodes = spill(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "nodes")
    named = nodes.select("fp", "root").join(nodes.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return rows.join(named, "fp").select("id", "hash", "fp", "root", "component")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Rows to be dropped are named by a broadcast list only when it was counted to be at most this long; more are joined by shuffle.
BROADCAST_LOSERS = 200_000


def drop_near_copies(df: DataFrame, shingle: int = nearcopies.SHINGLE, similarity: float = nearcopies.SIMILARITY) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, then the smallest text digest.

    Links are exact: texts whose sets of shingles are similar; see nearcopies. The choice is made on ids and digests alone; of the
    documents, only those that go are looked up.

    Documents with a null doc_id lose to others; of rows that repeat the kept one, one stays.
    """
    rows = df.select(F.col("doc_id").alias("id"), nearcopies.digest(F.col("text")).alias("node"))
    rows = spill(rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")), "rows")
    roots = nearcopies.near_copy_roots(df, shingle=shingle, similarity=similarity)
    named = spill(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    winners = named.groupBy("root").agg(first).select(F.col("first.id").alias("_id"), F.col("first.node").alias("_node"))
    won = named["id"].eqNullSafe(winners["_id"]) & (named["node"] == winners["_node"])
    losers = spill(named.join(winners, won, "left_anti").select("id", "node"), "losers")
    again = spill(named.filter("n > 1").join(winners, won, "left_semi").select("id", "node"), "again")
    kept = _picked(df, losers.union(again), "left_anti")
    if again.isEmpty():
        return kept
    keyed = _picked(df, again, "left_semi").withColumn("_node", nearcopies.digest(F.col("text")))
    return kept.union(keyed.dropDuplicates(["doc_id", "_node"]).drop("_node"))


def _picked(df: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """The rows of df that the table (id, node) names, or (left_anti) the others."""
    named = named.select(F.col("id").alias("_id"), F.col("node").alias("_named"))
    named = F.broadcast(named) if named.count() <= BROADCAST_LOSERS else named
    keyed = df.withColumn("_digest", nearcopies.digest(F.col("text")))
    return keyed.join(named, keyed["doc_id"].eqNullSafe(named["_id"]) & (keyed["_digest"] == named["_named"]), how).select(*[keyed[c] for c in df.columns])
