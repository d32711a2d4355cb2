"""Benchmark decontamination with SimHash over item-sized windows.

Every document's words (runs of letters and digits, lower-cased) form five-word shingles; every window with as many
shingles as some benchmark item gets a SimHash. Windows that hold too few benchmark shingles to reach the similarity are
skipped first, which loses nothing. A multi-index of the items' fingerprints gives every item within the radius: of BLOCKS
blocks one differs by at most radius / BLOCKS bits, and a table for each block names the items that near, which leaves about a
fifth of the items to be compared. The exact weighted similarity of the two bags of shingles (sum of smaller counts by sum of
larger counts) decides.

The benchmark is held by every task in blocks of at most INDEX_BYTES, counted as it is read; a larger benchmark takes one
pass over the documents a block.

Defined results: null or empty texts and items without a word match nothing; an item shorter than a shingle is one
shingle of all its words; equal items each give their row; repeated documents each give their rows; ties between windows
go to the first; other columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches, table
from loomtext.llm.vector_text import BASE, Words, chunks, mix

SHINGLE = 5
SIMILARITY = 0.8
#: A window at similarity 0.8 differs from the item in 10 of 64 bits or so, and in more than this with a probability under 0.01.
RADIUS = 17
#: Bits of the blocks, and where each begins.
WIDTHS = (11, 11, 11, 11, 10, 10)
BLOCKS, STARTS = len(WIDTHS), tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: About so much of the benchmark's index is held at once: what an item's tables take, and its text's length by a factor.
INDEX_BYTES, ITEM_BYTES, BYTES_A_CHARACTER = 32 << 20, sum(1 << w for w in WIDTHS) // 8 + 500, 4
FILTER_BITS = 22


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * BASE + hashes[i : i + n]
    return mix(out)


def signs(hashes: np.ndarray) -> np.ndarray:
    """One row a hash, one column a bit: +1 or -1."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


@dataclass
class Sized:
    """The items whose shingles have one width and one number."""

    ids: list = field(default_factory=list)
    bags: list = field(default_factory=list)
    prints: list = field(default_factory=list)

    def index(self, radius: int) -> None:
        self.fps = np.array(self.prints, np.uint64)
        most = radius // BLOCKS
        self.tables = []
        for b, width in enumerate(WIDTHS):
            values = np.arange(1 << width, dtype=np.uint64)
            self.tables.append(np.packbits(np.bitwise_count(values[:, None] ^ self.block(self.fps, b)[None, :]) <= most, axis=1))

    @staticmethod
    def block(fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> np.uint64(STARTS[b])) & np.uint64((1 << WIDTHS[b]) - 1)

    def near(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius, through the blocks' tables."""
        held = self.tables[0][self.block(fps, 0).astype(np.int64)]
        for b in range(1, BLOCKS):
            held = held | self.tables[b][self.block(fps, b).astype(np.int64)]
        window, item = np.nonzero(np.unpackbits(held, axis=1, count=len(self.fps)))
        close = np.bitwise_count(fps[window] ^ self.fps[item]) <= radius
        return window[close], item[close]


class Benchmark:
    def __init__(self, items: list[tuple[object, str]], shingle: int, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.sized: dict[tuple[int, int], Sized] = defaultdict(Sized)
        known = defaultdict(list)
        for key, text in items:
            hashes = Words(text or "", digits=True).hashes()
            if len(hashes):
                width = min(shingle, len(hashes))
                own = shingles(hashes, width)
                group = self.sized[width, len(own)]
                group.ids.append(key)
                group.bags.append(np.unique(own, return_counts=True))
                group.prints.append(int(pack(signs(own).sum(0)[None])[0]))
                known[width].append(own)
        self.known = {w: np.unique(np.concatenate(x)) for w, x in known.items()}
        self.filters = {}
        for w, x in self.known.items():
            self.filters[w] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[w][x >> np.uint64(64 - FILTER_BITS)] = True
        for group in self.sized.values():
            group.index(radius)

    def hits(self, own: np.ndarray, width: int) -> np.ndarray:
        """Which shingles some item has."""
        out = self.filters[width][own >> np.uint64(64 - FILTER_BITS)]
        some = np.flatnonzero(out)
        out[some] = np.isin(own[some], self.known[width])
        return out

    def matches(self, own: np.ndarray, hit: np.ndarray, width: int) -> dict:
        """For one document's shingles: item -> (similarity, first word, differing bits) of its best window."""
        best: dict = {}
        count = np.r_[0, np.cumsum(hit)]
        some = np.flatnonzero(hit)
        for (w, n), group in self.sized.items():
            if w != width or len(own) < n:
                continue
            needed = np.ceil(2 * n * self.similarity / (1 + self.similarity) - 1e-9)
            lo, hi = max(0, some[0] - n + 1), min(len(own) - n, some[-1])
            at = np.arange(lo, hi + 1)
            at = at[count[at + n] - count[at] >= needed]
            for x in runs(at, n):
                a, b = x[0], x[-1] + n
                sums = np.r_[np.zeros((1, 64), np.int32), np.cumsum(signs(own[a:b]), axis=0, dtype=np.int32)]
                fps = pack(sums[x - a + n] - sums[x - a])
                for i, j in zip(*group.near(fps, self.radius), strict=True):
                    start = int(x[i])
                    same = shared(own[start : start + n], *group.bags[j])
                    alike = same / (2 * n - same)
                    if alike >= self.similarity and alike > best.get(group.ids[j], (0,))[0]:
                        best[group.ids[j]] = (alike, start, int(np.bitwise_count(fps[i] ^ group.fps[j])))
        return best

    def scan(self, texts: list[str]):
        """(text's index, item, similarity, first word, differing bits) over texts taken together."""
        words = Words("\n".join(texts), digits=True)
        hashes = words.hashes()
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), words.start, "right")
        for width in self.known:
            own = shingles(hashes, width)
            if not len(own):
                continue
            hit = self.hits(own, width) & (of[: len(own)] == of[width - 1 :])
            for i in np.unique(of[:-width + 1 or None][hit]) if hit.any() else ():
                a, b = np.searchsorted(of, [i, i + 1])
                part = slice(a, b - width + 1)
                for item, (alike, start, bits) in self.matches(own[part], hit[part], width).items():
                    yield int(i), item, alike, start, bits


def shared(window: np.ndarray, grams: np.ndarray, times: np.ndarray) -> int:
    """Sum of the smaller counts of a window's shingles and a bag."""
    at = np.minimum(np.searchsorted(grams, window), len(grams) - 1)
    found = np.bincount(at[grams[at] == window], minlength=len(grams))
    return int(np.minimum(found, times).sum())


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's (item, text) in blocks whose index takes about so many bytes, or one item."""
    block, size = [], 0
    for key, text in benchmark.select(item_col, item_text).toLocalIterator():
        own = ITEM_BYTES + BYTES_A_CHARACTER * len(text or "")
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += own
    if block:
        yield block


def runs(starts: np.ndarray, n: int, most: int = 4096) -> list[np.ndarray]:
    """Window starts in runs less than n apart, at most so many together."""
    parts = np.split(starts, np.flatnonzero(np.diff(starts) >= n) + 1) if len(starts) else []
    return [part[i : i + most] for part in parts for i in range(0, len(part), most)]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(id, item, similarity, start_word, bits): each document's best window for each item that it holds. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, similarity double, start_word long, bits int"
    out = spark.createDataFrame([], schema)
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text, index_bytes)):
        index = spark.sparkContext.broadcast(Benchmark(block, shingle, similarity, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=index) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                found = [(i + j, *x) for i, part in chunks(batch.column(1).to_pylist()) for j, *x in held.scan(part)]
                if found:
                    at, item, alike, start, bits = zip(*found, strict=True)
                    cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item), pa.array(alike), pa.array(start, pa.int64()), pa.array(bits, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "item", "similarity", "start_word", "bits"])

        one = rows.mapInArrow(run, schema)
        out = out.union(one) if k else one
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns, without a shuffle; one pass for each block of the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    for block in blocks_of(benchmark, item_col, item_text, INDEX_BYTES):
        index = spark.sparkContext.broadcast(Benchmark(block, SHINGLE, SIMILARITY, RADIUS))

        def run(batches: Iterator[pa.RecordBatch], shared=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {i + j for i, part in chunks(batch.column(at).to_pylist()) for j, *_ in shared.value.scan(part)}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)])) if found else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "start_word")
