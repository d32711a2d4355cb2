"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. The corpus is split so that equal strings
always meet and nothing else has to:

1. Texts are taken once each (their copies are covered whole) and kept in a table bucketed by the text's digest.
2. The anchor of a string is its GRAM-byte substring of least hash, the leftmost among equals. Equal strings have equal
   anchors, so strings are dealt by anchor: an anchor's segment holds all its strings. Segments seen twice (by a 128-bit digest)
   are repeated throughout; anchors with one segment need no more; the rest goes on, with its bytes.
3. Segments, whole anchors together, form blocks of bounded size, so many a task as their bytes ask for. In a block's Burrows-Wheeler transform, intervals of
   rows are extended backward breadth-first: each level derives the common prefixes of one more byte, by increasing value, and
   the work stops at LENGTH. Rows whose common prefix got no value share LENGTH bytes or more.
4. An anchor with more segments than a block holds (a passage in very many surroundings) is split exactly: its strings are
   dealt by their own 128-bit hash over all tasks and counted.

Defined results: null text: as an empty one; texts shorter than LENGTH lose nothing; equal texts of LENGTH or more lose
everything; repeated rows and null ids are kept, each with its result; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import remove, scratch_path, small_batches, spill, table

LENGTH, GRAM = 400, 150
#: Bytes of a block that is transformed at once; an anchor with more is split.
BLOCK = 1 << 20
#: Blocks of a task, about.
BLOCKS_A_TASK, MOST_TASKS = 6, 20_000
#: Strings of a text are anchored so many at a time.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, PIECE + 4 * LENGTH)
_BACK = _powers(pow(_BASE, -1, 1 << 64), PIECE + 4 * LENGTH)


def window_hashes(data: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """A mixed 64-bit hash of each run of `width` bytes."""
    n = len(data) - width + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(salt)) * _UP[: len(data)], out=sums[1:])
    x = (sums[width:] - sums[:n]) * _BACK[:n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values, from running minima of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor's hash, first string, number of strings) of each run of strings that share an anchor."""
    data = np.frombuffer(text, np.uint8)
    for lo in range(0, len(data) - length + 1, PIECE):
        part = data[lo : lo + PIECE + length - 1]
        hashes = window_hashes(part, gram)
        least = sliding_least(hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield hashes[place[first]], first + lo, np.diff(np.r_[first, len(place)])


def suffix_order(symbols: np.ndarray, single: np.ndarray, depth: int) -> np.ndarray:
    """Rows in order of their first `depth` symbols or more, by doubling; only rows not yet told apart are sorted again.

    single: symbols unlike any other (end marks).
    """
    n = len(symbols)
    packed, has = np.zeros(n, np.int64), np.zeros(n, bool)
    padded, ends = np.r_[symbols, np.zeros(7, symbols.dtype)], np.r_[single, np.ones(7, bool)]
    for i in range(7):
        packed = packed << 9 | np.where(has, 0, padded[i : i + n]).astype(np.int64)
        has |= ends[i : i + n]
    order = np.argsort(packed, kind="stable")  # end marks rank by place
    key = packed[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | has[order][1:]]
    rank = np.empty(n, np.int64)  # a suffix's rank is the first row of those not told apart from it
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    k = 7
    while k < depth:
        rows = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])  # rows of more than one suffix
        if not len(rows):
            break
        at = order[rows]
        key = rank[at] * n + rank[np.minimum(at + k, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at
        apart = np.r_[True, key[1:] != key[:-1]]
        fresh[rows] |= apart
        rank[at] = np.maximum.accumulate(np.where(apart, rows, 0))
        k *= 2
    return order


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For the parts laid end to end (each followed by an end mark of its own): does the string that starts here start elsewhere too?

    Breadth-first backward extension: the interval of rows of a string w, extended by each symbol c before it, is the interval of cw;
    where an interval of strings of d + 1 symbols ends, the common prefix with the next row is d, unless it was found to be shorter before.
    """
    lengths = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int32) + 1
    marks = np.cumsum(lengths + 1) - 1
    single = np.zeros(len(data), bool)
    single[marks] = True
    data[marks] = 0
    n = len(data)
    order = suffix_order(data, single, length + 1).astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    symbols = data.copy()
    symbols[marks] = 257 + np.arange(len(marks))  # end marks differ from each other
    lead = symbols[order]  # first symbol of each row
    back = place[order - 1]  # the row of the string one symbol longer: the transform's last-to-first step
    prefix = np.full(n + 1, -1, np.int16)
    owner = np.full(n + 1, -1, np.int32)
    first, end, lone = np.array([0]), np.array([n]), np.zeros(0, np.int64)
    prefix[0] = prefix[n] = 0
    for level in range(length):
        size = end - first
        to = back[_ranges(first, size)].astype(np.int64)
        of = np.repeat(np.arange(len(first), dtype=np.int32), size)
        owner[to] = of
        after = np.minimum(to + 1, n - 1)
        ends = (to == n - 1) | (owner[after] != of) | (lead[after] != lead[to])
        before = np.maximum(to - 1, 0)
        begins = (to == 0) | (owner[before] != of) | (lead[before] != lead[to])
        owner[to] = -1
        first, end = np.sort(to[begins]), np.sort(to[ends]) + 1
        lone = back[lone].astype(np.int64)  # intervals of one row stay so
        lone = lone[prefix[lone + 1] < 0]
        new = (prefix[end] < 0) | ((end == n) & (level == 0))
        first, end = first[new], end[new]
        prefix[end] = prefix[lone + 1] = level
        one = end - first == 1
        lone = np.r_[lone, first[one]]
        first, end = first[~one], end[~one]
        if not len(first) and not len(lone):
            break
    shared = prefix < 0
    out = np.zeros(n, bool)
    out[order] = shared[:-1] | shared[1:]
    return out


@contextmanager
def _distinct(docs: DataFrame) -> Iterator[DataFrame]:
    """(key, text, copies): each text once, bucketed by key, so that joins leave the texts where they are; gone afterwards."""
    spark = docs.sparkSession
    name, path = f"loomtext_texts_{uuid.uuid4().hex}", scratch_path(spark, "texts")
    once = docs.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    once.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # of the catalog only; what the table's path holds goes now
        remove(spark, path)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))


def _rows(docs: DataFrame) -> DataFrame:
    return spill(docs.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "rows")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(id, key, n_bytes, copies, spans): each row's removed spans (start, end) in bytes, sorted, possibly overlapping; with
    copies > 1 and n_bytes >= length the whole text is removed. key: the text's MD5."""
    docs = _docs(df, id_col, text_col)
    with _distinct(docs) as texts:
        found = spill(texts.select("key", "copies").join(_found(texts, length, gram, block), "key", "left"), "spans")
    return _rows(docs).join(found, "key")


def _found(texts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """(key, spans) of the texts with a removed span of their own."""
    if not 0 < gram <= length:
        raise ValueError("the anchor lies within the string")

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            of, segments, cols = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                for hashes, first, count in anchors(text, length, gram):
                    segments += [digest(text[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]
                    of += [i] * len(first)
                    cols.append((hashes.view(np.int64), first.astype(np.int64), count.astype(np.int32)))
            if cols:
                hashes, first, count = (pa.array(np.concatenate(c)) for c in zip(*cols, strict=True))
                parts = [batch.column(0).take(pa.array(of, pa.int64())), hashes, pa.array(segments, pa.binary()), first, count]
                yield pa.RecordBatch.from_arrays(parts, ["key", "anchor", "segment", "first", "count"])

    long_texts = texts.filter(F.octet_length("text") >= length).select("key", "text")
    placed = spill(long_texts.mapInArrow(anchor, "key binary, anchor long, segment binary, first long, count int"), "anchors")
    groups = spill(
        placed.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first")).alias("at"), F.first("count").alias("count")), "segments"
    )
    several = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("count") + length).alias("bytes")).filter("n_segments > 1")
    rivals = groups.join(several, "anchor").select("anchor", "segment", F.col("at.key").alias("key"), F.col("at.first").alias("first"), "count", (F.col("bytes") > block).alias("large"))
    wanted = rivals.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "first", "count", "large")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted_here in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = [text[w["first"] : w["first"] + w["count"] + length - 1] for w in wanted_here]
                cols = [pa.array([w[c] for w in wanted_here], k) for c, k in (("anchor", pa.int64()), ("segment", pa.binary()), ("large", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], ["anchor", "segment", "large", "data"])

    segments = spill(texts.join(wanted, "key").select("text", "wanted").mapInArrow(cut, "anchor long, segment binary, large boolean, data binary"), "rivals")
    schema = "anchor long, segment binary, start int, stop int"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block and row[0] != held[-1][0]:
                    yield from transformed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from transformed(held)

    def transformed(held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        shared = repeated_starts([data for *_, data in held], length)
        edges = np.diff(np.r_[0, shared.astype(np.int8), 0])
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # end marks are never shared, so runs lie in one part
        ends = np.cumsum([len(data) + 1 for *_, data in held])
        of = np.searchsorted(ends, start, "right")
        base = np.r_[0, ends[:-1]][of]
        names = [pa.array([row[j] for row in held], k).take(pa.array(of)) for j, k in ((0, pa.int64()), (1, pa.binary()))]
        places = [pa.array((x - base).astype(np.int32)) for x in (start, stop)]
        yield pa.RecordBatch.from_arrays([*names, *places], schema.replace(",", "").split()[::2])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor_of, segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, np.uint8)
                # Hashes of sums can collide together, whatever their base; the other half of the key is a hash of another kind.
                one = window_hashes(x, length).view(np.int64)
                two = np.array([xxhash.xxh64_intdigest(data[i : i + length]) for i in range(len(one))], np.uint64).view(np.int64)
                n = len(one)
                cols = [pa.array(np.full(n, anchor_of)), pa.array([segment] * n, pa.binary()), *map(pa.array, (np.arange(n, dtype=np.int32), one, two))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "segment", "start", "one", "two"])

    small = segments.filter("not large").select("anchor", "segment", "data")
    whole = small.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    dealt = small.repartition(min(MOST_TASKS, 1 + whole // (BLOCKS_A_TASK * block)), "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(expand, schema)
    strings = segments.filter("large").select("anchor", "segment", "data").mapInArrow(spell, "anchor long, segment binary, start int, one long, two long")
    again = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    single = strings.join(again, ["one", "two"]).select("anchor", "segment", "start", (F.col("start") + 1).alias("stop"))
    same = groups.filter("n > 1").select("anchor", "segment", F.lit(0).alias("start"), F.col("count").alias("stop"))
    runs = spill(found.union(single).union(same), "runs")
    starts = placed.join(runs, ["anchor", "segment"]).select("key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop") + length - 1).alias("end"))
    return starts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_spans(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, bytes kept) of sorted spans."""
    kept, at, removed, runs = [], 0, 0, 0
    for s in spans or ():
        start, end = s["start"], s["end"]
        if end <= at and runs:
            continue
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        removed += end - max(start, at)
        at = end
    kept.append(text[at:])
    return removed, runs, b"".join(kept)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and `kept` (binary) if asked for."""
    docs = _docs(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, found_here in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                whole = copies > 1 and len(text) >= length
                removed, n, kept = (len(text), 1, b"") if whole else remove_spans(text, found_here)
                out.append((removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if kept_bytes else [])))
            kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if kept_bytes else [])]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["key", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept_bytes else [])]
    schema = "key binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    with _distinct(docs) as texts:
        spans = _found(texts, length, gram, block)
        done = spill(texts.join(spans, "key", "left").select("key", "text", "copies", "spans").mapInArrow(run, schema), "kept")
    return _rows(docs).join(done, "key").drop("key")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
