"""Near copies by exact shingle similarity: SimHash links and MinHash bands propose pairs, shared shingles decide.

A first proposal comes from the pigeonring search over SimHash fingerprints (simhash.links, radius RADIUS). Pairs at similarity
0.8 differ in some 10 of 64 bits, where no index by segments selects, so what lies beyond the radius comes from MinHash: texts
that agree in one of BANDS bands of ROWS minima are a pair. Whatever proposed it, a pair is a link only if the whole sets
of shingles are as similar as wanted.

Equal texts are one node, named by their digest. What the proposals join are families, the components of a table of (text, a text of
its key). A family is held together in one task, all its pairs against each other as a matrix of shared shingles, and gives a forest of its
links. A family too large for one task is first held against its centre, the text with most shared keys; what that doesn't link is
then held against the whole family in blocks. So no pair is written out, no pair of a family is missed, and a large group of near
copies costs one test a text and a block for the few that are unlike the centre.

Only digests, keys and the shingle sets of texts in a family are shuffled or stored; texts stay where they are.

Defined results: texts without a word, null ones among them, are alike; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches, spill
from loomtext.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Of the SimHash proposal.
RADIUS = 4
#: Texts, and shingles of all of them together, that one task holds of one side.
TEXTS_A_BLOCK, SHINGLES_A_BLOCK = 1024, 2_000_000
#: A centre's set of shingles is held against so many others in one task; one with more partners is laid out several times.
PARTNERS = 256
#: Texts to be compared are picked by a broadcast list only when it was counted to be at most this long (16 bytes each).
BROADCAST_NODES = 200_000
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_ADD, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)
#: Shingles mixed at once.
_PART = 1 << 12
#: Shingles of a block whose matrix is laid out at once.
_COLUMNS = 1 << 12


def digest(text: Column) -> Column:
    """A text's node: 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def band_keys(grams: np.ndarray) -> list[int]:
    """One key a band, signed; texts without shingles share theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), _PART):
        mixed = (grams[lo : lo + _PART, None] ^ _ADD) * _TIMES
        least = np.minimum(least, mixed.min(0))
    digests = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _once(texts: DataFrame, schema: str, made) -> DataFrame:
    """made(shingle hashes' source text) -> values, for each text (node, text); a task gives each node once."""
    small_batches(texts.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    rows.append((node, *made(text or b"")))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return texts.select("node", "text").mapInArrow(run, schema)


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, fp, keys): SimHash fingerprint and band keys of each text."""
    from loomtext.llm.simhash import majority, shingle_hashes

    def made(text: bytes) -> tuple:
        grams = shingle_hashes(text, shingle)
        fp = majority(grams) if len(grams) else 0
        return fp - (fp >> 63 << 64), band_keys(grams)

    return _once(texts, "node binary, fp long, keys array<long>", made)


def shingle_sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sets of the texts named by nodes."""
    from loomtext.llm.simhash import shingle_hashes

    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    some = texts.join(nodes, "node", "left_semi")
    made = lambda text: (np.unique(shingle_hashes(text, shingle)).view(np.int64),)
    return _once(some, "node binary, grams array<long>", made).dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is as wanted; b may be the partner of very many."""
    load = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    left = pairs.join(load, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    right = load.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    shared = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - shared
    return left.join(right, ["b", "part"]).filter((whole == 0) | (shared >= F.lit(similarity) * whole - 1e-9)).select("a", "b")


def simhash_pairs(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) proposed by fingerprints: equal ones, and those that the pigeonring search links."""
    from loomtext.llm.simhash import links

    first = marks.groupBy("fp").agg(F.min("node").alias("first"))
    equal = marks.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(first.select("fp"), radius).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    crossing = near.join(first.select(F.col("fp").alias("fa"), F.col("first").alias("a")), "fa").join(first.select(F.col("fp").alias("fb"), F.col("first").alias("b")), "fb")
    return equal.filter("a <> b").union(crossing.select("a", "b"))


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that span the links between the sets numbered in left and those in right."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, gram = row[times[gram] > 1], gram[times[gram] > 1]
    gram = np.unique(gram, return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(gram.max(initial=-1)) + 1, _COLUMNS):
        a, b = np.searchsorted(gram, [lo, lo + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[a:b], gram[a:b] - lo] = 1
        shared += part[left] @ part[right].T
    whole = size[left][:, None] + size[right][None, :] - shared
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(left, right)] = (shared >= similarity * whole - 1e-9) | (whole == 0)
    near |= near.T
    edges, fresh = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if fresh[start]:
            fresh[start], todo = False, [start]
            while todo:
                at = todo.pop()
                found = np.flatnonzero(near[at] & fresh)
                fresh[found] = False
                edges += [(at, int(x)) for x in found]
                todo += found.tolist()
    return edges


def linked(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a forest of the links of each cell, a table of (family, cell, side, node, grams): side 0 is held against side 1, side 2 against all."""

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        flat = cell.column("grams").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False)
        sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        edges = forest(sets, np.flatnonzero(side != 1), np.flatnonzero(side != 0), similarity)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        nodes = cell.column("node").combine_chunks()
        return pa.Table.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    return cells.groupBy("family", "cell").applyInArrow(run, "a binary, b binary").filter("a <> b")


def near_copy_roots(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = TEXTS_A_BLOCK) -> DataFrame:
    """(node, root) for every text (by its digest) that has a near copy."""
    texts = df.select(digest(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    marks = spill(sketches(texts, shingle), "sketches")
    keyed = marks.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key", "first")
    members = spill(keyed.join(shared, "key").select("node", "key", "first"), "members")
    proposed = members.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).union(simhash_pairs(marks)).distinct()
    families = spill(components(proposed).select("node", F.col("root").alias("family")), "families")
    sets = spill(shingle_sets(texts, families.select("node"), shingle), "shingles")
    held = spill(sets.join(families, "node").select("family", "node", F.size("grams").alias("size")), "held")
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / SHINGLES_A_BLOCK)).cast("int").alias("blocks"))
    sizes = spill(sizes, "sizes")
    small = families.join(sizes.filter("blocks <= 1").select("family"), "family")
    cells = small.select("family", "node", F.lit(0).alias("cell"), F.lit(2).alias("side"))
    large = sizes.filter("blocks > 1")
    links = None
    if not large.isEmpty():
        weights = members.groupBy("node").agg(F.count_distinct("key").alias("keys"))
        placed = spill(families.join(large, "family").join(weights, "node", "left").select("family", "blocks", "node", F.coalesce("keys", F.lit(0)).alias("keys")), "large")
        centres = placed.groupBy("family").agg(F.max(F.struct("keys", "node"))["node"].alias("centre"))
        pairs = placed.join(centres, "family").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        links = spill(similar(pairs.filter("a <> b"), sets, similarity), "links")
        done = links.select(F.col("a").alias("node")).union(centres.select("centre"))
        odd = spill(placed.join(done, "node", "left_anti"), "odd")
        parts = odd.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("odd_blocks"))
        mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = odd.join(parts, "family").withColumn("j", numbers("blocks")).withColumn("i", mine("odd_blocks"))
        right = placed.join(parts, "family").withColumn("i", numbers("odd_blocks")).withColumn("j", mine("blocks"))
        each = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        cells = cells.unionByName(each.select("family", "node", (F.col("i") * F.col("blocks") + F.col("j")).alias("cell"), "side"))
    found = spill(linked(cells.join(sets, "node").select("family", "cell", "side", "node", "grams"), similarity), "links")
    return spill(components(found if links is None else found.union(links)), "roots")
