"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

An agenda of candidate merges, best score first, leftmost first among equals, builds a unit (blanks and the letters up
to the next blank) from characters to pieces. Each candidate is skipped with probability `dropout`, decided by a hash
keyed by seed, the text's own hash, the unit's number in the text and the candidate's number in the unit: each occurrence of a
word is dealt its own skips, the same text always gives the same segmentation, and any segmentation decodes to the same
text. Without dropout the pieces are those of the model's own encoder.

The agendas of many short units are worked off side by side, one candidate of each at a time. Workers remember only what no key
decides: a unit's pieces without a skip, which are those of each occurrence that is dealt none.

What the vocabulary lacks, and the blank mark itself where a text holds it, becomes byte pieces, so that every text
comes back exactly; nothing is normalised.

Defined results: null text: null ids and null text; empty text: no ids; repeated rows: equal ids; an empty table gives
an empty result; columns with the names of the results are replaced, others left alone.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.llm.common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
DROPOUT, SEED = 0.1, 17
#: Units that a worker remembers; beyond that it starts anew.
REMEMBER = 400_000
#: Longer units aren't remembered, and each has its own agenda, a heap.
LONG_UNIT = 32
#: Units dealt with together.
TOGETHER = 1 << 16
#: Candidates of a long unit whose skips are drawn at once.
DRAW = 4096
_STEP, _NEVER = 0x9E3779B97F4A7C15, 1 << 62
_PLACE = (1 << 40) - 1
_NONE = np.int32(1 << 30)
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.r_[self.held, np.zeros_like(self.held)]
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Pieces:
    """A model's pieces and the two directions."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        if not 0 <= dropout <= 1:
            raise ValueError("dropout is a probability")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        by_score = sorted(plain, key=lambda i: -model.get_score(i))
        self.order = {model.id_to_piece(i): r for r, i in enumerate(by_score) if 1 < len(model.id_to_piece(i)) < 256}
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.byte_ids = np.array(self.bytes, np.int32)
        self.symbols()
        self.skip = np.uint64(int(dropout * (1 << 53)))
        self.seed = seed & 0xFFFFFFFFFFFFFFFF
        self.forget()

    def symbols(self) -> None:
        """Numbers for what an agenda joins (pieces, better scores first, and characters), and a hash table of each pair's piece."""
        chars = sorted({c for p in self.order for c in p} | {p for p in self.ids if len(p) == 1})
        names = [*self.order, *chars]
        number = {p: i for i, p in enumerate(names)}
        self.id_of = np.array([self.ids.get(p, -1) for p in names], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in chars]] = np.arange(len(self.order), len(names))
        pairs = {}
        for p, i in number.items():
            for k in range(1, len(p)):
                left, right = number.get(p[:k]), number.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        keys, made = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.shift = np.uint64(64 - max(4, int(4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.pair, self.pair_to = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        at = self.slot(keys)
        while len(keys):  # those that find their slot free and come first there stay
            free = self.pair[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            stay = free & first
            self.pair[at[stay]], self.pair_to[at[stay]] = keys[stay], made[stay]
            keys, made, at = keys[~stay], made[~stay], (at[~stay] + 1) & (size - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(_STEP)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol of each pair, or _NONE. A negative symbol is a character that no piece has."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        at = self.slot(key)
        found = self.pair[at]
        out = np.where(found == key, self.pair_to[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at = (at[open_] + 1) & (len(self.pair) - 1) if len(at) != len(open_) else (at + 1) & (len(self.pair) - 1)
            found = self.pair[at]
            hit = found == key[open_]
            out[open_[hit]] = self.pair_to[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return out.reshape(shape)

    def forget(self) -> None:
        """Start with no known unit; number 0 is the blank mark of a text."""
        self.known: dict[str, int] = {"": 0}
        self.count, self.first, self.size, self.pool = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.int32)
        self.count.add([0])
        self.stored(self.byte_ids[list(BLANK.encode())], np.array([len(BLANK.encode())]))

    def stored(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first.add(self.pool.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.pool.add(ids)

    def skipped(self, base: np.ndarray, unit: np.ndarray, candidate: np.ndarray | int) -> np.ndarray:
        """Is a candidate of a text's unit skipped? base: the text's, from base_of()."""
        x = base + ((unit.astype(np.uint64) << np.uint64(32)) + np.uint64(1) + np.asarray(candidate, np.uint64)) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)) < self.skip

    def base_of(self, key: int) -> np.uint64:
        return np.uint64(xxhash.xxh64_intdigest((key & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), self.seed))

    def skips(self, base: np.uint64, unit: int) -> Iterator[int]:
        """The numbers of a unit's skipped candidates, ascending, without end."""
        if not self.skip:
            yield _NEVER
        for lo in range(0, _NEVER, DRAW):
            yield from (np.flatnonzero(self.skipped(base, np.full(DRAW, unit), np.arange(lo, lo + DRAW))) + lo).tolist()

    def merge_short(self, units: list[str], base: np.ndarray | None = None, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, how many are each unit's, candidates of each, was one skipped) of short units, with the skips of texts with base and the unit's number there."""
        length = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(length) - length
        counts, sizes, dealt = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        parts = [None] * 4
        for group, (low, high) in enumerate(((0, 4), (4, 8), (8, 16), (16, LONG_UNIT))):
            rows = np.flatnonzero((length > low) & (length <= high))
            at = starts[rows][:, None] + np.arange(high)
            real = np.arange(high) < length[rows][:, None]
            point = np.where(real, points[np.minimum(at, len(points) - 1)], 0)
            symbol = np.where(real, self.symbol_of[point], -1)
            symbol = np.where(real & (symbol < 0), -2 - point, symbol).astype(np.int32)  # below -1: a character without a piece
            symbol, counts[rows], dealt[rows] = self.agenda(symbol, None if base is None else base[rows], None if base is None else number[rows])
            flat = symbol[symbol != -1]
            ids = np.where(flat >= 0, self.id_of[np.maximum(flat, 0)], -1)
            own = (symbol != -1).sum(1)
            if (ids < 0).any():
                ids, own = self.with_bytes(flat, ids, own, points_of=point)
            sizes[rows] = own
            parts[group] = rows, ids
        out = np.empty(int(sizes.sum()), np.int32)
        place = np.cumsum(sizes) - sizes
        for rows, ids in parts:
            n = sizes[rows]
            out[np.repeat(place[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes, counts, dealt

    def with_bytes(self, flat: np.ndarray, ids: np.ndarray, own: np.ndarray, points_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the bytes of characters that have no piece."""
        names = np.full(len(flat), 0, np.int64)
        lost = np.flatnonzero(ids < 0)
        single = {int(self.symbol_of[c]): c for c in np.unique(points_of).tolist() if self.symbol_of[c] >= 0}
        names[lost] = [-2 - x if x < 0 else single[x] for x in flat[lost].tolist()]
        size = np.ones(len(flat), np.int64)
        size[lost] = 1 + (names[lost] > 0x7F) + (names[lost] > 0x7FF) + (names[lost] > 0xFFFF)
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = self.byte_ids[np.frombuffer("".join(map(chr, names[lost].tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
        row = np.repeat(np.arange(len(own)), own)
        return out, np.bincount(row, size, len(own)).astype(np.int64)

    def agenda(self, symbol: np.ndarray, base: np.ndarray | None, number: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of symbols (-1: none) when no candidate is left, how many candidates came up in each row, and whether one was skipped.

        A pair's candidate is known by the symbol that it makes: the smaller, the better its score.
        """
        out, counts, dealt = symbol, np.zeros(len(symbol), np.int64), np.zeros(len(symbol), bool)
        if symbol.shape[1] < 2 or not len(symbol):
            return out, counts, dealt
        rows, made, column = np.arange(len(symbol)), self.joined(symbol[:, :-1], symbol[:, 1:]), np.arange(symbol.shape[1])
        for k in range(1 << 20):
            best = made.argmin(1)
            every = np.arange(len(rows))
            new = made[every, best]
            live = new < _NONE
            if not live.all():
                out[rows[~live]] = symbol[~live]
                counts[rows[~live]] = k
                rows, symbol, made, best, new = rows[live], symbol[live], made[live], best[live], new[live]
                every = every[: len(rows)]
            if not len(rows):
                return out, counts, dealt
            if base is not None and self.skip:
                gone = self.skipped(base[rows], number[rows], k)
                made[every[gone], best[gone]] = _NONE
                dealt[rows[gone]] = True
                at, best, new = every[~gone], best[~gone], new[~gone]
            else:
                at = every
            which = best[:, None]
            part = symbol[at]
            part[:, :-1] = np.where(column[:-1] > which, part[:, 1:], part[:, :-1])
            part[:, -1] = -1
            part[np.arange(len(at)), best] = new
            pairs = made[at]
            pairs[:, :-1] = np.where(column[:-2] > which, pairs[:, 1:], pairs[:, :-1])
            pairs[:, -1] = _NONE
            for side in (0, -1):  # the pairs of the new symbol: with the next one, and with the one before
                ok = np.flatnonzero((best + side >= 0) & (best + side < symbol.shape[1] - 1))
                place = best[ok] + side
                pairs[ok, place] = self.joined(part[ok, place], part[ok, place + 1])
            symbol[at], made[at] = part, pairs
        raise RuntimeError("an agenda ends")

    def merge_long(self, unit: str, skips: Iterator[int]) -> list[str]:
        """The pieces while the candidates numbered in `skips` are skipped. The agenda is a heap: n log n for units of any length."""
        n = len(unit)
        piece, order, count, skip = list(unit), self.order, 0, next(skips, _NEVER)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []  # numbers of score order, place and length of the merged piece
        for i in range(n - 1):
            if (r := order.get(unit[i : i + 2])) is not None:
                agenda.append(r << 48 | i << 8 | 2)
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            i = (entry >> 8) & _PLACE
            a, j = piece[i], after[i]
            if not a or j >= n or len(a) + len(b := piece[j]) != entry & 255:
                continue
            count += 1
            if count > skip:
                skip = next(skips, _NEVER)
                continue
            piece[i], piece[j] = a + b, ""
            a += b
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := order.get(a + piece[k])) is not None:
                    push(agenda, r << 48 | i << 8 | len(a) + len(piece[k]))
            h = before[i]
            if h >= 0 and (r := order.get(piece[h] + a)) is not None:
                push(agenda, r << 48 | h << 8 | len(piece[h]) + len(a))
        return [p for p in piece if p]

    def piece_ids(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.ids.get, pieces))
        if None in found:
            out = array("i")
            for p, i in zip(pieces, found, strict=True):
                out.extend([self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if i is None else (i,))
            found = out
        return np.array(found, np.int32)

    def learn(self, units: list[str], fresh: np.ndarray, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Remember the units marked fresh, none of which was dealt a skip."""
        rows = {units[i]: i for i in np.flatnonzero(fresh).tolist()}
        at = np.fromiter(rows.values(), np.int64, len(rows))
        self.known.update(zip(rows, range(self.first.n, self.first.n + len(rows)), strict=True))
        self.stored(ids[_ranges((np.cumsum(sizes) - sizes)[at], sizes[at])], sizes[at])
        self.count.add(counts[at])

    def segmented(self, units: list[str], base: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many are each unit's) of units whose texts have base and in which they have these numbers."""
        if len(self.known) > REMEMBER:
            self.forget()
        get = self.known.get
        which = np.array([get(u, -1) for u in units], np.int64)
        plain = which >= 0
        if self.skip:
            short = np.flatnonzero(plain)
            count, live = self.count.held[which[short]], np.arange(len(short))
            for k in range(int(count.max(initial=0))):
                live = live[count[live] > k]
                at = short[live]
                hit = self.skipped(base[at], number[at], k)
                plain[at[hit]] = False
                live = live[~hit]
        sizes = np.zeros(len(units), np.int64)
        known = np.flatnonzero(plain)
        sizes[known] = self.size.held[which[known]]
        length = np.array([len(u) for u in units], np.int64)
        dealt = np.flatnonzero(~plain & (length <= LONG_UNIT))
        mine = [units[i] for i in dealt.tolist()]
        dealt_ids, sizes[dealt], counts, skipped = self.merge_short(mine, base[dealt], number[dealt])
        self.learn(mine, (which[dealt] < 0) & ~skipped, dealt_ids, sizes[dealt], counts)
        long_units = np.flatnonzero(length > LONG_UNIT).tolist()
        long_ids = [self.piece_ids(self.merge_long(units[i], self.skips(base[i], int(number[i])))) for i in long_units]
        sizes[long_units] = [len(x) for x in long_ids]
        out, place = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        first = self.first.held[which[known]]
        out[_ranges(place[known], sizes[known])] = self.pool.held[_ranges(first, sizes[known])]
        out[_ranges(place[dealt], sizes[dealt])] = dealt_ids
        for i, ids in zip(long_units, long_ids, strict=True):
            out[place[i] : place[i] + len(ids)] = ids
        return out, sizes

    @staticmethod
    def split(text: str) -> Iterator[list[str]]:
        """A text's units, so many together; "" stands for a blank mark of the text itself."""
        for k, part in enumerate((" " + text).split(BLANK)):
            if k:
                yield [""]
            part = part.replace(" ", BLANK)
            if len(part) < TOGETHER:
                yield _UNIT.findall(part)
            else:
                found = _UNIT.finditer(part)
                while some := [m[0] for m in islice(found, TOGETHER)]:
                    yield some

    def encode_many(self, texts: list[str | None], keys: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many are each text's). keys: what decides the skips, by itself the text."""
        sizes, flat = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        units: list[str] = []
        runs: list[tuple[int, np.uint64, int, int]] = []  # text, its base, number of the first unit, units

        def flush() -> None:
            if not units:
                return
            n = np.array([r[3] for r in runs])
            base = np.repeat(np.array([r[1] for r in runs], np.uint64), n)
            number = np.repeat(np.array([r[2] for r in runs]) - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            ids, size = self.segmented(units, base, number)
            flat.append(ids)
            np.add.at(sizes, np.array([r[0] for r in runs]), np.add.reduceat(size, np.cumsum(n) - n))
            units.clear()
            runs.clear()

        for i, text in enumerate(texts):
            if text:
                base, number = self.base_of(self.key(text) if keys is None else keys[i]), 0
                for some in filter(None, self.split(text)):
                    runs.append((i, base, number, len(some)))
                    number += len(some)
                    units.extend(some)
                    if len(units) >= TOGETHER:
                        flush()
        flush()
        return np.concatenate(flat), sizes

    def encode(self, text: str, key: int | None = None) -> np.ndarray:
        return self.encode_many([text], None if key is None else [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")

    def key(self, text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


@lru_cache(4)
def _pieces(path: str, dropout: float, seed: int) -> Pieces:
    return Pieces(path, dropout, seed)


def encode(
    df: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, decoded: str | None = None
) -> DataFrame:
    """Every row with its pieces' ids; if `decoded` names a column, also with the text that those ids give back.

    Map-side, no shuffle. The model's path must be readable on every worker.
    """
    small_batches(df.sparkSession)
    df = df.drop(out, *([decoded] if decoded else []))
    at = df.columns.index(text_col)
    if not Path(model).is_file():
        raise FileNotFoundError(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _pieces(model, dropout, seed)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            flat, sizes = held.encode_many(texts)
            ends = np.cumsum(sizes)
            none = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat), mask=none)
            cols, names = [*batch.columns, ids], [*batch.schema.names, out]
            if decoded:
                back = [None if t is None else held.decode(flat[a:b]) for t, a, b in zip(texts, ends - sizes, ends, strict=True)]
                cols.append(pa.array(back, pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(cols, names)

    more = f"`{out}` array<int>" + (f", `{decoded}` string" if decoded else "")
    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(more).fields]))


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Every row with the text that its ids give."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _pieces(model, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else held.decode(np.array(x, np.int32)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` string").fields]))


def digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless) of rows with text, ids and decoded."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("ids", " ")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded"))
