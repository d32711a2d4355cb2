"""Language of words in (code-switched) text by a linear-chain conditional random field.

A word's emission scores add learned weights of its bigrams and trigrams, of its affixes (n-grams that hold the word's
edge, and its last three letters) and of its entry in the lexicon (whole words seen in training). Learned transitions
join neighbouring words. Forward-backward gives each word's exact label probabilities; a document's language is the
label with the largest mean probability.

Training takes a bounded sample of labelled rows (SAMPLE_A_LABEL documents of each label, about, of at most TRAIN_BYTES each), cuts it into word
sequences, splices half of them from several documents so that switches occur, and climbs the log-likelihood.
Prediction reads whole texts and only the text. Every label is learned; the model takes about 1 MB for each.

Defined results: null text or text without a letter: `und`, score 0; a table without labels: `und` for all; null ids
are kept and aren't held out; repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.llm.common import small_batches, table
from loomtext.llm.vector_text import Words, chunks

UNKNOWN = "und"
#: About so many documents of each label are sampled for training, by hash.
SAMPLE_A_LABEL = 120
#: Longer texts (in bytes) aren't drawn for training, which bounds what the driver holds; they are predicted like any other.
TRAIN_BYTES = 1 << 20
NGRAM_BITS, LEXICON_BITS = 15, 17
EPOCHS, SEQUENCE, MINIBATCH, RATE = 3, 48, 64, 0.25
#: Words of a block of the exact block-wise forward-backward pass.
BLOCK = 32
#: A text longer than this is scored in pieces cut between words; its words are still one chain.
PIECE = 1 << 19

_A, _B = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _B) >> np.uint64(64 - bits)).astype(np.int64)


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Feature tables' rows: [(row numbers, where each word's begin; None: one a word)], over one weight matrix."""
    chars, first, size = words.chars.astype(np.uint64) + np.uint64(2), words.first, words.size
    edge = np.uint64(1)
    before = np.empty_like(chars)
    before[1:] = chars[:-1]
    before[first] = edge
    two = np.empty_like(chars)
    two[1:] = before[:-1]
    two[first] = edge
    last = first + size - 1
    grams = 1 << NGRAM_BITS
    bi = before * _A + chars
    tri = (two * _A + before) * _A + chars
    suffix = tri[last] * _A + edge
    end = bi[last] * _A + edge + np.uint64(7)
    return [
        (_bucket(bi, NGRAM_BITS), first),
        (_bucket(tri + np.uint64(3), NGRAM_BITS) + grams, first),
        (_bucket(suffix, NGRAM_BITS) + 2 * grams, None),
        (_bucket(end, NGRAM_BITS) + 3 * grams, None),
        (_bucket(words.hashes(), LEXICON_BITS) + 4 * grams, None),
    ]


ROWS = 4 * (1 << NGRAM_BITS) + (1 << LEXICON_BITS)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # ROWS x labels
    moves: np.ndarray  # labels x labels, log scale

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.zeros((len(words.first), len(self.labels)), np.float32)
        for rows, begins in features(words):
            scores = self.weights[rows]
            out += scores if begins is None else np.add.reduceat(scores, begins, axis=0)
        return out

    def posteriors(self, emissions: np.ndarray, counts: np.ndarray, steps: bool = False):
        """Label probabilities of each word; counts: words of each text, each text a chain of its own.

        With steps, also those given only the words up to it.

        Exact: chains are cut into blocks; each block's transfer matrix is built for all blocks at once, messages pass
        along a chain block by block, and then through all blocks at once.
        """
        k = len(self.labels)
        n = len(emissions)
        if not n:
            return np.zeros((0, k), np.float32)
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        local = np.exp(emissions - emissions.max(1, keepdims=True))
        blocks = -(-counts // BLOCK)
        text_of = np.repeat(np.arange(len(counts)), blocks)
        rank = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(counts) - counts)[text_of] + rank * BLOCK
        size = np.minimum(BLOCK, counts[text_of] - rank * BLOCK)
        place = np.minimum(start[:, None] + np.arange(BLOCK), n - 1)
        real = np.arange(BLOCK) < size[:, None]
        through = np.broadcast_to(np.eye(k, dtype=np.float32), (len(start), k, k)).copy()
        for t in range(BLOCK):
            step = (through.reshape(-1, k) @ move).reshape(-1, k, k) * local[place[:, t]][:, None, :]
            step /= step.max((1, 2), keepdims=True)
            through = np.where(real[:, t, None, None], step, through)
        into, out_of = np.full((len(start), k), 1 / k, np.float32), np.ones((len(start), k), np.float32)
        order = np.argsort(rank, kind="stable")
        ranks = np.searchsorted(rank[order], np.arange(rank.max() + 2))
        last = rank == blocks[text_of] - 1
        for r in range(1, rank.max() + 1):
            b = order[ranks[r] : ranks[r + 1]]
            v = np.einsum("bi,bij->bj", into[b - 1], through[b - 1])
            into[b] = v / v.sum(1, keepdims=True)
        for r in range(rank.max() - 1, -1, -1):
            b = order[ranks[r] : ranks[r + 1]]
            b = b[~last[b]]
            v = np.einsum("bij,bj->bi", through[b + 1], out_of[b + 1])
            out_of[b] = v / v.sum(1, keepdims=True)
        ahead = np.empty((len(start), BLOCK, k), np.float32)
        v = into
        for t in range(BLOCK):
            step = (v @ move) * local[place[:, t]]
            v = np.where(real[:, t, None], step / step.sum(1, keepdims=True), v)
            ahead[:, t] = v
        forward = ahead[real] if steps else None
        v = out_of
        for t in range(BLOCK - 1, -1, -1):
            ahead[:, t] *= v
            step = (v * local[place[:, t]]) @ move.T
            v = np.where(real[:, t, None], step / step.sum(1, keepdims=True), v)
        both = ahead[real]
        both /= both.sum(1, keepdims=True)
        return (both, forward) if steps else both

    def read(self, text: str) -> tuple[Words | None, np.ndarray]:
        """Emissions of all words of a text, piece by piece if it is long."""
        if len(text) <= PIECE:
            words = Words(text)
            return words, self.emissions(words)
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end].isalpha() and text[end - 1].isalpha():
                end += 1
            parts.append(self.emissions(Words(text[at:end])))
            at = end
        return None, np.concatenate(parts)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For texts taken together: label (-1: no letter) and score of each."""
        counts = np.zeros(len(texts), np.int64)
        if len(texts) == 1:
            scores = self.read(texts[0])[1]
            counts[0] = len(scores)
        else:
            words = Words("\n".join(texts))
            ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
            counts += np.bincount(np.searchsorted(ends, words.start, "right"), minlength=len(texts))[: len(texts)]
            scores = self.emissions(words)
        found = self.posteriors(scores, counts)
        some = np.flatnonzero(counts)
        label, score = np.full(len(texts), -1), np.zeros(len(texts))
        if len(some):
            mean = np.add.reduceat(found.astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
            label[some] = mean.argmax(1)
            score[some] = mean.max(1).clip(0, 1)
        return label, score

    def words(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, probability) of each word, offsets in code points."""
        words = Words(text)
        found = self.posteriors(self.emissions(words), np.array([len(words.first)]))
        best = found.argmax(1)
        return [(int(s), int(s + n), self.labels[b], float(p[b])) for s, n, b, p in zip(words.start, words.size, best, found, strict=True)]


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> Crf | None:
    """Stochastic gradient ascent (with per-weight step sizes) on the log-likelihood of labelled word sequences."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    docs = [(w, labels.index(x)) for t, x in zip(texts, langs, strict=True) if (w := t.split())]
    if not docs:
        return None
    sequences = []
    for words, y in docs:  # whole texts; every second stretch is spliced with stretches of other documents
        for i in range(0, len(words), SEQUENCE):
            part = [(w, y) for w in words[i : i + SEQUENCE]]
            if len(sequences) % 2:
                cut = int(rng.integers(1, len(part) + 1))
                other, z = docs[int(rng.integers(len(docs)))]
                j = int(rng.integers(len(other)))
                part = part[:cut] + [(w, z) for w in other[j : j + SEQUENCE - cut]]
            sequences.append(part)
    k = len(labels)
    weights, moves = np.zeros((ROWS, k), np.float32), np.zeros((k, k))
    seen, seen_moves = np.full((ROWS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), MINIBATCH):
            batch = [sequences[i] for i in order[at : at + MINIBATCH]]
            marked = Words(" ".join(w for s in batch for w, _ in s))
            spaces = np.cumsum([0] + [len(w) + 1 for s in batch for w, _ in s])
            of = np.searchsorted(spaces, marked.start, "right") - 1  # a token may hold several words, or none
            y = np.array([y for s in batch for _, y in s])[of]
            chain = np.repeat(np.arange(len(batch)), [len(s) for s in batch])[of]
            if not len(y):
                continue
            crf = Crf(labels, weights, moves)
            found, forward = crf.posteriors(crf.emissions(marked), np.bincount(chain, minlength=len(batch)), steps=True)
            grad = -found
            grad[np.arange(len(y)), y] += 1
            for rows, begins in features(marked):
                g = grad if begins is None else np.repeat(grad, marked.size, axis=0)
                touched, where = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(where, g[:, j], len(touched)) for j in range(k)], 1)
                seen[touched] += step**2
                weights[touched] += RATE * step / np.sqrt(seen[touched])
            inside = np.flatnonzero(chain[1:] == chain[:-1]) + 1
            before, move = forward[inside - 1].astype(np.float64), np.exp(moves)
            joint = before[:, :, None] * move[None] * (found[inside] / (before @ move))[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            step = np.bincount(y[inside - 1] * k + y[inside], minlength=k * k).reshape(k, k) - joint.sum(0)
            seen_moves += step**2
            moves += RATE * step / np.sqrt(seen_moves)
            moves = np.clip(moves, -8, 8)
    return Crf(labels, weights, moves)


def held_out(doc_id):
    """Column: the rows that training never sees (remainder 2 of the id's CRC-32 by 4)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, sample: int = SAMPLE_A_LABEL) -> Crf | None:
    """Train on about `sample` texts of each label, chosen by a hash; columns text and lang. None without labels.

    Copies of a text count once, so that a large group of them neither fills the sample nor thins out its label.
    """
    labelled = df.filter("text is not null and lang is not null").filter(F.octet_length("text") <= TRAIN_BYTES)
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("text").alias("texts"))
    sizes = counted.orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], sample / max(1, r["texts"]))])
    drawn = F.pmod(F.xxhash64(F.lit("train"), "text"), F.lit(1_000_003)) / 1_000_003
    rows = labelled.select("text", "lang").filter(drawn < F.try_element_at(share, F.col("lang"))).dropDuplicates()
    rows = rows.orderBy(F.xxhash64("text"), "text", "lang").limit(4 * sample * len(sizes)).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(df: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """Every row with lang_pred and score (columns of these names are replaced); only the text is read for it. No shuffle."""
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            label, score = np.full(len(texts), -1), np.zeros(len(texts))
            for i, part in chunks(texts) if crf else ():
                label[i : i + len(part)], score[i : i + len(part)] = crf.documents(part)
            names = [crf.labels[x] if x >= 0 else UNKNOWN for x in label] if crf else [UNKNOWN] * len(texts)
            cols = [*batch.columns, pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields]))


def label_words(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, probability) of every word, offsets in code points."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = shared.value.words(text) if text else []
                if rows:
                    start, end, lang, p = zip(*rows, strict=True)
                    cols = [pa.array([key.as_py()] * len(rows), key.type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(lang), pa.array(p)]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "start", "end", "lang", "probability"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, end long, lang string, probability double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter("not held_out and doc_id is not null"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
