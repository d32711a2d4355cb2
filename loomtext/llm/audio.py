"""Audio features of a media column: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

Media are 8-bit mono WAV files in a binary column. Samples are resampled by a rational factor with a windowed-sinc
filter split into its phases; frames overlap by half; log-mel energies are stored as fixed-shape tensors (CLIP frames by
MELS bands, the last one padded with the floor), each with its time span; energy segments open above a high level and
close below a low one. Long media are worked through in pieces whose borders change nothing.

Energies are stored to DECIMALS decimals of a natural logarithm (a half of 0.01 is 0.02 dB), far below what 8-bit samples resolve; with so
few different values Parquet's dictionaries hold them in a third of the space.

Defined results: null or empty media (or a WAV without samples) have no frame, tensor or segment; repeated rows get equal
results; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.llm.common import scratch_path, small_batches, spill, table

RATE, UP, DOWN = 8000, 3, 4
WINDOW, HOP, MELS, CLIP = 256, 128, 24, 64
TAPS = 16  # of each phase
FLOOR = 1e-6
DECIMALS = 2
OPEN_DB, CLOSE_DB = 0.5, -0.5  # against the medium's mean level
#: Frames worked on at once.
PIECE = 4096
PAD_TO, PAD = 192, 32
FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments"]
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as the samples of an 8-bit mono WAV file."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file: its data chunk."""
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return b""


@cache
def phases() -> np.ndarray:
    """UP rows of taps: the low-pass filter's phases."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def resampled_size(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Samples lo to hi of the resampled signal; x is 0 outside."""
    first = lo * DOWN // UP - TAPS + 1
    last = (hi - 1) * DOWN // UP + 1
    part = np.zeros(last - first, np.float32)
    a, b = max(first, 0), min(last, len(x))
    if b > a:
        part[a - first : b - first] = (x[a:b].astype(np.float32) - 128) / 128
    views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    at = np.arange(lo, hi) * DOWN
    out = np.empty(hi - lo, np.float32)
    for p in range(UP):
        mine = np.flatnonzero(at % UP == p)
        out[mine] = views[at[mine] // UP - TAPS + 1 - first] @ phases()[p]
    return out


@cache
def mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    edges = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    hz = 700 * (10 ** (edges / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)[:, None]
    rise, fall = (f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frames_of(n: int) -> int:
    size = resampled_size(n)
    return 0 if not n else max(1, 1 + (size - WINDOW) // HOP)


def frames(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Windowed frames lo to hi, a row each."""
    y = resample(x, lo * HOP, (hi - 1) * HOP + WINDOW)
    return np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Log-mel bands of frames lo to hi."""
    power = np.abs(np.fft.rfft(frames(x, lo, hi))).astype(np.float32) ** 2
    return np.round(np.log(power @ mel_bank() + FLOOR), DECIMALS).astype(np.float32)


def level(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Level (dB) of frames lo to hi."""
    return 10 * np.log10((frames(x, lo, hi) ** 2).mean(1) + FLOOR)


def segments(levels: np.ndarray) -> list[tuple[float, float]]:
    """Time spans from rising above the high level until falling below the low one."""
    if not len(levels):
        return []
    mark = np.where(levels >= levels.mean() + OPEN_DB, 1, np.where(levels < levels.mean() + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, (last >= 0) & (mark[last] == 1), False]
    change = np.flatnonzero(on[1:] != on[:-1])
    step, size = HOP * DOWN / UP / RATE, WINDOW * DOWN / UP / RATE
    return [(float(a * step), float((b - 1) * step + size)) for a, b in change.reshape(-1, 2)]


def clips(payload: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(tensors, first clip) piece by piece; tensors have shape (clips, CLIP, MELS)."""
    x = np.frombuffer(payload, np.uint8)
    total = frames_of(len(x))
    for lo in range(0, total, PIECE):
        mel = log_mel(x, lo, min(total, lo + PIECE))
        whole = np.full((-(-len(mel) // CLIP) * CLIP, MELS), np.round(np.float32(np.log(FLOOR)), DECIMALS), np.float32)
        whole[: len(mel)] = mel
        yield whole.reshape(-1, CLIP, MELS), lo // CLIP


def energy_segments(payload: bytes) -> list[tuple[float, float]]:
    """The energy segments of a whole payload."""
    x = np.frombuffer(payload, np.uint8)
    total = frames_of(len(x))
    return segments(np.concatenate([level(x, lo, min(total, lo + PIECE)) for lo in range(0, total, PIECE)])) if total else []


def span(clip: int, payload_bytes: int) -> tuple[float, float]:
    step = HOP * DOWN / UP / RATE
    frames = min(CLIP, frames_of(payload_bytes) - clip * CLIP)
    return clip * CLIP * step, (clip * CLIP + frames - 1) * step + WINDOW * DOWN / UP / RATE


def tensors(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, clip, start_s, end_s, tensor): one fixed-shape tensor a row, flat, row-major; see tensor_array()."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                payload = samples(media or b"")
                for found, first in clips(payload):
                    numbers = list(range(first, first + len(found)))
                    start, end = zip(*(span(c, len(payload)) for c in numbers), strict=True)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), CLIP * MELS).cast(pa.list_(pa.float32()))
                    cols = [pa.array([key.as_py()] * len(numbers), key.type), pa.array(numbers, pa.int32()), pa.array(start), pa.array(end), flat]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "clip", "start_s", "end_s", "tensor"])

    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, clip int, start_s double, end_s double, tensor array<float>")


def tensor_array(column: pa.ChunkedArray | pa.Array) -> pa.FixedShapeTensorArray:
    """The tensor column of an Arrow table as Arrow's fixed-shape tensors of CLIP x MELS."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = pa.FixedSizeListArray.from_arrays(flat.flatten(), CLIP * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (CLIP, MELS)), values)


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Every row without its media, with what is read back from them: the payload's and the file's digests, the number
    of frames, and the energy segments."""
    small_batches(df.sparkSession)
    df = df.drop(*FEATURES)
    at = df.columns.index(media_col)

    def one(media: bytes | None):
        media = media or b""
        payload = samples(media)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
            frames_of(len(payload)), energy_segments(payload),
        )

    more = StructType.fromDDL(
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "frames long, segments array<struct<start_s: double, end_s: double>>"
    )
    spans_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), spans_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column(at)]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            made = [pa.array([[{"start_s": a, "end_s": b} for a, b in x] for x in c] if t == spans_type else c, t) for c, t in zip(cols, types, strict=True)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(kept + made, [f.name for f in fields])

    fields = [f for f in df.schema.fields if f.name != media_col] + more.fields
    return df.mapInArrow(run, StructType(fields))


def store_tensors(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """tensors() as a table in the shared folder, read again."""
    made = tensors(df, id_col, media_col)
    path = scratch_path(df.sparkSession, "tensors")
    made.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def joined_crc(clips_of: list[tuple[int, int]]) -> int:
    """The digest of a medium's tensors from its clips' own: (clip, CRC of its time span and values), in the clips' order."""
    return zlib.crc32(b"".join(crc.to_bytes(4, "little") for _, crc in sorted(clips_of)))


def stored_digests(stored: DataFrame) -> DataFrame:
    """(id, clips, tensor_crc32) read from a table of tensors; only the clips' digests are shuffled."""
    small_batches(stored.sparkSession)
    kind = stored.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            crcs = [zlib.crc32(x.tobytes(), zlib.crc32(struct.pack("<dd", *s))) for s, x in zip(spans, tensor_array(batch.column(4)).to_numpy_ndarray(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["id", "clip", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[(x["clip"], x["crc"]) for x in r] for r in batch.column(1).to_pylist()]
            cols = [pa.array([len(r) for r in held], pa.int64()), pa.array([joined_crc(r) for r in held], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "clips", "tensor_crc32"])

    digests = stored.select("id", "clip", "start_s", "end_s", "tensor").mapInArrow(each, f"id {kind}, clip int, crc long")
    gathered = digests.groupBy("id").agg(F.collect_list(F.struct("clip", "crc")).alias("held"))
    return gathered.mapInArrow(whole, f"id {kind}, clips long, tensor_crc32 long")


def with_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Rows with their text's UTF-8 bytes, padded with blanks to a multiple of PAD_TO, as a WAV file; and n_bytes."""
    n = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    size = F.greatest(F.lit(1), F.ceil(n / PAD_TO)) * PAD_TO
    number = lambda x: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))
    head = wav(b"")
    payload = F.rpad(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), size.cast("int"), F.lit(bytes([PAD])))
    parts = [F.lit(head[:4]), number(size + 36), F.lit(head[8:40]), number(size), payload]
    return df.withColumn("n_bytes", n).withColumn(out, F.concat(*parts)).drop(text_col)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spill(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id()), "media")
    digests = stored_digests(store_tensors(stored, "_row")).withColumnRenamed("id", "_row")
    read = features(stored).join(digests, "_row", "left").na.fill(0, ["clips", "tensor_crc32"])
    text = F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("clips="), "clips"), F.concat(F.lit("crc="), "tensor_crc32"),
        F.concat(F.lit("segments="), F.concat_ws(",", F.transform("segments", lambda s: F.format_string("%.4f-%.4f", s["start_s"], s["end_s"])))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"))
