"""Helpers shared by the operators of this package: table reads, Arrow slices, vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Arrow batch and one vectorised step may hold; a longer text stands alone.
BATCH_BYTES = 4 << 20
STEP_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; reading goes through Spark only, so any store will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes: rows with very long texts then don't add up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    # Workers find the package where the driver did, unless the job ships it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def filled(column: pa.Array) -> pa.Array:
    """A null text counts as empty."""
    return pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")


def slices(batch: pa.RecordBatch, name: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``limit`` bytes of column ``name``, or of one row."""
    sizes = pc.binary_length(filled(batch.column(name))).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and held + size > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the offsets of the texts."""
    column = filled(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RANDOM = mix(np.arange(1, 0x600, dtype=np.uint64) * _ODD)
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.empty(_SEGMENT + 1, np.uint64)
    out[0] = 1
    np.cumprod(np.full(_SEGMENT, base, np.uint64), out=out[1:])
    return out


_UP = _powers(_STEP)
_DOWN = _powers(np.uint64(pow(int(_STEP), -1, 1 << 64)))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ascending spans ``values[starts[i]:ends[i]]``, equal for equal spans wherever they stand.

    Spans can be constructed that share one (it is a polynomial modulo a power of two), so callers compare
    the spans themselves. Works in segments, so memory does not grow with the length of a text.
    """
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(ends, starts[low] + _SEGMENT, side="right"))
        high = max(high, low + 1)
        base, top = int(starts[low]), int(ends[high - 1])
        if top - base > _SEGMENT:  # one span longer than a segment
            total, shift = 0, 1
            for at in range(base, top, _SEGMENT):
                part = _RANDOM[values[at : min(at + _SEGMENT, top)]]
                total += shift * int((part * _UP[: len(part)]).sum(dtype=np.uint64))
                shift = shift * int(_UP[_SEGMENT]) % (1 << 64)
            out[low] = np.uint64(total % (1 << 64))
        else:
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_RANDOM[values[base:top]] * _UP[: top - base], out=sums[1:])
            first = starts[low:high] - base
            out[low:high] = (sums[ends[low:high] - base] - sums[first]) * _DOWN[first]
        low = high
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def _place_keys(places: np.ndarray) -> np.ndarray:
    return mix((places.astype(np.uint64) + np.uint64(0x5BD1)) * _ODD)


_PLACES = _place_keys(np.arange(_SEGMENT))


def keyed_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ascending spans ``values[starts[i]:ends[i]]``, which don't overlap and aren't empty.

    Each place of a span has a random factor of its own, so no pattern of letters makes two spans share a
    hash whatever the factors; two different ones do with a chance of about 2**-56. Works in segments, as above.
    """
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(int(np.searchsorted(ends, starts[low] + _SEGMENT, side="right")), low + 1)
        base, top = int(starts[low]), int(ends[high - 1])
        if top - base > _SEGMENT:  # one span longer than a segment
            total = 0
            for at in range(base, top, _SEGMENT):
                part = _RANDOM[values[at : min(at + _SEGMENT, top)]]
                total += int((part * _place_keys(np.arange(at - base, at - base + len(part)))).sum(dtype=np.uint64))
            out[low] = np.uint64(total % (1 << 64))
        else:
            lengths = ends[low:high] - starts[low:high]
            first = np.cumsum(lengths) - lengths
            places = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            held = values[places + np.repeat(starts[low:high], lengths)]
            out[low:high] = np.add.reduceat(_RANDOM[held] * _PLACES[places], first)
        low = high
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in bytes, and the index of each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    opens[edges] = word[edges]
    closes[:-1] &= ~word[1:]
    closes[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def taken(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes that take the spans ``starts[i] : starts[i] + lengths[i]`` one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
