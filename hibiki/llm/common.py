"""Session settings, shared files and word positions that the operators use."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from hibiki.session import configure

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings, and Arrow batches small enough for whole long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    return spark


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def once(key: tuple, make: Callable):
    """What ``make`` gives, made once per Python process: reused workers keep it between tasks."""
    kept = sys.__dict__.setdefault("_hibiki_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Return freed memory to the system: Python processes wait for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


# -- files in the shared folder, whatever store it lies in ------------------------------------


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file written under a name of its own, then given its name: a repeated task does no harm."""
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


# -- texts of an Arrow batch as one array of bytes ----------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (with the end of the last); null: empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    filled = filled.cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs without ASCII white space), and the first word of
    each text (with the number of all words)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = (data != 32) & ((data < 9) | (data > 13))
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, kept per process and grown by doubling."""
    kept = once(("powers", base), lambda: [np.ones(1, np.uint64)])
    while len(kept[0]) < n:
        kept[0] = np.concatenate([kept[0], kept[0] * np.uint64(pow(base, len(kept[0]), 1 << 64))])
    return kept[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a sequence, the same for equal spans wherever they lie."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(values)), out=sums[1:])
    moved = (sums[ends] - sums[starts]) * _powers(_BACK, len(values) + 1)[starts]
    return mix(moved + (ends - starts).astype(np.uint64))


# -- names that sums cannot fool: every step scrambles, so equal names mean equal content ----------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of spans of bytes, read eight bytes at a time."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    names = mix((ends - starts).astype(np.uint64) + _ODD)
    left, at = np.arange(len(starts)), starts
    while len(left):
        place, shift = at >> 3, (at & 7).astype(np.uint64) * np.uint64(8)
        value = words[place] >> shift
        value |= np.where(shift > 0, words[place + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        size = ends[left] - at
        value &= _MASKS[np.minimum(size, 8)]
        names[left] = mix((names[left] ^ mix(value + _ODD)) * _ODD)
        more = size > 8
        left, at = left[more], at[more] + 8
    return names


class Runs:
    """Names of spans of a sequence: of a span's two longest parts of 2 ** k elements, which cover it,
    and of its length. Parts are named level by level from their halves, up to the longest span."""

    def __init__(self, names: np.ndarray, longest: int):
        self.levels = [names.astype(np.uint64)]
        while 2 << len(self.levels) - 1 <= min(longest, len(names)):
            half, size = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(mix(mix(half[:-size] * _ODD + np.uint64(size)) ^ half[size:]))

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit names of non-empty spans."""
        lengths = ends - starts
        out = np.zeros(len(starts), np.uint64)
        for k, level in enumerate(self.levels):
            own = np.flatnonzero((lengths >= 1 << k) & (lengths < 2 << k))
            if len(own):
                first, last = level[starts[own]], level[ends[own] - (1 << k)]
                out[own] = mix(mix(first * _ODD + lengths[own].astype(np.uint64)) ^ last)
        return out
