"""Fill-in-the-middle: texts cut at unit ends into prefix, middle and suffix, and put in another order.

A batch of texts is viewed as 64-bit words of eight bytes. Arithmetic on whole words marks the bytes
that end a unit, ``bitwise_count`` counts the marks of each word, and the running sum of the counts
is searched for the word that holds the end of a text's n-th unit; clearing the lowest marks of that
one word finds the byte. Code points are counted in the same way, from marks on their first bytes.

Units are lines: up to and with a line feed, or what follows the last one. Where a text is cut, and
into which form it goes, follows from a hash of its key, so reruns and repeated rows agree.

Rows: a null text is an empty one. Empty texts and texts that hold a sentinel stay as they are (form
``plain``), as do those beyond ``rate``. A null key is hashed as ``null``. Repeated rows give repeated
rows, an empty table gives none, and only the columns asked for in ``keep`` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.llm.common import prepare, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Per cent of all texts that are transformed, and of those, that begin with the suffix.
RATE, SPM = 100, 50
_OUT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])

_ONES, _LOW, _HIGH = (np.uint64(int(b * 8, 16)) for b in ("01", "7f", "80"))


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte of the words that equals the given one."""
    other = words ^ (_ONES * np.uint64(byte))
    return ~(((other & _LOW) + _LOW) | other | _LOW)


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point: all but those of the form 10xxxxxx."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Marked bytes of a sequence, with the number before a place and the place of the n-th."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks lie before each byte position."""
        word, bit = places >> 3, (places & 7).astype(np.uint64) * np.uint64(8)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte position of each mark, counted from one."""
        word = np.searchsorted(self.before, nth, side="left") - 1
        inside = nth - self.before[word]
        left = self.words[word]
        for i in range(1, 8):
            left = np.where(inside > i, left & (left - np.uint64(1)), left)
        lowest = left & (~left + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit words, with zeros behind the last byte and one more word."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


class Units:
    """The units of a batch of texts, given by their bytes and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, end: int = 0x0A):
        words = as_words(data)
        self.starts, self.stops = offsets[:-1], offsets[1:]
        self._ends, self._chars = Marks(equal_bytes(words, end)), Marks(first_bytes(words))
        self._before = self._ends.rank(self.starts)
        full = self.stops > self.starts
        open_ended = full.copy()
        open_ended[full] = data[self.stops[full] - 1] != end
        self.count = self._ends.rank(self.stops) - self._before + open_ended

    def place(self, units: np.ndarray) -> np.ndarray:
        """Where the first so many units of each text end."""
        places = np.where(units <= 0, self.starts, self.stops)
        inner = np.flatnonzero((units > 0) & (units < self.count))
        places[inner] = self._ends.select(self._before[inner] + units[inner]) + 1
        return places

    def chars(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return self._chars.rank(stops) - self._chars.rank(starts)


def _numbers(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of a key."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    digits = F.sha2(own, 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None,
    rate: int = RATE, spm: int = SPM, seed: int = SEED,
) -> DataFrame:
    """The kept columns (the key by default), the number of units ``n``, ``form``, ``output``, and
    the code points of prefix and middle (null for plain texts)."""
    prepare(docs.sparkSession)
    keep = list([key] if keep is None else keep)
    own = F.coalesce(F.col(text), F.lit(""))
    plain = (own == "")
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(own, F.lit(sentinel))
    first, second, third, fourth = _numbers(key, seed)
    plain = plain | (third % 100 >= rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, one, two, as_is, suffix_first = batch.columns[len(keep):]
            data, offsets = text_bytes(whole)
            units = Units(data, offsets)
            cuts = [h.to_numpy() % (units.count + 1) for h in (one, two)]
            a, b = units.place(np.minimum(*cuts)), units.place(np.maximum(*cuts))
            as_is, suffix_first = (c.to_numpy(zero_copy_only=False) for c in (as_is, suffix_first))
            raw = data.tobytes()
            out = [
                _arranged(raw, spans, *how)
                for spans, how in zip(
                    zip(units.starts.tolist(), a.tolist(), b.tolist(), units.stops.tolist()),
                    zip(as_is.tolist(), suffix_first.tolist()),
                )
            ]
            form = np.where(as_is, "plain", np.where(suffix_first, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(units.count, pa.int64()), pa.array(form, pa.string()),
                 pa.array(units.chars(units.starts, a), pa.int64(), mask=as_is),
                 pa.array(units.chars(a, b), pa.int64(), mask=as_is),
                 pc.cast(pa.array(out, pa.binary()), pa.string())],
                [*(f"_{i}" for i in range(len(keep))), *_OUT.names],
            )

    # Columns are told apart by place within the job, whatever their names.
    given = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
                          + _OUT.fields)
    found = docs.select(
        *given, own.alias("_text"), first.alias("_h1"), second.alias("_h2"), plain.alias("_plain"),
        (fourth % 100 < spm).alias("_spm"),
    ).mapInArrow(run, schema)
    return found.toDF(*keep, *_OUT.names)


def _arranged(raw: bytes, spans: tuple, plain: bool, suffix_first: bool) -> bytes:
    start, a, b, stop = spans
    if plain:
        return raw[start:stop]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    prefix, middle, suffix = raw[start:a], raw[a:b], raw[b:stop]
    parts = (s, suffix, p, prefix) if suffix_first else (p, prefix, s, suffix)
    return b"".join((*parts, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone.

    A transformed text holds no sentinel of its own, so the sentinels split it into its parts.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = (F.get(parts, i) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(one, middle, two))
        .when(form == "spm", F.concat(two, middle, one))
        .otherwise(output)
    )
