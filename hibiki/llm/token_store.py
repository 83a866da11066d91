"""Token ids in raw binary shards, found by key through minimal perfect hashing.

Documents are range-partitioned by key; every task encodes its documents and writes one shard, the
ids one after another in key order, each document closed by an end id. The index is cut into parts
by a hash of the key. A part is a minimal perfect hash: keys that collide on a level move on to the
next, the rank of a key's bit is its slot, and a slot holds the key's fingerprint, shard, offset
and length. A look-up reads a few bits and one slot, whatever the size of the store.

Rows: null texts are empty and hold the end id only; a null key sorts first and can be looked up.
Rows with equal keys follow each other in the order of a hash of their text and are told apart by
their number (0, 1, ...). Extra columns are left out. An empty table gives no shards.

Encoding goes by words: no token of this kind of tokenizer spans white space, so the library
encodes each distinct word once per worker (within a bounded cache).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hibiki.llm.common import mix, new_file, once, prepare, store
from hibiki.session import write_out

END_ID = 2
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 1_000_000
_JOINED = 2000
# Punctuation that is one run behind letters; an apostrophe may begin a token of its own.
_CLOSING = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Keys in a part of the index, at most on average.
PART_KEYS = 1_000_000
_SLACK = 1.5


def _letters(word: bytes) -> bool:
    """Whether a word is all letters, and is so in lower case."""
    return word.isalpha() or word.decode().lower().isalpha()


class _Known(dict):
    """Packed ids by word; words that were asked for in vain are put into ``new``."""

    def __init__(self):
        self.new: set[bytes] = set()
        self.missed = False

    def __missing__(self, word: bytes) -> bytes:
        self.new.add(word)
        self.missed = True
        return b""


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space and marks word ends."""

    def __init__(self, path: str, end_mark: str = "</w>"):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added) or b"(?!)", re.IGNORECASE)
        self.heads = {t.encode()[:1].lower() for t in added} | {t.encode()[:1].upper() for t in added}
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end_mark)]] = True
        self.known = _Known()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed."""
        split = [self._words((t or "").encode()) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out, again = self.known, [], []
        for i, words in enumerate(split):
            known.missed = False
            out.append(b"".join(map(known.__getitem__, words)))
            if known.missed:
                again.append(i)
        self._learn(known.new)
        known.new = set()
        for i in again:
            out[i] = b"".join(map(known.__getitem__, split[i]))
        return out

    def _words(self, text: bytes) -> list[bytes]:
        """Only ASCII letters are lowered here, the tokenizer sees to the others; texts that may hold
        added tokens keep theirs, as these are found as they are written."""
        may = any(head in text for head in self.heads) and self.added.search(text)
        return (text if may else text.lower()).split()

    def _learn(self, words: set[bytes]) -> None:
        # A letter run and the punctuation behind it are separate tokens, if the letters stay letters
        # when lowered: some end in marks then, which go with the punctuation.
        closed = {}
        for w in words:
            head = w.rstrip(_CLOSING)
            if head and len(head) < len(w) and _letters(head) and not self.added.search(w, len(head)):
                closed[w] = head, w[len(head):]
        plain = (words - closed.keys()) | {part for parts in closed.values() for part in parts}
        plain = sorted(w for w in plain if w not in self.known)
        runs = [w for w in plain if _letters(w)]
        for i in range(0, len(runs), _JOINED):
            self._learn_runs(runs[i:i + _JOINED])
        for w in plain:
            if w not in self.known:
                self.known[w] = self._ids(w.decode()).tobytes()
        for w, (head, tail) in closed.items():
            self.known[w] = self.known[head] + self.known[tail]

    def _learn_runs(self, runs: list[bytes]) -> None:
        """Letter runs, encoded together; they are left to be encoded alone if ends do not fit."""
        ids = self._ids(b" ".join(runs).decode())
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(runs) and (not len(cuts) or cuts[-1] == len(ids)):
            packed, ends = ids.tobytes(), (cuts * ids.itemsize).tolist()
            self.known.update(zip(runs, (packed[a:b] for a, b in zip([0, *ends], ends))))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)


# -- minimal perfect hashing --------------------------------------------------------------------


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)


def build_hash(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all levels (packed) and the size of each level, for distinct 128-bit keys (a, b)."""
    levels, sizes = [], []
    while len(a):
        if len(sizes) == 200:
            raise ValueError("two keys have equal hashes")
        size = -(-int(len(a) * _SLACK + 8) // 64) * 64
        places = _places(a, b, len(sizes), size)
        alone = np.bincount(places.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        left = ~alone[places]
        a, b = a[left], b[left]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.packbits(bits, bitorder="little"), np.array(sizes, np.int64)


def slots(bits: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that certainly are not in the hash."""
    words = bits.view("<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    out, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes.tolist()):
        places = (_places(a[open_], b[open_], level, size) + np.uint64(base)).astype(np.int64)
        word, bit = words[places >> 6], (places & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word & ((np.uint64(1) << bit) - np.uint64(1))
        out[open_[hit]] = (ranks[places >> 6] + np.bitwise_count(below))[hit]
        open_, base = open_[~hit], base + size
    return out


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a ^ mix(b)) >> np.uint64(32)).astype(np.uint32)


# -- writing and reading ------------------------------------------------------------------------


def _hashed(rows: DataFrame, key: Column, number: Column, parts: int) -> DataFrame:
    a, b = F.xxhash64(key, number), F.xxhash64(number, F.lit("b"), key)
    # Null keys are left out of a hash; the marker keeps them apart from others.
    return rows.withColumns({
        "_a": F.xxhash64(a, key.isNull()), "_b": b,
    }).withColumn("_part", F.pmod(F.col("_a"), F.lit(parts)).cast("int"))


def _numbered_on(records: DataFrame, totals: list) -> DataFrame:
    """The records, the numbers of a key that lies in several shards running on from one to the next.

    ``totals``: by shard, its first and last key and how many records of the last it holds.
    """
    ahead, last, count = [], None, 0
    for row in totals:
        before = count if row["first"] == last else 0
        if before:
            ahead.append((row["_shard"], row["first"]["key"], before))
        count = row["of_last"] + (before if row["first"] == row["last"] else 0)
        last = row["last"]
    if not ahead:
        return records
    own = records.sparkSession.createDataFrame(ahead, "at_shard int, first long, ahead long")
    same = (F.col("_shard") == F.col("at_shard")) & F.col("key").eqNullSafe(F.col("first"))
    return records.join(F.broadcast(own), same, "left").withColumn(
        "number", F.col("number") + F.coalesce("ahead", F.lit(0))
    ).select(*records.columns)


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, shards: int | None = None,
) -> DataFrame:
    """Write shards and index; returns the manifest: _shard, ids in it and before it, parts, width."""
    spark = prepare(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    own = own.withColumn("order", F.xxhash64("text"))
    own = own.repartitionByRange(shards, "key", "order").sortWithinPartitions("key", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("words", tokenizer), lambda: WordEncoder(tokenizer))
        width, shard, at, last, number = encoder.kind.itemsize, TaskContext.get().partitionId(), 0, None, 0
        end = np.array([end_id], encoder.kind).tobytes()
        with new_file(f"{folder}/{shard:06d}.ids") as out:
            for batch in batches:
                keys, places, counts, numbers = batch.column(0), [], [], []
                for own_key, ids in zip(keys.to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    out.write(ids + end)
                    number = number + 1 if at and own_key == last else 0
                    last = own_key
                    numbers.append(number)
                    places.append(at)
                    counts.append(len(ids) // width + 1)
                    at += counts[-1]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), keys, pa.array(numbers, pa.int64()),
                     pa.array(places, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([width] * n, pa.int32())],
                    ["_shard", "key", "number", "at", "n", "width"],
                )

    records = write_out(own.select("key", "text").mapInArrow(
        run, "_shard int, key long, number long, at long, n long, width int"
    ), "records")
    # A few rows per shard; running sums tell what lies before each.
    totals = records.groupBy("_shard").agg(
        F.sum("n").alias("ids"), F.max("width").alias("width"),
        F.min_by(F.struct("key"), "at").alias("first"), F.max_by(F.struct("key"), "at").alias("last"),
        (F.max_by("number", "at") + 1).alias("of_last"),
    ).orderBy("_shard").collect()
    records = _numbered_on(records, totals)
    parts = max(shards, -(-records.count() // PART_KEYS))

    def build(group: pa.Table) -> pa.Table:
        a = group.column("_a").to_numpy().view(np.uint64)
        b = group.column("_b").to_numpy().view(np.uint64)
        bits, sizes = build_hash(a, b)
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        order = np.empty(len(a), np.int64)
        order[slots(bits, sizes, a, b)] = np.arange(len(a))
        part = group.column("_part")[0].as_py()
        data = io.BytesIO()
        np.savez(
            data, bits=bits, sizes=sizes, marks=_fingerprint(a, b)[order],
            **{c: group.column(c).to_numpy()[order] for c in ("_shard", "at", "n")},
        )
        with new_file(f"{folder}/{part:06d}.index") as out:
            out.write(data.getvalue())
        return pa.table([pa.array([part], pa.int32()), pa.array([len(a)], pa.int64())], ["part", "keys"])

    hashed = _hashed(records, F.col("key"), F.col("number"), parts)
    write_out(hashed.groupBy("_part").applyInArrow(build, "part int, keys long"), "index-parts")
    rows, before = [], 0
    for row in totals:
        rows.append((row["_shard"], row["ids"], before, parts, row["width"]))
        before += row["ids"]
    return spark.createDataFrame(rows, "_shard int, ids long, before long, parts int, width int")


def fetch(spark: SparkSession, folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, number, start, n_tokens and ids (little-endian unsigned 32-bit) of the keys found.

    ``keys`` has the key and its ``number``, 0 for the first record of a key.
    """
    first = manifest.first()
    schema = "key long, number long, start long, n_tokens long, ids binary"
    if first is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    parts, width = first["parts"], first["width"]
    asked = _hashed(keys.select(F.col(key).cast("long").alias("key"), "number"), F.col("key"), F.col("number"), parts)

    def look_up(group: pa.Table) -> pa.Table:
        fs, path = store(f"{folder}/{group.column('_part')[0].as_py():06d}.index")
        if fs.get_file_info(path).type.name == "NotFound":  # a part without keys
            group = group.slice(0, 0)
            index = {"marks": np.zeros(0, np.uint32), "_shard": np.zeros(0, np.int32),
                     "at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
            found, good = np.zeros(0, np.int64), np.zeros(0, bool)
        else:
            with fs.open_input_file(path) as data:
                index = dict(np.load(io.BytesIO(data.read())))
            a = group.column("_a").to_numpy().view(np.uint64)
            b = group.column("_b").to_numpy().view(np.uint64)
            found = slots(index["bits"], index["sizes"], a, b)
            good = (found >= 0) & (index["marks"][found] == _fingerprint(a, b))
        picked = group.filter(pa.array(good))
        return pa.table(
            [index["_shard"][found[good]], index["at"][found[good]], index["n"][found[good]],
             picked.column("key"), picked.column("number")],
            ["_shard", "at", "n", "key", "number"],
        )

    located = asked.groupBy("_part").applyInArrow(
        look_up, "_shard int, at long, n long, key long, number long"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, data = None, None
        for batch in batches:
            out = []
            for shard, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != opened:
                    if data is not None:
                        data.close()
                    fs, path = store(f"{folder}/{shard:06d}.ids")
                    data, opened = fs.open_input_file(path), shard
                raw = data.read_at(n * width, at * width)
                out.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())],
                ["_shard", "at", "n", "key", "number", "ids"],
            )

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payloads = (
        located.repartition(shards, "_shard").sortWithinPartitions("_shard", "at")
        .mapInArrow(read, "_shard int, at long, n long, key long, number long, ids binary")
    )
    # One row per shard, written by the driver itself.
    return payloads.join(F.broadcast(manifest.select("_shard", "before")), "_shard").select(
        F.col("key").alias(key), "number", (F.col("before") + F.col("at")).alias("start"),
        F.col("n").alias("n_tokens"), "ids",
    )


def all_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every key with the numbers of its records."""
    counted = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))
