"""The text index: which passages hold which token, in generations that readers see whole.

Files below one folder are only ever added:

``members/<segment>``   (id, unit, attributes, alive, version)  what a sync changed: passages added or
               replaced, and removed ids (not alive). The newest version of an id counts. A unit is
               one distinct (text, attributes), named by a hash, so copies are indexed once.
``postings-<n>``   (unit, token, tf, segment)  raw counts, in buckets by unit. A sync appends those of
               units that no earlier segment holds; nothing in it depends on other passages.
``stats/<name>``   what follows from one state of members and postings: ``live`` (id, unit,
               attributes), ``vocab`` (token, df, idf, n_units), ``units`` (unit, doc, norm,
               attributes; in the same buckets) and ``tops`` (token, top), the largest tf / norm.
``commits``    one row per generation: its segments, postings, and, once derived, its stats.

The weight of a token in a passage is tf * idf / norm; idf and norm belong to a generation, so no
weights are stored and no posting is rewritten when idf changes. A generation counts from the moment
its row is there: a row is one file. Whatever fails before leaves files that no row names, and the
next run does the work again. Readers keep the generation they opened while others are written. One
writer at a time.

From some number of segments on, or when passages outgrow the buckets, a sync merges: live members
and their postings are written anew, in buckets that fit, and what is dead is left behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hibiki.functions.text import tokens
from hibiki.session import broadcast_if, bucket_table, table_exists

#: Units whose copies a task knows again, at least.
KNOWN_UNITS = 200_000
#: Tokens that are counted at once, about.
COUNTED_TOKENS = 2_000_000
#: Few enough that a task holds and sorts its bucket in memory, however large the index.
UNITS_PER_BUCKET = 16_384
#: Segments from which on a sync merges them.
MAX_SEGMENTS = 8
# A bucket's units are few enough to be hashed, so that its postings need no sorting to meet them.
#: Bytes of names of units that are sent to every executor; beyond, they are joined with a shuffle.
BROADCAST_BYTES = 32 << 20
#: Tokens, the most frequent ones, whose idf is sent to every executor. Postings of the others, which
#: no token has many of, are dealt by token.
COMMON_TOKENS = 200_000

_COMMIT = (
    "generation long, segments array<string>, postings string, buckets int, attributes array<string>, "
    "stats string, n_docs long"
)
_POSTINGS = "unit binary, token string, tf long, segment string"


@dataclass(frozen=True)
class TextIndex:
    path: str
    generation: int
    postings: DataFrame
    units: DataFrame
    vocab: DataFrame
    tops: DataFrame
    copies: DataFrame
    n_docs: int
    attributes: list[str] = field(default_factory=list)

    @property
    def weights(self) -> DataFrame:
        """(unit, doc, token, tf, w, attributes): unit-length TF-IDF weights."""
        return _weights(self.postings, self.units, self.vocab, self.attributes)


def unit_of(text, attributes: Sequence[str]):
    """Name of a distinct (text, attributes): a hash, so equal content meets in one group."""
    name = F.sha2(F.coalesce(text, F.lit("")), 256)
    if attributes:
        extra = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"})
        name = F.sha2(F.concat(name, extra), 256)
    return F.unhex(F.left(name, F.lit(32)))


# -- generations ------------------------------------------------------------------------------------


def head(spark: SparkSession, path: str, derived: bool = False) -> Row | None:
    """The row of the last generation, or of the last whose stats are derived."""
    if not table_exists(spark, f"{path}/commits"):
        return None
    rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    if derived:
        rows = rows.filter("stats IS NOT NULL")
    return rows.orderBy(F.desc("generation")).first()


def _commit(spark: SparkSession, path: str, last: Row | None, **changes) -> Row:
    """One more generation; its one row is one file, which is there or not."""
    old = last.asDict() if last else {}
    row = Row(**(old | {"stats": None, "n_docs": None} | changes | {"generation": old.get("generation", 0) + 1}))
    names = [part.split(" ")[0] for part in _COMMIT.split(", ")]
    table = spark.createDataFrame([tuple(row[name] for name in names)], _COMMIT)
    table.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return row


def _put(df: DataFrame, folder: str) -> DataFrame:
    """Write a table once; it is never changed."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _add_postings(counts: DataFrame, path: str, state: Row | dict, segment: str) -> None:
    """Append (unit, token, tf) rows, dealt by unit into as many partitions as there are buckets."""
    table = bucket_table(counts.sparkSession, f"{path}/{state['postings']}", _POSTINGS, "unit",
                         state["buckets"], "token")
    counts.select("unit", "token", F.col("tf").cast("long"), F.lit(segment)).write.insertInto(table)


def _postings(spark: SparkSession, path: str, state: Row) -> DataFrame:
    """The postings of a generation's segments, in their buckets."""
    table = bucket_table(spark, f"{path}/{state.postings}", _POSTINGS, "unit", state.buckets, "token")
    return spark.table(table).filter(F.col("segment").isin(state.segments)).drop("segment")


def _live(spark: SparkSession, path: str, state: Row) -> DataFrame:
    """(id, attributes, unit) of the passages of a generation."""
    rows = spark.read.parquet(*[f"{path}/members/{s}" for s in state.segments])
    if len(state.segments) > 1:
        rest = F.struct(*[c for c in rows.columns if c != "id"])
        rows = rows.groupBy("id").agg(F.max_by(rest, "version").alias("last")).select("id", "last.*")
    return rows.filter("alive").select("id", *state.attributes, "unit")


def _buckets(spark: SparkSession, passages: int) -> int:
    return passages // UNITS_PER_BUCKET + spark.sparkContext.defaultParallelism


# -- segments ---------------------------------------------------------------------------------------


def _members(docs: DataFrame, key: str, text: str, attributes: Sequence[str]) -> DataFrame:
    return docs.select(
        F.col(key).alias("id"), *attributes, unit_of(F.col(text), attributes).alias("unit")
    )


def one_text_per_unit(df: DataFrame, unit: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per unit. Rows of a unit are equal, so any of them will do."""
    return df.groupBy(unit).agg(*[F.first(c).alias(c) for c in [text, *keep]])


def _without_copies(texts: DataFrame) -> DataFrame:
    """The (unit, text) rows without copies of those that the same task has had, so that a text with
    many copies is sent once by each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in batches:
            fresh = []
            for i, unit in enumerate(batch.column(0).to_pylist()):
                if unit not in known:
                    known.add(unit)
                    fresh.append(i)
            if len(known) > KNOWN_UNITS:
                known = set()
            yield batch.take(pa.array(fresh, pa.int64()))

    return texts.select("unit", "text").mapInArrow(run, "unit binary, text string")


def _counted(texts: DataFrame, buckets: int) -> DataFrame:
    """(unit, token, tf) of distinct texts. Texts are dealt by unit once; the tokens, their counts and
    the buckets follow from that.

    Tokens are counted in runs of whole texts, each sorted by token, so that sorting a bucket by token
    only merges its runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("tokens").value_lengths().to_numpy())])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNTED_TOKENS, "right")) - 1)
                yield from _run(batch.slice(start, stop - start))
                start = stop

    dealt = _without_copies(texts).repartition(buckets, "unit")
    found = one_text_per_unit(dealt, "unit", "text").select("unit", tokens(F.col("text")).alias("tokens"))
    return found.mapInArrow(run, "unit binary, token string, tf long")


def _run(texts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(unit, token, tf) of some texts, by token."""
    lists = texts.column("tokens")
    token = lists.flatten().dictionary_encode()
    by_token = pc.sort_indices(token.dictionary)
    place = np.empty(len(by_token), np.int64)
    place[by_token.to_numpy()] = np.arange(len(by_token))
    rows = np.repeat(np.arange(texts.num_rows), lists.value_lengths().to_numpy())
    keys = np.sort(place[token.indices.to_numpy()] * texts.num_rows + rows)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    counts = np.diff(np.append(heads, len(keys)))
    sorted_ = token.dictionary.take(by_token)
    for at in range(0, len(heads), 1 << 16):
        own = keys[heads[at:at + (1 << 16)]]
        yield pa.RecordBatch.from_arrays([
            texts.column("unit").take(pa.array(own % texts.num_rows)),
            sorted_.take(pa.array(own // texts.num_rows)), pa.array(counts[at:at + (1 << 16)]),
        ], ["unit", "token", "tf"])


def build_text_index(
    docs: DataFrame, path: str, key: str = "id", text: str = "text", attributes: Sequence[str] = ()
) -> TextIndex:
    """Index a table of passages from nothing."""
    store_passages(docs, path, key, text, attributes)
    return refresh_text_index(docs.sparkSession, path)


def store_passages(
    docs: DataFrame, path: str, key: str = "id", text: str = "text", attributes: Sequence[str] = ()
) -> None:
    """The first generation of an index, or one that replaces all passages of an older one."""
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    last = head(spark, path)
    members = _members(docs, key, text, attributes).withColumns(
        {"alive": F.lit(True), "version": F.lit(last.generation + 1 if last else 1).cast("long")}
    )
    stored = _put(members, f"{path}/members/{segment}")
    state = {"postings": f"postings-{segment}", "buckets": _buckets(spark, stored.count())}
    texts = docs.select(unit_of(F.col(text), attributes).alias("unit"), F.col(text).alias("text"))
    _add_postings(_counted(texts, state["buckets"]), path, state, segment)
    _commit(spark, path, last, segments=[segment], attributes=list(attributes), **state)


def apply_changes(
    docs: DataFrame,
    path: str,
    deleted: DataFrame | None = None,
    key: str = "id",
    text: str = "text",
    attributes: Sequence[str] = (),
) -> None:
    """Insert or replace the given passages and remove the deleted ids, as one more generation.

    Repeating the same change leaves the same passages, so a batch may be replayed after a failure.
    The generation can be searched when ``refresh_text_index`` has derived its stats. Without
    changes there is none.
    """
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    state = head(spark, path)
    new = _members(docs, key, text, attributes).withColumn("alive", F.lit(True))
    if deleted is not None:
        gone = deleted.select(F.col(key).alias("id"), F.lit(False).alias("alive"))
        new = new.unionByName(gone, allowMissingColumns=True)
    new = new.withColumn("version", F.lit(state.generation + 1).cast("long"))
    new = _put(new, f"{path}/members/{segment}")
    if new.isEmpty():
        return
    units = new.filter("alive").select("unit").distinct()
    # The names of the new units go to the postings, not the other way round.
    some = broadcast_if(units, 16, BROADCAST_BYTES)
    known = _postings(spark, path, state).select("unit").join(some, "unit", "left_semi").distinct()
    texts = docs.select(unit_of(F.col(text), attributes).alias("unit"), F.col(text).alias("text"))
    fresh = texts.join(known, "unit", "left_anti")
    _add_postings(_counted(fresh, state.buckets), path, state, segment)
    state = _commit(spark, path, state, segments=[*state.segments, segment])
    if len(state.segments) > MAX_SEGMENTS:
        merge_segments(spark, path)


def merge_segments(spark: SparkSession, path: str) -> None:
    """Write live members and their postings into one segment, in buckets that fit their number."""
    state, segment = head(spark, path), uuid.uuid4().hex
    live = _live(spark, path, state).withColumns(
        {"alive": F.lit(True), "version": F.lit(state.generation + 1).cast("long")}
    )
    live = _put(live, f"{path}/members/{segment}")
    new = {"postings": f"postings-{segment}", "buckets": _buckets(spark, live.count())}
    units = live.select("unit").distinct().repartition(state.buckets, "unit")
    counts = _postings(spark, path, state).join(units, "unit", "left_semi").repartition(new["buckets"], "unit")
    _add_postings(counts, path, new, segment)
    _commit(spark, path, state, segments=[segment], **new)


# -- what follows from a generation -----------------------------------------------------------------


def _frequencies(postings: DataFrame, units: DataFrame) -> DataFrame:
    """(token, df, n_units): postings meet the number of copies in their bucket; sums leave it."""
    return postings.select("unit", "token").join(units.hint("shuffle_hash"), "unit").groupBy("token").agg(
        F.sum("n_copies").alias("df"), F.count(F.lit(1)).alias("n_units")
    )


def _norms(postings: DataFrame, units: DataFrame, rarity: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(unit, doc, norm, attributes), summed inside the buckets."""
    raw = F.col("tf") * F.col("idf")
    lengths = with_idf(postings, rarity).groupBy("unit").agg(F.sqrt(F.sum(raw * raw)).alias("norm"))
    return lengths.join(units.hint("shuffle_hash"), "unit").select("unit", "doc", "norm", *attributes)


def _tops(postings: DataFrame, units: DataFrame) -> DataFrame:
    """(token, top): times idf, the largest weight of a token. Only sums per token leave the buckets."""
    return postings.join(units.select("unit", "norm").hint("shuffle_hash"), "unit").groupBy("token").agg(
        F.max(F.col("tf") / F.col("norm")).alias("top")
    )


def _weights(postings: DataFrame, units: DataFrame, vocab: DataFrame, attributes: Sequence[str]) -> DataFrame:
    w = F.col("tf") * F.col("idf") / F.col("norm")
    return with_idf(postings.join(units.hint("shuffle_hash"), "unit"), vocab).select(
        "unit", "doc", "token", "tf", w.alias("w"), *attributes
    )


def with_idf(rows: DataFrame, vocab: DataFrame, unseen: Column | None = None) -> DataFrame:
    """The rows with the idf of their ``token``; those of other tokens get ``unseen``, or are left out.

    Frequent tokens are met by a broadcast of bounded size, so that they are never dealt to one
    task each; only rows of the many rare tokens are shuffled, where there are more than can be sent.
    """
    if "df" not in vocab.columns:  # already as it is to be joined
        return rows.join(vocab, "token")
    rarity = vocab.select("token", "idf")
    how = "inner" if unseen is None else "left"
    idf = F.col("idf") if unseen is None else F.coalesce(F.col("idf"), unseen)
    # One row per power of two.
    sizes = vocab.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, power = 0, None
    for size in sorted(sizes, key=lambda r: -r["power"]):
        total += size["n"]
        if total > COMMON_TOKENS:
            break
        power = size["power"]
    if total <= COMMON_TOKENS:
        return rows.join(F.broadcast(rarity), "token", how).withColumn("idf", idf)
    common = vocab.filter(F.floor(F.log2("df")) >= power).select("token", "idf") if power is not None else rarity.limit(0)
    met = rows.join(F.broadcast(common), "token", "left")
    rest = met.filter("idf IS NULL").drop("idf").join(rarity.hint("merge"), "token", how)
    return met.filter("idf IS NOT NULL").unionByName(rest.withColumn("idf", idf))


def refresh_text_index(spark: SparkSession, path: str) -> TextIndex:
    """Derive the stats of the last generation, unless they are there. No text is read or tokenised,
    and postings stay in their buckets."""
    state = head(spark, path)
    if state.stats is not None:
        return open_text_index(spark, path)
    passages = _live(spark, path, state).select("unit").count()
    if _buckets(spark, passages) > 2 * state.buckets:
        merge_segments(spark, path)
        state = head(spark, path)
    stats = f"stats/{uuid.uuid4().hex}"
    folder, attributes = f"{path}/{stats}", state.attributes
    live = _put(_live(spark, path, state), f"{folder}/live")
    postings = _postings(spark, path, state)
    n_docs = live.count()
    units = live.groupBy("unit").agg(
        F.min("id").alias("doc"), F.count(F.lit(1)).alias("n_copies"),
        *[F.first(a).alias(a) for a in attributes],
    )
    units = _put_units(units, f"{folder}/copies", state.buckets)
    vocab = _frequencies(postings, units).select(
        "token", "df", (F.log(F.lit(n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"), "n_units"
    )
    vocab = _put(vocab, f"{folder}/vocab")
    units = _put_units(_norms(postings, units, vocab, attributes), f"{folder}/units", state.buckets)
    _put(_tops(postings, units), f"{folder}/tops")
    _commit(spark, path, state, stats=stats, n_docs=n_docs)
    return open_text_index(spark, path)


def _put_units(units: DataFrame, folder: str, buckets: int) -> DataFrame:
    """A table by unit, in as many buckets as the postings."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    table = bucket_table(units.sparkSession, folder, columns, "unit", buckets, "unit")
    units.repartition(buckets, "unit").write.insertInto(table)
    return units.sparkSession.table(table)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    """The last generation that can be searched."""
    state = head(spark, path, derived=True)
    folder = f"{path}/{state.stats}"
    kinds = spark.read.parquet(f"{folder}/live").schema
    columns = ", ".join(
        f"`{name}` {kind}" for name, kind in [
            ("unit", "binary"), ("doc", kinds["id"].dataType.simpleString()), ("norm", "double"),
            *[(a, kinds[a].dataType.simpleString()) for a in state.attributes],
        ]
    )
    units = bucket_table(spark, f"{folder}/units", columns, "unit", state.buckets, "unit")
    return TextIndex(
        path=path,
        generation=state.generation,
        postings=_postings(spark, path, state),
        units=spark.table(units),
        vocab=spark.read.parquet(f"{folder}/vocab"),
        tops=spark.read.parquet(f"{folder}/tops"),
        copies=spark.read.parquet(f"{folder}/live"),
        n_docs=state.n_docs,
        attributes=list(state.attributes),
    )


def sync_text_index(
    docs: DataFrame, path: str, key: str = "id", text: str = "text", attributes: Sequence[str] = ()
) -> TextIndex:
    """Create the index if there is none, else bring it to the given snapshot.

    Only passages whose content changed are tokenised.
    """
    spark = docs.sparkSession
    state = head(spark, path)
    if state is None:
        return build_text_index(docs, path, key, text, attributes)
    old = _live(spark, path, state).select(F.col("id").alias(key), F.col("unit").alias("_unit"))
    named = docs.withColumn("_new_unit", unit_of(F.col(text), attributes))
    changed = (
        named.join(old, key, "left")
        .filter(~F.col("_new_unit").eqNullSafe(F.col("_unit")))
        .drop("_unit", "_new_unit")
    )
    deleted = old.select(key).join(docs.select(key), key, "left_anti")
    apply_changes(changed, path, deleted, key, text, attributes)
    return refresh_text_index(spark, path)


def indexed_rows(index: TextIndex) -> DataFrame:
    """How many passages can be found."""
    return index.copies.agg(F.count("*").alias("indexed_rows"))


def weights_by_id(index: TextIndex) -> DataFrame:
    """The weight of every token in every passage, copies included."""
    met = index.postings.join(index.units.select("unit", "norm").hint("shuffle_hash"), "unit").join(
        index.copies.select("unit", "id"), "unit"
    ).select("id", "token", "tf", "norm")
    w = F.col("tf") * F.col("idf") / F.col("norm")
    return with_idf(met, index.vocab).select("id", "token", "tf", w.alias("w"))
