"""An online copy: the newest row of every key, kept up by change feeds, for lookups by key.

Rows lie in buckets by a hash of their key. A refresh reads and writes only the buckets that its
changes fall into, into a folder of their own; a row of the ``commits`` table then says which folder
holds which bucket. Readers see the copy before or after a refresh, never a part of it. Applying the
same changes again, or older ones late, changes nothing: per key the highest version stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hibiki.operators.ranking import latest_per_key
from hibiki.session import table_exists, write_out

ROWS_PER_BUCKET = 1_000_000
_COMMIT = "generation long, folders array<string>"


def _last(spark: SparkSession, path: str) -> Row | None:
    if not table_exists(spark, f"{path}/commits"):
        return None
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy(F.desc("generation")).first()


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str, last: Row, buckets: Sequence[int]) -> DataFrame | None:
    """The rows of some buckets, those without a folder being empty."""
    places = [f"{path}/{last.folders[b]}/bucket={b}" for b in buckets if last.folders[b]]
    return spark.read.parquet(*places) if places else None


def sync_online(
    changes: DataFrame, path: str, keys: Sequence[str], version: str, deleted: Column | None = None
) -> list[int]:
    """Bring the copy up to date with changed rows; returns the buckets that were written.

    ``deleted`` marks rows that remove their key; a marker stays behind it, so that an older change
    that comes late does not bring the key back.
    """
    spark, last = changes.sparkSession, _last(changes.sparkSession, path)
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    new = write_out(changes.withColumn("_deleted", gone), "changes")
    buckets = len(last.folders) if last else new.count() // ROWS_PER_BUCKET + 1
    new = new.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # numbers of buckets
    if not touched:
        return []
    rows, old = new, _stored(spark, path, last, touched) if last else None
    if old is not None:
        rows = rows.unionByName(old.withColumn("bucket", _bucket(keys, buckets)))
    # Rows of one version that differ are told apart by their content, so that reruns agree.
    content = F.xxhash64(*[c for c in new.columns if c not in ("bucket", *keys)])
    rows = latest_per_key(rows, [*keys, "bucket"], [F.desc(version), content])
    folder = f"rows-{uuid.uuid4().hex}"
    rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    folders = list(last.folders) if last else [None] * buckets
    for b in touched:
        folders[b] = folder
    commit = spark.createDataFrame([(last.generation + 1 if last else 1, folders)], _COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return touched


def read_online(spark: SparkSession, path: str) -> DataFrame:
    """The copy: one row per key."""
    last = _last(spark, path)
    return _stored(spark, path, last, range(len(last.folders))).filter("NOT _deleted").drop("_deleted")


def look_up(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence) -> DataFrame:
    """The row of one key, read from its bucket alone."""
    last = _last(spark, path)
    kinds = read_online(spark, path).schema
    own = [F.lit(v).cast(kinds[k].dataType) for k, v in zip(keys, values)]
    named = spark.range(1).select(*[c.alias(k) for k, c in zip(keys, own)])
    bucket = named.select(_bucket(keys, len(last.folders)).alias("b")).first().b
    rows = _stored(spark, path, last, [bucket])
    if rows is None:
        return read_online(spark, path).limit(0)
    for k, c in zip(keys, own):
        rows = rows.filter(F.col(k) == c)
    return rows.filter("NOT _deleted").drop("_deleted")
