"""WARC archives in which equal payloads are stored once.

Headers (key, payload digest, length) are shuffled by digest; of the records with equal payloads of
some length, the one with the largest key stays a response and the others become revisits that
refer to it. Every task then writes one gzip member per record, with fresh headers, into an archive
of its own; a revisit carries no payload. Reading back joins revisits to the responses they refer to.

Rows: null payloads are empty ones. Null keys are smaller than any and are written as such. Of rows
with equal key and payload one is the response, the others revisit it. Extra columns are left out,
empty tables give no archives. Payloads below ``least`` bytes are always responses.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hibiki.llm.common import new_file, prepare, store
from hibiki.session import write_out

LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """(key, digest, refers_to) per distinct key and payload; refers_to is null for responses."""
    heads = pages.select(
        F.col(key).alias("key"), F.sha1(_payload(payload)).alias("digest"),
        F.octet_length(_payload(payload)).cast("long").alias("bytes"),
    ).distinct()
    originals = heads.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("key").alias("original"))
    return heads.join(originals, "digest", "left").select(
        "key", "digest", F.when(F.col("bytes") >= least, F.struct("original")).alias("shared")
    )


def _payload(column: str):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def _record(key, copy: int, url: str, digest: str, payload: bytes, refers: str | None, date: str) -> bytes:
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_identity(key, copy)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers:
        lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {_PROFILE}"]
    body = b"" if refers else b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _identity(key, copy: int) -> str:
    return f"<urn:page:{'' if key is None else key}:{copy}>"


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url",
    least: int = LEAST, date: str = DATE,
) -> DataFrame:
    """Write the archives; returns the table of their names."""
    prepare(pages.sparkSession)
    decided = write_out(decide(pages, key, payload, least), "decisions")
    named = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k")
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), _payload(payload).alias("payload"))
    own = own.select("*", named, F.sha1("payload").alias("digest"))
    decided = decided.select(named, "digest", F.col("shared").isNotNull().alias("shared"),
                             F.col("shared.original").alias("original"))
    # Rows with equal key and payload are numbered; those of a join by both lie together already.
    copies = Window.partitionBy("k", "digest").orderBy("url")
    both = own.join(decided, ["k", "digest"]).select(
        "key", "url", "digest", "payload", "shared", "original",
        (F.row_number().over(copies) - 1).alias("copy"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, written = f"{TaskContext.get().partitionId():06d}.warc.gz", 0
        with new_file(f"{folder}/{name}") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    first = row["key"] == row["original"] and row["copy"] == 0
                    refers = _identity(row["original"], 0) if row["shared"] and not first else None
                    record = _record(
                        row["key"], row["copy"], row["url"] or "", row["digest"], row["payload"], refers, date
                    )
                    out.write(gzip.compress(record, LEVEL, mtime=0))
                written += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())],
                                         ["name", "records"])

    return write_out(both.mapInArrow(run, "name string, records long").filter("records > 0"), "archives")


def read_records(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """page_id, record_type, payload_digest, payload (null for revisits), refers_to per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = store(f"{folder}/{name}")
                with fs.open_input_stream(path, compression=None) as raw, gzip.open(raw) as lines:
                    rows, size = [], 0
                    for row in _records(lines):
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 512 or size > 1 << 24:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return archives.select("name").repartition(
        max(1, archives.count()), "name"
    ).mapInArrow(run, "page_id long, record_type string, payload_digest string, payload binary, refers_to long")


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("refers_to", pa.int64()),
])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _records(lines) -> Iterator[dict]:
    while lines.readline():  # the version
        head = {}
        while line := lines.readline().strip():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        body = lines.read(int(head["Content-Length"]))
        lines.read(4)
        revisit = head["WARC-Type"] == "revisit"
        yield {
            "page_id": _key(head["WARC-Record-ID"]), "record_type": head["WARC-Type"],
            "payload_digest": head["WARC-Payload-Digest"].partition(":")[2],
            "payload": None if revisit else body[body.index(b"\r\n\r\n") + 4:],
            "refers_to": _key(head["WARC-Refers-To"]) if revisit else None,
        }


def _key(identity: str) -> int | None:
    key = identity.strip("<>").split(":")[2]
    return int(key) if key else None


def resolve(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a stored payload is taken from its bytes; a revisit gets the length of the
    payload of the response with its digest.
    """
    own = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest"))
    heads = write_out(records.select(
        "page_id", "record_type", own.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "refers_to",
    ), "record-headers")
    stored = heads.filter("record_type = 'response'")
    # One response of a digest suffices; short payloads may have many.
    lengths = stored.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    found = heads.filter("record_type = 'revisit'").drop("payload_bytes").join(lengths, "payload_digest")
    return stored.unionByName(found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
