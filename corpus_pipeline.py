"""From documents to token ids: five stages, each written and read again before the next.

toxicity drops documents above their language's threshold; near duplicates keeps one document of
each group that SimHash fingerprints of three-word shingles link within two bits; personal data replaces what it finds in the texts; mixing takes documents as often as
their source's target says; byte-level BPE returns the ids of every text, and what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki.llm import bpe, mixing, pii, simhash, toxicity
from hibiki.llm.common import prepare
from hibiki.session import write_out


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=3)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    keep = ["doc_id", "lang", "source"]
    ids = bpe.encode(docs, ranks, pattern, keep)
    ids = ids.withColumn("own", F.col("ids"))
    decoded = bpe.decode(ids, ranks, pattern, [*keep, "n_tokens", "own"])
    return decoded.select(
        *keep, "n_tokens", F.col("own").alias("ids"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", clean),
    ("near duplicates", one_of_each),
    ("personal data", sanitised),
    ("mixing", mixed),
    ("byte-level BPE", tokenised),
]

# Training, hashing by XXH64 and BPE have no equivalent in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
