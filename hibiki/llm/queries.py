"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki.llm import (
    bpe, filter_audit, fim, fingerprints, mixing, pii, simhash, substrings, threshold, token_store,
    toxicity, vector_dedup, warc,
)
from hibiki.llm.common import WORD, documents, prepare
from hibiki.session import new_path


def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, d, "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    encoded = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.decode(
        encoded, ranks, public_tokenizers.PATTERN, ["doc_id", "n_tokens", "ids_sha256"]
    )
    return decoded.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, d, "doc_id", "text"), words=3)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, d: str, docs: DataFrame) -> toxicity.Model | None:
    return toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "doc_id", "text", "lang")
    model = toxicity_model(spark, d, docs)
    scored = toxicity.add_scores(docs, model, keep=["doc_id", "lang"])
    limit = toxicity.threshold_of(model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"), (F.col("score") >= limit).alias("toxic"),
    )


def op4_token_store(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    docs = documents(spark, d, "doc_id", "text")
    manifest = token_store.write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    found = token_store.fetch(spark, folder, manifest, token_store.all_keys(docs))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(documents(spark, d, "doc_id", "text"))
    counts = [
        F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS BIGINT) AS n_{kind}")
        for i, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = warc.write_archives(prepare(spark).read.parquet(f"{d}/pages.parquet"), folder)
    return warc.resolve(warc.read_records(spark, folder, archives))


def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, d, "doc_id", "text"))


def op8_recompression(spark: SparkSession, d: str) -> DataFrame:
    left = substrings.remove_repeats(documents(spark, d, "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    found = mixing.shares(documents(spark, d, "doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{d}/embeddings.parquet").select(
        "vec_id", threshold.whole_numbers(F.col("embedding")).alias("embedding")
    )
    return threshold.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "doc_id", "text", "lang")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    conditions = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }
    found = filter_audit.audit(
        docs, spark.read.parquet(f"{d}/labels.parquet"), conditions, repeats="E",
        part=F.coalesce(F.col("lang"), F.lit("")),
    )
    return found.drop("filter")


def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    found = fim.transform(documents(spark, d, "doc_id", "text"))
    again = fim.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def op13_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return vector_dedup.near_duplicates(vectors)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_token_store": op4_token_store,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_fingerprints": op7_fingerprints,
    "op8_recompression": op8_recompression,
    "op9_mixing": op9_mixing,
    "op10_threshold": op10_threshold,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_dedup": op13_vector_dedup,
}
SQL: dict[str, str] = {
    "op6_warc": """WITH heads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (SELECT *, max(page_id) OVER same AS original, row_number() OVER
  (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS nth
  FROM heads WINDOW same AS (PARTITION BY payload_digest))
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 THEN original END AS refers_to FROM ranked""",
    "op9_mixing": f"""WITH sized AS (SELECT doc_id, source,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  md5('1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS o FROM documents),
sums AS (SELECT source, sum(size)::DOUBLE AS s FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth,
  [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w,
  2.0::DOUBLE * s AS cap FROM sums),
placed AS (SELECT *, row_number() OVER f AS nr, (sum(s) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  AS level FROM weighed WINDOW f AS (ORDER BY cap / w, nth)),
opened AS (SELECT arg_min(level, nr) AS final, min(nr) AS opens FROM placed WHERE level * w < cap),
wanted AS (SELECT source, s, coalesce(CASE WHEN nr >= opens THEN least(final * w, cap) END, cap)
  AS target FROM placed LEFT JOIN opened ON true),
parts AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM wanted),
tied AS (SELECT source, o, sum(size) AS n FROM sized GROUP BY source, o),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY o
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN 2 * before + n <= 2 * (target - whole * s) THEN 1 ELSE 0 END))::BIGINT
  AS taken
FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source
JOIN run ON run.source IS NOT DISTINCT FROM sized.source AND run.o = sized.o""",
    "op10_threshold": """WITH v AS (SELECT DISTINCT vec_id,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c
  ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT * FROM (SELECT query_id, (row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
WHERE rank <= 5""",
    "op11_filter_audit": f"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM texts),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS fails
  FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
totals AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM names a, names b, names c, names d, names e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS taken
  FROM orders, range(1, 6) AS r(step)),
counted AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (fails & (taken | own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails & taken = 0 AND fails & own > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & taken > 0 AND fails & own > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails & taken = 0 AND fails & own > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails & taken = 0 AND fails & own > 0), 0)::BIGINT AS toxic_lost
  FROM (SELECT part, filter_order, step, own, taken::INT AS taken, fails, n, good, toxic FROM totals, steps)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted""",
    "op12_fill_in_middle": r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
numbered AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a,
  ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 AS way FROM cut),
parts AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
    THEN 'plain' WHEN way < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
  array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM numbered)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts""",
    "op13_vector_dedup": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
  coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b
  ON a.fine AND b.fine AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT r AS a, r AS b FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
found AS (SELECT reached.a AS r, min(v.vec_id) AS component_id FROM reached JOIN v ON v.r = reached.b GROUP BY reached.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN found USING (r) LEFT JOIN counted USING (r)""",
}
