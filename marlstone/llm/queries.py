"""The subpackage's named queries and, where SQL can state the same result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import embedjoin, linededup, lm, media, mixing, piece_bpe, pii, sharding, simhash, toxicity
from marlstone.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(documents(spark, sf_dir)).select("doc_id", "text", "lines", "removed_lines")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), e AS (
  SELECT *, CASE WHEN i >= 2 AND (v + 31 * lag(v) OVER (PARTITION BY doc_id ORDER BY i)) % 3 = 0 THEN 1 ELSE 0 END AS ends FROM h
), n AS (
  SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS chunk FROM e
), c AS (
  SELECT doc_id, min(i) AS first, max(i) AS until, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, chunk
), f AS (
  SELECT doc_id, i, row_number() OVER w AS k, sum(words) OVER w AS p, sum(words) OVER w - words AS s FROM h WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), a AS (
  SELECT doc_id, list(line ORDER BY i) AS full_lines FROM h WHERE words > 0 GROUP BY doc_id
), r AS (
  SELECT x.doc_id, x.i AS first, y.i AS until, x.k AS k1, y.k AS k2 FROM f x ASOF JOIN f y ON x.doc_id = y.doc_id AND x.s + 51 <= y.p
  UNION SELECT y.doc_id, x.i, y.i, x.k, y.k FROM f y ASOF JOIN f x ON x.doc_id = y.doc_id AND y.p - 51 >= x.s
), b AS (
  SELECT doc_id, first, until, body FROM c WHERE until > first AND translate(body, ' ' || chr(10), '') <> ''
  UNION ALL SELECT doc_id, first, until, array_to_string(full_lines[k1:k2], chr(10)) FROM r JOIN a USING (doc_id)
), g AS (
  SELECT * FROM (SELECT *, min((doc_id, first)) OVER (PARTITION BY body) AS kept FROM b) WHERE (doc_id, first) <> kept
), m AS (
  SELECT DISTINCT doc_id, unnest(range(first, until + 1)) AS i FROM g
), d AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE m.i IS NULL), '') AS text, count(*) AS lines, count(m.i) AS removed_lines
  FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, text, lines, removed_lines FROM d
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedjoin.near_duplicates(documents(spark, sf_dir, "embeddings"), least=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are the patterns' spans; the field's stand in ``spans`` and are counted in ``n_added``."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.learn(docs))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = c.vec_id
"""


def piece_model() -> str:
    """The public vocabulary file that the box offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.encode(documents(spark, sf_dir), piece_model())
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(documents(spark, sf_dir), bins=16)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.text_media(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("dhash"), "hash", F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.amounts(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS caps_before,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS budget
  FROM s
), l AS (
  SELECT arg_max((budget - caps_before) / w_left, w_left) FILTER (WHERE w * ((budget - caps_before) / w_left) <= cap AND source_size > 0) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target FROM r, l
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(round(p.target - p.whole * p.source_size) AS BIGINT) AS part,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(d.size AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - earlier)) AS BIGINT) AS taken FROM o
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.scores(docs, toxicity.learn(docs, documents(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_embedding, op4_pii, op5_sentencepiece, op6_lm, op7_sharding, op8_media, op9_mixing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_embedding": OP3_SQL, "op9_mixing": OP9_SQL}
