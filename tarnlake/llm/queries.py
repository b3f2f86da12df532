"""One query for each operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe, jaccard, langid, media, mixing, quality, secrets, sharding, topk, toxicity
from tarnlake.llm.arrowtext import released
from tarnlake.llm.store import spread

#: Labelled rows that a model is fitted on at most.
QUALITY_ROWS, TOXIC_ROWS, LANGUAGE_ROWS = 3000, 3000, 1500
#: A document is good, or toxic, from this score on.
SURE = 0.7


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def remainder(mod: int, key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % mod


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated_quality(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir).select("doc_id", "held_out", "score", "predicted")


def rated_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with score, held_out and predicted, by a model of the labelled documents in `sf_dir`."""
    sample = quality.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", remainder(4) != 2, QUALITY_ROWS)
    out = quality.score_quality(docs, quality.fit_quality(*sample), text)
    del sample
    released()
    return out.withColumn("held_out", F.coalesce(remainder(4, key) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= SURE).cast("int"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix_sources(docs).withColumn("second_position", F.get("positions", F.lit(1)))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "second_position").orderBy(F.col("position").asc_nulls_last(), mixing.order_hash(F.col("doc_id")))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(*quality.labelled_sample(docs, labels, "toxic", remainder(3) != 1, TOXIC_ROWS))
    released()
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= SURE).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), F.md5("text").alias("text"))
    out = sharding.balanced_shards(docs, F.col("text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(*langid.language_sample(docs, remainder(5) != 0, LANGUAGE_ROWS))
    released()
    out = langid.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.audio_columns(docs, outputs=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_mixing, op3_top_k, op4_toxicity, op5_bpe, op6_secrets, op7_sharding, op8_language, op9_jaccard, op10_audio)
}

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(chr(31), coalesce('=' || doc_id::VARCHAR, '-'), coalesce('=' || md5(text), '-'))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, [3, 1, 2][(k % 3 + 1)::INT]::BIGINT AS weight, 2 * words AS cap FROM r),
l AS (SELECT *, cap / weight::DOUBLE AS ratio,
        (3 * sum(words) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (2 * sum(weight) OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, words, k, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, cap::DOUBLE)) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.words AS source_size, t.target, t.k % 3 AS turn, floor(t.target + 0.5)::BIGINT AS goal,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, goal - before))::BIGINT AS one, greatest(0, least(size, goal - before - source_size))::BIGINT AS two,
        CASE WHEN target > 0 THEN least(before::DOUBLE / target, 1.0) ELSE 0.0 END * 1.0::DOUBLE AS need,
        CASE WHEN target > 0 THEN least((before + source_size)::DOUBLE / target, 1.0) ELSE 0.0 END * 1.0::DOUBLE AS more,
        [0.0, -1.0, 1.0][(turn + 1)::INT]::DOUBLE AS slope, [1.0, 1.5, 0.5][(turn + 1)::INT]::DOUBLE AS a FROM m)
SELECT doc_id, size, source_size, target, one + two AS taken,
       CASE WHEN one > 0 THEN round(CASE WHEN need > 0 THEN least(2.0 * need / (a + sqrt(greatest(a * a + 2.0 * slope * need, 0.0))), 1.0) ELSE 0.0 END, 9) END AS position,
       CASE WHEN two > 0 THEN round(CASE WHEN more > 0 THEN least(2.0 * more / (a + sqrt(greatest(a * a + 2.0 * slope * more, 0.0))), 1.0) ELSE 0.0 END, 9) END AS second_position
FROM e
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""


def secrets_sql() -> str:
    kinds = {"assign": (secrets.ASSIGN, 2, 6, 2**31), "access": (secrets.ACCESS, 0, 20, 2**31), "hex": (secrets.HEX, 0, 24, 2**31), "secret": (secrets.KEYLIKE, 0, 40, 40), "endpoint": (secrets.ENDPOINT, 0, 0, 2**31)}
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        pattern, group, least, most = kinds[kind]
        p = "'" + pattern.replace("'", "''") + "'"
        found.append(f"""SELECT r, {rank} AS rank, '{kind}' AS kind, unnest(list_zip(string_split_regex(t, {p}), regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, {group}))) AS x,
  generate_subscripts(string_split_regex(t, {p}), 1) AS i, {least} AS least, {most} AS most FROM d""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
g AS (SELECT *, sum(length(x[1]) + coalesce(length(x[2]), 0)) OVER (PARTITION BY r, rank ORDER BY i) AS b FROM f),
h AS (SELECT r, rank, kind, b - length(x[2]) AS a, b FROM g WHERE x[2] IS NOT NULL AND length(x[3]) BETWEEN least AND most),
near AS (SELECT * FROM h w WHERE rank < 3 OR EXISTS (SELECT 1 FROM h s WHERE s.r = w.r AND s.rank = 1 AND w.a <= s.b + {secrets.SCOPE} AND w.b >= s.a - {secrets.SCOPE})),
o AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < 3), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans FROM near GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
c AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM c GROUP BY x) m ON m.x = w.doc_id
"""

ORACLES = {"op2_mixing": MIXING_SQL, "op3_top_k": TOP_K_SQL, "op6_secrets": secrets_sql(), "op9_jaccard": JACCARD_SQL}
