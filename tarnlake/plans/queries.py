"""The engine's operators as queries over whole tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import chunking, collections, filters, maintenance, ranking
from tarnlake.operators.shared import shared_dir, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASKED = "the licensed thinonea over of the in"
TOP = 10


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_PIECE = r"'[^\s\p{Z}\x0B\x85\p{P}$+<=>^\x60\x7C~]+'"


def tokens_sql(source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in tok(key, tokens, doc_len)."""
    return rf"""pc AS (SELECT {key}, {text} AS t, list_transform(list_filter(regexp_extract_all({text}, {_PIECE}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: lower(x)) AS p FROM {source}),
tok AS (SELECT {key}, list_concat(p, list_filter(regexp_extract_all(lower(t), '[A-Za-z0-9_]+'), lambda w: NOT list_contains(p, w))) AS tokens FROM pc)"""


def terms_of(text: str) -> list[str]:
    """Query terms of plain ASCII words."""
    return list(dict.fromkeys(text.lower().split()))


def bm25_sql(source: str, terms: list[str] | None = None) -> str:
    """CTEs that end in bm25(doc_id, score)."""
    wanted = ", ".join(f"'{t}'" for t in terms or terms_of(ASKED))
    return f"""{tokens_sql(source)},
st AS (SELECT count(*) AS n, sum(len(tokens))::DOUBLE / count(*) AS a FROM tok),
po AS (SELECT doc_id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM tok) WHERE term IN ({wanted}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bm25 AS (SELECT doc_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
         FROM po JOIN df USING (term), st GROUP BY doc_id)"""


# --- tokens and lexical ranking ------------------------------------------------------------------------------------


@registered(f"WITH {tokens_sql('documents')} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct FROM tok")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return docs.select("doc_id", F.col("doc_len").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@registered(f"WITH {tokens_sql('documents')} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return ranking.postings(docs, "doc_id").select("doc_id", "term", "tf")


@registered(f"WITH {tokens_sql('documents')} SELECT count(*) AS doc_count, round(sum(len(tokens))::DOUBLE / count(*), 6) AS avg_doc_len FROM tok")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return ranking.corpus_stats(docs).select("doc_count", F.round("avg_doc_len", 6).alias("avg_doc_len"))


@registered(f"WITH {tokens_sql('documents')} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return ranking.document_frequency(ranking.postings(docs, "doc_id"))


def _bm25(docs: DataFrame) -> DataFrame:
    held = ranking.with_tokens(docs.select("doc_id", "text"), F.col("text"))
    best = ranking.top(ranking.bm25_direct(held, terms_of(ASKED), "doc_id"), "bm25", "doc_id", TOP)
    return best.select("rank", "doc_id", F.round("bm25", 6).alias("score"))


_RANKED = f"SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM bm25 ORDER BY round(score, 9) DESC, doc_id LIMIT {TOP}"


@registered(f"WITH {bm25_sql('documents')} {_RANKED}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(table(spark, sf_dir, "documents"))


@registered(f"""WITH en AS (SELECT * FROM documents WHERE lang = 'en'), {bm25_sql("en")} {_RANKED}""")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(table(spark, sf_dir, "documents").where("lang = 'en'"))


@registered(f"WITH {bm25_sql('documents')} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    scores = ranking.bm25_scores(ranking.postings(docs, "doc_id"), terms_of(ASKED), ranking.corpus_stats(docs), "doc_id")
    return scores.select("doc_id", F.round("bm25", 6).alias("score"))


# --- dense and fused ranking ---------------------------------------------------------------------------------------


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0] * 64


_DENSE = """q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
qn AS (SELECT list_transform(qv, lambda x: x / sqrt(list_sum(list_transform(qv, lambda y: y * y)))) AS qv FROM q),
vn AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n FROM embeddings)),
dn AS (SELECT vec_id, list_dot_product(v, qv) AS dense FROM vn, qn)"""


@registered(f"WITH {_DENSE} SELECT row_number() OVER (ORDER BY round(dense, 9) DESC, vec_id)::INT AS rank, vec_id, round(dense, 6) AS score FROM dn ORDER BY round(dense, 9) DESC, vec_id LIMIT {TOP}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("unit", ranking.normalized(F.col("embedding")))
    scores = ranking.dense_scores(vectors, ranking.unit(_query_vector(spark, sf_dir)), "vec_id", "unit")
    return ranking.top(scores, "dense", "vec_id", TOP).select("rank", "vec_id", F.round("dense", 6).alias("score"))


@registered("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(ranking.l2_norm(F.col("embedding")), 6).alias("norm"))


def _fused_sql(lexical: str) -> str:
    return f"""WITH {_DENSE}, both_ AS (SELECT d.* FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id), {bm25_sql(lexical)},
dr AS (SELECT doc_id, row_number() OVER (ORDER BY round(dense, 9) DESC, doc_id) AS r FROM dn JOIN both_ ON doc_id = vec_id),
lr AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm25 SEMI JOIN both_ USING (doc_id) WHERE score > 0),
fs AS (SELECT dr.doc_id, 0.7::DOUBLE * 61 / (60 + dr.r) + coalesce(0.3::DOUBLE * 61 / (60 + lr.r), 0) AS score FROM dr LEFT JOIN lr USING (doc_id))
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM fs ORDER BY round(score, 9) DESC, doc_id LIMIT {TOP}"""


def _fused(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), ranking.normalized(F.col("embedding")).alias("unit"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dense = ranking.dense_scores(vectors.join(docs.select("doc_id"), "doc_id", "left_semi"), ranking.unit(_query_vector(spark, sf_dir)), "doc_id", "unit")
    held = docs if whole else docs.join(vectors.select("doc_id"), "doc_id", "left_semi")
    lexical = ranking.bm25_direct(ranking.with_tokens(held, F.col("text")), terms_of(ASKED), "doc_id")
    return ranking.top(ranking.fuse(dense, lexical, "doc_id", TOP), "score", "doc_id", TOP).select("rank", "doc_id", F.round("score", 6).alias("score"))


@registered(_fused_sql("both_"))
def hybrid_rrf_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical statistics of the records that have vectors."""
    return _fused(spark, sf_dir, False)


@registered(_fused_sql("documents"))
def hybrid_rrf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical statistics of everything stored, ranks among the rows that are searched."""
    return _fused(spark, sf_dir, True)


# --- metadata filters ------------------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and metadata: lang, n_chars, source (None for src0), and toxic where there is a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    source = filters.text_value(F.nullif(F.col("source"), F.lit("src0")))
    entries = F.array(entry("lang", filters.text_value(F.col("lang"))), entry("n_chars", filters.number_value(F.col("n_chars"))), entry("source", source))
    toxic = F.when(F.col("toxic").isNotNull(), F.array(entry("toxic", filters.number_value(F.col("toxic")))))
    return both.select("doc_id", F.map_from_entries(F.concat(entries, F.coalesce(toxic, F.slice(entries, 1, 0)))).alias("metadata"))


_LABELLED = "WITH l AS (SELECT d.doc_id, lang, n_chars, nullif(source, 'src0') AS source, toxic FROM documents d LEFT JOIN labels USING (doc_id)) SELECT doc_id FROM l WHERE "

FILTERS: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"lang": "en"}, "lang = 'en'"),
    "filter_eq_number": ({"toxic": True}, "toxic = 1"),
    "filter_ne": ({"toxic": {"ne": 1}}, "toxic IS DISTINCT FROM 1"),
    "filter_in": ({"lang": {"in": ["de", "fr", 3]}}, "lang IN ('de', 'fr')"),
    "filter_nin": ({"toxic": {"nin": [1, 7]}}, "toxic IS NULL OR toxic NOT IN (1, 7)"),
    "filter_gt": ({"n_chars": {"gt": 2000}}, "n_chars > 2000"),
    "filter_range": ({"n_chars": {"gte": 500, "lt": 1500}, "lang": {"ne": "es"}}, "n_chars >= 500 AND n_chars < 1500 AND lang IS DISTINCT FROM 'es'"),
    "filter_exists": ({"toxic": {"exists": True}}, "toxic IS NOT NULL"),
    "filter_missing": ({"toxic": {"exists": False}}, "toxic IS NULL"),
    "filter_eq_none": ({"source": None}, "source IS NULL"),
    "filter_ne_none": ({"source": {"ne": None}}, "source IS NOT NULL"),
    "filter_other_type": ({"lang": 1}, "false"),
}


def _filtered(condition: dict) -> Query:
    return lambda spark, sf_dir: labelled(spark, sf_dir).where(filters.predicate(condition)).select("doc_id")


for _name, (_condition, _where) in FILTERS.items():
    QUERIES[_name], ORACLES[_name] = _filtered(_condition), _LABELLED + _where


@registered("SELECT event_id FROM events WHERE epoch_us(ts) >= 1704067200000000 + 86400000000 AND epoch_us(ts) < 1704067200000000 + 864000000000")
def filter_datetime_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import UTC, datetime

    events = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("ts"), filters.time_value(F.col("ts").cast("timestamp"))).alias("metadata"))
    between = {"ts": {"gte": datetime(2024, 1, 2, tzinfo=UTC), "lt": datetime(2024, 1, 11, tzinfo=UTC)}}
    return events.where(filters.predicate(between)).select("event_id")


# --- chunking --------------------------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace(regexp_replace(replace(left(text, 200000), chr(13) || chr(10), chr(10)), '^[\s\p{Z}\x0B\x85\x1c-\x1f]+', ''), '[\s\p{Z}\x0B\x85\x1c-\x1f]+$', '')"
_STRIP = r"regexp_replace(regexp_replace(w, '^[\s\p{Z}\x0B\x85\x1c-\x1f]+', ''), '[\s\p{Z}\x0B\x85\x1c-\x1f]+$', '')"
_WINDOWS = f"""WITH s AS (SELECT doc_id, {_STRIPPED} AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 1000) / 900.0), 0)::BIGINT + 1)) AS k FROM s WHERE length(t) > 0),
w AS (SELECT doc_id, t, k, substring(t, k * 900 + 1, 1000) AS w FROM i),
c AS (SELECT doc_id, t, k, w, {_STRIP} AS x FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS window_index FROM c WHERE x <> '')"""


@registered(f"{_WINDOWS} SELECT doc_id, window_index::INT AS window_index, length(x)::INT AS chars, sha1(x) AS digest FROM n")
def chunk_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "window_index", F.length("window").alias("chars"), F.sha1("window").alias("digest"))


@registered(rf"""{_WINDOWS},
p AS (SELECT doc_id, window_index, t, k * 900 + length(w) - length(regexp_replace(w, '^[\s\p{{Z}}\x0B\x85\x1c-\x1f]+', '')) AS a, k * 900 + length(regexp_replace(w, '[\s\p{{Z}}\x0B\x85\x1c-\x1f]+$', '')) - 1 AS b FROM n),
h AS (SELECT doc_id, length(regexp_extract(text, '^[\s\p{{Z}}\x0B\x85\x1c-\x1f]+')) - length(replace(regexp_extract(text, '^[\s\p{{Z}}\x0B\x85\x1c-\x1f]+'), chr(10), '')) AS o FROM documents)
SELECT doc_id, window_index::INT AS window_index, (length(left(t, a)) - length(replace(left(t, a), chr(10), '')) + 1 + o)::INT AS start_line,
  (length(left(t, greatest(a, b))) - length(replace(left(t, greatest(a, b)), chr(10), '')) + 1 + o)::INT AS end_line FROM p JOIN h USING (doc_id)""")
def chunk_full_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "window_index", "start_line", "end_line")


def _flat_sql(text: str) -> str:
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({text}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda y: regexp_replace(regexp_replace(y, '^[\s\p{{Z}}\x0B\x85\x1c-\x1f]+', ''), '[\s\p{{Z}}\x0B\x85\x1c-\x1f]+$', '')), lambda y: y <> ''), ' ')"


_TRIM = r"CASE WHEN length(f) <= 160 THEN f ELSE regexp_replace(left(f, 159), '[\s\p{Z}\x0B\x85\x1c-\x1f]+$', '') || '…' END"


@registered(f"SELECT doc_id, {_TRIM} AS preview FROM (SELECT doc_id, {_flat_sql('left(text, 1000)')} AS f FROM documents) WHERE f <> ''")
def preview_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.trim_preview(T.head(F.col("text"))).alias("preview"))
    return docs.where("preview is not null")


def as_files(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents as text files."""
    return docs.select(F.concat(F.lit("docs/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col(text).alias("text"))


@registered(f"SELECT 'docs/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt :: ' || f AS label, {_TRIM} AS preview FROM (SELECT doc_id, {_flat_sql('left(text, 1000)')} AS f FROM documents)")
def chunk_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(as_files(table(spark, sf_dir, "documents")), "head").select("path", "label", "preview")


@registered("SELECT page_id, list_extract(string_split(url, '/'), -1) AS preview, replace(list_extract(string_split(url, '/'), -1), '_', ' ') AS label FROM pages")
def chunk_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    named = chunking.chunked(pages.select(F.col("url").alias("path"), F.lit("").alias("text")).distinct(), "name").select(F.col("path").alias("url"), "preview", "label")
    return pages.select("page_id", "url").join(named, "url").select("page_id", "preview", "label")


@registered(f"""WITH m AS (SELECT doc_id, {_flat_sql('left(text, 4000)')} AS f FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(f, '[A-Za-z][A-Za-z0-9_-]+')) AS raw, generate_subscripts(regexp_extract_all(f, '[A-Za-z][A-Za-z0-9_-]+'), 1) AS pos FROM m),
g AS (SELECT doc_id, lower(raw) AS k, count(*) AS n, min(pos) AS first_pos, arg_min(raw, pos) AS shown FROM w WHERE length(raw) >= 3 AND lower(raw) NOT IN ({", ".join(f"'{s}'" for s in T.STOPWORDS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rn FROM g)
SELECT doc_id, string_agg(shown, ', ' ORDER BY rn) AS preview FROM r WHERE rn <= 10 GROUP BY doc_id""")
def keywords_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(T.keywords(T.head(F.col("text"), T.BRIEF_HEAD)), 1, T.BRIEF_KEYWORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, ", ").alias("preview")).where("preview <> ''")


@registered()
def outline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a heading over each, and one over its second half."""
    half = F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.substring(F.col("text"), F.lit(1), half), F.lit("\n\n## More\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), marked.alias("text"))
    return chunking.chunked(files, "outline")


@registered()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python sources: each a class whose docstring is the whole text."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r'[\\"\r\n]', " ")
    source = F.concat(F.lit("import os\n\n# about\nclass Doc:\n    '''"), F.replace(said, F.lit("'"), F.lit(" ")), F.lit("'''\n\n    def size(self):\n        return "), F.col("n_chars").cast("string"), F.lit("\n"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), source.alias("text"))
    return chunking.chunked(files, "code")


# --- maintenance ---------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Now, and a made-up snapshot before: some files missing, some of another time or size, some since removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    now = docs.where("doc_id % 11 <> 3").select(path.alias("rel_path"), F.lit(1000.0).alias("mtime"), F.col("n_chars").alias("size"))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 7).otherwise(0)
    mtime = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, 900.0).otherwise(1000.2).cast("double")
    return now, docs.where("doc_id % 7 <> 2").select(path.alias("rel_path"), mtime.alias("mtime"), size.alias("size"))


_DIFF = """WITH a AS (SELECT 'docs/' || doc_id AS rel_path, n_chars AS size FROM documents WHERE doc_id % 11 <> 3),
b AS (SELECT 'docs/' || doc_id AS rel_path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS size, doc_id % 13 = 0 AS untimed FROM documents WHERE doc_id % 7 <> 2),
d AS (SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN b.rel_path IS NULL THEN 'added' WHEN a.rel_path IS NULL THEN 'removed' WHEN untimed OR a.size <> b.size THEN 'modified' ELSE 'same' END AS change
      FROM a FULL JOIN b ON a.rel_path = b.rel_path)"""


@registered(f"{_DIFF} SELECT * FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.snapshot_diff(*_snapshots(spark, sf_dir))


@registered(f"""{_DIFF}, n AS (SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'same') AS same FROM d)
SELECT added, modified, removed, round((added + modified + removed)::DOUBLE / greatest(added + modified + same, removed + modified + same, 1), 6) AS ratio FROM n""")
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.change_ratio(maintenance.snapshot_diff(*_snapshots(spark, sf_dir))).withColumn("ratio", F.round("ratio", 6))


@registered("WITH c AS (SELECT doc_id % 50 AS f, doc_id, doc_id % 50 <> 7 AND doc_id % 50 <> 9 AS same FROM documents) SELECT 'f' || f AS path, bool_and(same) AS touch FROM c GROUP BY f")
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("doc_id").alias("chunk_index"), F.sha1("text").alias("label_hash"))
    old = chunks.where("path <> 'f9'").withColumn("label_hash", F.when(F.col("path") == "f7", F.lit("other")).otherwise(F.col("label_hash")))
    return maintenance.touched_files(chunks, old)


def _histogram_sql(text: str) -> str:
    return "[" + ", ".join(f"length(lower({text})) - length(replace(lower({text}), '{chr(c)}', ''))" for c in range(97, 123)) + "]"


@registered(f"SELECT doc_id, array_to_string({_histogram_sql('text')}, ',') AS letters FROM documents")
def letter_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.transform(T.letter_histogram(F.col("text")), lambda x: x.cast("int").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(vector, ",").alias("letters"))


@registered(f"SELECT doc_id, array_to_string({_histogram_sql('text')}, ',') AS letters FROM documents")
def embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are embedded once, and those of English documents come from a cache."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cache = docs.where("lang = 'en'").select(T.embedding_key(F.col("text")).alias("text_hash"), T.letter_histogram(F.col("text")).alias("embedding"))
    out = maintenance.embed_distinct(docs, "text", T.letter_histogram, cache)
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("letters"))


@registered(f"{_WINDOWS} SELECT doc_id, window_index::INT AS window_index, doc_id % 3 = 0 AS known FROM n")
def line_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which two thirds have lost their lines, with all lines again; `known` tells those that never lost them."""
    cut = chunking.windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fresh = cut.select(F.col("doc_id").alias("path"), F.col("window_index").alias("chunk_index"), "start_line", "end_line")
    keep = F.col("path") % 3 == 0
    old = fresh.select("path", "chunk_index", F.when(keep, F.lit(-1)).alias("start_line"), F.when(keep, F.lit(-1)).alias("end_line"))
    out = maintenance.backfill_lines(old, fresh).where("start_line is not null and end_line is not null")
    return out.select(F.col("path").alias("doc_id"), F.col("chunk_index").alias("window_index"), (F.col("start_line") == -1).alias("known"))


@registered("""WITH c AS (SELECT event_id AS id, 'u' || user_id AS text_hash, ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY ts DESC, CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END DESC, id DESC) AS n FROM c)
SELECT id, text_hash FROM r WHERE n = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY ORDER BY ts DESC, id DESC LIMIT 400""")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries for their users: the odd ones put into a cache of the even ones, then pruned."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    rows = events.select(F.col("event_id").alias("id"), F.lit("m").alias("model"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("text_hash"), F.array(F.col("value").cast("float")).alias("embedding"), F.col("ts").alias("created_at"))
    out = maintenance.put_embeddings(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 20, 400, F.lit(now))
    return out.select("id", "text_hash")


@registered("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"))
    now = events.agg(F.max("created_at").alias("tl_now"))
    return maintenance.prune_ttl(events.crossJoin(F.broadcast(now)), F.col("tl_now"), 10).select("event_id")


@registered("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def capacity_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return maintenance.prune_capacity(events, 5000).select(F.col("id").alias("event_id"))


@registered("SELECT 'i2' AS index_id, '/data' AS root")
def superset_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a few indexes, the one that covers a request."""
    rows = [
        ("i0", "/", "m", "auto", False, True, True, [], [], 26, 90),
        ("i1", "/data", "m", "auto", False, True, True, [".txt"], [], 26, 10),
        ("i2", "/data", "m", "auto", False, True, True, [".md", ".py"], ["*.tmp"], 26, 20),
        ("i3", "/data/docs", "m", "auto", True, True, True, [], [], 26, 5),
        ("i4", "/data/docs", "m", "auto", False, True, False, [], [], 26, 5),
        ("i5", "/data/docs", "m", "auto", False, True, True, [], ["*.py"], 26, 5),
        ("i6", "/dat", "m", "auto", False, True, True, [], [], 26, 5),
    ]
    catalog = spark.createDataFrame(rows, "index_id string, root string, model string, mode string, include_hidden boolean, respect_gitignore boolean, recursive boolean, extensions array<string>, excludes array<string>, dimension int, file_count long")
    request = maintenance.Request("/data/docs", "m", extensions=(".py",), excludes=("*.tmp", "*.log"), dimension=26)
    return maintenance.covering_index(catalog, request).select("index_id", "root")


_PATH = "array_to_string(list_slice(string_split(url, '/'), 4, 99), '/')"


@registered(rf"SELECT page_id, starts_with({_PATH}, 'a/') AS below, NOT contains({_PATH}, '/') AS direct, coalesce(regexp_extract(lower(list_extract(string_split({_PATH}, '/'), -1)), '^.+(\.[^.]+)$', 1), '') IN ('.html', '.htm') AS html FROM pages")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array_join(F.slice(F.split("url", "/", -1), 4, 99), "/")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p: Column = F.col("path")
    return pages.select("page_id", maintenance.under(p, "a").alias("below"), maintenance.under(p, "", recursive=False).alias("direct"), maintenance.has_extension(p, (".html", ".htm")).alias("html"))


# --- collections ---------------------------------------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as records."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    meta = F.create_map(F.lit("role"), filters.text_value(F.col("role")), F.lit("conv"), filters.number_value(F.col("conv_id")))
    return table(spark, sf_dir, "conversations").select(key.alias("record_key"), "text", meta.alias("metadata"), "conv_id", "turn").dropDuplicates(["record_key"])


def _generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put in, then those of every third conversation again: the even ones with a new text."""
    none = spark.createDataFrame([], collections.RECORDS)
    first = collections.merged(none, turns(spark, sf_dir).select("record_key", "text", "metadata"), 1, collections.LETTERS).persist()
    again = turns(spark, sf_dir).where("conv_id % 3 = 0").withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    return collections.merged(first, again.select("record_key", "text", "metadata"), 10**9, collections.LETTERS)


def _stored(spark: SparkSession, sf_dir: str) -> collections.Collection:
    out = collections.Collection(spark, f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}", "turns")
    out.upsert_frame(turns(spark, sf_dir).select("record_key", "text", "metadata"))
    return out


_TURNS = "c AS (SELECT conv_id || '-' || turn AS record_key, conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN text || ' again' ELSE text END AS text FROM conversations)"


@registered(f"WITH {_TURNS} SELECT record_key, row_number() OVER (ORDER BY record_key) AS record_id, sha1(text) AS text_hash, role, conv_id::DOUBLE AS conv FROM c")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _generation(spark, sf_dir)
    return out.select("record_key", "record_id", "text_hash", F.col("metadata")["role"]["text"].alias("role"), F.col("metadata")["conv"]["num"].alias("conv"))


@registered("SELECT count(*) AS written, count(*) FILTER (WHERE turn % 2 = 0) AS embedded, count(*) FILTER (WHERE turn % 2 <> 0) AS skipped FROM conversations WHERE conv_id % 3 = 0")
def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert over a stored collection reports."""
    again = turns(spark, sf_dir).where("conv_id % 3 = 0").withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    r = _stored(spark, sf_dir).upsert_frame(again.select("record_key", "text", "metadata"))
    return spark.createDataFrame([(r.written, r.embedded, r.skipped)], "written long, embedded long, skipped long")


@registered("SELECT conv_id || '-' || turn AS record_key FROM conversations WHERE NOT (role = 'user' AND conv_id % 4 = 1)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored collection without the records that a filter names; vectors and tokens go with them."""
    into = _stored(spark, sf_dir)
    into.delete_frame(into.records().where(filters.predicate({"role": "user"})).where("cast(split(record_key, '-')[0] as bigint) % 4 = 1"))
    return into.records().where("embedding is not null").select("record_key")


@registered(f"WITH {_TURNS}, k AS (SELECT unnest(['5-1', 'none', '0-0', '5-1', '3-0', '1-0']) AS record_key, generate_subscripts(['5-1', 'none', '0-0', '5-1', '3-0', '1-0'], 1) - 1 AS i), o AS (SELECT record_key, min(i) AS i FROM k GROUP BY record_key) SELECT row_number() OVER (ORDER BY i)::INT AS place, record_key, role FROM o JOIN c USING (record_key)")
def get_many_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stored collection in the order asked for, each once."""
    found = _stored(spark, sf_dir).get_many(["5-1", "none", "0-0", "5-1", "3-0", "1-0"])
    return spark.createDataFrame([(i, r["id"], r["metadata"]["role"]) for i, r in enumerate(found, 1)], "place int, record_key string, role string")


@registered()
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by users for a query, dense and lexical ranks fused."""
    records = _generation(spark, sf_dir).persist()
    best = collections.ranked_records(records, "please explain", collections.letters("please explain"), TOP, {"role": "user"}, "hybrid")
    return best.select("rank", "record_id", F.round("score", 6).alias("score"))


@registered("""SELECT 'user-' || user_id AS record_key, sha1(concat_ws(' ', event_type, props)) AS text_hash FROM events
WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of records, put into a collection until nothing more is there."""
    from tarnlake.streaming.stream import upsert_stream

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    read = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    meta = F.create_map(F.lit("value"), filters.number_value(F.col("value")))
    rows = read.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id"), F.concat_ws(" ", "event_type", "props").alias("text"), meta.alias("metadata"), F.col("event_id").cast("long").alias("seq"))
    into = collections.Collection(spark, f"{root}/data", "events")
    upsert_stream(rows, into, f"{root}/state").awaitTermination()
    return into.records().select("record_key", "text_hash")


# --- reranking and evaluation --------------------------------------------------------------------------------------


@registered(f"WITH {bm25_sql('documents')} SELECT doc_id, round(score / (SELECT max(score) FROM bm25), 6) AS share FROM bm25")
def max_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the largest one; 0 if none is positive."""
    docs = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    scores = ranking.bm25_direct(docs, terms_of(ASKED), "doc_id")
    return ranking.over_largest(scores, "bm25", "share").select("doc_id", F.round("share", 6).alias("share"))


@registered("SELECT unnest([1, 9, 10, 11, 50, 75, 100, 200])::INT AS k, unnest([20, 20, 20, 22, 100, 150, 150, 150])::INT AS candidates")
def rerank_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, ranking.candidates(k)) for k in (1, 9, 10, 11, 50, 75, 100, 200)], "k int, candidates int")


@registered(f"WITH {bm25_sql('documents')}, t AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS p FROM bm25 QUALIFY p < 20), r AS (SELECT doc_id, p, CASE WHEN p % 3 = 0 THEN -p END AS place FROM t) SELECT row_number() OVER (ORDER BY place NULLS LAST, p)::INT AS rank, doc_id FROM r")
def rank_apply_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker that names every third of 20 results, from the last, one twice and one that isn't there."""
    held = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    best = ranking.top(ranking.bm25_direct(held, terms_of(ASKED), "doc_id"), "bm25", "doc_id", 20)
    results = best.select((F.col("rank") - 1).alias("position"), "doc_id", F.col("bm25").alias("score"))
    named = [*range(18, -1, -3), 18, 99]
    ranked = spark.createDataFrame([(i, p, 1.0 / (p + 1)) for p, i in enumerate(named)], "index int, place int, new_score double")
    return ranking.apply_ranking(results, ranked).select("rank", "doc_id")


@registered(f"""WITH {bm25_sql('documents')}, t AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS p FROM bm25 QUALIFY p <= 20),
k AS (SELECT t.*, tok.tokens FROM t JOIN tok USING (doc_id)), m AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM k),
w AS (SELECT term, count(*) AS times FROM (SELECT unnest({ASKED.split()}) AS term) GROUP BY term),
g AS (SELECT w.term, w.times, count(*) FILTER (WHERE list_contains(k.tokens, w.term)) AS held FROM w, k GROUP BY ALL),
c AS (SELECT k.doc_id, g.times * (ln(m.n + 1) - ln(g.held + 0.5)) AS weight, len(list_filter(k.tokens, lambda x: x = g.term)) / (0.25 + 0.75 * len(k.tokens) / m.mean) AS c FROM k, g, m WHERE g.held > 0),
l AS (SELECT doc_id, sum(weight * 2.5 * (c + 0.5) / (2.0 + c)) AS l FROM c GROUP BY doc_id),
f AS (SELECT k.doc_id, k.p, 0.7 * k.score / max(k.score) OVER () + 0.3 * CASE WHEN max(l) OVER () > 0 THEN l / max(l) OVER () ELSE 0 END AS score FROM k JOIN l USING (doc_id))
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, p)::INT AS rank, doc_id, round(score, 6) AS score FROM f""")
def bm25l_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 by BM25 in a new order, fused with BM25L among themselves."""
    held = ranking.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    best = ranking.top(ranking.bm25_direct(held, terms_of(ASKED), "doc_id"), "bm25", "doc_id", 20)
    rows = held.join(F.broadcast(best.select("doc_id", "bm25", "rank")), "doc_id").orderBy("rank").select("doc_id", "bm25", "tokens").collect()  # 20 rows
    order = ranking.rerank_bm25([r["bm25"] for r in rows], ASKED.split(), [r["tokens"] for r in rows])
    return spark.createDataFrame([(k, rows[i]["doc_id"], round(s, 6)) for k, (i, s) in enumerate(order, 1)], "rank int, doc_id long, score double")


_EVAL = """WITH p AS (SELECT item_id, text, left(text, 40) AS probe FROM benchmark),
h AS (SELECT p.item_id, d.doc_id, contains(d.text, p.probe) AS hit FROM p, documents d),
r AS (SELECT item_id, min(doc_id) FILTER (WHERE hit) AS doc_id, count(*) FILTER (WHERE hit) AS n FROM h GROUP BY item_id)
SELECT round(avg(CASE WHEN n BETWEEN 1 AND 10 THEN 1.0 / n ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN n BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS hit5 FROM r"""


@registered(_EVAL)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries; the rank is how many documents hold an item's beginning."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("probe"))
    probes = F.broadcast(items.agg(F.collect_list(F.struct("item_id", "probe")).alias("probes")))  # the query set: a few hundred rows
    hits = table(spark, sf_dir, "documents").select("text").crossJoin(probes).select(F.explode(F.filter("probes", lambda p: F.contains(F.col("text"), p["probe"]))).alias("p"))
    ranks = items.join(hits.groupBy(F.col("p.item_id").alias("item_id")).agg(F.count(F.lit(1)).alias("rank")), "item_id", "left")
    out = ranking.quality_of(ranks)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@registered(f"""WITH RECURSIVE {bm25_sql('documents')},
t AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, length(text) AS n FROM bm25 JOIN documents USING (doc_id) QUALIFY rank <= {TOP}),
f AS (SELECT 0 AS rank, 0::BIGINT AS doc_id, 0::BIGINT AS chars, 0::BIGINT AS used UNION ALL
  SELECT t.rank, t.doc_id, x, used + x FROM f JOIN t ON t.rank = f.rank + 1, LATERAL (SELECT CASE WHEN least(2000, 8000 - used) < 200 THEN 0 ELSE least(n, 2000, 8000 - used) END AS x))
SELECT rank, doc_id, chars, CASE WHEN least(2000, 8000 - (used - chars)) < 200 THEN 'budget_exhausted' END AS reason FROM f WHERE rank > 0""")
def content_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the best windows within the shared budget."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = ranking.top(ranking.bm25_direct(ranking.with_tokens(docs, F.col("text")), terms_of(ASKED), "doc_id"), "bm25", "doc_id", TOP)
    rows = [r.asDict() for r in docs.join(F.broadcast(best), "doc_id").orderBy("rank").collect()]  # TOP rows
    shown = maintenance.with_contents([r | {"start_line": 1} for r in rows], lambda r, left: (r["text"] or "")[:left])
    return spark.createDataFrame([(r["rank"], r["doc_id"], len(r["content"] or ""), r["reason"]) for r in shown], "rank int, doc_id long, chars long, reason string")
