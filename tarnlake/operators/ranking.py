"""Lexical, dense and fused ranking of rows for a query, and reranking of a few candidates.

Frames here have an `id` that orders ties (smaller first), so every ranking is total. Nothing is ranked by a window over
all rows unless ranks of all rows are what is asked for: fusion only ranks the rows that can matter, see `fuse`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators.shared import saved

K1, B = 1.5, 0.75
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 0.7, 0.3
MOST_TERMS = 32
BM25L_DELTA = 0.5
PLACES = 9


def document(rel_path: Column, label: Column) -> Column:
    """What of a chunk is matched lexically."""
    return F.concat_ws(" ", rel_path, label)


def with_tokens(df: DataFrame, text: Column, tokens: str = "tokens", length: str = "doc_len") -> DataFrame:
    return df.withColumn(tokens, T.tokenize(text)).withColumn(length, F.size(tokens))


def postings(df: DataFrame, key: str, tokens: str = "tokens", length: str = "doc_len") -> DataFrame:
    """key, term, tf, doc_len: one row for each term of each document."""
    return df.select(key, length, F.explode(tokens).alias("term")).groupBy(key, length, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(df: DataFrame, length: str = "doc_len") -> DataFrame:
    """One row: doc_count, avg_doc_len."""
    return df.agg(F.count(F.lit(1)).alias("doc_count"), (F.sum(length) / F.count(F.lit(1))).alias("avg_doc_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(doc_count: Column | float, df: Column | float) -> Column:
    return F.log((doc_count - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, doc_len: Column, avg_doc_len: Column | float) -> Column:
    """A term's share of a score, without its idf."""
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * doc_len / avg_doc_len))


def bm25_scores(posted: DataFrame, terms: Sequence[str], stats: DataFrame, key: str) -> DataFrame:
    """key, bm25 of the documents that hold a query term: Okapi with an idf that is never negative.

    Only postings of the (at most 32, distinct) terms are read; the filter reaches the scan of stored postings.
    """
    terms = list(dict.fromkeys(terms))[:MOST_TERMS]
    held = posted.where(F.col("term").isin(*terms)) if terms else posted.limit(0)
    frequency = F.broadcast(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row for each query term, 32 at most
    scored = held.join(frequency, "term").crossJoin(F.broadcast(stats)).where("doc_count > 0 and avg_doc_len > 0")
    share = idf(F.col("doc_count"), F.col("df")) * bm25_term(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"))
    return scored.groupBy(key).agg(F.sum(share).alias("bm25"))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25_direct(df: DataFrame, terms: Sequence[str], key: str, tokens: str = "tokens", length: str = "doc_len", stats: DataFrame | None = None) -> DataFrame:
    """The same scores for texts that have no stored postings: counts of the query terms in each row, no explode and no
    shuffle of rows. Counts are written once; one pass over them makes the statistics (a single row), one scores."""
    terms = list(dict.fromkeys(terms))[:MOST_TERMS]
    if not terms:
        return df.select(key, F.lit(0.0).alias("bm25")).limit(0)
    held = F.filter(tokens, lambda x: x.isin(*terms))  # few of a text's tokens, which are gone through once
    counts = T.let(held, lambda x: F.array(*[F.size(F.filter(x, _is(t))) for t in terms]))
    counted = saved(df.select(key, length, counts.alias("tfs")))  # narrow, and read twice: texts are tokenized once
    known = [F.sum((F.col("tfs")[i] > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]
    own = [F.count(F.lit(1)).alias("doc_count"), (F.sum(length) / F.count(F.lit(1))).alias("avg_doc_len")] if stats is None else []
    summary = counted.agg(*known, *own)
    if stats is not None:
        summary = summary.crossJoin(F.broadcast(stats))
    scored = counted.where(F.exists("tfs", lambda x: x > 0)).crossJoin(F.broadcast(summary)).where("doc_count > 0 and avg_doc_len > 0")
    shares = [F.when(F.col("tfs")[i] > 0, idf(F.col("doc_count"), F.col(f"df_{i}")) * bm25_term(F.col("tfs")[i], F.col(length), F.col("avg_doc_len"))).otherwise(0.0) for i in range(len(terms))]
    return scored.select(key, reduce(lambda a, b: a + b, shares).alias("bm25"))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def unit(values: Sequence[float]) -> list[float]:
    norm = math.sqrt(sum(float(v) * float(v) for v in values)) or 1.0
    return [float(v) / norm for v in values]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dense_scores(df: DataFrame, query: Sequence[float], key: str, vector: str = "embedding") -> DataFrame:
    """key, dense: inner product with the query. Rows without a vector are left out; ValueError where one has another length."""
    have = df.where(F.col(vector).isNotNull())
    wrong = have.where(F.size(vector) != len(query)).select(F.size(vector)).first()
    if wrong:
        raise ValueError(f"dimension mismatch: the query has {len(query)}, a stored vector {wrong[0]}")
    return have.select(key, dot(F.col(vector), literal_vector(query)).alias("dense"))


def over_largest(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds `name`: the score over the largest one; 0 if none is positive."""
    largest = df.agg(F.max(score).alias("tl_most"))
    return df.crossJoin(F.broadcast(largest)).withColumn(name, F.when(F.col("tl_most") > 0, F.col(score) / F.col("tl_most")).otherwise(0.0)).drop("tl_most")


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows with their rank from 1: a top-k of each partition, then one of those. Scores that agree to PLACES
    decimal places are ties: sums of doubles differ in the last bits with the order of their parts."""
    order = [F.desc(F.round(score, PLACES)), F.col(key)]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _ranks(df: DataFrame, score: str, key: str, name: str, among: DataFrame) -> DataFrame:
    """key, name: the rank that rows of `among` have among all rows of `df`.

    No window over all rows: rows are range-partitioned by score, ranked within their partition, and the number of rows
    in the partitions before is added. Only these numbers, one for each partition, come to the driver.
    """
    order = [F.desc(F.round(score, PLACES)), F.col(key)]
    ordered = df.select(key, score).repartitionByRange(*order).withColumn("tl_part", F.spark_partition_id())
    placed = saved(ordered)  # written: bounds sampled anew, after a loss, would not fit the offsets
    before, running = {}, 0
    for row in placed.groupBy("tl_part").count().orderBy("tl_part").collect():
        before[row["tl_part"]] = running
        running += row["count"]
    within = F.row_number().over(Window.partitionBy("tl_part").orderBy(*order))
    offsets = F.create_map(*[F.lit(x).cast("long") for item in before.items() for x in item]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    ranked = placed.withColumn(name, within + F.element_at(offsets, F.col("tl_part").cast("long"))).select(key, name)
    return ranked.join(among.select(key), key, "left_semi")


def fuse(dense: DataFrame, lexical: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """key, score: reciprocal rank fusion of a dense and a lexical ranking; dense rows only.

    With `k`, only rows that can be among the k best are scored: the k best dense rows and those that match lexically.
    Any other row is beaten on the dense term by k rows and has no lexical one.
    """
    matched = lexical.where("bm25 > 0").join(dense.select(key), key, "left_semi")
    among = dense.select(key)
    if k is not None:
        among = dense.orderBy(F.desc(F.round("dense", PLACES)), key).limit(k).select(key).union(matched.select(key)).distinct()
    first = _ranks(dense, "dense", key, "dense_rank", among)
    second = _ranks(matched, "bm25", key, "bm25_rank", matched)
    one, two = DENSE_WEIGHT * (RRF_K + 1.0), LEXICAL_WEIGHT * (RRF_K + 1.0)
    score = one / (RRF_K + F.col("dense_rank")) + F.coalesce(two / (RRF_K + F.col("bm25_rank")), F.lit(0.0))
    return first.join(second, key, "left").select(key, score.alias("score"))


def candidates(k: int) -> int:
    """How many rows a reranker sees for a top k."""
    return min(max(2 * k, 20), 150)


def bm25l(query: Sequence[str], documents: Sequence[Sequence[str]]) -> list[float]:
    """BM25L of each of a few documents for query tokens (repeats count), their statistics among themselves."""
    n = len(documents)
    if not n:
        return []
    mean = sum(map(len, documents)) / n or 1.0
    out = [0.0] * n
    held = [frozenset(d) for d in documents]
    for term in query:
        df = sum(term in h for h in held)
        if not df:
            continue
        weight = math.log(n + 1) - math.log(df + 0.5)
        for i, d in enumerate(documents):
            c = d.count(term) / (1 - B + B * len(d) / mean)
            out[i] += weight * (K1 + 1) * (c + BM25L_DELTA) / (K1 + c + BM25L_DELTA)
    return out


def share_of_best(scores: Sequence[float]) -> list[float]:
    most = max(scores, default=0.0)
    return [s / most if most > 0 else 0.0 for s in scores]


def rerank_bm25(base: Sequence[float], query: Sequence[str], documents: Sequence[Sequence[str]]) -> list[tuple[int, float]]:
    """New order of a few candidates (index, score): their base scores fused with BM25L; unchanged without query tokens."""
    if not query:
        return list(enumerate(base))
    a, b = share_of_best([max(s, 0.0) for s in base]), share_of_best(bm25l(query, documents))
    fused = [DENSE_WEIGHT * x + LEXICAL_WEIGHT * y for x, y in zip(a, b, strict=True)]
    return sorted(enumerate(fused), key=lambda p: -p[1])


def apply_ranking(results: DataFrame, ranking: DataFrame) -> DataFrame:
    """Results (position from 0, score, ...) in a reranker's order (index, new_score, in its own `place`).

    Unknown indexes and repeats of one are dropped; results it doesn't name follow in their old order.
    """
    first = ranking.withColumn("tl_n", F.row_number().over(Window.partitionBy("index").orderBy("place"))).where("tl_n = 1")
    both = results.join(F.broadcast(first.select("index", "place", "new_score")), results["position"] == F.col("index"), "left")
    order = Window.orderBy(F.col("place").asc_nulls_last(), "position")
    return both.withColumn("rank", F.row_number().over(order)).withColumn("score", F.coalesce("new_score", "score")).drop("index", "place", "new_score")


Reranker = Callable[[str, Sequence[str]], Sequence[tuple[int, float]]]


def quality_of(ranks: DataFrame, rank: str = "rank", cutoff: int = 10) -> DataFrame:
    """One row: mrr, hit1 and hit5 of the ranks at which the expected results came (null: not found)."""
    r = F.col(rank)
    return ranks.agg(
        F.avg(F.when(r <= cutoff, 1.0 / r).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(r <= 1, 1.0).otherwise(0.0)).alias("hit1"),
        F.avg(F.when(r <= 5, 1.0).otherwise(0.0)).alias("hit5"),
    )
