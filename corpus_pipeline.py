"""A training corpus in five stages, each reading what the stage before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe, jaccard, mixing, queries, secrets
from tarnlake.llm.store import dropped, saved


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under names that no operator uses, and the name of each column: a document table may have columns that are
    named like an operator's outputs, and keeps them."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(name).alias(c) for c, name in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good; null and empty texts, and those of white space alone, go.

    Very long texts are rated whole. Repeated rows stay or go together. Rows without an id are rated like others.
    """
    rows, at = apart(docs)
    return named(queries.rated_quality(spark, rows, sf_dir, at["doc_id"], at["text"]).where("predicted = 1"), at)


#: Near copies: texts whose sets of so many words in a row are alike to so many hundredths.
WORDS, PERCENT = 5, 80


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id.

    Texts without words are like no other and stay, as do rows without an id. Repeated rows of one id are one document:
    they stay or go together.
    """
    joined = jaccard.jaccard_components(docs.select("doc_id", "text"), words=WORDS, percent=PERCENT)
    return jaccard.one_of_each(docs, joined)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text (null for a null one).

    Empty and null texts stay as they are; repeated rows get equal texts.
    """
    rows, at = apart(docs)
    found = secrets.find_secrets(rows, at["text"], at["doc_id"], whole=True)
    found = found.withColumn(at["text"], secrets.masked(F.col(at["text"]), F.col("span_list")))
    return named(found.withColumn(at["n_chars"], F.length(at["text"]).cast("long")), at)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in training order; a document stands there as often as the mix begins it, each time at a place
    of its own, and whole.

    Documents that the mix doesn't take, and null and empty texts, go. Rows without a source are a source; repeated rows
    count one by one.
    """
    rows, at = apart(docs)
    taken = mixing.mix_sources(rows, at["text"], at["source"], at["doc_id"], turns=True)
    return named(mixing.in_training_order(taken, at["doc_id"]), at)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, token ids of every row, repeats too; null and empty texts have no tokens."""
    return bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), queries.tokenizer_path(), outputs=("n_tokens", "ids")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near copies", keep_distinct),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("encoding", encode),
]

#: The first stage's trained model is beyond SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
            dropped(before)
    return docs
