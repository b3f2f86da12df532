"""Collections of records: upsert, delete, fetch, filter and search over immutable generations.

A collection is a folder of Parquet generations and a small pointer file that names the current one. Writers make a new
generation and then move the pointer; readers resolve the pointer once and read one generation throughout, so they never
see half a write. Plain Parquet has no MERGE: what stays is an anti-join, what changes is added.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import ranking as R
from tarnlake.operators.filters import METADATA, CollectionError, encoded_metadata, predicate

SCHEMA_VERSION = 1
#: Seconds after which a generation that no pointer names, or a claim, is taken to be left over.
STALE = 6 * 3600.0
RECORDS = f"record_id long, record_key string, text string, text_hash string, metadata {METADATA}, embedding array<float>, tokens array<string>, doc_len int, updated_at timestamp"


@dataclass(frozen=True)
class Embedder:
    """`column` makes the vectors of a text column; `vector` that of one query, on the driver."""

    provider: str
    model: str
    column: Callable[[Column], Column]
    vector: Callable[[str], Sequence[float]]


def letters(text: str) -> list[float]:
    low = text.lower()
    return [float(low.count(chr(c))) for c in range(97, 123)]


LETTERS = Embedder("builtin", "letters", T.letter_histogram, letters)


def python_embedder(provider: str, model: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64) -> Embedder:
    """An embedder from a function over lists of texts; on executors it runs in Arrow batches, `batch` texts a call."""

    @F.pandas_udf("array<float>")
    def column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            rows = [list(map(float, v)) for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            yield pd.Series(rows, index=part.index, dtype=object)

    return Embedder(provider, model, column, lambda text: embed([text])[0])


@dataclass(frozen=True)
class Info:
    """A collection's contract and state."""

    id: str
    name: str
    provider: str
    model: str
    dimension: int | None
    schema_version: int
    created_at: str
    generation: str | None = None
    next_id: int = 1
    count: int = 0
    version: int = 0


@dataclass(frozen=True)
class UpsertReport:
    written: int
    embedded: int
    skipped: int


class Files:
    """Whole small files in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path("").getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        fs, path = self.fs(), self.path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _listed(self, folder: str, start: str) -> list[Any]:
        fs, path = self.fs(), self.path(folder)
        return sorted((x for x in fs.listStatus(path) if x.getPath().getName().startswith(start)), key=lambda x: x.getPath().getName()) if fs.exists(path) else []

    def pointer(self, folder: str = "") -> tuple[int, str | None]:
        """Version and content of the newest pointer; 0 and None where there is none."""
        for found in reversed(self._listed(folder, "pointer-")):
            name = found.getPath().getName()
            if (text := self.read(f"{folder}/{name}" if folder else name)) is not None:
                return int(name.split("-")[1].split(".")[0]), text
        return 0, None

    def move(self, base: int, text: str) -> None:
        """Makes version `base` + 1 of the pointer, if `base` is the newest one still; CollectionError otherwise.

        A version is claimed by a file that only one writer can create, and appears whole, by a rename; the version
        before stays, so there is a pointer at any time. The claim of a writer that was lost counts for STALE seconds.
        """
        fs, name = self.fs(), f"{base + 1:012d}"
        claim, fresh = self.path(f"claim-{name}"), self.path(f"new-{name}.{uuid.uuid4().hex}")
        try:
            if fs.exists(claim) and self.pointer()[0] == base and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
                fs.delete(claim, False)
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise CollectionError(f"another writer has changed {self.root}; read it again") from e
        if self.pointer()[0] != base:
            fs.delete(claim, False)
            raise CollectionError(f"another writer has changed {self.root}; read it again")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        if not fs.rename(fresh, self.path(f"pointer-{name}.json")):
            raise OSError(f"can't move the pointer of {self.root}")
        for old in self._listed("", "pointer-")[:-2]:  # readers that have begun may hold the one before
            number = old.getPath().getName()[len("pointer-") : -len(".json")]
            fs.delete(old.getPath(), False)
            fs.delete(self.path(f"claim-{number}"), False)

    def clean(self, keep: set[str]) -> None:
        """Deletes generations that aren't kept and that no writer can be at work on, by their age."""
        for name in self.folders():
            if name not in keep and name[1:21].isdigit() and time.time() - int(name[1:21]) / 1e9 > STALE:
                self.delete(name)

    def delete(self, name: str) -> bool:
        fs, path = self.fs(), self.path(name)
        return fs.exists(path) and fs.delete(path, True)

    def folders(self) -> list[str]:
        fs, path = self.fs(), self.path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def checked_records(records: Sequence[Mapping[str, Any]]) -> list[tuple]:
    """(record_key, text, encoded metadata) of mappings with id, text and metadata, or CollectionError."""
    out, seen = [], set()
    for r in records:
        if not isinstance(r, Mapping):
            raise CollectionError("a record is a mapping with id, text and metadata")
        key, text = r.get("id"), r.get("text")
        if not isinstance(key, str) or not key.strip():
            raise CollectionError("a record's id is a string that isn't blank")
        key = key.strip()
        if key in seen:
            raise CollectionError(f"id {key} occurs twice")
        seen.add(key)
        if not isinstance(text, str) or not text.strip():
            raise CollectionError(f"the text of {key} is a string that isn't blank")
        out.append((key, text, encoded_metadata(r.get("metadata"))))
    return out


def merged(old: DataFrame, new: DataFrame, first_id: int, embedder: Embedder) -> DataFrame:
    """A generation: `old` records (schema RECORDS) with `new` ones (record_key, text, metadata) put in.

    A record keeps its id and, while its text is the same, its vector and tokens; metadata is replaced whole. New ids
    follow the order of keys. Texts are embedded once each.
    """
    fresh = new.withColumn("text_hash", F.sha1("text"))
    had = old.select("record_key", F.col("record_id").alias("old_id"), F.col("text_hash").alias("old_hash"), F.col("embedding").alias("old_vector"), F.col("tokens").alias("old_tokens"))
    both = fresh.join(had, "record_key", "left")
    same = F.col("old_hash") == F.col("text_hash")
    unchanged = both.where(F.coalesce(same & F.col("old_vector").isNotNull(), F.lit(False))).withColumns({"embedding": F.col("old_vector"), "tokens": F.col("old_tokens")})
    changed = both.where(~F.coalesce(same & F.col("old_vector").isNotNull(), F.lit(False)))
    vectors = changed.select("text_hash", "text").dropDuplicates(["text_hash"]).select("text_hash", embedder.column(F.col("text")).alias("embedding"))
    changed = changed.join(vectors, "text_hash").withColumn("tokens", T.tokenize(F.col("text")))
    columns = ["record_key", "text", "text_hash", "metadata", "embedding", "tokens", "old_id"]
    put = unchanged.select(*columns).unionByName(changed.select(*columns))
    known = put.where("old_id is not null").withColumn("record_id", F.col("old_id"))
    # rank within sorted partitions, offset by the partitions before: no window over all new records
    added = R._ranks(put.where("old_id is null").withColumn("tl_zero", F.lit(0)), "tl_zero", "record_key", "tl_rank", put)
    added = put.where("old_id is null").join(added, "record_key").withColumn("record_id", (F.col("tl_rank") + first_id - 1).cast("long")).drop("tl_rank")
    stamped = known.unionByName(added).withColumn("doc_len", F.size("tokens")).withColumn("updated_at", F.current_timestamp())
    names = [f.split()[0] for f in RECORDS.split(", ") if not f.startswith("num:")]
    kept = old.join(new.select("record_key"), "record_key", "left_anti")
    return kept.select(*names).unionByName(stamped.withColumn("embedding", F.col("embedding").cast("array<float>")).select(*names))


def ranked_records(records: DataFrame, query: str, vector: Sequence[float], k: int, filters: Mapping[str, Any] | None = None, rerank: str = "off") -> DataFrame:
    """The k best records (record_id, score, rank) among those that `filters` lets through: filtered first, then scored.

    Dense scores are cosines. With `rerank` "hybrid", BM25 over the filtered records (statistics, too) is fused in,
    unless the query has no tokens or nothing matches.
    """
    held = records.where(predicate(filters)).where(F.size("embedding") == len(vector))
    scored = held.withColumn("embedding", R.normalized(F.col("embedding")))
    dense = R.dense_scores(scored, R.unit(vector), "record_id")
    if rerank == "hybrid":
        terms = list(dict.fromkeys(tokens_of(records.sparkSession, query)))[: R.MOST_TERMS]
        lexical = R.bm25_direct(held.where("doc_len > 0"), terms, "record_id") if terms else None
        if lexical is not None and not lexical.where("bm25 > 0").isEmpty():
            return R.top(R.fuse(dense, lexical, "record_id", k), "score", "record_id", k)
    return R.top(dense.withColumnRenamed("dense", "score"), "score", "record_id", k)


def tokens_of(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(T.tokenize(F.lit(query)).alias("t")).first()["t"]


class Collection:
    """A named collection in `data_dir`; nothing is there until the first upsert."""

    def __init__(self, spark: SparkSession, data_dir: str, name: str, embedder: Embedder = LETTERS):
        if not isinstance(name, str) or not name.strip():
            raise CollectionError("a collection's name is a string that isn't blank")
        self.spark, self.name, self.embedder = spark, name.strip(), embedder
        self.files = Files(spark, f"{data_dir.rstrip('/')}/collections/{self.name.encode().hex()}")

    # -- state

    def info(self) -> Info | None:
        version, said = self.files.pointer()
        return replace(Info(**json.loads(said)), version=version) if said else None

    def _checked(self, info: Info | None) -> Info | None:
        if info and (info.provider, info.model) != (self.embedder.provider, self.embedder.model):
            raise CollectionError(f"collection {self.name} was made with {info.provider}/{info.model}, not {self.embedder.provider}/{self.embedder.model}")
        return info

    def records(self, info: Info | None = None) -> DataFrame:
        info = info or self.info()
        if not info or not info.generation:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(f"{self.files.root}/{info.generation}")

    def _publish(self, info: Info, generation: DataFrame) -> Info:
        name = f"g{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        generation.write.parquet(f"{self.files.root}/{name}")
        stored = self.spark.read.schema(RECORDS).parquet(f"{self.files.root}/{name}")
        row = stored.agg(F.count(F.lit(1)).alias("n"), F.max("record_id").alias("top"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        dimension = info.dimension or row["high"]
        if row["n"] and (row["low"], row["high"]) != (dimension, dimension):
            self.files.delete(name)
            raise CollectionError(f"collection {self.name} has dimension {dimension}, not {row['low'] if row['low'] != dimension else row['high']}")
        old = info.generation
        info = replace(info, generation=name, dimension=dimension, next_id=max(info.next_id, (row["top"] or 0) + 1), count=row["n"])
        try:
            self.files.move(info.version, json.dumps(asdict(info)))
        except CollectionError:
            self.files.delete(name)
            raise
        self.files.clean({name, old or ""})
        return replace(info, version=info.version + 1)

    # -- writing

    def upsert(self, id: str, text: str, metadata: Mapping[str, Any] | None = None) -> UpsertReport:
        return self.upsert_many([{"id": id, "text": text, "metadata": metadata}])

    def upsert_many(self, records: Sequence[Mapping[str, Any]]) -> UpsertReport:
        rows = checked_records(records)
        return self.upsert_frame(self.spark.createDataFrame(rows, f"record_key string, text string, metadata {METADATA}"))

    def upsert_frame(self, records: DataFrame) -> UpsertReport:
        """Records of any number (record_key, text, metadata as encoded in filters). Checked before anything is written."""
        records = records.select(F.trim("record_key").alias("record_key"), "text", "metadata")
        blank = (F.coalesce(F.col("record_key"), F.lit("")) == "") | (F.coalesce(T.strip(F.col("text")), F.lit("")) == "")
        row = records.agg(F.count(F.lit(1)).alias("n"), F.sum(blank.cast("int")).alias("blank")).first()
        if row["blank"]:
            raise CollectionError("records have an id and a text that aren't blank")
        if twice := records.groupBy("record_key").count().where("count > 1").first():
            raise CollectionError(f"id {twice['record_key']} occurs twice")
        info = self._checked(self.info())
        if not row["n"]:
            return UpsertReport(0, 0, 0)
        new = info is None
        info = info or Info(uuid.uuid4().hex, self.name, self.embedder.provider, self.embedder.model, None, SCHEMA_VERSION, datetime.now(UTC).isoformat())
        old = self.records(info)
        same = records.withColumn("h", F.sha1("text")).join(old.select("record_key", "text_hash"), "record_key").where("h = text_hash").count()
        try:
            self._publish(info, merged(old, records, info.next_id, self.embedder))
        except Exception:
            if new and not self.info():  # another writer may have made it meanwhile
                self.files.delete("")
            raise
        return UpsertReport(row["n"], row["n"] - same, same)

    def delete(self, id: str) -> bool:
        return self.delete_many([id]) > 0

    def delete_many(self, ids: Sequence[str]) -> int:
        return self.delete_frame(self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "record_key string")) if ids else 0

    def delete_frame(self, gone: DataFrame) -> int:
        """Deletes the records with the keys (record_key) of a frame of any size; how many there were."""
        info = self.info()
        if not info:
            return 0
        kept = self.records(info).join(gone.select("record_key"), "record_key", "left_anti")
        after = self._publish(info, kept.select(*[f.name for f in self.records(info).schema]))
        return info.count - after.count

    def drop(self) -> bool:
        return self.files.delete("")

    def drop_if_empty(self, id: str) -> bool:
        """Drops the collection only if it still is the one with this id, and has no records."""
        info = self.info()
        return bool(info and info.id == id and not info.count) and self.drop()

    # -- reading

    def count(self) -> int:
        info = self.info()
        return info.count if info else 0

    def get(self, id: str) -> dict | None:
        return next(iter(self.get_many([id])), None)

    def get_many(self, ids: Sequence[str]) -> list[dict]:
        """In the order asked for, each once; unknown ids are left out."""
        asked = self.spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "record_key string, place int")
        rows = self.records().join(F.broadcast(asked), "record_key").orderBy("place").collect()
        return [record_of(r) for r in rows]

    def search(self, query: str, top_k: int = 5, filters: Mapping[str, Any] | None = None, rerank: str = "off") -> list[dict]:
        if not isinstance(query, str) or not query.strip():
            raise CollectionError("the query is blank")
        predicate(filters)  # mistakes show before anything runs
        info = self._checked(self.info())
        if info is None:
            raise CollectionError(f"there is no collection {self.name}")
        if top_k <= 0 or not info.count:
            return []
        vector = self.embedder.vector(query)
        if info.dimension and len(vector) != info.dimension:
            raise CollectionError(f"dimension mismatch: the query has {len(vector)}, the collection {info.dimension}")
        records = self.records(info)
        best = ranked_records(records, query, vector, top_k, filters, rerank)
        rows = records.join(F.broadcast(best.select("record_id", "score", "rank")), "record_id").orderBy("rank").collect()  # texts of the winners only
        return [record_of(r) | {"score": r["score"]} for r in rows]


def record_of(row: Any) -> dict:
    """A record as the caller gave it; datetimes come back as ISO strings."""
    return {"id": row["record_key"], "text": row["text"], "metadata": {k: v["text"] if v["text"] is not None else v["num"] for k, v in (row["metadata"] or {}).items()}}


def list_collections(spark: SparkSession, data_dir: str) -> list[Info]:
    files = Files(spark, f"{data_dir.rstrip('/')}/collections")
    found = (files.pointer(f)[1] for f in files.folders())
    return sorted((Info(**json.loads(x)) for x in found if x), key=lambda i: i.name)


def clear_collections(spark: SparkSession, data_dir: str) -> int:
    n = len(list_collections(spark, data_dir))
    Files(spark, f"{data_dir.rstrip('/')}/collections").delete("")
    return n


def newest_per_key(records: DataFrame, order: Column) -> DataFrame:
    """One row for each record_key: the last by `order`."""
    last = Window.partitionBy("record_key").orderBy(order.desc())
    return records.withColumn("tl_n", F.row_number().over(last)).where("tl_n = 1").drop("tl_n")
