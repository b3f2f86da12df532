"""A session over one data folder: index and search file trees, in memory or stored, and collections."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import chunking, maintenance, ranking
from tarnlake.operators.collections import LETTERS, Collection, Embedder, Files, clear_collections, list_collections, tokens_of
from tarnlake.sources import scan as scanning
from tarnlake.streaming.stream import Freshness

CHUNKS = "path string, chunk_index int, label string, preview string, start_line int, end_line int, position long, label_hash string, embedding array<float>, tokens array<string>, doc_len int"
FILES = "path string, absolute string, size long, mtime double"
RERANKERS = ("off", "bm25", "hybrid")


@dataclass(frozen=True)
class Options:
    """What of a tree is indexed, and how."""

    mode: str = "auto"
    include_hidden: bool = False
    respect_gitignore: bool = True
    recursive: bool = True
    extensions: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    @classmethod
    def of(cls, extensions: Sequence[str] | None = None, excludes: Sequence[str] | None = None, **rest: Any) -> Options:
        out = cls(extensions=maintenance.normalize_extensions(extensions), excludes=maintenance.normalize_excludes(excludes), **rest)
        if out.mode not in chunking.MODES:
            raise ValueError(f"unknown mode {out.mode}; there are {', '.join(chunking.available_modes())}")
        return out


@dataclass(frozen=True)
class IndexResult:
    status: str  # empty, up_to_date, stored
    files: int = 0


@dataclass(frozen=True)
class Response:
    results: list[dict] = field(default_factory=list)
    stale: bool = False
    index_empty: bool = False


def index_key(root: str, options: Options) -> str:
    o = options
    said = f"{root}|hidden={o.include_hidden}|gitignore={o.respect_gitignore}|recursive={o.recursive}|mode={o.mode}"
    said += f"|ext={','.join(o.extensions)}" * bool(o.extensions) + f"|exclude={','.join(o.excludes)}" * bool(o.excludes)
    return hashlib.sha1(said.encode()).hexdigest()


def chunk_frame(files: DataFrame, options: Options, embedder: Embedder, cached: DataFrame | None = None) -> DataFrame:
    """Chunks of files (with text), embedded; files whose labels are all as in `cached` keep their vectors."""
    chunks = chunking.chunked(files, options.mode).withColumn("label_hash", F.sha1("label"))
    if cached is None:
        out = maintenance.embed_distinct(chunks, "label", embedder.column)
    else:
        known = cached.select(F.col("label_hash").alias("text_hash"), "embedding")
        out = maintenance.embed_distinct(chunks, "label", embedder.column, known)
    return out.withColumn("tokens", T.tokenize(ranking.document(F.col("path"), F.col("label")))).withColumn("doc_len", F.size("tokens")).withColumn("embedding", F.col("embedding").cast("array<float>"))


def search_chunks(chunks: DataFrame, query: str, vector: Sequence[float], top: int, rerank: str = "off", everything: DataFrame | None = None) -> list[dict]:
    """The best chunks for a query. Lexical statistics are those of `everything` stored; ranks are among `chunks`."""
    if top <= 0:
        raise ValueError("top must be positive")
    scored = chunks.withColumn("unit", ranking.normalized(F.col("embedding")))
    dense = ranking.dense_scores(scored, ranking.unit(vector), "position", "unit")
    terms = tokens_of(chunks.sparkSession, query) if rerank != "off" else []
    best = dense.withColumnRenamed("dense", "score")
    label: str | None = rerank
    if rerank == "hybrid":
        lexical = ranking.bm25_direct(chunks if everything is None else everything, terms, "position") if terms else None
        if lexical is not None and not lexical.where("bm25 > 0").isEmpty():
            best = ranking.fuse(dense, lexical, "position", top)
        else:
            label = None
    k = ranking.candidates(top) if rerank == "bm25" else top
    best = ranking.top(best, "score", "position", k)
    shown = chunks.select("position", "path", "chunk_index", "preview", "start_line", "end_line")
    rows = [r.asDict() for r in shown.join(F.broadcast(best), "position").orderBy("rank").collect()]
    if rerank == "bm25" and rows:
        said = [f"{r['path'].rsplit('/', 1)[-1]} {r['path']} {r['preview'] or ''}".strip() for r in rows]
        tokens = [x["t"] for x in chunks.sparkSession.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", T.pieces(F.col("s")).alias("t")).orderBy("i").collect()]
        words = chunks.sparkSession.range(1).select(T.pieces(F.lit(query)).alias("t")).first()["t"]
        rows = [rows[i] | {"score": s} for i, s in ranking.rerank_bm25([r["score"] for r in rows], words, tokens)][:top]
    return [r | {"rank": i, "reranker": label} for i, r in enumerate(rows, 1)]


class InMemoryIndex:
    """An index that is nowhere but in Spark's cache."""

    def __init__(self, chunks: DataFrame, embedder: Embedder):
        self.chunks, self.embedder = chunks.persist(), embedder

    def search(self, query: str, top: int = 5, rerank: str = "off") -> Response:
        query = checked_query(query)
        if self.chunks.isEmpty():
            return Response(index_empty=True)
        return Response(search_chunks(self.chunks, query, self.embedder.vector(query), top, rerank))

    def close(self) -> None:
        self.chunks.unpersist()


def checked_query(query: str) -> str:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query is blank")
    return query.strip()


class Client:
    """`data_dir` holds indexes and collections. `embedder` makes the vectors of both."""

    def __init__(self, spark: SparkSession, data_dir: str, embedder: Embedder = LETTERS, freshness: Freshness | None = None):
        self.spark, self.data_dir, self.embedder = spark, data_dir.rstrip("/"), embedder
        self.freshness = freshness or Freshness()

    # -- collections

    def collection(self, name: str) -> Collection:
        return Collection(self.spark, self.data_dir, name, self.embedder)

    def collections(self) -> list:
        return list_collections(self.spark, self.data_dir)

    def clear_collections(self) -> int:
        return clear_collections(self.spark, self.data_dir)

    # -- indexes

    def _files(self, key: str) -> Files:
        return Files(self.spark, f"{self.data_dir}/indexes/{key}")

    def catalog(self) -> list[dict]:
        """What is indexed, newest first."""
        top = Files(self.spark, f"{self.data_dir}/indexes")
        found = [json.loads(x) | {"version": v} for v, x in map(top.pointer, top.folders()) if x]
        return sorted(found, key=lambda x: x["generated_at"], reverse=True)

    def _stored(self, entry: Mapping[str, Any], table: str) -> DataFrame:
        return self.spark.read.schema(CHUNKS if table == "chunks" else FILES).parquet(f"{self.data_dir}/indexes/{entry['key']}/{entry['generation']}/{table}")

    def _scan(self, root: Path, o: Options) -> DataFrame:
        return scanning.scan(self.spark, root, include_hidden=o.include_hidden, recursive=o.recursive, extensions=o.extensions, exclude_patterns=o.excludes, respect_gitignore=o.respect_gitignore)

    def index(self, path: str = ".", **options: Any) -> IndexResult:
        """Builds or updates the index of a tree: few changes are worked in, many make it anew."""
        root, o = scanning.resolve_directory(path), Options.of(**options)
        files = self._scan(root, o).persist()
        count = files.count()
        if not count:
            return IndexResult("empty")
        key = index_key(str(root), o)
        base = next((e for e in self.catalog() if e["key"] == key), None)
        entry = base if base and base["model"] == self.embedder.model else None
        if entry:
            cached = self._stored(entry, "files")
            rename = lambda df: df.withColumnRenamed("path", "rel_path")
            diff = maintenance.snapshot_diff(rename(files), rename(cached)).persist()
            ratio = maintenance.change_ratio(diff).first()["ratio"]
            if not ratio:
                return IndexResult("up_to_date", count)
            if ratio <= maintenance.INCREMENTAL:
                same = diff.where("change = 'same'").select(F.col("rel_path").alias("path"))
                old = self._stored(entry, "chunks")
                kept = old.join(same, "path", "left_semi").drop("position")
                made = chunk_frame(scanning.read_texts(files.join(same, "path", "left_anti")), o, self.embedder, old)
                return self._write(key, base, root, o, files, count, kept.unionByName(made.select(*kept.columns)))
        return self._write(key, base, root, o, files, count, chunk_frame(scanning.read_texts(files), o, self.embedder))

    def _write(self, key: str, base: Mapping[str, Any] | None, root: Path, o: Options, files: DataFrame, count: int, chunks: DataFrame) -> IndexResult:
        generation = f"g{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.data_dir}/indexes/{key}/{generation}"
        names = [f.name for f in self.spark.createDataFrame([], CHUNKS).schema]
        chunking.position(chunks).select(*names).write.parquet(f"{at}/chunks")
        files.write.parquet(f"{at}/files")
        size = self.spark.read.schema(CHUNKS).parquet(f"{at}/chunks").select(F.max(F.size("embedding"))).first()[0]
        entry = {"key": key, "root": str(root), "model": self.embedder.model, "dimension": size, "generation": generation, "generated_at": time.time(), "file_count": count} | asdict(o)
        store = self._files(key)
        store.move(base["version"] if base else 0, json.dumps(entry))
        store.clean({generation, base["generation"] if base else ""})
        return IndexResult("stored", count)

    def index_in_memory(self, path: str = ".", **options: Any) -> InMemoryIndex:
        root, o = scanning.resolve_directory(path), Options.of(**options)
        return InMemoryIndex(chunking.position(chunk_frame(scanning.read_texts(self._scan(root, o)), o, self.embedder)), self.embedder)

    def clear_index(self, path: str = ".", **options: Any) -> int:
        key = index_key(str(scanning.resolve_directory(path)), Options.of(**options))
        return int(self._files(key).delete(""))

    def clear_indexes(self) -> int:
        n = len(self.catalog())
        Files(self.spark, f"{self.data_dir}/indexes").delete("")
        return n

    def _covering(self, root: str, o: Options) -> dict | None:
        entries = self.catalog()
        if not entries:
            return None
        fields = "index_id string, root string, model string, mode string, include_hidden boolean, respect_gitignore boolean, recursive boolean, extensions array<string>, excludes array<string>, dimension int, file_count long"
        rows = [(e["key"], e["root"], e["model"], e["mode"], e["include_hidden"], e["respect_gitignore"], e["recursive"], e["extensions"], e["excludes"], e["dimension"], e["file_count"]) for e in entries]
        request = maintenance.Request(root, self.embedder.model, o.mode, o.include_hidden, o.respect_gitignore, o.recursive, o.extensions, o.excludes)
        row = maintenance.covering_index(self.spark.createDataFrame(rows, fields), request).first()
        return next((e for e in entries if row and e["key"] == row["index_id"]), None)

    def search(self, query: str, path: str = ".", top: int = 5, rerank: str = "off", auto_index: bool = True, **options: Any) -> Response:
        """The best chunks below `path`, from the index that covers it; built first if there is none, and renewed if stale."""
        query = checked_query(query)
        if rerank not in RERANKERS:
            rerank = "off"
        root, o = scanning.resolve_directory(path), Options.of(**options)
        entry = self._covering(str(root), o)
        if entry is None:
            if not auto_index:
                raise FileNotFoundError(f"no index covers {root}")
            if self.index(path, **options).status == "empty":
                return Response(index_empty=True)
            entry = self._covering(str(root), o)
        stale = False
        above = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items() if k in Options.__dataclass_fields__})
        if not self.freshness.fresh(entry["root"], entry["generation"]):
            token = self.freshness.begin(entry["root"])
            rename = lambda df: df.withColumnRenamed("path", "rel_path")
            diff = maintenance.snapshot_diff(rename(self._scan(Path(entry["root"]), above)), rename(self._stored(entry, "files")))
            stale = not diff.where("change <> 'same'").isEmpty()
            if stale and auto_index:
                self.index(entry["root"], **asdict(replace(above)))
                entry = next(e for e in self.catalog() if e["key"] == entry["key"])
                stale = False
            stale = stale or not self.freshness.finish(entry["root"], entry["generation"], token)
        whole = self._stored(entry, "chunks")
        inside = str(root.relative_to(entry["root"])) if str(root) != entry["root"] else ""
        held = whole.where(maintenance.under(F.col("path"), inside, o.recursive)).where(maintenance.has_extension(F.col("path"), o.extensions))
        if o.excludes:
            rules = scanning.IgnoreRules(o.excludes)
            skip = len(inside) + 1 if inside else 0
            spared = F.udf(lambda p: rules.ignores(p[skip:]), "boolean")  # a glob matcher over distinct paths only
            gone = held.select("path").distinct().where(spared("path"))
            held = held.join(gone, "path", "left_anti")
        if held.isEmpty():
            return Response(index_empty=True, stale=stale)
        return Response(search_chunks(held, query, self.embedder.vector(query), top, rerank, whole), stale)


def porcelain(results: Sequence[Mapping[str, Any]], zero: bool = False) -> str:
    """Results as tab-separated lines: rank, similarity, path, chunk, first and last line, preview; - where there is none."""
    escape: Callable[[str], str] = lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    lines = []
    for r in results:
        cells = [str(r["rank"]), f"{r['score']:.3f}", r["path"], str(r["chunk_index"]), *("-" if r[k] is None else str(r[k]) for k in ("start_line", "end_line", "preview"))]
        lines.append("\t".join(map(escape, cells)))
    end = "\0" if zero else "\n"
    return "".join(x + end for x in lines)


def as_json(results: Sequence[Mapping[str, Any]]) -> str:
    keys = ("rank", "score", "path", "chunk_index", "start_line", "end_line", "preview")
    return json.dumps([{k: round(r[k], 4) if k == "score" else r[k] for k in keys} for r in results], ensure_ascii=False)
