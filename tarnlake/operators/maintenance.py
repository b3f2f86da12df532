"""Keeping an index up to date: snapshot diffs, what to embed again, which index to reuse, and pruning of caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T

#: Share of changed files up to which an index is updated rather than built anew.
INCREMENTAL = 0.5
#: Seconds that times of change may differ by and still be the same.
SAME_TIME = 0.5
TTL_DAYS, CAPACITY = 30, 50_000


def snapshot_diff(current: DataFrame, cached: DataFrame, by_hash: bool = False) -> DataFrame:
    """rel_path and change (added, modified, removed, same) for two snapshots (rel_path, mtime, size).

    A file counts as modified if its cached time is unknown, or if its size is another (or unknown). As in the usual
    rule, edits that leave the size alone go unseen; `by_hash` compares a column `hash` instead.
    """
    a, b = current.alias("a"), cached.alias("b")
    both = a.join(b, F.col("a.rel_path") == F.col("b.rel_path"), "full_outer")
    if by_hash:
        changed = ~F.col("a.hash").eqNullSafe(F.col("b.hash"))
    else:
        other = F.col("b.size").isNull() | (F.col("a.size") != F.col("b.size"))
        late = F.abs(F.col("a.mtime") - F.col("b.mtime")) > SAME_TIME
        changed = F.col("b.mtime").isNull() | F.when(late, other).otherwise(F.coalesce(F.col("a.size") != F.col("b.size"), F.lit(False)))
    kind = F.when(F.col("b.rel_path").isNull(), "added").when(F.col("a.rel_path").isNull(), "removed").when(changed, "modified").otherwise("same")
    return both.select(F.coalesce("a.rel_path", "b.rel_path").alias("rel_path"), kind.alias("change"))


def change_ratio(diff: DataFrame) -> DataFrame:
    """One row: added, modified, removed, and their share of the larger snapshot (at least 1)."""
    n = {k: F.sum((F.col("change") == k).cast("long")) for k in ("added", "modified", "removed", "same")}
    n = {k: F.coalesce(v, F.lit(0)) for k, v in n.items()}
    larger = F.greatest(n["added"] + n["modified"] + n["same"], n["removed"] + n["modified"] + n["same"], F.lit(1))
    return diff.agg(n["added"].alias("added"), n["modified"].alias("modified"), n["removed"].alias("removed"), ((n["added"] + n["modified"] + n["removed"]) / larger).alias("ratio"))


def touched_files(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """path, touch: whether all chunks of a file have the label hashes they had, in the same number, so that nothing of it
    has to be embedded. Both frames have path, chunk_index, label_hash."""
    old = cached.select("path", "chunk_index", F.col("label_hash").alias("tl_old"))
    had = cached.groupBy("path").agg(F.count(F.lit(1)).alias("tl_had"))
    seen = chunks.join(old, ["path", "chunk_index"], "left").groupBy("path").agg(F.count(F.lit(1)).alias("tl_n"), F.bool_and(F.coalesce(F.col("label_hash") == F.col("tl_old"), F.lit(False))).alias("tl_same"))
    return seen.join(had, "path", "left").select("path", (F.col("tl_same") & (F.col("tl_n") == F.coalesce("tl_had", F.lit(0)))).alias("touch"))


def reuse_vectors(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks with the stored vector of the same path and chunk_index; null where there is none."""
    return chunks.join(cached.select("path", "chunk_index", "embedding"), ["path", "chunk_index"], "left")


def embed_distinct(df: DataFrame, text: str, embed: Callable[[Column], Column], cache: DataFrame | None = None, key: Callable[[Column], Column] = T.embedding_key) -> DataFrame:
    """Adds `embedding`: each distinct text is embedded once, and only if `cache` (text_hash, embedding) lacks it."""
    keyed = df.withColumn("tl_hash", key(F.col(text)))
    distinct = keyed.select("tl_hash", F.col(text).alias("tl_text")).dropDuplicates(["tl_hash"])
    known = None
    if cache is not None:
        known = cache.select(F.col("text_hash").alias("tl_hash"), "embedding").dropDuplicates(["tl_hash"])
        distinct = distinct.join(known.select("tl_hash"), "tl_hash", "left_anti")
    made = distinct.select("tl_hash", embed(F.col("tl_text")).alias("embedding"))
    return keyed.join(made if known is None else made.unionByName(known), "tl_hash", "left").drop("tl_hash")


def backfill_lines(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks whose lines are unknown get those of freshly cut ones (path, chunk_index, start_line, end_line); all else stays."""
    new = fresh.select("path", "chunk_index", F.col("start_line").alias("tl_start"), F.col("end_line").alias("tl_end"))
    both = chunks.join(new, ["path", "chunk_index"], "left")
    lost = F.col("start_line").isNull()
    filled = both.withColumn("end_line", F.when(lost, F.col("tl_end")).otherwise(F.col("end_line"))).withColumn("start_line", F.coalesce("start_line", "tl_start"))
    return filled.select(*chunks.columns)


def put_embeddings(cache: DataFrame, new: DataFrame, days: int = TTL_DAYS, most: int = CAPACITY, now: Column | None = None) -> DataFrame:
    """The embedding cache (id, model, text_hash, embedding, created_at) with new entries put in and old ones pruned.

    Of entries for one model and text the newest counts, a new one before an old one of the same time.
    """
    both = cache.withColumn("tl_new", F.lit(0)).unionByName(new.withColumn("tl_new", F.lit(1)))
    order = Window.partitionBy("model", "text_hash").orderBy(F.desc("created_at"), F.desc("tl_new"), F.desc("id"))
    held = both.withColumn("tl_n", F.row_number().over(order)).where("tl_n = 1").drop("tl_n", "tl_new")
    return prune_capacity(prune_ttl(held, now, days), most)


def prune_ttl(cache: DataFrame, now: Column | None = None, days: int = TTL_DAYS, created: str = "created_at") -> DataFrame:
    return cache.where(F.col(created) >= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))


def prune_capacity(cache: DataFrame, most: int = CAPACITY, created: str = "created_at", key: str = "id") -> DataFrame:
    """The newest `most` entries, by time and key."""
    return cache.orderBy(F.desc(created), F.desc(key)).limit(most)


# --- filters over paths --------------------------------------------------------------------------------------------


def normalize_extensions(values: Sequence[str | None] | None) -> tuple[str, ...]:
    parts = [p for v in values or () if v for p in re.split(r"[,\s]+", v)]
    dotted = {p if p.startswith(".") else f".{p}" for p in (p.strip().lower() for p in parts) if p.strip(".")}
    return tuple(sorted(dotted))


def normalize_excludes(values: Sequence[str | None] | None) -> tuple[str, ...]:
    parts = [p.strip() for v in values or () if v for p in re.split(r"[,\s]+", v)]
    return tuple(dict.fromkeys(f"**/*{p}" if re.fullmatch(r"\.[^/*?]+", p) else p for p in parts if p))


def under(path: Column, directory: str, recursive: bool = True) -> Column:
    """Whether a relative path is below `directory` ("" or "." is the root); without `recursive`, directly below it."""
    prefix = "" if directory in ("", ".") else directory.strip("/") + "/"
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return path.startswith(prefix) & (F.lit(True) if recursive else ~rest.contains("/"))


def has_extension(path: Column, extensions: Sequence[str], whole_name: bool = False) -> Column:
    """By what follows the last dot of the name, or (`whole_name`) by how the name ends."""
    name = F.lower(F.element_at(F.split(path, "/", -1), -1))
    if not extensions:
        return F.lit(True)
    if whole_name:
        return F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(name, e))
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1).isin(*extensions)


# --- which index answers a request ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """What an index must cover. Paths are absolute and /-separated."""

    root: str
    model: str
    mode: str = "auto"
    include_hidden: bool = False
    respect_gitignore: bool = True
    recursive: bool = True
    extensions: tuple[str, ...] = ()
    excludes: tuple[str, ...] = field(default=())
    dimension: int | None = None


def covering_index(catalog: DataFrame, request: Request) -> DataFrame:
    """The best index (one row, or none) whose files include all that the request asks for.

    Its root is the request's or above it, its flags, mode and model are the same, it goes deep enough, leaves out
    nothing that the request wants, and has the right dimension. The nearest root is best, then the same depth, fewer
    files, fewer extensions, and excludes closest to the request's.
    """
    parent = F.when(F.col("root") == "/", F.lit("/")).otherwise(F.concat("root", F.lit("/")))
    same = F.lit(request.root) == F.col("root")
    above = same | F.lit(request.root).startswith(parent)
    fits = above & (F.col("model") == request.model) & (F.col("mode") == request.mode) & (F.col("include_hidden") == request.include_hidden) & (F.col("respect_gitignore") == request.respect_gitignore)
    deep = F.col("recursive") | (same & F.lit(not request.recursive))
    wanted, spared = F.array(*map(F.lit, request.extensions)).cast("array<string>"), F.array(*map(F.lit, request.excludes)).cast("array<string>")
    broad = (F.size("extensions") == 0) | (F.lit(bool(request.extensions)) & (F.size(F.array_except(wanted, "extensions")) == 0))
    lenient = F.size(F.array_except("excludes", spared)) == 0
    sized = F.lit(True) if request.dimension is None else F.col("dimension") == request.dimension
    slashes = F.length(F.lit(request.root)) - F.length(F.replace(F.lit(request.root), F.lit("/"), F.lit("")))
    depth = F.when(same, 0).otherwise(slashes - F.when(F.col("root") == "/", 0).otherwise(F.length("root") - F.length(F.replace("root", F.lit("/"), F.lit("")))))
    found = catalog.where(fits & deep & broad & lenient & sized)
    return found.orderBy(depth, (F.col("recursive") != request.recursive).cast("int"), F.coalesce("file_count", F.lit(10**9)), F.size("extensions"), F.lit(len(request.excludes)) - F.size("excludes"), "index_id").limit(1)


# --- contents under a shared budget ---------------------------------------------------------------------------------

EACH, TOGETHER, WORTHWHILE = 2000, 8000, 200


def with_contents(results: Sequence[Mapping[str, Any]], read: Callable[[Mapping[str, Any], int], str | None], each: int = EACH, together: int = TOGETHER) -> list[dict]:
    """A few ranked results with `content`, or `reason` where there is none, until `together` characters are used up.

    A fold, for what a result may take depends on what those before it took. `read` gives a result's text within a
    number of characters, None if it can't be read and "" if it no longer matches.
    """
    out, used = [], 0
    for r in results:
        left = min(each, together - used)
        content, reason = None, None
        if r.get("start_line") is None:
            reason = "no_line_range"
        elif left < min(WORTHWHILE, each):
            reason = "budget_exhausted"
        else:
            content = read(r, left)
            reason = "unreadable" if content is None else None if content else "stale_line_range"
        used += len(content or "")
        out.append({**r, "content": content or None, "reason": reason})
    return out


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("tl_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("tl_n = 1").drop("tl_n")
