"""Documents into chunks: by name, head, keywords, sliding windows, Markdown outline, code structure, or by what fits.

Files are rows of path (relative, /-separated), text and, for routing, size in bytes. Results have path, chunk_index,
label (what is matched and embedded), preview (what is shown), start_line and end_line. Everything but outlines and code
is column expressions; those two parse, and run as mapInPandas over the rows that need them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators.codeparse import code_chunks
from tarnlake.operators.outline import outline_chunks
from tarnlake.operators.shared import saved

SIZE, OVERLAP = 1000, 100
#: Characters of a file that are looked at.
MOST = 200_000
#: Bytes up to which mode auto takes windows of a file rather than its head.
WHOLE = 10_000
#: Kinds of files that are read as text. Fixed values.
TEXT_SUFFIXES = (
    ".txt", ".md", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".html", ".htm", ".toml", ".csv", ".log", ".ini", ".cfg", ".rst",
    ".tex", ".xml", ".sh", ".bat", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".swift", ".rs", ".kt", ".dart",
    ".scala", ".pl", ".r", ".jl", ".hs", ".lua", ".vb", ".ps1", ".bash", ".zsh", ".fish", ".vue", ".jsx", ".tsx", ".scss",
)
CODE_SUFFIXES = (".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
OUTLINE_SUFFIXES = (".md", ".markdown", ".mdx")
OTHER_SUFFIXES = (".pdf", ".docx", ".pptx")

COLUMNS = ("path", "chunk_index", "label", "preview", "start_line", "end_line")
_SCHEMA = "path string, chunk_index int, label string, preview string, start_line int, end_line int"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def suffix(path: Column) -> Column:
    """The last dot of the name and what follows, in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _none() -> Column:
    return F.lit(None).cast("int")


def by_name(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    return files.select("path", F.lit(0).alias("chunk_index"), F.replace(name, F.lit("_"), F.lit(" ")).alias("label"), name.alias("preview"), _none().alias("start_line"), _none().alias("end_line"))


def _or_name(files: DataFrame, label: Column, preview: Column, found: Column) -> DataFrame:
    name = file_name(F.col("path"))
    return files.select(
        "path", F.lit(0).alias("chunk_index"), F.when(found, label).otherwise(F.replace(name, F.lit("_"), F.lit(" "))).alias("label"),
        F.when(found, preview).otherwise(name).alias("preview"), _none().alias("start_line"), _none().alias("end_line"),
    )


def by_head(files: DataFrame) -> DataFrame:
    known = suffix(F.col("path")).isin(*TEXT_SUFFIXES, *OTHER_SUFFIXES)
    start = T.head(F.col("text"))
    return _or_name(files, F.concat(file_name(F.col("path")), F.lit(" :: "), start), T.trim_preview(start), known & start.isNotNull())


def by_keywords(files: DataFrame) -> DataFrame:
    known = suffix(F.col("path")).isin(*TEXT_SUFFIXES, *OTHER_SUFFIXES)
    words = F.slice(T.keywords(T.head(F.col("text"), T.BRIEF_HEAD)), 1, T.BRIEF_KEYWORDS)
    return _or_name(files, F.concat(file_name(F.col("path")), F.lit(" :: "), F.array_join(words, " ")), F.array_join(words, ", "), known & (F.size(words) > 0))


def windows(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each sliding window that isn't blank: adds window_index (dense from 0), window, start_line, end_line.

    Windows go over the stripped text; lines count in the original, so blank lines at its start are added back. A text's
    windows are made within its row, and only then does it become several rows.
    """
    size = max(int(size), 1)
    stride = max(size - max(int(overlap), 0), 1)
    edge = r"^[\p{IsWhite_Space}\x1c-\x1f]+"
    plain = df.withColumn("tl_raw", F.replace(F.substring(text, 1, MOST), F.lit("\r\n"), F.lit("\n"))).withColumn("tl_text", T.strip(F.col("tl_raw")))
    offset = F.length(F.regexp_extract("tl_raw", edge, 0)) - F.length(F.replace(F.regexp_extract("tl_raw", edge, 0), F.lit("\n"), F.lit("")))
    steps = F.greatest(F.ceil((F.length("tl_text") - size) / stride), F.lit(0)).cast("int")

    def newlines(upto: Column) -> Column:
        part = F.substring(F.col("tl_text"), F.lit(1), upto.cast("int"))
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def cut(i: Column) -> Column:
        start = i * stride
        piece = F.substring(F.col("tl_text"), (start + 1).cast("int"), F.lit(size))
        first = start + F.length(F.regexp_extract(piece, edge, 0))
        last = F.greatest(first, start + F.length(T.rstrip(piece)) - 1)
        return F.struct(T.strip(piece).alias("window"), (newlines(first) + 1 + F.col("tl_offset")).cast("int").alias("start_line"), (newlines(last) + 1 + F.col("tl_offset")).cast("int").alias("end_line"))

    made = F.filter(F.transform(F.sequence(F.lit(0), F.col("tl_steps")), cut), lambda w: w["window"] != "")
    plain = plain.withColumn("tl_offset", offset).withColumn("tl_steps", steps).where(F.length("tl_text") > 0)
    out = plain.select(*df.columns, F.posexplode(made).alias("window_index", "tl_window"))
    return out.select(*df.columns, "window_index", "tl_window.*")


def by_windows(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows; files of other kinds, and those without text, by name."""
    kind = suffix(F.col("path"))
    name = file_name(F.col("path"))
    cut = windows(files.where(kind.isin(*TEXT_SUFFIXES, *OTHER_SUFFIXES)).select("path", "text"), "text", size, overlap)
    flat = T.flatten(F.col("window"))
    lined = kind.isin(*TEXT_SUFFIXES)
    cut = cut.select(
        "path", F.col("window_index").alias("chunk_index"), F.concat(name, F.lit(" [#"), (F.col("window_index") + 1).cast("string"), F.lit("] :: "), flat).alias("label"),
        T.trim_preview(flat).alias("preview"), F.when(lined, F.col("start_line")).alias("start_line"), F.when(lined, F.col("end_line")).alias("end_line"),
    )
    blank = ~kind.isin(*TEXT_SUFFIXES, *OTHER_SUFFIXES) | (F.coalesce(T.strip(F.substring("text", 1, MOST)), F.lit("")) == "")
    return cut.unionByName(by_name(files.where(blank)))


def _parsed(files: DataFrame, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Chunks that `parse(path, text)` finds, as (display, text, start_line, end_line); one row without a display where none."""
    schema = "path string, part int, display string, body string, start_line int, end_line int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                found = parse(path, (text or "")[:MOST])
                rows += [(path, i, *x) for i, x in enumerate(found)] or [(path, -1, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["path", "part", "display", "body", "start_line", "end_line"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "part": "int32"})

    return files.select("path", "text").mapInPandas(run, schema)


def _with_fallback(files: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks, and windows of the files that have none."""
    lost = files.join(found.select("path").distinct(), "path", "left_anti")
    return found.unionByName(by_windows(lost))


def by_outline(files: DataFrame) -> DataFrame:
    """A chunk for each Markdown section; other files, and those without headings, by windows."""
    marked = files.where(suffix(F.col("path")).isin(*OUTLINE_SUFFIXES))
    parts = _parsed(marked, outline_chunks).where("part >= 0")
    name, some = file_name(F.col("path")), F.col("body") != ""
    found = parts.select(
        "path", F.col("part").alias("chunk_index"), F.when(some, F.concat_ws(" :: ", name, "display", "body")).otherwise(F.concat_ws(" :: ", name, "display")).alias("label"),
        F.when(some, F.concat_ws(" :: ", "display", T.trim_preview(F.col("body")))).otherwise(F.col("display")).alias("preview"), "start_line", "end_line",
    )
    return _with_fallback(files, found)


def by_code(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Functions, classes, methods and what stands between them, long ones by windows; other files by windows."""
    coded = files.where(suffix(F.col("path")).isin(*CODE_SUFFIXES))
    parts = _parsed(coded, code_chunks).where("part >= 0").withColumnsRenamed({"start_line": "from_line", "end_line": "to_line"})
    cut = windows(parts, "body", size, overlap)
    of_part = Window.partitionBy("path", "part")
    in_file = Window.partitionBy("path").orderBy("part", "window_index")
    cut = cut.withColumn("many", F.count(F.lit(1)).over(of_part)).withColumn("flat", T.flatten(F.col("window"))).where("flat is not null")
    shown = F.concat(F.col("display"), F.when(F.col("many") > 1, F.concat(F.lit(" [#"), (F.col("window_index") + 1).cast("string"), F.lit("]"))).otherwise(""))
    found = cut.select(
        "path", (F.row_number().over(in_file) - 1).alias("chunk_index"), F.concat_ws(" :: ", file_name(F.col("path")), shown, "flat").alias("label"),
        F.concat_ws(" :: ", shown, T.trim_preview(F.col("flat"))).alias("preview"), F.col("from_line").alias("start_line"), F.col("to_line").alias("end_line"),
    )
    return _with_fallback(files, found)


def route(path: Column, size: Column) -> Column:
    """What mode auto does with a file."""
    kind = suffix(path)
    return F.when(kind.isin(*CODE_SUFFIXES), "code").when(kind.isin(*OUTLINE_SUFFIXES), "outline").when(size <= WHOLE, "full").otherwise("head")


def by_kind(files: DataFrame) -> DataFrame:
    size = F.col("size") if "size" in files.columns else F.octet_length("text")
    routed = files.withColumn("tl_route", route(F.col("path"), size))
    parts = [chunk(routed.where(F.col("tl_route") == mode).drop("tl_route")) for mode, chunk in (("code", by_code), ("outline", by_outline), ("full", by_windows), ("head", by_head))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MODES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "auto": by_kind, "brief": by_keywords, "code": by_code, "full": by_windows, "head": by_head, "name": by_name, "outline": by_outline,
}


def available_modes() -> list[str]:
    return sorted(MODES)


def chunked(files: DataFrame, mode: str = "auto") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(available_modes())}")
    return MODES[mode](files).select(*COLUMNS)


def uses_code_chunking(mode: str, path: Column) -> Column:
    return F.lit(mode in ("auto", "code")) & suffix(path).isin(*CODE_SUFFIXES)


def position(chunks: DataFrame) -> DataFrame:
    """Adds position: the order of chunks by path, then chunk_index, from 0, without a window over all rows."""
    sizes = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("tl_n"))
    ranged = saved(sizes.repartitionByRange("path").withColumn("tl_part", F.spark_partition_id()))
    before, total = {}, 0
    for row in ranged.groupBy("tl_part").agg(F.sum("tl_n").alias("n")).orderBy("tl_part").collect():
        before[row["tl_part"]] = total
        total += row["n"]
    running = F.sum("tl_n").over(Window.partitionBy("tl_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.create_map(*[F.lit(x).cast("long") for item in (before or {0: 0}).items() for x in item])
    starts = ranged.select("path", (F.coalesce(running, F.lit(0)) + F.element_at(offsets, F.col("tl_part").cast("long"))).alias("tl_start"))
    within = F.row_number().over(Window.partitionBy("path").orderBy("chunk_index")) - 1
    return chunks.withColumn("tl_within", within).join(starts, "path").withColumn("position", (F.col("tl_start") + F.col("tl_within")).cast("long")).drop("tl_within", "tl_start")
