"""Kernels of the retrieval engine: text, ranking, filters, chunking, maintenance, collections, streams, client."""

import json
import math
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tarnlake.client import Client, as_json, porcelain
from tarnlake.functions import text as T
from tarnlake.operators import chunking, collections, maintenance, ranking
from tarnlake.operators.codeparse import python_chunks, script_chunks
from tarnlake.operators.collections import Collection, clear_collections, list_collections, python_embedder
from tarnlake.operators.filters import METADATA, CollectionError, encoded_metadata, predicate
from tarnlake.operators.outline import outline_chunks
from tarnlake.sources import scan
from tarnlake.streaming.stream import Freshness, record_files, upsert_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- text ------------------------------------------------------------------------------------------------------------


def test_tokens(spark):
    tokens = value(spark, T.tokenize(F.lit("_apply_bm25_rerank")))
    assert {"apply", "bm25", "rerank", "_apply_bm25_rerank"} <= set(tokens)
    assert value(spark, T.tokenize(F.lit("!!!"))) == [] and value(spark, T.tokenize(F.lit(None).cast("string"))) == []
    assert value(spark, T.tokenize(F.lit("Alpha beta alpha"))) == ["alpha", "beta", "alpha"]
    assert len(value(spark, T.query_terms(F.lit(" ".join(f"t{i}" for i in range(50)))))) == 32


@pytest.mark.parametrize("text", ["", " a \n\n  b\tc \r\n", "\x1c x \x85 y  z ", "   é   ", "one\x0btwo\x0cthree\r\n\r\nfour", "\n"])
def test_white_space_as_python_has_it(spark, text):
    assert value(spark, T.strip(F.lit(text))) == text.strip()
    assert value(spark, T.splitlines(F.lit(text))) == text.splitlines()
    flat = " ".join(x.strip() for x in text.splitlines() if x.strip())
    assert value(spark, T.flatten(F.lit(text))) == (flat or None)


def test_preview(spark):
    assert value(spark, T.trim_preview(F.lit(" short "))) == "short"
    long = value(spark, T.trim_preview(F.lit("x" * 158 + " y" * 30)))
    assert long == "x" * 158 + "…"


def test_keywords(spark):
    text = F.lit("Vector search uses vector indexes. The Search engine: 向量 检索 向量 需要")
    assert value(spark, T.keywords(text)) == ["Vector", "search", "向量", "uses", "indexes", "engine", "检索"]


def test_keys(spark):
    import hashlib

    assert value(spark, T.embedding_key(F.lit("é"), 5)) == hashlib.sha1("é|dim=5".encode()).hexdigest()
    assert value(spark, T.query_key(F.lit(" q "), "openai/m")) == hashlib.sha1(b"q|model=m").hexdigest()


# --- ranking ---------------------------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    posted = spark.createDataFrame([(0, "alpha", 2, 3), (1, "alpha", 1, 2), (1, "beta", 1, 2)], "id int, term string, tf int, doc_len int")
    stats = spark.createDataFrame([(3, 2.0)], "doc_count long, avg_doc_len double")
    got = {r["id"]: r["bm25"] for r in ranking.bm25_scores(posted, ["alpha", "beta", "alpha"], stats, "id").collect()}
    assert got[0] == pytest.approx(math.log((3 - 2 + 0.5) / 2.5 + 1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert got[1] == pytest.approx(math.log(1.5 / 2.5 + 1) + math.log(2.5 / 1.5 + 1))
    assert ranking.bm25_scores(posted, ["alpha"], stats.withColumn("avg_doc_len", F.lit(0.0)), "id").count() == 0
    assert ranking.bm25_scores(posted, [], stats, "id").count() == 0


def test_fusion_by_hand(spark):
    dense = spark.createDataFrame([(0, 0.9), (1, 0.5), (2, 0.1)], "id int, dense double")
    lexical = spark.createDataFrame([(0, 3.0), (2, 2.0), (7, 9.0)], "id int, bm25 double").where("id <> 7")
    for k in (None, 3):
        got = {r["id"]: r["score"] for r in ranking.fuse(dense, lexical, "id", k).collect()}
        assert got == pytest.approx({0: 1.0, 1: 0.7 * 61 / 62, 2: 0.7 * 61 / 63 + 0.3 * 61 / 62})
    assert [r["id"] for r in ranking.top(ranking.fuse(dense, lexical, "id", 1), "score", "id", 1).collect()] == [0]


def test_lexical_rescue(spark):
    rows = [(i, [1.0, i / 100.0]) for i in range(24)] + [(24, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id int, embedding array<float>").withColumn("embedding", ranking.normalized(F.col("embedding")))
    dense = ranking.dense_scores(vectors, [1.0, 0.0], "id")
    lexical = spark.createDataFrame([(24, 5.0)], "id int, bm25 double")
    full = {r["id"]: r["score"] for r in ranking.fuse(dense, lexical, "id").collect()}
    cut = {r["id"]: r["score"] for r in ranking.fuse(dense, lexical, "id", 2).collect()}
    assert all(full[i] == pytest.approx(s) for i, s in cut.items()) and 24 in cut


def test_dense(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id int, embedding array<float>")
    assert df.select(ranking.normalized(F.col("embedding")).alias("v")).first()["v"] == pytest.approx([0.6, 0.8])
    assert ranking.dense_scores(df, [1.0, 0.0], "id").count() == 2
    with pytest.raises(ValueError, match="3.*2"):
        ranking.dense_scores(df, [1.0, 0.0, 0.0], "id")


def test_rerank(spark):
    assert [ranking.candidates(k) for k in (1, 9, 10, 11, 50, 75, 100, 200)] == [20, 20, 20, 22, 100, 150, 150, 150]
    docs = [["alpha", "alpha", "beta"], ["gamma", "delta"], ["beta", "gamma"]]
    assert [i for i, _ in ranking.rerank_bm25([0.1, 0.9, 0.2], ["alpha"], docs)] == [1, 0, 2]
    assert ranking.rerank_bm25([0.1, 0.9], [], docs[:2]) == [(0, 0.1), (1, 0.9)]
    results = spark.createDataFrame([(i, f"r{i}", 1.0) for i in range(4)], "position int, name string, score double")
    order = spark.createDataFrame([(2, 0, 9.0), (9, 1, 8.0), (2, 2, 7.0), (0, 3, None)], "index int, place int, new_score double")
    got = [(r["name"], r["score"]) for r in ranking.apply_ranking(results, order).orderBy("rank").collect()]
    assert got == [("r2", 9.0), ("r0", 1.0), ("r1", 1.0), ("r3", 1.0)]


# --- filters ---------------------------------------------------------------------------------------------------------

NOON = datetime(2024, 5, 1, 12, tzinfo=UTC)
RECORDS = {
    "a": {"status": "closed", "n": 1, "flag": True, "when": NOON, "gone": None},
    "b": {"status": "open", "n": 2.5, "flag": False},
    "c": {"n": 3},
    "d": {},
    "e": None,
}


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (None, "abcde"), ({}, "abcde"), ({"status": "closed"}, "a"), ({"status": {"ne": "closed"}}, "bcde"), ({"flag": 1}, "a"), ({"n": {"in": [1, "x", 3]}}, "ac"),
        ({"n": {"nin": [1, 3]}}, "bde"), ({"n": {"gt": 1, "LTE": 3}}, "bc"), ({"status": 1}, ""), ({"gone": None}, "a"), ({"gone": {"ne": None}}, "bcde"),
        ({"n": {"exists": True}}, "abc"), ({"n": {"exists": False}}, "de"), ({"when": NOON}, "a"), ({"when": NOON.isoformat()}, "a"), ({"when": {"gte": NOON}}, "a"),
        ({"status": {"in": ["open", "closed"]}, "n": {"lt": 2}}, "a"),
    ],
)
def test_filters(spark, condition, want):
    rows = [(k, encoded_metadata(v)) for k, v in RECORDS.items()]
    df = spark.createDataFrame(rows, f"k string, metadata {METADATA}")
    assert "".join(sorted(r["k"] for r in df.where(predicate(condition)).collect())) == want


@pytest.mark.parametrize("bad", [[], 0, {"": 1}, {"a": {"like": 1}}, {"a": {}}, {"a": {"exists": 1}}, {"a": {"in": "x"}}, {"a": {"in": []}}, {"a": {"in": [None]}}, {"a": {"gt": "x"}}, {"a": {"eq": [1]}}])
def test_filter_mistakes(spark, bad):
    with pytest.raises(CollectionError):
        predicate(bad)


# --- chunking --------------------------------------------------------------------------------------------------------


def chunks(spark, rows, mode):
    df = chunking.chunked(spark.createDataFrame(rows, "path string, text string"), mode)
    return [tuple(r) for r in df.orderBy("path", "chunk_index").collect()]


def _windows(text, size, overlap):
    text = text.replace("\r\n", "\n").strip()
    out, start = [], 0
    while start < len(text):
        if text[start : start + size].strip():
            out.append(text[start : start + size].strip())
        if start + size >= len(text):
            break
        start += max(size - overlap, 1)
    return out


@pytest.mark.parametrize("text", ["", "  \n ", "abc", "a" * 1000, "b" * 1001, "\n\nline one\nline two " * 300, "é " * 950 + "\n" * 1200 + "tail", "x\r\ny" * 700])
def test_windows(spark, text):
    got = chunking.windows(spark.createDataFrame([(text,)], "text string")).orderBy("window_index").collect()
    assert [r["window"] for r in got] == _windows(text, 1000, 100) and [r["window_index"] for r in got] == list(range(len(got)))
    lines = text.replace("\r\n", "\n").split("\n")
    for r in got:
        assert r["window"].split("\n")[0].strip() in lines[r["start_line"] - 1] and r["window"].split("\n")[-1].strip() in lines[r["end_line"] - 1]


def test_modes(spark):
    assert chunking.available_modes() == ["auto", "brief", "code", "full", "head", "name", "outline"]
    assert chunks(spark, [("a/my_file.bin", "x")], "full") == [("a/my_file.bin", 0, "my file.bin", "my_file.bin", None, None)]
    assert chunks(spark, [("a/n.txt", " one\n\n two ")], "head") == [("a/n.txt", 0, "n.txt :: one two", "one two", None, None)]
    assert chunks(spark, [("n.txt", "\n\none\ntwo")], "full") == [("n.txt", 0, "n.txt [#1] :: one two", "one two", 3, 4)]
    assert chunks(spark, [("n.txt", "alpha beta alpha")], "brief")[0][2:4] == ("n.txt :: alpha beta", "alpha, beta")
    with pytest.raises(ValueError, match="outline"):
        chunks(spark, [], "none")


MARKDOWN = "---\ntitle: x\n---\nintro text\n\n# One\nbody\n```\n# not a heading\n```\n## Two ##\nmore\n\nThree\n=====\nend\n"


def test_outline(spark):
    got = outline_chunks("x.md", MARKDOWN)
    assert [(g[0], g[2], g[3]) for g in got] == [("preamble", 4, 5), ("One", 6, 13), ("One > Two", 11, 13), ("Three", 14, 16)]
    assert got[0][1] == "intro text" and got[3][1] == "end" and outline_chunks("x.md", "no heading") == []
    assert chunks(spark, [("x.md", MARKDOWN), ("y.md", "plain")], "outline")[-1][2] == "y.md [#1] :: plain"


@pytest.mark.parametrize(
    "text, want",
    [
        ("````\n```\n# no\n````\n# Yes", [("preamble", 1, 4), ("Yes", 5, 5)]),
        ("```\n~~~\n# no\n", []),
        ("```~~\n# no\n```\n# Yes #\n", [("preamble", 1, 3), ("Yes", 4, 4)]),
        ("    ~~~\n# no\n  ~~~~\nT\n---\n", [("preamble", 1, 3), ("T", 4, 5)]),
        ("#tag\n---\ntext\n===\n---\n## \n### C ###\n", [("preamble", 1, 2), ("text", 3, 7), ("text > C", 7, 7)]),
        ("---\nnever closed\n# A\n## B\n# C\n", [("preamble", 1, 2), ("A", 3, 4), ("A > B", 4, 4), ("C", 5, 5)]),
        ("", []),
    ],
)
def test_outline_rules(text, want):
    assert [(c, a, b) for c, _, a, b in outline_chunks("x.md", text)] == want


def test_comments_above_a_symbol():
    few = "#!/bin/x\n# coding: utf-8\n# one\n# two\ndef f():\n    pass\n"
    assert [p[2:] for p in python_chunks(few)] == [(1, 2), (3, 6)]
    many = "\n".join(f"# {i}" for i in range(14)) + "\ndef f():\n    pass\n"
    assert python_chunks(many)[-1][2] == 5
    wide = "\n".join(["# " + "x" * 300] * 4) + "\ndef f():\n    pass\n"
    assert python_chunks(wide)[-1][2] == 3


PYTHON = '''import os

# about f
@deco
def f(a):
    return a

class C(Base):
    """Doc."""
    x = 1

    async def go(self):
        pass

    def stop(self, n: int):
        pass

y = 2
'''


def test_python_code(spark):
    got = python_chunks(PYTHON)
    assert [(g[0], g[2], g[3]) for g in got] == [("module", 1, 2), ("def f(a):", 3, 6), ("class C(Base):", 8, 16), ("async C.go(self)", 12, 13), ("C.stop(self, n: int)", 15, 16), ("module globals", 17, 18)]
    assert got[2][1] == "class C(Base):\nDoc.\nx = 1\nMethods: go, stop" and python_chunks("def (") == []
    assert [c[1] for c in chunks(spark, [("m.py", PYTHON)], "code")] == list(range(6))
    assert chunks(spark, [("m.py", "def (")], "code")[0][2] == "m.py [#1] :: def ("
    long = "def f():\n" + "    x = 1\n" * 300
    assert "[#2]" in chunks(spark, [("l.py", long)], "code")[1][2]


SCRIPT = """import x from 'y';

// adds
function add(a, b) { return `}${a}` + b; }

/** Shape. */
export class Shape extends Base {
  constructor(n) { super(n); }
  // area
  area() { if (true) { return "}"; } }
}
const go = async (a) => {
  return a;
};
let plain = 3;
"""


def test_script_code():
    got = script_chunks(SCRIPT)
    assert [g[0] for g in got] == ["module", "function add(a, b) { return `}${a}` + b; }", "export class Shape", "Shape.constructor", "Shape.area", "const go = async (a) => {", "module globals"]
    assert got[1][2:] == (3, 4) and got[1][1].startswith("// adds\nfunction") and got[2][1].endswith("Methods: constructor, area") and got[4][1].startswith("// area")
    assert got[5][2:] == (12, 14)


def test_auto_routes(spark):
    rows = [("a.py", "x = 1"), ("b.md", "# T\nt"), ("c.txt", "small"), ("d.txt", "y" * 10_001)]
    labels = [c[2] for c in chunks(spark, rows, "auto")]
    assert labels[0] == "a.py :: module :: x = 1" and labels[1] == "b.md :: T :: t" and labels[2] == "c.txt [#1] :: small" and labels[3].startswith("d.txt :: yyy")


def test_positions(spark):
    df = chunking.position(spark.createDataFrame([(f"p{i // 3:03d}", i % 3) for i in range(60)], "path string, chunk_index int").repartition(4))
    got = [(r["path"], r["chunk_index"]) for r in df.orderBy("position").collect()]
    assert got == sorted(got) and [r["position"] for r in df.orderBy("position").collect()] == list(range(60))


# --- maintenance -----------------------------------------------------------------------------------------------------


def test_snapshot_diff(spark):
    fields = "rel_path string, mtime double, size long"
    now = spark.createDataFrame([("same", 1.0, 5), ("bigger", 1.0, 6), ("touched", 9.0, 5), ("both", 9.0, 6), ("untimed", 1.0, 5), ("new", 1.0, 1)], fields)
    old = spark.createDataFrame([("same", 1.2, 5), ("bigger", 1.0, 5), ("touched", 1.0, 5), ("both", 1.0, 5), ("untimed", None, 5), ("old", 1.0, 1)], fields)
    diff = maintenance.snapshot_diff(now, old)
    assert {r[0]: r[1] for r in diff.collect()} == {"same": "same", "bigger": "modified", "touched": "same", "both": "modified", "untimed": "modified", "new": "added", "old": "removed"}
    assert maintenance.change_ratio(diff).first()["ratio"] == pytest.approx(5 / 6)


def test_paths():
    assert maintenance.normalize_extensions(["py", ".py", " .MD ", ".", "", None]) == (".md", ".py")
    assert maintenance.normalize_excludes([".js,.md"]) == ("**/*.js", "**/*.md")


def test_contents_share_a_budget():
    rows = [{"start_line": 1, "text": "x" * 3000} for _ in range(6)] + [{"start_line": None, "text": ""}]
    got = maintenance.with_contents(rows, lambda r, n: r["text"][:n])
    assert [len(g["content"] or "") for g in got] == [2000] * 4 + [0, 0, 0] and [g["reason"] for g in got[4:]] == ["budget_exhausted"] * 2 + ["no_line_range"]


@pytest.mark.parametrize(
    ("line", "base", "want"), [("/x", "b", "b/x"), ("x", "b", "b/**/x"), ("a/x", "b", "b/a/x"), ("!x", "b", "!b/**/x"), ("# c", "b", None), ("x/", "b", "b/**/x/"), ("x", "", "x")]
)
def test_ignore_lines(line, base, want):
    assert scan.scope_line(line, base) == want


def tree(tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_scan(tmp_path, spark):
    tree(tmp_path, {".git/info/exclude": "ex.txt\n", ".gitignore": "*.log\n!keep.log\nbuild/\n", "a.txt": "a", "ex.txt": "x", "b.log": "x", "keep.log": "x", "build/c.txt": "x", "__init__.py": "", ".hidden": "x", "sub/.gitignore": "/only.txt\n", "sub/only.txt": "x", "sub/deep/only.txt": "x", "sub/d.tar.gz": "x"})
    names = lambda **o: [p.relative_to(tmp_path).as_posix() for p in scan.collect_files(tmp_path, **o)]
    assert names() == ["__init__.py", "a.txt", "keep.log", "sub/d.tar.gz", "sub/deep/only.txt"]
    assert ".hidden" in names(include_hidden=True) and "b.log" in names(respect_gitignore=False)
    assert names(recursive=False) == ["__init__.py", "a.txt", "keep.log"] and names(extensions=[".tar.gz"]) == ["sub/d.tar.gz"]
    assert names(exclude_patterns=["**/*.txt"]) == ["__init__.py", "keep.log", "sub/d.tar.gz"]
    assert scan.collect_files(tmp_path / "build") == []
    read = scan.read_texts(scan.scan(spark, tmp_path))
    assert {r["path"]: r["text"] for r in read.collect()}["a.txt"] == "a"
    with pytest.raises(FileNotFoundError):
        scan.resolve_directory(tmp_path / "none")


# --- collections, streams and the client -----------------------------------------------------------------------------


def test_collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}", " notes ")
    assert c.count() == 0 and c.get("a") is None and not c.delete("a") and c.info() is None
    with pytest.raises(CollectionError):
        c.search("x")
    report = c.upsert_many([{"id": "a", "text": "alpha beta", "metadata": {"n": 1, "t": NOON}}, {"id": "b", "text": "zzz", "metadata": {"n": 2}}, {"id": "c", "text": "alpha"}])
    assert (report.written, report.embedded, report.skipped) == (3, 3, 0)
    report = c.upsert_many([{"id": "a", "text": "alpha beta", "metadata": {"n": 9}}, {"id": "d", "text": "needle"}])
    assert (report.written, report.embedded, report.skipped) == (2, 1, 1)
    ids = {r["record_key"]: r["record_id"] for r in c.records().collect()}
    assert ids == {"a": 1, "b": 2, "c": 3, "d": 4} and c.count() == 4
    assert [r["id"] for r in c.get_many(["c", "none", "a", "c"])] == ["c", "a"] and c.get("a")["metadata"] == {"n": 9.0}
    assert c.search("alpha", 1)[0]["id"] == "c" and [r["id"] for r in c.search("alpha", 5, {"n": {"gt": 5}})] == ["a"]
    assert c.search("needle", 1, rerank="hybrid")[0]["id"] == "d" and c.search("alpha", 0) == []
    assert c.delete_many(["a", "none"]) == 1 and c.count() == 3
    for bad in ([{"id": " ", "text": "x"}], [{"id": "x", "text": " "}], [{"id": "x", "text": "1"}, {"id": "x", "text": "2"}], [{"id": "x", "text": "1", "metadata": {"a": [1]}}], [3]):
        with pytest.raises(CollectionError):
            c.upsert_many(bad)
    other = Collection(spark, f"file://{tmp_path}", "notes", python_embedder("own", "m", lambda texts: [[1.0, 0.0] for _ in texts]))
    with pytest.raises(CollectionError):
        other.upsert("z", "text")
    assert [i.name for i in list_collections(spark, f"file://{tmp_path}")] == ["notes"] and not c.drop_if_empty(c.info().id)
    assert clear_collections(spark, f"file://{tmp_path}") == 1 and c.count() == 0 and not c.drop()


def test_failed_first_write_leaves_nothing(spark, tmp_path):
    bad = python_embedder("own", "bad", lambda texts: [[1.0] * len(t) for t in texts])
    c = Collection(spark, f"file://{tmp_path}", "x", bad)
    with pytest.raises(CollectionError, match="dimension"):
        c.upsert_many([{"id": "a", "text": "ab"}, {"id": "b", "text": "abc"}])
    assert c.info() is None and not c.drop()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda i, text, seq: json.dumps({"id": i, "text": text, "metadata": {}, "seq": seq})
    (tmp_path / "in/1.json").write_text("\n".join([row("a", "old", 1), row("a", "new", 2), row("b", "bee", 1), row(" ", "x", 1)]))
    c = Collection(spark, f"file://{tmp_path}/data", "s")
    for _ in range(2):
        upsert_stream(record_files(spark, str(tmp_path / "in")), c, str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in/2.json").write_text(row("b", "bee two", 5))
    upsert_stream(record_files(spark, str(tmp_path / "in")), c, str(tmp_path / "state")).awaitTermination()
    assert {r["record_key"]: r["text"] for r in c.records().collect()} == {"a": "new", "b": "bee two"}


def test_freshness():
    now = [0.0]
    f = Freshness(seconds=5.0, uses=1, most=2, clock=lambda: now[0])
    assert f.finish("/r", "k", f.begin("/r")) and f.fresh("/r", "k") and not f.fresh("/r", "k")
    token = f.begin("/r")
    f.changed("/r")
    assert not f.finish("/r", "k", token)
    assert f.finish("/r", "k", f.begin("/r"))
    now[0] = 5.0
    assert not f.fresh("/r", "k")
    for k in "xyz":
        f.finish("/r", k, f.begin("/r"))
    assert not f.fresh("/r", "x") and f.fresh("/r", "z")


def test_client(spark, tmp_path):
    tree(tmp_path / "t", {"one.txt": "the needle is here", "two.md": "# Zebra\nzzz zzz", "sub/three.py": "def aaa():\n    return 'aaa'\n"})
    root, c = str(tmp_path / "t"), Client(spark, f"file://{tmp_path}/data", freshness=Freshness(seconds=0.0))
    assert c.index(root).status == "stored" and c.index(root).status == "up_to_date"
    got = c.search("needle", root, top=2, rerank="hybrid")
    assert got.results[0]["path"] == "one.txt" and not got.stale and len(got.results) == 2
    assert [r["path"] for r in c.search("aaa", str(tmp_path / "t/sub")).results] == ["sub/three.py"]
    assert {r["path"] for r in c.search("zzz", root, extensions=["md"]).results} == {"two.md"}
    assert {r["path"] for r in c.search("zzz", root, excludes=["*.md"]).results} == {"one.txt", "sub/three.py"}
    tree(tmp_path / "t", {"four.txt": "a fresh haystack"})
    assert "four.txt" in {r["path"] for r in c.search("haystack", root, rerank="hybrid").results}
    os.remove(tmp_path / "t/four.txt")
    assert "four.txt" not in {r["path"] for r in c.search("haystack", root).results}
    memory = c.index_in_memory(root)
    shown = memory.search("needle", top=1, rerank="bm25").results
    assert shown[0]["path"] == "one.txt" and porcelain(shown).startswith("1\t") and json.loads(as_json(shown))[0]["rank"] == 1
    memory.close()
    assert len(c.catalog()) == 1 and c.clear_index(root) == 1 and c.clear_indexes() == 0
    (tmp_path / "e").mkdir()
    assert c.index(str(tmp_path / "e")).status == "empty" and c.search("x", str(tmp_path / "e")).index_empty
    with pytest.raises(FileNotFoundError):
        c.search("x", root, auto_index=False)
    with pytest.raises(ValueError):
        c.search("  ", root)


def test_only_one_of_two_writers_wins(spark, tmp_path):
    one = collections.Collection(spark, str(tmp_path), "notes")
    one.upsert("a", "first")
    stale = one.info()
    collections.Collection(spark, str(tmp_path), "notes").upsert("b", "second")
    with pytest.raises(collections.CollectionError, match="another writer"):
        one._publish(stale, one.records(stale))
    assert one.count() == 2 and {r["id"] for r in one.get_many(["a", "b"])} == {"a", "b"}
    one.upsert("c", "third")  # reads the pointer anew
    assert one.count() == 3


def test_there_is_a_pointer_at_any_time(spark, tmp_path, monkeypatch):
    one = collections.Collection(spark, str(tmp_path), "notes")
    one.upsert("a", "first")
    files = one.files
    files.fs().create(files.path("claim-000000000002"), False).close()  # a writer that was lost between the two steps
    with pytest.raises(collections.CollectionError, match="another writer"):
        one.upsert("b", "second")
    assert one.count() == 1
    monkeypatch.setattr(collections, "STALE", -10.0)
    one.upsert("b", "second")
    assert one.count() == 2 and files.pointer()[0] == 2
