"""Secret scans: labelled assignments, access identifiers and hex runs, and multipart credentials linked by scope.

Patterns find spans natively: the pieces between matches and the matches themselves give all positions. Weak candidates
(long random-looking words, endpoints) are reported only where an access identifier stands within the same scope; an
interval join by cells of the scope's width decides that, for the few texts that have both kinds at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import let
from tarnlake.llm.prefix import order_hash
from tarnlake.llm.store import fresh, saved

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: what could be a secret key by its length alone, and endpoints.
KEYLIKE = r"[A-Za-z0-9+/=_-]{40,}"
#: The same with `=` between a name and its value, as in env files, and of any length from 40 on.
VALUE = r"[A-Za-z0-9+/_-]{40,}={0,2}"
ENDPOINT = r"(?:https?|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
#: Base kinds as they rank at one start, then those that linking adds.
KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: Code points between parts of one credential at most.
SCOPE = 200

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


#: Elements of a block of sums or of text pieces, and code points of a text piece.
STRIDE, PIECE = 32, 1024


def sums_before(values: Column, levels: int = 2) -> Column:
    """For each number of an array, the sum of those before it.

    Blocks of STRIDE numbers are summed by themselves, and so are the blocks' totals, a level up; so the work is in
    proportion to the array (up to STRIDE ** levels numbers, and little more beyond).
    """

    def plain(x: Column) -> Column:
        return F.transform(x, lambda _, i: F.aggregate(F.slice(x, 1, i), F.lit(0).cast("bigint"), lambda acc, v: acc + v))

    def blocked(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(STRIDE)), lambda i: F.slice(x, i + 1, STRIDE))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, totals(blocks), lambda b, start: F.transform(plain(b), lambda v: v + start))))

    def totals(blocks: Column) -> Column:
        each = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, v: acc + v))
        return sums_before(each, levels - 1) if levels > 1 else let(each, plain)

    return let(values, lambda x: F.when(F.size(x) > STRIDE, blocked(x)).otherwise(plain(x)))


def hits(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, found: Column, pattern: str, kind: str, least: int = 0, group: int = 0, most: int = 2**31 - 1) -> Column:
    """Matches, given as hits(), as (start, rank of the kind, end), code points, end exclusive; matches whose `group` has
    fewer than `least` or more than `most` characters are dropped afterwards. Null or no matches: no spans."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x).cast("bigint"))
    lengths = F.transform(found, lambda x: F.length(x).cast("bigint"))
    part = F.transform(found, lambda x: F.length(F.regexp_extract(x, pattern, group) if group else x).between(least, most))

    def placed(x: Column) -> Column:
        starts = F.zip_with(sums_before(F.zip_with(x["gap"], x["length"], lambda g, n: g + n)), x["gap"], lambda a, g: a + g)
        ends = F.arrays_zip(starts.alias("start"), x["length"].alias("length"), x["good"].alias("good"))
        good = F.filter(ends, lambda e: e["good"])
        return F.transform(good, lambda e: F.struct(e["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (e["start"] + e["length"]).alias("end")))

    all_ = let(F.struct(gaps.alias("gap"), lengths.alias("length"), part.alias("good")), placed)
    return F.when(F.size(found) > 0, all_).otherwise(F.array().cast(_SPAN))


def written(found: Column) -> Column:
    """kind:start:end, comma-joined in the order of `found`."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int = SCOPE, chained: bool = False) -> DataFrame:
    """Weak spans near an access identifier: from (tl_key, tl_strong, tl_weak) to (tl_key, tl_added).

    Cells are `scope` wide. A strong span covers the cells from `scope` before its start to `scope` behind its end; a
    weak span joins in the cells that it touches. The join is a semi-join: no pairs come out, whatever a text holds.
    `chained`: endpoints near a secret that is linked, and secrets near such an endpoint, are linked as well.
    """
    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))

    strong = parts.select("tl_key", F.explode("tl_strong").alias("s")).select("tl_key", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    strong = strong.withColumn("cell", cells(F.col("a") - scope, F.col("b") + scope))
    weak = parts.select("tl_key", F.explode("tl_weak").alias("w")).withColumn("cell", cells(F.col("w.start"), F.col("w.end")))
    def near(strong: DataFrame) -> Column:
        return (weak["tl_key"] == strong["tl_key"]) & (weak["cell"] == strong["cell"]) & (weak["w.start"] <= strong["b"] + scope) & (weak["w.end"] >= strong["a"] - scope)

    found = weak.join(strong, near(strong), "left_semi").select("tl_key", "w")
    if chained:
        found = saved(found.distinct())
        again = found.select("tl_key", F.col("w.start").alias("a"), F.col("w.end").alias("b"), F.col("w.rank").alias("kind"))
        again = again.withColumn("cell", cells(F.col("a") - scope, F.col("b") + scope))
        found = found.union(weak.join(again, near(again) & (weak["w.rank"] != again["kind"]), "left_semi").select("tl_key", "w"))
    return found.groupBy("tl_key").agg(F.array_sort(F.collect_set("w")).alias("tl_added"))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE, whole: bool = False) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans (as text) and span_list (start, rank in KINDS, end) to every row.

    Null texts count as empty: no spans, and the hash of nothing. A very long text is one row, scanned whole. Repeated
    texts get equal values: linking works on distinct texts. An empty table gives an empty one, and columns named like
    the new ones are replaced.

    Weak secrets are runs of exactly 40 key characters, `=` among them. With `whole`, they are also values of 40 or more
    behind a name and `=`, and endpoints link with secrets, not only with access identifiers.
    """
    outputs = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_list")
    docs = docs.drop(*outputs)
    t, assign, access, hexes, weak, link, place, found, keys, values, ends, same, added = fresh(
        docs, "tl_t", "tl_assign", "tl_access", "tl_hex", "tl_weak_parts", "tl_link", "tl_place", "tl_found", "tl_keys", "tl_values", "tl_ends", "tl_same", "tl_added_parts"
    )
    rows = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    for name, pattern, kind, least, group in ((assign, ASSIGN, "assign", 6, 2), (access, ACCESS, "access", 20, 0), (hexes, HEX, "hex", 0, 0)):
        rows = rows.withColumn(found, hits(F.col(t), pattern)).withColumn(name, spans(F.col(t), F.col(found), pattern, kind, least, group)).drop(found)
    # weak parts matter only beside an access identifier, so other texts aren't searched for them
    some = F.size(access) > 0
    rows = rows.withColumns({keys: F.when(some, hits(F.col(t), KEYLIKE)), values: F.when(some & F.lit(whole), hits(F.col(t), VALUE)), ends: F.when(some, hits(F.col(t), ENDPOINT))})
    parts = [spans(F.col(t), F.col(keys), KEYLIKE, "secret", 40, most=40), spans(F.col(t), F.col(values), VALUE, "secret"), spans(F.col(t), F.col(ends), ENDPOINT, "endpoint")]
    rows = rows.withColumn(weak, F.when(some, F.array_distinct(F.concat(*parts)))).drop(keys, values, ends)
    rows = rows.withColumn(link, F.when(some & (F.size(weak) > 0), order_hash(F.col(t))))
    parts = rows.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("tl_key")).agg(F.first(access).alias("tl_strong"), F.first(weak).alias("tl_weak"))
    near = linked(saved(parts), scope, whole).toDF(same, added)
    # texts without links keep away from each other: their place in the shuffle is a hash that matches nothing
    rows = rows.withColumn(place, F.coalesce(link, F.concat(F.lit("-"), order_hash(F.col(key), F.xxhash64(t))))).drop(t, link, weak)
    names = docs.columns
    out = rows.join(near, F.col(place) == F.col(same), "left")
    base = F.array_sort(F.concat(assign, access, hexes))
    everything = F.array_sort(F.concat(assign, access, hexes, F.coalesce(added, F.array().cast(_SPAN))))
    return out.select(
        *[F.col(c) for c in names], F.size(assign).cast("long").alias("n_assign"), F.size(access).cast("long").alias("n_access"), F.size(hexes).cast("long").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(everything).alias("spans"), everything.alias("span_list"),
    )


def masked(text: Column, span_list: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by `mask`; overlapping spans are one stretch, touching ones two.

    A null text stays null, and a text without spans as it is. The text is cut into pieces first, so what stands between
    two spans is found without reading the text from its start: the work is in proportion to text and spans.
    """

    def between(x: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        whole = F.array_join(F.slice(x["pieces"], first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(whole, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def stretches(s: Column) -> Column:
        """Distinct cover of the spans: where it begins and where it ends, in turn."""
        marks = F.array_sort(F.concat(F.transform(s, lambda v: F.struct(v["start"].alias("at"), F.lit(1).alias("way"))), F.transform(s, lambda v: F.struct(v["end"].alias("at"), F.lit(0).alias("way")))))
        return let(marks, lambda m: let(sums_before(F.transform(m, lambda v: F.when(v["way"] == 1, F.lit(1)).otherwise(F.lit(-1)).cast("bigint"))), lambda deep: F.transform(
            F.filter(F.zip_with(m, deep, lambda v, d: F.struct(v["at"].alias("at"), v["way"].alias("way"), d.alias("deep"))), lambda v: ((v["way"] == 1) & (v["deep"] == 0)) | ((v["way"] == 0) & (v["deep"] == 1))), lambda v: v["at"])))

    def filled(x: Column) -> Column:
        cuts = F.concat(F.array(F.lit(0).cast("bigint")), x["cuts"], F.array(x["long"]))  # kept from even places to odd ones
        ends = let(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c), F.lit(2)), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b"))))
        return F.array_join(F.transform(ends, lambda e: between(x, e["a"], e["b"])), mask)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = let(F.struct(pieces.alias("pieces"), stretches(span_list).alias("cuts"), F.length(text).cast("bigint").alias("long")), filled)
    return F.when(F.size(span_list) > 0, done).otherwise(text)
