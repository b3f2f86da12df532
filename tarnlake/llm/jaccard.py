"""Jaccard join over word shingles by PartEnum signatures, and the components of its links.

Sets of similar size share a band, in which two sets that link differ in at most k elements. Signatures are made on two
levels. The hashed domain is cut into parts, so many that two such sets differ in at most `d` elements in some of them;
each part is cut again into `m` smaller ones, and all subsets of m - d of these are enumerated: some subset holds none
of the differences. What a set has in a subset makes one signature, so sets that link share one, and sets with one in
common are candidates, whose whole sets are compared.

A subset in which a set has nothing says nothing. There are therefore some parts to spare: a set with no more parts than
that in which a subset is empty needs no signature for it. Sets with more sign again under another hash; two sets that
both have too many meet there, and those that still have too many after the last hash sign their empty subsets.

Of a group (the sets with one signature) each set is first paired with the first one, then, where that leaves several
components, in a few turns with some neighbours in a random order; both are linear. Groups that are open still are
compared in blocks, large ones spread over many tasks; of a pair of blocks only such pairs
come out as exact bounds (sizes, and a parity sketch, whose differing bits never outnumber the differing elements) allow.
Sets that are alike but don't link share many groups. A pair is due in the largest of them: each set carries the largest
of its groups, and in a smaller one a pair with one of those in common is left out, as it has met there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb, erf, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import LOWER, WHITE, Hasher, flat, mixed, pieces, runs, tidy
from tarnlake.llm.graph import components
from tarnlake.llm.store import Scratch, fresh, saved

#: Two sets link if 100 * common >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Largest size of a band by its smallest; hashes that a set may sign under.
WIDTH, TRIES = 1.35, 8
#: (d, m) by the number of differences allowed, up to three: one part, cut so that subsets hold half of it or more.
FEW = ((0, 1), (1, 3), (2, 5), (3, 6))
#: (d, m) beyond that: up to MEDIUM differences, and for larger sets, whose signatures are many.
MEDIUM, CUTS = 12, ((2, 4), (1, 3))
#: Turns in which sets meet neighbours of their group, how many, and sets of a group that are put in one order together.
TURNS, NEAR, STRETCH = 1, 2, 8192
#: Sets of a block, and how many of its largest groups a set carries.
BLOCK, MET = 256, 8
#: Words of 64 bits in a set's sketch, and in its folded form that all pairs are bounded by first; bits of a wide sketch for
#: each element at least.
SKETCH, FOLDED, WIDE = 8, 2, 2
#: Words of 64 bits in the bitmap of ids whose texts are read again.
FILTER = 1 << 16
#: Set keys that a task remembers at most, so as not to sign one set again and again.
REMEMBERED = 200_000

_K = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, edges: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text behind the other, and their number by text."""
    low = LOWER[data]
    starts, ends, per = runs(~WHITE[low], edges)
    w = Hasher(low)(starts, ends)
    first = np.cumsum(per) - per
    count = np.where(per >= words, per - words + 1, np.minimum(per, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(per, words), count)
    h = size.astype(np.uint64)
    for i in range(words):
        h = np.where(i < size, h * _K + w[np.minimum(at + i, max(len(w) - 1, 0))], h) if len(w) else h
    h = mixed(h)
    cuts = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[cuts[:-1][count > 0]] = True
    return h[keep], np.bincount(np.repeat(np.arange(len(per)), count)[keep], minlength=len(per))


@lru_cache(None)
def _spare(n: int, parts: int, d: int, m: int) -> int:
    """How many parts to add, so that sets of `n` elements make the fewest signatures, signing again counted."""
    best, e = (float("inf"), 0), 0
    while e <= 2 * parts + 2:
        all_ = parts + e
        empty = exp(-n / (all_ * m))
        p = sum(comb(m, i) * empty**i * (1 - empty) ** (m - i) for i in range(m - d, m + 1))
        if all_ < 60:
            enough = sum(comb(all_, i) * p**i * (1 - p) ** (all_ - i) for i in range(e + 1))
        else:
            enough = 0.5 * (1 + erf((e + 0.5 - p * all_) / sqrt(2 * max(p * (1 - p) * all_, 1e-9))))
        best = min(best, (all_ / max(enough, 1e-3), e))
        e += 1 + e // 8
    return best[1]


@lru_cache(None)
def _band(lo: int, percent: int) -> tuple[int, ...]:
    hi = max(lo, int(lo * WIDTH))
    k = 2 * (100 - percent) * hi // (100 + percent)
    if k < len(FEW):
        return lo, hi, k, *FEW[k], 1, 0
    d, m = CUTS[k > MEDIUM]
    parts = k // (d + 1) + 1
    return lo, hi, k, d, m, parts, _spare(-(-lo * percent // 100), parts, d, m)  # smaller sets sign in a band, too


def bands(most: int, percent: int = PERCENT) -> np.ndarray:
    """Rows of smallest and largest size, allowed differences, d, m, parts and parts to spare, for sizes up to `most`."""
    out, lo = [], 1
    while lo <= most:
        out.append(_band(lo, percent))
        lo = out[-1][1] + 1
    return np.array(out, np.int64).reshape(-1, 7)


def signatures(h: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (48 bits) of sets given like shingles() does, and the set each belongs to."""
    table = bands(int(n.max(initial=0)) * 100 // percent + 1, percent)
    some = np.flatnonzero(n > 0)
    home = np.searchsorted(table[:, 0], n[some], "right") - 1
    up = home + 1 < len(table)
    up[up] = table[home[up] + 1, 0] <= n[some[up]] * 100 // percent  # may link to a larger set of the next band
    todo = np.stack([np.append(some, some[up]), np.append(home, home[up] + 1)], 1)
    begin = np.cumsum(n) - n
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for turn in range(TRIES):
        left = [todo[:0]]
        for d, m in {(int(x), int(y)) for x, y in table[np.unique(todo[:, 1]), 3:5]}:
            s, band = (job := todo[(table[todo[:, 1], 3] == d) & (table[todo[:, 1], 4] == m)]).T
            parts, size = table[band, 5] + table[band, 6], n[s]
            at = np.repeat(begin[s] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x = mixed(h[at] + np.uint64((turn + 1) * int(_K) % 2**64))
            part = ((x >> np.uint64(32)) * np.repeat(parts * m, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            base = np.cumsum(parts) - parts
            rows = int(parts.sum())
            slot, y = np.repeat(base * m, size) + part, mixed(x)
            halves = [np.bincount(slot, z.astype(float), rows * m).astype(np.uint64) for z in (y & np.uint64(0xFFFFFFFF), y >> np.uint64(32))]  # below 2^53: exact
            total = (halves[0] + halves[1] * _K).reshape(rows, m)
            held = (np.bincount(slot, minlength=rows * m) > 0).reshape(rows, m)
            of = np.repeat(np.arange(len(job)), parts)
            place = (band[of].astype(np.uint64) << np.uint64(40)) + ((np.arange(rows) - base[of]).astype(np.uint64) << np.uint64(16)) + np.uint64(turn)
            bad = held.sum(1) <= d
            over = np.bincount(of, bad, len(job)) > table[band, 6]
            gaps = over[of] if turn == TRIES - 1 else np.zeros(rows, bool)
            for i, subset in enumerate(combinations(range(m), m - d)):
                on = held[:, subset].any(1) | gaps
                sig = mixed(total[:, subset].sum(1, dtype=np.uint64) + mixed((place + np.uint64(i << 8)) * _K))
                found.append(sig[on] >> np.uint64(16))
                owner.append(s[of[on]])
            left.append(job[over])
        todo = np.concatenate(left)
        if not len(todo):
            break
    return np.concatenate(found), np.concatenate(owner)


def sketches(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 * SKETCH parities of each set: two sets differ in at least as many elements as bits."""
    row, bits = np.repeat(np.arange(len(n)), n), 64 * SKETCH
    bit = (mixed(h ^ _K) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(row * bits + bit, minlength=bits * len(n)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), 1).view(np.int64).reshape(-1, SKETCH)


def wide_sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in as many bits as a set's size asks for (a power of two), one set's words behind the other's, and where
    they begin. A sketch's halves, joined by exclusive or, are the sketch of half the width."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(WIDE * n, 1)))).astype(np.int64)
    base = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(n)), n)
    slot = base[row] + (mixed(h ^ _K) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(slot, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), np.append(base, bits.sum()) // 64


def set_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set (0 for empty ones), as two arrays."""
    row = np.cumsum(n) - n
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.zeros(len(n), np.uint64)
        if len(h):
            total[n > 0] = np.add.reduceat(mixed(h ^ np.uint64(salt)), row[n > 0])
        out.append(np.where(n > 0, mixed(total + n.astype(np.uint64)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


_PARITIES = [f"s{i}" for i in range(SKETCH)]
_FOLDS = [f"f{i}" for i in range(FOLDED)]
_BIT = f"pmod(xxhash64(id), {64 * FILTER}L)"


def _keyed(words: int):
    """id, n, lo, hi and sketch: size and key of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, n = shingles(*flat(piece.column(1)), words)
                arrays = [piece.column(0), pa.array(n), *map(pa.array, set_keys(h, n)), *map(pa.array, sketches(h, n).T.copy())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "lo", "hi", *_PARITIES])

    return run


def _signed(words: int, percent: int):
    """sig, lo: the signatures of each row's set, of equal sets in a task as a rule once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, n = shingles(*flat(piece.column(1)), words)
                lo, _ = set_keys(h, n)
                new = np.zeros(len(n), bool)
                for i in np.flatnonzero(n > 0).tolist():
                    if (k := int(lo[i])) not in seen:
                        new[i] = True
                        seen.add(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sig, owner = signatures(h[np.repeat(new, n)], n[new], percent)
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(sig[order].view(np.int64)), pa.array(lo[new][owner[order]])], names=["sig", "lo"])

    return run


def _hashed(words: int):
    """node, h: key and hashes of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, n = shingles(*flat(piece.column(0)), words)
                lo, _ = set_keys(h, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(lo), lists], names=["node", "h"]).filter(pa.array(n > 0))

    return run


def _wide(words: int):
    """node, bits: key and wide sketch of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, n = shingles(*flat(piece.column(0)), words)
                lo, _ = set_keys(h, n)
                bits, at = wide_sketches(h, n)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([pa.array(lo), lists], names=["node", "bits"]).filter(pa.array(n > 0))

    return run


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two wide sketches differ, the wider one folded to the other's width first."""
    size = F.least(F.size(a), F.size(b))

    def fitted(x: Column) -> Column:
        return F.when(F.size(x) > size, F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(fitted(a), fitted(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, x: acc + x)


def _folded(size: int) -> list[Column]:
    """The sketch folded to `size` words: parities over fewer, larger classes of elements."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(s) for s in _PARITIES[i::size]]).alias(f) for i, f in enumerate(_FOLDS[:size])]


def _may_link(percent: int, words: list[str]) -> Column:
    """Whether sizes and sketches of both sides (columns that end in _a and _b) leave a link possible."""
    allowed = F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in words])
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= allowed)


def _ended(df: DataFrame, end: str, *columns: str) -> DataFrame:
    """`lo` as the column `end`, other columns with _`end` behind their names."""
    return df.select(F.col("lo").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])


class _Join:
    """One run of the join: the texts, the classes of equal sets, and the components found so far."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent, self.scratch = texts, words, percent, Scratch()
        keyed = texts.mapInArrow(tidy(_keyed(words)), f"id long, n long, lo long, hi long, {', '.join(f'{s} long' for s in _PARITIES)}")
        keyed = self.scratch(keyed)
        self.rows = keyed.select("id", "n", "lo", "hi")
        self.classes = self.scratch(keyed.where("n > 0 and id is not null").groupBy("lo", "hi").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *_PARITIES)]))
        self.repeated = self.scratch(self.rows.groupBy("id").agg(F.count(F.lit(1)).alias("many")).where("many > 1 and id is not null").select("id", F.lit(True).alias("again")))
        self.tried = self.parts = None

    def members(self) -> DataFrame:
        """sig, lo, head (the first set of the group), many (its sets) of the groups with two sets or more, each set once."""
        signed = self.texts.where("id is not null").select("id", "text").mapInArrow(tidy(_signed(self.words, self.percent)), "sig long, lo long")
        group = Window.partitionBy("sig").orderBy("lo")
        head = F.first("lo").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        grouped = signed.select("sig", "lo", head.alias("head"), F.lead("lo").over(group).alias("next"))
        grouped = grouped.where("(next is null or next <> lo) and (next is not null or head <> lo)").select("sig", "lo", "head")
        return self.scratch(grouped.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("sig"))))

    def of_nodes(self, pairs: DataFrame, run, schema: str) -> DataFrame:
        """What `run` makes of the texts of the sets in pairs: only those are read into sets again, one text for a set."""
        nodes = pairs.select(F.col("a").alias("lo")).union(pairs.select(F.col("b").alias("lo"))).distinct()
        # a bitmap of FILTER words over hashed ids picks the texts; what few others it lets through has keys that no pair has
        places = nodes.join(self.classes, "lo").select(F.expr(_BIT.replace("id", "rep")).alias("bit"))
        bits = self.scratch(places.groupBy(F.expr("bit >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")))
        texts = self.texts.withColumn("bit", F.expr(_BIT)).withColumn("word", F.expr("bit >> 6")).join(F.broadcast(bits), "word")  # FILTER rows at most
        texts = texts.where("bits & shiftleft(1L, cast(bit & 63 as int)) <> 0").select("id", "text").join(self.repeated, "id", "left")
        once, more = texts.where("again is null").select("text"), texts.where("again").select("text").dropDuplicates()
        return once.union(more).mapInArrow(tidy(run), schema)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of set keys, those whose whole sets link; wide sketches rule out most others before."""
        bits = self.of_nodes(pairs, _wide(self.words), "node long, bits array<long>")
        for end in ("a", "b"):
            pairs = pairs.join(_ended(self.classes, end, "n"), end).join(bits.select(F.col("node").alias(end), F.col("bits").alias(f"bits_{end}")), end)
        allowed = F.floor((100 - self.percent) * (F.col("n_a") + F.col("n_b")) / (100 + self.percent))
        pairs = self.scratch(pairs.where(_bits_apart(F.col("bits_a"), F.col("bits_b")) <= allowed).select("a", "b").distinct())
        sets = self.of_nodes(pairs, _hashed(self.words), "node long, h array<long>")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return self.scratch(both.where(100 * common >= self.percent * (F.size("ha") + F.size("hb") - common)).select("a", "b").distinct())

    def link(self, pairs: DataFrame) -> None:
        """Verifies pairs (a < b) that haven't been yet, and joins the components of those that link."""
        pairs = pairs.distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        for words, bounded in ((_FOLDS, self.classes.select("lo", "n", *_folded(FOLDED))), (_PARITIES, self.classes)):  # few bits rule most pairs out
            for end in ("a", "b"):
                pairs = pairs.join(_ended(bounded, end, "n", *words), end)
            pairs = self.scratch(pairs.where(_may_link(self.percent, words)).select("a", "b").distinct())
        links = self.verified(pairs)
        self.tried = pairs if self.tried is None else self.scratch(self.tried.union(pairs))
        self.parts = components(links) if self.parts is None else self.merged(links)
        self.scratch.tables.append(self.parts)

    def merged(self, links: DataFrame) -> DataFrame:
        """Components (node, component) after further links: those links make a small graph between components."""
        up = self.parts.select(F.col("node").alias("below"), F.col("component").alias("above"))
        ends = links
        for end in ("a", "b"):
            ends = ends.join(up, F.col(end) == F.col("below"), "left").withColumn(end, F.coalesce("above", end)).drop("below", "above")
        found = components(ends)
        self.scratch.tables.append(found)
        whole = found.select(F.col("node").alias("first"), F.col("component").alias("whole"))
        alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(self.parts, "node", "left_anti")
        known = self.parts.select("node", "component").union(alone.select("node", F.col("node").alias("component")))
        return saved(known.join(whole, F.col("component") == F.col("first"), "left").select("node", F.coalesce("whole", "component").alias("component")))

    def open(self, members: DataFrame) -> DataFrame:
        """sig, lo, part, many (sets of the group) of the groups that hold several components."""
        placed = self.scratch(members.join(self.parts, F.col("lo") == F.col("node"), "left").select("sig", "lo", "many", F.coalesce("component", "lo").alias("part")))
        several = placed.groupBy("sig").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
        return self.scratch(placed.join(self.scratch(several.select("sig")), "sig"))

    def neighbours(self, held: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of sets in different components that are near each other in a random order of their group."""
        stretch = F.pmod(F.xxhash64("lo", F.lit(turn), F.lit("stretch")), F.ceil(F.col("many") / STRETCH)).alias("stretch")
        order = Window.partitionBy("sig", "stretch").orderBy(F.xxhash64("lo", F.lit(turn)), "lo")
        me = F.struct("lo", "part")
        placed = held.select("sig", "lo", "part", stretch).select("lo", "part", F.array(*[F.lag(me, i).over(order) for i in range(1, NEAR + 1)]).alias("near"))
        placed = placed.select("lo", "part", F.explode("near").alias("x"))
        return placed.where("x.part <> part").select(F.least("x.lo", "lo").alias("a"), F.greatest("x.lo", "lo").alias("b"))

    def met(self, held: DataFrame) -> DataFrame:
        """`held` with `seen`: those of the MET largest groups of the row's set that come before the row's group.

        Groups come by size, then by signature, an order that all sets share. So two sets that have a group in common in
        `seen` are together in a group that comes before, and in the first group of all that they share they have none.
        """
        before = Window.partitionBy("lo").orderBy(F.desc("many"), "sig").rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumn("seen", F.array_compact(F.array(*[F.nth_value("sig", i).over(before) for i in range(1, MET + 1)])))

    def across(self, held: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets in one group and in different components that sizes and sketches leave possible.

        A group of more than BLOCK sets is cut into blocks, and each set goes to the cells (p, q) that its block makes with
        each block of the group; so no task gets a whole large group. Bounds are part of the join: nothing else comes out.
        A pair comes out of the first group that it shares, and of others only where no group in `seen` tells so.
        """
        held = held.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("lo"), "blocks").cast("int"))
        held = self.scratch(self.met(held).join(self.classes.select("lo", "n", *_PARITIES), "lo"))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = held.select("sig", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "lo", "part", "n", "seen", *_PARITIES)  # both sides alike: one shuffle
        one, two = (_ended(held, end, "part", "n", "seen", *_PARITIES, "sig", "p", "q", "block") for end in "ab")
        cell = (F.col("sig_a") == F.col("sig_b")) & (F.col("p_a") == F.col("p_b")) & (F.col("q_a") == F.col("q_b")) & ((F.col("p_a") == F.col("q_a")) | (F.col("block_a") != F.col("block_b")))
        due = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & _may_link(self.percent, _PARITIES) & ~F.arrays_overlap("seen_a", "seen_b")
        return one.join(two, cell & due).select("a", "b")

    def run(self) -> DataFrame:
        """id, n, component_id of all rows."""
        members = self.members()
        self.link(members.where("head <> lo").select(F.col("head").alias("a"), F.col("lo").alias("b")))
        members = members.where("many > 2").select("sig", "lo", "many")  # a group of two has been tried whole
        for turn in range(TURNS):
            members = self.open(members)
            self.link(self.neighbours(members, turn))
        self.link(self.across(self.open(members.select("sig", "lo", "many"))))
        named = self.classes.select("lo", "hi", "rep").join(self.parts, F.col("lo") == F.col("node"), "left").withColumn("part", F.coalesce("component", "lo"))
        named = named.withColumn("tl_hi", F.when(F.col("component").isNull(), F.col("hi")))  # sets with one half key in common, unlinked
        least = named.groupBy(F.col("part").alias("of_part"), F.col("tl_hi").alias("of_hi")).agg(F.min("rep").alias("component_id"))
        named = named.join(least, (F.col("part") == F.col("of_part")) & F.col("tl_hi").eqNullSafe(F.col("of_hi"))).select("lo", "hi", "component_id")
        some = self.rows.where("n > 0 and id is not null").join(named, ["lo", "hi"]).select("id", "n", "component_id")
        none = self.rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
        out = saved(some.union(none))
        self.scratch.clear()
        return out


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable over links, itself included) for every row.

    Equal sets are one class, and links are looked for between classes only, so copies aren't expanded into pairs. Rows
    whose text is null, empty or white space have no shingles and link with nothing: component_id is their own key. Rows
    without a key (null) take no part and have no component. Repeated keys are rows of one document if their texts are
    equal; otherwise they are tied only by the id. Long texts are taken whole. An empty table gives an empty one. Only
    `text` and `key` are read, so other columns and their names don't matter.

    No link that could join two components is lost: two sets that link share a group, and all pairs of a group that are in
    different components are compared. Pairs within a component never come out.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = _Join(texts, words, percent).run()
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose key is its component's smallest; of rows with one key, all whose component it is."""
    (work,) = fresh(docs, "tl_keep")
    keep = joined.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(work)).distinct()
    return docs.join(keep, F.col(key) == F.col(work), "left_semi").unionByName(docs.where(F.col(key).isNull()))
