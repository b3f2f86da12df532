"""Mixing sources to target weights along a curriculum.

Each source has a number of words to give (its target, a share of a budget by weight, not beyond `cap` times what it
has) and a schedule: a weight at each of some points in training time, linear in between. The integral of the schedule
is the source's cumulative demand; inverting it at a document's place among the source's words gives the document's
position in training. All of it is column expressions; what is windowed over a whole source are bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.prefix import order_hash, running
from tarnlake.llm.store import fresh

WEIGHTS = (3, 1, 2)
#: Weights at the start, middle and end of training, dealt out to sources in turn like WEIGHTS: even, early, late.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 09-0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """From words by source (one row each): weight, rank and target.

    The budget is share[0] / share[1] of all words. A target stops at `cap` times the source's words; what is over goes
    to the others by weight, until none is above. That is one level: a source gets the level times its weight, or its
    cap. With sources in order of cap / weight, the level is found at the first whose cap isn't below it. The windows
    hold one row for each source, never documents.
    """
    by_name, by_ratio = Window.orderBy(F.col(source).asc_nulls_last()), Window.orderBy("tl_ratio", F.col(source).asc_nulls_last())
    out = sizes.withColumn("tl_rank", F.row_number().over(by_name) - 1)
    out = out.withColumn("tl_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("tl_rank") % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("tl_cap", cap * F.col(size)).withColumn("tl_ratio", F.col("tl_cap") / F.col("tl_weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(1))
    left = F.lit(share[0]) * F.sum(size).over(everyone) - share[1] * F.coalesce(F.sum("tl_cap").over(before), F.lit(0))
    out = out.withColumn("tl_level", left / (share[1] * F.sum("tl_weight").over(onwards)))
    out = out.withColumn("tl_level", F.min(F.when(F.col("tl_level") <= F.col("tl_ratio"), F.struct("tl_ratio", source, "tl_level"))).over(everyone)["tl_level"])
    target = F.coalesce(F.least(F.col("tl_cap").cast("double"), F.col("tl_level") * F.col("tl_weight")), F.col("tl_cap").cast("double"))
    return out.withColumn("tl_target", target).drop("tl_cap", "tl_ratio", "tl_level")


def demand_position(x: Column, total: Column, knots: list[Column]) -> Column:
    """The time (0 to 1) by which a source with these weights at evenly spaced times has given `x` of `total` words."""
    m = len(knots) - 1
    areas = [(knots[i] + knots[i + 1]) / (2.0 * m) for i in range(m)]
    whole = sum(areas[1:], areas[0])
    need = F.when(total > 0, F.least(x / total, F.lit(1.0))).otherwise(F.lit(0.0)) * whole
    out, done = None, F.lit(0.0)
    for i in range(m):
        a, slope, rest = knots[i], (knots[i + 1] - knots[i]) * m, need - done
        # a s + slope s^2 / 2 = rest, in the form that also holds where the slope is 0
        s = F.least(2.0 * rest / (a + F.sqrt(F.greatest(a * a + 2.0 * slope * rest, F.lit(0.0)))), F.lit(1.0 / m))
        here, done = F.lit(i / m) + F.when(rest > 0, s).otherwise(0.0), done + areas[i]
        out = F.when(need <= done, here) if out is None else out.when(need <= done, here)
    return out.otherwise(F.lit(1.0))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, share: tuple[int, int] = (3, 2), cap: int = 2, turns: bool = False) -> DataFrame:
    """Adds size, source_size, target (of the source), taken (words the mix takes, repeats counted), position and positions.

    A source's documents stand in the order of a hash of key and text. The mix takes words along that order until the
    target (rounded) is met, from the start again where the target is beyond what the source has; the document in which
    it is met gives its first words only. positions has a place in training for each pass in which words of a document
    are taken, that of the first of them; position is the first place, null if nothing is taken. With `turns`, there is
    a row for each pass instead, with its turn (from 0), taken and position. A null source is a source. Null and empty texts have size 0 and are never taken. Repeated rows count one by
    one; which of them comes first doesn't show. An empty table gives an empty one. Columns named like the new ones
    are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "position", "positions", *["turn"] * turns)
    order, before, rank = fresh(docs, "tl_order", "tl_before", "tl_rank")
    rows = docs.withColumn("size", word_count(F.col(text))).withColumn(order, order_hash(F.col(key), F.md5(text)))
    sums = rows.groupBy(F.col(source).alias("tl_name")).agg(F.sum("size").alias("tl_words"))
    targets = source_targets(sums, "tl_name", "tl_words", weights, share, cap)
    targets = targets.select(F.col("tl_name").alias(source), F.col("tl_words").alias("source_size"), F.col("tl_target").alias("target"), F.col("tl_rank").alias(rank))
    rows = running(rows, [source], order, F.col("size"), before, ["size"], targets)
    words = F.floor(F.col("target") + 0.5)
    starts = [F.col(before) + k * F.col("source_size") for k in range(cap)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), words - start)).cast("long") for start in starts]
    schedule = F.col(rank) % len(schedules)
    knots = [F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), (schedule + 1).cast("int")) for i in range(len(schedules[0]))]
    places = [F.round(demand_position(start.cast("double"), F.col("target"), knots), 9) for start in starts]
    each = F.array(*[F.struct(F.lit(k).alias("turn"), part.alias("taken"), place.alias("position")) for k, (part, place) in enumerate(zip(parts, places))])
    each = F.filter(each, lambda x: x["taken"] > 0)
    if turns:
        rows = rows.select("*", F.inline(each))
    else:
        rows = rows.withColumn("taken", sum(parts[1:], parts[0])).withColumn("positions", F.transform(each, lambda x: x["position"]))
        rows = rows.withColumn("position", F.get("positions", F.lit(0)))
    return rows.drop(order, before, rank)


def in_training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the mix takes, sorted over all partitions by position (by a sampled range shuffle), ties by a hash of `key`.

    Rows that take nothing (null and empty texts, too) are left out; repeated rows stay. An empty table gives an empty one.
    """
    return mixed.where(F.col("taken") > 0).orderBy("position", order_hash(F.col(key)))
