"""Sharding by balanced label propagation: linked documents move to where most of their neighbours are, under quotas.

Documents with equal link keys are neighbours. Rows start in random shards whose counts differ by one at most; in each
round, a row wants the shard that holds most of its group, and rows move as exchanges between two shards: those that
want to cross one way against those that want to cross the other way, or against rows without neighbours. So counts
stay as they are. Of the shards, only their table of wishes (shards x shards numbers) comes to the driver. Groups
larger than a part of a shard are cut into sections, for they fit no shard.

No join gathers a large group: groups of more than 1 / HOT of all rows are at most HOT in number, so what is known of
them is broadcast; rows of smaller ones are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.prefix import order_hash, running
from tarnlake.llm.store import dropped, fresh, saved

#: Rounds at most; they end sooner when no row moves, or wishes hardly get fewer.
ROUNDS = 6
#: Groups with more than 1 / HOT of all rows are large.
HOT = 4096


def quotas(wants: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict[tuple[int, int], int], dict[int, list[tuple[int, int]]]]:
    """How many rows cross from i to j, and for each shard how many of its free rows go where, so that counts stay."""
    move = {(i, j): min(n, wants.get((j, i), 0)) for (i, j), n in wants.items()}
    sent: dict[int, list[tuple[int, int]]] = {}
    for j in range(shards):
        left, total = free.get(j, 0), sum(wants.get((i, j), 0) - move.get((i, j), 0) for i in range(shards))
        for i in range(shards):
            over = wants.get((i, j), 0) - move.get((i, j), 0)
            n = over if total <= left or not total else over * left // total
            if n:
                move[i, j] += n
                sent.setdefault(j, []).append((i, n))
    return move, sent


def _lookup(key: Column, table: dict, default: int = 0) -> Column:
    """A number for each key of a small dict, as a map literal."""
    if not table:
        return F.lit(default).cast("long")
    entries = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default).cast("long"))


def balanced_shards(docs: DataFrame, link: Column, key: str = "doc_id", text: str = "text", shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """Adds shard (0 to shards - 1; counts at most one apart) and slot (gapless from 0 within a shard) to every row.

    `link` names a row's group; rows whose link is null, or shared with no other row, are free. Rows are put in order by
    a hash of key and text; repeated rows are alike, and whichever takes a place, the counts hold. An empty table gives
    an empty one. Columns named like the new ones are replaced.
    """
    docs = docs.drop("shard", "slot")
    order, rank, group, section, want, size, hub, target, free, large, place = fresh(
        docs, "tl_order", "tl_rank", "tl_group", "tl_section", "tl_want", "tl_n", "tl_hub", "tl_target", "tl_free", "tl_large", "tl_place"
    )
    rows = docs.withColumn(order, order_hash(F.col(key), F.md5(text)))
    # a free row is a group of its own, so that the joins below spread such rows out
    rows = rows.withColumn(group, F.coalesce(F.concat(F.lit("="), link.cast("string")), F.concat(F.lit("-"), order)))
    rows = saved(running(rows, [], order, F.lit(1).cast("long"), rank).withColumn("shard", (F.col(rank) % shards).cast("int")).drop(rank))
    groups = saved(rows.groupBy(F.col(group).alias(hub)).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > 1))
    total = rows.count()
    most, limit = max(1, total // (2 * shards)), max(1, total // HOT)
    scratch = [rows, groups]

    def looked_up(rows: DataFrame, key: str, table: DataFrame, is_large: Column) -> DataFrame:
        """Left join of `table` (by `hub`): what is large there is broadcast (HOT groups and their sections at most)."""
        known = [c for c in table.columns if c not in (hub, large)]
        out = rows.join(F.broadcast(table.where(is_large).drop(large)), F.col(key) == F.col(hub), "left").withColumn(large, F.col(hub).isNotNull()).drop(hub)
        out = out.withColumnsRenamed({c: f"{c}_large" for c in known}).withColumn(place, F.when(F.col(large), F.concat(F.lit("-"), order)).otherwise(F.col(key)))
        out = out.join(table.where(~is_large).drop(large), F.col(place) == F.col(hub), "left").drop(hub, place)
        return out.withColumns({c: F.coalesce(f"{c}_large", c) for c in known}).drop(*[f"{c}_large" for c in known])

    rows = looked_up(rows, group, groups, F.col(size) > limit)
    sections = F.ceil(F.col(size) / most).cast("int")
    number = F.pmod(F.conv(F.substring(order, 5, 8), 16, 10).cast("long"), sections)
    rows = rows.withColumn(free, F.col(size).isNull())
    rows = rows.withColumn(section, F.when(F.col(free), F.concat(F.lit("-"), order)).otherwise(F.concat_ws(":", group, number.cast("string")))).drop(group, size)
    rows = saved(rows)
    dropped(*scratch)
    before = None
    for _ in range(rounds):
        held = rows.where(~F.col(free)).groupBy(section, large, "shard").agg(F.count(F.lit(1)).alias(size))
        best = held.groupBy(F.col(section).alias(hub), large).agg(F.max_by("shard", F.struct(F.col(size), F.xxhash64(section, "shard"))).alias(target))
        best = saved(best)
        rows_wanting = looked_up(rows.drop(large), section, best, F.col(large))
        old, rows = rows, saved(rows_wanting.withColumn(want, F.coalesce(target, F.col("shard"))).drop(target))
        dropped(old, best)
        counts = rows.groupBy("shard", want, F.col(free).alias("free")).agg(F.count(F.lit(1)).alias("n")).collect()  # shards x shards rows at most
        wants = {(r["shard"], r[want]): r["n"] for r in counts if r["shard"] != r[want]}
        now = sum(wants.values())
        if not wants or before is not None and now > 0.98 * before:
            rows = rows.drop(want)
            break
        before = now
        move, sent = quotas(wants, {r["shard"]: r["n"] for r in counts if r["free"]}, shards)
        rows = running(rows, ["shard", want, free], order, F.lit(1).cast("long"), rank)
        pair = F.col("shard") * shards + F.col(want)
        crossing = F.col(rank) < _lookup(pair, {i * shards + j: n for (i, j), n in move.items()})
        goes = F.col("shard")
        for j, parts in sent.items():
            at, case = 0, None
            for i, n in parts:
                inside = (F.col(rank) >= at) & (F.col(rank) < at + n)
                case = F.when(inside, F.lit(i)) if case is None else case.when(inside, F.lit(i))
                at += n
            goes = F.when(F.col("shard") == j, F.coalesce(case, F.col("shard"))).otherwise(goes)
        shard = F.when(F.col(free), goes).when((F.col("shard") != F.col(want)) & crossing, F.col(want)).otherwise(F.col("shard"))
        old, rows = rows, rows.withColumn("shard", shard.cast("int")).drop(want, rank)
        rows = saved(rows)
    out = running(rows, ["shard"], order, F.lit(1).cast("long"), "slot", [key])
    return out.drop(order, section, free, large)


def cut_edges(sharded: DataFrame, link: Column) -> DataFrame:
    """One row: groups of linked rows, those in one shard, and rows outside their group's main shard."""
    held = sharded.withColumn("tl_link", link).where(F.col("tl_link").isNotNull()).groupBy("tl_link", "shard").agg(F.count(F.lit(1)).alias("n"))
    each = held.groupBy("tl_link").agg(F.sum("n").alias("rows"), F.max("n").alias("main"), F.count(F.lit(1)).alias("parts")).where(F.col("rows") > 1)
    return each.agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("parts") == 1).cast("long")).alias("whole"), F.sum(F.col("rows") - F.col("main")).alias("outside"))


