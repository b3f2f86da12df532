"""Running sums and ranks within keys of which one may hold a third of all rows.

A window over such a key would be one task. Here a key's rows are cut into buckets by the leading digits of the hash they
are ordered by; a window runs within each bucket, and what lies in the buckets before is added from a table of bucket
totals, which has `16 ** DIGITS` rows for each key at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.store import fresh

DIGITS = 3


def order_hash(*columns: Column) -> Column:
    """A hash (32 hex digits) of values of any kind, nulls told from empty strings: a random but repeatable order."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def one_key(columns: list[Column]) -> Column:
    """Columns as one string that is never null, so that equal keys, nulls too, meet in joins and windows alike."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same keys that come before (by `order`, an order_hash
    column, then by `ties`). Rows that tie in all of these are alike, and take their places in any order.

    `beside` has a row for each key (columns named like `keys`) and further columns that are added to all rows of the
    key; it is joined to the bucket totals, so no join gathers a key's rows. Rows are shuffled once, by key and bucket.
    """
    bucket, amount, ahead, own, key = fresh(df, "tl_bucket", "tl_amount", "tl_ahead", "tl_own", "tl_key")
    rows = df.withColumn(key, one_key([F.col(k) for k in keys])).withColumn(bucket, F.substring(order, 1, DIGITS)).withColumn(amount, value)
    totals = rows.groupBy(key, bucket).agg(F.sum(amount).alias(own))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key), F.col(bucket), F.coalesce(F.sum(own).over(before), F.lit(0)).alias(ahead))
    if beside is not None:
        more = beside.withColumn(key, one_key([F.col(k) for k in keys])).drop(*keys)
        totals = totals.join(more, key, "left")
    within = Window.partitionBy(key, bucket).orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(own, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return rows.join(totals, [key, bucket], "left").withColumn(name, F.col(ahead) + F.col(own)).drop(bucket, amount, ahead, own, key)
