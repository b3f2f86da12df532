"""Metadata filters: validated mappings compiled into predicates that keep "missing" and "null" apart.

Metadata is a map from key to a struct of `text` and `num`: strings fill text, numbers and booleans num, datetimes both
(ISO text and epoch seconds), None neither. A filter's value decides which of the two it is compared with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = "map<string,struct<text:string,num:double>>"
COMPARISONS = ("gt", "gte", "lt", "lte")
OPERATORS = ("eq", "ne", "in", "nin", *COMPARISONS, "exists")


class CollectionError(ValueError):
    """What a caller of the collection operators has got wrong."""


def encoded(value: Any) -> tuple[str | None, float | None]:
    """(text, num) of a metadata value."""
    if value is None:
        return None, None
    if isinstance(value, bool):
        return None, float(value)
    if isinstance(value, datetime):
        return value.isoformat(), value.timestamp()
    if isinstance(value, (int, float)):
        return None, float(value)
    if isinstance(value, str):
        return value, None
    raise CollectionError(f"metadata values are strings, numbers, booleans, datetimes or None, not {type(value).__name__}")


def encoded_metadata(metadata: Mapping[str, Any] | None) -> dict[str, tuple[str | None, float | None]]:
    if metadata is None:
        return {}
    if not isinstance(metadata, Mapping):
        raise CollectionError("metadata must be a mapping")
    for key in metadata:
        if not isinstance(key, str) or not key.strip():
            raise CollectionError("metadata keys are strings that aren't blank")
    return {k: encoded(v) for k, v in metadata.items()}


def _compared(value: Any) -> tuple[str, Any]:
    """The field a query value is compared with, and the value there."""
    if value is None:
        raise CollectionError("None can't be compared here")
    text, num = encoded(value)
    return ("num", num) if num is not None else ("text", text)


def _one(at: Column, present: Column, op: str, value: Any) -> Column:
    if op == "exists":
        if not isinstance(value, bool):
            raise CollectionError("exists takes true or false")
        return present if value else ~present
    if op in ("in", "nin"):
        if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
            raise CollectionError(f"{op} takes a list")
        if not value:
            raise CollectionError(f"{op} takes a list that isn't empty")
        by: dict[str, list] = {"text": [], "num": []}
        for field, v in map(_compared, value):
            by[field].append(v)
        found = reduce(lambda a, b: a | b, [F.coalesce(at[f].isin(*vs), F.lit(False)) for f, vs in by.items() if vs])
        return found if op == "in" else ~found
    if op in COMPARISONS:
        if isinstance(value, str) or value is None:
            raise CollectionError(f"{op} compares numbers, booleans or datetimes")
        field, v = _compared(value)
        num = at[field]
        return F.coalesce({"gt": num > v, "gte": num >= v, "lt": num < v, "lte": num <= v}[op], F.lit(False))
    if value is None:
        same = present & at["text"].isNull() & at["num"].isNull()
    else:
        field, v = _compared(value)
        same = at[field].eqNullSafe(F.lit(v))
    return same if op == "eq" else ~same


def predicate(filters: Mapping[str, Any] | None, metadata: str = "metadata") -> Column:
    """All conditions of `filters`, ANDed, as one column that is never null. None or {} lets everything through."""
    if filters is None:
        return F.lit(True)
    if not isinstance(filters, Mapping):
        raise CollectionError("filters must be a mapping")
    out = F.lit(True)
    for key, condition in filters.items():
        if not isinstance(key, str) or not key.strip():
            raise CollectionError("filter keys are strings that aren't blank")
        held = F.coalesce(F.col(metadata), F.create_map().cast(METADATA))
        present, at = F.map_contains_key(held, key), F.try_element_at(held, F.lit(key))
        if isinstance(condition, Mapping):
            if not condition:
                raise CollectionError(f"no operator for {key}")
            for op, value in condition.items():
                name = str(op).lower()
                if name not in OPERATORS:
                    raise CollectionError(f"unknown operator {op}; there are {', '.join(OPERATORS)}")
                out = out & _one(at, present, name, value)
        else:
            out = out & _one(at, present, "eq", condition)
    return out


def text_value(value: Column) -> Column:
    return F.struct(value.cast("string").alias("text"), F.lit(None).cast("double").alias("num"))


def number_value(value: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("text"), value.cast("double").alias("num"))


def time_value(value: Column) -> Column:
    """A timestamp column: ISO text and epoch seconds."""
    return F.struct(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss").alias("text"), F.unix_micros(value).cast("double").__truediv__(1e6).alias("num"))
