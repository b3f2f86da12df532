"""Tables in between, kept where every executor and the driver can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType

from tarnlake.operators.shared import dropped, saved, shared_dir, spread

__all__ = ["Scratch", "dropped", "fresh", "kind", "saved", "shared_dir", "spread"]


class Scratch:
    """Tables of one operator's run, deleted together when it is done with them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, width: int | None = None) -> DataFrame:
        self.tables.append(saved(df, width))
        return self.tables[-1]

    def clear(self) -> None:
        dropped(*self.tables)
        self.tables = []


def kind(ddl: str) -> DataType:
    """The type that a DDL string names."""
    return StructType.fromDDL(f"x {ddl}")[0].dataType


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
