"""Sinks: JSON without null fields, Parquet, and upserts of tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def as_json(frame: DataFrame) -> DataFrame:
    """A JSON text a row; null fields are left out, as are map entries whose value is null."""
    kinds = dict(frame.dtypes)
    tidy = [F.map_filter(c, lambda _, v: v.isNotNull()).alias(c) if kinds[c].startswith("map<") else F.col(c) for c in frame.columns]
    return frame.select(F.to_json(F.struct(*tidy)).alias("json"))


def write_json(frame: DataFrame, path: str) -> None:
    as_json(frame).write.text(path)


def as_gauges(frame: DataFrame, prefix: str = "silverloom") -> DataFrame:
    """A line ``prefix_column value`` for each column of a row of numbers, as scrapers of metrics read them;
    a null number has no line."""
    lines = F.array(*(F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in frame.columns))
    return frame.select(F.explode(F.array_compact(lines)).alias("line"))


def insert_new(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it lacks."""
    return held.unionByName(rows.join(held.select(*keys), keys, "left_anti").select(*held.columns))


def upsert(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows in place of those of the same key."""
    return held.join(rows.select(*keys), keys, "left_anti").select(*held.columns).unionByName(rows.select(*held.columns))


def observed(frame: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame, and a count of rows that is there once an action has run over it."""
    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("rows")), seen
