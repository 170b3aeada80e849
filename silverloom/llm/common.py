"""What the corpus operators share: bytes of texts, tables in the shared folder, hash folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from silverloom.sources.snapshots import settle as settle  # written once to the shared folder

#: Rows an Arrow batch holds at most: keeps a worker's memory small even if every text is long.
BATCH_ROWS = 1024
def session(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that fit in a worker whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_batches(
    frame: DataFrame,
    schema: T.StructType | str,
    each: Callable[[pa.RecordBatch], dict[str, list]],
    prepare: Callable[[], None] | None = None,
) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns; prepare runs once a task."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if prepare:
            prepare()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in target], schema=target)

    return frame.mapInArrow(run, schema)


def schema_with(frame: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The fields ``keep`` of the frame, and those that ``more`` names."""
    return T.StructType([frame.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
