"""Records as a stream: batch files are ingested as they arrive, or changes detected by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from silverloom.functions import identity
from silverloom.plans import engine
from silverloom.sources import records


def read_json_stream(spark: SparkSession, path: str) -> DataFrame:
    return records.flat(spark.readStream.schema(records.BATCH).option("multiLine", True).json(path))


class Ingestor:
    """Holds the state that micro-batches change; a batch that is handed over again changes nothing."""

    def __init__(self, state: engine.State, source_system: str, now: Callable[[int], str]):
        self.state, self.source_system, self.now = state, source_system, now
        self.refused: list[tuple[int, str]] = []

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            self.state, _ = engine.ingest_batch(self.state, batch, self.source_system, self.now(number), most=None)
        except records.InvalidBatch as error:
            self.refused.append((number, str(error)))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGES = "source_key string, payload_hash string, revision_number int"


def changed_only(stream: DataFrame, key: str, payload: list[str], order: str) -> DataFrame:
    """Rows whose payload differs from the last of their key, numbered; the state of a key is the last
    hash and number."""
    hashed = stream.select(F.col(key).cast("string").alias("source_key"), identity.payload_hash(stream, payload).alias("payload_hash"), F.col(order).alias("at"))

    def step(name: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, number = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if row.payload_hash != last:
                last, number = row.payload_hash, number + 1
                out.append((name[0], last, number))
        state.update((last, number))
        yield pd.DataFrame(out, columns=["source_key", "payload_hash", "revision_number"])

    return hashed.groupBy("source_key").applyInPandasWithState(step, CHANGES, "last string, number int", "append", "NoTimeout")
