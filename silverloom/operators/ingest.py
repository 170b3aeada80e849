"""Ingestion with change detection by hash, revisions, and the projections that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from silverloom.functions import identity, text

FIELDS = ("full_name", "email", "phone", "address", "postal_code", "updated_at")
REVISION = ("source_id", "source_system", "source_record_id", "revision_id", "revision_number", "payload_hash", *FIELDS, "ingested_at")


def source_id() -> Column:
    return identity.content_id(F.lit("source"), F.col("source_system"), F.col("source_record_id"))


def revision_id() -> Column:
    return identity.content_id(F.lit("revision"), F.col("source_id"), F.col("revision_number").cast("string"))


def hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("source_id", source_id()).withColumn("payload_hash", identity.payload_hash(records))


def current_revisions(revisions: DataFrame) -> DataFrame:
    """The latest revision of each source; the aggregate combines before its shuffle."""
    names = [c for c in revisions.columns if c != "source_id"]
    latest = revisions.groupBy("source_id").agg(F.max_by(F.struct(*names), "revision_number").alias("r"))
    return latest.select("source_id", "r.*").select(*revisions.columns)


def detect_changes(revisions: DataFrame, batch: DataFrame, ingested_at: Column) -> DataFrame:
    """The batch with status CREATED or UNCHANGED against the current revisions, and, where it is
    created, the new revision's number and id. A return to an older payload is a new revision."""
    held = current_revisions(revisions).select(F.col("source_id").alias("held_id"), F.col("payload_hash").alias("held_hash"), F.col("revision_number").alias("held_number"))
    met = hashed(batch).join(held, F.col("source_id") == F.col("held_id"), "left")
    same = F.coalesce(F.col("payload_hash") == F.col("held_hash"), F.lit(False))
    number = F.coalesce("held_number", F.lit(0)) + F.when(same, 0).otherwise(1)
    out = met.withColumn("status", F.when(same, "UNCHANGED").otherwise("CREATED")).withColumn("revision_number", number)
    return out.withColumn("revision_id", revision_id()).withColumn("ingested_at", ingested_at).drop("held_id", "held_hash", "held_number")


def new_revisions(changes: DataFrame) -> DataFrame:
    return changes.filter("status = 'CREATED'").select(*REVISION)


def batch_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_if(F.col("status") == "CREATED").alias("created"), F.count_if(F.col("status") == "UNCHANGED").alias("unchanged"))


def affected_goldens(changes: DataFrame, memberships: DataFrame) -> DataFrame:
    return changes.filter("status = 'CREATED'").select("source_id").join(memberships, "source_id").select("golden_id").distinct()


def replay(stream: DataFrame, key: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Many batches at once: the rows whose payload differs from the one before it of the same key,
    numbered from 1. (One window: its sort is by key and order, and keys are many.)"""
    told = stream.withColumn("payload_hash", identity.payload_hash(stream, payload))
    window = W.partitionBy(*key).orderBy(*order)
    kept = told.withColumn("last", F.lag("payload_hash").over(window)).filter(~F.col("payload_hash").eqNullSafe(F.col("last"))).drop("last")
    return kept.withColumn("revision_number", F.row_number().over(window))


def normalize(revisions: DataFrame) -> DataFrame:
    """Normalised fields and derived keys of each revision."""
    out = (
        revisions.withColumn("n_name", text.normalize_name(F.col("full_name")))
        .withColumn("n_email", text.normalize_email(F.col("email")))
        .withColumn("n_phone", text.normalize_phone(F.col("phone")))
        .withColumn("n_address", text.normalize_address(F.col("address")))
        .withColumn("n_postal", text.normalize_postal(F.col("postal_code")))
    )
    return out.select(
        "*",
        text.first_token(F.col("n_name")).alias("first_name"),
        text.last_token(F.col("n_name")).alias("surname"),
        text.soundex(text.last_token(F.col("n_name"))).alias("surname_soundex"),
        text.phone_last7(F.col("n_phone")).alias("phone_last7"),
        text.street_number(F.col("n_address")).alias("street_number"),
        text.phone_warnings(F.col("phone"), F.col("n_phone")).alias("warnings"),
    )


def normalize_new(revisions: DataFrame, done: DataFrame) -> DataFrame:
    """Only revisions that have not been normalised yet."""
    return normalize(revisions.join(done.select("revision_id"), "revision_id", "left_anti").select(*revisions.columns))
