"""A labelled corpus of 1,000 customer records of two systems, by which matching is measured: 400 pairs of
duplicates with typos, missing and changed fields, and 100 pairs of one household that are two persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The words that records are put together from.
FIRST = "Ana Alicia Alexandra Benjamin Carla Darius Elena Fatima Gabriel Hannah Ibrahim Jasmine Kai Lucia Marcus Nadia Owen Priya Quinn Rosa Samuel Talia Uma Victor Wendy".split()
LAST = "Rivera Smith Johnson Patel Nguyen Garcia Brown Miller Davis Wilson Anderson Thomas Moore Martin Lee Clark Lewis Walker Hall Young King Wright Lopez Hill Green".split()
STREETS = "Main Pine Oak Cedar Lake Hill Market Mission Sunset Maple".split()
#: How many duplicates and households there are, and the number the households begin at.
DUPLICATES, HOUSEHOLDS, OFFSET = 400, 100, 1000
UPDATED = "2026-09-01T12:00:00Z"


def pick(words: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (place % len(words) + 1).cast("int"))


def digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def phone(number: Column) -> Column:
    return F.concat(F.lit("+1415"), digits(200 + F.floor(number / 10_000) % 700, 3), digits(number % 10_000, 4))


def people(spark: SparkSession) -> DataFrame:
    """A row for each pair of records: what both systems may know of it."""
    i = F.col("i")
    numbered = spark.range(DUPLICATES + HOUSEHOLDS).select((F.col("id") >= DUPLICATES).alias("apart"), F.when(F.col("id") < DUPLICATES, F.col("id")).otherwise(F.col("id") - DUPLICATES).alias("k"))
    rows = numbered.withColumn("i", F.when(F.col("apart"), F.col("k") + OFFSET).otherwise(F.col("k")))
    return rows.select("*", pick(FIRST, i).alias("first"), pick(FIRST, i + 3).alias("other"), pick(LAST, 7 * i).alias("last"), F.concat((100 + i % 700).cast("string"), F.lit(" "), pick(STREETS, i)).alias("house"), digits(90_000 + i % 9000, 5).alias("postal_code"))


def evaluation_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(records with source_system, labels): the shapes that ``ingest_batch`` and ``metrics.evaluate`` take."""
    every = lambda n: F.col("k") % n == 0
    twin, k, i = ~F.col("apart"), F.col("k"), F.col("i")
    name = F.concat_ws(" ", "first", "last")
    slip = F.regexp_replace(name, "^(..[^AEIOUaeiou]*)[AEIOUaeiou]", "$1")  # the first vowel from the third letter on
    mail = F.concat(F.lit("person"), digits(k, 4), F.lit("@example.test"))
    alone = lambda system: F.concat(F.lit(f"{system}.unique"), k.cast("string"), F.lit("@example.test"))
    spelt = F.concat(F.lit("(415) "), F.substring(phone(i), 6, 3), F.lit("-"), F.substring(phone(i), 9, 4))
    crm = people(spark).select(
        F.lit("CRM").alias("source_system"),
        F.when(twin, F.concat(F.lit("crm-"), digits(k, 4))).otherwise(F.concat(F.lit("crm-unique-"), digits(k, 3))).alias("source_record_id"),
        name.alias("full_name"),
        F.when(twin, mail).when(~every(10), alone("crm")).alias("email"),
        phone(i).alias("phone"),
        F.concat("house", F.lit(" Street")).alias("address"),
        "postal_code",
        F.when(twin, F.concat(F.lit("duplicate-"), digits(k, 4))).otherwise(F.concat(F.lit("unique-crm-"), digits(k, 3))).alias("group_id"),
        F.when(~twin, "household_false_positive_trap").when(every(37), "changed_phone").otherwise("duplicate").alias("scenario"),
    )
    billing = people(spark).select(
        F.lit("Billing").alias("source_system"),
        F.when(twin, F.concat(F.lit("billing-"), digits(k, 4))).otherwise(F.concat(F.lit("billing-unique-"), digits(k, 3))).alias("source_record_id"),
        F.when(~twin, F.concat_ws(" ", "other", "last")).when(every(9), slip).otherwise(name).alias("full_name"),
        F.when(~twin, alone("billing")).when(~every(13), F.upper(mail)).alias("email"),
        F.when(~twin, F.when(~every(11), phone(i + 7000))).when(every(37), phone(i + 5000)).when(every(7), spelt).otherwise(phone(i)).alias("phone"),
        F.concat("house", F.when(twin, " St").otherwise(" Street")).alias("address"),
        "postal_code",
        F.when(twin, F.concat(F.lit("duplicate-"), digits(k, 4))).otherwise(F.concat(F.lit("unique-billing-"), digits(k, 3))).alias("group_id"),
        F.when(~twin, "household_false_positive_trap").when(every(37), "changed_phone").otherwise("duplicate").alias("scenario"),
    )
    rows = crm.unionByName(billing).withColumn("updated_at", F.lit(UPDATED).cast("timestamp"))
    return rows.drop("group_id", "scenario"), rows.select("group_id", "source_system", "source_record_id", "scenario")
