"""Sources of customer records: JSON batches, tables by Parquet or JDBC, label files, a made corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from silverloom.functions import text

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("sourceRecordId", "fullName", "email", "phone", "address", "postalCode", "updatedAt")])
BATCH = T.StructType([T.StructField("records", T.ArrayType(RECORD))])
LABEL = "group_id string, source_system string, source_record_id string, scenario string"
#: The longest text of each field, and the most records of a batch.
LIMITS = {"source_record_id": 200, "full_name": 500, "email": 500, "phone": 100, "address": 1000, "postal_code": 40}
MOST_RECORDS = 1000
NAMES = {"sourceRecordId": "source_record_id", "fullName": "full_name", "email": "email", "phone": "phone", "address": "address", "postalCode": "postal_code", "updatedAt": "updated_at"}


class InvalidBatch(ValueError):
    """A batch that is refused as a whole; its text begins with the error's code."""


#: An instant as the records write it.
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"
#: Holds an updatedAt that is no instant, so that its row is refused.
UNREAD = "unread_updated_at"


def flat(batches: DataFrame) -> DataFrame:
    """A row for each record of batches {records: [...]}; a null or missing field is null, an updatedAt
    that is no instant is kept beside (see UNREAD)."""
    rows = batches.select(F.inline("records")).select(*(F.col(a).alias(b) for a, b in NAMES.items()))
    said = F.col("updated_at")
    read = F.when(said.rlike(INSTANT), F.expr("try_cast(updated_at as timestamp)"))
    return rows.withColumn(UNREAD, F.when(said.isNotNull() & read.isNull(), said)).withColumn("updated_at", read)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark.read.schema(BATCH).json(path, multiLine=True))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).csv(path, header=True)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 1 << 31), parts: int = 8) -> DataFrame:
    """A table of another database; with a numeric column it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def check_source_system(name: str) -> str:
    name = (name or "").strip()
    if not (1 <= len(name) <= 100 and all(c.isascii() and (c.isalnum() or c in "_-") for c in name)):
        raise InvalidBatch("INVALID_SOURCE_SYSTEM")
    return name


def row_error(records: DataFrame, limits: dict[str, int] = LIMITS) -> Column:
    """The first field that breaks its limits, or null."""
    out = F.when(text.present(F.col("source_record_id")).isNull(), F.lit("source_record_id"))
    for name, most in limits.items():
        out = out.when(F.length(name) > most, F.lit(name))
    return out.when(F.col(UNREAD).isNotNull(), F.lit("updated_at")) if UNREAD in records.columns else out


def validated(records: DataFrame, limits: dict[str, int] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the limits, and the others with the field that doesn't."""
    judged = records.withColumn("error", row_error(records, limits))
    return judged.filter("error is null").drop("error", UNREAD), judged.filter("error is not null")


def repeated_keys(records: DataFrame) -> DataFrame:
    return records.groupBy("source_record_id").count().filter("count > 1").select("source_record_id")


def check_batch(records: DataFrame, most: int | None = MOST_RECORDS) -> DataFrame:
    """The batch, unless it has no or too many rows, a bad row or a repeated key."""
    counts = records.agg(F.count("*").alias("n"), F.count(row_error(records)).alias("bad")).first()
    if not counts["n"] or most and counts["n"] > most or counts["bad"]:
        raise InvalidBatch("VALIDATION_ERROR")
    if not repeated_keys(records).isEmpty():
        raise InvalidBatch("DUPLICATE_BATCH_ID")
    return records.drop(UNREAD)


#: The words that made records are put together from.
FIRST = "alice,bruno,carla,david,elena,felix,grace,hugo,irene,jonas,karin,louis,maria,nadia,oscar,paula"
LAST = "miller,smith,johnson,garcia,brown,davis,wilson,moore,taylor,anderson,thomas,jackson,white,harris,martin,thompson,robinson,clark,lewis,walker"
STREETS = "main,oak,pine,maple,cedar,elm,park,lake,hill,river"

#: Customers as records of three systems, in SQL that Spark and DuckDB read alike.
CORPUS_SQL = f"""
base as (
  select cast(c_custkey as int) as i,
    split_part('{FIRST}', ',', cast(c_custkey % 16 + 1 as int)) as fn,
    split_part('{FIRST}', ',', cast((c_custkey + 3) % 16 + 1 as int)) as fn3,
    split_part('{LAST}', ',', cast((7 * c_custkey + floor(c_custkey / 16)) % 20 + 1 as int)) as ln,
    cast(100 + c_custkey % 700 as string) || ' ' || split_part('{STREETS}', ',', cast(c_custkey % 10 + 1 as int)) as street,
    lpad(cast(10000 + c_custkey % 9000 as string), 5, '0') as postal,
    1704067200 + (c_custkey % 365) * 86400 as day
  from customer),
phones as (
  select i, o, lpad(cast(200 + cast(floor((i + o) / 10000) as int) % 700 as string), 3, '0') as ex, lpad(cast((i + o) % 10000 as string), 4, '0') as li
  from (select i, 0 as o from base union all select i, 500000 as o from base where i % 37 = 0 union all select i, 700000 as o from base where i % 5 = 4) t),
records as (
  select 'CRM' as source_system, 'crm-' || cast(b.i as string) as source_record_id, fn || ' ' || ln as full_name,
    case when b.i % 29 = 0 then null else 'user' || cast(b.i as string) || '@mail.test' end as email,
    '+1 206 ' || ex || ' ' || li as phone, street || ' Street' as address, postal as postal_code, cast(day as bigint) as updated_epoch,
    'duplicate-' || cast(b.i as string) as group_id, 'duplicate' as scenario
  from base b join phones p on b.i = p.i and p.o = 0
  union all
  select 'Billing', 'bill-' || cast(b.i as string), case when b.i % 9 = 0 then substr(fn, 1, 2) || substr(fn, 4) else fn end || ' ' || ln,
    case when b.i % 13 = 0 then null else upper('user' || cast(b.i as string) || '@mail.test') end,
    case when b.i % 7 = 0 then '(206) ' || ex || '-' || li else '+1 206 ' || ex || ' ' || li end, street || ' St', postal,
    cast(day + case when b.i % 2 = 0 then 86400 else 0 end as bigint), 'duplicate-' || cast(b.i as string), case when b.i % 37 = 0 then 'changed_phone' else 'duplicate' end
  from base b join phones p on b.i = p.i and p.o = case when b.i % 37 = 0 then 500000 else 0 end where b.i % 5 < 4
  union all
  select 'Billing', 'bill-' || cast(b.i as string), fn3 || ' ' || ln, 'other' || cast(b.i as string) || '@mail.test', '+1 206 ' || ex || ' ' || li,
    street || ' Street', postal, cast(day as bigint), 'unique-b-' || cast(b.i as string), 'household_false_positive_trap'
  from base b join phones p on b.i = p.i and p.o = 700000 where b.i % 5 = 4
  union all
  select 'Support', 'sup-' || cast(b.i as string), fn || ' ' || ln, case when b.i % 12 = 0 then null else 'user' || cast(b.i as string) || '@mail.test' end,
    '+1 206 ' || ex || ' ' || li, street || ' Street', postal, case when b.i % 4 = 0 then null else cast(day as bigint) end,
    'duplicate-' || cast(b.i as string), 'duplicate'
  from base b join phones p on b.i = p.i and p.o = 0 where b.i % 6 = 0)
"""


def made_corpus(customers: DataFrame) -> DataFrame:
    """Records of three systems made from customers, with the group that tells duplicates."""
    sql = "with customer as (select * from {made_customer}), " + CORPUS_SQL.replace("{", "{{").replace("}", "}}") + " select *, timestamp_seconds(updated_epoch) as updated_at from records"
    return customers.sparkSession.sql(sql, made_customer=customers)
