"""The engine's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from silverloom.functions import identity
from silverloom.operators import blocking, clustering, golden, ingest, metrics, review, scoring
from silverloom.operators.components import connected_components
from silverloom.operators.rules import RuleSet
from silverloom.plans import engine
from silverloom.sources import records, sinks
from silverloom.sources.snapshots import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2025-01-01T00:00:00Z"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records.made_corpus(table(spark, sf_dir, "customer"))
    return made.withColumn("revision_id", F.col("source_record_id")).withColumn("source_id", F.col("source_record_id")).withColumn("ingested_at", F.lit(NOW).cast("timestamp"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(corpus(spark, sf_dir))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised records, made once for all that reads them."""
    return settle(normalized(spark, sf_dir), "pair-records")


# -- SQL that several oracles begin with ------------------------------------------------------------

CORPUS = "with recursive " + records.CORPUS_SQL
_ADDRESS = r"trim(regexp_replace(regexp_replace(lower(address), '[^\p{L}\p{N}\s#-]', ' ', 'g'), '\s+', ' ', 'g'))"
for _word, _short in (("street", "st"), ("road", "rd"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("apartment", "apt")):
    _ADDRESS = rf"regexp_replace({_ADDRESS}, '\b{_word}\b', '{_short}', 'g')"
_CODES = "translate(regexp_replace(upper(surname), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
for _digit in "0123456":
    _CODES = f"regexp_replace({_CODES}, '{_digit}+', '{_digit}', 'g')"
NORMAL = (
    CORPUS
    + rf""", norm0 as (
  select *, trim(regexp_replace(regexp_replace(lower(full_name), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) as n_name,
    lower(trim(email)) as n_email, regexp_replace(phone, '\D', '', 'g') as digits, {_ADDRESS} as n_address, regexp_replace(lower(postal_code), '\s+', '', 'g') as n_postal
  from records),
norm1 as (
  select *, case when regexp_matches(digits, '^1?[2-9][0-9][0-9][2-9][0-9][0-9][0-9][0-9][0-9][0-9]$') then '+1' || right(digits, 10) end as n_phone,
    split_part(n_name, ' ', 1) as first_name, split_part(n_name, ' ', -1) as surname, nullif(regexp_extract(n_address, '^\s*(\d+[a-zA-Z]?)\b', 1), '') as street_number
  from norm0),
norm as (
  select *, right(n_phone, 7) as phone_last7,
    substr(upper(surname), 1, 1) || rpad(replace(substr({_CODES}, 2), '0', ''), 3, '0') as surname_soundex
  from norm1)"""
)
BLOCKS = (
    NORMAL
    + """, blocks as (
  select source_record_id as id, 'EXACT_EMAIL' as rule, n_email as key from norm where n_email is not null
  union all select source_record_id, 'EXACT_PHONE', n_phone from norm where n_phone is not null
  union all select source_record_id, 'PHONE_LAST7_SURNAME_SOUNDEX', phone_last7 || '|' || surname_soundex from norm where n_phone is not null
  union all select source_record_id, 'SURNAME_SOUNDEX_POSTAL', surname_soundex || '|' || n_postal from norm
  union all select source_record_id, 'FIRST_INITIAL_SURNAME_STREET_NUMBER', substr(first_name, 1, 1) || '|' || surname || '|' || street_number from norm),
sizes as (select rule, key, count(*) as size from blocks group by rule, key)"""
)
PAIRS = (
    BLOCKS
    + """, pairs as (
  select a.id as left_id, b.id as right_id, string_agg(distinct a.rule, ',' order by a.rule) as rules
  from blocks a join blocks b on a.rule = b.rule and a.key = b.key and a.id < b.id join sizes s on s.rule = a.rule and s.key = a.key
  where s.size <= 500 group by a.id, b.id)"""
)
SCORES = (
    PAIRS
    + """, two as (
  select p.left_id, p.right_id, p.rules, l.n_name as ln, r.n_name as rn, l.n_email as le, r.n_email as re, l.n_phone as lp, r.n_phone as rp, l.n_address as la, r.n_address as ra
  from pairs p join norm l on l.source_record_id = p.left_id join norm r on r.source_record_id = p.right_id),
names as (
  select distinct ln, rn, case when length(ln) <= length(rn) then ln else rn end as s, case when length(ln) <= length(rn) then rn else ln end as l from two where ln <> rn),
walk(ln, rn, s, l, i, mask, got) as (
  select ln, rn, s, l, 1, repeat('0', length(l)), '' from names
  union all
  select ln, rn, s, l, i + 1, case when pos is null then mask else substr(mask, 1, pos - 1) || '1' || substr(mask, pos + 1) end, case when pos is null then got else got || substr(s, i, 1) end
  from (select *, list_filter(range(greatest(1, i - greatest(length(l) // 2 - 1, 0)), least(length(l), i + greatest(length(l) // 2 - 1, 0)) + 1), lambda j: substr(l, j, 1) = substr(s, i, 1) and substr(mask, j, 1) = '0')[1] as pos
        from walk where i <= length(s)) w),
ends as (
  select *, length(got) as m, array_to_string(list_transform(list_filter(range(1, length(l) + 1), lambda j: substr(mask, j, 1) = '1'), lambda j: substr(l, j, 1)), '') as other
  from walk where i = length(s) + 1),
jaro as (
  select ln, rn, s, l, case when m = 0 then 0.0::double else (m::double / length(ln) + m::double / length(rn) + (m - len(list_filter(range(1, m + 1), lambda k: substr(got, k, 1) <> substr(other, k, 1))) / 2.0::double) / m) / 3 end as j from ends),
winkler as (
  select ln, rn, case when j < 0.7 then j else j + 0.1::double * (case when substr(s, 1, 1) <> substr(l, 1, 1) then 0 when substr(s, 1, 2) <> substr(l, 1, 2) or length(s) < 2 then 1 when substr(s, 1, 3) <> substr(l, 1, 3) or length(s) < 3 then 2 when substr(s, 1, 4) <> substr(l, 1, 4) or length(s) < 4 then 3 else 4 end) * (1 - j) end as jw from jaro),
sims as (
  select t.*, (le = re)::int::double as se, (lp = rp)::int::double as sp, case when t.ln = t.rn then 1.0::double else w.jw end as sn,
    case when la is null or ra is null then null when la = ra then 1.0::double else greatest(0.0::double, 1 - levenshtein(la, ra)::double / greatest(length(la), length(ra))) end as sa
  from two t left join winkler w on w.ln = t.ln and w.rn = t.rn),
sums as (
  select *, case when sa is null then 0.0::double else sa * 0.15::double end + case when se is null then 0.0::double else se * 0.35::double end + case when sn is null then 0.0::double else sn * 0.2::double end + case when sp is null then 0.0::double else sp * 0.3::double end as total,
    case when sa is null then 0.0::double else 0.15::double end + case when se is null then 0.0::double else 0.35::double end + case when sn is null then 0.0::double else 0.2::double end + case when sp is null then 0.0::double else 0.3::double end as weight,
    (sa is not null)::int + (se is not null)::int + (sn is not null)::int + (sp is not null)::int as comparable, coalesce(se = 0 and sp = 0, false) as contradiction
  from sims),
scores as (
  select *, total / weight as raw,
    case when comparable < 2 then 'INSUFFICIENT_EVIDENCE' when contradiction then 'REVIEW'
      when total / weight >= 0.9 and sn is not null and ((coalesce(se = 1, false) or coalesce(sp = 1, false)) and sn >= 0.92 or coalesce(se = 1, false) and coalesce(sp = 1, false) and sn >= 0.8) then 'AUTO_MATCH'
      when total / weight >= 0.72 then 'REVIEW' else 'NO_MATCH' end as decision
  from sums)"""
)
WINNERS = (
    NORMAL
    + """, long as (
  select group_id as golden_id, source_system, source_record_id, updated_epoch, 'full_name' as field, full_name as value, n_name as normalized from norm
  union all select group_id, source_system, source_record_id, updated_epoch, 'email', email, n_email from norm
  union all select group_id, source_system, source_record_id, updated_epoch, 'phone', phone, n_phone from norm
  union all select group_id, source_system, source_record_id, updated_epoch, 'address', address, n_address from norm),
ranked as (
  select *, case when field = 'address' then case source_system when 'Billing' then 0 when 'CRM' then 1 else 2 end else case source_system when 'CRM' then 0 when 'Billing' then 1 else 2 end end as rank
  from long where value is not null),
winners as (
  select * from (select *, row_number() over (partition by golden_id, field order by rank, updated_epoch desc nulls last, source_system, source_record_id) as place from ranked) t where place = 1)"""
)


# -- sources and normalisation ----------------------------------------------------------------------


@query(CORPUS + " select source_system, source_record_id, full_name, email, phone, address, postal_code, updated_epoch, group_id, scenario from records")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("source_system", "source_record_id", "full_name", "email", "phone", "address", "postal_code", "updated_epoch", "group_id", "scenario")


@query(CORPUS + " select source_record_id, case when length(full_name) > 12 then 'full_name' when length(email) > 16 then 'email' end as error from records where length(full_name) > 12 or length(email) > 16")
def invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.validated(corpus(spark, sf_dir), {"full_name": 12, "email": 16})[1].select("source_record_id", "error")


@query("select cast(user_id as varchar) as source_record_id from events group by user_id having count(*) > 1")
def repeated_batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.repeated_keys(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_record_id")))


@query(NORMAL + " select source_record_id, n_name, n_email, n_phone, n_address, n_postal, first_name, surname, phone_last7, street_number from norm")
def normalized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("source_record_id", "n_name", "n_email", "n_phone", "n_address", "n_postal", "first_name", "surname", "phone_last7", "street_number")


@query(NORMAL + " select surname, surname_soundex, count(*) as n from norm group by surname, surname_soundex")
def surname_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).groupBy("surname", "surname_soundex").agg(F.count("*").alias("n"))


# -- change detection -------------------------------------------------------------------------------


def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table(spark, sf_dir, "events").withColumn("level", F.floor(F.col("value") / 50).cast("long"))
    return ingest.replay(stream, ["event_type", "user_id"], ["ts", "event_id"], ["level"])


EVENT_REVISIONS = """with told as (
  select *, cast(floor(value / 50) as bigint) as level, lag(cast(floor(value / 50) as bigint)) over w as last, row_number() over w as place from events window w as (partition by event_type, user_id order by ts, event_id)),
kept as (select *, row_number() over (partition by event_type, user_id order by ts, event_id) as revision_number from told where place = 1 or level is distinct from last)"""


@query(EVENT_REVISIONS + " select event_type, user_id, event_id, level, revision_number from kept")
def ingest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_revisions(spark, sf_dir).select("event_type", "user_id", "event_id", "level", F.col("revision_number").cast("long").alias("revision_number"))


@query(EVENT_REVISIONS + " select event_type, user_id, max(revision_number) as revision_number, arg_max(event_id, revision_number) as event_id from kept group by event_type, user_id")
def current_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_revisions(spark, sf_dir).withColumn("source_id", F.concat_ws("|", "event_type", "user_id")).select("source_id", "event_type", "user_id", "event_id", "revision_number")
    return ingest.current_revisions(rows).select("event_type", "user_id", "event_id", F.col("revision_number").cast("long").alias("revision_number"))


@query(CORPUS + " select count(*) filter (where source_system <> 'Billing' or try_cast(substr(source_record_id, 6) as int) % 3 = 0) as created, count(*) filter (where source_system = 'Billing' and try_cast(substr(source_record_id, 6) as int) % 3 <> 0) as unchanged from records")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is sent anew when two thirds of Billing's are held already."""
    every = corpus(spark, sf_dir).drop("revision_id", "source_id", "ingested_at")
    known = every.filter("source_system = 'Billing' and cast(substr(source_record_id, 6) as int) % 3 <> 0")
    held = ingest.new_revisions(ingest.detect_changes(spark.createDataFrame([], engine.SCHEMAS["revisions"]), known, F.lit(NOW).cast("timestamp")))
    return ingest.batch_summary(ingest.detect_changes(held, every, F.lit(NOW).cast("timestamp")))


def state_of(spark: SparkSession, **tables: DataFrame) -> engine.State:
    """A state with these tables, what columns they lack null; the others are empty."""
    empty = engine.State.empty(spark)
    return replace(empty, tables=empty.tables | {k: engine.conform_new(v, k) for k, v in tables.items()})


@query("select cast(c_custkey as varchar) as source_id, 'r' || c_custkey as revision_id, 'CLAIMED' as state from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def claim_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's first stage claims, beside an earlier run's claims (customers with a pending order)."""
    revisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("r"), "c_custkey").alias("revision_id"), F.lit(1).alias("revision_number"))
    claims = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("r"), "o_custkey").alias("revision_id"), F.lit(1).alias("ruleset_version"), F.lit("run-0").alias("run_id")).distinct()
    after = engine.stage_claim(state_of(spark, revisions=revisions, claims=claims), "run-1", NOW, RuleSet())
    return after["claims"].filter("run_id = 'run-1'").select("source_id", "revision_id", "state")


@query("select distinct 'g' || (c_custkey % 97) as golden_id from customer where c_custkey % 5 = 0 and c_custkey % 3 <> 0")
def affected_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    changes = rows.filter("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("source_id"), F.lit("CREATED").alias("status"))
    held = rows.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("source_id"), F.expr("'g' || (c_custkey % 97)").alias("golden_id"))
    return ingest.affected_goldens(changes, held)


# -- blocking and scoring ---------------------------------------------------------------------------


@query(BLOCKS + " select id as revision_id, rule, key from blocks")
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_keys(normalized(spark, sf_dir))


@query(BLOCKS + " select rule, size, count(*) as blocks from sizes group by rule, size")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(blocking.block_keys(normalized(spark, sf_dir))).groupBy("rule", "size").agg(F.count("*").alias("blocks"))


@query(BLOCKS + " select max(size) as max_observed_block_size, count(*) filter (where size > 2) as oversized_blocks from sizes")
def oversized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_figures(blocking.block_keys(normalized(spark, sf_dir)), 2)


@query(PAIRS + " select left_id, right_id, rules from pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(settled(spark, sf_dir)).withColumn("rules", F.array_join("rules", ","))


@query(PAIRS + " select left_id, right_id, rules from pairs where left_id like 'sup-%' or right_id like 'sup-%'")
def incremental_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs with a record that is claimed: here those of Support."""
    rows = settled(spark, sf_dir)
    claimed = rows.filter("source_system = 'Support'").select("revision_id")
    return blocking.candidate_pairs(rows, claimed).withColumn("rules", F.array_join("rules", ","))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired_and_scored(settled(spark, sf_dir))


@query(SCORES + " select left_id, right_id, rules, round(sa, 6) as sim_address, se as sim_email, round(sn, 6) as sim_name, sp as sim_phone, comparable, contradiction, round(raw, 6) as score, decision from scores")
def er_pairs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pair_scores(spark, sf_dir)
    return out.select("left_id", "right_id", F.array_join("rules", ",").alias("rules"), F.round("sim_address", 6).alias("sim_address"), "sim_email", F.round("sim_name", 6).alias("sim_name"), "sim_phone", "comparable", "contradiction", F.round("raw_score", 6).alias("score"), "decision")


@query(SCORES + " select count(*) as candidates, count(*) filter (where decision = 'AUTO_MATCH') as auto_match, count(*) filter (where decision = 'REVIEW') as review, count(*) filter (where decision = 'NO_MATCH') as no_match, count(*) filter (where decision = 'INSUFFICIENT_EVIDENCE') as insufficient_evidence from scores")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decision_counts(pair_scores(spark, sf_dir))


@query(SCORES + " select left_id, right_id, 'CANDIDATE' as type, 'PENDING' as status, case when contradiction then 'Email and phone both contradict' else 'Score meets review threshold but not auto-match safeguards' end as reason from scores where decision = 'REVIEW' and right(left_id, 1) <> '7'")
def review_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a run publishes, where those of some pairs are pending already."""
    held = pair_scores(spark, sf_dir).withColumn("first_run", F.lit("run-1"))
    pending = held.filter(F.right("left_id", F.lit(1)) == "7").select("left_id", "right_id", F.lit("PENDING").alias("status"))
    return review.publish(held, pending, "run-1", F.lit(NOW).cast("timestamp")).select("left_id", "right_id", "type", "status", "reason")


@query(PAIRS + " select left_id, right_id, rules, case when right(left_id, 1) < '5' then 'run-0' else 'run-1' end as first_run from pairs")
def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a second run meet those of a first, which knew one rule of each."""
    new = blocking.candidate_pairs(settled(spark, sf_dir)).withColumn("first_run", F.lit("run-1"))
    old = new.filter(F.right("left_id", F.lit(1)) < "5").withColumn("rules", F.slice("rules", 1, 1)).withColumn("first_run", F.lit("run-0"))
    return blocking.merge_candidates(old, new).withColumn("rules", F.array_join("rules", ","))


# -- clusters and golden records --------------------------------------------------------------------


@query(SCORES + ", edges as (select left_id as a, right_id as b from scores where decision = 'AUTO_MATCH' union all select right_id, left_id from scores where decision = 'AUTO_MATCH'), reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a) select a as node, min(b) as component from reach group by a")
def auto_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = pair_scores(spark, sf_dir).filter("decision = 'AUTO_MATCH'")
    return connected_components(auto.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).withColumn("golden_id", F.col("group_id"))


@query(WINNERS + " select golden_id, field, value, normalized, source_system, source_record_id, rank, 'sourcePriority=' || rank || '; updatedAt desc; ingestionTime desc; source identity asc' as rule from winners")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.provenance(group_members(spark, sf_dir)).select("golden_id", "field", "value", "normalized", "source_system", "source_record_id", "rank", "rule")


@query(WINNERS + " select w.golden_id, max(value) filter (where field = 'full_name') as full_name, max(value) filter (where field = 'email') as email, max(value) filter (where field = 'phone') as phone, max(value) filter (where field = 'address') as address, any_value(n.n_members) as n_members from winners w join (select group_id, count(*) as n_members from records group by group_id) n on n.group_id = w.golden_id group by w.golden_id")
def survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.projected(group_members(spark, sf_dir)).select("golden_id", "full_name", "email", "phone", "address", "n_members")


@query("select cast(c_custkey as varchar) as source_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) as golden_id from (select *, md5('golden|' || c_custkey) as m from customer where c_custkey % 4 <> 0) t")
def singleton_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden for each source that has none."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"))
    held = sources.filter("cast(source_id as bigint) % 4 = 0").withColumn("golden_id", F.lit("g"))
    return golden.singletons(sources.unionByName(sources), held)


@query(
    WINNERS
    + """, told as (select golden_id, string_agg(field || '=' || source_system || ':' || source_record_id || ':' || value, ';' order by field) as provenance from winners group by golden_id),
  members as (select group_id, count(*) as n, string_agg(source_system || ':' || source_record_id, ';' order by source_system, source_record_id) as members from records group by group_id)
  select group_id as golden_id, case when right(group_id, 1) = '3' then null else 2 end as current_version, members, case when right(group_id, 1) <> '3' then provenance end as provenance, case when right(group_id, 1) <> '3' then (select max(value) from winners w where w.golden_id = group_id and field = 'full_name') end as full_name from members left join told on golden_id = group_id"""
)
def golden_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, current version, members and provenance; goldens without a version have neither."""
    members = group_members(spark, sf_dir)
    heads = members.select("golden_id").distinct().withColumn("current_version", F.when(F.right("golden_id", F.lit(1)) != "3", 2))
    versions = golden.projected(members).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).withColumn("full_name", F.when(F.col("version") == 2, F.col("full_name")))
    told = golden.provenance(members).withColumn("version", F.lit(2))
    out = golden.read_golden(heads, versions, members.select("source_id", "golden_id"), told, members)
    listed = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["source_system"], m["source_record_id"])), ";")
    origin = F.array_join(F.transform("provenance", lambda p: F.concat(p["field"], F.lit("="), F.concat_ws(":", p["source_system"], p["source_record_id"], p["value"]))), ";")
    return out.select("golden_id", "current_version", listed.alias("members"), origin.alias("provenance"), "full_name")


@query("select event_id, event_type as type from events where user_id % 50 = 3 or event_id % 50 = 3 and event_id % 7 < 2")
def golden_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a golden, and those in which it was absorbed or made by a split."""
    other = F.concat(F.lit("g"), F.col("event_id") % 50)
    details = F.create_map(F.when(F.col("event_id") % 7 == 0, "absorbedGoldenId").when(F.col("event_id") % 7 == 1, "newGoldenId").otherwise("else"), other)
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("g"), F.col("user_id") % 50).alias("golden_id"), F.col("event_type").alias("type"), details.alias("details"), F.timestamp_seconds("event_id").alias("created_at"))
    return golden.history(events, "g3").select("event_id", "type")


def resolution(spark: SparkSession, sf_dir: str, rules: RuleSet = RuleSet()) -> tuple[DataFrame, DataFrame]:
    """All records as singletons, and what becomes of each automatic pair."""
    rows = settle(normalized(spark, sf_dir), "resolution-records")
    auto = scoring.paired_and_scored(rows, rules).filter("decision = 'AUTO_MATCH'")
    auto = settle(auto.select("left_id", "right_id", "score", F.col("left_id").alias("left_source"), F.col("right_id").alias("right_source")), "resolution-pairs")
    alone = rows.select("*", F.lit(1).alias("revision_number"), F.concat(F.lit("g-"), "source_id").alias("golden_id"), F.concat(F.lit("0|"), "source_id").alias("golden_created")).select(*clustering.RECORD)
    nothing = spark.createDataFrame([], "source_a string, source_b string, decision string")
    return rows, settle(clustering.resolve(alone, auto, nothing, rules), "resolution-effects")


@query()
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution(spark, sf_dir)[1].select("left_id", "right_id", "status", "conflict", "reason", "survivor", "absorbed")


@query()
def resolved_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, effects = resolution(spark, sf_dir)
    final = clustering.final_goldens(effects)
    own = rows.select("source_record_id", F.concat(F.lit("g-"), "source_id").alias("golden_id"))
    return own.join(final, F.col("golden_id") == F.col("absorbed"), "left").select("source_record_id", F.coalesce("survivor", "golden_id").alias("golden_id"))


@query()
def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems ingested, a whole run, and the golden records it leaves."""
    state = engine.State.empty(spark)
    rows = corpus(spark, sf_dir).drop("revision_id", "source_id", "ingested_at", "source_system")
    systems = corpus(spark, sf_dir).select("source_system", "source_record_id")
    for number, system in enumerate(("CRM", "Billing", "Support")):
        batch = rows.join(systems.filter(F.col("source_system") == system).select("source_record_id"), "source_record_id")
        state, _ = engine.ingest_batch(state, batch, system, f"2025-01-0{number + 1}T00:00:00Z", most=None)
    state, _ = engine.run(state, NOW)
    return state["goldens"].join(state["versions"], "golden_id", "left").filter(F.col("version").isNull() | (F.col("version") == F.col("current_version"))).select("golden_id", "status", "current_version", "merged_into", "n_members", "full_name", "email", "phone", "address")


# -- review, figures, evaluation --------------------------------------------------------------------


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review items of 1600 pairs."""
    kind = F.when(F.col("event_id") % 3 == 0, "CANDIDATE").otherwise("CLUSTER_CONFLICT")
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("review_id"), kind.alias("type"), F.expr("'run-' || (event_id % 2)").alias("run_id"),
        F.expr("cast(user_id % 40 + 1 as string)").alias("left_id"), F.expr("cast(event_id % 40 + 41 as string)").alias("right_id"),
        F.when(F.col("event_type").isin("view", "click"), "PENDING").otherwise("RESOLVED").alias("status"), F.timestamp_seconds(F.col("event_id") % 40 * 86400).alias("created_at"),
    )


def event_candidates(spark: SparkSession) -> DataFrame:
    pairs = spark.range(1600).select(F.expr("id div 40 + 1").alias("a"), F.expr("id % 40 + 41").alias("b")).filter("(a + b) % 3 = 0")
    return pairs.select(F.col("a").cast("string").alias("left_id"), F.col("b").cast("string").alias("right_id"), (F.col("a") / 64).alias("score"), F.array(F.lit("EXACT_EMAIL")).alias("rules"), F.lit("REVIEW").alias("decision"), F.lit(None).cast("string").alias("evidence"), F.lit("PENDING").alias("apply_status"))


ITEMS = "select *, lpad(cast(event_id as varchar), 9, '0') as review_id, user_id % 40 + 1 as l, event_id % 40 + 41 as r from events"


@query(f"select review_id, 86400 * (event_id % 40) as created_epoch, case when (l + r) % 3 = 0 then l / 64.0::double end as score from ({ITEMS}) t where event_type in ('view', 'click') and event_id % 3 = 0 and event_id % 2 = 0 and (event_id % 40 > 10 or event_id % 40 = 10 and review_id > '000000400') order by 2, 1 limit 26")
def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 25 pending items of one kind and run after a cursor, and one more row that tells of the next."""
    cursor = identity.encode_cursor("1970-01-11T00:00:00Z", "000000400")
    rows, _ = review.page(event_reviews(spark, sf_dir), event_candidates(spark), cursor, "CANDIDATE", "run-0", 25)
    return rows.select("review_id", F.unix_seconds("created_at").alias("created_epoch"), "score")


@query(f"""with items as ({ITEMS}), said as (select review_id, count(*) as n, arg_max(case when event_id % 3 = 0 then 'MATCH' else 'NO_MATCH' end, event_id) as last from
  (select event_id, lpad(cast(event_id - event_id % 4 as varchar), 9, '0') as review_id from events where event_type = 'purchase') t group by review_id)
  select i.review_id, case when (l + r) % 3 = 0 then l / 64.0::double end as score, a.c_name as left_name, case when l % 3 < 2 then 'g' || (l % 7) end as left_golden, b.c_name as right_name, case when r % 3 < 2 then 'g' || (r % 7) end as right_golden, n as n_decisions, last as last_decision
  from items i left join customer a on a.c_custkey = l left join customer b on b.c_custkey = r left join said on said.review_id = i.review_id""")
def review_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its candidate, both records with their goldens, and its decisions in order."""
    people = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    empty = [F.lit(None).cast("string").alias(c) for c in ("source_system", "source_record_id", "email", "phone", "address", "postal_code")]
    revisions = people.select(key.alias("revision_id"), key.alias("source_id"), F.lit(1).alias("revision_number"), F.col("c_name").alias("full_name"), *empty)
    memberships = people.filter("c_custkey % 3 < 2").select(key.alias("source_id"), F.expr("'g' || (c_custkey % 7)").alias("golden_id"))
    said = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.expr("lpad(cast(event_id - event_id % 4 as string), 9, '0')").alias("review_id"), F.col("event_id").alias("decision_id"), F.when(F.col("event_id") % 3 == 0, "MATCH").otherwise("NO_MATCH").alias("decision"),
        F.timestamp_seconds("event_id").alias("created_at"), *(F.lit(None).cast("string").alias(c) for c in ("supersedes_id", "actor", "note")),
    )
    out = review.detail(event_reviews(spark, sf_dir), event_candidates(spark), revisions, memberships, said)
    return out.select("review_id", "score", F.col("left.full_name").alias("left_name"), F.col("left.golden_id").alias("left_golden"), F.col("right.full_name").alias("right_name"), F.col("right.golden_id").alias("right_golden"), F.when(F.col("decisions").isNotNull(), F.size("decisions").cast("long")).alias("n_decisions"), F.element_at("decisions", -1)["decision"].alias("last_decision"))


LATEST = "select least(user_id % 40, event_id % 40) as a, greatest(user_id % 40, event_id % 40) as b, case when event_id % 3 = 0 then 'MATCH' else 'NO_MATCH' end as decision, ts, event_id from events"


@query(f"select 's' || a as source_a, 's' || b as source_b, arg_max(decision, (ts, event_id)) as decision from (select case when 's' || a <= 's' || b then a else b end as a, case when 's' || a <= 's' || b then b else a end as b, decision, ts, event_id from ({LATEST}) x) t group by a, b")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest word on an unordered pair, whichever way round it was asked."""
    events = table(spark, sf_dir, "events")
    reviews = events.select(F.col("event_id").cast("string").alias("review_id"), (F.col("user_id") % 40).cast("string").alias("left_id"), (F.col("event_id") % 40).cast("string").alias("right_id"))
    said = events.select(F.col("event_id").cast("string").alias("review_id"), F.col("event_id").alias("decision_id"), F.when(F.col("event_id") % 3 == 0, "MATCH").otherwise("NO_MATCH").alias("decision"), F.col("ts").alias("created_at"))
    revisions = spark.range(40).select(F.col("id").cast("string").alias("revision_id"), F.concat(F.lit("s"), "id").alias("source_id"))
    return review.latest_decisions(said, reviews, revisions)


RUN_METRICS = "select count(*) filter (where event_id % 4 < 2) as active_runs, coalesce(sum(event_id % 3), 0)::bigint as apply_failures, coalesce(sum(event_id % 5), 0)::bigint as retries, coalesce(max(user_id), 0) as max_block_size, count(*) filter (where event_type = 'purchase') as pending_reviews from events"


@query(RUN_METRICS)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, "STARTING").when(F.col("event_id") % 4 == 1, "RUNNING").otherwise("COMPLETED")
    runs = events.select(status.alias("status"), (F.col("event_id") % 3).alias("apply_failures"), (F.col("event_id") % 5).alias("retry_count"), F.col("user_id").alias("max_observed_block_size"))
    return metrics.gauges(runs, events.select(F.when(F.col("event_type") == "purchase", "PENDING").otherwise("RESOLVED").alias("status")))


@query(" union all ".join(f"select 'silverloom_{c} ' || {c} as line from ({RUN_METRICS}) t" for c in ("active_runs", "apply_failures", "retries", "max_block_size", "pending_reviews")))
def exported_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_gauges(run_metrics(spark, sf_dir))


@query(CORPUS + " select a.source_record_id as left_id, b.source_record_id as right_id from records a join records b on a.group_id = b.group_id and a.source_record_id < b.source_record_id where a.group_id like 'duplicate-%'")
def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.true_pairs(corpus(spark, sf_dir).select("group_id", F.col("source_record_id").alias("record_id")))


@query(
    SCORES
    + """, truth as (select a.source_record_id as left_id, b.source_record_id as right_id from records a join records b on a.group_id = b.group_id and a.source_record_id < b.source_record_id where a.group_id like 'duplicate-%'),
n as (select count(*) as k from records),
f as (select count(*) filter (where t.left_id is not null) as true_pairs, count(*) filter (where t.left_id is not null and s.decision is not null) as true_candidates, count(*) filter (where s.decision is not null) as candidates,
  count(*) filter (where s.decision = 'AUTO_MATCH') as auto_matches, count(*) filter (where s.decision = 'AUTO_MATCH' and t.left_id is not null) as true_auto_matches
  from scores s full join truth t on s.left_id = t.left_id and s.right_id = t.right_id)
select f.*, k * (k - 1) // 2 as all_pairs, round(true_candidates::double / true_pairs, 4) as candidate_recall, round(true_auto_matches::double / auto_matches, 4) as auto_precision, round(1 - candidates::double / (k * (k - 1) // 2), 4) as comparison_reduction from f, n"""
)
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(spark, sf_dir)
    labels = rows.select("group_id", F.col("source_record_id").alias("record_id"))
    return metrics.evaluate(scoring.paired_and_scored(rows, beside=("group_id",)), labels, rows.count())


@query("select a.o_custkey as revision_id, a.o_orderkey as first_run, b.o_orderkey as second_run from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey")
def overlapping_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlapping_claims(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("revision_id"), F.col("o_orderkey").alias("run_id")))
