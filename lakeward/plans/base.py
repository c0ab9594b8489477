"""The driver's tables seen as access events, findings and incidents, in Spark and in SQL.

`events` stands for access events (user to principal, type to action, value to rows, props to object),
`customer` for findings of sampled columns. Thresholds of the queries are scaled to these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = {"click": "read", "view": "read", "purchase": "write", "signup": "connect", "error": "auth_failure"}
SEGMENTS = {"AUTOMOBILE": "email", "BUILDING": "phone", "FURNITURE": "card_number", "HOUSEHOLD": "person_name", "MACHINERY": "iban"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(column, cases: dict[str, str]):
    chain = F
    for k, v in cases.items():
        chain = chain.when(column == k, F.lit(v))
    return chain.otherwise(F.lit("other"))


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("principal"),
        choose(F.col("event_type"), ACTIONS).alias("action"),
        F.floor(F.col("value") * 100).cast("long").alias("rows"),
        F.concat(F.lit("target_"), (F.col("user_id") % 5).cast("string")).alias("target"),
        F.concat(F.lit("Obj_"), (k % 23).cast("string")).alias("object"),
        k.alias("k"),
    )


def sample_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("finding_id"),
        F.concat(F.lit("target_"), (F.col("c_nationkey") % 5).cast("string")).alias("target"),
        F.concat(F.lit("db_"), (key % 4).cast("string")).alias("db"),
        F.concat(F.lit("obj_"), (key % 23).cast("string")).alias("object"),
        F.when(key % 7 == 0, F.lit("password_hash")).otherwise(choose(F.col("c_mktsegment"), SEGMENTS)).alias("classifier"),
        F.round(F.lit(0.5) + (key % 50) / 100.0, 2).alias("confidence"),
        F.lit(200).cast("long").alias("sampled"),
        (key % 200).cast("long").alias("matched"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000).cast("long") + key * 60_000_000).alias("last_seen"),
    )


def _case(column: str, cases: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + " ELSE 'other' END"


EVENTS_SQL = f"""ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS principal, {_case('event_type', ACTIONS)} AS action,
  CAST(floor(value * 100) AS BIGINT) AS rows, 'target_' || CAST(user_id % 5 AS VARCHAR) AS target,
  'Obj_' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 23 AS VARCHAR) AS object,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""

FINDINGS_SQL = f"""fi AS (SELECT c_custkey AS finding_id, 'target_' || CAST(c_nationkey % 5 AS VARCHAR) AS target, 'db_' || CAST(c_custkey % 4 AS VARCHAR) AS db,
  'obj_' || CAST(c_custkey % 23 AS VARCHAR) AS object, CASE WHEN c_custkey % 7 = 0 THEN 'password_hash' ELSE {_case('c_mktsegment', SEGMENTS)} END AS classifier,
  round(0.5 + (c_custkey % 50) / 100.0, 2) AS confidence, CAST(200 AS BIGINT) AS sampled, CAST(c_custkey % 200 AS BIGINT) AS matched,
  make_timestamp(1704067200000000 + c_custkey * 60000000) AS last_seen FROM customer)"""

WEIGHT_SQL = "CASE classifier WHEN 'card_number' THEN 8 WHEN 'password_hash' THEN 8 WHEN 'iban' THEN 7 WHEN 'email' THEN 3 WHEN 'phone' THEN 3 WHEN 'person_name' THEN 2 ELSE 1 END"


def pick(column, values: tuple[str, ...]):
    """One of the values, dealt by a number."""
    return F.get(F.array(*map(F.lit, values)), (column % len(values)).cast("int"))


def pick_sql(column: str, values: tuple[str, ...]) -> str:
    return f"['{"', '".join(values)}'][({column}) % {len(values)} + 1]"
