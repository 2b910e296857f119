"""Stateful folds over events, as batch queries; the streaming tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs as J
from ..session import table
from .catalog import query

STATE = "case event_type when 'signup' then 'queued' when 'click' then 'active' when 'view' then 'running' when 'purchase' then 'completed' else 'failed' end"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    state = F.when(e == "signup", "queued").when(e == "click", "active").when(e == "view", "running").when(e == "purchase", "completed").otherwise("failed")
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", state.alias("state"))


@query(f"with e as (select user_id, ts, event_id, {STATE} as state from events), l as (select * from e qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) select user_id, case when state in ('queued','active','running') then 'failed' else state end as state, state in ('queued','active','running') as retryable from l")
def t01_load(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a restart: what was active has failed and can be retried."""
    return J.last_states(_events(spark, d), "user_id", ["ts", "event_id"], "state")


@query(f"with e as (select user_id, {STATE} as state from events) select user_id, state, count(*) as transitions from e group by 1, 2")
def t03_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id", "state").agg(F.count("*").alias("transitions"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id, epoch_us(ts) // 3600000000 order by ts desc, event_id desc) = 1")
def t07_progress_reporter(spark: SparkSession, d: str) -> DataFrame:
    """At most one update per job and hour, the latest."""
    return J.throttled(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id", 3600).select("user_id", "event_id", "event_type")


@query("with s as (select user_id, event_id, value, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) - value as spent from events) select user_id, event_id from s where spent < 1000")
def t12_ensure_available(spark: SparkSession, d: str) -> DataFrame:
    """Calls made while the running total was within the budget."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return J.within_budget(rows, "user_id", ["ts", "event_id"], "value", 1000.0).select("user_id", "event_id")


@query("select id, created_at < timestamptz '2025-01-15 00:00:00+00' as due from field_claim where retracted_at is null")
def t15_recheck(spark: SparkSession, d: str) -> DataFrame:
    """What was last checked over a fixed time ago; now is a parameter, never the clock."""
    return table(spark, d, "field_claim").where("retracted_at is null").select("id", (F.unix_micros("created_at") < F.lit(1736899200000000)).alias("due"))


@query("select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type, count(*) as events from events group by 1, 2")
def t16_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows (an extension: the batch side of the streaming view)."""
    return J.windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "events")
