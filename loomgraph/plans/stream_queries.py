"""The streaming forms, run over the whole of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import UNKNOWN
from ..session import table
from ..streaming import streams
from .catalog import query


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.source(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events"))


@query("select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and behaviour."""
    rows = streams.finished(streams.windowed(stream(spark, sf_dir), ["event_type"], "1 day"), "complete")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("select d + interval (o * 12) hour window_start, count(*) n from (select date_trunc('day', ts)::timestamp + interval (12 * (extract(hour from ts) // 12)) hour d from events), (select unnest([0, -1]) o) group by 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by days that begin every twelve hours."""
    rows = streams.finished(streams.windowed(stream(spark, sf_dir), [], "1 day", "12 hours"), "complete")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 21600e6 then 0 else 1 end fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) no from g) select user_id, min(ts) started, count(*) n, round(sum(value), 6) total from s group by user_id, no""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: sessions of users."""
    rows = streams.finished(streams.sessions(stream(spark, sf_dir), "user_id", "6 hours"), "complete")
    return rows.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n", F.round("total", 6).alias("total"))


@query("select event_id, user_id, event_type from events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, though the stream brings each twice."""
    twice = stream(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_n")).drop("_n")
    return streams.finished(streams.distinct_events(twice), "append").select("event_id", "user_id", "event_type")


@query("""with l as (select user_id, max(ts) last from events group by 1) select user_id, count(*) n, round(sum(case event_type when 'purchase' then 1.0 else 0.2 end * 0.5 ** ((epoch_us(last) - epoch_us(ts)) / 86400e6 / 14)), 6) weight from events join l using (user_id) group by 1""")
def stream_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed preference state."""
    rows = streams.finished(streams.decayed(stream(spark, sf_dir), {"purchase": 1.0, "click": 0.2, "view": 0.2}, UNKNOWN, 14.0), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "weight"), "batch").alias("r"))
    return last.select("user_id", "r.n", F.round("r.weight", 6).alias("weight"))


@query("""with r as (select user_id, event_type, event_id, ts, (props->>'k')::int k, lead((props->>'k')::int) over w nk, lead(ts) over w nt from events window w as (partition by user_id, event_type order by ts, event_id)),
c as (select *, case when nk <> k then nt end step from r), i as (select event_id, first_value(step ignore nulls) over (partition by user_id, event_type order by ts, event_id rows between current row and unbounded following) at0 from c)
select event_id, epoch_us(at0) invalid_us from i where at0 is not null""")
def stream_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts ended by later ones, from keyed state."""
    facts = stream(spark, sf_dir).select(F.col("user_id").alias("subject"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("object"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("uuid"))
    return streams.finished(streams.superseding(facts), "append").select(F.col("uuid").alias("event_id"), "invalid_us")
