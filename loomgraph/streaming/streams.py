"""Structured Streaming forms: ingest without repetitions, windowed counts, sessions, keyed state.

Every query runs over what is there and ends (availableNow), or continuously with another trigger; checkpoints and
results lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import shared_path

LATE = "2 days"


def source(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at `path` (a folder or one file), with the schema of `like`; `files` at most in
    each batch."""
    reader = spark.readStream.schema(like.schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """Event time as a timestamp under the session's zone (watermarks don't take timestamps without one), with the
    watermark after which late rows are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the query over all input and returns its table. append: all rows; complete: the last state of the table;
    update: all updates, numbered by batch."""
    spark = stream.sparkSession
    out, at = shared_path(spark, "stream"), shared_path(spark, "checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    writer.foreachBatch(store).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    kept = last[-1:] if mode == "complete" else last
    parts = [f"{out}/batch={n}" for n in kept]
    rows = spark.read.parquet(*parts)
    return rows.drop("batch") if mode == "complete" else rows


def distinct_events(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each key once, as long as its repetitions come within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and sums by tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = timed(events, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of a key: events no more than `gap` apart."""
    rows = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n", "total")


def decayed(events: DataFrame, weights: dict[str, float], unknown: float, days: float) -> DataFrame:
    """user_id, weight, last_us, n: each user's behaviour weights, fading by half in `days`, as of their last event. The
    state is one number and one time for a user, however many events there were."""

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["us", "event_id"])
        for us, kind in zip(rows["us"].tolist(), rows["event_type"].tolist(), strict=True):
            weight = weights.get(kind, unknown)
            if last is None or us >= last:
                total = weight + (total * 0.5 ** ((us - last) / 86_400e6 / days) if last is not None else 0.0)
                last = us
            else:  # late: it has faded already
                total += weight * 0.5 ** ((last - us) / 86_400e6 / days)
            n += 1
        state.update((total, last, n))
        yield pd.DataFrame({"user_id": [key[0]], "weight": [total], "last_us": [last], "n": [n]})

    rows = events.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, weight double, last_us long, n long", "total double, last long, n long", "update", GroupStateTimeout.NoTimeout)


def superseding(facts: DataFrame) -> DataFrame:
    """uuid, invalid_us: facts (subject, type, object, us, uuid) that a later one of the same subject and type with
    another object ends. The state is the facts that are still valid and their value."""

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, held = state.get if state.exists else (None, [])
        held = list(held)
        ended: list[tuple[int, int]] = []
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["us", "uuid"])
        for us, uuid, new in zip(rows["us"].tolist(), rows["uuid"].tolist(), rows["object"].tolist(), strict=True):
            if held and new != value:
                ended += [(h, us) for h in held]
                held = []
            value = new
            held.append(uuid)
        state.update((value, held))
        yield pd.DataFrame(ended, columns=["uuid", "invalid_us"]).astype("int64")

    return facts.groupBy("subject", "type").applyInPandasWithState(fold, "uuid long, invalid_us long", "value long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> Any:
    """Hands every batch to `apply`, which merges it into a table; a batch that is repeated after a failure has the same
    number, so that last-writer-wins merges give the same table."""
    at = shared_path(stream.sparkSession, "checkpoint")
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", at).trigger(availableNow=True).start()
