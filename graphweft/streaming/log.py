"""Event logs as streams: ids once, windows with watermarks, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.runtime import shared_root


def event_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream; their schema is that of what is there."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumns({n: F.col(n).cast("timestamp") for n, t in stream.dtypes if t == "timestamp_ntz"})  # event time has to be an instant


def once(stream: DataFrame, id: str, ts: str, late: str) -> DataFrame:
    """Each id once; the watermark bounds what is remembered."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])


def windowed(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("events"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and return its result as a table in shared storage."""
    import uuid

    spark = stream.sparkSession
    root = shared_root(spark)
    run = uuid.uuid4().hex
    path = f"{root}/graphweft/stream-{run}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    schema = stream.schema
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/graphweft/offsets-{run}").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def last_by_key(stream: DataFrame, root: str, key: str, order: str, fingerprint: str) -> DataFrame:
    """Rows of a stream that change their key's fingerprint, as a table in shared storage.

    A micro-batch gathers what came since the last one, so bursts count once: of each key its last row, by `order`. It is reported if its fingerprint isn't the one known.
    Fingerprints are kept by batch number; a batch that runs again finds those of the batch before it and writes the same.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if number:
            known = spark.read.parquet(f"{root}/known/{number - 1}")
        else:
            known = last.select(key, F.col(fingerprint).alias("_old")).limit(0)
        met = last.join(known, key, "left")
        met.where(~F.col(fingerprint).eqNullSafe(F.col("_old")) | F.col("_old").isNull()).drop("_old").write.mode("overwrite").parquet(f"{root}/changed/batch={number}")
        new = last.select(key, F.col(fingerprint).alias("_old"))
        known.join(new, key, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{root}/known/{number}")

    q = stream.writeStream.option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/changed/*")


def stale_components(stream: DataFrame, key: str, ts: str, grace: str, late: str) -> DataFrame:
    """(component, last_seen) of each component for which event time has gone past its last event by the grace period: a timer for each, reset by every event.

    `grace` is like `7 days`; a component that comes back is timed anew.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ms = int(pd.Timedelta(grace).total_seconds() * 1000)

    def step(k, frames, state):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"component": [str(k[0])], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in frames:
            last = max(last, int(pdf["at"].max()))
        state.update((last,))
        due = last // 1000 + ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias("component"), F.col(ts), F.unix_micros(F.col(ts)).alias("at"))
    return timed.groupBy("component").applyInPandasWithState(step, "component string, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(stream: DataFrame, checkpoint: str, sinks: dict) -> dict[str, int]:
    """Hand every micro-batch to each sink (name: function of batch and number); a sink that fails misses that batch and holds up no other. Returns failures by name."""
    failed = dict.fromkeys(sinks, 0)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, sink in sinks.items():
            try:
                sink(batch, number)
            except Exception:  # noqa: BLE001  subscribers are on their own
                failed[name] += 1
        batch.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return failed


def coalesced(stream: DataFrame, checkpoint: str, key: str, order: str, capacity: int, run) -> None:
    """Hand `run` each micro-batch's keys once, the newest `capacity` of them by `order`: what a queue holds that drops its oldest."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max(order).alias(order)).orderBy(F.desc(order), key).limit(capacity)
        run(newest, number)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
