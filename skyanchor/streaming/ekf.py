"""The trajectory filter as a stateful stream, and sessions, windows and duplicates under a watermark."""

from __future__ import annotations

from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.sequence import FIELDS, STARTED, STATE, advance
from ..sources.shared import make_folder, shared_folder

def _steps(pdfs) -> list[tuple]:
    """The rows of a user's frames in order, as tuples of FIELDS with None for what is missing; plain lists, as most users have few rows."""
    rows = []
    for pdf in pdfs:
        rows += zip(*([None if x is pd.NA or x != x else x for x in pdf[c].tolist()] for c in FIELDS))
    return sorted(rows, key=itemgetter(0))


def filtered(steps: DataFrame, drift_m: float = 50.0, yaw_sigma_deg: float = 1.0) -> DataFrame:
    """(user_id, state...) after each micro-batch, of a stream of steps that comes in order by user across batches.

    A batch's steps are sorted by i; steps not after the state's are late and ignored.
    """

    def run(key, pdfs, state):
        s = tuple(state.get) if state.exists else STARTED
        for x in _steps(pdfs):
            if x[0] > s[0]:
                s = advance(s, x, drift_m, yaw_sigma_deg)
        state.update(s)
        yield pd.DataFrame([(key[0], *s)], columns=["user_id", *(c.split()[0] for c in STATE.split(", "))])

    return steps.groupBy("user_id").applyInPandasWithState(run, f"user_id bigint, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


SEEN = "user_id bigint, last_ts timestamp, n bigint, lost boolean"


def presence(events: DataFrame, silence: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, last_ts, n, lost) of a stream (user_id, ts): who was heard in a micro-batch, and who is lost.

    A user is lost, and forgotten, once the watermark has passed their last event by
    silence: the state's timer is set in event time.  Late events neither move it back
    nor count less.
    """
    gap = int(pd.Timedelta(silence).total_seconds() * 1000)

    def run(key, pdfs, state):
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="us", tz="UTC")], "n": [n], "lost": [True]})
            return
        last, n = state.get if state.exists else (None, 0)
        for pdf in pdfs:
            top = int(pdf["us"].max())
            last, n = max(top, last) if last is not None else top, n + len(pdf)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="us", tz="UTC")], "n": [n], "lost": [False]})

    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return e.groupBy("user_id").applyInPandasWithState(run, SEEN, "last bigint, n bigint", "update", GroupStateTimeout.EventTimeTimeout)


def to_folder(path: str):
    """A sink for foreachBatch: each micro-batch replaces its own folder of the shared path, so that a repeated batch is written once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def stream_final_states(spark: SparkSession, steps: DataFrame, batches: int = 3) -> DataFrame:
    """Feed steps through the stateful stream in order, a slice of each user at a time, and give the last state of each."""
    base = shared_folder(spark, "stream")
    cols = steps.select("user_id", *FIELDS).withColumn("n", F.expr("count(*) over (partition by user_id)"))
    cols = cols.withColumn("part", F.least(F.lit(batches - 1), F.floor(F.col("i") * batches / F.col("n"))).cast("int")).drop("n")
    cols.write.partitionBy("part").parquet(f"{base}/all")
    schema = spark.read.parquet(f"{base}/all").drop("part").schema
    make_folder(spark, f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
    q = None
    for k in range(batches):
        spark.read.parquet(f"{base}/all/part={k}").write.mode("append").parquet(f"{base}/in")
        if q is None:
            q = filtered(stream).writeStream.outputMode("update").foreachBatch(to_folder(f"{base}/out")).option("checkpointLocation", f"{base}/check").start()
        q.processAllAvailable()
    q.stop()
    names = [c.split()[0] for c in STATE.split(", ")]
    states = spark.read.parquet(f"{base}/out").select("user_id", *names)
    return states.groupBy("user_id").agg(F.max(F.struct(*names)).alias("s")).select("user_id", "s.*")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream (user_id, ts, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def unique_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first event of each key of a stream, among those that come within late of each other."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windows(events: DataFrame, size: str = "15 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows of a stream (ts, event_type, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
