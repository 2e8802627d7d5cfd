"""Link counts as streams: minute windows with late data, and running queues kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.plans import lineage

c = F.col
#: How long a window waits for late events.
LATE = "10 minutes"


def folder(spark: SparkSession) -> str:
    """A new folder under that of ``spark.checkpoint.dir``, or under a temporary one where that is unset and all tasks run here."""
    return lineage.folder(spark, "stream")


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A stream of a Parquet file or folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def minute_windows(stream: DataFrame, time: str, key: str, window: str = "1 minute") -> DataFrame:
    """start, key, arrivals, departures in tumbling windows; ``kind`` tells which an event is."""
    counted = stream.withWatermark(time, LATE).groupBy(F.window(time, window).alias("w"), key)
    out = counted.agg(F.sum(F.when(c("kind") == "arrival", 1).otherwise(0)).alias("arrivals"), F.sum(F.when(c("kind") == "departure", 1).otherwise(0)).alias("departures"))
    return out.select(c("w.start").alias("start"), key, "arrivals", "departures")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """start, end, key, events of runs of events without a gap."""
    out = stream.withWatermark(time, LATE).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(c("w.start").alias("start"), c("w.end").alias("end"), key, "events")


def queues(stream: DataFrame, key: str) -> DataFrame:
    """key, arrivals, departures, peak: running counts and the largest queue at the end of a batch, kept as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrivals, departures, peak = state.get if state.exists else (0, 0, 0)
        for batch in batches:
            arrivals += int((batch.kind == "arrival").sum())
            departures += int((batch.kind == "departure").sum())
        peak = max(peak, arrivals - departures)
        state.update((arrivals, departures, peak))
        yield pd.DataFrame({key: [k[0]], "arrivals": [arrivals], "departures": [departures], "peak": [peak]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, arrivals long, departures long, peak long", "arrivals long, departures long, peak long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key after all that the source has now: the stream is run until then, in update mode.

    Each batch is written under its number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    out = folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/rows")
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.drop("batch").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_batch")
