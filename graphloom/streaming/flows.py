"""Event streams: windows with watermarks, a numbered log per key, keyed expiry and compaction.

Every function takes a streaming DataFrame (ts, key columns) and returns one.
:func:`drained` runs a stream over what is there and gives the result as a
table; the offsets and the state live in the folder the cluster shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import work_dir


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a table: one file, or all files of a folder."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if [urlsplit(f).path for f in table.inputFiles()] == [urlsplit(path).path]:  # Spark streams folders only
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a folder or file of events; ``ts`` becomes a timestamp of the session's zone."""
    return table_stream(spark, path, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def numbered(events: DataFrame) -> DataFrame:
    """(key, seq, event_id): an append-only log numbered per key across batches, in order of time in a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        seq = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "seq": list(seq), "event_id": rows["event_id"].tolist()})

    return events.select("user_id", "ts", "event_id").groupBy("user_id").applyInPandasWithState(run, "key long, seq long, event_id long", "last long", "append", "NoTimeout")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/graphloom-streams/{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def server_sent(rows: DataFrame) -> DataFrame:
    """Frames of an event feed: one text a row, in the form a browser's event source reads."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("seq", "type")]))
    return rows.select(F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))
