"""Streaming operators over event files: windows with watermarks, sessions, feedback state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.files import scratch


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The Parquet table ``name`` of ``folder`` as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_once(result: DataFrame, mode: str = "append", kind: str = "parquet") -> DataFrame:
    """Runs a stream over what its source has now and returns what it wrote to the shared folder.

    In append mode the files are the result, JSON lines if ``kind`` is ``json``. In complete mode each batch replaces the last one.
    """
    spark = result.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    writer = result.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format(kind).option("path", out).start()
    else:
        kind, query = "parquet", writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.format(kind).schema(result.schema).load(out)


#: Key and distance in time of the row that ends a stream that is known to be over.
LAST, BEHIND = "__last__", "400 days"


def with_end(events: DataFrame, time: str, folder: str, name: str = "events") -> DataFrame:
    """The stream with one more row, far behind the last, that moves the watermark so that all windows before it close.

    Only for a source that is known to be over; a stream that goes on closes its windows by itself.
    """
    spark = events.sparkSession
    last = spark.read.parquet(f"{folder}/{name}.parquet").agg(F.max(time).alias(time))
    end = last.select(*[(F.col(time) + F.expr(f"INTERVAL {BEHIND}")).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    out = scratch(spark, "stream-end")
    end.write.parquet(out)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(out))


def tumbling(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Events and their values per window and key; in append mode a window comes out once when the watermark, ``late`` behind the
    latest event, has passed it, its state is dropped, and events that come later still are left out."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Events per session of each key, closed by a gap; in append mode a session comes out when the watermark has passed it."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), *by, "n")


def feedback(events: DataFrame, *by: str) -> DataFrame:
    """Running clicks and views of each key, clicks weighted by 1 / max(propensity, 0.05)."""
    propensity = F.lit(1.0) / (F.lit(1) + F.get_json_object("props", "$.k").cast("double") % 20)
    weight = F.lit(1.0) / F.greatest(propensity, F.lit(0.05))
    click = F.col("event_type") == "click"
    return events.groupBy(*by).agg(F.sum(click.cast("int")).alias("clicks"), F.round(F.sum(F.when(click, weight).otherwise(0.0)), 4).alias("ips_clicks"), F.sum((F.col("event_type") == "view").cast("int")).alias("views"))
