"""Arriving files as a stream: each source once, with an append-only log; and event-time windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quoin.functions import text as T


def arrivals(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files as they come in, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def judged(docs: DataFrame) -> DataFrame:
    """Sources with digest, size, state and reason: refused without words, or with more than a tenth control characters, else accepted."""
    c = F.col("text")
    control = (F.length(c) - F.length(F.regexp_replace(c, T.CONTROL, ""))) / F.greatest(F.length(c), F.lit(1))
    reason = F.when(c.isNull() | (F.size(T.split_words(c)) == 0), "no words").when(control > 0.1, "control characters")
    return docs.withColumn("sha256", F.sha2(c, 256)).withColumn("size", F.octet_length(c)).withColumn("state", F.when(reason.isNull(), "accepted").otherwise("refused")).withColumn("reason", reason)


def accepted(docs: DataFrame) -> DataFrame:
    """Sources that pass the guards, with digest and size."""
    return judged(docs).where("state = 'accepted'").drop("state", "reason")


LOG = "sha256 string, size long, state string, reason string, run string, batch long"


def ingest(stream: DataFrame, to: str, log: str, checkpoint: str, quarantine: str | None = None) -> StreamingQuery:
    """Write what is new under `to`, what is refused under `quarantine` (if given), and a row for each source to the log; all in folders of run and batch.

    run is the query's id, which its checkpoint keeps: a batch that runs again overwrites itself, and a stream with another checkpoint adds folders of its own. The digests that this run has met are state of the
    stream, so its own log isn't read again, however long it grows; only what other runs logged is (their folders alone), so a source that comes twice, in a later run too, is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        told = judged(rows)
        new = told.where("state = 'accepted'").dropDuplicates(["sha256"])
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/run=*")
        others = [str(s.getPath()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or () if s.getPath().getName() != f"run={run}"]
        if others:
            known = spark.read.schema(LOG).option("basePath", log).parquet(*others).where("state = 'accepted'")
            new = new.join(known.select("sha256"), "sha256", "left_anti")
        own = f"run={run}/batch={number}"
        new.drop("state", "reason").write.mode("overwrite").parquet(f"{to}/{own}")
        refused = told.where("state = 'refused'")
        if quarantine:
            refused.write.mode("overwrite").parquet(f"{quarantine}/{own}")
        written = spark.read.schema("sha256 string, size int").parquet(f"{to}/{own}")  # what was written is what is logged
        rows_ = written.select("sha256", F.col("size").cast("long").alias("size"), F.lit("accepted").alias("state"), F.lit(None).cast("string").alias("reason"))
        rows_ = rows_.unionAll(refused.select("sha256", F.col("size").cast("long"), "state", "reason")) if quarantine else rows_
        rows_.write.mode("overwrite").parquet(f"{log}/{own}")

    met = stream.withColumn("digest ", F.sha2("text", 256)).dropDuplicates(["digest "]).drop("digest ")
    return met.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, over a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause longer than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
