"""Ingest of arriving files as transactions: a batch's texts, provenance and refusals count together, or not at all.

Each batch is extracted, guarded, normalised, guarded again and, where a control extraction is there, verified. Its tables go to folders of run and batch; a marker, written last, commits them. Readers see
committed batches only. Spark runs a batch that failed again under its number, which overwrites what was left half written; rollback() deletes it where no run follows. Which contents are known is state of
the stream, keyed by digest: a file that comes again, in a later batch or a later start, adds nothing, and a batch's work doesn't grow with what was ingested before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoin.operators import ingestion
from quoin.sources import library

LISTED = "name string, modified long"
LIST = 10_000  # names in one list at most
TABLES = {
    "sources": "path string, format string, text string, sha256 string, source_sha256 string, state string, reasons array<string>",
    "provenance": "path string, format string, source_sha256 string, output_sha256 string, ingested_at timestamp, limits string, tool string, state string",
    "refused": "path string, format string, source_sha256 string, refused string",
}
RUN = ", run string, batch long"


def arrivals(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Files of a folder as they come in, so many in a batch at most, older ones first; each content once (its digest is state), under the path that came first.

    What is new by name is listed when this is called, in lists below the folder (_arrived), and the stream is one of these lists, whose files tasks read. Spark's own stream of files keeps an entry of every file on the driver, and
    plans each batch by file. What comes later is met by the next call.
    """
    at, lists = spark._jvm.org.apache.hadoop.fs.Path(folder), f"{folder.rstrip('/')}/_arrived/lists"
    store, own = at.getFileSystem(spark._jsc.hadoopConfiguration()), library.escaped(lists)
    new = library.dated(spark, folder)
    if _exists(spark, lists):
        new = new.join(spark.read.schema(LISTED).parquet(own).select("name"), "name", "left_anti")
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(lists))
    many = max(1, -(-files // LIST))  # lists in a batch
    if not new.isEmpty():
        new.select("name", "modified").repartition(1).sortWithinPartitions("modified", "name").write.mode("append").option("maxRecordsPerFile", max(1, files // many)).parquet(lists)
    names = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", many).parquet(own)
    path, digest = F.concat(F.lit(f"{store.makeQualified(at).toString()}/"), "name"), F.sha2("bytes", 256)
    once = library.contents(names, folder).select("name", digest.alias("digest")).dropDuplicates(["digest"])  # names alone are shuffled: what is new is read again
    return library.contents(once, folder).select(path.alias("path"), F.col("bytes").alias("content"), digest.alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """run=/batch= folders below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/batch=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted("/".join(str(s.getPath()).rsplit("/", 2)[1:]) for s in found or ())


def judged(files: DataFrame, words: frozenset[str] = frozenset(), controls: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """files (path, content) as ingested: path, format, text, sha256, source_sha256, refused, state, reasons. controls (path, control, declared): what fails verification against its control is refused."""
    return _verified(ingestion.ingest_files(files.select("path", "content"), words), controls, limits)


def _verified(done: DataFrame, controls: DataFrame | None, limits: dict | None) -> DataFrame:
    """What ingest_files() made, with state and reasons; with controls it is read several times, so it has to give the same rows each time."""
    if controls is None:
        return done.withColumn("state", F.lit("unverified")).withColumn("reasons", F.array(F.lit("no control")))
    asked = done.where("refused is null").join(controls, "path").select(F.col("path").alias("id"), "control", F.col("text").alias("candidate"), "declared", F.lit(None).cast("array<int>").alias("pages"), F.lit(False).alias("accepted"))
    told = ingestion.verify_extractions(asked, limits).select(F.col("id").alias("path"), "state", "reasons")
    both = done.join(told, "path", "left").withColumn("state", F.coalesce("state", F.lit("unverified"))).withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no control"))))
    failed = F.col("refused").isNull() & (F.col("state") == "failed")
    return both.withColumn("refused", F.when(failed, F.concat(F.lit("verification: "), F.array_join("reasons", "; "))).otherwise(F.col("refused")))


def ingest(
    stream: DataFrame, to: str, checkpoint: str, run: str, words: frozenset[str] = frozenset(), controls: DataFrame | None = None, limits: dict | None = None, tool: str = "", between: Callable[[str, int], None] | None = None
) -> StreamingQuery:
    """Ingest what arrives. run names the stream (one a checkpoint). between is called after each table of a batch, with its name and the batch's number: where it raises, the batch isn't committed."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, own = rows.sparkSession, f"run={run}/batch={number}"
        if _exists(spark, f"{to}/commits/{own}"):  # committed, but stopped before the stream's checkpoint knew
            return
        staged, verified = f"{to}/staged/{own}", f"{to}/verified/{own}"
        # The batch's rows are read by this write alone: of files of one content, another may come first whenever they are read.
        ingestion.ingest_files(rows.select("path", "content"), words).write.mode("overwrite").parquet(staged)
        told = _verified(spark.read.parquet(staged), controls, limits)
        if controls is not None:
            told.write.mode("overwrite").parquet(verified)
            told = spark.read.parquet(verified)
        good = told.where("refused is null")
        made = {"sources": good, "provenance": ingestion.provenance(told, "1970-01-01", limits, tool).withColumn("ingested_at", F.current_timestamp()).join(good.select("path", "state"), "path"), "refused": told.where("refused is not null")}
        for name, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            made[name].select(*columns).write.mode("overwrite").parquet(f"{to}/{name}/{own}")
            if between:
                between(name, number)
        counts = told.agg(F.count_if(F.col("refused").isNull()).alias("accepted"), F.count_if(F.col("refused").isNotNull()).alias("refused"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{to}/commits/{own}")
        for done in (staged, verified):  # a copy of all texts
            _delete(spark, done)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, to: str, table: str) -> DataFrame:
    """The rows of a table (sources, provenance or refused) in committed batches, with run and batch."""
    paths = [f"{to}/{table}/{x}" for x in _folders(spark, f"{to}/commits")]
    if not paths:
        return spark.createDataFrame([], TABLES[table] + RUN)
    return spark.read.schema(TABLES[table] + RUN).option("basePath", f"{to}/{table}").parquet(*paths)


def rollback(spark: SparkSession, to: str) -> list[str]:
    """Delete what batches without a marker have left, and staged and verified rows that a committed batch had no time to delete; the folders deleted. Not while a stream writes there."""
    sure, gone = set(_folders(spark, f"{to}/commits")), []
    for name in ("staged", "verified", *TABLES):
        for x in _folders(spark, f"{to}/{name}"):
            if name not in TABLES or x not in sure:
                _delete(spark, f"{to}/{name}/{x}")
                gone.append(f"{name}/{x}")
    return gone
