"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_CACHE: dict[str, dict] = {}


def worker_cache(name: str, most: int) -> dict:
    """A Python worker's table of what it has computed, for one purpose at a time and emptied beyond `most` entries, so that workers' memory stays bounded."""
    if name not in _CACHE or len(_CACHE[name]) > most:
        _CACHE.clear()
        _CACHE[name] = {}
    return _CACHE[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small input over all cores: a file of one row group is one task, however long its texts take. Inputs over `most` bytes have files enough and stay as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), f"quoin-{os.getpid()}")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        found = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/quoin/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


# On a local store (no other is touched), files without checksum files beside them: without native libraries each one costs a JVM several forks, for the rights of every file made.
_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def durable(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a table written in the shared folder and read again: its lineage ends there, and a lost executor loses none of it. partitions: files at most, for small tables."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(partitions) if partitions else df).write.options(**_LOCAL).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that this process wrote with durable(); results that still depend on it can't be read afterwards. Long sessions call it when their results are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def arrow_limits(spark: SparkSession, rows: int = 500, mb: int = 8) -> None:
    """Bound the batches that Python workers get, by rows and by bytes: texts may be very long. These settings of the session stay, as plans run after the call that made them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: a zip of it goes with the session, once."""
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_quoin_shipped", False):
        return
    base = Path(__file__).resolve().parent.parent
    if base.suffix != ".zip":
        to = Path(tempfile.mkdtemp()) / "quoin_package"
        shutil.copytree(base / "quoin", to / "quoin", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(to), "zip", to))
    sc._quoin_shipped = True
