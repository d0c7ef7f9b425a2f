"""Long measuring runs that can stop and go on: results for each document and tier, under a manifest of what is measured and how."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators.ranks import ranked
from quoin.sources.library import exists


class ManifestError(ValueError):
    """The folder holds results of other inputs or settings."""


def manifest(inputs: DataFrame, settings: dict) -> dict:
    """What tells a run from others: its settings, how many inputs (doc, tier, digest) it has, and a digest of them all that doesn't depend on their order."""
    own = F.xxhash64("doc", "tier", "digest")
    r = inputs.agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit(1 << 40))).alias("s")).first()
    return {"schema": "measuring-run/v1", "settings": settings, "inputs": r["n"], "digest": f"{(r['x'] or 0) & (1 << 64) - 1:016x}{r['s'] or 0:x}"}


def resume(inputs: DataFrame, at: str, settings: dict, measure: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """All results so far (the columns of measure, which has doc and tier) after measuring what is left of inputs (doc, tier, digest, ...), at most so many of them in this call.

    The first call writes the manifest; a folder with another manifest is refused, as its results would be mixed with these. Each call appends its results in one write, which counts as a whole or not at all;
    an anti join on doc and tier picks what is left; the first of them, by tier and doc, are told by ranks over ranges, so that no task sees all. An input that measure gives no row for is tried again by each call.
    """
    spark, own, path = inputs.sparkSession, json.dumps(manifest(inputs, settings), sort_keys=True), f"{at}/manifest"
    if exists(spark, path):
        found = spark.read.text(path, wholetext=True).first()[0].strip()
        if found != own:
            raise ManifestError(f"{at} holds results under another manifest: {found}")
    else:
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(path)
    left = inputs
    if exists(spark, f"{at}/results"):
        left = inputs.join(spark.read.parquet(f"{at}/results").select("doc", "tier"), ["doc", "tier"], "left_anti")
    if most is not None:
        first = ranked(left.select("tier", "doc"), [], ["tier", "doc"]).where(F.col("rank") <= most)
        left = left.join(first.select("doc", "tier"), ["doc", "tier"], "left_semi")
    measure(left).write.mode("append").parquet(f"{at}/results")
    return spark.read.parquet(f"{at}/results")
