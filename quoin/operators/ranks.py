"""Exact ranks and quantiles of groups of any size: no group is in one buffer, sort or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.runtime import durable


def ranked(rows: DataFrame, group: list[str], by: list[str], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 within their group, in the order of by (nulls first); equal rows have different ranks, in any order.

    Rows are dealt to ranges of (group, by), so a large group is in many tasks, and a value that many rows share too (a number of each row parts them). Ranges are counted; a row's rank is the number of its
    group's rows in earlier ranges (one count a group and range) and its place within its own.
    """
    numbered = rows.withColumn("tie ", F.monotonically_increasing_id())
    dealt = durable(numbered.repartitionByRange(*group, *by, "tie ").withColumn("range ", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*group, "range ").agg(F.count("*").alias("n "))
    earlier = Window.partitionBy(*group).orderBy("range ").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"{g} ") for g in group], F.col("range ").alias("own range "), F.coalesce(F.sum("n ").over(earlier), F.lit(0)).alias("before "))
    place = F.row_number().over(Window.partitionBy(*group, "range ").orderBy(*by, "tie "))
    same = F.col("range ") == F.col("own range ")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g} "))
    return dealt.withColumn("place ", place).join(before, same).select(*rows.columns, (F.col("before ") + F.col("place ")).alias(name))


def picked(rows: DataFrame, group: str, value: str, at: dict[str, list[Column]]) -> DataFrame:
    """(group, n, and a column for each name in at): the mean of a group's values at the given ranks, which are columns of n, the number of its values that aren't null."""
    own = rows.where(F.col(value).isNotNull()).select(group, value)
    sizes = own.groupBy(group).agg(F.count("*").alias("n"))
    wanted = [F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, ranks in at.items() for r in ranks]
    asked = sizes.select(F.col(group).alias("its group"), "n", F.explode(F.array(*wanted)).alias("w")).select("its group", "n", "w.name", F.col("w.rank").alias("its rank"))
    met = ranked(own, [group], [value]).join(asked, F.col(group).eqNullSafe(F.col("its group")) & (F.col("rank") == F.col("its rank")))
    return met.groupBy(group, "n").agg(*[F.avg(F.when(F.col("name") == name, F.col(value))).alias(name) for name in at])


def median(n: Column) -> list[Column]:
    """The ranks whose mean is the median of n values."""
    return [F.floor((n + 1) / 2), F.floor(n / 2) + 1]


def discrete(share: float, n: Column) -> list[Column]:
    """The rank of the smallest value that at least this share of n values doesn't exceed."""
    return [F.greatest(F.lit(1), F.ceil(F.lit(str(share)).cast("decimal(10,9)") * n))]
