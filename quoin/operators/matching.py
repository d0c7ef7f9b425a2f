"""Texts that contain needles, by an inverted index of short pieces instead of a loop over pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def _pieces(text: Column, n: int) -> Column:
    """Pieces of n characters, from left to right."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def containing(hay: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows of hay beside rows of needles where the text holds the needle; the columns of both, whose names must differ. Nulls match nothing, an empty needle every text.

    A text is known by its different pieces of one to LONGEST characters. Each different needle is looked up by that of its own pieces (all of LONGEST, or the needle where it is shorter) which fewest texts have;
    a needle with a piece that no text has is in none. What the equi-join on pieces finds is verified.
    """
    piece, low = "piece ", F.col(text)
    known = hay.where(low.isNotNull()).withColumn(piece, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(low, n) for n in range(1, LONGEST + 1)]))))
    often = known.groupBy(piece).agg(F.count("*").alias("texts "))
    n = F.col(needle)
    own = needles.select(needle).where(n.isNotNull()).distinct().withColumn(piece, F.explode(F.when(F.length(n) < LONGEST, F.array(n)).otherwise(F.array_distinct(_pieces(n, LONGEST)))))
    chosen = own.join(often, piece, "left").groupBy(needle).agg(F.min_by(piece, F.struct("texts ", piece)).alias(piece), F.max(F.col("texts ").isNull()).alias("absent ")).where("not `absent `").drop("absent ")
    return known.join(needles.join(chosen, needle), piece).where(F.contains(low, n)).drop(piece)
