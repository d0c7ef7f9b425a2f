"""What lost bytes stood for, learned with a word list that is a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.normalize import CANDIDATES
from quoin.runtime import durable

LETTER, LOST = r"\p{L}\p{Nl}\p{No}", r"\x00-\x08\x0b\x0c\x0e-\x1f"


def contexts(texts: DataFrame) -> DataFrame:
    """(id, byte, a, b): the letters on either side of each control byte between letters, of texts (id, text)."""
    chunk = F.explode(F.filter(F.regexp_extract_all("text", F.lit(f"[{LETTER}{LOST}]+"), F.lit(0)), lambda c: c.rlike(f"[{LETTER}][{LOST}][{LETTER}]"))).alias("chunk")
    rows = texts.select("id", chunk).select("id", F.split("chunk", f"[{LOST}]", -1).alias("p"), F.regexp_extract_all("chunk", F.lit(f"[{LOST}]"), F.lit(0)).alias("c"))
    each = F.transform("c", lambda c, i: F.struct(c.alias("byte"), F.get("p", i).alias("a"), F.get("p", i + 1).alias("b")))
    return rows.select("id", F.explode(each).alias("x")).select("id", "x.*").where("a != '' and b != ''")


def control_meanings(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, byte, meaning, votes, apart) of each text's control bytes between letters: the ligature that makes most words (ties to the first), if two or more and more than are halves that are words of their
    own; else a space. words (word) in lower case, of any number: contexts meet it by joins, those of one text counted before.

    A dictionary that fits in memory is broadcast by Spark; a larger one is shuffled by word, as the different pieces of all contexts are.
    """
    known = words.select(F.col("word")).where("word is not null").distinct()
    counted = durable(contexts(texts).groupBy("id", "byte", F.lower("a").alias("a"), F.lower("b").alias("b")).agg(F.count("*").alias("times")), "contexts")
    options = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("ligature")) for i, c in enumerate(CANDIDATES)])).alias("o")
    tried = counted.select("id", "byte", "times", "a", "b", options).select("id", "byte", "times", "o.place", "o.ligature", F.concat("a", "o.ligature", "b").alias("word"))
    votes = tried.join(known, "word", "left_semi").groupBy("id", "byte", "place", "ligature").agg(F.sum("times").alias("n"))
    best = votes.groupBy("id", "byte").agg(F.max(F.struct("n", (-F.col("place")).alias("p"), "ligature")).alias("best"))
    halves = counted.where("length(a) > 1 and length(b) > 1").join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    apart = halves.groupBy("id", "byte").agg(F.sum("times").alias("apart"))
    met = counted.select("id", "byte").distinct().join(best, ["id", "byte"], "left").join(apart, ["id", "byte"], "left").select("id", "byte", "best", F.coalesce("apart", F.lit(0)).alias("apart"))
    n = F.coalesce("best.n", F.lit(0))
    return met.select("id", "byte", F.when((n >= 2) & (n > F.col("apart")), F.col("best.ligature")).otherwise(" ").alias("meaning"), n.alias("votes"), "apart")


def replaced(text: Column, meanings: Column) -> Column:
    """A text in which bytes between letters stand for what is known of them (an array of byte and meaning), and all other control bytes for a space."""
    own = lambda s, m: F.regexp_replace(s, F.concat(F.lit(f"(?<=[{LETTER}])"), m["byte"], F.lit(f"(?=[{LETTER}])")), m["meaning"])
    return F.regexp_replace(F.aggregate(meanings, text, own), f"[{LOST}]", " ")


def repaired(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts (id, text) with what their control bytes stood for in place of them."""
    told = control_meanings(texts, words).where("meaning != ' '").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("byte", "meaning"))).alias("meanings"))  # a few bytes a text
    none = F.array().cast("array<struct<byte:string,meaning:string>>")
    return texts.join(told, "id", "left").select("id", replaced(F.col("text"), F.coalesce("meanings", none)).alias("text"))
