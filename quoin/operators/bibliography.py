"""The bibliography: which of its lines is a source's, which sources it lacks, and which cards carry an outdated copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.matching import containing

# A fixed value: characters of a source's file name.
NAME = "[A-Za-z0-9._-]"


def names_in(line: Column) -> Column:
    """The sources that a line names: files ending in .txt that stand alone, and what follows a backtick up to any dot or to the closing one."""
    files = F.transform(F.filter(F.regexp_extract_all(line, F.lit(f"({NAME}+)"), F.lit(1)), lambda x: F.endswith(x, F.lit(".txt"))), lambda x: F.substring(x, F.lit(1), F.length(x) - 4))
    quoted = F.regexp_extract_all(line, F.lit(f"`({NAME}+`?)"), F.lit(1))

    def heads(x: Column) -> Column:
        parts = F.split(F.rtrim(x, F.lit("`")), r"\.", -1)
        whole = F.when(F.endswith(x, F.lit("`")), F.size(parts)).otherwise(F.size(parts) - 1)
        return F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda n: F.when(n <= whole, F.array_join(F.slice(parts, F.lit(1), n), ".")))

    return F.filter(F.array_distinct(F.concat(files, F.flatten(F.transform(quoted, heads)))), lambda x: x.isNotNull() & (x != ""))


def lines(bibliography: DataFrame) -> DataFrame:
    """(at, line) of a bibliography (column text)."""
    return bibliography.select(F.posexplode(F.split("text", "\n")).alias("at", "line"))


def lookup(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources (id) with their line of the bibliography (at, line), null if it names them nowhere: the first row of a table, else the first line."""
    row = F.trim("line")
    named = rows.select("at", row.alias("line"), F.explode(names_in(F.col("line"))).alias("id"))
    best = named.groupBy("id").agg(F.min_by("line", F.struct(~F.startswith("line", F.lit("|")), "at")).alias("line"))
    return sources.select("id").join(best.select("id", F.trim(F.ltrim("line", F.lit("|"))).alias("line")), "id", "left")


def uncovered(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Sources (id) that the bibliography neither names nor mentions by one of the first three parts of their name that are words of three letters or more."""
    missing = lookup(sources, rows).where("line is null").select("id")
    parts = F.slice(F.filter(F.split(F.lower("id"), "-"), lambda p: (F.length(p) >= 3) & p.rlike(r"^\p{L}+$")), 1, 3)
    asked = missing.select("id", F.explode_outer(parts).alias("part"))
    tokens = asked.where("part is not null").select("part").distinct()
    said = containing(rows.select(F.lower("line").alias("line")), tokens, "line", "part").select("part").distinct().withColumn("said", F.lit(True))
    return asked.join(said, "part", "left").groupBy("id").agg(F.max(F.coalesce("said", F.lit(False))).alias("said")).where("not said").select("id")


def outdated(cards: DataFrame, rows: DataFrame) -> DataFrame:
    """Cards (id, card) whose copy of their bibliography line isn't the line as it is now: (id, copied, live). Cards without a copy and sources without a line aren't among them."""
    copied = cards.select("id", F.nullif(F.trim(F.regexp_extract("card", r"(?m)^\*\*Bibliography\.\*\* (.+)$", 1)), F.lit("")).alias("copied")).where("copied is not null")
    live = lookup(copied, rows).where("line is not null").withColumnRenamed("line", "live")
    return copied.join(live, "id").where("copied != trim(live)")


def title(line: Column) -> Column:
    """What stands before the file name of a line, without emphasis; null if nothing does."""
    return F.nullif(F.trim(F.replace(F.rtrim(F.trim(F.substring_index(line, "`", 1)), F.lit("|")), F.lit("*"), F.lit(""))), F.lit(""))


def humanized(stem: Column) -> Column:
    """A title made of a file name: without its year and what follows, spaces for hyphens, the first letter upper case."""
    s = F.trim(F.replace(F.regexp_replace(stem, r"-\d{4}.*$", ""), F.lit("-"), F.lit(" ")))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def source_title(stem: Column, line: Column) -> Column:
    return F.coalesce(title(line), humanized(stem))
