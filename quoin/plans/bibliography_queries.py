"""A bibliography made of documents: rows, prose, mentions and near misses; look-up, coverage and outdated copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import bibliography as B
from quoin.plans.registry import query
from quoin.plans.text_queries import docs

_KEY = "'q' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij') || 'z'"
_SOURCES = f"s AS (SELECT doc_id, lang, {_KEY} AS part, {_KEY} || '-' || (1900 + doc_id % 100) || '-' || lang AS id FROM documents)"
_LINES = """b AS (SELECT doc_id * 10 + k AS pos, trim(line) AS line FROM (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN ['prose on `' || id || '` first', '| **On ' || lang || '** | `' || id || '.txt` |'] WHEN 1 THEN ['  see `' || id || '` for it'] WHEN 2 THEN [id || '.txt is fine', 'and again ' || id || '.txt'] WHEN 3 THEN ['Said by ' || upper(part)]
  WHEN 4 THEN ['x' || id || '.txt'] WHEN 5 THEN ['`' || id || '-more.txt`', id || '.txts'] WHEN 6 THEN ['none'] ELSE ['`' || id || '.x.y`'] END AS x FROM s)))"""
_HIT = "m AS (SELECT s.doc_id, s.id, b.pos, b.line FROM s JOIN b ON contains(b.line, s.id) WHERE regexp_matches(b.line, '(^|[^A-Za-z0-9._-])' || s.id || '\\.txt($|[^A-Za-z0-9._-])') OR regexp_matches(b.line, '`' || s.id || '[.`]')), f AS (SELECT doc_id, trim(ltrim(arg_min(line, (NOT starts_with(line, '|'))::INT * 1000000000000 + pos), '|')) AS line FROM m GROUP BY doc_id)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, part, id): a file name for each document, its first part a word of its own."""
    d = F.col("doc_id").cast("string")
    part = F.concat(F.lit("q"), F.translate(d, "0123456789", "abcdefghij"), F.lit("z"))
    return docs(spark, sf_dir).select("doc_id", "lang", part.alias("part"), F.concat(part, F.lit("-"), (F.col("doc_id") % 100 + 1900).cast("string"), F.lit("-"), "lang").alias("id"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(at, line) of a bibliography of these sources."""
    s, k = sources(spark, sf_dir), F.col("doc_id") % 8
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    i = F.col("id")
    kinds = [
        F.array(say("prose on `", i, "` first"), say("| **On ", F.col("lang"), "** | `", i, ".txt` |")), F.array(say("  see `", i, "` for it")), F.array(say(i, ".txt is fine"), say("and again ", i, ".txt")), F.array(say("Said by ", F.upper("part"))),
        F.array(say("x", i, ".txt")), F.array(say("`", i, "-more.txt`"), say(i, ".txts")), F.array(F.lit("none")), F.array(say("`", i, ".x.y`")),
    ]
    lines = F.when(k == 0, kinds[0])
    for n, x in enumerate(kinds[1:], 1):
        lines = lines.when(k == n, x)
    return s.select("doc_id", F.posexplode(lines).alias("k", "line")).select((F.col("doc_id") * 10 + F.col("k")).alias("at"), "line")


@query(f"WITH {_SOURCES}, {_LINES}, {_HIT} SELECT s.doc_id AS id, f.line, coalesce(nullif(trim(replace(rtrim(trim(split_part(f.line, '`', 1)), '|'), '*', '')), ''), upper(s.id[1]) || s.part[2:]) AS title FROM s LEFT JOIN f USING (doc_id)")
def j10_bibliography_lookup(spark, sf_dir):
    """Each source's line of the bibliography, rows of its table before prose, and the title that it gives, else one made of the file's name."""
    s = sources(spark, sf_dir)
    found = B.lookup(s, rows(spark, sf_dir))
    return found.join(s.select("doc_id", "id"), "id").select(F.col("doc_id").alias("id"), "line", B.source_title(F.col("id"), F.col("line")).alias("title"))


@query(f"WITH {_SOURCES}, {_LINES}, {_HIT}, t AS (SELECT string_agg(lower(line), E'\\n') AS all_ FROM b) SELECT s.doc_id AS id FROM s LEFT JOIN f USING (doc_id), t WHERE f.line IS NULL AND NOT contains(all_, s.part) AND NOT (regexp_full_match(s.lang, '[a-z]{{3,}}') AND contains(all_, s.lang))")
def j11_bibliography_coverage(spark, sf_dir):
    """Sources that the bibliography neither names nor mentions by a part of their name."""
    s = sources(spark, sf_dir)
    return B.uncovered(s, rows(spark, sf_dir)).join(s.select("doc_id", "id"), "id").select(F.col("doc_id").alias("id"))


@query(f"WITH {_SOURCES}, {_LINES}, {_HIT} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN upper(line) ELSE line || ' old' END AS copied, line AS live FROM f WHERE doc_id % 3 > 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0) AND CASE WHEN doc_id % 5 = 0 THEN upper(line) ELSE line || ' old' END <> line")
def j12_bibliography_mirror(spark, sf_dir):
    """Cards whose copy of their bibliography line isn't the line as it is; a third of the cards carry none."""
    s, r = sources(spark, sf_dir), rows(spark, sf_dir)
    d = F.col("doc_id")
    copy = F.when(d % 5 == 0, F.upper("line")).when(d % 7 == 0, F.concat("line", F.lit(" old"))).otherwise(F.col("line"))
    cards = B.lookup(s, r).join(s.select("doc_id", "id"), "id").select("id", F.when((d % 3 > 0) & F.col("line").isNotNull(), F.concat(F.lit("# T\n**Bibliography.** "), copy, F.lit("\n\nbody"))).otherwise("# T").alias("card"))
    return B.outdated(cards, r).join(s.select("doc_id", "id"), "id").select(F.col("doc_id").alias("id"), "copied", "live")
