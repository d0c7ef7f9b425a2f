"""Extraction, normalisation, entailment adapters, streaming ingest and event windows."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import normalize, runs
from quoin.operators.entailment import entailed, overlap
from quoin.plans.registry import query
from quoin.plans.text_queries import HEAD_SQL, NOISE_SQL, NUMBER_SQL, ROMAN_SQL, TABLE_SQL, WS, docs, odd_lines
from quoin.runtime import scratch, spread, table
from quoin.sources import formats, library
from quoin.streaming import ingest, transactions


_TAGS = "|".join(sorted(formats.BREAKS))


def _entities_sql(x: str) -> str:
    """Entities as HTML reads them: those of old names also without their semicolon, as where a text was cut; the ampersand last."""
    for name, c in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{c}', 'g')"
    return x


@query(f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<head>.*</head>|<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<![^>]*>', '', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?({_TAGS})(\\s[^>]*)?/?>', E'\\n', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
  c AS (SELECT page_id, {_entities_sql('t')} AS t FROM b), d AS (SELECT page_id, trim(regexp_replace(array_to_string(list_transform(string_split(t, E'\\n'), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), E'\\n'), '\\n{{3,}}', E'\\n\\n', 'g'), E'\\n') AS t FROM c)
  SELECT page_id, 'html' AS format, length(t)::INT AS chars, sha256(t) AS text_sha, NULL::VARCHAR AS error FROM d""")
def s15_html_text(spark, sf_dir):
    """Visible text of each page."""
    pages = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    out = formats.extract(pages)
    return out.select(F.col("path").cast("long").alias("page_id"), "format", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha"), "error")


@query()
def f22_normalize(spark, sf_dir):
    """The whole normalisation of documents with page furniture, wrapped at sentences."""
    lines = odd_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    wrapped = lines.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))
    return normalize.changed(wrapped).select("doc_id", F.length("normal").alias("chars"), F.sha2("normal", 256).alias("normal_sha"))


@query()
def r25_entail_stub(spark, sf_dir):
    """Support of each card's claims by the windows of its source, by a stand-in backend; a card for each document, with anchors in its first, middle and last sentences and a pattern."""
    s, n = T.sentences(F.col("text")), F.size("s")
    words = lambda i: F.split(F.element_at("s", i.cast("int")), " ")
    half = lambda w: F.ceil(F.size(w) / 2).cast("int")

    def line(i):
        """The first half of the sentence that the anchor is in, and the second half of one that is half a text away."""
        own, other = words(i), words((i + F.floor(n / 2)) % n + 1)
        claim = F.concat_ws(" ", F.slice(own, F.lit(1), half(own)), F.regexp_replace(F.array_join(F.slice(other, half(other), F.size(other)), " "), r"[.!?]+$", ""))
        return F.concat(claim, F.lit(" (grep: `"), F.regexp_replace(F.array_join(F.slice(own, 1, 3), " "), "[`)]", ""), F.lit("`)."))

    spots = F.array_distinct(F.array(F.lit(1), F.ceil(n / 2), n.cast("long")))
    body = F.concat(F.array_join(F.transform(spots, line), " "), F.lit(" A pattern (grep-re: `.+`)."))
    rows = entailed(docs(spark, sf_dir).withColumn("s", s).select(F.col("doc_id").alias("id"), body.alias("body"), "text"), overlap)
    return rows.select(F.col("id").alias("doc_id"), "ord", "phrase", F.round("support", 6).alias("support"))


@query("SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents WHERE trim(text) <> '' GROUP BY text")
def s24_stream_ingest(spark, sf_dir):
    """Documents as a stream of files into a table, each text once; the log as it then is."""
    at = scratch(spark, "stream")
    source = table(spark, sf_dir, "documents")
    source.repartition(4, "doc_id").write.parquet(f"{at}/drop")
    ingest.ingest(ingest.arrivals(spark, f"{at}/drop", source.schema, 2), f"{at}/sources", f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log").select("sha256", F.col("size").cast("long").alias("size"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Beyond the reference: hourly windows of events."""
    return ingest.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(f"""WITH t AS (SELECT DISTINCT sha256(text) AS digest, text FROM documents WHERE text IS NOT NULL), l AS (SELECT digest, trim(regexp_replace(unnest(string_split(text, E'\\n')), '^{WS}|{WS}$', '', 'g')) AS s FROM t), n AS (SELECT *, count(*) OVER (PARTITION BY digest, s) AS times FROM l),
  k AS (SELECT digest, bool_or(s <> '' AND ({TABLE_SQL} OR NOT ({NUMBER_SQL} OR {ROMAN_SQL} OR {NOISE_SQL} OR ({HEAD_SQL} AND times >= 5)))) AS kept FROM n GROUP BY digest)
  SELECT digest, CASE WHEN kept THEN 'accepted' ELSE 'refused' END AS state, 1::BIGINT AS times FROM k""")
def s24_ingest_transactions(spark, sf_dir):
    """Documents as files in a stream that stops in its second batch, between two of its tables, and is started again: what is committed in the end, each content once. A text of which normalisation leaves no line is refused."""
    at = scratch(spark, "files")
    made = docs(spark, sf_dir).where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    n = library.write_files(made, f"{at}/drop")

    def stop(table: str, number: int) -> None:
        if (table, number) == ("sources", 1):
            raise RuntimeError("stopped between two tables")

    start = lambda hook: transactions.ingest(transactions.arrivals(spark, f"{at}/drop", -(-n // 3)), f"{at}/to", f"{at}/checkpoint", "one", between=hook)
    try:
        start(stop).awaitTermination()
    except StreamingQueryException:
        pass
    told = transactions.committed(spark, f"{at}/to", "sources").select("batch").unionAll(transactions.committed(spark, f"{at}/to", "refused").select("batch"))  # the first batch may have either alone
    if n and [r["batch"] for r in told.distinct().collect()] != [0]:
        raise AssertionError("a batch without its marker is read")
    start(None).awaitTermination()
    good = transactions.committed(spark, f"{at}/to", "sources").select("source_sha256").join(transactions.committed(spark, f"{at}/to", "provenance").select("source_sha256"), "source_sha256").withColumn("state", F.lit("accepted"))
    rows = good.unionAll(transactions.committed(spark, f"{at}/to", "refused").select("source_sha256", F.lit("refused")))
    return rows.groupBy(F.col("source_sha256").alias("digest"), "state").agg(F.count("*").alias("times"))


@query("SELECT doc_id AS doc, tier, length(CASE tier WHEN 'whole' THEN text ELSE split_part(text, E'\\n', 1) END)::INT AS value FROM documents, (VALUES ('line'), ('whole')) t(tier) WHERE text IS NOT NULL")
def r22_resumed_run(spark, sf_dir):
    """A measuring run cut in two, whose second part measures what the first has left; under other settings its folder is refused."""
    at = scratch(spark, "run")
    rows = docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("line"), F.lit("whole"))).alias("tier"), F.sha2("text", 256).alias("digest"), "text")
    measure = lambda left: left.select("doc", "tier", F.length(F.when(F.col("tier") == "whole", F.col("text")).otherwise(F.substring_index("text", "\n", 1))).alias("value"))
    some = rows.where("doc % 3 > 0").count()
    if runs.resume(rows, at, {"window": 400}, measure, some).count() != some:
        raise AssertionError("the first part measured more or less than it was asked for")
    try:
        runs.resume(rows, at, {"window": 500}, measure)
        raise AssertionError("another manifest is taken")
    except runs.ManifestError:
        return runs.resume(rows, at, {"window": 400}, measure)
