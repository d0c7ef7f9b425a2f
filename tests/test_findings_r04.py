"""Queries against their SQL on small tables of the rows in which they differed, and what large tables need."""

import math
import os
import uuid

import duckdb

from pyspark.sql import functions as F

from quoin.plans import catalog

SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string"}


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


def differ(spark, at, name, **tables):
    """What only the query and only its SQL give for tables of these rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[table]).coalesce(1).write.parquet(f"{at}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(at))
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert got
    return [r for r in got if r not in want], [r for r in want if r not in got]


def texts(*rows):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(rows, 1)]


ODD = ["", None, "\n", " \t\n", "\x00", "\x01\x02\x03 a", "PK\x03\x04 a", "%PDF", "%PDF-1.7", " %PDF-1.7", "﻿<html>", "\r<html>", " \r\n<!doctype html>", "\t<HTML lang=de>", "<?xml version", "<!DOCTYPE  html>", " " * 512 + "<html>", "é" * 300 + "<html>", "\xff\xfe", "plain"]


def test_texts_of_no_mark_are_txt(spark, tmp_path):
    pages = [(i, "u", t) for i, t in enumerate(ODD * 5, 1)]
    assert differ(spark, tmp_path, "s13_sniff_format", documents=texts(*ODD * 7), pages=pages) == ([], [])


def test_empty_blocks_are_empty_lines(spark, tmp_path):
    rows = [(i, t, *x, 0) for i, (t, x) in enumerate([(t, x) for t in [*ODD, "\nsecond", "a\"\\\u2028b", "\r\n", "  \nb"] for x in [("en", "src0"), ("", ""), (None, "src0"), ("en", None)]], 1)]
    assert differ(spark, tmp_path, "s21_layout_pages", documents=rows) == ([], [])


def test_blocks_without_text_are_left_out_unless_asked_for(spark):
    from quoin.sources import library

    js = '{"texts": [{"text": "", "prov": [{"page_no": 1}]}, {"text": "a", "prov": [{"page_no": 1}]}], "pictures": [{"prov": [{"page_no": 1}, {"page_no": 2}]}], "tables": [{"text": "b", "prov": [{"page_no": 3}]}, {"text": "", "prov": [{"page_no": 3}]}]}'
    rows = spark.createDataFrame([(1, js)], "id int, json string")
    told = lambda **x: [tuple(r)[1:] for r in library.docling_pages(rows, **x).orderBy("page").collect()]
    assert told() == [(1, "a"), (2, ""), (3, "b")]
    assert told(every=True) == [(1, None), (2, None), (3, "b\n")]
    long = rows.select("id", F.regexp_replace("json", '"a"', F.concat(F.lit('"'), F.repeat(F.lit("xy"), 10_000_001), F.lit('"'))).alias("json"))
    assert [(r["page"], r["n"]) for r in library.docling_pages(long).select("page", F.length("text").alias("n")).orderBy("page").collect()] == [(1, 20_000_002), (2, 0), (3, 1)]


def test_what_arrives_is_read_once(spark, tmp_path):
    """Paths that are others whenever they are read, as a stream's may be where it meets one content several times."""
    from quoin.streaming import transactions

    again = F.udf(lambda p: f"{p}-{uuid.uuid4()}").asNondeterministic()
    files = spark.range(20).select(again(F.col("id").cast("string")).alias("path"), F.encode(F.concat(F.lit("some words "), "id"), "UTF-8").alias("content"))
    assert transactions.judged(files).select("source_sha256").distinct().count() == 20
    (tmp_path / "drop").mkdir()
    for i in range(20):
        (tmp_path / "drop" / f"{i}.txt").write_text(f"Some words of text {i % 15}." if i else " ")
    controls = spark.createDataFrame([("x", "other words", None)], "path string, control string, declared int")
    stream = transactions.arrivals(spark, str(tmp_path / "drop")).withColumn("path", again("path"))
    to = str(tmp_path / "to")
    transactions.ingest(stream, to, str(tmp_path / "checkpoint"), "r", controls=controls).awaitTermination()
    n = {t: transactions.committed(spark, to, t).select("path").distinct().count() for t in transactions.TABLES}
    assert n == {"sources": 15, "provenance": 15, "refused": 1}
    both = [transactions.committed(spark, to, t).select("path", "source_sha256") for t in ("sources", "provenance")]
    assert both[0].exceptAll(both[1]).isEmpty()
    assert transactions.rollback(spark, to) == [] and not [*(tmp_path / "to").glob("staged/*/*")]


def test_pages_are_measured_where_they_are(spark, tmp_path):
    from quoin.operators import services as S

    words = ["a b c d e f", "a b c d e f f a", "x x y x", "", None, "one two- three Maß mass", "d c b a", "a"]
    rows = [(i, j, s, e) for i, s in enumerate(words) for j, e in enumerate(words)]
    found = S.page_recall(spark.createDataFrame(rows, "doc long, page long, shown string, extracted string"), 3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

    def tokens(t):
        return (t or "").replace("- ", "").lower().replace("ß", "ss").split()

    def want(shown, extracted):
        if extracted is None:
            return None, None, "no text of this page"
        s, e = tokens(shown), tokens(extracted)
        own = [w for w in s if s.count(w) == e.count(w) == 1]
        there, n = [w for w in e if w in own], len(own)
        order = 1 - 6 * sum((own.index(w) - there.index(w)) ** 2 for w in own) / (n * (n * n - 1)) if n >= 3 else None
        return sum(min(s.count(w), e.count(w)) for w in set(s)) / len(s) if s else None, order, None

    got = {(r["doc"], r["page"]): (r["recall"], r["order"], r["error"]) for r in found.collect()}
    assert got == {(i, j): want(s, e) for i, j, s, e in rows}
    lines = texts(*ODD, "\n".join(w or "" for w in words), "ein Satz, der läuft. " * 3000)
    assert differ(spark, tmp_path, "a8_page_recall", documents=lines) == ([], [])


def test_the_driver_meets_lists_of_arriving_files(spark, tmp_path):
    from quoin.streaming import transactions

    drop = tmp_path / "drop [1]"
    drop.mkdir()
    names = [f"{i} %41+é.txt" for i in range(10)]
    for i, name in enumerate(names):
        (drop / name).write_text(f"text {i}")
        os.utime(drop / name, (1000 - i, 1000 - i))
    for name in ("_hidden", ".hidden"):
        (drop / name).write_text("x")
    (drop / "sub").mkdir()
    seen = []

    def run(files):
        stream = transactions.arrivals(spark, str(drop), files)
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "binaryFile" not in plan and "_arrived" in plan and "Deduplicate [digest#" in plan and "bytes" not in plan.split("Deduplicate")[1].splitlines()[1].split("sha2")[0]
        seen.append([])
        stream.writeStream.foreachBatch(lambda rows, _: seen[-1].append(sorted((r["path"], r["content"]) for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return [len(b) for b in seen[-1]]

    assert run(4) == [4, 4, 2] and run(4) == []
    assert sorted(x for b in seen[0] for x in b) == sorted((f"file:{drop}/{n}", f"text {i}".encode()) for i, n in enumerate(names))
    assert {p for p, _ in seen[0][2]} == {f"file:{drop}/{n}" for n in names[:2]}  # the youngest
    (drop / "again.txt").write_text("text 3")
    (drop / "new.txt").write_text("new")
    assert run(20_003) == [1] and seen[-1] == [[(f"file:{drop}/new.txt", b"new")]]


def test_no_documents_are_no_files(spark, tmp_path):
    spark.createDataFrame([(1, None, "en", "s", 0)], SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["s24_ingest_transactions"](spark, str(tmp_path)).count() == 0


def test_a_first_batch_may_be_refused_as_a_whole(spark, tmp_path):
    assert differ(spark, tmp_path, "s24_ingest_transactions", documents=texts("12", "...", " ", "xiv", "", "7")) == ([], [])
