"""Every registered query on odd and on empty tables, and on the smallest scale against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quoin.llm import queries

PAGES, VECTORS = "page_id long, url string, html string", "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd_tables(spark, odd_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs = odd_docs.withColumnRenamed("n.x", "text2").withColumn("component_id", F.lit("c")).withColumn("lang_pred", F.lit("l")).withColumn("sequence_id", F.lit(1)).withColumn("its key", F.lit(2))
    docs.write.parquet(f"{at}/documents.parquet")
    pages = [(1, "u", "<p>x</p>"), (2, None, None), (2, "u", ""), (3, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (4, "u", "é" * 70_000)]
    spark.createDataFrame(pages, PAGES).withColumn("payload", F.lit("p")).withColumn("record_type", F.lit("r")).write.parquet(f"{at}/pages.parquet")
    vectors = [(0, [0.5, -0.25], 1), (0, [0.5, -0.25], 1), (50, None, 1), (1, [0.25], None), (2, [], 1), (None, [1.0, 1.0], 1), (100, [float("nan"), 1.0], 1), (3, [0.5, -0.25], 1)]
    spark.createDataFrame(vectors, VECTORS).withColumn("grp", F.lit(1)).withColumn("score", F.lit(1)).write.parquet(f"{at}/embeddings.parquet")
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "b"), (2, None, "user", "c"), (3, 7, "assistant", "d" * 70_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("event", F.lit("e")).withColumn("payload", F.lit(1)).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty_tables(spark, odd_tables, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{odd_tables}/{t}.parquet").where("false").coalesce(1).write.parquet(f"{at}/{t}.parquet")
    return str(at)


OF_DOCUMENTS = ["op1_fingerprints", "op2_minhash", "op4_bpe", "op6_substring_dedup", "op8_language", "op10_licenses", "op12_ngram_join"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_on_odd_and_empty_tables(spark, odd_tables, empty_tables, name):
    got = queries.QUERIES[name](spark, odd_tables)
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    rows = got.collect()
    ids = sorted(str(r["doc_id"]) for r in spark.read.parquet(f"{odd_tables}/documents.parquet").select("doc_id").collect())
    if name in OF_DOCUMENTS:
        assert sorted(str(r["doc_id"]) for r in rows) == ids
    elif name == "op9_packing":
        assert set(str(r["doc_id"]) for r in rows) == set(ids) and sum(r["piece"] == 0 for r in rows) == len(ids)
    elif name == "op3_warc":
        assert len(rows) == 6 and {r["page_id"]: r["record_type"] for r in rows if r["page_id"] == 3} == {3: "revisit"}
    elif name == "op7_knn":
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == {(0, 1, 3, 128 * 128 + 64 * 64), (0, 2, 1, 128 * 64), (0, 3, 2, 0)}
    elif name == "op11_reassembly":
        assert {r["conv_id"] for r in rows if r["event"] == "close"} == {1, 3, None}
    elif name == "op13_vector_codes":
        assert sorted(str(r["vec_id"]) for r in rows) == ["0", "0", "1", "2", "3", "None"]
    else:
        assert rows
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd_tables, empty_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, odd_tables)
        assert done.columns == docs.columns, name
        assert 0 < done.count() <= docs.count()
    assert corpus_pipeline.run(spark, odd_tables).count() > 0 and corpus_pipeline.run(spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cur.fetchall())) and sorted(got.columns) == sorted(names)
