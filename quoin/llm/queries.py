"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe, codes, fingerprints, knn, langid, licenses, neardup, ngram_join, packing, reassembly, substring, token_counts, warc
from quoin.runtime import ship, spread, table

WORD_BPE, BYTE_BPE, MULTI_BPE, PATTERN = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; those of one small file go over all cores."""
    return spread(table(spark, sf_dir, "documents"), 24 << 20)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.near_duplicates(documents(spark, sf_dir), k=4, percent=80).drop("key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode(documents(spark, sf_dir), MULTI_BPE, PATTERN, keep=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document, counted in the encoding of the whole text."""
    ship(spark)
    return token_counts.token_counts(documents(spark, sf_dir), ["text"], BYTE_BPE, PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept text and what was removed from it."""
    ship(spark)
    done = substring.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_units", F.size("removed").alias("n_removed"), length.alias("removed_chars"), "removed", "text")


def op7_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.languages(documents(spark, sf_dir)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(packing.pieces(documents(spark, sf_dir), WORD_BPE, 2048), 2048)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.licenses(documents(spark, sf_dir))


def op11_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return reassembly.digests(reassembly.reassembled(table(spark, sf_dir, "conversations")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return codes.compressed(table(spark, sf_dir, "embeddings"))


_ALL = (op1_fingerprints, op2_minhash, op3_warc, op4_bpe, op5_token_counts, op6_substring_dedup, op7_knn, op8_language, op9_packing, op10_licenses, op11_reassembly, op12_ngram_join, op13_vector_codes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: Links by counting shared shingles of all pairs, and their transitive closure.
_LINKED = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= PERCENT * (x.n + y.n - c)), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id"""
_NEAR_SQL = _LINKED.replace("PERCENT", "80").replace("m AS component_id", "m AS component_id, m = d.doc_id AS kept")
#: All pairs of a query and a row.
_KNN_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""


def _codes_sql() -> str:
    """Rounds of assigning and moving, each a pair of tables of (part, entry)."""
    far = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))"
    near = lambda r: f"n{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS m FROM (SELECT vec_id, p.part, entry, {far} AS d FROM p JOIN b{r} b ON b.part = p.part) GROUP BY 1, 2)"
    moved = lambda r: f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(x.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY i) AS e FROM
      (SELECT part, entry, i, sum(v)::DOUBLE AS total, count(*) AS n FROM (SELECT part, m.entry AS entry, unnest(v) AS v, unnest(range(len(v))) AS i FROM n{r} JOIN p USING (vec_id, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) x ON x.part = b.part AND x.entry = b.entry)"""  # noqa: E731
    rounds = ", ".join(f"{near(r)}, {moved(r)}" for r in range(6))
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS v FROM k, range(8) t(part)),
      b0 AS (SELECT part, entry, v AS e FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16) USING (vec_id)), {rounds}, {near(6)},
      c AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM n6 GROUP BY 1),
      h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS s FROM b6)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


ORACLE: dict[str, str] = {"op2_minhash": _NEAR_SQL, "op7_knn": _KNN_SQL, "op12_ngram_join": _LINKED.replace("PERCENT", "85"), "op13_vector_codes": _codes_sql()}
