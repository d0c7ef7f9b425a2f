"""Search, evidence, diagnosis and retrieval metrics over documents as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import evaluation, retrieval, search_index
from quoin.operators.grounding import phrase_hits
from quoin.plans.registry import query
from quoin.plans.text_queries import TERMS_SQL, docs
from quoin.runtime import scratch, table

TERMS = ("the", "tion", "reau")


def blobs(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    """Searchable text of each document: id, first line and language, and on demand all of it."""
    parts = [F.col("doc_id").cast("string"), F.substring_index("text", "\n", 1), F.col("lang")]
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lower(F.concat_ws(" ", *parts, *([F.col("text")] if full else []))).alias("blob"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, list(TERMS))], "question int, terms array<string>")


def _blob_sql(full: bool) -> str:
    return f"SELECT doc_id AS id, lower(doc_id || ' ' || split_part(text, E'\\n', 1) || ' ' || lang{' || chr(32) || text' if full else ''}) AS blob FROM documents"


def _bm25_sql(blob: str, questions: str) -> str:
    """questions: (question, term)"""
    return f"""b AS ({blob}), s AS (SELECT id, blob, greatest(len(list_filter(string_split(regexp_replace(blob, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')), 1) AS dl FROM b),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s), q AS ({questions}), t AS (SELECT DISTINCT term FROM q),
  h AS (SELECT id, dl, term, (length(blob) - length(replace(blob, term, ''))) // length(term) AS tf FROM s, t WHERE contains(blob, term)),
  w AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM h, st GROUP BY term, n, avgdl),
  r AS (SELECT question, id, sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN w USING (term) JOIN q USING (term) GROUP BY question, id)"""


_ASKED = "SELECT 0 AS question, unnest(['the', 'tion', 'reau']) AS term"
_TOP = "SELECT id, round(score, 6) AS score, total FROM (SELECT id, score, count(*) OVER () AS total, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r) WHERE rank <= 20"


def _search(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    scored = retrieval.bm25(blobs(spark, sf_dir, full), asked(spark))
    best, total = retrieval.best_with_total(scored, 20)
    return best.select("id", F.round("score", 6).alias("score"), F.lit(total).alias("total"))


@query(f"WITH {_bm25_sql(_blob_sql(False), _ASKED)} {_TOP}")
def r1_bm25_search(spark, sf_dir):
    """The 20 best cards for three terms, and how many match."""
    return _search(spark, sf_dir, False)


@query(f"WITH {_bm25_sql(_blob_sql(True), _ASKED)} {_TOP}")
def r1_bm25_fulltext(spark, sf_dir):
    return _search(spark, sf_dir, True)


@query(f"WITH {_bm25_sql(_blob_sql(True), _ASKED)} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM h, st GROUP BY term, n, avgdl")
def a1_corpus_stats(spark, sf_dir):
    b = blobs(spark, sf_dir, True).withColumn("dl", F.greatest(F.size(T.split_words(F.col("blob"))), F.lit(1)))
    hits = b.select("dl", *[T.count_of(F.lit(t), F.col("blob")).alias(t) for t in TERMS])
    one = hits.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), *[x for t in TERMS for x in (F.count_if(F.col(t) > 0).alias(f"df_{t}"), F.sum(t).alias(f"tf_{t}"))])
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df_{t}").alias("df"), F.col(f"tf_{t}").alias("tf")) for t in TERMS])
    return one.select(F.explode(rows).alias("x"), "n", "avgdl").select("x.*", "n", "avgdl").where("df > 0")


@query(f"""WITH {_bm25_sql(_blob_sql(False), _ASKED)}, k AS (SELECT kb, greatest(n - 10, 0)::INT AS truncated FROM (SELECT source AS kb, dense_rank() OVER (ORDER BY source) AS k, (SELECT count(DISTINCT source) FROM documents) AS n FROM documents GROUP BY source) WHERE k <= 10)
  SELECT kb, id, rank, round(score, 6) AS score, truncated FROM (SELECT kb, r.id, r.score, truncated, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, r.id) AS rank FROM r JOIN documents d ON d.doc_id = r.id JOIN k ON k.kb = d.source) WHERE rank <= 5""")
def k5_fanout_topk(spark, sf_dir):
    """The five best cards of each of the first ten knowledge bases, and how many bases are left out. One job; the bases are a partition column."""
    kbs = docs(spark, sf_dir).select(F.col("source").alias("kb")).distinct()
    n = kbs.agg(F.count("*").alias("n"))
    first = kbs.orderBy("kb").limit(10).crossJoin(F.broadcast(n)).select("kb", F.greatest(F.col("n") - 10, F.lit(0)).cast("int").alias("truncated"))
    owners = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("kb")).join(F.broadcast(first), "kb")
    scored = retrieval.bm25(blobs(spark, sf_dir, False), asked(spark)).join(owners, "id")
    return retrieval.top_k(scored, 5, "kb").select("kb", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "truncated")


BLOCKS_SQL = """blk AS (SELECT id, min(ln) AS start, max(ln) AS "end", string_agg(line, E'\\n' ORDER BY ln) AS text FROM (
  SELECT id, ln, line, para, (row_number() OVER (PARTITION BY id, para ORDER BY ln) - 1) // 8 AS piece FROM (
    SELECT *, sum((trim(line, E' \\t') = '')::INT) OVER (PARTITION BY id ORDER BY ln) AS para FROM (SELECT doc_id AS id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, string_split(t, E'\\n') AS l FROM (%s)))))
  WHERE trim(line, E' \\t') <> '') GROUP BY id, para, piece)"""
_SPACED_SQL = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '\\. ', E'.\\n\\n', 'g') ELSE text END AS t FROM documents"


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines between the sentences of every other one, as theirs have none."""
    return docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text")))


@query(f"""WITH {BLOCKS_SQL % _SPACED_SQL} SELECT id, start, "end", sha256(text) AS text_sha FROM blk""")
def w3_source_blocks(spark, sf_dir):
    b = retrieval.blocks(spaced(spark, sf_dir))
    return b.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("text", 256).alias("text_sha"))


_SCORE = """CASE WHEN m < 2 THEN 0.0 ELSE m / 3.0 * 10 + f END"""
_COUNTS = """SELECT *, ((c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT) AS m, least(c1, 3) + least(c2, 3) + least(c3, 3) AS f FROM (SELECT *, (length(b) - length(replace(b, 'tion', ''))) // 4 AS c1, (length(b) - length(replace(b, 'ende', ''))) // 4 AS c2, (length(b) - length(replace(b, 'reau', ''))) // 4 AS c3
  FROM (SELECT *, lower(regexp_replace(trim(text, E' \\n\\t'), '\\s+', ' ', 'g')) AS b FROM %s))"""
QUESTION = "tion ende reau"


@query(f"""SELECT id, round({_SCORE}, 6)::DOUBLE AS score FROM ({_COUNTS % "(SELECT doc_id AS id, text FROM documents)"})""")
def f12_passage_score(spark, sf_dir):
    terms = F.array(*map(F.lit, QUESTION.split()))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.round(retrieval.passage_score(F.col("text"), terms), 6).alias("score"))


@query(f"""WITH {BLOCKS_SQL % _SPACED_SQL} SELECT id, rank, start, "end", round(score, 6)::DOUBLE AS score, sha256(text) AS excerpt_sha FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start) AS rank FROM (SELECT *, {_SCORE} AS score FROM ({_COUNTS % "blk"})) WHERE score > 0) WHERE rank <= 5 AND length(text) <= 2000
  UNION ALL SELECT id, rank, start, "end", round(score, 6)::DOUBLE, sha256(CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '…' ELSE '' END) FROM (
    SELECT *, greatest(0, hi - 2000) AS lo FROM (SELECT *, least(length(text), greatest(0, c - 666) + 2000) AS hi FROM (SELECT *, list_min(list_filter([instr(lower(text), 'tion'), instr(lower(text), 'ende'), instr(lower(text), 'reau')], lambda p: p > 0)) - 1 AS c, row_number() OVER (PARTITION BY id ORDER BY score DESC, start) AS rank FROM (SELECT *, {_SCORE} AS score FROM ({_COUNTS % "blk"})) WHERE score > 0))) WHERE rank <= 5 AND length(text) > 2000""")
def r6b_evidence_topk(spark, sf_dir):
    e = retrieval.evidence(spaced(spark, sf_dir), QUESTION, 5)
    return e.select("id", F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 6).alias("score"), F.sha2("excerpt", 256).alias("excerpt_sha"))


CUES = [(0, ["the", "tion"], ["pacing", "Story Arc"]), (1, ["th", "and"], ["cadence", "pacing"]), (2, ["é", "der"], ["voice"]), (3, ["that", "in", "of"], ["voice", "tension"])]


@query("""WITH m(ord, cues, dims) AS (VALUES (0, ['the', 'tion'], ['pacing', 'story-arc']), (1, ['th', 'and'], ['cadence', 'pacing']), (2, ['é', 'der'], ['voice']), (3, ['that', 'in', 'of'], ['voice', 'tension'])),
  s AS (SELECT item_id, ord, dims, len(list_filter(cues, lambda c: CASE WHEN regexp_matches(c, '[a-z0-9]') THEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || c || '($|[^\\p{L}\\p{N}_])') ELSE contains(lower(text), c) END)) AS score FROM benchmark, m),
  d AS (SELECT item_id, score, ord, unnest(dims) AS dimension, generate_subscripts(dims, 1) AS place FROM s WHERE score > 0)
  SELECT item_id AS symptom_id, dimension, row_number() OVER (PARTITION BY item_id ORDER BY best) AS rank FROM (SELECT item_id, dimension, min((-score, ord, place)) AS best FROM d GROUP BY item_id, dimension)""")
def r8_diagnose(spark, sf_dir):
    symptoms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("symptom_id"), F.col("text").alias("symptom"))
    found = retrieval.diagnose(symptoms, spark.createDataFrame(CUES, "ord int, cues array<string>, dims array<string>"))
    return found.select("symptom_id", "dimension", F.col("rank").cast("long").alias("rank"))


NAMES = [(0, "card 7"), (1, "part"), (2, "the"), (3, "Thedly onndst"), (4, "card 1"), (5, "zzz"), (6, "The tion and ing")]


def lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source lens for each document, and two dimensions of one family."""
    sources = docs(spark, sf_dir).select(F.lit("source").alias("kind"), F.concat(F.lit("card-"), F.col("doc_id").cast("string")).alias("name"), F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("aliases"))
    return sources.unionAll(spark.createDataFrame([("dimension", "part-who", "", None), ("dimension", "part-what", "", None)], "kind string, name string, title string, aliases string"))


@query("""WITH q(query_id, name) AS (VALUES (0, 'card 7'), (1, 'part'), (2, 'the'), (3, 'Thedly onndst'), (4, 'card 1'), (5, 'zzz'), (6, 'The tion and ing')),
  a AS (SELECT query_id, replace(lower(trim(name)), ' ', '-') AS stem, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'a', 'an', 'and', 'to', 'in', 'on', 'for', 'by', '&')) AS toks FROM q),
  l AS (SELECT 'source' AS kind, 'card-' || doc_id AS name, lower('card-' || doc_id || ' ' || split_part(text, E'\\n', 1) || ' ' || lang) AS hay FROM documents UNION ALL VALUES ('dimension', 'part-who', 'part-who'), ('dimension', 'part-what', 'part-what')),
  p AS (SELECT query_id, kind, name, name = stem AS exact, kind = 'dimension' AND starts_with(name, stem || '-') AS family, kind = 'dimension' AND contains(name, stem) AS inside, len(toks) AS need, len(list_filter(toks, lambda t: regexp_matches(hay, '(^|[^\\p{L}\\p{N}_])' || t || '($|[^\\p{L}\\p{N}_])'))) AS words FROM l, a),
  n AS (SELECT query_id, bool_or(exact) AS e, sum(family::INT) AS f, sum((kind <> 'dimension' AND words = need AND need > 0)::INT) AS u FROM p GROUP BY query_id),
  s AS (SELECT *, CASE WHEN e OR f = 1 THEN 'exact' WHEN f > 1 OR u > 1 THEN 'ambiguous' WHEN u = 1 THEN 'unique' ELSE 'none' END AS status FROM n),
  m AS (SELECT p.*, s.status, s.f, s.u, CASE WHEN s.e THEN p.exact WHEN s.f > 0 THEN p.family WHEN s.u > 0 THEN p.kind <> 'dimension' AND p.words = p.need ELSE p.kind <> 'dimension' AND p.words > 0 END AS member FROM p JOIN s USING (query_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, name) AS rank FROM m WHERE member)
  SELECT s.query_id, s.status, r.rank, r.name FROM s LEFT JOIN (SELECT * FROM r WHERE rank <= CASE WHEN status = 'exact' THEN 1 WHEN status = 'ambiguous' AND f = 0 THEN 8 WHEN status = 'none' THEN 5 ELSE 1000000 END) r USING (query_id)""")
def r7_consult_resolve(spark, sf_dir):
    """Which lenses a name may mean, in order."""
    found = retrieval.consult(spark.createDataFrame(NAMES, "query_id int, name string"), lenses(spark, sf_dir))
    return found.select("query_id", "status", F.col("rank").cast("long").alias("rank"), "name")


_GOLD = f"SELECT item_id AS question, word AS term FROM {TERMS_SQL} WHERE n <= 4"


_MEANS = """, g AS (SELECT item_id AS question, doc_id AS id FROM benchmark b, documents d WHERE contains(d.text, b.text)), gn AS (SELECT question, count(*) AS n FROM g GROUP BY question),
  k AS (SELECT r.question, r.id, row_number() OVER (PARTITION BY r.question ORDER BY round(score, 9) DESC, r.id) AS rank, g.id IS NOT NULL AS rel FROM r LEFT JOIN g USING (question, id)),
  m AS (SELECT gn.question, gn.n, coalesce(sum((rel AND rank <= 5)::INT), 0) / 5.0 AS p5, coalesce(sum((rel AND rank <= 10)::INT), 0) / gn.n AS r10, coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0) AS mrr, coalesce(sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM gn LEFT JOIN k USING (question) GROUP BY gn.question, gn.n)
  SELECT count(*)::BIGINT AS questions, round(avg(p5), 6) AS p5, round(avg(r10), 6) AS r10, round(avg(mrr), 6) AS mrr, round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n)), 6) AS ndcg10 FROM m"""


@query(f"WITH {_bm25_sql(_blob_sql(True), _GOLD)}{_MEANS}")
def a11_retrieval_metrics(spark, sf_dir):
    """Each benchmark passage asks with its first four terms; the documents that hold it are relevant."""
    questions, gold = _gold(spark, sf_dir)
    return evaluation.retrieval_means(retrieval.bm25(blobs(spark, sf_dir, True), questions), gold)


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    questions = items.select("question", F.slice(T.terms(F.col("text")), 1, 4).alias("terms"))
    gold = phrase_hits(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), items.select(F.col("question").alias("phrase_id"), F.col("text").alias("phrase")))
    return questions, gold.select(F.col("phrase_id").alias("question"), "id")


@query("WITH " + _bm25_sql(_blob_sql(True), _GOLD).replace("sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))", "sum(tf)") + _MEANS)
def r20_raw_count_arm(spark, sf_dir):
    """The same questions ranked by raw counts, which BM25 is held against."""
    questions, gold = _gold(spark, sf_dir)
    return evaluation.retrieval_means(evaluation.count_scores(blobs(spark, sf_dir, True), questions), gold)


_INDEXED: dict[tuple, search_index.Index] = {}


def indexed(spark: SparkSession, sf_dir: str) -> search_index.Index:
    """The index of all documents, built once a session in three segments: the third replaces texts of the first by what they are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED or len(_INDEXED[key].segments()) < 3:
        own, b = search_index.Index(spark, scratch(spark, "index")), blobs(spark, sf_dir, True)
        own.add(b.where("id % 2 = 0").withColumn("blob", F.when(F.col("id") % 10 == 0, "the the reau").otherwise(F.col("blob"))))
        own.add(b.where("id % 2 = 1"))
        own.add(b.where("id % 10 = 0"))
        _INDEXED[key] = own
    return _INDEXED[key]


_MORE = "SELECT * FROM (VALUES (0, 'the'), (0, 'tion'), (0, 'reau'), (1, 'de'), (1, 'ou'), (2, 'of the'), (2, 'e'), (3, 'zzqx'), (4, 'et de'), (4, 'nicht')) t(question, term)"


@query(f"WITH {_bm25_sql(_blob_sql(True), _MORE)} SELECT question, id, round(score, 6) AS score, rank, total FROM (SELECT question, id, score, count(*) OVER (PARTITION BY question) AS total, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, id) AS rank FROM r) WHERE rank <= 20")
def r1_index_search(spark, sf_dir):
    """The 20 best documents for each of five questions, and how many match, by the index: no text is read but those that hold the parts of a phrase."""
    questions = spark.createDataFrame([(0, list(TERMS)), (1, ["de", "OU"]), (2, ["of the", "e"]), (3, ["zzqx"]), (4, ["et de", "nicht", " "])], "question int, terms array<string>")
    scored = indexed(spark, sf_dir).search(questions)
    best = retrieval.top_k(scored, 20).join(scored.groupBy("question").agg(F.count("*").alias("total")), "question")
    return best.select("question", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "total")
