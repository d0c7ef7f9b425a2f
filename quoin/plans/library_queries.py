"""Smaller operators of cards, panels, pages and ingest over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import evaluation, gate
from quoin.operators import grounding as G
from quoin.operators import linter as L
from quoin.operators import services as S
from quoin.operators.normalize import backups_to_prune
from quoin.plans.grounding_queries import TODAY
from quoin.plans.registry import query
from quoin.plans.retrieval_queries import _COUNTS, _SCORE, BLOCKS_SQL
from quoin.plans.text_queries import TOKENS_SQL, WS, docs, sql_norm
from quoin.runtime import table

_FIRST = "split_part(text, E'\\n', 1)"


@query("SELECT doc_id AS id, substr(text, 1, 200) AS body FROM documents")
def p1_zoom(spark, sf_dir):
    """The thin level of every card; other columns aren't read."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("thin"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("aliases"), F.lit("thin").alias("zoom"), F.col("text").alias("full"))
    return S.zoom(rows, "thin")


@query("SELECT doc_id AS id, array_to_string(list_sort(list_filter(['craft', 'engine notes', 'scorer ' || lang, lang], lambda k: k = 'craft' OR contains(k, 'engine') OR contains(k, 'scorer'))), ',') AS names FROM documents")
def p3_projection(spark, sf_dir):
    """The engine's sections of a dimension."""
    secs = F.map_from_arrays(F.array(F.lit("craft"), F.lit("engine notes"), F.concat(F.lit("scorer "), "lang"), F.col("lang")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(F.map_keys(S.project(secs, "engine"))), ",").alias("names"))


_PATHS = "(SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'lib/src1/' || doc_id || '.md' WHEN 1 THEN 'lib/src1/../' || doc_id || '.txt' WHEN 2 THEN '../lib/src1/' || doc_id || '.txt' WHEN 3 THEN 'lib/other/' || doc_id || '.txt' WHEN 4 THEN 'lib/src1/a b.txt' WHEN 5 THEN 'lib/' || source || '/x/' || doc_id || '.txt' ELSE 'lib/' || source || '/' || doc_id || '.txt' END AS rel, CASE doc_id % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN '' WHEN 2 THEN 'a\\b' ELSE 'card-' || doc_id END AS card FROM documents)"


@query(f"SELECT doc_id AS id, regexp_full_match(rel, 'lib/(src0|src1|src2)/[A-Za-z0-9._-]+\\.txt') AS source, card <> '' AND NOT contains(card, '/') AND NOT contains(card, chr(92)) AS card FROM {_PATHS}")
def p6_source_fence(spark, sf_dir):
    """Only texts of the configured shelves are sources, and only bare names are cards."""
    d = F.col("doc_id").cast("string")
    at = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    rel = F.col("doc_id") % 9
    path = F.when(rel == 0, at("lib/src1/", d, ".md")).when(rel == 1, at("lib/src1/../", d, ".txt")).when(rel == 2, at("../lib/src1/", d, ".txt")).when(rel == 3, at("lib/other/", d, ".txt")).when(rel == 4, "lib/src1/a b.txt").when(rel == 5, at("lib/", F.col("source"), "/x/", d, ".txt")).otherwise(at("lib/", F.col("source"), "/", d, ".txt"))
    k = F.col("doc_id") % 4
    card = F.when(k == 0, "a/b").when(k == 1, "").when(k == 2, "a\\b").otherwise(at("card-", d))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), L.is_source_path(path, L.source_path(["src0", "src1", "src2"], "lib")).alias("source"), L.card_path(card).alias("card"))


@query(f"SELECT doc_id AS id, trim(list_filter(string_split(t, E'\\n'), lambda x: trim(x) <> '' AND NOT starts_with(x, '_('))[1]) AS gist FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN E'_(to be written)\\n\\n' || text ELSE text END AS t FROM documents)")
def w8_gist(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_(to be written)\n\n"), "text")).otherwise(F.col("text"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), S.gist(t).alias("gist"))


@query("SELECT doc_id AS id, sha256(regexp_replace(replace(text, E'\\n', CASE WHEN doc_id % 2 = 0 THEN E'\\n \\n\\n\\n' ELSE E'\\n\\n' END), '\\n(?:[ \\t]*\\n){2,}', E'\\n\\n', 'g')) AS text_sha FROM documents")
def w7_collapse_blanks(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\n \n\n\n").otherwise("\n\n"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(S.collapse_blank_lines(t), 256).alias("text_sha"))


@query("""SELECT id, array_to_string(s[greatest(1, p - 1):least(len(s), p + 1)], ' ') AS sentences FROM (SELECT id, s, list_position(list_transform(s, lambda x: contains(regexp_replace(x, '\\s+', ' ', 'g'), 'on')), true) AS p FROM (
  SELECT doc_id AS id, string_split(regexp_replace(trim(text, E' \\n\\t'), '([.!?])\\s+', '\\1\x01', 'g'), '\x01') AS s FROM documents)) WHERE p > 0""")
def w5_sentence_window(spark, sf_dir):
    """The first sentence that holds a phrase, with its neighbours."""
    w = S.sentence_window(F.btrim("text", F.lit(" \n\t")), F.lit("on"), 1)
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), w.alias("sentences")).where("sentences is not null")


@query(f"""WITH n AS (SELECT doc_id, {sql_norm('text')} AS flat FROM documents), a AS (SELECT doc_id AS owner, split_part(split_part(text, E'\\n', 1), ' ', 2) AS phrase, unnest([doc_id + 1, doc_id + 2, doc_id - 3]) AS rel FROM documents)
  SELECT owner, bool_or(coalesce(trim(phrase) <> '' AND (contains(flat, trim(phrase)) OR (replace(phrase, '-', '') <> '' AND contains(replace(flat, '-', ''), replace(trim(phrase), '-', '')))), false)) AS found, (count(*) - count(flat))::BIGINT AS absent FROM a LEFT JOIN n ON n.doc_id = a.rel GROUP BY owner""")
def j5_anchor_any_of(spark, sf_dir):
    """Anchors that hold if any of three neighbouring sources has them."""
    d = F.col("doc_id")
    own = docs(spark, sf_dir).select(d.alias("a"), d.alias("owner"), G.marker(F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))).alias("marker"), F.array(d + 1, d + 2, d - 3).alias("rels"))
    return S.any_of(own, docs(spark, sf_dir).select(d.alias("rel"), "text")).select("owner", "found", "absent")


@query("""WITH c AS (SELECT 'card-' || doc_id AS id FROM documents), s(owner, name) AS (VALUES ('x', 'card-7'), ('x', 'card'), ('y', '-19'), ('y', 'none')), p AS (SELECT owner, name, id, CASE WHEN id = name THEN 0 WHEN starts_with(id, name || '-') THEN 1 ELSE 2 END AS kind FROM c, s WHERE contains(id, name))
  SELECT s.owner, s.name, count(id)::BIGINT AS cards, min(b.kind)::INT AS kind FROM s LEFT JOIN (SELECT owner, name, id, kind FROM (SELECT *, min(kind) OVER (PARTITION BY owner, name) AS m FROM p) WHERE kind = m) b ON b.owner = s.owner AND b.name = s.name GROUP BY s.owner, s.name""")
def j6_panel_names(spark, sf_dir):
    c = docs(spark, sf_dir).select(F.concat(F.lit("card-"), F.col("doc_id").cast("string")).alias("id"))
    s = spark.createDataFrame([("x", "card-7"), ("x", "card"), ("y", "-19"), ("y", "none")], "owner string, name string")
    return S.panel_names(s, c).groupBy("owner", "name").agg(F.count("id").alias("cards"), F.min("kind").alias("kind"))


_STATUS = "['found', 'not-found', 'source-stale', 'ambiguous', 'review-expired', 'source-not-installed', 'source-unstamped', 'review-date-invalid'][(doc_id * 5 + i * (doc_id % 7 + 1)) % 8 + 1]"


@query(f"""WITH r AS (SELECT doc_id AS anchor, i AS ord, {_STATUS} AS status FROM documents, range(0, 3) t(i) WHERE i <= doc_id % 3),
  k AS (SELECT *, CASE WHEN status IN ('source-stale', 'review-expired', 'review-date-invalid') THEN 5 WHEN status = 'source-unstamped' THEN 4 WHEN status = 'ambiguous' THEN 3 WHEN status = 'source-not-installed' THEN 2 ELSE 1 END AS rk FROM r)
  SELECT anchor, CASE WHEN count(*) FILTER (WHERE status = 'found') = 1 THEN 'found' WHEN count(*) FILTER (WHERE status = 'found') > 1 THEN 'ambiguous-panel' ELSE max_by(status, rk * 100 + ord) FILTER (WHERE status <> 'found') END AS status FROM k GROUP BY anchor""")
def w11_reason_rank(spark, sf_dir):
    """One status for each anchor over its panel: the most telling failure, the later card's of equal ones."""
    names = F.array(*map(F.lit, ("found", "not-found", "source-stale", "ambiguous", "review-expired", "source-not-installed", "source-unstamped", "review-date-invalid")))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("anchor"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("ord"))
    return S.worst_reason(rows.withColumn("status", F.element_at(names, ((F.col("anchor") * 5 + F.col("ord") * (F.col("anchor") % 7 + 1)) % 8 + 1).cast("int"))))


@query("SELECT doc_id AS draft, 'c' AS criterion, floor(avg(s) + 0.5)::INT AS score, (max(s) - min(s))::INT AS spread FROM (SELECT doc_id, (doc_id * (i + 2)) % 5 AS s FROM documents, range(0, 4) t(i)) GROUP BY doc_id")
def w12_balanced_scores(spark, sf_dir):
    runs = docs(spark, sf_dir).select(F.col("doc_id").alias("draft"), F.lit("c").alias("criterion"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("doc_id") * (i + 2)) % 5).cast("int"))).alias("score"))
    return S.balanced_scores(runs)


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), 'stub') AS zoom, count(*)::BIGINT AS cards, (count(*) FILTER (WHERE source <> 'src0'))::BIGINT AS aliased FROM documents GROUP BY 1")
def a2_zoom_counts(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("zoom"), F.nullif("source", F.lit("src0")).alias("aliases"))
    return S.zoom_counts(rows)


@query("SELECT text_sha, n::BIGINT AS n, first FROM (SELECT sha256(text) AS text_sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1) WHERE n > 1")
def a20_duplicates(spark, sf_dir):
    """Sources that stand in the corpus more than once."""
    return S.duplicates(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("sha256", "text_sha")


@query(f"""WITH p AS (SELECT doc_id AS doc, i AS page, l[i] AS shown, substr(l[i], 1, length(l[i]) // 2) || ' zz' AS extracted FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents))),
  q AS (SELECT doc, page, {TOKENS_SQL.replace('text', 'shown')} AS s, list_reverse({TOKENS_SQL.replace('text', 'extracted')}) AS e FROM p),
  w AS (SELECT doc, page, unnest(s) AS t, generate_subscripts(s, 1) AS i, 1 AS a FROM q UNION ALL SELECT doc, page, unnest(e), generate_subscripts(e, 1), 0 FROM q), g AS (SELECT doc, page, t, sum(a) AS a, sum(1 - a) AS b, min(i) FILTER (WHERE a = 1) AS pa, min(i) FILTER (WHERE a = 0) AS pb FROM w GROUP BY doc, page, t),
  k AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY pa) AS x, row_number() OVER (PARTITION BY doc, page ORDER BY pb) AS y FROM g WHERE a = 1 AND b = 1), o AS (SELECT doc, page, CASE WHEN count(*) >= 4 THEN 1 - 6 * sum((x - y) * (x - y))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) END AS r FROM k GROUP BY doc, page)
  SELECT p.doc, p.page, round(z.r, 6)::DOUBLE AS recall, round(o.r, 6) AS "order" FROM p LEFT JOIN (SELECT doc, page, sum(least(a, b)) / nullif(sum(a), 0) AS r FROM g GROUP BY doc, page) z USING (doc, page) LEFT JOIN o USING (doc, page)""")
def a8_page_recall(spark, sf_dir):
    """How much of every line's words an extraction of its first half, backwards, keeps, and in what order; each line is a page."""
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "shown"))
    half = F.concat(F.substring("shown", F.lit(1), F.floor(F.length("shown") / 2).cast("int")), F.lit(" zz"))
    half = F.array_join(F.reverse(T.tokens(half)), " ")
    pages = lines.select("doc", (F.col("pos") + 1).cast("long").alias("page"), "shown", half.alias("extracted"))
    return S.page_recall(pages).select("doc", "page", F.round("recall", 6).alias("recall"), F.round("order", 6).alias("order"))


@query(f"SELECT doc_id AS id, CASE WHEN w = 0 THEN 'no words' WHEN share > 0.1 THEN 'control characters' END AS refused FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(t, '{WS}', ' ', 'g'), ' '), lambda x: x <> '')) AS w, (length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'))) / greatest(length(t), 1) AS share FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN replace(text, 'e', chr(2)) ELSE text END AS t FROM documents))")
def i5_quality_gate(spark, sf_dir):
    t = F.when(F.col("doc_id") % 4 == 0, "  ").when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit("e"), F.lit("\x02"))).otherwise(F.col("text"))
    return S.quality_gate(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), t.alias("text"))).select("id", "refused")


@query("""WITH t AS (SELECT doc_id AS id, n_chars AS w0, doc_id % 20 AS s0, n_chars * (doc_id % 3) // 2 AS w1, doc_id % 11 AS s1, n_chars AS w2, doc_id % 7 AS s2 FROM documents), a AS (SELECT *, CASE WHEN w1 > 0 AND (w0 = 0 OR (w1 >= w0 * 0.5 AND s1 < s0)) THEN 1 ELSE 0 END AS one FROM t),
  b AS (SELECT *, CASE one WHEN 1 THEN w1 ELSE w0 END AS w, CASE one WHEN 1 THEN s1 ELSE s0 END AS s FROM a) SELECT id, CASE WHEN w2 > 0 AND (w = 0 OR (w2 >= w * 0.5 AND s2 < s)) THEN 'third' WHEN one = 1 THEN 'second' ELSE 'first' END AS tier FROM b""")
def i9_better_tier(spark, sf_dir):
    """The extraction that is kept of three, tried in turn."""
    d, n = F.col("doc_id"), F.col("n_chars")
    tier = lambda name, words, score: F.struct(F.lit(name).alias("tier"), words.alias("words"), score.alias("score"))
    tiers = F.array(tier("first", n, d % 20), tier("second", F.expr("n_chars * (doc_id % 3) DIV 2"), d % 11), tier("third", n, d % 7))
    return docs(spark, sf_dir).select(d.alias("id"), S.better_tier(tiers)["tier"].alias("tier"))


@query("SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'a', 'an', 'and', 'to', 'in', 'on', 'for', 'by', '&')), ' ') AS tokens FROM benchmark")
def f24_name_tokens(spark, sf_dir):
    from quoin.operators.retrieval import name_tokens

    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(name_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id AS id, sha256(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{7f}-\\x{9f}]', '', 'g')) AS safe_sha, sha256(E'<untrusted-source>\\n' || replace(t, '</untrusted-source>', '<' || chr(8203) || '/untrusted-source>') || E'\\n</untrusted-source>') AS wrapped_sha, length(regexp_replace(t, '[\\p{Cf}\\p{Cc}\\p{Zs}\\p{Zl}\\p{Zp}]', '', 'g'))::BIGINT AS visible FROM (SELECT doc_id, replace(replace(text, 'e ', chr(27) || 'e' || chr(8203)), 'and', '</untrusted-source>') AS t FROM documents)")
def f26_untrusted(spark, sf_dir):
    """Corpus text made safe for a terminal, framed for a prompt, and its visible characters."""
    t = F.replace(F.replace("text", F.lit("e "), F.lit("\x1be\u200b")), F.lit("and"), F.lit("</untrusted-source>"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(S.safe(t), 256).alias("safe_sha"), F.sha2(S.untrusted(t), 256).alias("wrapped_sha"), F.length(S.visible(t)).cast("long").alias("visible"))


@query("SELECT doc_id AS id, least(greatest(n_chars * 1000 // 24000, 300), 10800)::BIGINT AS seconds FROM documents")
def h12_deadline(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), S.deadline(F.col("n_chars") * 1000).cast("long").alias("seconds"))


@query("SELECT doc_id AS id, sha256('aim-' || doc_id || chr(0) || split_part(text, E'\\n', 1) || chr(0) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END || chr(0) || '0=low|1=' || source) AS key FROM documents")
def h3_criterion_key(spark, sf_dir):
    """The digest of what a criterion says, which a judge's steps are kept by."""
    field = lambda c: F.struct(c.alias("value"))
    level = lambda i, c: F.struct(F.lit(i).alias("score"), field(c).alias("descriptor"))
    rows = docs(spark, sf_dir).select(
        "doc_id", F.struct(F.concat(F.lit("aim-"), F.col("doc_id").cast("string")).alias("id"), field(F.substring_index("text", "\n", 1)).alias("statement"), field(F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("guidance"), F.array(level(0, F.lit("low")), level(1, F.col("source"))).alias("levels")).alias("c")
    )
    return rows.select(F.col("doc_id").alias("id"), gate.criterion_key(F.col("c")).alias("key"))


@query(f"""WITH w AS (SELECT doc_id AS id, {sql_norm('text')} AS flat, string_split({_FIRST}, ' ') AS l FROM documents), a AS (SELECT id, flat, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, trim(unnest([l[1], l[2] || ' ' || l[3], 'no such thing', l[3] || 'zz'])) AS p FROM w WHERE len(l) > 2)
  SELECT id, round(avg((p <> '' AND (contains(flat, p) OR (regexp_replace(p, '-\\s*', '', 'g') <> '' AND contains(nohy, regexp_replace(p, '-\\s*', '', 'g')))))::INT), 6) AS share, count(*)::BIGINT AS anchors FROM a GROUP BY id""")
def r23_anchor_compatibility(spark, sf_dir):
    """The share of each document's anchors that its text still holds, over folds."""
    l = F.split(F.substring_index("text", "\n", 1), " ")  # noqa: E741
    word = lambda i: F.element_at("l", i)
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", l.alias("l")).where(F.size("l") > 2)
    rows = rows.select("id", "text", F.array(word(1), F.concat_ws(" ", word(2), word(3)), F.lit("no such thing"), F.concat(word(3), F.lit("zz"))).alias("anchors"))
    return evaluation.anchor_compatibility(rows).select("id", F.round("share", 6).alias("share"), F.col("n").cast("long").alias("anchors"))


_R6_SQL = f"""WITH c AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS src, split_part({_FIRST}, ' ', 2) AS phrase, doc_id % 5 = 0 AS stale, doc_id % 7 = 0 AS expired, doc_id % 3 = 0 AS titled, {sql_norm('text')} AS flat FROM documents),
  n AS (SELECT *, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, {sql_norm('phrase')} AS p FROM c), x AS (SELECT *, CASE WHEN p = '' OR contains(phrase, '`') THEN 0 WHEN contains(flat, p) THEN (length(flat) - length(replace(flat, p, ''))) // length(p) WHEN replace(p, '-', '') = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, replace(p, '-', ''), ''))) // length(replace(p, '-', '')) END AS n FROM n),
  a AS (SELECT id, 'card-anchor' AS route, 1 AS rank, 1 AS start, least(len(string_split(text, E'\\n')) - (ends_with(text, E'\\n'))::INT, 3) AS "end", text FROM x WHERE id % 2 = 0 AND src IS NOT NULL AND NOT stale AND NOT expired AND n = 1),
  {BLOCKS_SQL % "(SELECT doc_id, text AS t FROM documents)"}, k AS ({_COUNTS % "blk"}), f AS (SELECT k.id, k.start, k."end", k.text, CASE WHEN titled THEN CASE WHEN c1 > 0 AND c3 > 0 THEN 10.0 + least(c1, 3) + least(c3, 3) ELSE 0 END ELSE {_SCORE} END AS score FROM k JOIN x ON x.id = k.id WHERE src IS NOT NULL AND NOT stale AND k.id NOT IN (SELECT id FROM a)),
  g AS (SELECT id, 'full-text' AS route, row_number() OVER (PARTITION BY id ORDER BY score DESC, start) AS rank, start, "end", text FROM f WHERE score > 0),
  u AS (SELECT id, route, rank::INT AS rank, start, "end", CASE WHEN length(array_to_string(string_split(text, E'\\n')[:3], E'\\n')) <= 2000 THEN sha256(array_to_string(string_split(text, E'\\n')[:"end"], E'\\n')) END AS passage_sha FROM a UNION ALL SELECT id, route, rank::INT, start, "end", CASE WHEN length(text) <= 2000 THEN sha256(text) END FROM g WHERE rank <= 3)
  SELECT x.id, CASE WHEN route IS NULL THEN 'insufficient' ELSE 'evidence-found' END AS status, route, rank, start::BIGINT AS start, "end"::BIGINT AS "end", passage_sha FROM x LEFT JOIN u USING (id)"""


@query(_R6_SQL)
def r6_retrieve_evidence(spark, sf_dir):
    """Both routes: anchors of cards with the lines around them, then blocks of the sources of cards without a usable one, without the title's words; stale and absent sources give nothing."""
    d, t = F.col("doc_id"), F.col("text")
    phrase = F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))
    body = F.when(d % 2 == 0, F.concat(F.lit("on tion ende reau (grep: `"), F.replace(phrase, F.lit("`"), F.lit("")), F.lit("`)\n\nother"))).otherwise(F.lit("nothing here"))
    rows = docs(spark, sf_dir).select(d.alias("id"), F.when(d % 3 == 0, "Ende of it").otherwise("Plain").alias("title"), body.alias("body"), F.when(d % 11 != 0, t).alias("text"), F.when(d % 5 == 0, "bad").alias("stored_sha"), F.when(d % 7 == 0, "2020-01-01").alias("review_by"))
    found = S.retrieve_evidence(rows, "tion ende reau", TODAY, 3)
    whole = F.when(~F.startswith("passage", F.lit("…")) & ~F.endswith("passage", F.lit("…")), F.sha2("passage", 256))
    return found.select("id", "status", "route", "rank", "start", "end", whole.alias("passage_sha"))


@query("SELECT root, name FROM (SELECT source AS root, CASE WHEN doc_id % 5 = 0 THEN 'other-' ELSE 'normalize-backup-' END || doc_id AS name, row_number() OVER (PARTITION BY source, doc_id % 5 = 0 ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r > 3 AND starts_with(name, 'normalize-backup-')")
def k8_prune_backups(spark, sf_dir):
    """Backups that go as only the newest three of each root stay; other folders aren't touched."""
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, "other-").otherwise("normalize-backup-"), F.col("doc_id").cast("string"))
    return backups_to_prune(docs(spark, sf_dir).select(F.col("source").alias("root"), name.alias("name"), F.struct("n_chars", "doc_id").alias("modified")), 3).select("root", "name")


@query("SELECT lang AS kb, count(*)::BIGINT AS cards FROM documents WHERE lang IN (SELECT DISTINCT lang FROM documents ORDER BY 1 LIMIT 10) GROUP BY lang")
def r19_execute_fanout(spark, sf_dir):
    """A verb through the dispatcher over several knowledge bases: the scope is a filter of one job."""
    d = docs(spark, sf_dir)
    kbs = [r[0] for r in d.select("lang").distinct().collect()]
    own = d.select(F.col("lang").alias("kb"), F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("shelf"), F.lit("thin").alias("zoom"))
    listed = S.execute("cards", {"cards": own}, {}, kbs)
    return listed.join(own.select("id", "kb"), "id").groupBy("kb").agg(F.count("*").alias("cards"))
