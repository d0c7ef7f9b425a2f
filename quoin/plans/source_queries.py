"""Readers, formats, pages, cards, frameworks and sheets: each made of documents in the form that its reader takes, and read back."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quoin.functions.anchors import parse_markers
from quoin.operators import evaluation, gate, grounding, ingestion, normalize
from quoin.operators import services as S
from quoin.plans.grounding_queries import FLAT, TODAY
from quoin.plans.registry import query
from quoin.plans.text_queries import docs, sql_norm
from quoin.runtime import arrow_limits, durable, scratch, shared_dir
from quoin.sources import archives, formats, library

_FIRST = "split_part(text, E'\\n', 1)"
_WORD = f"split_part({_FIRST}, ' ', 2)"


def number():
    return F.col("doc_id")


def first_line():
    return F.substring_index("text", "\n", 1)


def second_word():
    return F.split_part(first_line(), F.lit(" "), F.lit(2))


def say(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def base(spark: SparkSession, sf_dir: str) -> library.Library:
    """A knowledge base on disk, in a folder whose name has glob characters: documents as sources of three shelves, cards for most of them with anchors, an index and some lenses."""
    shared_dir(spark)
    root = scratch(spark, "base[1]")
    d = docs(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("shelf"), (number() % 3).cast("string")).alias("shelf"))
    phrase = F.when(number() % 10 == 1, "rotted phrase").otherwise(F.replace(second_word(), F.lit("`"), F.lit("")))
    rel = F.when(number() % 10 == 3, say("shelf0/gone-", number(), ".txt")).when(number() % 10 == 4, say("../", number(), ".txt")).otherwise(say("./", F.col("shelf"), "/", number(), ".txt"))
    front = say("---\nid: ", number(), "\nfile: ", rel, "\naliases: a", number() % 4, "\nshelf: ", F.col("shelf"), "\nsource_sha256: ", F.when(number() % 10 == 5, "bad").otherwise(F.sha2("text", 256)), F.when(number() % 10 == 6, "\nreview_by: 2020-01-01").otherwise(""), "\n---\n")
    card = say(front, "# Card ", number(), "\n\n## Thin\nSaid (grep: `", phrase, "`).\n## Full\nMore.\n## Thin\nAgain (grep: `", phrase, "`).\n")
    files = [
        d.select(say(F.col("shelf"), "/", number(), ".txt").alias("path"), "text"), d.where(number() % 10 != 2).select(say("cards/", number(), ".md").alias("path"), card.alias("text")),
        d.where(number() % 10 == 7).select(say("lenses/", F.when(number() % 3 == 0, "_").otherwise(""), "lens-", number(), ".md").alias("path"), F.lit("# Lens").alias("text")), d.where("false").select(F.lit("x").alias("path"), "text"),
    ]
    board = d.where((number() % 10 != 2) & (number() % 10 != 8)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(number())), lambda i: F.concat(F.lit("- ["), i.cast("string"), F.lit("]("), i.cast("string"), F.lit(".md)"))), "\n").alias("text"))
    fixed = spark.createDataFrame([("cards/README.md", "# read"), ("lenses/README.md", "x"), ("lenses/GATE-TRIAGE.md", "x"), ("shelf0/notes.md", "x")], "path string, text string")
    out = board.select(F.lit("cards/INDEX.md").alias("path"), "text").unionAll(fixed)
    for f in files:
        out = out.unionAll(f)
    library.write_files(out, root)
    return library.manifest('id = "kb"\nshelves = ["shelf0", "shelf1", "shelf2", "gone"]\nsyntheses = "lenses"\n', root)


_SHELF = "'shelf' || doc_id % 3"


@query(f"SELECT {_SHELF} AS shelf, doc_id::VARCHAR AS id, {_SHELF} || '/' || doc_id || '.txt' AS rel, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def s2_shelf_texts(spark, sf_dir):
    """All texts of all shelves; a shelf that isn't there and other files are left out."""
    return library.sources(spark, base(spark, sf_dir)).select("shelf", "id", "rel", "size", "sha256")


@query(f"SELECT doc_id::VARCHAR AS id, 'Card ' || doc_id AS title, 'a' || doc_id % 4 AS aliases, {_SHELF} AS shelf, 'Again (grep: `' || CASE WHEN doc_id % 10 = 1 THEN 'rotted phrase' ELSE replace({_WORD}, '`', '') END || '`).' AS thin, 'full,thin' AS names FROM documents WHERE doc_id % 10 <> 2")
def s3_card_files(spark, sf_dir):
    """Cards with their fields and sections, the later of equal ones; the board and the readme are none."""
    return library.cards(spark, base(spark, sf_dir)).select("id", "title", "aliases", "shelf", "thin", F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("names"))


@query("SELECT 'lens-' || doc_id AS name FROM documents WHERE doc_id % 10 = 7 AND doc_id % 3 <> 0")
def s4_lens_files(spark, sf_dir):
    lib = base(spark, sf_dir)
    return library.lenses(spark, f"{lib.root}/{lib.syntheses}").select("name")


@query("SELECT doc_id::VARCHAR AS name FROM documents WHERE doc_id % 10 <> 2 AND doc_id % 4 = 0")
def s29_tripwire(spark, sf_dir):
    """Cards on disk that an enumeration lacks."""
    lib = base(spark, sf_dir)
    on_disk = library.files(spark, f"{lib.root}/{lib.cards}", "*.md", r"\.md").where(~F.concat("name", F.lit(".md")).isin(*library.NOT_CARDS)).select("name")
    return library.tripwire(on_disk.where(F.col("name").cast("long") % 4 != 0), on_disk)


@query(f"""WITH n AS (SELECT doc_id AS d, text, replace({_WORD}, '`', '') AS phrase, {sql_norm('text')} AS flat FROM documents), p AS (SELECT *, trim(phrase) AS p, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, regexp_replace(trim(phrase), '-\\s*', '', 'g') AS pd FROM n WHERE d % 10 <> 2),
  h AS (SELECT d, CASE WHEN d % 10 = 1 THEN contains(flat, 'rotted phrase') ELSE p <> '' AND (contains(flat, p) OR pd <> '' AND contains(nohy, pd)) END AS held, phrase FROM p)
  SELECT severity, code, count(*)::BIGINT AS n FROM (SELECT 'error' AS severity, 'A' AS code FROM p WHERE d % 10 = 4 UNION ALL SELECT 'unmeasured', 'U' FROM p WHERE d % 10 = 3 UNION ALL SELECT 'error', 'B' FROM n WHERE d % 10 = 2 UNION ALL SELECT 'error', 'D' FROM n WHERE d % 10 = 8
    UNION ALL SELECT 'warn', 'H' FROM p WHERE d % 10 IN (5, 6) UNION ALL SELECT 'error', 'F' FROM h, range(2) WHERE d % 10 NOT IN (3, 4) AND NOT held AND NOT (d % 10 <> 1 AND phrase = '')) GROUP BY ALL""")
def r10_check_on_disk(spark, sf_dir):
    """The linter's verb over a base on disk: paths out of the shelves, absent sources, orphans, an outdated index, rotted anchors, sources changed or due for review."""
    from quoin.__main__ import pattern, tables

    lib = base(spark, sf_dir)
    t = tables(spark, lib, once=True)
    found = S.execute("check", {k: t[k] for k in ("cards", "sources", "anchors", "index", "missed")}, {"today": TODAY, "pattern": pattern(lib)})
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("SELECT 3::BIGINT * count(*) FILTER (WHERE doc_id % 3 = 0) AS errors, count(*) FILTER (WHERE doc_id % 3 = 1) AS warns, count(*) FILTER (WHERE doc_id % 3 = 2) AS unmeasured, false AS ok FROM documents")
def a18_report(spark, sf_dir):
    """Findings counted by severity; with an error or anything unmeasured a base isn't sound."""
    rows = docs(spark, sf_dir).select(F.explode(F.when(number() % 3 == 0, F.array(*[F.lit("error")] * 3)).when(number() % 3 == 1, F.array(F.lit("warn"))).otherwise(F.array(F.lit("unmeasured")))).alias("severity"))
    return grounding.report(rows)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN sha256(E'\\n' || text) END AS body_sha FROM documents")
def s10_body_below_mark(spark, sf_dir):
    card = F.when(number() % 4 > 0, say("front\n", "<!-- scaffold: managed by tool-", number(), " — edit Thin/Full below the marker by hand -->", "\n", F.col("text"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select(number().alias("id"), F.sha2(library.body_below_mark(card), 256).alias("body_sha"))


@query(f"SELECT doc_id AS id, {_FIRST} AS claim, CASE WHEN doc_id % 2 = 0 THEN lang END AS practices, source AS anchors, (2 + (doc_id % 2 = 0)::INT)::INT AS n FROM documents")
def s11_framework_sections(spark, sf_dir):
    """Numbered sections of a framework by their fixed names; a ninth number is left out."""
    text = say("# T\n### 1. What it claims\n", F.trim(first_line()), "\n", F.when(number() % 2 == 0, say("### 4. Practices\n", F.col("lang"), "\n")).otherwise(""), "### 8. Anchors\n", F.col("source"), "\n### 9. Beyond\nz\n")
    m = docs(spark, sf_dir).select(number().alias("id"), library.framework_sections(text).alias("m"))
    return m.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("claim", "practices", "anchors")], F.size("m").alias("n"))


@query("SELECT doc_id AS id, 'a|' || lang || ',' || lower(source) AS cues, 'Pacing,arc' || doc_id % 3 AS dims FROM documents WHERE doc_id % 5 > 0")
def s12_diagnostics(spark, sf_dir):
    """The pipe table of symptoms: escaped bars stay in a cell, rows without cues are left out. Each row's table is one document's."""
    rows = docs(spark, sf_dir).select(number().alias("id"), F.when(number() % 5 > 0, say("| A\\|", F.col("lang"), " , ", F.upper("source"), "| Pacing, arc", number() % 3, " | ")).otherwise(F.lit("| | x |")).alias("line"))
    table = rows.agg(F.concat(F.lit("# map\n| cues | dims |\n|---|:-:|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    found = library.diagnostics(table)
    ids = rows.select("id", (F.row_number().over(_by_id()) + 2).alias("ord"))
    return found.join(ids, "ord").select("id", F.array_join("cues", ",").alias("cues"), F.array_join("dims", ",").alias("dims"))


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'txt' END AS format, CASE WHEN doc_id % 7 < 6 THEN sha256(text) END AS text_sha FROM documents WHERE text <> ''")
def s14_text_decoding(spark, sf_dir):
    """Texts as UTF-8 with and without a mark, as UTF-16 of either order, and as bytes that are no text."""

    def coded(text: pd.Series, kind: pd.Series) -> pd.Series:
        how = {2: ("utf-8-sig", b""), 3: ("utf-16-le", b"\xff\xfe"), 4: ("utf-16-be", b"\xfe\xff")}
        return pd.Series([b"\x00\x01" + t.encode() if k == 6 else how[k][1] + t.encode(how[k][0]) if k in how else t.encode() for t, k in zip(text, kind, strict=True)])

    rows = docs(spark, sf_dir).where("text != ''").select(number().cast("string").alias("path"), F.pandas_udf(coded, "binary")("text", number() % 7).alias("content"))
    return formats.extract(rows).select(F.col("path").cast("long").alias("id"), "format", F.sha2("text", 256).alias("text_sha"))


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def _escaped(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE sha256(array_to_string(list_filter([list_aggregate(list_transform(string_split(trim(source), E'\\n'), lambda x: x), 'string_agg', E'\\n'), array_to_string(list_filter(list_transform(string_split(text, E'\\n'), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), E'\\n\\n')], lambda x: x <> ''), E'\\n\\n')) END AS text_sha, doc_id % 6 = 5 AS refused FROM documents""")
def s16_epub(spark, sf_dir):
    """Chapters in the order of the spine, one under a percent-encoded name; an archive with an empty spine is refused."""

    def made(text: pd.Series, source: pd.Series, kind: pd.Series) -> pd.Series:
        def one(t, s, k):
            spine = "" if k == 5 else '<itemref idref="b"/><itemref idref="a"/>'
            opf = f'<package><manifest><item id="a" href="the%20text.html"/><item id="b" href="b.html#x"/></manifest><spine>{spine}</spine></package>'
            body = "".join(f"<p>{_escaped(x)}</p>" for x in t.split("\n"))
            return _zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="no.opf" media-type="x"/><rootfile full-path="o/c.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "o/c.opf": opf, "o/the text.html": f"<html><body>{body}</body></html>", "o/b.html": f"<main>{_escaped(s)}</main>"})

        return pd.Series([one(*r) for r in zip(text, source, kind, strict=True)])

    rows = docs(spark, sf_dir).select(number().cast("string").alias("path"), F.pandas_udf(made, "binary")("text", "source", number() % 6).alias("content"))
    return formats.extract(rows).select(F.col("path").cast("long").alias("id"), F.sha2("text", 256).alias("text_sha"), F.col("error").isNotNull().alias("refused"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 5 THEN sha256(trim(text, E'\\n')) END AS text_sha, doc_id % 6 = 5 AS refused FROM documents")
def s17_docx(spark, sf_dir):
    """Paragraphs of a document; an archive with a name that leaves it is refused."""

    def made(text: pd.Series, kind: pd.Series) -> pd.Series:
        def one(t, k):
            body = "".join(f"<w:p><w:r><w:t>{_escaped(x)}</w:t></w:r></w:p>" for x in t.split("\n"))
            return _zipped({"word/document.xml": f'<w:d xmlns:w="w">{body}</w:d>'} | ({"../../out": "x"} if k == 5 else {}))

        return pd.Series([one(*r) for r in zip(text, kind, strict=True)])

    rows = docs(spark, sf_dir).select(number().cast("string").alias("path"), F.pandas_udf(made, "binary")("text", number() % 6).alias("content"))
    return formats.extract(rows).select(F.col("path").cast("long").alias("id"), F.sha2("text", 256).alias("text_sha"), F.col("error").isNotNull().alias("refused"))


def _bound(batches):
    """An EPUB with a chapter for each document of even number, the last first in reading order, and a DOCX with a paragraph for each line of the others: two archives a batch, named alike if a task runs again."""
    import pyarrow as pa
    from pyspark import TaskContext

    for n, batch in enumerate(batches):
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        even, odd = [(k, t or "") for k, t in rows if k % 2 == 0], [(k, t or "") for k, t in rows if k % 2]
        items, order = "".join(f'<item id="i{k}" href="the%20{k}.html"/>' for k, _ in even), "".join(f'<itemref idref="i{k}"/>' for k, _ in reversed(even))
        chapters = {f"o/the {k}.html": "<html><body>" + "".join(f"<p>{_escaped(x)}</p>" for x in t.split("\n")) + "</body></html>" for k, t in even}
        book = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": f"<package><manifest>{items}</manifest><spine>{order}</spine></package>"}
        lines = "".join(f"<w:p><w:r><w:t>{k}</w:t><w:tab/><w:t>{_escaped(x)}</w:t></w:r></w:p>" for k, t in odd for x in t.split("\n"))
        made = ([_zipped(book | chapters)] if even else []) + ([_zipped({"word/document.xml": f'<w:d xmlns:w="w">{lines}</w:d>'})] if odd else [])
        at = f"{TaskContext.get().partitionId()}-{n}"
        yield pa.RecordBatch.from_pydict({"path": [f"{at}/{i}.bin" for i in range(len(made))], "text": made}, pa.schema([("path", pa.string()), ("text", pa.binary())]))


def _archives(spark, sf_dir) -> str:
    """A folder of archives that hold all documents."""
    at = scratch(spark, "archives")
    arrow_limits(spark)
    library.write_files(docs(spark, sf_dir).select("doc_id", "text").mapInArrow(_bound, "path string, text binary"), at)
    return at


_CHAPTER = r"the ([0-9]+)\.html$"


@query("""SELECT doc_id AS id, 'epub' AS kind, sha256(body) AS text_sha, NULL::BIGINT AS n_lines, NULL::BIGINT AS digest FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, E'\n'), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), E'\n\n') AS body FROM documents WHERE doc_id % 2 = 0) WHERE body <> '' UNION ALL
  SELECT doc_id, 'docx', NULL, count(*), sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line FROM documents WHERE doc_id % 2 = 1) GROUP BY 1""")
def s19_archive_texts(spark, sf_dir):
    """Chapters and paragraphs of a folder of archives, by the source that plans them by size and cuts the large ones; file names don't tell the kind."""
    found = durable(archives.texts(spark, _archives(spark, sf_dir), pathGlobFilter="*.bin", splitBytes=4 << 20), "texts")  # read twice
    none = F.lit(None).cast("long")
    chapters = found.where("kind = 'epub'").select(F.regexp_extract("member", _CHAPTER, 1).cast("long").alias("id"), "kind", F.sha2("text", 256).alias("text_sha"), none.alias("n_lines"), none.alias("digest"))
    lines = found.where("kind = 'docx'").select("kind", F.explode(F.split("text", "\n")).alias("line")).select(F.substring_index("line", "\t", 1).cast("long").alias("id"), "kind", F.expr("substring(line, instr(line, '\t') + 1)").alias("line"))
    number = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")
    return chapters.unionByName(lines.groupBy("id", "kind").agg(F.lit(None).cast("string").alias("text_sha"), F.count("*").alias("n_lines"), F.sum(number).alias("digest")))


@query("""SELECT doc_id AS id, octet_length(encode('<html><body><p>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), E'\n', '</p><p>') || '</p></body></html>'))::BIGINT AS size FROM documents WHERE doc_id % 2 = 0""")
def s19_archive_members(spark, sf_dir):
    """The chapters that archives hold, with their sizes, by directories alone."""
    found = archives.members(spark, _archives(spark, sf_dir), splitBytes=4 << 20)
    return found.where(F.col("member").rlike(_CHAPTER)).select(F.regexp_extract("member", _CHAPTER, 1).cast("long").alias("id"), "size")


@query(f"SELECT doc_id AS id, 1 AS page, {_FIRST} || E'\\n' || source AS text FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 3, lang FROM documents WHERE doc_id % 4 > 0")
def s21_layout_pages(spark, sf_dir):
    """Blocks of a layout result by the page of their provenance, empty ones as empty lines; without provenance no page is known, and without a block's text not its page's."""
    block = lambda t, p: F.struct(t.alias("text"), (F.array(F.struct(F.lit(p).alias("page_no"))) if p else F.array().cast("array<struct<page_no:int>>")).alias("prov"))
    told = F.to_json(F.struct(F.array(block(F.col("lang"), 3), block(first_line(), 1)).alias("texts"), F.array(block(F.col("source"), 1)).alias("tables")))
    rows = docs(spark, sf_dir).select(number().alias("id"), F.when(number() % 4 > 0, told).otherwise(F.to_json(F.struct(F.array(block(first_line(), 0)).alias("texts")))).alias("json"))
    return library.docling_pages(rows, every=True)


@query(f"SELECT doc_id AS id, p::INT AS page, CASE WHEN p = 1 THEN trim({_FIRST}, E'\\n') ELSE lang END AS text FROM documents, (VALUES (1), (3)) t(p) WHERE doc_id % 5 NOT IN (2, 3)")
def s22_marked_pages(spark, sf_dir):
    """Pages between numbered rules; a text whose numbers go back or has none gives no pages."""
    rule = lambda n: f"{{{n}}}{'-' * 48}\n"
    text = F.when(number() % 5 == 2, say(rule(2), first_line(), "\n", rule(1), "x")).when(number() % 5 == 3, F.col("lang")).otherwise(say(rule(0), first_line(), "\n", rule(2), F.col("lang")))
    return library.marker_pages(docs(spark, sf_dir).select(number().alias("id"), text.alias("text"))).select("id", "page", "text")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'disagreement,engine' ELSE 'claim,limits' END AS names FROM documents")
def p4_framework_default(spark, sf_dir):
    """What is shown of a framework unless more is asked for."""
    keys = F.when(number() % 3 == 0, F.array(F.lit("claim"), F.lit("engine"), F.lit("disagreement"))).otherwise(F.array(F.lit("claim"), F.lit("limits")))
    shown = S.framework_default(F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("x"))))
    return docs(spark, sf_dir).select(number().alias("id"), F.array_join(F.array_sort(F.map_keys(shown)), ",").alias("names"))


@query("SELECT 'library/' || source || '/' || doc_id % 50 || '.txt' AS rel, max('fw-' || doc_id) AS framework FROM documents WHERE doc_id % 4 > 0 GROUP BY 1")
def j9_source_of_framework(spark, sf_dir):
    """The first source that each framework names; of several frameworks of one the last by name."""
    path = F.when(number() % 4 == 0, say("mylibrary/src1/", number(), ".txt and library/other/", number(), ".txt")).otherwise(say("see library/", F.col("source"), "/", number() % 50, ".txt, then library/src0/zz.txt"))
    return S.source_of_framework(docs(spark, sf_dir).select(say("fw-", number()).alias("name"), path.alias("text")), [f"src{i}" for i in range(64)])


@query(f"SELECT (SELECT count(*) FROM documents)::BIGINT AS cards, (SELECT sum(doc_id % 3) FROM documents)::BIGINT AS anchors, count(*)::BIGINT AS sources, round(sum(strlen(text)) / 1e6, 6) AS megabytes FROM documents")
def a19_composition(spark, sf_dir):
    d = docs(spark, sf_dir)
    body = F.concat_ws(" ", *[F.when(number() % 3 > i, F.lit(f"(grep: `p{i}`)")) for i in range(2)])
    return S.composition(d.select(body.alias("body")), d.select(F.octet_length("text").alias("size")))


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Two says ' || source || '.' ELSE 'First ' || lang || ' is.' END AS claim FROM documents")
def f17_claim_of(spark, sf_dir):
    """The sentence of a card that an anchor stands in, without its marker; the first sentence if none has it."""
    body = say("First ", F.col("lang"), " is. Two says ", F.col("source"), " (grep: `key ", number(), "`). Third.")
    return docs(spark, sf_dir).select(number().alias("id"), S.claim_of(body, F.when(number() % 2 == 0, say("key ", number())).otherwise(F.lit("no such"))).alias("claim"))


@query(f"SELECT doc_id AS id, sha256(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', ' ') ELSE replace(replace(text, 'fi', 'fi'), 'x', ' ') END, 'zz', 'zz')) AS text_sha FROM documents")
def f19_repair_control(spark, sf_dir):
    """Control bytes that stand for nothing known become spaces: without a word list no ligature is guessed."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize.repair_control(t, frozenset()))

    broken = F.when(number() % 2 == 0, F.translate("text", "e", "\x02")).otherwise(F.translate("text", "x", "\x1f"))
    return docs(spark, sf_dir).select(number().alias("id"), F.sha2(F.pandas_udf(run, "string")(broken), 256).alias("text_sha"))


_OPTIONS = "(VALUES (0, 'ffi'), (1, 'ffl'), (2, 'fi'), (3, 'fl'), (4, 'ff'), (5, 'ft'), (6, 'st')) o(place, ligature)"


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS w FROM documents), dict AS (SELECT DISTINCT lower(w) AS w FROM w), p AS (SELECT doc_id, string_split(w, CASE WHEN doc_id % 2 = 0 THEN 'st' ELSE 'en' END) AS p FROM w),
  c AS (SELECT doc_id, lower(p[i]) AS a, lower(p[i + 1]) AS b FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM p WHERE len(p) > 1) WHERE p[i] <> '' AND p[i + 1] <> ''),
  v AS (SELECT doc_id, place, ligature, count(*) AS n FROM c, {_OPTIONS} WHERE (a || ligature || b) IN (SELECT w FROM dict) GROUP BY ALL), b AS (SELECT doc_id, max(n) AS votes, arg_max(ligature, n * 10 - place) AS ligature FROM v GROUP BY doc_id),
  h AS (SELECT doc_id, count(*) AS apart FROM c WHERE length(a) > 1 AND length(b) > 1 AND a IN (SELECT w FROM dict) AND b IN (SELECT w FROM dict) GROUP BY doc_id)
  SELECT d.doc_id AS id, CASE WHEN votes >= 2 AND votes > coalesce(apart, 0) THEN ligature ELSE ' ' END AS meaning, coalesce(votes, 0)::BIGINT AS votes, coalesce(apart, 0)::BIGINT AS apart FROM (SELECT DISTINCT doc_id FROM c) d LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)""")
def a17_learned_bytes(spark, sf_dir):
    """What a lost byte stood for in each document, by the words of all documents as the word list: st in every other one, and en, which is no ligature, in the rest."""
    from quoin.operators import wordlists

    d = docs(spark, sf_dir)
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{wordlists.LETTER}]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word"))
    broken = F.when(number() % 2 == 0, F.replace("text", F.lit("st"), F.lit("\x02"))).otherwise(F.replace("text", F.lit("en"), F.lit("\x1f")))
    return wordlists.control_meanings(d.select(number().alias("id"), broken.alias("text")), words).drop("byte")


_STOP = ", ".join(f"'{w}'" for w in evaluation.SEARCH_STOP)


@query(f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text || ' The what IS more'), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), ' ') AS terms FROM benchmark")
def f28_search_terms(spark, sf_dir):
    from quoin.runtime import table

    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(evaluation.search_terms(F.concat("text", F.lit(" The what IS more"))), " ").alias("terms"))


@query("""WITH l AS (SELECT doc_id, i, '| ' || CASE WHEN doc_id % 3 = 0 THEN '**En/Beat**' ELSE 'x' END || ' | ' || string_split(text, E'\\n')[i] || ' |' AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS i FROM documents) WHERE string_split(text, E'\\n')[i] NOT LIKE '% ')
  SELECT trim(arg_min(line, CASE WHEN contains(lower(line), '**en/beat') THEN 0 ELSE 1000000000 END + doc_id * 10000 + i)) AS row FROM l WHERE contains(lower(line), 'en')""")
def f30_triage_row(spark, sf_dir):
    """A dimension's row of a triage table made of all lines of all documents: by its bold name, before rows that only mention a part of it. Each document's lines are a table of their own, in order."""
    lines = docs(spark, sf_dir).select(number().alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line")).where(~F.endswith("line", F.lit(" ")))
    row = say("| ", F.when(F.col("id") % 3 == 0, "**En/Beat**").otherwise("x"), " | ", F.col("line"), " |")
    return S.triage_row(lines.select(row.alias("text"), (F.col("id") * 10000 + F.col("i") + 1).alias("place")), "en-beat")


@query("SELECT doc_id AS id, (1 + length(text) - length(replace(text, E'\\n', '')))::INT AS pages, len(list_filter(string_split(text, E'\\n'), lambda l: len(list_filter(string_split(regexp_replace(trim(l), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) < 5))::BIGINT AS few, (1 + length(text) - length(replace(text, E'\\n', ''))) <> 7 AS control_mismatch FROM documents WHERE NOT ends_with(text, E'\\n')")
def i2_coverage(spark, sf_dir):
    """Pages of a control, those with few words, and whether there are as many as declared; lines stand for pages."""
    rows = docs(spark, sf_dir).where(~F.endswith("text", F.lit("\n"))).select(number().alias("id"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"), F.lit(7).alias("declared"))
    return ingestion.coverage(rows).select("id", "pages", F.size("empty").cast("long").alias("few"), "control_mismatch")


@query(f"SELECT doc_id AS id, sha256(E'---\\nid: ' || doc_id || E'-x\\nfile: lib/' || doc_id || E'-x.txt\\nshelf: ' || source || E'\\nzoom: ' || CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'stub' END || E'\\nsource_sha256: ' || sha256(text) || E'\\n' || CASE WHEN doc_id % 3 = 0 THEN 'framework: fw-' || doc_id || E'\\n' ELSE '' END || E'---\\n# ' || doc_id || E' x\\n\\n{ingestion.MARK}' || CASE WHEN doc_id % 2 = 0 THEN E'\\nmine ' || lang ELSE E'\\n\\n## Thin\\n_(to be written)_\\n\\n## Full\\n_(to be written)_\\n' END) AS card_sha FROM documents")
def r11_scaffold(spark, sf_dir):
    """Cards for all sources: what is managed, then what was written by hand, or stubs."""
    d = docs(spark, sf_dir).withColumn("id", say(number(), "-x"))
    sources = d.select("id", F.col("source").alias("shelf"), say("lib/", F.col("id"), ".txt").alias("rel"), F.sha2("text", 256).alias("sha256"))
    existing = d.where(number() % 2 == 0).select("id", say("old\n<!-- scaffold: managed by other — edit Thin/Full below the marker by hand -->\nmine ", F.col("lang")).alias("card"))
    frameworks = d.where(number() % 3 == 0).select(say("lib/", F.col("id"), ".txt").alias("rel"), say("fw-", number()).alias("framework"))
    made = ingestion.scaffold(sources, existing, frameworks)
    return made.select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("id"), F.sha2("card", 256).alias("card_sha"))


@query(f"SELECT doc_id AS id, ord::INT AS ord, CASE ord WHEN 0 THEN 'Cut ' || lang ELSE 'Keep' END AS name, CASE WHEN ord = 0 AND doc_id % 3 = 0 THEN 'advisory' ELSE 'required' END AS criticality, CASE ord WHEN 0 THEN 'Leave out' ELSE '' END AS guidance, CASE WHEN ord = 1 AND doc_id % 2 = 0 THEN 'unanchored' END AS problem, (CASE WHEN ord = 0 THEN 2 ELSE doc_id % 2 END)::INT AS anchors FROM documents, (VALUES (0), (1)) t(ord) WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, NULL, NULL, 'required', NULL, 'no-moves', NULL FROM documents WHERE doc_id % 5 = 0")
def r15_craft_moves(spark, sf_dir):
    """Moves of Craft sections with their anchors, advice and problems."""
    first = say("- **Cut ", F.col("lang"), ".** ", F.when(number() % 3 == 0, "[advisory] ").otherwise(""), "Leave\n  out (grep: `a ) b`; `c`).\n")
    craft = F.when(number() % 5 > 0, say("Intro\n", first, "- **Keep**", F.when(number() % 2 == 1, " (search: `d`)").otherwise(""))).otherwise("prose - **no**")
    moves = gate.craft_moves(docs(spark, sf_dir).select(number().alias("dimension"), craft.alias("craft")))
    return moves.select(F.col("dimension").alias("id"), "ord", F.when(F.col("body").isNotNull(), F.col("name")).alias("name"), "criticality", "guidance", "problem", F.when(F.col("body").isNotNull(), F.size("markers")).alias("anchors"))


_RULES = "['id-positional', 'levels', 'panel', 'nth', 'envelope', 'criticality', 'id', NULL, 'schema', 'evidence', 'statement-unknown', 'panel-empty', 'approved-digest', 'pin', 'dimension', 'panel-repeated'][doc_id % 16 + 1]"


@query(f"SELECT doc_id AS id, {_RULES} AS rule FROM documents WHERE doc_id % 16 <> 7 UNION ALL SELECT doc_id, unnest(['panel', 'types']) FROM documents WHERE doc_id % 16 = 11")
def r18_rubric_rules(spark, sf_dir):
    """One broken rule in each rubric but every sixteenth: a slot for an id, a gap in the scale, a card off the panel, #0, an envelope in a further field without its warrant, no evidence, an approval of other content, and so on."""

    def made(ids: pd.Series) -> pd.Series:
        def one(i):
            k = i % 16
            field = {"value": "v", "kind": "derived", "warrant": "w"}
            c = {"id": "C1" if k == 0 else "9x" if k == 6 else "aim", "criticality": "optional" if k == 5 else "required", "statement": {"kind": "unknown"} if k == 10 else field, "guidance": {"kind": "unknown"}, "fields": {"more": {"value": "v", "kind": "paraphrase"} if k == 4 else field}}
            c |= {"levels": [{"score": 0, "descriptor": field}, {"score": 2 if k == 1 else 1, "descriptor": field}], "evidence": [] if k == 9 else [{"card": "z" if k == 2 else "k", "phrase": "p"} | ({"nth": 0} if k == 3 else {})]}
            doc = {"schema": "criterion-spec/v2" if k == 8 else gate.SCHEMA, "dimension": f"r.{i}" if k == 14 else f"r-{i}", "panel": [] if k == 11 else ["k", "k"] if k == 15 else ["k"], "criteria": [c]}
            if k == 12:
                doc |= {"admission": "human_approved", "approved_digest": "0" * 64}
            return json.dumps(doc | ({"fingerprint": {"sources": {"k": "A" * 64}}} if k == 13 else {}))

        return ids.map(one)

    rows = gate.read_rubrics(docs(spark, sf_dir).select(F.pandas_udf(made, "string")(number()).alias("text")))
    return gate.violations(rows).select(F.substring("dimension", 3, 20).cast("long").alias("id"), "rule")


@query("""SELECT doc_id AS id, (CASE doc_id % 8 WHEN 0 THEN 'criteria[0].evidence[0].nth: boolean' WHEN 1 THEN 'criteria[0].levels[1].score: boolean' WHEN 2 THEN 'panel: names of cards, one at least' WHEN 3 THEN 'criteria[0].evidence[0].regex: not allowed' WHEN 4 THEN 'criteria[0].fields.more: string'
  WHEN 5 THEN 'rubric: no JSON, or a key is repeated' WHEN 6 THEN 'criteria[0].levels: missing; criteria[0].statement.kind: decimal' ELSE '' END) AS problems FROM documents""")
def h11_rubric_types(spark, sf_dir):
    """Rubrics of which most have a value of a wrong type: the paths of those, true being no number."""

    def made(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(i, text):
            k = i % 8
            field = {"value": text, "kind": "derived", "warrant": "w"}
            c = {"id": "aim", "statement": field | ({"kind": 1.5} if k == 6 else {}), "fields": {"more": "v" if k == 4 else field}, "evidence": [{"card": "k", "phrase": "p"} | ({"nth": True} if k == 0 else {"regex": 0} if k == 3 else {"nth": 1})]}
            c |= {} if k == 6 else {"levels": [{"score": 0, "descriptor": field}, {"score": True if k == 1 else 1, "descriptor": field}]}
            return ('{"note": 1, "note": 2, ' if k == 5 else "{") + json.dumps({"dimension": "d", "panel": [""] if k == 2 else ["k"], "criteria": [c]})[1:]

        return pd.Series([one(i, t) for i, t in zip(ids, texts, strict=True)])

    rows = docs(spark, sf_dir).select(number().alias("id"), F.pandas_udf(made, "string")(number(), F.coalesce("text", F.lit(""))).alias("text"))
    return gate.read_rubrics(rows).select("id", F.array_join(F.array_sort("problems"), "; ").alias("problems"))


@query("""SELECT doc_id AS id, sha256('{"a":[' || doc_id || ',null,true],"dimension":"d","k:' || coalesce(lang, '') || '":' || to_json(coalesce(text, ''))::VARCHAR || ',"z":{"b":"\\u001f","é":{}}}') AS digest FROM documents""")
def h2_rubric_digest(spark, sf_dir):
    """The digest of what is approved: keys in order, nothing between values, without the approval itself, whatever the text is."""
    text = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    doc = say('{ "z" : {"é" : { }, "b" : "\\u001F"}, "approved_digest": "x", "k:', F.coalesce("lang", F.lit("")), '" :', F.substr(text, F.lit(2), F.length(text) - 2), ', "dimension": "d",\n "admission": null, "a": [', number(), ", null, true ] }")
    return docs(spark, sf_dir).select(number().alias("id"), gate.body_digest(F.try_parse_json(doc)).alias("digest"))


_WHY = "['not-approved', 'not-approved', 'rule-schema', 'rule-evidence', 'panel-unpinned', 'panel-drifted', 'panel-missing', 'rule-types', NULL, NULL][doc_id % 10 + 1]"


@query(f"""WITH p AS (SELECT doc_id, text, CASE WHEN trim(w) = '' THEN 'zz' ELSE w END AS phrase FROM (SELECT doc_id, text, split_part(split_part(text, E'\\n', 1), ' ', 2) AS w FROM documents)), f AS (SELECT doc_id, {FLAT} AS flat, {sql_norm('phrase')} AS n FROM p), g AS (SELECT *, regexp_replace(flat, '-\\s*', '', 'g') AS nohy, regexp_replace(n, '-\\s*', '', 'g') AS nd FROM f),
  k AS (SELECT doc_id, CASE WHEN n = '' THEN 0 WHEN contains(flat, n) THEN (length(flat) - length(replace(flat, n, ''))) // length(n) WHEN nd = '' THEN 0 ELSE (length(nohy) - length(replace(nohy, nd, ''))) // length(nd) END AS c FROM g),
  r AS (SELECT doc_id, coalesce({_WHY}, CASE WHEN c = 0 THEN 'evidence-not-found' WHEN c > 1 THEN 'evidence-ambiguous' WHEN doc_id % 7 = 0 THEN 'scores' END) AS reason FROM k)
  SELECT doc_id AS id, CASE WHEN reason IS NOT NULL THEN 'unavailable' WHEN doc_id % 3 = 2 THEN 'go' ELSE 'recycle' END AS outcome, reason, CASE WHEN reason IS NULL THEN (doc_id % 3 * 50)::BIGINT END AS points, reason IS NULL AND doc_id % 2 = 0 AS calibrated FROM r""")
def r14_gate(spark, sf_dir):
    """A rubric for each document, citing a phrase of its text, and a draft: what isn't approved as it is, breaks a rule, isn't pinned as installed, doesn't ground once or isn't fully scored gets no verdict."""

    def made(ids: pd.Series, phrases: pd.Series, shas: pd.Series) -> pd.Series:
        def one(i, phrase, sha):
            k, field = i % 10, {"value": "v", "kind": "derived", "warrant": "w"}
            card = f"gone-{i}" if k == 6 else str(i)
            c = {"id": "aim", "statement": field, "levels": [{"score": n, "descriptor": field} for n in range(3)], "evidence": [] if k == 3 else [{"card": card, "phrase": phrase} | ({"nth": True} if k == 7 else {})]}
            doc = {"schema": "x" if k == 2 else gate.SCHEMA, "dimension": f"r-{i}", "panel": [card], "fingerprint": {"sources": {} if k == 4 else {card: "0" * 64 if k == 5 else sha}}, "criteria": [c]}
            digest = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            return json.dumps(doc | {"admission": "candidate" if k == 1 else "human_approved", "approved_digest": "0" * 64 if k == 0 else digest}, indent=1)

        return pd.Series([one(*x) for x in zip(ids, phrases, shas, strict=True)])

    word = F.split_part(F.substring_index("text", "\n", 1), F.lit(" "), F.lit(2))
    d = docs(spark, sf_dir)
    rubrics = gate.read_rubrics(d.select(F.pandas_udf(made, "string")(number(), F.when(F.trim(word) == "", "zz").otherwise(word), F.sha2("text", 256)).alias("text")))
    cards = d.select(number().cast("string").alias("card"), "text", F.sha2("text", 256).alias("stored_sha"), F.lit(None).cast("string").alias("review_by"))
    dimension = say("r-", number())
    scores = d.select(number().alias("draft"), dimension.alias("dimension"), F.when(number() % 7 == 0, "other").otherwise("aim").alias("criterion"), (number() % 3).cast("int").alias("score"))
    done = gate.review(rubrics, cards, None, scores, TODAY, calibrated=d.where(number() % 2 == 0).select(dimension.alias("dimension")))
    return done.select(F.col("draft").alias("id"), "outcome", "reason", F.col("points").cast("long").alias("points"), "calibrated")


@query("SELECT doc_id AS draft, CASE WHEN doc_id % 4 = 0 THEN 'unavailable' WHEN ((doc_id % 3) * 2 + (doc_id % 5)) * 100 >= 60 * 8 THEN 'go' ELSE 'recycle' END AS outcome, CASE WHEN doc_id % 4 = 0 THEN 'scores' END AS reason, CASE WHEN doc_id % 4 > 0 THEN (((doc_id % 3) * 2 + (doc_id % 5)) * 100 // 8)::BIGINT END AS points FROM documents")
def r14_review(spark, sf_dir):
    """Drafts against one sound rubric with two criteria of different scales: go, recycle, or unavailable where a score is missing."""
    field = {"value": "v", "kind": "derived", "warrant": "w"}
    level = lambda n: [{"score": i, "descriptor": field} for i in range(n)]
    c = lambda i, n: {"id": i, "criticality": "required", "statement": field, "guidance": field, "levels": level(n), "evidence": [{"card": "k", "phrase": "needless words"}]}
    text = "Omit needless words."
    doc = gate.pinned({"schema": gate.SCHEMA, "dimension": "d", "panel": ["k"], "criteria": [c("aim", 3), c("tone", 5)]}, {"k": hashlib.sha256(text.encode()).hexdigest()}, True)
    rubrics = gate.read_rubrics(spark.createDataFrame([(json.dumps(doc),)], "text string"))
    cards = spark.createDataFrame([("k", text)], "card string, text string").withColumn("stored_sha", F.sha2("text", 256)).withColumn("review_by", F.lit(None).cast("string"))
    scores = docs(spark, sf_dir).select(number().alias("draft"), F.lit("d").alias("dimension"), F.explode(F.filter(F.array(F.struct(F.lit("aim").alias("criterion"), (number() % 3).cast("int").alias("score")), F.when(number() % 4 > 0, F.struct(F.lit("tone").alias("criterion"), (number() % 5).cast("int").alias("score")))), lambda x: x.isNotNull())).alias("s")).select("draft", "dimension", "s.*")
    done = gate.review(rubrics, cards, None, scores, TODAY)
    return done.select("draft", "outcome", "reason", F.col("points").cast("long").alias("points"))


@query(f"SELECT doc_id AS id, doc_id % 3 > 0 AS usable, CASE WHEN doc_id % 3 > 0 THEN 2 END::INT AS line_start, CASE doc_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END::INT AS line_end, CASE doc_id % 3 WHEN 0 THEN 'folded-only' WHEN 1 THEN 'found' ELSE 'folded-only' END AS status FROM documents")
def f10_folded_spans(spark, sf_dir):
    """Where phrases stand: on a line, over two lines, or over a hyphen, which can't be placed."""
    d = say(number())
    text = F.when(number() % 3 == 0, say("start\nkey", d, " hyphen-\nated\nend")).when(number() % 3 == 1, say("start\nkey", d, " one\nend")).otherwise(say("start\nkey", d, " two\n  words\nend"))
    phrase = F.when(number() % 3 == 0, say("key", d, " hyphenated")).when(number() % 3 == 1, say("key", d, " one")).otherwise(say("key", d, " two words"))
    rows = docs(spark, sf_dir).select(number().alias("id"), text.alias("text"), grounding.marker(phrase).alias("marker"), F.lit("").alias("stored_sha"), F.lit(None).cast("string").alias("review_by"))
    return grounding.evidence_context(rows, TODAY, around=0).select("id", "usable", "line_start", "line_end", "status")


@query("SELECT doc_id AS id, doc_id % 7 AS n, array_to_string(list_transform(range(0, doc_id % 7), lambda i: 'note ' || i), ';') AS phrases FROM documents")
def f4_many_markers(spark, sf_dir):
    """As many anchors as a card has, in all spellings, in order."""
    spelled = ("(grep: `note 0`)", "(search: \"note 1\")", "(`grep: \"note 2\"`", "; `note 3`", "(`grep:` `note 4`)", "(search: `note 5`)")
    body = F.concat_ws(" ", *[F.when(number() % 7 > i, F.lit(s if i != 3 else s)) for i, s in enumerate(spelled)])
    m = parse_markers(F.replace(body, F.lit(" ; "), F.lit("; ")))
    return docs(spark, sf_dir).select(number().alias("id"), m.alias("m")).select("id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["phrase"]), ";").alias("phrases"))


@query("SELECT doc_id AS id, sha256('{\"id\":\"' || doc_id || '\",\"title\":\"t\",\"aliases\":\"' || lang || '\",\"zoom\":\"thin\"}') AS meta_sha FROM documents")
def h10_meta_level(spark, sf_dir):
    rows = docs(spark, sf_dir).select(number().cast("string").alias("id"), F.lit("t").alias("title"), F.col("lang").alias("aliases"), F.lit("thin").alias("zoom"))
    return S.zoom(rows, "meta").select(F.col("id").cast("long").alias("id"), F.sha2("body", 256).alias("meta_sha"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 4 = 1 THEN 'abstained' WHEN doc_id % 4 = 2 THEN 'unverified' ELSE 'verified' END AS state, CASE doc_id % 4 WHEN 0 THEN 'containment,inflation-low' WHEN 2 THEN 'containment,inflation-low' ELSE '' END AS reasons FROM documents")
def i7_verify_extraction(spark, sf_dir):
    """Extractions against their control, made of numbered words: half of it fails, or is accepted unverified; without a control it abstains; the same verifies."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i.cast("string"), F.lit("x"), number().cast("string"))), " ")
    rows = docs(spark, sf_dir).select(number().alias("id"), F.when(number() % 4 != 1, words).alias("control"), F.when(number() % 2 == 0, F.substring_index(words, " ", 30)).otherwise(words).alias("candidate"), F.lit(None).cast("int").alias("declared"), F.lit(None).cast("array<int>").alias("pages"), (number() % 4 == 2).alias("accepted"))
    return ingestion.verify_extractions(rows).select("id", "state", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT rater, draft::BIGINT AS draft, criterion, n::BIGINT AS n FROM (SELECT 'ann' AS rater, doc_id AS draft, unnest(['aim', 'tone']) AS criterion, 1 AS n FROM labels)")
def s26_rating_sheet(spark, sf_dir):
    """A rater's sheet written as JSON lines and read back: a row for each draft and criterion, unscored."""
    from quoin.runtime import table

    field = {"value": "v", "kind": "derived", "warrant": "w"}
    c = lambda i: {"id": i, "statement": field, "guidance": field, "levels": [{"score": k, "descriptor": field} for k in range(3)], "evidence": []}
    drafts = table(spark, sf_dir, "labels").select(number().cast("string").alias("draft"), number().cast("string").alias("text"))
    at = scratch(spark, "sheet")
    gate.sheet({"dimension": "d", "panel": ["k"], "criteria": [c("aim"), c("tone")]}, drafts, "ann").orderBy("ord").select("line").write.text(at)
    header, rows = library.rating_sheet(spark, at)
    told = durable(rows.where("score is null").join(header.select("rater"), how="cross"), "rows")
    return told.groupBy("rater", F.col("draft").cast("long").alias("draft"), "criterion").agg(F.count("*").alias("n"))
