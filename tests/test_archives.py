"""Archives by ranges: plans, kinds, parts, errors."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quoin.runtime import ship
from quoin.sources import archives, formats

CONTAINER = '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>'


def zipped(files, packed=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", packed) as z:
        for k, v in files.items():
            z.writestr(k, v)
        z.comment = comment
    return out.getvalue()


def epub(chapters, **more):
    items = "".join(f'<item id="i{n}" href="{n}.html"/>' for n in range(len(chapters)))
    order = "".join(f'<itemref idref="i{n}"/>' for n in reversed(range(len(chapters))))
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "c.opf": f"<package><manifest>{items}</manifest><spine>{order}</spine></package>"} | {f"{n}.html": c for n, c in enumerate(chapters)}, **more)


def docx(lines):
    return zipped({"[Content_Types].xml": "<t/>", "word/document.xml": '<d xmlns:w="w">' + "".join(f"<w:p><w:t>{x}</w:t></w:p>" for x in lines) + "</d>"}, zipfile.ZIP_DEFLATED)


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, data in files.items():
            at = tmp_path / name.replace("__", "/")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(data)
        return str(tmp_path)

    return write


def test_plan_packs_small_files_and_cuts_large_ones():
    mb = 1 << 20
    plan = archives.planned([("b", 10 * mb), ("a", 100), ("c", 0), ("d", 3 * mb)], 4 * mb)
    flat = [r for p in plan for r in p.ranges]
    assert flat == [("a", 0, 100), ("b", 0, 4 * mb), ("b", 4 * mb, 8 * mb), ("b", 8 * mb, 10 * mb), ("c", 0, 1), ("d", 0, 3 * mb)]
    assert [len(p.ranges) for p in plan] == [1, 1, 1, 2, 1]
    assert archives.planned([], mb)[0].ranges == []


def test_every_member_is_of_one_range(spark, folder):
    ship(spark)
    chapters = [f"<p>chapter {n} {'x' * (3000 * (n % 4))}</p>" for n in range(40)]
    root = folder(big__book=epub(chapters), small=epub(["<p>one</p>", "<p> </p>"]))
    for split in (500, 10_000, 1 << 26):
        got = archives.texts(spark, root, splitBytes=split)
        rows = sorted((r.path, r.part, r.text) for r in got.collect())
        want = [("big/book", n, formats.html_text(c)) for n, c in enumerate(reversed(chapters))] + [("small", 1, "one")]
        assert rows == sorted(want)
        listed = archives.members(spark, root, splitBytes=split)
        assert listed.count() == 43 + 5 == listed.select("path", "member").distinct().count()
        assert got.rdd.getNumPartitions() > 10 if split == 500 else got.rdd.getNumPartitions() >= 1
    with zipfile.ZipFile(os.path.join(root, "big/book")) as z:
        assert {(i.filename, i.header_offset, i.file_size) for i in z.infolist()} == {(r.member, r.at, r.size) for r in listed.where("path = 'big/book'").collect()}


def test_blocks_of_paragraphs_join_to_the_text(spark, folder):
    ship(spark)
    lines = [f"line {n} " + "w" * 5000 for n in range(500)] + ["", "y" * 1_500_000, "end"]
    data = docx(lines)
    got = sorted((r.part, r.text) for r in archives.texts(spark, folder(d=data)).collect())
    assert len(got) > 3 and "\n".join(t for _, t in got) == "\n".join(lines) == formats.docx_text(data)


def test_what_cannot_be_read_is_a_row(spark, folder):
    ship(spark)
    broken = bytearray(epub(["<p>good</p>", "<p>torn apart</p>"]))
    at = broken.index(b"torn apart")
    broken[at : at + 4] = b"TORN"
    root = folder(
        not_zip=b"PK\x03\x04 nothing", empty=b"", hollow=zipped({}), leaves=zipped({"../x": "1", "word/document.xml": "<a/>"}), other=zipped({"a.txt": "application/epub+zip word/document.xml"}), no_spine=zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "c.opf": "<package/>"}),
        torn=bytes(broken), bomb=zipped({"word/document.xml": "<a>" + " " * 3_000_000 + "</a>"}, zipfile.ZIP_DEFLATED), _hidden=b"x", unclosed=zipped({"word/document.xml": "<a><p><t>x</t></p>"}),
    )
    rows = archives.texts(spark, root, most=1_000_000, splitBytes=64).collect()
    by = {(r.path, r.part): r for r in rows}
    assert len(by) == len(rows) and {r.path for r in rows} == {"not_zip", "empty", "hollow", "leaves", "other", "no_spine", "torn", "bomb", "unclosed"}
    assert by["torn", 1].text == "good" and "CRC" in by["torn", 0].error
    for name, word in (("not_zip", "zip"), ("empty", "zip"), ("hollow", "no known kind"), ("leaves", "unsafe"), ("other", "no known kind"), ("no_spine", "spine"), ("bomb", "too much")):
        assert by[name, None].kind is None and word in by[name, None].error
    assert by["unclosed", 0].text is None and by["unclosed", 0].error
    with pytest.raises(Exception, match="nowhere"):
        archives.texts(spark, root + "/nowhere").collect()
    os.mkdir(root + "/none")
    assert archives.texts(spark, root + "/none").count() == 0


def test_kind_by_the_directory_alone(spark):
    inner = zipped({"mimetype": "application/epub+zip", "word/document.xml": "<a/>"})
    rows = [
        ("epub", epub(["x"])), ("epub", epub(["x"], comment=b"a comment PK")), ("epub", zipped({"first": "x" * 70_000, "mimetype": " application/epub+zip\r\n"})), ("docx", docx(["x"])), ("docx", zipped({"a": "b" * 200_000, "word/document.xml": "<a/>"})),
        ("docx", zipped({"mimetype": "text/plain", "word/document.xml": "<a/>"})), (None, zipped({"a": inner + b"."})), (None, zipped({"x/word/document.xml": "<a/>", "word/document.xmlx": ""})), (None, epub(["x"])[:-30]), (None, b"PK\x03\x04"),
        (None, zipped({"a": "b"})[:-22] + b"PK\x05\x06" + b"\xff" * 18),
    ]
    df = spark.createDataFrame([(n, k, bytearray(d)) for n, (k, d) in enumerate(rows)], "n int, kind string, content binary")
    assert [r.told for r in df.orderBy("n").select(formats.sniffed(F.col("content")).alias("told")).collect()] == [k for k, _ in rows]


def test_a_paragraph_within_another_follows_it():
    xml = b"<d><p><t>a</t><box><p><t>in</t></p></box><t>b</t></p><p><t>c</t></p></d>"
    assert list(formats.paragraphs(io.BytesIO(xml))) == ["ainb", "in", "c"]
