"""Operators that compare rows, against brute force; and the pipeline."""

import base64
import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quoin.llm import graphs, knn, neardup, substring, warc
from quoin.runtime import scratch


def classes(docs, k, percent):
    """Components by all pairs of rows; rows of one id are one node."""
    sets, up = [], {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (top(d), len(s)) for d, s in sets if d is not None}


def edited(words, share, rng):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of copies with edits of their own around the threshold, a chain, a passage that many share, and texts of their own."""
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    base = [word() for _ in range(200)]
    texts = [" ".join(edited(base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]), rng)) for _ in range(120)]
    chain = [word() for _ in range(150)]
    for _ in range(10):
        chain = edited(chain, 0.02, rng)
        texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 100))) for _ in range(60)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(copies, k, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 4 if k == 5 else neardup.MEMBERS)
    want = classes([tuple(r) for r in copies.collect()], k, 80)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(copies, k).collect()}
    assert got == want and len(set(c for c, _ in want.values())) < len(want)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    want = classes([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 4, 80)
    got = neardup.near_duplicates(odd_docs, 4).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] == (3 if r["n_shingles"] else None) and r["kept"] == (r["component_id"] is None)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_without_ids(spark):
    """Edited copies without a doc_id are linked by way of each other; the document with one names the group, and a group without any has no name."""
    rng = random.Random(9)
    base, other = ([f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(2))
    chain = [base]
    for _ in range(3):
        chain.append([*chain[-1]])
        chain[-1][40 * len(chain)] = f"new{len(chain)}"
    alone = [*other[:-1], "end"]
    rows = [(None, " ".join(c)) for c in chain[:3]] + [(70, " ".join(chain[3])), (None, " ".join(other)), (None, " ".join(alone)), (None, " ".join(other)), (None, None), (5, "some text of its own")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len(got) == len(rows) and sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("None", "70", False)] * 3 + [("70", "70", True)] + [("None", "None", True)] * 4 + [("5", "5", True)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = list(range(2000))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for a, b in edges if a != b for n in (a, b)}


def test_substrings(spark, odd_docs, no_docs):
    passage = "This passage of many words comes again in other texts, as it was planted there. It has a second sentence, so that units follow each other in a run of them! Ok. And a third with still some more words than that, for it needs to be as long as a passage has to be."
    data = [(3, f"Own beginning of a text. {passage} Own end."), (1, f"First holder. {passage.upper()} Its own end."), (2, "A clean text of its own.\nOk. It stays."), (4, f"{passage}\n{passage} Tail."), (5, None), (6, ""), (7, "A clean text of its own."), (8, "Ok. " * 200)]
    rows = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.substring_dedup(rows).collect()}
    assert all(got[d]["text"] == dict(data)[d] and got[d]["removed"] == [] for d in (1, 2, 7, 8))
    assert got[3]["text"] == "Own beginning of a text. Own end."
    (span,) = got[3]["removed"]
    assert dict(data)[3][span["start"] : span["end"]].strip() == passage
    assert got[4]["text"] == "Tail." and got[5]["text"] is None and got[6]["text"] == ""
    out = substring.substring_dedup(odd_docs, more=("gone", "units"))
    assert out.columns == [*odd_docs.columns, "gone", "units"] and out.count() == odd_docs.count()
    clashing = substring.substring_dedup(odd_docs)
    assert clashing.columns == [*odd_docs.columns, "removed_", "n_units"] and clashing.count() == odd_docs.count()
    assert substring.substring_dedup(no_docs).count() == 0
    twice = spark.createDataFrame([(1, f"{passage}\n{passage} Tail.")], "doc_id long, text string")
    assert substring.substring_dedup(twice).first()["removed"] == [] and substring.substring_dedup(twice, within=True).first()["text"] == f"{passage}\nTail."


@pytest.mark.parametrize("sentences", [True, False])
def test_substrings_by_brute_force(spark, sentences):
    """Of runs of 50 words that stand in a document of smaller id, wherever they begin and end, with and without sentence ends, nearly all words go; next to nothing else does."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        ends = (lambda: (". " if rng.random() < 0.1 else ".\n" if rng.random() < 0.03 else "").rstrip(" ")) if sentences else (lambda: "")
        return " ".join(w + ends() for w in words)

    planted = [prose(rng.randint(51, 120 if sentences else 60)) for _ in range(60)]
    docs = {i: f"{prose(rng.randint(3, 150))} {rng.choice(planted) if i % 2 else ''} {prose(rng.randint(3, 40))}\nRead more here" for i in range(300)}
    docs[300] = docs[1].replace(" ", "  ")
    words = {d: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)] for d, t in docs.items()}
    seen, again = {}, {}
    for d, own in words.items():
        again[d] = [False] * len(own)
        for i in range(len(own) - 49):
            if seen.setdefault(tuple(w[2] for w in own[i : i + 50]), d) != d:
                again[d][i : i + 50] = [True] * 50
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    kept_again = other_gone = 0
    for d, own in words.items():
        at, kept = 0, ""
        for s in got[d]["removed"]:
            kept, at = kept + docs[d][at : s["start"]], s["end"]
        assert kept + docs[d][at:] == got[d]["text"]
        gone = [any(s["start"] <= w[0] and w[1] <= s["end"] for s in got[d]["removed"]) for w in own]
        kept_again += sum(a and not g for a, g in zip(again[d], gone))
        other_gone += sum(g and not a for a, g in zip(again[d], gone))
    assert sum(map(sum, again.values())) > 5000
    assert kept_again <= 0.01 * sum(map(sum, again.values())) and other_gone <= 0.002 * sum(map(len, words.values()))


def test_repeated_lines(spark):
    """by="lines" removes every line that stands earlier, whatever its length, and keeps its first place."""
    data = [(1, "Read more\nOne text.\n\nx"), (2, "READ  more!\nAnother text."), (3, "Other.\nRead more\nx"), (None, "Read more"), (None, "Read more")]
    got = sorted((r["doc_id"] or 9, r["text"]) for r in substring.substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), by="lines").collect())
    assert got == [(1, data[0][1]), (2, "Another text."), (3, "Other.\n"), (9, ""), (9, "")]


def test_lines_of_whole_documents_by_sql(spark):
    """Every line of every document against SQL: hot lines and repeats within a document too, with within=True."""
    con = duckdb.connect()
    want = con.execute("""WITH l AS (SELECT doc_id, i, t[i] AS line, array_to_string(regexp_extract_all(lower(t[i]), '[\\p{L}\\p{N}]+'), ' ') AS words FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t
      FROM '/root/testdata/sf0.001/documents.parquet'))), f AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS r FROM l) SELECT doc_id, coalesce(string_agg(words, ' ' ORDER BY i) FILTER (r = 1 AND words <> ''), '') FROM f GROUP BY doc_id""").fetchall()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = substring.substring_dedup(docs, by="lines", within=True).collect()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    assert {r["doc_id"]: plain(r["text"]) for r in got} == {d: " ".join(w.split()) for d, w in want}
    hot = spark.createDataFrame([(i, f"Read more about this and that here today now\nown {i}\nown {i}") for i in range(40)], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in substring.substring_dedup(hot, by="lines", within=True).collect()}
    assert sum("Read more" in t for t in kept.values()) == 1 and all(t.count(f"own {i}") == 1 for i, t in kept.items())


def test_knn(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(600)] + [(600 + i, [0.1] * 16) for i in range(12)]
    data += [(700, None), (750, [1.0] * 15 + [float("nan")]), (800, [1.0] * 15 + [float("inf")]), (850, [1.0, None] + [0.0] * 14), (900, [0.5, 0.5]), (7, [0.3] * 16), (None, [1.0] * 16), (950, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    sound = [(i, np.floor(256 * np.array(list(v) + [0.0] * (16 - len(v))))) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in sound:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in sound if j != i)[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(r) for r in knn.top_k(df).collect()} == want
    assert knn.top_k(df.where("vec_id = 50")).count() == 0 and knn.top_k(df.limit(0)).count() == 0
    assert knn.top_k(df.where("vec_id in (50, 51, 52)")).count() == 2


def test_knn_sends_less_where_data_has_a_shape(spark, monkeypatch):
    """Clusters in directions of their own: fewer copies than groups of queries, and still every best."""
    monkeypatch.setattr(knn, "GROUP", 5)
    rng = np.random.default_rng(5)
    data = [(i, (np.eye(16)[i % 8] * 4 + rng.normal(0, 0.05, 16)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    copies, groups = knn.replication(df)
    assert groups >= 8 and copies < 0.5 * groups
    whole = np.floor(256 * np.array([v for _, v in data]))
    want = {(i, n + 1, j, -s) for i in range(0, 1600, 50) for n, (s, j) in enumerate(sorted((-int(x), j) for j, x in enumerate(whole @ whole[i]) if j != i)[:5])}
    assert {tuple(r) for r in knn.top_k(df).collect()} == want


def test_knn_of_small_tables(spark):
    """Tables so small that the k-th best score is negative."""
    rng = np.random.default_rng(3)
    for n in (6, 7, 8, 9, 10):
        data = [(i, rng.normal(0, 1, 16).tolist()) for i in range(n)]
        whole = [np.floor(256 * np.array(v)) for _, v in data]
        best = sorted((-int(whole[0] @ whole[j]), j) for j in range(1, n))[:5]
        got = {tuple(r) for r in knn.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
        assert got == {(0, i + 1, j, -s) for i, (s, j) in enumerate(best)}, n


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choice("abc <>") for _ in range(300_000))
    pages = [(5, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "u", None), (4, "u", ""), (7, "u", big), (8, "u", big), (8, "u", big), (None, "u", "<p>x</p>"), (11, "u", "é\r\n\r\n WARC/1.1")]
    pages += [(100 + i, f"http://h/{i}", f"<html>{i % 30} page</html>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("d", F.lit("x")).withColumn("refers", F.lit(1))
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None))
    assert sorted(map(str, map(tuple, warc.round_trip(df).collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0
    only_large = warc.round_trip(df, least_bytes=1000).where("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in only_large} == {8}


def test_warc_payloads_and_dictionary(spark):
    to = scratch(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>some page {i} with words</body></html>") for i in range(50)], "page_id long, url string, html string").coalesce(1)
    assert warc.write_archives(pages, to) == 50
    got = warc.read_archives(spark, to)
    assert {bytes(r["payload"]).decode() for r in got.collect()} == {r["html"] for r in pages.collect()}
    content = bytes(spark.read.format("binaryFile").load(to + "/*.warc.zst").first()["content"])
    assert struct.unpack_from("<I", content)[0] == warc.SKIPPABLE_DICTIONARY
    dictionary, found = warc.frames(content)
    assert dictionary and len(found) == 50
    a, b = found[0]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(content[a:b])


def test_warc_problems():
    good = warc.record(1, "u", b"hello", None)
    assert warc.parse(good)["problem"] is None and warc.parse(good)["payload"] == b"hello"
    assert warc.parse(good.replace(b"hello", b"hellO"))["problem"] == "payload digest"
    assert warc.parse(good[:-1])["problem"] == "length or end of record"
    assert warc.parse(re.sub(rb"WARC-Date: [^\r]*\r\n", b"", good))["problem"] == "missing warc-date"
    assert warc.parse(b"HTTP/1.1\r\n\r\n")["problem"] == "version or headers"
    assert warc.parse(warc.record(1, "u", b"hello", 0))["record_type"] == "revisit"
    for bad in (b"\x00" * 20, zstandard.ZstdCompressor().compress(good)[:-3], b"abc"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            warc.frames(bad)


def test_pipeline(spark, tmp_path, odd_docs):
    import corpus_pipeline as c

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns, name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 1 not in left and 2 not in left and 8 not in left and 4 not in left and {3, 9, 10, 11} <= set(left)
    packed = c.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(left)
