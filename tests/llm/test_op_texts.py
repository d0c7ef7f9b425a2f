"""Operators that go through texts one by one, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoin.llm import bpe, fingerprints, langid, licenses, packing, token_counts
from quoin.llm.queries import BYTE_BPE, MULTI_BPE, WORD_BPE


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_fingerprints(odd_docs):
    docs = texts_of(odd_docs.withColumn("text", F.coalesce("text", F.lit(""))).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    got = fingerprints.fingerprints(odd_docs).collect()
    assert len(got) == len(docs) and sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in docs)
    by = {}
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)]
        n = len(t) // 4
        by.setdefault(d, set()).add((len(t), hashlib.sha256((t[: len(t) - n] + following[1][:n]).encode()).hexdigest(), fingerprints.fingerprint(t)))
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) in by[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["edits"] == []) == (r["fingerprint"] == r["edited_fingerprint"] or r["edited_sha256"] == hashlib.sha256(b"").hexdigest())


def test_fingerprint_tells_texts_apart():
    a = "One line here, and more.\n\nSecond part. With words!\nThird line of it.\n" * 5
    assert fingerprints.fingerprint(a) == fingerprints.fingerprint(a) != fingerprints.fingerprint(a + " ")
    b = a.replace("Second", "Changed", 1)
    (span,) = fingerprints.edits(a, b)
    assert "Changed" in b[slice(*span)] and len(b[slice(*span)]) < 60
    assert fingerprints.edits(a, a) == [] and 0.9 < fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) < 1
    root, sections = fingerprints.tree(a)
    assert sum(s[1] for s in sections) == len(a) and sum(len(p[2]) for s in sections for p in s[2]) == 32 * len(fingerprints.LEAF.findall(a))


def test_likeness_by_brute_force():
    """Descent through the trees against the pieces of both texts as they are: never more, and hardly less. Edits hold every character that changed."""
    import random
    from collections import Counter

    rng = random.Random(7)
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ",", ".", ".\n", "!\n\n"]) for _ in range(rng.randint(1, 400))]
        changed = [("new" if rng.random() < 0.05 else w) for w in words if rng.random() > 0.03]
        a, b = " ".join(words), " ".join(changed)
        x, y = (Counter(fingerprints.LEAF.findall(t)) for t in (a, b))
        whole = 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))
        near = fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
        assert near <= whole + 0.01 and near >= whole - 0.1 and (near == 1) == (a == b)
        spans = fingerprints.edits(a, b)
        kept = {line.strip() for line in a.split("\n")}
        for m in re.finditer(r"[^\n]+", b):
            if m[0].strip() and m[0].strip() not in kept:  # changed lines, but for the spaces between them
                assert any(s <= m.start() + len(m[0]) - len(m[0].lstrip()) and m.start() + len(m[0].rstrip()) <= e for s, e in spans)


def test_empty_tables(no_docs):
    assert not rows(fingerprints.fingerprints(no_docs)) and not rows(bpe.encode(no_docs, MULTI_BPE, P.PATTERN)) and not rows(licenses.licenses(no_docs))
    assert not rows(langid.languages(no_docs)) and not rows(langid.kept(no_docs)) and not rows(packing.pack(packing.pieces(no_docs, WORD_BPE)))
    assert not rows(token_counts.token_counts(no_docs, ["text"], BYTE_BPE, P.PATTERN))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(MULTI_BPE), special_tokens={})


def test_bpe(odd_docs, encoding):
    want = []
    for d, t in texts_of(odd_docs):
        ids = encoding.encode_ordinary(t)
        data = np.array(ids, "<u4").tobytes()
        want.append((d, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), data))
    got = [(*r[:4], bytes(r[4])) for r in rows(bpe.encode(odd_docs, MULTI_BPE, P.PATTERN))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_bpe_of_words_in_spark(spark, encoding):
    """The fold in higher-order functions: the same ids, and the words again."""
    words = ["the", " tion", "ouwhea", "é", " 中文字", "🙂", "", "x" * 95, "ab" * 200, "\n\n"]
    df = spark.createDataFrame([(bytearray(w.encode()),) for w in words], "word binary")
    got = {bytes(r["word"]).decode(): (r["ids"], bytes(r["piece"])) for r in bpe.encode_words(df, MULTI_BPE).collect()}
    assert got == {w: (encoding.encode_ordinary(w), w.encode()) for w in words}


def test_long_words_merge_alike(encoding):
    ranks = bpe.ranks_of(MULTI_BPE)
    for w in ("a" * 700, "abcd" * 90, "ouwhetion" * 50, "éü" * 80):
        assert bpe.merged(w.encode(), ranks) == encoding.encode_ordinary(w)


def test_token_counts(odd_docs):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(BYTE_BPE), special_tokens={})
    assert token_counts.token_counts(odd_docs, ["n.x"], BYTE_BPE, P.PATTERN).count() == odd_docs.count()
    got = token_counts.token_counts(odd_docs, ["source", "text"], BYTE_BPE, P.PATTERN).collect()
    sums = {}
    for r in got:
        sums.setdefault(r["doc_id"], []).append(r)
    for r in odd_docs.where("doc_id >= 100 or doc_id in (2, 6, 8, 11)").select("doc_id", "source", "text").collect():
        whole = f"{r['source'] or ''}\n{r['text'] or ''}"
        own = sums[r["doc_id"]]
        assert sum(x["n_tokens"] for x in own) == len(enc.encode_ordinary(whole)) == pytest.approx(sum(x["token_share"] for x in own))
        assert min(x["start"] for x in own) == 0 and max(x["end"] for x in own) == len(whole)


def test_boundary_crossing_tokens():
    """A token over a boundary counts where it begins, and its share is split by bytes."""
    text = "ab  \n\n\ncd"
    n, share, crossing = token_counts.attribute(text, token_counts.sections(text), BYTE_BPE, P.PATTERN)
    ends = token_counts.token_bytes(text, BYTE_BPE, P.PATTERN).cumsum()
    starts = token_counts.sections(text)
    spans = list(zip([0, *ends], ends))
    own = [sum(a >= s and a < e for a, _ in spans) for s, e in zip(starts, [*starts[1:], len(text)])]
    parts = [sum(max(0, min(b, e) - max(a, s)) / (b - a) for a, b in spans) for s, e in zip(starts, [*starts[1:], len(text)])]
    assert n.tolist() == own and share.tolist() == pytest.approx(parts)
    assert crossing.sum() == sum(any(a < s < b for s in starts) for a, b in spans) > 0


def test_language_id(odd_docs, spark):
    import random

    random.seed(2)
    alphabets = {"aa": ["bar", "bor", "tan", "nat"], "bb": ["ilk", "kel", "quu", "vix"]}
    text = lambda k: " ".join("".join(random.choice(alphabets[k]) for _ in range(2)) for _ in range(30))
    data = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(200)] + [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (None, text("aa"), "aa")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in data[:200])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"] and got[1001]["score"] == 0
    blind = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.languages(blind).collect()} == {k: r["lang_pred"] for k, r in got.items()}
    assert {r["doc_id"] for r in langid.kept(docs).collect()} == set(got) - {1000, 1001, 1002}
    assert langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") < 6, F.lit(None)).otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang"] for r in langid.kept(wrong).collect()} == {k: r["lang_pred"] for k, r in got.items() if r["lang_pred"] != "und"}
    assert langid.kept(odd_docs).columns == odd_docs.columns and langid.kept(odd_docs).count() <= odd_docs.count()
    assert langid.languages(odd_docs).count() == odd_docs.count()


def test_texts_without_letters_go_where_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, None), (3, "12 !!", " "), (4, "", None), (None, "é", None), (None, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in langid.kept(docs).collect()) == ["words", "é"]


def test_language_id_of_many_labels(spark):
    """No label is dropped or shrunk: more labels than a group holds, those that are rarest too, in a script of their own or not."""
    import random

    random.seed(4)
    data = []
    for k in range(70):
        alphabet = [chr(0x0430 + i) for i in range(32)] if k == 69 else "abcdefghijklmnopqrstuvwxyz"
        words = ["".join(random.choice(alphabet) for _ in range(4)) for _ in range(8)]
        data += [(100 * k + i, " ".join(random.choice(words) for _ in range(40)), f"l{k:02}") for i in range(5 if k > 60 else 8)]
    data += [(9000, None, "l01"), (9001, "12 !!", None), (None, data[0][1], None), (1, data[1][1], "l00")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = langid.learn(docs)
    assert len(sample) == 70
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"]) for r in langid.languages(docs, sample).collect())
    assert got == sorted([(d, k) for d, _, k in data[:-4]] + [(9000, "und"), (9001, "und"), (-1, "l00"), (1, "l00")])
    assert all(0 <= r["score"] <= 1 for r in langid.languages(docs, sample).collect())
    clashing = docs.withColumn("lang_pred", F.lit(1)).withColumn("row", F.lit("r")).withColumn("r", F.lit("r"))
    told = langid.kept(clashing.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))))
    assert told.columns == clashing.columns and sorted((str(r["doc_id"]), r["lang"]) for r in told.collect()) == sorted((str(d), k) for d, k in [(-1, "l00") if d is None else (d, k) for d, _, k in data[:-4]] + [("None", "l00"), (1, "l00")])
    few = dict(list(sample.items())[:9])
    own = docs.where("doc_id < 900")
    want = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in own.select("doc_id", "text").mapInArrow(langid._predict(few), "doc_id long, lang_pred string, score double").collect()}
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.languages(own, few).collect()} == want


def test_large_alphabets_are_told_apart(spark):
    """Two invented languages in thousands of letters each, of which no sample has all; letters that no sample has speak for neither."""
    import random

    random.seed(6)
    letters = {"xx": [chr(0x4E00 + i) for i in range(3000)], "yy": [chr(0x6000 + i) for i in range(3000)]}
    shared = [chr(0x4E00 + i) for i in range(0, 3000, 7)]
    text = lambda k: " ".join("".join(random.choice(letters[k] + shared) for _ in range(3)) for _ in range(25))
    docs = spark.createDataFrame([(i, text("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(240)], "doc_id long, text string, lang string")
    got = langid.languages(docs).join(docs, "doc_id").where(langid.held_out(F.col("doc_id")))
    assert got.count() > 40 and got.where("lang_pred != lang").count() == 0


def test_rows_without_id_are_learned_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"some text number {'abcdefghij'[i % 10] * (1 + i % 37)} and more of it", "xx") for i in range(900)], "doc_id long, text string, lang string")
    assert 0 < len(langid.learn(docs, docs=4)["xx"].split("some")) - 1 <= 8


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")) & (F.col("lang_pred") != "und"))
    assert both.count() > 200 and both.where("lang_pred = lang").count() >= 0.98 * both.count()


def test_whole_licences_and_own_templates(spark):
    from quoin.llm.license_texts import TEXTS

    docs = [(i, f"some words before it\n{t}\nand after", label) for i, (label, _, t) in enumerate(TEXTS)] + [(100, "The licence of our house: keep the doors closed at night and feed the cat", "house"), (101, "nothing of the kind", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, want string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.licenses(df).collect()}
    assert all(want in got[i] for i, _, want in docs[:-2]) and got[100] == got[101] == [""]
    assert "bsd-3-clause" not in got[1]
    own = licenses.licenses(df, [("house", "keep the doors closed", "keep the doors closed at night and feed the cat"), ("none", "x", "")])
    assert {r["doc_id"] for r in own.where("labels like '%house%'").collect()} == {100}


def test_phrases_by_brute_force():
    """The automata's parse against a search for the longest match at each place."""
    sample = {"aa": "abracadabra abba", "bb": "cadillac adac bac"}
    symbols, flat, roots = langid._model(sample)
    width, langs = symbols.width, sorted(sample)
    for text in ("abracad", "cadabra lacb", "x abc", "dddd", "z"):
        row, n = symbols.of(text)
        assert n == len(text)
        got = langid.phrases([row], width, flat, roots)[:, 0].tolist()
        want = []
        for k in langs:
            n, at = 0, 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in sample[k]:
                    size += 1
                at, n = at + (size if text[at] in sample[k] else 1), n + 1
            want.append(n)
        assert got == want


def test_packing(odd_docs):
    tok = Tokenizer.from_file(WORD_BPE)
    tok.encode_special_tokens = True
    want = []
    for d, t in texts_of(odd_docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want += [(d, p, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(packing.pieces(odd_docs, WORD_BPE)).collect()
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))
    _packed(got, 2048)


def _packed(got, capacity):
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_is_close_to_the_least(spark):
    """Sizes of many kinds: all pieces once, gapless, and hardly more sequences than their ids need, or than best-fit one by one takes."""
    import random
    from bisect import bisect_left, insort

    rng = random.Random(3)
    kinds = {"mixed": [rng.randint(1, 100) for _ in range(2000)], "hot": [34] * 700 + [rng.randint(1, 60) for _ in range(900)], "large": [rng.randint(51, 100) for _ in range(300)], "one size": [40] * 101, "tiny": [1] * 500 + [100], "few": [7]}
    for name, sizes in kinds.items():
        gaps: list[int] = []
        for n in sorted(sizes, reverse=True):
            i = bisect_left(gaps, n)
            left = (gaps.pop(i) if i < len(gaps) else 100) - n
            insort(gaps, left)
        rows = spark.createDataFrame([(i % 7 or None, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(rows, 100).collect()
        assert sorted((r["ids_crc32"], r["length"]) for r in got) == list(enumerate(sizes))
        assert _packed(got, 100) <= max(len(gaps) * 1.02 + 1, -(-sum(sizes) // 100)), name


def test_a_sweep_takes_the_smallest_gap_that_holds(spark):
    """Against pieces one by one, the largest first, each in the smallest gap that is left and holds it."""
    import random

    rng = random.Random(4)
    for salts in (1, 3):
        pieces = [(i, rng.randint(1, 40)) for i in range(120)]
        slots = [(i, rng.randint(1, 40), i, 0) for i in range(90)]
        left, want = sorted(s for _, s, *_ in slots), []
        for _, n in sorted(pieces, key=lambda p: -p[1]):
            fit = [g for g in left if g >= n]
            if fit:
                left.remove(fit[0])
                want.append((n, fit[0]))
        own = {i: s for i, s, *_ in slots}
        got = packing.sweep(spark.createDataFrame(pieces, "id long, size long"), spark.createDataFrame(slots, "id long, size long, seq long, slot int"), salts).collect()
        assert sorted((r["size"], own[r["seq"]]) for r in got) == sorted(want)
        assert len({r["seq"] for r in got}) == len(got) and all(dict(pieces)[r["id"]] == r["size"] for r in got)


def test_licences(spark, odd_docs):
    data = [(1, "All rights\nreserved. x ALL RIGHTS RESERVED"), (2, "under CC BY-NC 4.0"), (3, "GNU General Public License, version 3"), (4, "apache says nothing"), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and related files, to deal in the Software without restriction"), (6, None), (7, "all rights are reserved")]
    got = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (2, 0, 4, "reserved", 1.0)
    assert got[2]["labels"] == "cc-by,cc-by-nc" and got[3]["base_labels"] == "gpl" and got[4]["labels"] == "" and got[5]["labels"] == "mit"
    assert (got[6]["n_words"], got[6]["first_word"], got[6]["labels"], got[6]["score"]) == (0, None, "", 0.0) and got[7]["n_base"] == 0
    for r in licenses.licenses(odd_docs).where("doc_id >= 2").collect():
        t = next(t for d, t in texts_of(odd_docs) if d == r["doc_id"])
        assert r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
