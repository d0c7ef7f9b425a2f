"""Turn reassembly, the n-gram join and vector codes, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import codes, licenses, ngram_join, queries, reassembly
from quoin.llm.neardup import shingle_set


def replayed(rows):
    """Events of turns (conv_id, turn, role, text), one arrival after another."""
    sha = lambda s: hashlib.sha256(s).hexdigest()
    first, came = {}, [{} for _ in range(10)]
    for c, t, r, x in rows:
        if t is None:
            continue
        first[c] = min(first.get(c, t), t)
        h = int(sha(f"{'' if c is None else c}:{t}".encode())[:8], 16)
        for b, role in [(h % 10, r or "")] + ([((h + 5) % 10, "user")] if h % 7 < 2 else []):
            p = (f"{role}|{x or ''}".encode(), role)
            came[b][c, t] = min(came[b].get((c, t), p), p)
    events, kept, released, last, closed = [], {}, {}, {}, set()

    def close(c, b):
        closed.add(c)
        own = kept[c]
        left = ",".join(map(str, sorted(set(own) - released[c])))
        breaks = sum(t - 1 in own and own[t - 1][1] == own[t][1] for t in own)
        events.append(("close", c, -1, b, sha(left.encode()), max(own) - first[c] + 1 - len(own), breaks))

    for b in range(10):
        for (c, t), p in came[b].items():
            if c in closed:
                events.append(("reject", c, t, b, sha(p[0]), None, None))
                continue
            kept.setdefault(c, {}).setdefault(t, p)
            released.setdefault(c, set())
            last[c] = b
        for c in kept:
            t = first[c]
            while c not in closed and t in kept[c]:
                if t not in released[c]:
                    released[c].add(t)
                    events.append(("release", c, t, b, sha(kept[c][t][0]), None, None))
                t += 1
        for c in kept:
            if c not in closed and b - last[c] >= 2:
                close(c, b)
    for c in kept:
        if c not in closed:
            close(c, 10)
    return sorted(map(str, events))


def told(df):
    return sorted(str(tuple(r)) for r in df.select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect())


def test_reassembly(spark):
    """Nulls in every column, repeated rows, large gaps, negative and huge numbers, a bar in a role, columns with clashing names; and one conversation with most rows."""
    rng = random.Random(3)
    some = rng.choice
    rows = [(some([None, 1, 2, 3, 4, 5, -7, 2**62]), some([None, -3, -2, 0, 1, 2, 3, 4, 5, 6, 9, 10**15]), some(["user", "assistant", None, "a|b"]), some([None, "", "x", "é🙂", "|y", "z" * 5000])) for _ in range(200)]
    rows += [(99, t, some(["user", "assistant"]), f"t{t}") for t in range(300) if t != 250] + rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("batch", F.lit("q")).withColumn("first", F.lit(1)).withColumn("bucket", F.lit(2))
    out = reassembly.reassembled(df, 4)
    assert told(reassembly.digests(out)) == replayed(rows)
    released = out.where("event = 'release' and conv_id = 99").select("turn", "text").collect()
    assert {r["turn"]: r["text"] for r in released} == {r["turn"]: f"t{r['turn']}" for r in released} and len(released) > 100
    assert out.where("event = 'close' and conv_id = 99").first()["turns"] is not None
    assert reassembly.reassembled(df.where("false"), 4).count() == 0


def test_reassembly_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.QUERIES["op11_reassembly"](spark, "/root/testdata/sf0.01")) == replayed(rows)


def classes(rows, k, percent):
    sets, up, by, ids = [set(shingle_set((t or "").encode(), k).tolist()) for _, t in rows], list(range(len(rows))), {}, {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for g in x:
            by.setdefault(g, []).append(i)
        if (d := rows[i][0]) is not None:
            up[top(i)] = top(ids.setdefault(d, i))
    for i, x in enumerate(sets):
        for j in {j for g in x for j in by[g] if j < i}:
            both = len(x & sets[j])
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(str((d, len(sets[i]), least.get(top(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("rare, percent", [(12, 85), (2, 85), (3, 60)])
def test_ngram_join(spark, monkeypatch, rare, percent):
    """Groups of near copies with edits of their own, one passage in many documents, short texts, nulls and repeated rows: the same classes, whatever counts as frequent."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rng = random.Random(percent + rare)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(60)
    for size in (1, 2, 5, 12, 40, 150, 400):
        base = text(size)
        for _ in range(rng.choice([3, 20, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [" ".join(passage + text(rng.choice([1, 2, 3, 5, 8, 12, 100]))) for _ in range(60)]
    rows += [" ".join(passage[: rng.choice([50, 55, 60])] + [f"q{rng.randrange(3)}"]) for _ in range(30)] + [" ".join(text(rng.choice([1, 2, 3, 4, 30]))) for _ in range(40)]
    data = list(enumerate(rows)) + [(0, rows[0]), (1, rows[-1]), (None, rows[5]), (None, rows[-1] + " x y"), (None, None), (9000, None), (9001, ""), (9002, " \n"), (-4, rows[70].upper())]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rep", F.lit("r")).withColumn("sig", F.lit(1)).withColumn("n", F.lit("n"))
    assert sorted(str(tuple(r)) for r in ngram_join.jaccard_components(df, 4, percent).collect()) == classes(data, 4, percent)
    assert ngram_join.jaccard_components(df.where("false")).count() == 0


def test_bounds_of_codes_lose_no_entry():
    rng = np.random.default_rng(4)
    for width, high in ((8, 50), (8, 5000), (3, 4), (1, 9), (16, 2**26), (5, 1)):
        x, book = rng.integers(-high, high + 1, (500, width)), rng.integers(-high, high + 1, (16, width))
        x[:16] = book
        kept: list[int] = []
        at, far = codes.nearest(x, book, kept)
        every = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (far == every.min(1)).all()
        assert kept[-1] <= kept[0] <= 500 * 16
    clustered = (rng.integers(0, 16, 500)[:, None] * 1000 + np.arange(8) * 300 + rng.integers(0, 20, (500, 8))).astype(np.int64)
    codes.nearest(clustered, np.unique(clustered, axis=0)[:: len(np.unique(clustered, axis=0)) // 16][:16], kept)
    assert kept[-1] < 0.5 * 500 * 16  # most pairs get no exact distance


def test_vector_codes(spark):
    rng = random.Random(7)
    data = [(i, rng.choice([None, 1, 2]), [rng.uniform(-1, 1) for _ in range(16)]) for i in range(120)] + [(3, 1, [0.5] * 16), (None, None, [0.25] * 16), (200, 1, None), (201, 2, [1.0, None] + [0.0] * 14), (202, 2, [float("nan")] * 16), (203, 2, [float("inf")] * 16), (204, 9, [0.5] * 5), (205, 9, [1e30] * 16), (206, 9, [])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("c")).withColumn("error", F.lit(1))
    most = int((2.0**61 / 16) ** 0.5)
    sound = [(i, label, [max(-most, min(most, math.floor(4096 * x))) for x in v + [0.0] * (16 - len(v))]) for i, label, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, _, v in sound:
        key = (i is None, i or 0)
        firsts[key] = min(firsts.get(key, v), v)
    books = [[firsts[k][2 * p : 2 * p + 2] for k in sorted(firsts)[:16]] for p in range(8)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[2 * p : 2 * p + 2], e)), n) for n, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            at = [near(p, v)[1] for _, _, v in sound]
            for n in range(16):
                if own := [v[2 * p : 2 * p + 2] for (_, _, v), a in zip(sound, at) if a == n]:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own)]
    found = [[near(p, v) for p in range(8)] for _, _, v in sound]
    errors = {}
    for (_, label, _), f in zip(sound, found):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), errors[label], sha) for (i, label, _), f in zip(sound, found)]
    assert sorted(str(tuple(r)) for r in codes.compressed(df).collect()) == sorted(map(str, want))
    assert codes.compressed(df.where("false")).count() == 0
    assert {r["code"] for r in codes.compressed(df.where("vec_id < 3")).collect()} == {"00" * 8, "01" * 8, "02" * 8}


def test_a_template_without_its_key_is_refused(spark):
    df = spark.createDataFrame([(1, "keep the doors closed at night")], "doc_id long, text string")
    with pytest.raises(ValueError):
        licenses.licenses(df, [("house", "open the doors", "keep the doors closed at night and feed the cat")])


def test_places_of_base_phrases_by_regular_expressions(spark):
    """n_base, first_word and last_word of whole documents, of which many get a phrase put in."""
    import re

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(1)
    put = ["CC-BY", "General  Public\nLicense", "all rights reserved", "cc by by cc/by", "general public", "All Rights Reserved all rights reserved."]
    rows = [(d, (t[: (at := rng.randrange(len(t) + 1))] + " " + rng.choice(put) + " " + t[at:]) if d % 3 else t) for d, t in docs]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower())
        line = b" " + b" ".join(words) + b" "
        places = [(line[: m.start() + 1].count(b" ") - 1, label) for p, label in ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved")) for m in re.finditer(b"(?= " + p + b" )", line)]
        at = [p for p, _ in places]
        assert got[d] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), d
    assert sum(v[1] > 0 for v in got.values()) > 50
