"""Near-duplicate documents: MinHash signatures, bands, verification on full sets, components.

A-Z are lower-cased; words are runs of anything but ASCII white space; a document's set holds its distinct k-word shingles, or its whole word sequence when it has fewer words.
Two documents are linked when 100 * |A and B| >= percent * |A or B|. Sets hold 64-bit hashes of shingles.

160 minima of universal hashes make 40 bands of 4: a pair at 0.8 shares no band with probability (1 - 0.8^4)^40 < 1e-9. Pairs of a band are never all listed:
  1. each bucket's members are held against its smallest one; of those a document keeps the pair with most bands;
  2. components; then the other such pairs whose ends are in different components;
  3. components; then, only in buckets that still hold several components, the members outside the bucket's largest component are held against the others. A pair is
     made only if an exact bound allows it: with c the largest component's document, |x and y| is at most the lesser |x and c| and |y and c| and the lesser number of
     other shingles that any two of c's companions share. In a large group of copies with edits of their own, hardly any pair passes that isn't linked.
Each step drops pairs only by bounds: set sizes, and 1 bit of each minimum (a pair at 0.8 differs in 16 of 160 bits on average, sd 3.8; 44 may differ), then the full sets decide.
Pairs within one component aren't checked, as they change no component. Equal sets are one node from the start, so copies never meet in a bucket.

Null or empty texts have an empty set and link with nothing; very long ones are held one at a time. Rows of one doc_id are one node. A row whose doc_id is null goes by a key made of
its text (below NO_ID, where no doc_id may lie): it is linked like others but never names a component. Where no row with a doc_id is linked with it, component_id is null and it is
kept, else it isn't. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.graphs import components
from quoin.runtime import arrow_limits, durable, worker_cache

BANDS, ROWS, BITS_MOST, CACHE, FILE, MEMBERS = 40, 4, 44, 150_000, 40_000, 64
NO_ID = -(1 << 62)
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = worker_cache("hashes of words", CACHE)
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    s = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        s = _mixed((s + h[i : len(h) - n + 1 + i]) * _MIX[i])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """160 minima of a*x + b over the set, each 32 bits."""
    x, out = s >> np.uint64(32), None
    for i in range(0, len(x), 1024):
        y = _A * x[None, i : i + 1024]
        y += _B
        least = y.min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out >> np.uint64(32)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            n, digests, bands, bits = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), bits.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = minima(s)
                key = salt.copy()
                for i in range(ROWS):
                    key = _mixed((key + m.reshape(BANDS, ROWS)[:, i]) * _MIX[i + 8])
                bands.append(key.view(np.int64))
                bits.append(np.packbits(np.append(m & np.uint64(1), np.zeros(-len(m) % 64, np.uint64)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _held_against(schema: pa.Schema, columns: list[str]):
    """Runs one(sa, sb) for rows (a, block, b, text) in which the text of a comes first in its block (b null), then those of its b; what one returns goes beside a and b, None drops the row."""

    def make(k: int, one):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, sa = None, None
            for batch in batches:
                out: list[tuple] = []
                for a, block, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if b is None:
                        at, sa = (a, block), shingle_set(text, k)
                    elif at == (a, block) and (got := one(sa, shingle_set(text, k))) is not None:
                        out.append((a, b, *got))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(c).type) for i, c in enumerate(columns)], names=columns)

        return run

    return make


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DIFFERENCE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int32()), ("novel", pa.list_(pa.int64()))])


def _confirm(k: int, percent: int):
    """Pairs whose sets are to be linked."""

    def one(sa: np.ndarray, sb: np.ndarray) -> tuple | None:
        both = len(np.intersect1d(sa, sb, assume_unique=True))
        return () if 100 * both >= percent * (len(sa) + len(sb) - both) > 0 else None

    return _held_against(_LINK, ["a", "b"])(k, one)


def _differences(k: int):
    """Of pairs (a, b): shingles of b that a has, and the others."""

    def one(sa: np.ndarray, sb: np.ndarray) -> tuple:
        has = np.isin(sb, sa, assume_unique=True)
        return int(has.sum()), sb[~has].view(np.int64)

    return _held_against(_DIFFERENCE, ["a", "b", "both", "novel"])(k, one)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds on sizes and bits; both are met by every pair that is to be linked (the bits but for a chance below 1e-10)."""
    differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(-(-BANDS * ROWS // 64))), F.lit(0))
    return (F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent) & (differ <= BITS_MOST)


def key_of(doc_id: Column, text: Column) -> Column:
    """The doc_id, or for rows without one a number of their text below NO_ID."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) - 1 - F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, block, b, text): each b's text once a pair, and a's once for each block of MEMBERS of its pairs or so, before them; so a centre's text doesn't travel with every member."""
    pairs = pairs.select("a", "b")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    own = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    members = own.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "block", "b", "text")
    centres = blocks.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    return members.unionAll(centres).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), key (key_of the row)."""
    arrow_limits(docs.sparkSession)
    docs = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = durable(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "signed")
    files = max(4, signed.count() // FILE)  # of the smaller tables
    classes = durable(signed.where("digest is not null").groupBy("digest").agg(F.coalesce(F.min(F.when(F.col("doc_id") > NO_ID, F.col("doc_id"))), F.min("doc_id")).alias("rep"), F.count("*").alias("copies")), "classes", files)
    nodes = durable(
        signed.join(classes.where("rep is not null").select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits", "bands"), "nodes"
    )
    rows = nodes.select("rep", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center != last").select("band", "center")
    buckets = durable(rows.join(full, "band"), "buckets", files)  # band, rep, center; only buckets of several documents
    told = nodes.select("rep", F.struct("n", "bits").alias("s"))

    def beside(pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) that may be linked."""
        both = pairs.join(told.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(told.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
        return both.where(_may_link("x", "y", percent)).drop("x", "y")

    stars = durable(beside(buckets.where("rep != center").groupBy(F.col("center").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("shared"))), "pairs", files)

    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = durable(docs.repartition("doc_id").join(involved, "doc_id", "left_semi"), "texts", files)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return durable(with_texts(pairs, texts).mapInArrow(_confirm(k, percent), "a long, b long"), "links", files)

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = confirmed(best)
    comp = components(links, files=files)

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """pairs whose ends are in different components."""
        named = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))

    left = durable(across(stars.join(best, ["a", "b"], "left_anti"), comp).select("a", "b"), "across", files)
    if not left.isEmpty():
        links = links.unionAll(confirmed(left))
        comp = components(links, files=files)

    named = buckets.select("band", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    parts = named.groupBy("band", "c").agg(F.count("*").alias("size"))
    several = parts.groupBy("band").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    mixed = durable(named.join(several, "band").join(told, "rep"), "mixed", files)
    refs = mixed.select(F.col("main").alias("a"), F.col("rep").alias("b")).distinct()
    against = durable(with_texts(refs, texts).mapInArrow(_differences(k), "a long, b long, both int, novel array<long>"), "differences", files)
    novel = against.select("a", "b", F.explode("novel").alias("t"))
    known = novel.groupBy("a", "t").agg(F.count("*").alias("times")).where("times > 1").select("a", "t")
    shared = novel.join(known, ["a", "t"]).groupBy("a", "b").agg(F.count("*").cast("int").alias("more"))
    bounds = against.select("a", "b", "both").join(shared, ["a", "b"], "left").select(F.col("a").alias("main"), F.col("b").alias("rep"), "both", F.coalesce("more", F.lit(0)).alias("more"))
    mixed = mixed.join(bounds, ["main", "rep"]).where((F.col("both") + F.col("more")) * 100 >= F.col("s.n") * percent)
    mixed = mixed.join(nodes.select("rep", "bands"), "rep")
    mixed = durable(mixed.select("band", "rep", "c", "main", F.struct("s.n", "s.bits", "both", "more", "bands").alias("s")), "bounded", files)
    few, all_ = mixed.where("c != main").select("band", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("s").alias("y")), mixed.select("band", F.col("rep").alias("a"), F.col("c").alias("ca"), "main", F.col("s").alias("x"))
    reach = (F.least("x.both", "y.both") + F.least("x.more", "y.more")) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    once = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True) == F.array_position("x.bands", F.col("band"))  # in the first band that both have
    crossing = few.join(all_, "band").where("ca != cb and (ca = main or a < b)").where(reach & _may_link("x", "y", percent) & once).select("a", "b").distinct()
    crossing = durable(crossing.join(stars.select("a", "b"), ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "crossing", files)
    if not crossing.isEmpty():
        links = links.unionAll(confirmed(crossing))
        comp = components(links, files=files)

    named = comp.groupBy("component").agg(F.min(F.when(F.col("node") > NO_ID, F.col("node"))).alias("name"))  # the smallest that is a doc_id
    linked = classes.join(comp.withColumnRenamed("node", "rep").join(named, "component"), "rep", "left").where("copies > 1 or component is not null")
    linked = linked.select("digest", F.coalesce("name", F.when(F.col("rep") > NO_ID, F.col("rep"))).alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(linked, "digest", "left")
    doc_id = F.when(F.col("doc_id") > NO_ID, F.col("doc_id"))
    component = F.coalesce("component", doc_id)
    return out.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"), F.col("doc_id").alias("key"))
