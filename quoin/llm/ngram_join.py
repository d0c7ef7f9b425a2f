"""N-gram Jaccard join by token-combination prefixes; documents with their components.

A-Z are lower-cased; words are runs of anything but ASCII white space; a document's set holds its distinct k-word shingles (tokens), or its whole word sequence when it has fewer words. Two documents
link when 100 * |A and B| >= percent * |A or B|. The join is exact but for 64-bit hashes of tokens. Equal sets are one node from the start.

Tokens have one order everywhere: those of the rare class first, then those of the frequent class, each by hash. A set of n tokens has to share at least a = ceil(percent * n / 100) with any partner, so
partners share a token among the first n - a + 1 of both (their prefixes).
  1. Of each set the first tokens by hash are written, a few more than a prefix takes. A token that more than RARE sets have there is frequent; so is one that more than RARE of the sets have anywhere whose
     prefix holds such tokens. Any fixed class of frequent tokens gives right results; a good one keeps buckets small.
  2. A set whose prefix holds rare tokens alone is indexed by those, one by one. If either partner is such a set, the token they share is rare.
  3. Else the set's prefix is extended by as many tokens as may differ between partners (and two): floor((100 - percent) * n / percent) + 2. Partners of this kind share a rare token, or so many frequent ones that two
     of them stand next to each other among the frequent tokens of both. So rare tokens are indexed singly, and frequent ones by combinations of two neighbours: an index linear in the text.
  4. Buckets of the index aren't listed pair by pair: members are held against one centre. Pairs pass bounds on sizes, on the tokens before and after the shared one (for combinations: on frequent
     tokens, as those that share rare ones meet elsewhere), and on parities: with a bit for each residue of token hashes that occurs an odd number of times, sets differ by at least as many tokens as bits.
     Survivors are verified on full sets; first each set's pair with most shared buckets, then, across the components so found, the rest.
  5. Only buckets that still hold several components hold their other members against these, salted by size, and only where one of the two has enough frequent tokens for any link; the same bounds apply within the
     join, and verification and components follow. Pairs within a component change nothing.

Null or empty texts have an empty set and link with nothing; very long ones are held one at a time. Rows of one doc_id are one document, linked with whatever one of its texts is linked with. A row whose
doc_id is null is linked like others but never names a component; where no row with a doc_id is linked with it, component_id is null. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.graphs import components
from quoin.llm.neardup import NO_ID, _mixed, key_of, shingle_set, with_texts
from quoin.runtime import arrow_limits, durable

RARE, SPARE, FILE, SALTED = 12, 4, 40_000, 128


def prefix_size(n: int, percent: int) -> int:
    """Tokens among which a set of n shares one with any partner."""
    return n - -(-percent * n // 100) + 1


def reach(n: int, percent: int) -> int:
    """By how much the prefix of a set with frequent tokens is extended."""
    return (100 - percent) * n // percent + 2


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of tokens by residue, at least one bit a token, as a power of two of longs."""
    bits = 64 << max(0, (len(s) - 1) // 64).bit_length()
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n = len(s)
                window = s[: prefix_size(n, percent) + SPARE * n // 100 + 4] if n else None
                out.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), window.view(np.int64), parities(s)) if n else (0, None, None, None))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=["doc_id", "n", "digest", "window", "odd"])

    return run


def _tokens(k: int):
    """All tokens of texts, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                s = shingle_set(batch.column(1)[i].as_py(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["rep", "tokens"])

    return run


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set in the order of hashes: its signatures in an extended prefix, and the place of each: that of a rare token, or less than 0 for a combination, by the number of frequent tokens."""
    hot = np.isin(tokens, frequent)
    rare, often, n = tokens[~hot], tokens[hot], len(tokens)
    length = prefix_size(n, percent) - 1 + reach(n, percent)
    rare = rare[:length]
    often = often[: max(0, length - len(rare))]
    pairs = _mixed(_mixed(often[:-1]) + often[1:])
    return np.concatenate([rare, pairs]), np.concatenate([np.arange(len(rare)), np.full(len(pairs), -int(hot.sum()))])


_INDEX = "sig long, rep long, n int, place int"


def _extended(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tokens = batch.column(1)[i].values.to_numpy().view(np.uint64)
                frequent = batch.column(2)[i]
                sig, place = signatures(tokens, frequent.values.to_numpy().view(np.uint64) if frequent.is_valid else tokens[:0], percent)
                same = lambda v, kind: pa.array(np.full(len(sig), v, kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), same(batch.column(0)[i].as_py(), np.int64), same(len(tokens), np.int32), pa.array(place.astype(np.int32))], names=["sig", "rep", "n", "place"])

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(k: int, percent: int):
    """Pairs to be linked, of rows (a, block, b, text) in which the texts of a come first in its block (b null), then those of its b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            out = []
            for a, block, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = shingle_set(text, k)
                if b is None:
                    at, own = (a, block), [*own, s] if at == (a, block) else [s]
                elif at == (a, block) and any(100 * (both := len(np.intersect1d(x, s, assume_unique=True))) >= percent * (len(x) + len(s) - both) > 0 for x in own):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], schema=_LINK)

    return run


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two parities differ; of different lengths (one is twice the other) the longer is folded."""
    count = lambda short, long: F.aggregate(F.transform(short, lambda v, i: F.bit_count(v.bitwiseXOR(F.get(long, i)).bitwiseXOR(F.when(F.size(long) > F.size(short), F.get(long, i + F.size(short))).otherwise(F.lit(0).cast("long"))))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(x) <= F.size(y), count(x, y)).otherwise(count(y, x))


def _near(x: str, y: str, both: Column, percent: int) -> Column:
    """Whether parities allow a link of sets with so many tokens in all: 100 * shared >= percent * joint, as what differs is the joint less the shared."""
    lengths = F.least(F.size(x), F.size(y)) * 2 >= F.greatest(F.size(x), F.size(y))
    return lengths & (_differ(F.col(x), F.col(y)) * (100 + percent) <= both * (100 - percent))


def _may_share(x: str, y: str, percent: int) -> Column:
    """Bounds on what two members of a bucket share: tokens before and after a shared rare one; for combinations, no more than either's frequent ones."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
    most = F.when(px < 0, F.least(-px, -py)).otherwise(F.least(px, py) + F.least(nx - px, ny - py))
    return F.least(most, nx, ny) * (100 + percent) >= (nx + ny) * percent


def prefixes(docs: DataFrame, nodes: DataFrame, k: int, percent: int, files: int) -> DataFrame:
    """(sig, rep, n, place): the index, from nodes (rep, n, window) and the texts (doc_id, text) of those whose prefix holds frequent tokens."""
    each = nodes.select("rep", F.explode("window").alias("token"))
    size = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")

    def known(frequent: DataFrame) -> DataFrame:
        """(rep, n, rare): rare tokens that make the prefix; null where frequent ones are needed."""
        hit = each.join(frequent, "token", "left_semi").groupBy("rep").agg(F.collect_set("token").alias("hot"))  # at most a window
        told = nodes.select("rep", "n", "window").join(hit, "rep", "left").withColumn("rare", F.when(F.col("hot").isNull(), F.col("window")).otherwise(F.array_except("window", "hot")))
        return told.select("rep", "n", F.when(F.size("rare") >= size, F.slice("rare", F.lit(1), size)).alias("rare"))

    def whole(reps: DataFrame) -> DataFrame:
        return docs.join(reps.where("rare is null").select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_tokens(k), "rep long, tokens array<long>")

    many = lambda tokens: tokens.groupBy("token").count().where(F.col("count") > RARE).select("token")
    first = durable(many(each), "frequent", files)
    more = many(whole(known(first)).select(F.explode("tokens").alias("token")))
    frequent = durable(first.unionAll(more).distinct(), "frequent", files)
    told = durable(known(frequent), "prefixes")
    full = durable(whole(told), "tokens")
    hot = full.select("rep", F.explode("tokens").alias("token")).join(frequent, "token", "left_semi").groupBy("rep").agg(F.collect_set("token").alias("hot"))
    simple = told.select("rep", "n", F.posexplode("rare").alias("place", "sig")).select("sig", "rep", F.col("n").cast("int").alias("n"), "place")
    return simple.unionAll(full.join(hot, "rep", "left").mapInArrow(_extended(percent), _INDEX))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included)."""
    arrow_limits(docs.sparkSession)
    docs = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = durable(docs.mapInArrow(_sign(k, percent), "doc_id long, n long, digest binary, window array<long>, odd array<long>"), "sets")
    files = max(4, signed.count() // FILE)  # of the smaller tables
    classes = durable(signed.where("digest is not null").groupBy("digest").agg(F.coalesce(F.min(F.when(F.col("doc_id") > NO_ID, F.col("doc_id"))), F.min("doc_id")).alias("rep"), F.count("*").alias("copies")), "classes", files)
    own = signed.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "window", "odd")
    nodes = durable(own.dropDuplicates(["rep", "window", "n"]), "nodes")
    index = durable(prefixes(docs, nodes, k, percent, files), "index")
    member = F.struct("rep", "n", "place")
    shared = index.groupBy("sig").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least != most").select("sig")
    own = durable(index.join(shared, "sig", "left_semi"), "shared")  # of several sets
    centre = own.groupBy("sig").agg(F.min_by(member, F.struct(F.when(F.col("place") < 0, F.col("place") / F.col("n")).otherwise(F.lit(0.0)), "rep")).alias("x"))
    buckets = durable(own.join(centre, "sig").select("sig", "x", member.alias("y")), "buckets")
    odd = nodes.select("rep", "odd")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb, ...) that parities allow."""
        both = pairs.join(odd.select(F.col("rep").alias("a"), F.col("odd").alias("p")), "a").join(odd.select(F.col("rep").alias("b"), F.col("odd").alias("q")), "b")
        return both.where(_near("p", "q", F.col("na") + F.col("nb"), percent)).drop("p", "q")

    found = buckets.where(F.col("x.rep") != F.col("y.rep")).where(_may_share("x", "y", percent)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    stars = durable(bounded(ordered.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))).groupBy("a", "b").agg(F.max("shared").alias("shared")), "pairs", files)

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = durable(docs.join(ids, "doc_id", "left_semi"), "texts")
        return durable(with_texts(pairs, texts).mapInArrow(_confirm(k, percent), "a long, b long"), "links", files)

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """pairs whose ends are in different components."""
        named = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = confirmed(best.select("a", "b"))
    comp = components(links, files=files)
    left = durable(across(stars.join(best, ["a", "b"], "left_anti"), comp), "across", files)
    if not left.isEmpty():
        links = links.unionAll(confirmed(left))
        comp = components(links, files=files)

    named = buckets.select("sig", "y", F.col("y.rep").alias("rep")).join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", "y", F.coalesce("component", "rep").alias("c"))
    sizes = named.groupBy("sig", "c").agg(F.count("*").alias("size"))
    several = sizes.groupBy("sig").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("size")).where("parts > 1").select("sig", "main", F.ceil(F.col("size") / SALTED).cast("int").alias("salts"))
    strong = (F.col("y.place") >= 0) | (-F.col("y.place") * (100 + percent) >= F.col("y.n") * 2 * percent)  # of combinations: two sets with fewer frequent tokens can't link
    mixed = durable(named.join(several, "sig").join(odd.withColumnRenamed("rep", "its rep"), F.col("y.rep") == F.col("its rep")).withColumn("y", F.struct("y.rep", "y.n", "y.place", "odd")).drop("odd", "its rep").withColumn("strong", strong), "mixed")
    few = mixed.where("c != main").select(F.col("sig").alias("own sig"), F.col("y").alias("x"), F.col("c").alias("cx"), F.pmod(F.xxhash64("y.rep"), F.col("salts")).cast("int").alias("own salt"), F.explode(F.when(F.col("strong"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("meets"))
    all_ = mixed.select("sig", "y", "c", "main", "strong", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    able = _may_share("x", "y", percent) & _near("x.odd", "y.odd", F.col("x.n") + F.col("y.n"), percent)
    met = few.join(all_, F.expr("`own sig` = sig and `own salt` = salt and meets = strong and cx != c and (c = main or x.rep < y.rep)") & able)
    met = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    crossing = durable(met.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "crossing", files)
    if not crossing.isEmpty():
        links = links.unionAll(confirmed(crossing))
        comp = components(links, files=files)

    name = comp.groupBy("component").agg(F.min(F.when(F.col("node") > NO_ID, F.col("node"))).alias("name"))  # the smallest that is a doc_id
    linked = classes.join(comp.withColumnRenamed("node", "rep").join(name, "component"), "rep", "left").where("copies > 1 or component is not null")
    linked = linked.select("digest", F.coalesce("name", F.when(F.col("rep") > NO_ID, F.col("rep"))).alias("component"))
    doc_id = F.when(F.col("doc_id") > NO_ID, F.col("doc_id"))
    return signed.select("doc_id", "n", "digest").join(linked, "digest", "left").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", doc_id).alias("component_id"))
