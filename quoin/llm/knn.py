"""Exact top-k inner products by a Voronoi kNN join.

Components become whole numbers floor(scale * x), so scores are exact. PIVOTS vectors (a bounded sample, by a hash of the id) split space into cells; queries and data go to
their nearest pivot. Summaries of the data's cells hold the few vectors closest to each pivot; a query's k-th best score among those is a lower bound of its k-th best of all.
Queries of a cell form groups of about GROUP, by their number; cells of fewer queries share one. With u the direction of a cell's pivot, it is known of each group's queries in the
cell: their least and largest length along u, their largest length R across it, the radius r (largest distance to the pivot p), and the bound (the least of theirs). For such a q and any x with length b
along u and c across it, q.x is at most max(least * b, largest * b) + R * c (Cauchy-Schwarz across u), and at most p.x + r|x|; x is sent to the group, once, only if
the lesser reaches the bound of one of its cells. replication() tells how many copies of the data that sends; it is below the number of groups where the data has any shape. Each group's data is dealt over salted parts
of bounded size, solved locally in blocks, and the parts' best are merged.

Rows whose vector is null, or holds null or non-finite components, take no part. Shorter vectors count as if filled with zeros. Rows of a repeated vec_id are all
candidates but for the query's own id; a repeated query is answered once for each different vector. Ties go to the smaller vec_id. Null ids are no queries and no candidates.
An empty table, or one without queries, gives no rows; texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, durable

PIVOTS, GROUP, PART, NEAR, BLOCK = 16, 4096, 16_384, 8, 2_000_000


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers as doubles, filled with zeros to width."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy() - column.offsets.to_numpy()[0]
    out = np.zeros((len(column), width))
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    for i in range(len(column)):
        out[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: by doubles while all sums are below 2**53, else by Python's whole numbers."""
    if not len(q) or not len(x) or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
    return whole(q) @ whole(x).T


def _best(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, vec_id, score) of the k best of every query, ties to smaller ids; scores are held for BLOCK pairs at a time."""
    order = np.argsort(x_id, kind="stable")  # then equal scores stay in the order of ids
    x_id, x = x_id[order], x[order]
    step = max(1, BLOCK // max(1, len(x_id)))
    for at in range(0, len(q_id), step):
        s = scores(q[at : at + step], x)
        for i, own in enumerate(q_id[at : at + step]):
            row = s[i]
            able = np.flatnonzero(x_id != own)
            if len(able) > 4 * k:
                least = np.partition(row[able], len(able) - k)[len(able) - k]
                able = able[row[able] >= least]
            for j in able[np.argsort(-row[able], kind="stable")[:k]]:
                yield at + i, int(x_id[j]), int(row[j])


def replication(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> tuple[float, int]:
    """How many copies of the data top_k sends on average, and how many groups of queries there are."""
    plan = _plan(vectors, k, every, scale)
    return (plan["sent"].count() / plan["n"], plan["groups"]) if plan else (0.0, 0)


def _plan(vectors: DataFrame, k: int, every: int, scale: int) -> dict | None:
    """The queries in their groups, and the data as it is sent to them; None without queries."""
    spark = vectors.sparkSession
    arrow_limits(spark, 4096)
    v = F.col("embedding")
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True)) & F.col("vec_id").isNotNull()
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("q")).first()
    n, width, queries = facts["n"], facts["width"] or 0, facts["q"] or 0
    if not queries or not width:
        return None
    share = min(1.0, 4.0 * PIVOTS / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v", "vec_id").collect()
    sample = sorted(sample, key=lambda r: r["vec_id"])[:: max(1, len(sample) // PIVOTS)][:PIVOTS]
    pivots = np.zeros((max(1, len(sample)), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    units = pivots / np.maximum(np.sqrt((pivots * pivots).sum(1)), 1e-12)[:, None]

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
        cell = d.argmin(1)
        return cell, np.sqrt(np.maximum(d[np.arange(len(x)), cell], 0))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The NEAR vectors of each cell that are closest to its pivot, in this part of the data."""
        held: dict[int, list] = {}
        for batch in batches:
            x = _dense(batch.column(1), width)
            cells, far = nearest(x)
            for i, c in enumerate(cells.tolist()):
                held.setdefault(c, []).append((far[i], batch.column(0)[i].as_py(), x[i].tolist()))
            held = {c: sorted(r, key=lambda t: t[:2])[:NEAR] for c, r in held.items()}
        flat = [(c, *r) for c, own in held.items() for r in own]
        yield pa.RecordBatch.from_pydict({"cell": pa.array([r[0] for r in flat], pa.int32()), "far": pa.array([r[1] for r in flat], pa.float64()), "vec_id": pa.array([r[2] for r in flat], pa.int64()), "v": pa.array([r[3] for r in flat], pa.list_(pa.float64()))})

    found = rows.mapInArrow(summary, "cell int, far double, vec_id long, v array<double>").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))).where(F.col("r") <= NEAR).collect()
    known_id, known = np.array([r["vec_id"] for r in found]), np.array([r["v"] for r in found])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _dense(batch.column(1), width)
            cells, far = nearest(q)
            s = scores(q, known).astype(float)
            s[batch.column(0).to_numpy()[:, None] == known_id[None, :]] = -np.inf
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            along = (q * units[cells]).sum(1)
            across = np.sqrt(np.maximum((q * q).sum(1) - along * along, 0))
            columns = [batch.column(0), batch.column(1), pa.array(cells, pa.int32()), *map(pa.array, (far, along, across, least))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cell", "far", "along", "across", "least"])

    asked = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(bound, "vec_id long, v array<double>, cell int, far double, along double, across double, least double")
    asked = durable(asked, "queries")
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS
    first, total, room = {}, 0, 0
    for c in sorted(counts, key=lambda c: (-counts[c], c)):  # cells over GROUP get groups of their own, others share some
        own = -(-counts[c] // GROUP)
        if own == 1 and counts[c] <= room:
            first[c], room = total - 1, room - counts[c]
        else:
            first[c], total, room = total, total + own, GROUP - counts[c] if own == 1 else 0
    share = F.create_map(*[F.lit(x) for c in first for x in (c, -(-counts[c] // GROUP))])[F.col("cell")]
    start = F.create_map(*[F.lit(x) for c in first for x in (c, first[c])])[F.col("cell")]
    asked = asked.withColumn("grp", (start + F.pmod(F.xxhash64("vec_id", "v"), share)).cast("int"))
    told = asked.groupBy("grp", "cell").agg(F.max("far").alias("r"), F.min("least").alias("least"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("wide")).collect()  # a row for each cell and group
    g_id, g_cell = np.array([g["grp"] for g in told]), np.array([g["cell"] for g in told])
    g_r, g_least, g_low, g_high, g_wide = (np.array([g[c] for g in told]) for c in ("r", "least", "low", "high", "wide"))
    order = np.argsort(g_id, kind="stable")
    g_id, g_cell, g_r, g_least, g_low, g_high, g_wide = (x[order] for x in (g_id, g_cell, g_r, g_least, g_low, g_high, g_wide))
    edges = [0, *(i for i in range(64, len(g_id)) if g_id[i] != g_id[i - 1] and i % 64 < PIVOTS), len(g_id)]  # blocks of bounds; a group's are together
    parts = max(1, -(-n // PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(1), width)
            size = (x * x).sum(1)
            at_pivot, along = x @ pivots.T, x @ units.T
            across = np.sqrt(np.maximum(size[:, None] - along * along, 0))
            size = np.sqrt(size)
            for start in range(0, len(edges) - 1):
                g = slice(edges[start], edges[start + 1])
                b, c = along[:, g_cell[g]], across[:, g_cell[g]]
                one = np.maximum(g_low[g] * b, g_high[g] * b) + g_wide[g] * c
                other = at_pivot[:, g_cell[g]] + size[:, None] * g_r[g]
                reach = np.minimum(one, other)
                i, j = np.nonzero(reach + 1e-9 * (np.abs(one) + np.abs(other) + size[:, None] * (g_r[g] + np.abs(g_high[g]) + np.abs(g_low[g]))) + 1e-6 >= g_least[g])
                if len(i):
                    i, j = np.unique(np.stack([i, g_id[g][j]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["grp", "vec_id", "v"])

    sent = rows.mapInArrow(send, "grp int, vec_id long, v array<double>").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int"))
    return {"n": n, "width": width, "groups": total, "parts": parts, "asked": asked.select("grp", "vec_id", "v"), "sent": sent}


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every row whose vec_id is divisible by every."""
    plan = _plan(vectors, k, every, scale)
    if plan is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, sent = plan["width"], plan["sent"]
    dealt = plan["asked"].withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(plan["parts"] - 1))))

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        one = lambda t: (t.column("vec_id").to_numpy(), _dense(t.column("v").combine_chunks(), width) if t.num_rows else np.zeros((0, width)))
        (q_id, qv), (x_id, xv) = one(q), one(x)
        got = list(_best(q_id, qv, x_id, xv, k)) if len(q_id) and len(x_id) else []
        which = q.column("v").combine_chunks().take(pa.array([i for i, _, _ in got], pa.int64())) if got else pa.array([], pa.list_(pa.float64()))
        return pa.table({"query_id": pa.array([int(q_id[i]) for i, _, _ in got], pa.int64()), "v": which, "vec_id": pa.array([b for _, b, _ in got], pa.int64()), "score": pa.array([s for _, _, s in got], pa.int64())})

    some = dealt.groupBy("grp", "part").cogroup(sent.groupBy("grp", "part")).applyInArrow(solve, "query_id long, v array<double>, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
