"""Conversation turn reassembly as a stateful stream.

Arrivals of a batch are turns of conversations, out of order, some of them again. Conversations are dealt to buckets by a hash; applyInPandasWithState holds one state a bucket: two zstd-compressed columnar
tables, of its conversations (first turn, last batch with an arrival, closed or not) and of the turns that open ones keep (number, role, batch of the arrival kept, released or not). Every batch has a tick
row a bucket, so that buckets without arrivals see time pass. What a batch brings is merged by arrays: a turn's first arrival is kept, later ones are repeats; the gapless run of kept turns from the
conversation's first turn is released, each turn once; a conversation without arrivals in QUIET successive batches is closed, and the end closes what is open. Whatever arrives after closing is rejected.

Texts never enter the state, nor the shuffle to it: events name the arrival they are about (conversation, turn, batch) and get its text by a join, dealt by all three. So a conversation with a third of
all rows gives its bucket numbers and roles alone, some bytes a turn and compressed. An executor that is lost costs the batch's tasks: state, offsets and output are in the checkpoint.

Null turns are dropped; a null role or text is empty. Rows without a conv_id are one conversation, in a bucket of its own. Of rows of one turn in one batch the smallest payload (role|text, by UTF-8
bytes) arrives. Very long texts are as others. An empty table gives no events. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quoin.runtime import durable, scratch

BATCHES, QUIET, BUCKETS = 10, 2, 64
ARRIVAL = "conv_id long, turn long, role string, text string, payload string, first long, bucket int, batch int"
EVENTS = "event string, bucket int, conv_id long, turn long, batch long, of int, n_missing long, n_breaks long, turns array<long>"
_CONVERSATIONS = pa.schema([("conv", pa.int64()), ("first", pa.int64()), ("last", pa.int32()), ("closed", pa.bool_())])
_TURNS = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("of", pa.int32()), ("released", pa.bool_())])


def _hash(conv_id: Column, turn: Column) -> Column:
    """The first 8 hex digits of sha256(conv_id:turn) as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", conv_id.cast("string"), turn.cast("string")), 256), 1, 8), 16, 10).cast("long")


def arrivals(turns: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What arrives in which of the batches: h % 10, and where h % 7 < 2 once more with role user in batch (h + 5) % 10. One row for each turn and batch, its smallest payload."""
    rows = turns.where(F.col("turn").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "its conv")
    h = _hash(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn"))
    own = F.struct((h % BATCHES).cast("int").alias("batch"), F.col("role").alias("role"))
    again = F.struct(((h + 5) % BATCHES).cast("int").alias("batch"), F.lit("user").alias("role"))
    sent = rows.withColumn("sent", F.explode(F.when(h % 7 < 2, F.array(own, again)).otherwise(F.array(own))))
    sent = sent.select("conv_id", "turn", "sent.batch", F.struct(F.concat_ws("|", "sent.role", "text").alias("payload"), F.col("sent.role").alias("role"), "text").alias("p"))
    least = sent.groupBy("conv_id", "turn", "batch").agg(F.min("p").alias("p"))
    named = least.join(first, F.col("conv_id").eqNullSafe(F.col("its conv")))
    bucket = F.coalesce(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int"), F.lit(-1))
    return named.select("conv_id", "turn", "p.role", "p.text", "p.payload", "first", F.when(F.col("conv_id").isNull(), -1).otherwise(bucket).alias("bucket"), "batch")


def _packed(table: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pandas(table, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(blob).read_all() if blob else schema.empty_table()).to_pandas()


def _runs(turns: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of turns sorted by conversation and number: where each conversation begins, which one each row is of, and its rank there."""
    conv = turns["conv"].to_numpy()
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if len(conv) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
    return starts, which, np.arange(len(conv)) - starts[which] if len(conv) else which


def merged(known: pd.DataFrame, turns: pd.DataFrame, came: pd.DataFrame, batch: int, end: bool) -> tuple[pd.DataFrame, pd.DataFrame, list[pd.DataFrame]]:
    """A bucket's conversations and kept turns after a batch, and the batch's events. came: conv, turn, first, role, one row a turn."""
    events = []
    closed = known.loc[known["closed"], "conv"].to_numpy()
    late = np.isin(came["conv"].to_numpy(), closed)
    if late.any():
        events.append(pd.DataFrame({"event": "reject", "conv": came["conv"][late], "turn": came["turn"][late], "of": batch}))
    came = came[~late]
    if len(came):
        opened = came.drop_duplicates("conv")
        fresh = opened[~np.isin(opened["conv"].to_numpy(), known["conv"].to_numpy())]
        known = pd.concat([known, pd.DataFrame({"conv": fresh["conv"], "first": fresh["first"], "last": batch, "closed": False})], ignore_index=True)
        known.loc[np.isin(known["conv"].to_numpy(), opened["conv"].to_numpy()), "last"] = batch
        turns = pd.concat([turns, pd.DataFrame({"conv": came["conv"], "turn": came["turn"], "role": came["role"], "of": batch, "released": False})], ignore_index=True)
        turns = turns.drop_duplicates(["conv", "turn"], keep="first").sort_values(["conv", "turn"], ignore_index=True)
    starts, which, rank = _runs(turns)
    if len(came):
        first = known.set_index("conv")["first"].reindex(turns["conv"]).to_numpy()
        ready = (turns["turn"].to_numpy() - first == rank) & ~turns["released"].to_numpy(dtype=bool)
        out = turns[ready]
        events.append(pd.DataFrame({"event": "release", "conv": out["conv"], "turn": out["turn"], "of": out["of"]}))
        turns = turns.assign(released=turns["released"].to_numpy(dtype=bool) | ready)
    shut = ~known["closed"].to_numpy(dtype=bool) & (end | (batch - known["last"].to_numpy() >= QUIET))
    if shut.any():
        gone = known.loc[shut, ["conv", "first"]].sort_values("conv")
        conv, turn, role = turns["conv"].to_numpy(), turns["turn"].to_numpy(), turns["role"].to_numpy(dtype=object)
        again = np.append(False, (conv[1:] == conv[:-1]) & (turn[1:] == turn[:-1] + 1) & (role[1:] == role[:-1])) if len(turns) else np.zeros(0, bool)
        at = pd.Series(np.arange(len(starts)), index=conv[starts]).reindex(gone["conv"]).to_numpy()  # every open conversation keeps a turn
        ends = np.append(starts, len(turns))
        open_turns = turns["released"].to_numpy(dtype=bool)
        rows = []
        for k, c, f in zip(at.astype(int), gone["conv"], gone["first"], strict=True):
            s = slice(ends[k], ends[k + 1])
            rows.append((c, int(turn[s][-1]) - int(f) + 1 - (s.stop - s.start), int(again[s].sum()), turn[s][~open_turns[s]].tolist()))
        events.append(pd.DataFrame({"event": "close", "conv": [r[0] for r in rows], "turn": -1, "of": -1, "n_missing": [r[1] for r in rows], "n_breaks": [r[2] for r in rows], "turns": [r[3] for r in rows]}))
        turns = turns[~np.isin(conv, gone["conv"].to_numpy())].reset_index(drop=True)
        known = known.assign(closed=known["closed"].to_numpy(dtype=bool) | shut)
    return known, turns, events


def _advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket and one batch: rows without a turn are its tick, that of batch BATCHES is the end."""
    rows = pd.concat(list(chunks), ignore_index=True)
    batch = int(rows["batch"].max())
    held = state.get if state.exists else (None, None)
    known, turns = _unpacked(held[0], _CONVERSATIONS), _unpacked(held[1], _TURNS)
    came = rows[rows["turn"].notna()]
    came = pd.DataFrame({"conv": came["conv_id"].fillna(0).astype("int64"), "turn": came["turn"].astype("int64"), "first": came["first"].astype("int64"), "role": came["role"]})
    known, turns, events = merged(known, turns, came, batch, batch >= BATCHES)
    state.update((_packed(known, _CONVERSATIONS), _packed(turns, _TURNS)))
    for e in events:
        if len(e):
            more = {"n_missing": -1, "n_breaks": -1, "turns": [[]] * len(e)} if "turns" not in e else {c: e[c] for c in ("n_missing", "n_breaks", "turns")}
            yield pd.DataFrame({"event": e["event"], "bucket": key[0], "conv_id": e["conv"], "turn": e["turn"], "batch": batch, "of": e["of"], **more})


def events(sent: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The stream's events over arrivals (written, partitioned by batch): event, conv_id, turn, batch, of (the batch whose arrival it is about; -1 for close), n_missing, n_breaks, turns (unreleased at closing).

    The query is started anew for each batch, and for the end, on one checkpoint; a start reads what was written to the feed since the last one.
    """
    spark = sent.sparkSession
    feed, at, out = scratch(spark, "feed"), scratch(spark, "stream"), scratch(spark, "events")
    columns = ["bucket", "conv_id", "turn", "first", "role", "batch", "payload"]
    ticks = spark.range(-1, buckets).select(F.col("id").cast("int").alias("bucket"), *[F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("first", "long"), ("role", "string"))])
    for batch in range(BATCHES + 1):
        own = ticks.withColumn("batch", F.lit(batch)).withColumn("payload", F.lit(None).cast("string")).coalesce(1)
        if batch < BATCHES:
            own = sent.where(F.col("batch") == batch).select(*columns).unionAll(own)
        own.write.mode("append").parquet(feed)
        stream = spark.readStream.schema("bucket int, conv_id long, turn long, first long, role string, batch int, payload string").parquet(feed).drop("payload")
        told = stream.groupBy("bucket").applyInPandasWithState(_advance, EVENTS, "conversations binary, turns binary", "append", GroupStateTimeout.NoTimeout)
        run = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", at).trigger(availableNow=True).start(out)
        run.awaitTermination()
    found = spark.read.schema(EVENTS).parquet(out)
    closing = lambda c: F.when(F.col("event") == "close", F.col(c)).alias(c)
    return found.select("event", F.when(F.col("bucket") >= 0, F.col("conv_id")).alias("conv_id"), "turn", "batch", "of", *map(closing, ("n_missing", "n_breaks", "turns")))


def reassembled(turns: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The events with what they are about: role, text and payload of releases and rejects, the numbers of the turns that a close leaves unreleased."""
    path = scratch(turns.sparkSession, "arrivals")
    arrivals(turns, buckets).write.partitionBy("batch").parquet(path)
    sent = turns.sparkSession.read.schema(ARRIVAL).parquet(path)
    found = events(sent, buckets)
    texts = sent.select(F.col("conv_id").alias("its conv"), F.col("turn").alias("its turn"), F.col("batch").alias("its batch"), "role", "text", "payload")
    same = F.col("conv_id").eqNullSafe(F.col("its conv")) & (F.col("turn") == F.col("its turn")) & (F.col("of") == F.col("its batch"))
    about = found.where("event != 'close'").join(texts, same).drop("its conv", "its turn", "its batch")
    return about.unionByName(found.where("event = 'close'"), allowMissingColumns=True)


def digests(found: DataFrame) -> DataFrame:
    """event, conv_id, turn, batch, sha256 (of the payload, or of the comma-joined numbers), n_missing, n_breaks."""
    numbers = F.array_join(F.transform("turns", lambda t: t.cast("string")), ",")
    of = F.sha2(F.when(F.col("event") == "close", F.coalesce(numbers, F.lit(""))).otherwise(F.col("payload")), 256)
    return found.select("event", "conv_id", "turn", F.col("batch").cast("long").alias("batch"), of.alias("sha256"), "n_missing", "n_breaks")
