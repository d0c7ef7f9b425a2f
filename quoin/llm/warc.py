"""WARC archives of Zstandard frames: a writer, and a reader that takes the dictionary from the leading skippable frame.

A file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary, raw or compressed, when it has one; then each record is one frame. The reader finds a frame's
end from its block headers, decodes it alone, and validates the version line, the mandatory headers, Content-Length, the end of the record, the length of the HTTP body and
the payload's digest. What fails is told in the column problem; a file that can't be cut into frames gives one row with its problem.

The writer gives a response for each row, or a revisit (headers only) when a row with an equal payload of least_bytes or more has a smaller page_id. A null payload is
empty. Rows of a repeated page_id that have the smallest page_id of their payload are all responses; a row without page_id is always a response. A file holds at most about
ARCHIVE bytes, is written under another name and moved, and its name and content depend on the task's rows alone, so a task that runs again replaces its own files.
A very long payload is a record as any other, held once by the task that writes or reads it. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.runtime import arrow_limits, scratch

#: Fixed values of the formats.
SKIPPABLE_DICTIONARY, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVE, DICTIONARY, SAMPLES = 8 << 20, 16 << 10, 200
DATE, PROFILE = "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the payload that it refers to, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1_32(payload)}"]
    head += [] if refers is None else [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=200, d=8) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def head_frame(d: zstandard.ZstdCompressionDict | None) -> bytes:
    if d is None:
        return b""
    packed = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed


def frames(content: bytes) -> tuple[bytes | None, list[tuple[int, int]]]:
    """The dictionary, and where each frame begins and ends. Raises ValueError on what isn't a frame."""
    at, out, dictionary = 0, [], None
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("truncated frame")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(content):
                raise ValueError("truncated skippable frame")
            if magic == SKIPPABLE_DICTIONARY and at == 0:
                body = content[8 : 8 + size]
                dictionary = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27) if body[:4] == struct.pack("<I", ZSTD_MAGIC) else body
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            raise ValueError("no frame where one should begin")
        end = at + zstandard.frame_header_size(content[at : at + 18])
        checksum, last = content[at + 4] & 4, False
        while not last:
            if end + 3 > len(content):
                raise ValueError("truncated block")
            b = int.from_bytes(content[end : end + 3], "little")
            last, kind, size = b & 1, b >> 1 & 3, b >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * bool(checksum)
        if end > len(content):
            raise ValueError("truncated frame")
        out.append((at, end))
        at = end
    return dictionary, out


def parse(data: bytes) -> dict:
    """Fields of one record; problem is null if all checks hold."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"))

    def bad(what: str) -> dict:
        out["problem"] = what
        return out

    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return bad("version or headers")
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    if missing := [k for k in MANDATORY if k not in fields]:
        return bad("missing " + ", ".join(missing))
    out |= {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return bad("length or end of record")
    block = rest[:-4]
    if not fields.get("content-type", "").startswith("application/http"):
        out |= {"payload": block, "payload_bytes": len(block)}
        return out
    http, gap, body = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", http)
    if not gap or not http.startswith(b"HTTP/") or not told:
        return bad("HTTP headers")
    out["payload_bytes"] = int(told[1])
    if out["record_type"] == "revisit":
        return bad("body in a revisit") if body else bad("revisit refers to nothing") if not out["refers_to"] or not out["payload_digest"] else out
    out["payload"] = body
    return bad("HTTP length") if len(body) != out["payload_bytes"] else bad("payload digest") if out["payload_digest"] not in (None, sha1_32(body)) else out


def _write(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = stores.FileSystem.from_uri(to)
        number, records, size = 0, 0, 0
        buffer, first, made = io.BytesIO(), None, []
        dictionary = packer = None

        def close() -> None:
            nonlocal number, records, size, buffer
            name = f"{root}/part-{task.partitionId():06d}-{number:05d}.warc.zst"
            own = f"{root}/_writing-{task.taskAttemptId()}-{number}"
            with fs.open_output_stream(own, compression=None) as f:
                f.write(head_frame(dictionary))
                f.write(buffer.getvalue())
            fs.move(own, name)
            made.append((name.rsplit("/", 1)[1], records, size))
            number, records, size, buffer = number + 1, 0, 0, io.BytesIO()

        for batch in batches:
            rows = [(i, u, h or b"", r) for i, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if first is None:
                first = [h[:8192] for _, _, h, _ in rows[:SAMPLES] if h]
                dictionary = trained(first)
                packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
            for row in rows:
                frame = packer.compress(record(*row))
                buffer.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE:
                    close()
        if records:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([m[0] for m in made], pa.string()), "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    return run


def write_archives(pages: DataFrame, to: str, least_bytes: int = 0) -> int:
    """Write a record for each row of (page_id, url, html) under the folder to; the number of records. Payloads are shuffled once at most, by page_id."""
    arrow_limits(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("d", F.sha1("html"))
    small = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "d")
    heads = small.groupBy("d").agg(F.min("page_id").alias("refers"), F.max("page_id").alias("last")).where("refers != last").select("d", "refers")
    again = small.join(heads, "d").where("page_id != refers").distinct()
    told = rows.join(again, ["page_id", "d"], "left").select("page_id", "url", "html", "refers").sortWithinPartitions("page_id", F.sha1("html"))
    fs, root = stores.FileSystem.from_uri(to)
    fs.create_dir(root, recursive=True)
    return told.mapInArrow(_write(to), "file string, records long, bytes long").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


_READ = pa.schema([("file", pa.string()), ("ordinal", pa.int32()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                name, content, rows = path.as_py().rsplit("/", 1)[-1], content.as_py(), []
                try:
                    dictionary, found = frames(content)
                except (ValueError, zstandard.ZstdError) as e:
                    dictionary, found = None, []
                    rows.append({"file": name, "ordinal": -1, "problem": f"file: {e}"})
                d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                for i, (a, b) in enumerate(found):
                    try:
                        one = parse(d.decompress(content[a:b], max_output_size=1 << 30))
                    except zstandard.ZstdError as e:
                        one = {"problem": f"frame: {e}"}
                    if not payloads:
                        one["payload"] = None
                    rows.append({"file": name, "ordinal": i, **one})
                    if len(rows) >= (200 if payloads else 2000):
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the .warc.zst files in the folder; without payloads their bytes are validated but not returned."""
    arrow_limits(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    kinds = "file string, ordinal int, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"
    return files.mapInArrow(_read(payloads), kinds)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    spark = pages.sparkSession
    to = scratch(spark, "warc")
    write_archives(pages, to, least_bytes)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return read_archives(spark, to, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")
