"""WARC archives: a writer of gzip-per-record files and a splittable reader.

The reader cuts every archive into byte ranges, one row and so one task each.  A task scans its range for the gzip magic
number, validates a candidate member by decoding its first bytes and looking for a WARC header, and owns the records whose
members start inside the range; the last one may end beyond it.  After an owned record the next member's place is known,
so scanning is needed only for the first.  Payloads are streamed through the digest, never held whole unless asked for.
"""
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch

_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 18
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"
RECORDS = ("path string, record_offset long, record_id string, record_type string, target_uri string, "
           "key string, declared_digest string, refers_to_id string, payload_bytes long, payload_digest string")


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return fs, name


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_id(key: str, digest: str) -> str:
    """A record's id: rows of one key with unlike payloads are records of their own."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{digest}:{key}')}>"


def member(kind: str, key: str, url: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as one gzip member.  A revisit holds the response's HTTP header and no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {_line(key)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit_bytes: int = 1000) -> DataFrame:
    """Rows (id, url, payload, digest, refers_to): of equal payloads of at least ``min_revisit_bytes`` the largest id is
    the response (``refers_to`` null) and the others revisit it.  Equal means equal length and SHA-1.

    Null and empty html is an empty payload, a null url an empty one.  Rows of one id with unlike payloads are records of
    their own, each response or revisit by its payload; rows with a null id revisit the largest id, and are responses where a
    payload has no other.  An empty table gives no records; other columns are not read."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    group = scratch.table(rows.filter(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(
        F.max("id").alias("winner"), F.count("*").alias("many")).filter("many > 1 AND winner IS NOT NULL"), "groups")
    return rows.join(group, ["digest", "n"], "left").select(
        "id", "url", "payload", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``records`` as .warc.gz files below ``folder`` (any store that pyarrow opens; shared by all executors) and
    returns the manifest (path, length, records).

    A task writes under names of its own, so a repeated task never touches another's files; only files in the manifest,
    which Spark commits once for each task, are part of the archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, size, count = None, "", 0, 0

        def done():
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "length": size, "records": count}],
                                              pa.schema([("path", pa.string()), ("length", pa.int64()),
                                                         ("records", pa.int64())]))

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, digest, to = (batch.column(c)[i].as_py() for c in range(5))
                data = member("revisit" if to is not None else "response", "null" if key is None else str(key), url or "",
                              digest, bytes(payload), None if to is None else str(to))
                if sink is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, name = _open(path)
                    fs.create_dir(name.rpartition("/")[0])
                    sink = fs.open_output_stream(name, compression=None)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(
        write, "path string, length long, records long")


class _Reader:
    """Bytes of one archive from a place on, in steps."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at
        source.seek(at)

    def more(self) -> bytes:
        data = self.source.read(_STEP)
        self.at += len(data)
        return data


def _decode(source, start: int, keep_payload: bool) -> tuple[dict, int] | None:
    """The record of the gzip member at ``start`` and the member's end; None if no WARC record starts there."""
    reader, unpack = _Reader(source, start), zlib.decompressobj(31)
    head, raw = b"", b""
    sha, n, kept = hashlib.sha1(), 0, []
    fields, left = None, 0  # left: bytes of the block still to come
    http_done = False
    try:
        while not unpack.eof:
            raw = unpack.unconsumed_tail or reader.more()
            if not raw:
                return None
            data = unpack.decompress(raw, _STEP)
            if fields is None:
                head += data
                if head[:7] != b"WARC/1."[:len(head[:7])]:
                    return None
                cut = head.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                fields = {}
                for line in head[:cut].split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
                left = int(fields.get("content-length", 0))
                data, head = head[cut + 4:], b""
            block = data[:left]
            left -= len(block)
            if not http_done and fields.get("content-type", "").startswith("application/http"):
                head += block
                cut = head.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                block = head[cut + 4:]
            http_done = True
            sha.update(block)
            n += len(block)
            if keep_payload:
                kept.append(block)
    except (zlib.error, ValueError):
        return None
    if fields is None or left:
        return None
    fields["#"] = (n, sha.hexdigest(), b"".join(kept) if keep_payload else None)
    return fields, reader.at - len(unpack.unused_data)


def records_in(source, start: int, end: int, keep_payload: bool = False) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the members that start in [start, end)."""
    at, size = start, source.size()
    end = min(end, size)
    while at < end:
        found = _decode(source, at, keep_payload)
        if found is not None:
            yield at, found[0]
            at = found[1]
            continue
        at += 1  # not a member: go on to the next magic number
        while at < end:
            source.seek(at)
            data = source.read(min(_STEP, end - at) + len(_MAGIC) - 1)
            hit = data.find(_MAGIC)
            if hit >= 0:
                at += hit
                break
            at += max(1, len(data) - len(_MAGIC) + 1)


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 4 << 20,
                  keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, length), each range of ``split_bytes`` read by a task.

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) are measured on what the record holds, which for a revisit is
    nothing; ``declared_digest`` is what its header says.  Damaged members and other gzip data are passed over.
    """
    parts = manifest.select("path", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    schema = RECORDS + (", payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c, pa.int64() if c in ("record_offset", "payload_bytes") else pa.binary() if c == "payload"
                            else pa.string()) for c in names])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = _open(path)
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for at, f in records_in(source, start, start + split_bytes, keep_payload):
                        bare = lambda x: x.strip("<>").removeprefix("urn:uuid:") if x else None
                        rows.append((path, at, bare(f.get("warc-record-id")), f.get("warc-type"),
                                     f.get("warc-target-uri"), f.get("x-record-key"), f.get("warc-payload-digest"),
                                     bare(f.get("warc-refers-to")), *f["#"])[:len(names)])
                        held += len(f["#"][2] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return parts.repartition(max(1, int(n)), "path", "start").mapInArrow(scan, schema)


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Response and revisit rows with the payload of the response that a revisit refers to (the archives are read once,
    into a table; only responses that are referred to take part in the join): adds ``refers_to`` (its key)
    and takes its length and digest, if the digest is the one that the revisit declares."""
    kind: Column = F.col("record_type")
    records = scratch.keep(records, "records")
    referred = records.filter(kind == "revisit").select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = scratch.keep(records.filter(kind == "response").join(referred, "record_id", "left_semi").groupBy(
        "record_id").agg(F.min(F.struct("key", "payload_bytes", "payload_digest")).alias("o")), "originals")
    own = records.filter(kind == "response").withColumn("refers_to", F.lit(None).cast("string"))
    again = (records.filter(kind == "revisit").drop("payload_bytes", "payload_digest")
             .join(originals.select(F.col("record_id").alias("refers_to_id"), "o"), "refers_to_id", "left")
             .withColumn("same", F.col("declared_digest") == F.concat(F.lit("sha1:"), F.col("o.payload_digest")))
             .withColumn("payload_bytes", F.when(F.col("same"), F.col("o.payload_bytes")))
             .withColumn("payload_digest", F.when(F.col("same"), F.col("o.payload_digest")))
             .withColumn("refers_to", F.col("o.key")).drop("o", "same"))
    return own.unionByName(again)
