"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where the hash has enough zero bits, more of them before the normal
chunk size than after it (normalised chunking).  Boundaries depend on nearby bytes only, so an insertion moves few of
them.  A text's fingerprint is its set of chunk digests with the bytes that each accounts for; the likeness of two
fingerprints is the shared weight as a share of the lighter one's (containment).
"""
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Chunk sizes in bytes, and the zero bits asked for before and after the normal size.
LEAST, NORMAL, MOST = 24, 48, 192
STRICT, LOOSE = np.uint32(((1 << 7) - 1) << 25), np.uint32(((1 << 4) - 1) << 28)

_MIXED = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
_MIXED = (_MIXED ^ (_MIXED >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
_GEAR = (_MIXED >> np.uint64(32)).astype(np.uint32)
_BLOCK = 1 << 20


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 bytes' random numbers, each shifted left by its age."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    strict, loose = [], []
    for at in range(0, n, _BLOCK):  # each block with the 31 bytes before it
        back = min(at, 31)
        h = _gear(raw[at - back:at + _BLOCK])[back:]
        strict.append(np.flatnonzero((h & STRICT) == 0) + at + 1)
        loose.append(np.flatnonzero((h & LOOSE) == 0) + at + 1)
    strict, loose = np.concatenate(strict).tolist(), np.concatenate(loose).tolist()
    strict.append(n + MOST + 1)
    loose.append(n + MOST + 1)
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        while strict[i] < start + LEAST:
            i += 1
        end = strict[i]
        if end > start + NORMAL:
            while loose[j] < start + NORMAL:
                j += 1
            end = min(loose[j], start + MOST)
        start = min(end, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(text: str) -> dict[int, int]:
    """Digest -> bytes in chunks with it."""
    data = text.encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    start = 0
    for end in cuts(data):
        digest = xxhash.xxh3_64_intdigest(data[start:end]) & 0xFFFFFFFFFF
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def printed(weights: dict[int, int]) -> str:
    """A fingerprint as text: sorted digest:weight pairs in hex."""
    return ",".join(f"{k:010x}:{v:x}" for k, v in sorted(weights.items()))


def parsed(text: str) -> dict[int, int]:
    return {int(k, 16): int(v, 16) for k, _, v in (x.partition(":") for x in text.split(",") if x)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over the lighter fingerprint's weight; two empty ones are alike, an empty one is like no other."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return shared / min(sum(a.values()), sum(b.values()))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, lent, rank_key, no_id, text) sorted by descending id, rows of one id by text, inside each bucket, where a
    bucket is a range of this order and ends with the lent first row of the next one, so that each row's successor is in its
    own bucket.

    As in Spark's own range partitioning the number of bounds follows the number of shuffle partitions, here four to each;
    they come from approximate percentiles of the ids.  An id on which several bounds fall (a hot one, or the rows without an
    id) has buckets of its own, by percentiles of the first seven bytes of its texts.  The bounds and the first key of each
    bucket are all that the driver sees, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("rank_key"),
                       F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    # a real id as low as the stand-in of a missing one comes before all of those
    rows = rows.withColumn("start", F.when((F.col("rank_key") == least) & ~F.col("no_id"), -1).otherwise(start))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    exact = max(10000, 20 * parts)
    bounds = rows.agg(F.percentile_approx("rank_key", [i / parts for i in range(1, parts)], exact)).first()[0]
    edges, times = np.unique(np.array(bounds or [], np.int64), return_counts=True)
    inner = {}  # hot id -> bounds among its texts' starts
    for n in np.unique(times[times > 1]).tolist():
        ids = edges[times == n].tolist()
        for r in rows.filter(F.col("rank_key").isin(ids)).groupBy("rank_key").agg(
                F.percentile_approx("start", [i / n for i in range(1, n)], exact).alias("b")).collect():
            inner[r.rank_key] = np.unique(np.array(r.b, np.int64))
    own = np.array([len(inner[e]) + 1 if e in inner else 0 for e in edges.tolist()] + [0])
    # descending ids: the largest are in bucket 0; at each edge first its own buckets, then that of what lies below
    first = np.append(np.cumsum((own + 1)[::-1])[::-1][1:], 0)
    held = np.append(edges, 0)

    @pandas_udf("long")
    def bucket_of(keys: pd.Series, starts: pd.Series) -> pd.Series:
        keys, starts = keys.to_numpy(), starts.to_numpy()
        at = np.searchsorted(edges, keys, side="left")
        out = first[at] + own[at]
        hot = (own[at] > 0) & (held[at] == keys)
        for key in np.unique(keys[hot]).tolist():
            mine = keys == key
            out[mine] = first[at[mine]] + np.searchsorted(inner[key], starts[mine], side="right")
        return pd.Series(out)

    # without a hot id no text is read to find the first keys
    placed = rows.withColumn("bucket", bucket_of("rank_key", "start" if inner else F.lit(0).cast("long")))
    low = F.min(F.when(F.col("rank_key").isin(list(inner)), F.col("start"))) if inner else F.lit(None).cast("long")
    heads = {r.bucket: (r.top, r.low) for r in placed.groupBy("bucket").agg(
        F.max("rank_key").alias("top"), low.alias("low")).collect()}
    order = sorted(heads)
    lend = [(b, *heads[b], a) for a, b in zip(order, order[1:] + order[:1])]
    firsts = F.broadcast(spark.createDataFrame(lend, "bucket long, top long, low long, taker long"))  # a row for each bucket
    tied = placed.join(firsts, "bucket").filter(
        (F.col("rank_key") == F.col("top")) & ((F.col("start") == F.col("low")) | F.col("low").isNull()))
    lent = tied.groupBy("taker", "rank_key").agg(F.min(F.struct("no_id", "text")).alias("m")).select(
        F.col("taker").alias("bucket"), F.lit(True).alias("lent"), "rank_key", "m.no_id", "m.text")
    both = placed.select("bucket", F.lit(False).alias("lent"), "rank_key", "no_id", "text").unionByName(lent)
    return both.repartition("bucket").sortWithinPartitions(
        "bucket", "lent", F.col("rank_key").desc(), "no_id", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64())])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form (its last third replaced by the start of the next document's text, in
    descending order of id, the first following the last) and their likeness, and the likeness to the next text.

    Null texts are empty.  Null ids come last; rows of the same id follow each other in the order of their texts.  A table
    of one row is its own next document.  Rows of one id whose texts start alike share a bucket, which is one task.  Equal texts have equal fingerprints.  Other columns are not read.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text, weights) that waits for its successor
        for batch in batches:
            out = []
            buckets, lent, keys, no_id = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if held is not None and held[0] != buckets[i]:
                    held = None  # cannot be: a bucket ends with lent rows
                if held is None and lent[i]:
                    continue
                text = batch.column(4)[i].as_py()
                weights = chunk_weights(text)
                if held is not None:
                    _, doc, own, mine = held
                    n = len(own)
                    edited = own[:n - n // 3] + text[:n // 3]
                    theirs = chunk_weights(edited)
                    out.append((doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                printed(mine), printed(theirs), likeness(mine, theirs), likeness(mine, weights)))
                held = None if lent[i] else (buckets[i], None if no_id[i] else keys[i], text, weights)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return in_order(docs, id_col, text_col).mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")
