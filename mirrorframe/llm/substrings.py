"""Removal of repeated word passages by level-wise doubling.

Windows of half the length are compared first, and only those that are repeated are extended to twice that length, the
whole window.  At the first level not every window is needed: each whole window is represented by the half window inside it
with the smallest hash (an anchor), a choice that depends on the window's words alone, so equal windows have equal anchors
at equal offsets, and a window can be repeated only if its anchor is.  About one position in six is an anchor.  Anchors that
survive are extended to all whole windows over them; where these agree altogether the anchors are compared as one, so a
passage copied many times costs a row for each anchor, not for each window.  No whole window that is repeated is missed, and
longer repeats are unions of such windows, so the doubling ends there.

Only hashes and positions are shuffled, and the texts of the documents twice; counts and first occurrences are aggregated
before they are joined, so that no task holds all the occurrences of a frequent window.
"""
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from mirrorframe.llm.common import Scratch

_MULS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_FINISH, _S1, _S2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(31), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _FINISH
    return x ^ (x >> _S2)


def hashed_words(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def levels(words: np.ndarray, window: int, chain: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all half windows and of all whole windows."""
    mul, half = _MULS[chain], window // 2
    one = words[:len(words) - half + 1]
    for i in range(1, half):
        one = one * mul + words[i:len(words) - half + 1 + i]
    one = _mix(one)
    return one, _mix(one[:-half] * mul + one[half:])


def anchor_runs(one: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text (position, first and last start of the whole windows that each stands for)."""
    span = window - window // 2 + 1
    at = np.lib.stride_tricks.sliding_window_view(one, span).argmin(axis=1) + np.arange(len(one) - span + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc: the id, null as the smallest; code: tells texts of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.col(text_col).alias("text")).withColumn(
        "code", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ds, ps = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = hashed_words(text.as_py())
                if len(words) >= window:
                    one = levels(words, window)[0]
                    at, _, _ = anchor_runs(one, window)
                    hs.append(one[at])
                    ps.append(at)
                    ds.append(np.full(len(at), doc, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ds)),
                    pa.array(np.concatenate(ps).astype(np.int32))], ["h", "doc", "p"])

    return rows.select("doc", "text").mapInArrow(emit, "h long, doc long, p int")


def _extended(rows: DataFrame, window: int) -> DataFrame:
    """rows: doc, code, text, at (positions of surviving anchors).  A row for each: the first and last start of the whole
    windows over it, the hash of them all together, and each one's."""
    kinds = pa.schema([("doc", pa.int64()), ("code", pa.int32()), ("p", pa.int32()), ("s1", pa.int32()), ("s2", pa.int32()),
                       ("c1", pa.int64()), ("c2", pa.int64()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int32()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, code, text, known in zip(*(batch.column(i) for i in range(4))):
                words = hashed_words(text.as_py())
                if len(words) < window:
                    continue
                one, full = levels(words, window)
                other = levels(words, window, 1)[1]
                at, s1, s2 = anchor_runs(one, window)
                live = np.isin(at, np.asarray(known.values))
                at, s1, s2 = at[live], s1[live], s2[live]
                if not len(at):
                    continue
                n = s2 - s1 + 1
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(s1, n)  # every whole window, by anchor
                offset = _mix((np.repeat(at, n) - place + 1).astype(np.uint64))
                contexts = [np.add.reduceat(_mix(x[place] ^ offset), ends - n).view(np.int64) for x in (full, other)]
                bounds = pa.array(np.r_[0, ends].astype(np.int32))
                short = (other[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), doc.as_py(), np.int64)), pa.array(np.full(len(at), code.as_py(), np.int32)),
                    pa.array(at.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(s2.astype(np.int32)),
                    *map(pa.array, contexts), pa.ListArray.from_arrays(bounds, pa.array(full[place].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(short))], schema=kinds)

    return rows.select("doc", "code", "text", "at").mapInArrow(
        emit, "doc long, code int, p int, s1 int, s2 int, c1 long, c2 long, w1 array<long>, w2 array<int>")


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (doc, code, spans): the starts (first, last) of whole windows that also occur earlier."""
    rows = _keyed(docs, id_col, text_col)
    # half windows
    anchors = scratch.table(_anchors(rows, window), "anchors")
    often = scratch.table(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    alive = scratch.table(anchors.join(often, "h", "left_semi").groupBy("doc").agg(F.collect_set("p").alias("at")), "alive")
    scratch.drop("anchors")
    # whole windows: anchors that agree in all of them first, then the windows of the first of each kind
    wide = scratch.table(_extended(rows.join(alive, "doc"), window), "wide")
    own = F.struct("doc", "code", "p")
    kinds = scratch.table(wide.groupBy("c1", "c2").agg(F.min(own).alias("f")), "kinds")
    ranked = scratch.table(wide.select("doc", "code", "p", "s1", "s2", "c1", "c2").join(kinds, ["c1", "c2"]).select(
        "doc", "code", "p", "s1", "s2", (own == F.col("f")).alias("is_first")), "ranked")
    later = ranked.filter("NOT is_first").select("doc", "code", "s1", "s2")
    steps = F.transform(F.arrays_zip("w1", "w2"), lambda w, i: F.struct(
        (F.col("s1") + i).alias("s"), w["w1"].alias("a"), w["w2"].alias("b")))
    windows = scratch.table(
        wide.select("doc", "code", "p", "s1", "w1", "w2").join(
            ranked.filter("is_first").select("doc", "code", "p"), ["doc", "code", "p"], "left_semi")
        .select("doc", "code", F.explode(steps).alias("w")).select("doc", "code", "w.s", "w.a", "w.b"), "windows")
    scratch.drop("wide")
    earliest = scratch.table(windows.groupBy("a", "b").agg(
        F.min(F.struct("doc", "code", "s")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "f"), "earliest")
    again = windows.join(earliest, ["a", "b"]).filter(F.struct("doc", "code", "s") != F.col("f")).select(
        "doc", "code", F.col("s").alias("s1"), F.col("s").alias("s2"))
    again = scratch.table(again, "again")
    scratch.drop("windows")
    return later.unionByName(again).groupBy("doc", "code").agg(F.collect_set(F.struct("s1", "s2")).alias("spans"))


def _cut(text: str | None, spans: list, window: int) -> tuple[list[bytes], int]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int32)
    first, last = np.array([(s["s1"], s["s2"]) for s in spans]).T
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                 texts: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text``.

    A word goes if a window of ``window`` words (an even number) over it also starts earlier: in a document of a smaller
    id, or in the same one.  Null and empty texts have no words.  A null id is smaller than any other.  Rows of the same id
    and text are one document; rows of the same id and different texts are taken in the order of a hash of the text.
    """
    if window % 2 or window < 4:
        raise ValueError("window is an even number, 4 or more")
    spark = docs.sparkSession
    result = "struct<n_words:long,n_removed:long,kept_sha256:string,kept_text:string>"
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                      ("kept_text", pa.string())])

    @arrow_udf(result)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text, spans):
            kept, gone = _cut(t.as_py(), s.as_py(), window)
            joined = b" ".join(kept)
            out.append((len(kept) + gone, gone, hashlib.sha256(joined).hexdigest(),
                        joined.decode("utf-8", "surrogatepass") if texts else None))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([],) * 4, kind)],
                                          fields=list(kind))

    with Scratch(spark, "substrings") as scratch:
        spans = scratch.keep(repeated_spans(docs, scratch, id_col, text_col, window), "spans")
    rows = _keyed(docs, id_col, text_col).join(spans, ["doc", "code"], "left")
    cut_rows = rows.select(F.col("id").alias("doc_id"), cut("text", "spans").alias("c"))
    return cut_rows.select("doc_id", "c.n_words", "c.n_removed", "c.kept_sha256", *(["c.kept_text"] if texts else []))
