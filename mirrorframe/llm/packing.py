"""Packing documents into sequences, shortest pack first over the length histogram.

A document of more tokens than a sequence holds is cut into full pieces and a rest.  The histogram of piece lengths has at
most ``size`` bins.  Lengths are placed longest first: the packs with the most room left (the shortest packs) that still
fit take one piece each, and their packing pattern's count is split where the length runs out.  A pattern is an interval
of sequence numbers, so each placement is one row (length, first rank, last rank, first sequence, offset); documents are
numbered within their length and joined to the placements by that rank.
"""
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch

#: Texts of these characters only (Latin, Greek and Cyrillic letters, ASCII, common punctuation) are encoded from the rank
#: file of the same vocabulary, which is several times faster; all others by the tokenizers file itself.  So are texts with
#: a long white-space run: the rank file's encoder gives up (a panic, no Exception) on runs of about a million; and texts that
#: hold an added token of the tokenizers file, which the rank file does not know.
_PLAIN = re.compile(r"[\t\n\r -~ -ɏΑ-ΡΣ-ωА-я‐-‧‰-›€]*")
_GAP = re.compile(r"\s\s")
_LONG_GAP = re.compile(r"(?<!\s)\s{10000}")
_loaded: dict = {}


def encoder(tokenizer: str, ranks: str | None):
    """A function from a text to its token ids (an array), kept for the life of the worker."""
    if (tokenizer, ranks) not in _loaded:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        whole.no_truncation()
        slow = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)
        if ranks is None:
            encode = slow
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            make = lambda name, p: tiktoken.Encoding(
                name, pat_str=p, mergeable_ranks=table, special_tokens={})
            full = make("ranks", public_tokenizers.PATTERN)
            # without two white-space characters in a row the lookahead never matters
            single = make("ranks-single", public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"))

            added = [t.content for t in whole.get_added_tokens_decoder().values()]

            def encode(text):
                if any(t in text for t in added) or not _PLAIN.fullmatch(text):
                    return slow(text)
                gap = _GAP.search(text)
                if gap and _LONG_GAP.search(text, gap.start()):
                    return slow(text)
                return np.array((full if gap else single).encode_ordinary(text), np.uint32)

        _loaded[tokenizer, ranks] = encode
    return _loaded[tokenizer, ranks]


def cut_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, size: int, end_id: int, id_col: str,
               text_col: str) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens), from one pass over the texts."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                       ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                out += [(doc, at, min(size, n - at), zlib.crc32(ids[at:at + size].tobytes()), n)
                        for at in range(0, n, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
                       ).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def place(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first sequence, offset).

    Every pack with room takes one piece of a length before any takes a second.  A placement uses up its length or a whole
    pattern, and splits at most one pattern, so there are at most two patterns for each of the ``size`` lengths, whatever
    the counts.  Where no pack has room, just enough new sequences are begun for the pieces left.
    """
    rows, sequences = [], 0
    packs: dict[int, list[tuple[int, int]]] = {}  # room left -> intervals (first sequence, count)
    rooms: list[int] = []  # sorted

    def add(room, first, count):
        if room not in packs:
            packs[room] = []
            bisect.insort(rooms, room)
        packs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank, done = histogram[length], 0, []
        while left:
            if done and not (rooms and rooms[-1] >= length):
                for x in done:
                    add(*x)
                done = []
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                first, count = packs[room].pop()
                if not packs[room]:
                    del packs[room], rooms[-1]
                used = min(count, left)
                if used < count:
                    add(room, first + used, count - used)
            else:
                room, first, used = size, sequences, -(-left // (size // length))
                sequences += used
            rows.append((length, rank, rank + used - 1, first, size - room))
            rank, left = rank + used, left - used
            if room > length:
                done.append((room - length, first, used))
        for x in done:
            add(*x)
    return rows


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts hold the end id alone.  Null ids and repeated rows are packed like any other, each row its own
    pieces.  The order of pieces of equal length is by checksum, id and start.  An empty table has no pieces.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "ids_crc32", "doc_id", "start"]
    with Scratch(spark, "packing") as scratch:
        pieces = scratch.table(cut_pieces(docs, tokenizer, ranks, size, end_id, id_col, text_col), "pieces")
        ranged = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        local = F.monotonically_increasing_id()
        held = scratch.keep(ranged.select("*", F.shiftright(local, 33).alias("part"),
                                          local.bitwiseAND((1 << 33) - 1).alias("place")), "ranked")
    # a row for each partition and each length: bounded by the partitions and by the size of a sequence
    before, running = {}, 0
    for r in sorted(held.groupBy("part").count().collect(), key=lambda r: r["part"]):
        before[r["part"]], running = running, running + r["count"]
    histogram = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    slots, start, running = place(histogram, size), {}, 0
    for length in sorted(histogram):
        start[length], running = running, running + histogram[length]
    table = spark.createDataFrame([(a, start[a] + b, start[a] + c, d, e) for a, b, c, d, e in slots],
                                  "slot_length long, low long, high long, first long, offset long")
    offsets = spark.createDataFrame(list(before.items()), "of_part long, before long")
    numbered = held.join(F.broadcast(offsets), F.col("part") == F.col("of_part")).withColumn(
        "rank", F.col("before") + F.col("place"))
    return numbered.join(F.broadcast(table), (F.col("length") == F.col("slot_length"))
                         & F.col("rank").between(F.col("low"), F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
