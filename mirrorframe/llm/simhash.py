"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint over the XXH64 hashes of its word shingles.  Equal fingerprints are collapsed first.
The distinct ones are cut into blocks: two fingerprints that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` whole blocks, so each choice of that many blocks is a join key, and close pairs share at least one.
Keys that few fingerprints share are self-joined and every pair is verified by its Hamming distance.  Keys that more than
``DENSE`` fingerprints share never form pairs: each fingerprint there is linked to the words one flipped bit away from it
(outside the key's blocks), and fingerprints that share such a word are at most two bits apart; the smallest of them
stands for the rest.  That is exact for two bits, so every link is found.  Components come from alternating large-star and
small-star rounds over the links.
"""
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from mirrorframe.llm.common import Scratch

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints on one block key beyond which pairs are not formed there.
DENSE = 64
_CHUNK = 1 << 14


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half the shingles' hashes.  No word: 0; fewer words than a shingle: the one whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    @arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(x.as_py(), shingle) for x in texts], np.uint64).view(np.int64))

    return prints(text)


def _masks(blocks: int, kept: int) -> list[int]:
    """One 64-bit mask for each choice of ``kept`` of ``blocks`` nearly equal blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(m) for m in itertools.combinations(block, kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, scratch: Scratch, max_bits: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``max_bits`` bits of each other, directly
    or through a chain of such steps.  In dense keys only ``max_bits`` up to 2 can be told apart by single flips."""
    if not 0 < max_bits <= 2 or blocks <= max_bits:
        raise ValueError("max_bits is 1 or 2, with more blocks than that")
    masks = _masks(blocks, blocks - max_bits)
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)
    ])).alias("key")).select("fp", "key.k", "key.v")
    sizes = scratch.table(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = scratch.table(keyed.join(sizes, ["k", "v"]), "blocks")
    few = shared.filter(F.col("n") <= DENSE)
    other = few.select("k", "v", F.col("fp").alias("b"))
    pairs = (few.join(other, ["k", "v"]).filter("fp < b")
             .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits)
             .select(F.col("fp").alias("a"), "b"))
    many = shared.filter(F.col("n") > DENSE)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    mask_of = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("k") + 1)
    probes = (many.select("fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(mask_of) == 0)).alias("f"))
              .select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("w")).distinct())
    if max_bits == 1:  # then a shared word proves a link only if it is one of the two
        known = probes.join(many.select(F.col("fp").alias("w")).distinct(), "w", "left_semi")
        return pairs.unionByName(known.filter("fp != w").select(
            F.least("fp", "w").alias("a"), F.greatest("fp", "w").alias("b"))).distinct()
    probes = scratch.table(probes, "probes")
    stars = scratch.table(probes.groupBy("w").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1"), "stars")
    near = probes.join(stars, "w").filter("fp != m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(near).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root): the smallest node reachable from each node that has a link.  Rounds of large-star and small-star
    run until a round changes nothing; each round's links are a table in the shared folder."""
    now = scratch.table(edges.select("a", "b"), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = (both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct())
        large = scratch.table(large, "large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        low = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (down.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("b")).filter("b != m")
                 .select(F.col("m").alias("a"), "b").distinct())
        now = scratch.table(small, "small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, blocks: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, fp, text_hash, root, component_id``.

    ``fp`` is the fingerprint (signed), ``root`` the smallest fingerprint of the component, ``component_id`` the smallest
    id in it.  Null and empty texts have fingerprint zero and link like any other.  Null ids are linked too, but count as
    the smallest id only where a component has no other (then it is null).  Repeated rows each return.
    """
    spark = docs.sparkSession
    with Scratch(spark, "simhash") as scratch:
        each = scratch.keep(docs.select(
            F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"),
            F.xxhash64(text_col).alias("text_hash")), "prints")
        distinct = scratch.table(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        found = components(links(distinct.select("fp"), scratch, max_bits, blocks), scratch)
        rooted = distinct.join(found, distinct.fp == found.node, "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root"))
        rooted = scratch.table(rooted, "rooted")
        first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        classes = scratch.keep(rooted.select("fp", "root").join(first, "root"), "classes")
    return each.join(classes, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input with one row of each component, all columns unchanged: the smallest id, of equal ids the smallest hash of
    the text, of equal rows any one."""
    of = near_duplicates(docs, id_col, text_col, **how)
    best = of.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("r"))
    best = best.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"))
    rows = docs.withColumn("__hash_of_text", F.xxhash64(text_col))
    kept = rows.join(best, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash_of_text") == F.col("__hash")),
                     "left_semi")
    return kept.dropDuplicates([id_col, "__hash_of_text"]).drop("__hash_of_text")
