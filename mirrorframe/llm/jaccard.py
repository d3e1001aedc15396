"""Similarity join on word n-grams by vertical partitioning.

A text's set is its distinct n-gram hashes.  Documents with equal sets are one class from the start; only sets are joined.

1. *Sieve.*  Of sets that link, each holds a known number of the other's n-grams among the smallest hashes.  Sets too few of
   whose smallest hashes occur in any other set link with nothing and go; that takes a third of the n-grams.
2. *Global order.*  The n-grams of the sets left are counted and ordered by frequency, rare ones first.  Those of one set only
   count towards its size and go.
3. *Fragments.*  The order is cut at quantiles of the n-gram mass into fragments; a set is one segment in each.
4. *Candidates.*  Sets that link share an n-gram among the first of their n-grams in the global order (prefixes, with length and
   position bounds).  First every set is tried with one set of each n-gram in its prefix; then, where an n-gram joins sets that
   are not yet connected, all pairs of sets in different components are tried.  Pairs inside a component decide nothing, so a
   group of near copies costs a star and not its square.
5. *Counting.*  A pair's common n-grams are counted in each fragment separately, segment against segment, and summed.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch
from mirrorframe.llm.simhash import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: N-grams that the sieve holds in a task at a time.
SIEVE_BLOCK = 1 << 22
#: Bits of a hash that the sieve looks at (it may keep a set too many, never lose one).
_SIEVE_SHIFT = np.uint64(16)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 13)
        return h


def gram_set(text: bytes | None, k: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word n-grams; of fewer words the one whole sequence; of none nothing."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * _ODD[i % len(_ODD)] + w[i:len(w) - size + 1 + i]
    for odd in _ODD[:2]:
        h = (h ^ (h >> np.uint64(31))) * odd
    return np.unique(h ^ (h >> np.uint64(33)))


def _needed(n, percent: int):
    """Least overlap of a set of n n-grams with any set that it links with."""
    return -(-percent * n // 100)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))


def _prints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document its id, the hash of its text, size and key of its set, and ``alone``: those of the set's smallest hashes that
    no other set of the same block has.  ``met`` counts the others, and rows without a key list them once for other blocks.
    So an n-gram leaves a block once, however many sets there have it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n long, key long, met long, alone array<long>"

    def prints(batches):
        known, ids, hashes, sizes, keys, sets, seen, held, id_type = _WordHashes(), [], [], [], [], [], set(), 0, None

        def out(t):
            long = pa.int64()
            return pa.schema([("doc_id", t), ("text_hash", long), ("n", long), ("key", long), ("met", long),
                              ("alone", pa.list_(long))])

        def block():
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            values, back, times = np.unique(flat, return_inverse=True, return_counts=True)
            shared = times[back] > 1
            met = np.bincount(owner[shared], minlength=len(sets))
            ends = np.cumsum([0, *np.bincount(owner[~shared], minlength=len(sets))])
            single = flat[~shared]
            alone = [single[a:b] for a, b in zip(ends, ends[1:])]
            common = values[times > 1]
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(met, pa.int64()), _lists(alone)],
                schema=out(id_type))
            for i in range(0, len(common), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_type), nothing, nothing, nothing, nothing, _lists([common[i:i + (1 << 16)]])],
                    schema=out(id_type))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                grams = gram_set(text.as_py(), k, known)
                n, key = len(grams), xxhash.xxh64_intdigest(grams.tobytes(), 7)
                new = n and key not in seen
                seen.add(key)
                part = grams[:n - _needed(n, percent) + 1 + n // 10] >> _SIEVE_SHIFT if new else grams[:0]
                held += len(part)
                ids.append(i.as_py())
                hashes.append(t.as_py())
                sizes.append(n)
                keys.append(key)
                sets.append(part)
            if held > SIEVE_BLOCK:
                yield from block()
                ids, hashes, sizes, keys, sets, held = [], [], [], [], [], 0
        if ids:
            yield from block()

    return docs.mapInArrow(prints, schema)


def _sieve(prints: DataFrame, percent: int) -> DataFrame:
    """Keys of the sets that may link: enough of their smallest hashes are in other sets."""
    of = F.explode("alone").alias("h")
    rows = prints.filter("size(alone) > 0").select("key", "n", "met", of)
    w = F.count(F.lit(1))
    # a hash comes at most once from a block (either from one set, or in the list of the shared)
    met = (rows.withColumn("blocks", w.over(Window.partitionBy("h")))
           .filter("blocks > 1 AND key IS NOT NULL").groupBy("key", "n").agg(w.alias("more")))
    own = prints.filter("key IS NOT NULL AND n > 0").groupBy("key", "n").agg(F.max("met").alias("met"))
    # of a linked pair the smaller set has at least percent of the larger one's n-grams, and so a tenth of those
    least = F.floor(_ceil_percent(F.col("n"), percent) / 10) + 1
    return (own.join(met, ["key", "n"], "left")
            .filter(F.col("met") + F.coalesce("more", F.lit(0)) >= least).select("key", "n"))


def _ceil_percent(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def sets(batches):
        known = _WordHashes()
        for batch in batches:
            own = [gram_set(t.as_py(), k, known) for t in batch.column(0).cast(pa.binary())]
            keys = np.array([xxhash.xxh64_intdigest(g.tobytes(), 7) for g in own], np.uint64)
            for i in range(0, len(own), 256):
                part = own[i:i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:i + 256].view(np.int64)), pa.array([len(g) for g in part], pa.int64()), _lists(part)],
                    names=["key", "n", "grams"])

    return texts.mapInArrow(sets, "key long, n long, grams array<long>")


class _Join:
    """The sets that passed the sieve, as prefixes and segments, and what has been counted so far."""

    def __init__(self, sets: DataFrame, scratch: Scratch, percent: int, fragments: int):
        self.scratch, self.percent = scratch, percent
        rows = scratch.table(sets.select("key", "n", F.explode("grams").alias("h")), "grams")
        often = scratch.table(rows.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
        rows = rows.join(often, "h")
        ordered = scratch.table(rows.groupBy("key", "n").agg(
            F.sort_array(F.collect_list(F.struct("f", "h"))).alias("grams"), F.sum("f").alias("mass")), "ordered")
        scratch.drop("grams")
        scratch.drop("often")
        # place in the global order as one number; only the cuts use it
        place = lambda g: g["f"] + F.shiftrightunsigned(g["h"], 11) / float(1 << 53)
        cuts = ordered.select(F.explode("grams").alias("g")).agg(F.percentile_approx(
            place(F.col("g")), [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
        bounds = [float("-inf"), *cuts, float("inf")]

        def segment(low: float, high: float) -> Column:
            inside = F.filter("grams", lambda g: (place(g) > low) & (place(g) <= high))
            return F.transform(inside, lambda g: g["h"]).alias("segment")

        pieces = F.array(*[F.struct(F.lit(i).alias("fragment"), segment(a, b))
                           for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
        self.segments = scratch.table(ordered.select("key", F.explode(pieces).alias("p")).select("key", "p.*")
                                      .filter("size(segment) > 0"), "segments")
        n, alone = F.col("n"), F.col("n") - F.size("grams")
        probe = n - _ceil_percent(n, percent) + 1
        # overlap that two sets of this size need: ceil(2 n p / (100 + p))
        index = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)) + 1
        self.prefixes = scratch.table(
            ordered.select("key", "n", alone.alias("alone"), index.alias("index"), "mass", F.posexplode(
                F.slice("grams", F.lit(1), F.greatest(F.lit(0).cast("long"), probe - alone).cast("int"))))
            .select("key", "n", F.col("col.h").alias("h"), (F.col("alone") + F.col("pos")).alias("at"), "alone", "mass",
                    (F.col("alone") + F.col("pos") < F.col("index")).alias("first")), "prefixes")

    def possible(self) -> Column:
        """Of rows (n, at) and (m, to): sizes and places of a common n-gram allow a link, if it is the first common one."""
        p = self.percent
        close = (100 * F.least("n", "m") >= p * F.greatest("n", "m"))
        rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))
        return close & ((100 + p) * rest >= p * (F.col("n") + F.col("m")))

    @staticmethod
    def pairs(rows: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) with sizes from rows with keys ``key`` and ``other``."""
        swap = F.col("key") > F.col("other")
        return rows.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"),
                           F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n_a"),
                           F.when(swap, F.col("n")).otherwise(F.col("m")).alias("n_b")).distinct()

    def stars(self) -> DataFrame:
        """Each set with one set of every n-gram of its prefix: that with the fewest n-grams of its own, then with the most
        frequent ones (``mass``: how often they occur in all), likely the text that the group's others were made from."""
        hub = self.scratch.table(self.prefixes.groupBy("h").agg(
            F.min(F.struct("alone", (-F.col("mass")).alias("rare"), "key", "n", "at")).alias("s"))
            .select("h", F.col("s.n").alias("m"), F.col("s.key").alias("other"), F.col("s.at").alias("to")), "hubs")
        return self.pairs(self.prefixes.join(hub, "h").filter("key != other").filter(self.possible()))

    def across(self, roots: DataFrame) -> DataFrame:
        """All pairs with a common n-gram in their prefixes and different components.  Rows of an n-gram's largest
        component meet the others only, so a component costs nothing beside itself."""
        s = self.scratch
        rows = self.prefixes.join(roots, F.col("key") == F.col("node"), "left").withColumn(
            "root", F.coalesce("root", "key")).drop("node")
        mixed = s.table(rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")), "shares")
        mixed = (mixed.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"))
                 .filter("k > 1").select("h", "main"))
        rows = s.table(rows.join(s.table(mixed, "mixed"), "h"), "rows")
        fewer = rows.filter("root != main")
        other = rows.select("h", F.col("key").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"),
                            F.col("first").alias("first_too"), F.col("root").alias("root_too"))
        shorter = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("key") < F.col("other")))
        both = (fewer.join(other, "h").filter("root != root_too")
                .filter(F.when(shorter, F.col("first")).otherwise(F.col("first_too"))).filter(self.possible()))
        return self.pairs(both)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: common n-grams counted per fragment and summed."""
        b = self.segments.select(F.col("key").alias("b"), "fragment", F.col("segment").alias("of_b"))
        a = self.segments.select(F.col("key").alias("a"), "fragment", F.col("segment").alias("of_a"))
        parts = pairs.join(b, "b").join(a, ["a", "fragment"]).select(
            "a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
        total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
        p = self.percent
        return total.filter((100 + p) * F.col("common") >= p * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                 fragments: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Sets link when 100 times their common n-grams reach ``percent`` times those of either; ``component_id`` is the smallest
    id reachable by links, the row's own included.  Null, empty and blank texts have size 0 and are linked with nothing, not
    even with one another: their component is their own id.  Rows with null ids take part; a component that has no other
    id gets null.  Repeated rows each return.  An empty table gives no rows; other columns are not looked at.
    N-grams are told apart by 64-bit hashes, and sets by the hash of theirs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    with Scratch(spark, "jaccard") as scratch:
        prints = scratch.table(_prints(docs, k, percent), "prints")
        each = scratch.keep(prints.filter("key IS NOT NULL").select("doc_id", "text_hash", "n", "key"), "each")
        passed = scratch.table(_sieve(prints, percent), "passed")
        scratch.drop("prints")
        chosen = scratch.table(each.join(passed, ["key", "n"]).groupBy("key", "n").agg(F.min(F.struct(
            F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r"))
            .select(F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("hash")), "chosen")
        texts = (docs.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
                 .dropDuplicates(["doc_id", "text_hash"]))
        sets = scratch.table(_sets(texts.select("text"), k), "sets")
        join = _Join(sets, scratch, percent, fragments)
        scratch.drop("sets")
        scratch.drop("ordered")
        tried = scratch.table(join.stars(), "tried")
        found = scratch.table(join.links(tried), "links")
        rest = scratch.table(join.across(scratch.table(components(found, scratch), "roots"))
                             .join(tried.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        more = scratch.table(join.links(rest), "more")
        roots = scratch.table(components(found.unionByName(more), scratch), "roots2")
        classes = each.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"))
        classes = scratch.table(classes.join(roots, F.col("key") == F.col("node"), "left").select(
            "key", "first_id", F.coalesce("root", "key").alias("root")), "classes")
        least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
        ids = scratch.keep(classes.join(least, "root").select("key", "component_id"), "ids")
    return each.join(ids, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
