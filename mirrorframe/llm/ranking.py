"""Ranked lexical search by dense blocked matrix products.

The items are cut into blocks of a bounded number of term occurrences, so that what a task holds of them is bounded however
many there are.  For each block one pass over the texts writes each document's length and its counts of the block's terms
(a *bag*); Spark sums the document frequencies over the bags.  The second pass multiplies, in float64, item tiles (the
weights of at most ``TILE_ITEMS`` items over their own compact vocabulary, cut into column tiles) with document tiles (the
impacts of at most ``TILE_DOCS`` bags over the same columns).  All entries are integers, and the column tiles are cut so
that no partial sum can reach 2^53: every product is exact in whatever order the library adds.  Partial sums are added in
64-bit integers.  Each task keeps, per item, what can still be among the best ``k`` (equal scores stay until ids decide), and
two windows reduce the tasks' lists, the first on salted items.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch

#: Terms are runs of ASCII letters and digits and of all code points above 127; only A-Z are lower-cased.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32
                    for b in range(256))
BLOCK_TERMS, TILE_ITEMS, TILE_COLUMNS, TILE_DOCS = 1 << 17, 128, 4096, 512
#: Impacts are below this, and sums of weight times impact must stay below 2^53.
IMPACT_BOUND, EXACT = 1_000_000, 1 << 53
_SALTS = 32


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: id, number of terms, and the vocabulary's terms in it with their counts."""
    schema = "doc_id long, n long, terms array<int>, counts array<int>"

    def bags(batches):
        find = vocabulary.get
        for batch in batches:
            sizes, offsets, ids, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                known = np.array([i for i in map(find, words) if i is not None], np.int32)
                i, c = np.unique(known, return_counts=True)
                ids.append(i)
                counts.append(c.astype(np.int32))
                offsets.append(offsets[-1] + len(i))
            flat = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat(ids))),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat(counts)))],
                names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(bags, schema)


def _exact_tiles(columns: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Column tiles (term numbers, items x columns weights) in each of which no item's sum can reach 2^53."""
    if len(columns) > TILE_COLUMNS:
        half = len(columns) // 2
        return _exact_tiles(columns[:half], weights[:, :half]) + _exact_tiles(columns[half:], weights[:, half:])
    if not len(columns) or int(weights.sum(axis=1).max()) * IMPACT_BOUND < EXACT:
        return [(columns, weights.astype(np.float64))]
    if len(columns) > 1:
        half = len(columns) // 2
        return _exact_tiles(columns[:half], weights[:, :half]) + _exact_tiles(columns[half:], weights[:, half:])
    return _exact_tiles(columns, weights // 2) + _exact_tiles(columns, weights - weights // 2)


def item_tiles(items: list[np.ndarray], weight: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each tile of items its column tiles.  ``items`` hold term numbers, repeats included."""
    tiles = []
    for start in range(0, len(items), TILE_ITEMS):
        part = items[start:start + TILE_ITEMS]
        columns = np.unique(np.concatenate(part))
        columns = columns[weight[columns] > 0]
        sums = np.zeros((len(part), len(columns)), np.int64)
        for row, own in enumerate(part):
            own, n = np.unique(own[weight[own] > 0], return_counts=True)
            sums[row, np.searchsorted(columns, own)] = weight[own] * n
        tiles.append(_exact_tiles(columns, sums))
    return tiles


def impacts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impacts of counts in documents of ``n`` terms."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


class _Best:
    """Per item, the candidates for its best k documents.  A document goes only when k others rank before it."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.rows, self.held = [], 0

    def add(self, item, score, doc, unknown):
        self.rows.append((item, score, doc, unknown))
        self.held += len(item)
        if self.held > 1 << 17:
            self.prune()

    def prune(self):
        item, score, doc, unknown = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((doc, unknown, -score, item))
        item, score, doc, unknown = item[order], score[order], doc[order], unknown[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        keep = rank < self.k
        self.rows = [(item[keep], score[keep], doc[keep], unknown[keep])]
        self.held = int(keep.sum())


def _scores(bags: DataFrame, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents of every item of a block: ``item_no, doc_id, score``."""

    def best_of_task(batches):
        tiles = item_tiles(items, weight)
        best = _Best(len(items), k)
        column_of = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                ids = part.column(0)
                unknown = np.asarray(ids.is_null())
                doc = np.asarray(ids.fill_null(0))
                size = np.asarray(part.column(1))
                offsets = np.asarray(part.column(2).offsets)
                term = np.asarray(part.column(2).flatten())
                row = np.repeat(np.arange(len(doc)), np.diff(offsets))
                value = impacts(np.asarray(part.column(3).flatten()).astype(np.int64), size[row], n_docs, n_terms)
                for number, tile in enumerate(tiles):
                    rows = min(TILE_ITEMS, len(items) - number * TILE_ITEMS)
                    total = np.zeros((rows, len(doc)), np.int64)
                    for columns, weights in tile:
                        column_of[columns] = np.arange(len(columns))
                        at = column_of[term]
                        column_of[columns] = -1
                        here = at >= 0
                        dense = np.zeros((len(columns), len(doc)))
                        dense[at[here], row[here]] = value[here]
                        total += (weights @ dense).astype(np.int64)
                    base = number * TILE_ITEMS
                    item, at = np.nonzero(total >= best.least[base:base + rows, None])
                    best.add(item + base, total[item, at], doc[at], unknown[at])
        if best.rows:
            best.prune()
            item, score, doc, unknown = best.rows[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), pa.array(doc, pa.int64(), mask=unknown), pa.array(score, pa.int64())],
                names=["item_no", "doc_id", "score"])

    return bags.mapInArrow(best_of_task, "item_no int, doc_id long, score long")


def _best(rows: DataFrame, keys: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0.

    Equal scores stand by ascending ``doc_id``, null ids last.  Ids are integers.  Each row of either table counts for
    itself: an item row that repeats gives its list again, a document row that repeats ranks again.  Null and empty texts have no
    terms: such an item has no rows, such a document never ranks and does not count in N.  Empty tables give no rows.
    Other columns of the inputs are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("text"))
    parts = []
    with Scratch(spark, "ranking") as scratch:
        sized = scratch.table(items.withColumn("size", F.octet_length("text")), "items")
        # a term takes at least two octets with what parts it from the next, so blocks hold no more terms than asked for on average
        total = sized.agg(F.sum("size")).first()[0] or 0
        blocks = max(1, -(-total // (2 * block_terms)))
        sized = scratch.table(sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
        for block in range(blocks):
            rows = sized.filter(F.col("block") == block).select("item_id", "text").collect()  # bounded by block_terms
            terms = [terms_of(r["text"].encode("utf-8", "surrogatepass")) for r in rows]
            vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
            if not vocabulary:
                continue
            numbers = [np.array([vocabulary[t] for t in own], np.int64) for own in terms]
            bags = scratch.table(_bags(docs, vocabulary), "bags")
            n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            if not n_docs:
                continue
            df = np.zeros(len(vocabulary), np.int64)
            for r in bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # bounded by the vocabulary
                df[r["t"]] = r["count"]
            weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
            found = _scores(bags, numbers, weight, n_docs, n_terms, k).withColumn(
                "salt", F.spark_partition_id() % _SALTS)
            found = _best(_best(found, ["item_no", "salt"], k), ["item_no"], k)
            named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                          "item_no int, item_id " + items.schema["item_id"].dataType.simpleString())
            parts.append(scratch.keep(found.join(F.broadcast(named), "item_no").select(
                "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "best"))
            scratch.drop("bags")
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
