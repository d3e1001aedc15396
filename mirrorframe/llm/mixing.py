"""Mixing sources to target weights by Poisson replication.

A source that holds ``size_s`` characters and should hold a share ``w_s`` of a mix of ``budget`` characters repeats each of
its documents at the mean rate ``w_s * budget / size_s``.  The number of copies of a document is the Poisson quantile, at
that mean, of a uniform number hashed from the seed and the document; documents are exploded by it and the copies dealt
out in the order of a second hash.  All of it is DataFrame functions.
"""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch


def _uniform(*parts):
    """A number in (0, 1) from the md5 of the parts: 52 bits, moved by half a step so that it is never 0 or 1."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source_col: str, text_col: str, weights: dict | None = None, temperature: float = 0.7,
          budget_ratio: float = 1.0) -> DataFrame:
    """Rows (source, size, rate, cdf): the repetition rate of each source and the cumulative Poisson probabilities at it.

    ``weights`` gives target weights by source (a source it lacks gets none); without it a source weighs its size to the
    power ``temperature``.  A null source is a source of its own.  The budget is ``budget_ratio`` times all characters.
    A source without a character repeats at the rate ``budget_ratio`` if it has a weight.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double"),
                            F.when(F.col("source").isNull(), float(weights.get(None, 0.0))).otherwise(0.0))
    sized = size.withColumn("weight", weight)
    all_weight, all_size = (sized.agg(F.sum(c)).scalar() for c in ("weight", "size"))
    rate = F.when(F.col("size") == 0, F.when(F.lit(weights is None) | (F.col("weight") > 0), F.lit(float(budget_ratio)))
                  .otherwise(0.0)) \
        .otherwise(F.col("weight") / all_weight * all_size * F.lit(float(budget_ratio)) / F.col("size"))
    rated = sized.select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    # beyond this many copies the distribution's tail is under a double's precision
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rated.select("source", "size", "rate", F.explode(
        F.when(F.col("rate") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(-1)))).alias("k"))
    # a row for each number of copies; a running sum of the logs, then of the probabilities
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == 0, -F.col("rate")).when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double")))
    summed = terms.withColumn("log", F.sum(step).over(upto)).withColumn("p", F.sum(F.exp("log")).over(upto))
    listed = F.array_sort(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "p"))))
    return summed.groupBy("source").agg(F.max("size").alias("size"), F.max("rate").alias("rate"), listed.alias("ps")).select(
        "source", "size", "rate", F.when(F.col("rate") > 0, F.transform("ps", lambda x: x["p"])).alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7,
        weights: dict | None = None, temperature: float = 0.7, budget_ratio: float = 1.0,
        columns: bool = True) -> DataFrame:
    """The copies of the documents, all columns unchanged, in an order that a hash of seed, document and copy fixes.

    With ``columns`` the rows also carry ``copy`` (1, 2, ... of a document), ``n_copies``, ``rate`` and ``mix_key`` (the
    order), which replace input columns of the same names.  A null id is drawn by the hash of the text; repeated rows draw
    the same number; null texts count no characters; an empty table gives an empty mix.

    The rates are written as a table in the shared folder first.  Spark then knows their size when it plans the join: it
    broadcasts them below its threshold, and the texts are not exchanged by source; a larger table of sources is joined by a
    shuffle.  The order's key is uniform, so its ranges are known without a sample and the copies are drawn once.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    spark = docs.sparkSession
    with Scratch(spark, "rates") as scratch:
        table = scratch.keep(rates(docs, source_col, text_col, weights, temperature, budget_ratio).select(
            F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf")).coalesce(1))
    drawn = (docs.join(table, F.col(source_col).eqNullSafe(F.col("__source")))
             .filter(F.col("__rate") > 0)
             .withColumn("__own", own)
             .withColumn("__u", _uniform(F.lit(str(seed)), F.col("__own")))
             .withColumn("__n", F.size(F.filter("__cdf", lambda p: p < F.col("__u"))))
             .filter("__n > 0"))
    names = [c for c in docs.columns if not columns or c not in ("copy", "n_copies", "rate", "mix_key")]
    copies = drawn.select(*names, "__rate", "__n", "__own", F.explode(F.sequence(F.lit(1), "__n")).alias("__copy"))
    copies = copies.withColumn("__key", _uniform(F.lit(f"{seed}/order"), F.col("__own"), F.col("__copy").cast("string")))
    extra = [F.col("__copy").alias("copy"), F.col("__n").alias("n_copies"), F.col("__rate").alias("rate"),
             F.col("__key").alias("mix_key")] if columns else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = copies.repartitionById(parts, F.floor(F.col("__key") * parts).cast("int"))
    return ranged.sortWithinPartitions("__key", "__own", "__copy").select(*names, *extra)
