"""Stylesheets that import stylesheets: which ones a crawl reads, to a chosen
depth or to the end (``css_depth``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import extract as X
from .policy import prefix_sum


def sheet_edges(sheets: DataFrame) -> DataFrame:
    """``sheets(url, css)`` -> ``(sheet, kind, ref_pos, target)``: every
    reference of every sheet, ``data:`` left out."""
    refs = X.extract_css_refs(sheets.withColumnRenamed("url", "sheet"), base_col="sheet", keep=["sheet"])
    return refs.where(~F.col("abs_url").startswith("data:")).select(
        "sheet", "kind", "ref_pos", F.col("abs_url").alias("target"))


def sheet_closure(roots: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """The sheets that a crawl reads: ``roots(crawl_id, url, seq)``, what they
    import, what that imports, and so on, ``depth`` levels in all (None: to
    the end) -> ``(crawl_id, url, level, rank, root)``.

    Each sheet counts once per crawl, where it is met first: by level, then by
    the rank of the sheet that imports it and the place of the import.  So
    sheets that import themselves or one another end.  ``root`` is the root
    that led there.  A level is a join of its keys with the imports, and a
    table in the shared folder; sheets without a row in ``edges`` are read and
    lead nowhere."""
    spark = roots.sparkSession
    key = ["crawl_id", "url"]
    with Scratch(spark, "sheets") as scratch:
        imports = scratch.table(edges.where("kind = 'import'").groupBy("sheet", "target").agg(F.min("ref_pos").alias("pos")))
        first = roots.groupBy(*key).agg(F.min("seq").alias("o"))
        front = prefix_sum(first, ["crawl_id"], ["o", "url"], out="rank").select(
            *key, F.lit(0).alias("level"), "rank", F.col("url").alias("root"))
        levels = [scratch.keep(front)]
        while depth is None or len(levels) < depth:
            met = levels[-1].join(imports, F.col("url") == F.col("sheet")).select(
                "crawl_id", F.col("target").alias("url"), "root", F.struct("rank", "pos").alias("o"))
            new = met.groupBy(*key).agg(F.min("o").alias("o"), F.min_by("root", "o").alias("root")).join(
                reduce(DataFrame.unionByName, levels).select(*key), key, "left_anti")
            new = prefix_sum(new, ["crawl_id"], ["o", "url"], out="rank").select(
                *key, F.lit(len(levels)).alias("level"), "rank", "root")
            new = scratch.keep(new)
            if new.isEmpty():
                break
            levels.append(new)
    return reduce(DataFrame.unionByName, levels)
