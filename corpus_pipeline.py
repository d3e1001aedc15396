"""The corpus pipeline: documents in, packed training sequences out.

``run`` applies STAGES to the table ``documents``.  Each stage's rows are written as Parquet into the shared folder and read
again as the next stage's documents.  All stages but the last keep the columns of the input, whatever they are.
"""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mirrorframe.llm import credentials, mixing, packing, quality, simhash
from mirrorframe.llm.common import Scratch, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (null and empty texts too)."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return credentials.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their size to the power 0.7: documents are repeated or left out, and dealt in a new order."""
    return mixing.mix(docs, seed=7, temperature=0.7, columns=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), size=2048, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("packing", packed),
]

#: Tokenising and fingerprints are not SQL; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "packed")
