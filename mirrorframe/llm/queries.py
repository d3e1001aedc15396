"""The registered queries of this subpackage and their DuckDB SQL."""
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorframe.llm import (chunk_prints, credentials, jaccard, language, main_text, mixing, oracles, packing, quality,
                             ranking, simhash, substrings, trie, warc)
from mirrorframe.llm.common import Scratch, read


def op1_warc(spark, sf_dir):
    """Archives of all pages, written and read back; repeated page rows each have a record."""
    with Scratch(spark, "warc") as scratch:
        records = warc.plan_records(read(spark, sf_dir, "pages"), scratch)
        manifest = scratch.keep(warc.write_archives(records, scratch.path("archives")), "manifest")
        held = warc.resolve_revisits(warc.read_archives(spark, manifest), scratch)
    return held.select(
        F.expr("try_cast(key AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


def op2_simhash(spark, sf_dir):
    of = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return of.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark, sf_dir):
    """Sources mixed at their size to the power 0.7, as many characters as there are."""
    return mixing.mix(read(spark, sf_dir, "documents"), seed=7, temperature=0.7).select(
        "doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "mix_key", "text")


def op4_main_text(spark, sf_dir):
    return main_text.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = language.identify(docs, docs.filter(fifth != 0))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark, sf_dir):
    return quality.quality_signals(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_fingerprints(spark, sf_dir):
    return chunk_prints.compare_with_next(read(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), size=2048, end_id=1)


def op9_substrings(spark, sf_dir):
    return substrings.drop_repeats(read(spark, sf_dir, "documents"), window=20)


def op10_secrets(spark, sf_dir):
    return credentials.scan(read(spark, sf_dir, "documents"))


def op11_trie(spark, sf_dir):
    with Scratch(spark, "trie") as scratch:
        turns = trie.turns_in_order(read(spark, sf_dir, "conversations"), scratch)
        members, turns = trie.shared_openings(turns, scratch)
        return trie.prefix_trie(members, turns, scratch)


def op12_search(spark, sf_dir):
    return ranking.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op13_jaccard(spark, sf_dir):
    return jaccard.near_classes(read(spark, sf_dir, "documents"), k=5, percent=80)


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_main_text": op4_main_text,
    "op5_language": op5_language,
    "op6_quality_rules": op6_quality_rules,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_secrets": op10_secrets,
    "op11_trie": op11_trie,
    "op12_search": op12_search,
    "op13_jaccard": op13_jaccard,
}

#: The other queries rest on XXH64, an HTML parser, a tokenizer, learned automata or look-behind patterns.
ORACLES = {
    "op1_warc": oracles.WARC,
    "op3_mixing": oracles.MIXING,
    "op6_quality_rules": oracles.QUALITY,
    "op9_substrings": oracles.SUBSTRINGS,
    "op11_trie": oracles.TRIE,
    "op12_search": oracles.SEARCH,
    "op13_jaccard": oracles.JACCARD,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
