"""The operators of this subpackage bound to the driver's tables, and SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefuse.llm import (
    chat, embeddings, html_text, lines, merkle, mixing, packing, quality, secrets, shards, simhash,
    spelling, warc)
from casefuse.llm.common import importable, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(fn):
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(importable(spark), sf_dir)
    return fn


@query
def op1_html_text_blocks(spark, sf_dir):
    """Main text of all pages."""
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


@query
def op2_sharding_kd_tree(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes."""
    return shards.kd_shards(read_table(spark, sf_dir, "documents"), 40)


@query
def op3_mixing_block_slots(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


@query
def op4_secret_randomness(spark, sf_dir):
    """Secrets of all documents."""
    return secrets.find_secrets(read_table(spark, sf_dir, "documents")).drop("found")


@query
def op5_simhash_bit_sliced(spark, sf_dir):
    """SimHash components of all documents."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_warc_dictionary(spark, sf_dir):
    """All pages written to archives and read back."""
    return warc.archive_pages(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op7_embedding_cross_polytope(spark, sf_dir):
    """Links, components and keepers of all vectors."""
    return embeddings.link_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op8_line_site_frequency(spark, sf_dir):
    """Lines of all documents, with the boilerplate of their source taken out."""
    report = lines.line_report(read_table(spark, sf_dir, "documents"), F.col("source"))
    return report.withColumn("text_md5", F.md5("text")).drop("text")


SQL["op8_line_site_frequency"] = lines.report_sql()


@query
def op9_packing_best_fit(spark, sf_dir):
    """Windows of 4096 tokens out of all documents."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_quality_decision_list(spark, sf_dir):
    """Statistics and verdict of all documents."""
    return quality.judge(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "labels"))


@query
def op11_chat_reply_trees(spark, sf_dir):
    """All conversations formatted, with what is read back from the formatted texts."""
    return chat.format_report(read_table(spark, sf_dir, "conversations"))


SQL["op11_chat_reply_trees"] = chat.report_sql()


@query
def op12_merkle_superblocks(spark, sf_dir):
    """Leaf, proof and folded root of all documents, half of them changed."""
    return merkle.manifest_report(read_table(spark, sf_dir, "documents"))


@query
def op13_spelling_q_chunks(spark, sf_dir):
    """Spelling variants among the words of all documents, with letters lost in places."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), one_in=199)
