"""The registered queries of this package: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.llm.common import rows_of, tokenizer_path
from ledgerrecon.llm.decontaminate import find_passages
from ledgerrecon.llm.html_text import extract_main_text
from ledgerrecon.llm.jaccard import similar_documents
from ledgerrecon.llm.licenses import find_licenses
from ledgerrecon.llm.packing import assign_sequences, token_pieces
from ledgerrecon.llm.quality import judge
from ledgerrecon.llm.search import ranked_search
from ledgerrecon.llm.secrets import find_secrets, span_text
from ledgerrecon.llm.sharding import shard_by_size
from ledgerrecon.llm.spelling import count_words, group_variants
from ledgerrecon.llm.substrings import remove_repeats
from ledgerrecon.llm.token_files import read_tokens, write_tokens
from ledgerrecon.llm.urls import judge_urls, site_rule, word_rule
from ledgerrecon.session import shared_path

SITE_RULES = [
    site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
]
#: For URLs that no site rule fits.
SPAM_RULES = [
    word_rule("block", "cheap", "pills"), word_rule("block", "spam", "farm"), word_rule("block", "casino"),
    word_rule("block", "free", "money"), word_rule("block", "adult"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_size(docs, shards=40, overhead=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, rows_of(spark, sf_dir, "benchmark"), window=10, keep_text=False)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    judged, _ = judge(docs, rows_of(spark, sf_dir, "labels"), keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule",
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    packed = assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=20, keep_text=False).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(rows_of(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    def of(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(of(kind) for kind in ("assign", "access", "hex")),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs, size=5, threshold=75).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(rows_of(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "text_digest", "license_id", F.array_join("notices", ",").alias("notices"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(rows_of(spark, sf_dir, "pages").select("page_id", "url"), SITE_RULES + SPAM_RULES)
    site = F.col("rule").isin([r.name for r in SITE_RULES])
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_tokens(rows_of(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(rows_of(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, rows_of(spark, sf_dir, "benchmark"), k=20).select("item_id", "rank", "doc_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(rows_of(spark, sf_dir, "documents"), min_length=7, min_count=2, drop_every=31)
    return group_variants(words, factor=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scans": op8_license_scans,
    "op9_url_filters": op9_url_filters,
    "op10_token_files": op10_token_files,
    "op11_html_extraction": op11_html_extraction,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}
