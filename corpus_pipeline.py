"""A training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.llm.common import rows_of, set_aside, small, stage, tokenizer_path
from ledgerrecon.llm.decontaminate import cut_passages
from ledgerrecon.llm.jaccard import similar_documents
from ledgerrecon.llm.packing import assign_sequences, token_pieces
from ledgerrecon.llm.quality import COUNTS, judge
from ledgerrecon.llm.secrets import redact_secrets
from ledgerrecon.llm.tokens import LEAN


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or fall under a learned rule go; the labels are those of the corpus."""
    docs, originals = set_aside(docs, (*COUNTS, "base_failed", "rule", "kept"))
    judged, _ = judge(docs, rows_of(spark, sf_dir, "labels"))
    return judged.where("kept").select(*originals)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.75 one row stays; without a set, all stay.

    The keeper is the row with the smallest (id with NULL last, hash of the text, hash of all columns); of rows
    equal in all of these any one. Documents that nothing links to stay, also without an id.
    """
    docs, originals = set_aside(docs, ("_row", "_text", "_keeper", "_copies"))
    # maps have no hash
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # NULLs are skipped by the hash, so what is NULL counts by itself
    row = F.xxhash64(*hashed, *(c.isNull() for c in hashed)).alias("_row")
    rows = docs.select("*", row)
    found = similar_documents(rows.select("_row", "text"), size=5, threshold=75, id_col="_row")
    # rows equal in all columns have one key, and so one component
    linked = stage(found.groupBy(F.col("id").alias("_keeper")).agg(
        F.max("component_id").alias("component_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("_copies")), "linked")
    ids = rows.select("_row", "doc_id", F.xxhash64("text").alias("_text")).dropDuplicates(["_row"])
    placed = linked.join(ids, F.col("_keeper") == F.col("_row"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_row")
    single = placed.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(rank.alias("rank"), "_copies")).alias("first"))
    keep = stage(
        single.select(F.col("first.rank._row").alias("_keeper"), F.col("first._copies").alias("_copies"))
        .union(linked.where("n_shingles = 0").select("_keeper", F.lit(1).cast("long"))), "keepers")
    # fewer rows go than stay, and while they are few the texts need not be shuffled
    gone = stage(linked.select("_keeper").join(keep.where("_copies = 1"), "_keeper", "left_anti"), "gone")
    kept = rows.join(small(gone), F.col("_row") == F.col("_keeper"), "left_anti")
    if (several := keep.where("_copies > 1")).limit(1).count():
        repeated = rows.join(small(several), F.col("_row") == F.col("_keeper"), "left_semi")
        kept = kept.union(repeated.dropDuplicates(["_row"]))
    return kept.select(*originals)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words are cut out; documents that are mostly such passages go."""
    return cut_passages(docs, rows_of(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    docs, originals = set_aside(docs, ("base_spans", "spans", "_candidates", "_cut"))
    return redact_secrets(docs).select(*originals)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row for each piece, with the digest of its ids and its place."""
    pieces = token_pieces(
        docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048, tables=LEAN, ids=F.crc32("ids").alias("ids_crc32"))
    packed = assign_sequences(pieces, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Learned rules and tokenizers cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = rows_of(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
