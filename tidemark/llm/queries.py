"""One registered query per text operator, with production parameters, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.collocations import collocations
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.html_layout import extract_text
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.line_dedup import dedup_lines, kept_text
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import held_out, learn, score_documents
from tidemark.llm.resampling import resample
from tidemark.llm.shards import arrive_and_compact
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.warc import read_archives, write_archives
from tidemark.llm.winnowing import fingerprints


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding_size_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the latest version of a store holds them, after arrivals and size-tiered compaction: texts as digests, with shard, its size and tier, and the version."""
    rows = arrive_and_compact(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars", "shard", "shard_bytes", "tier", "version")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    back = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    sound = F.when(F.col("kind") == "record", F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), "archive", F.lit(" "), "reason")).cast("long"))
    return back.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, with the aligned stretch: ``doc_id, item_id, ...``."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.75 or more: ``doc_id, n_shingles, component_id``."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text: ``doc_id, n_chars, edited_sha256, fingerprint, ...``."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page as it is laid out: ``page_id, url, text, n_chars, n_lines, n_tables``."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_pu_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by text: ``doc_id, held_out, score, predicted``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families by paragraph classifier and template: ``doc_id, n_paragraphs, n_licensed, license, ...``."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go, by bitmaps: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    rows = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2(kept_text("row.text", "keep"), 256).alias("kept_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of 2 to 3 words: ``lang, rank, phrase, a, l, r, n, score``."""
    return collocations(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the benchmark: ``doc_id, n_features, weight, score, rank``."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sharding_size_tiered, op2_warc_salvage, op3_suffix_array_dedup, op4_ffd_packing, op5_qgram_decontamination, op6_ngram_jaccard_join, op7_winnowing_fingerprints, op8_html_layout_text, op9_pu_quality_classifier, op10_license_scan, op11_line_dedup, op12_phrase_collocations, op13_importance_resampling)}
ORACLES = {"op2_warc_salvage": sql.WARC_RECORDS, "op3_suffix_array_dedup": sql.REMOVED_REPEATS, "op6_ngram_jaccard_join": sql.JACCARD_COMPONENTS, "op11_line_dedup": sql.LINES_KEPT, "op12_phrase_collocations": sql.COLLOCATIONS, "op13_importance_resampling": sql.RESAMPLED}
