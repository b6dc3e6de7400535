"""Corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.jaccard_join import jaccard_groups
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import learn, score_documents
from tidemark.llm.shared import discard, id_order, staged
from tidemark.llm.substring_dedup import remove_repeats

#: A document whose score of quality is below this goes.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects.

    Null and empty texts are judged like any other, repeated rows alike, and
    null ids are no hindrance; columns pass through whatever their names.  An
    empty table stays empty.
    """
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, scorer, name).where(F.col(name) >= LEAST_SCORE).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest doc_id, null ids last.

    A document is a doc_id and a text: rows that repeat both are one, and one
    of them stays; rows without an id, or that repeat one with another text,
    are documents like any other.  Of equal ids in a group the text with the
    smallest hash stays.  Texts without words are near copies of nothing.  An
    empty table stays empty; other columns pass through whatever their names.
    """
    groups = jaccard_groups(docs).select(F.col("doc_id").isNull().alias("_null"), id_order("doc_id").alias("_id"), F.col("check").alias("_text"), "root")
    own = F.struct("_null", "_id", "_text")
    best = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(own).alias("own")).select("own.*")
    kept = best.union(groups.where("root IS NULL").select("_null", "_id", "_text").distinct())
    # the row goes as one column, so that its own names clash with nothing
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("_null"), id_order("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    keys = ["_null", "_id", "_text"]
    many = row.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    kept = staged(kept.join(many, keys, "left"), "kept")
    once = row.join(kept.where("_n IS NULL").select(*keys).hint("shuffle_hash"), keys)
    # rows that repeat a document: one of them stays, chosen in every task before it moves, however many there are
    again = row.join(kept.where("_n IS NOT NULL").select(*keys), keys).select("row", F.struct(*keys).alias("_k")).dropDuplicates(["_k"])
    return once.select("row.*").unionByName(again.select("row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every 100-byte string that also starts earlier; a document with nothing left goes.

    A null or empty text stays as it is, and so do rows that repeat an id and a
    text, as neither is earlier; null ids stand before all others.  An empty
    table stays empty; other columns pass through, ``n_chars`` is counted anew.
    """
    cut = remove_repeats(docs, with_text=True).where("n_removed = 0 OR kept <> ''")
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(columns[c].alias(c) if c in columns else F.col(f"row.{c}") for c in docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item.

    Null and empty texts leak nothing; repeated rows go or stay alike; null ids
    are no hindrance.  An empty table or benchmark drops nothing; other columns
    pass through whatever their names.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids.

    A null text is an empty one (its end mark alone); repeated rows are packed
    each; a null id stays null.  An empty table gives no pieces; other columns
    are left out.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", leaks), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)  # what is written now holds all that the next stage reads
    return STAGES[-1][1](spark, docs, sf_dir)
