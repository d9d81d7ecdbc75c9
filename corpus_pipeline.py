"""The training-data pipeline: quality rules, language ID, line dedup, near-duplicates, packing.

Each stage hands the documents to its operator under names of its own, so that no column of theirs can clash with a result,
and gives them back as they were. Defined results of all stages: an empty table gives an empty result; extra columns pass
through whatever their names; repeated rows and null keys are rows like others.

* quality_rules: a null or empty text fails the base rule and goes; a null source has no host verdict.
* language_id: a text without a letter goes, as does one farther than LEAST_SCORE from every learned language. If nothing
  was learned (no row has a language), every document stays.
* line_dedup: the first occurrence of a passage stays (null keys last); a document that loses every line goes.
* minhash_near_dedup: one row of each class stays; texts without a word stay.
* best_fit_packing: key, piece, start, size, bin, capacity, offset of every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import language_id, line_dedup, near_dup, packing, quality_rules
from lexloom.llm._work import free_name, written
from lexloom.llm.queries import word_tokens

#: No SQL expresses language profiles, weighted sampling and packing.
ORACLE_SQL = None
#: Of the nearest language. Documents in a learned language scored 0.35 and more on all of 12,000, random letters 0.24 and less from 20 words on.
LEAST_SCORE = 0.28


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator's result has, and the new name of each column."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and whose host isn't rejected."""
    held, at = aside(docs)
    out = quality_rules.host_quality(held, text=at["text"], host=at["source"])
    return out.where(F.col("kept")).select(*at.values()).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents near enough to a language, by profiles learned from the labelled documents."""
    profiles = language_id.learned_profiles(docs.select("text", "lang"))
    if not profiles:
        return docs
    held, at = aside(docs)
    out = language_id.predict_language(held, profiles, text=at["text"])
    good = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return out.where(good).select(*at.values()).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated three-line windows but the first from the texts; n_chars follows. Documents that lose every line go."""
    held, at = aside(docs)
    out = line_dedup.line_dedup(held, key=at["doc_id"], text=at["text"])
    cut, text, n = F.col("n_removed") > 0, F.col(at["text"]), F.col(at["n_chars"])
    out = out.where(~cut | (F.length(text) > 0)).withColumn(at["n_chars"], F.when(cut, F.length(text).cast("long")).otherwise(n))
    return out.select(*at.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one with the smallest id, null ids last, then by a hash of the row. Texts without a word stay."""
    row = free_name(docs, "row_id")
    # Rows that share it are equal, so any of them may stay.
    named = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("h")))
    found = near_dup.near_duplicates(named.select(row, "text"), key=row, sets=True)
    kept = found.where(F.col("class_id") == F.col(row)).select(row)
    worded = F.coalesce(F.col("text").rlike(near_dup.WORD), F.lit(False))
    # Equal rows meet before the shuffle.
    once = named.where(worded).dropDuplicates([row]).join(kept, row, "left_semi").select(*docs.columns)
    return once.unionByName(docs.where(~worded))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of the documents that are left."""
    return packing.best_fit_packing(word_tokens(docs))


STAGES = [("quality_rules", quality), ("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read again, a point to recover from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
