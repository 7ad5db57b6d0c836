"""Corpus cleaning: language ID, quality rules, line dedup, near duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All stages but the last return the columns of documents, and n_chars follows
the text. Empty inputs pass through every stage and end in an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscast.llm import langid, line_dedup, ngram_join, packing, quality
from obscast.llm.queries import tokenizer_path
from obscast.llm.shared import Scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Predictions below this calibrated probability do not count as a language.
MIN_SCORE = 0.4
#: Word shingles and similarity from which documents are near duplicates.
WIDTH, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is recognised as one of the corpus's languages."""
    model = langid.fit(docs.where(~langid.held_out()))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return langid.predict(docs.select(*COLUMNS), model).where(known).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality.keep_good(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    cleaned = line_dedup.dedup(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words all stay.

    It is that of the least doc_id, null after all others; among rows of one doc_id that of
    the least text hash, and one of equal rows.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        groups = ngram_join.components(docs, WIDTH, PERCENT)
        first = groups.where("doc_id = component_id").select("doc_id")
        return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)
    # Ids do not name rows here: rows get a key of their own, by which groups are found.
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    groups = ngram_join.components(keyed.select(F.col("key").alias("doc_id"), "text"), WIDTH, PERCENT)
    groups = stored(groups.withColumnRenamed("doc_id", "key").distinct(), "row-groups")
    named = keyed.select("key", "doc_id").join(groups.where("n_shingles > 0"), "key")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    first = named.groupBy("component_id").agg(least.alias("least")).select("least.key")
    # A second hash, so that texts whose keys collide are not taken for equal rows.
    found = keyed.join(first, "key", "left_semi").groupBy("key", F.xxhash64(F.lit("text"), "text"))
    found = found.agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    wordless = keyed.join(groups.where("n_shingles = 0"), "key", "left_semi")
    return found.unionByName(wordless.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    before, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs = after
    packed = stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packed")
    scratch.close()
    return packed
