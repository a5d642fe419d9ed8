"""Corpus pipeline: from raw documents to token counts of a clean, deduplicated corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet and reads it again for the next one.  All stages but the last return the
columns of ``documents``.

1. quality classifier: documents scored under 0.3 go;
2. line dedup: later occurrences of repeated line chunks go from the texts, and a document
   that loses all its lines goes (texts that were null or empty before stay);
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity of
   0.8 or more) one row stays, that with the smallest id (null last), then the smallest text key;
   of rows equal in id and text one stays, and all rows without words;
4. benchmark decontamination: documents that cover a test item go;
5. SentencePiece encoding and decoding: a row of token digests for each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexistore.llm import decontaminate, jaccard_join, line_dedup, quality, sentencepiece_codec
from lexistore.llm.common import Scratch, by_shuffle, row_id_a, row_id_b, scratch_freed, table
from lexistore.llm.queries import KEEP_FROM, PIECE_MODEL

WIDTH, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the rows of ``docs`` that have labels."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, forest).where(F.col("score") >= KEEP_FROM).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).where("removed is null or text <> ''")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the least id (null last), then text key, then hash of the row; all rows without words stay."""
    scratch = Scratch(spark, "near-duplicates")
    found = jaccard_join.jaccard_components(docs, WIDTH, PERCENT).where("n_shingles > 0").select("row_a", "row_b", "doc_id", "root")
    found = scratch.write(found, "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "row_a", "row_b")).alias("at")).select("at.row_a", "at.row_b")
    keys = found.select("row_a", "row_b").distinct().join(first.withColumn("first", F.lit(True)), ["row_a", "row_b"], "left")
    marks = scratch.write(keys.select("row_a", "row_b", F.coalesce("first", F.lit(False)).alias("first")), "marks")
    scratch.drop("found")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_id_a(), row_id_b())
    kept = rows.join(by_shuffle(marks), ["row_a", "row_b"], "left").where("first is null or first")
    copy = F.row_number().over(Window.partitionBy("row_a", "row_b").orderBy(F.xxhash64("row")))  # rows equal in id and text
    return kept.withColumn("copy", copy).where("first is null or copy = 1").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select("row.*")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", tokenised),
]

#: Boosted trees, rolling hashes and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with scratch_freed():  # what a stage wrote on its way isn't needed once its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
