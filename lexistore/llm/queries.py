"""The ``opN_`` queries: each operator over its whole table, with digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, pii, quality, secrets, sentencepiece_codec, sharding, substring_dedup, topk
from .common import table

SHARDS = 24
PIECE_MODEL = "piece_bpe_32k.model"
KEEP_FROM = 0.3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["first"]), F.lit(0))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    by_id = lambda a, b: F.when(a.isNull(), 1).when(b.isNull(), -1).otherwise(F.signum(a - b))  # noqa: E731  ids differ
    best = F.element_at(F.array_sort("hits", lambda a, b: F.when(a["coverage"] != b["coverage"], F.signum(b["coverage"] - a["coverage"])).otherwise(by_id(a["item_id"], b["item_id"])).cast("int")), 1)
    found = found.select(F.col("row.doc_id").alias("doc_id"), "hits")  # by itself, so that no other column of the row is shuffled
    found = found.select("doc_id", "hits", F.when(F.size("hits") > 0, best).alias("best"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).cast("int").alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",", "null").alias("items"),
        F.col("best.item_id").alias("best_item"),
        F.col("best.coverage").alias("best_coverage"),
        F.col("best.tiles").alias("best_tiles"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree_of(SHARDS), sharding.tree_of(SHARDS + 1))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("strong")), 256).alias("base_sha256"), secrets.joined(F.concat("strong", "linked")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score_documents(docs.select("doc_id", "text"), forest)
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), quality.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_topk, op3_sentencepiece, op4_pii, op5_substring_dedup, op6_decontaminate, op7_sharding, op8_secrets, op9_quality, op10_jaccard_join, pipeline]
    return {f.__name__: f for f in found}


#: DuckDB SQL where an operator's rows can be said in it.
ORACLE: dict[str, str] = {
    "op2_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) AS score
            FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.r <> v.r AND len(q.e) = len(v.e)
        ), c AS (SELECT r, query_id, vec_id, CAST(greatest(-9223372036854775808, least(9223372036854775807, score)) AS BIGINT) AS score FROM s),
        t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c)
        SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
        ), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM t AS a JOIN t AS b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
        FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) AS c ON c.x = s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
