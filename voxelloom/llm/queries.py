"""The operators as queries over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import binpack, langid, license_scan, mixing, mtree, packing, pii, pqdedup, simhash, token_files
from voxelloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_binary(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_documents(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express: sizes and targets."""
    return op1_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_pii_skip_chain, op3_mtree_top_k, op4_pq_dedup, op5_license_scan, op6_pack_windows, op7_language_id, op8_binary_rows, op9_simhash_dedup, op10_token_counts, mix_targets)
}

ORACLES: dict[str, str] = {
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                     [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
        full_at AS (SELECT cap / w AS level FROM s),
        held AS (SELECT level, (SELECT sum(least(cap, w * level)) FROM s) AS used FROM full_at),
        base AS (SELECT coalesce(max(level), 0) AS level FROM held WHERE used <= 1.5 * (SELECT sum(source_size) FROM s)),
        water AS (SELECT (1.5 * sum(source_size) - coalesce(sum(cap) FILTER (cap / w <= level), 0)) / sum(w) FILTER (cap / w > level) AS level FROM s, base)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(least(cap, w * water.level), 3) AS target
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, water""",
    "op3_mtree_top_k": """
        WITH p AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM p q JOIN p c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_pq_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
}
