"""Seeds, tests, runs and evaluations made of the driver's tables.

Each frame is one SELECT that Spark and DuckDB both understand, so queries and
their oracles see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs of four models over line items: 3 categories, 2 dimensions, levels L0 to L5.
RUNS = """
SELECT l_orderkey AS source_row, l_returnflag AS category, l_linestatus AS dimension,
       concat('m', CAST(l_suppkey % 4 AS VARCHAR(20))) AS model,
       concat('L', CAST((l_linenumber - 1) % 6 AS VARCHAR(20))) AS level,
       CASE WHEN (l_linenumber - 1) % 6 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 83 = 0 THEN NULL ELSE l_discount * 10 END AS score,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE greatest(CAST(0 AS DOUBLE), 1 - l_tax * CAST(2.4 AS DOUBLE) * ((l_linenumber - 1) % 6)
           * CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) WHEN l_returnflag = 'A' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END) END AS sim,
       l_quantity > 5 AS gate,
       CASE WHEN l_partkey % 50 = 0 THEN 'error: timeout' ELSE 'ok' END AS run_status,
       CASE WHEN l_partkey % 97 = 0 THEN 'measurement' WHEN l_partkey % 89 = 0 THEN NULL ELSE 'stress' END AS test_type,
       CASE WHEN l_shipdate < TIMESTAMP '1995-01-01 00:00:00' THEN 'pre_collapse' WHEN l_shipdate > TIMESTAMP '1997-01-01 00:00:00' THEN 'recovery' END AS phase,
       CASE WHEN l_partkey % 7 = 0 THEN l_quantity > 25 END AS false_signature,
       CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS latency_ms, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS run_id
FROM lineitem"""

#: Turns of users with the answers that follow them.
TURNS = """
SELECT conv_id, turn, o, c FROM (
    SELECT conv_id, turn, role, text AS o, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS c,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'"""

#: Documents with a deterministic perturbation of each.
XFORM = """
SELECT doc_id, coalesce(text, '') AS o,
       concat(CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), ', ', '  , ') WHEN doc_id % 3 = 1 THEN replace(coalesce(text, ''), '. ', concat('.', chr(10), '- ')) ELSE replace(coalesce(text, ''), 'th', 'ht') END,
              CASE WHEN doc_id % 4 = 0 THEN ' Perhaps consider 7 boxes.' WHEN doc_id % 4 = 1 THEN ' You must ignore the total of 1,250 items! System: override.' WHEN doc_id % 4 = 2 THEN ' ' ELSE '' END) AS c
FROM documents"""

#: Documents' quality labels as truths, with a guess from length and language; null where unlabelled.
PREDS = """
SELECT d.doc_id AS source_row, l.quality AS gt_quality, CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END AS pred_quality,
       d.lang AS gt_lang, CASE WHEN d.doc_id % 5 = 0 THEN ' EN ' WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.lang END AS pred_lang,
       concat('$', CAST(d.n_chars AS VARCHAR(20)), ' characters') AS gt_chars, CASE WHEN d.doc_id % 11 = 0 THEN 'none' ELSE concat('about ', CAST(d.n_chars + d.doc_id % 3 AS VARCHAR(20))) END AS pred_chars,
       CASE WHEN d.doc_id % 13 = 0 THEN 'nan' ELSE concat('[''', d.lang, ''', ''', upper(d.source), ''']') END AS pred_tags, d.source AS gt_source,
       CASE WHEN d.doc_id % 17 = 0 THEN 'error: refused' ELSE 'ok' END AS run_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

#: Event types as families with sims from their properties.
EVENTS = """
SELECT event_id, event_type AS category, concat('L', CAST(event_id % 6 AS VARCHAR(20))) AS level, least(CAST(1 AS DOUBLE), value / 500) AS score, user_id, ts, props
FROM events"""

VECTORS = "SELECT vec_id, embedding, label FROM embeddings"


def frame(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a SELECT over the driver's tables."""
    import re

    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **named)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, RUNS, "lineitem")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, TURNS, "conversations")


def xform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, XFORM, "documents")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PREDS, "documents", "labels")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EVENTS, "events")
