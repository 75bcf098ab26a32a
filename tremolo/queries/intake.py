"""Sources, sinks and generation plans that read or write files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.levels import CAP
from ..operators import attempts as A
from ..operators import generate as G
from ..plans.bridge import RUNS, TURNS, XFORM, turns, xform
from ..plans.bridge import runs as all_runs
from ..sources import registry, results, tables
from .registry import query
from .texts import _goal_of, _numbers, _q, _sentences


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/work"
    return f"{top.rstrip('/')}/intake-{uuid.uuid4().hex}"


@query("src02_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, round(c_acctbal, 3)::VARCHAR AS c_acctbal FROM customer")
def csv(spark, sf_dir):
    """SRC-02, SNK-03: a table written as CSV and read again."""
    path = _folder(spark)
    tables.write_csv(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), path)
    return tables.read_csv(spark, path, keep_empty=True)


@query(
    "src01_csv_intake",
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, lang FROM documents",
)
def csv_intake(spark, sf_dir):
    """SRC-01: whole documents written as CSV files of quoted texts with line breaks, in order, read in splits and numbered over all files."""
    path = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # a file for each range of documents; large ones are cut into splits that begin inside of texts
    docs.orderBy("doc_id").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    got = tables.load(spark, ["text"], ["lang"], path=path).df
    return got.select("row_id", "doc_id", F.nullif("text", F.lit("")).alias("text"), "lang")


@query(
    "snk02_results",
    f"""WITH r AS ({RUNS}) SELECT model AS run, source_row, run_id, CASE WHEN source_row % 5 = 0 THEN latency_ms + 1 WHEN source_row % 3 = 0 THEN latency_ms + 2 ELSE latency_ms END AS latency_ms FROM r""",
)
def checkpointed(spark, sf_dir):
    """SNK-01, SNK-02: three batches of responses, two of them with seeds that were asked again; the first two are played twice, and merged before the last."""
    path = _folder(spark)
    rows = all_runs(spark, sf_dir).select(F.col("model").alias("run"), "source_row", "run_id", "latency_ms")
    again = lambda n, more: rows.where(F.col("source_row") % n == 0).withColumn("latency_ms", F.col("latency_ms") + more)
    batches = [rows, again(3, 2), again(5, 1)]
    for number in (0, 1, 0, 1):
        results.append(batches[number], path, number, buckets=8)
    results.compact(spark, path, buckets=8)
    results.append(batches[2], path, 2, buckets=8)
    return results.read(spark, path)


@query("src03_rows", "SELECT * FROM (VALUES (0, 'a', 1), (1, 'b', 2)) v(row_id, question, answer)")
def rows(spark, sf_dir):
    return tables.load(spark, ["question"], ["answer"], rows=[{"question": "a", "answer": 1}, {"question": "b", "answer": 2}]).df.select("row_id", "question", "answer")


@query("src01_intake", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, source FROM documents")
def intake(spark, sf_dir):
    """SRC-01, SRC-04, FIL-10: a table's rows numbered in order, outputs with inferred types."""
    got = tables.load(spark, ["text"], ["lang", "source"], table=spark.read.parquet(f"{sf_dir}/documents.parquet"), order="doc_id")
    return got.df.select("row_id", "doc_id", "source")


@query("src05_models", "SELECT concat('m', (s_suppkey % 3)::VARCHAR) AS model, s_suppkey % 3 + 1 AS model_order, count(*) AS n FROM supplier GROUP BY ALL")
def models(spark, sf_dir):
    """SRC-05: all models' evaluation files of a dataset, a folder each."""
    top = _folder(spark)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    for i in range(3):
        tables.write_csv(suppliers.where(F.col("s_suppkey") % 3 == i).select("s_suppkey", "s_name"), f"{top}/m{i}__d/eval.csv")
    found = tables.read_models(spark, top, "d", ["m0", "m1", "m2"])
    return found.groupBy("model", "model_order").agg(F.count("*").alias("n"))


_REPLY = "CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN 'None' WHEN doc_id % 3 = 0 THEN NULL ELSE concat(' Reply ', CAST(doc_id AS VARCHAR(20)), chr(10)) END"
_MADE = {  # what a reply r (null if it says nothing) makes of the fields s (source) and t (text)
    "append": "coalesce(s || ' ' || t || chr(10) || r, s || ' ' || t)",
    "wrap": "s || ' ' || coalesce(r, t)",
    "task": "CASE WHEN r IS NULL THEN s || ' ' || t ELSE '[SOURCE] ' || r || chr(10) || chr(10) || 'Source:' || chr(10) || s || chr(10) || '[BODY] ' || t END",
    "source": "s || ' ' || coalesce(r, t)",
    "measure": "s || ' ' || t",
    "decision": "coalesce(r, s || ' ' || t)",
    "per_field": "s || ' ' || coalesce(r, t)",
    "delimited": "s || ' ' || coalesce(r, t)",
    "json": "s || ' ' || coalesce(r, t)",
}
_OK = {"measure": "true", "per_field": "true", "delimited": "true", "json": "true"}


@query(
    "gen02_strategies",
    f"WITH d AS (SELECT doc_id, source AS s, trim(text) AS t, nullif(nullif(trim({_REPLY}, ' ' || chr(10)), ''), 'None') AS r FROM documents WHERE trim(coalesce(text, '')) NOT IN ('', 'nan', 'NaN')) "
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS strategy, {_OK.get(k, 'r IS NOT NULL')} AS ok, md5({v}) AS c FROM d" for k, v in _MADE.items()),
)
def strategies(spark, sf_dir):
    """GEN-02: what every strategy makes of useful, blank, empty and absent replies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("trim(coalesce(text, '')) NOT IN ('', 'nan', 'NaN')")
    rows = docs.select("doc_id", A.fields_of(source=F.col("source"), body=F.col("text")).alias("f"), F.expr(_REPLY.replace("VARCHAR(20)", "STRING")).alias("r"))
    said = F.coalesce("r", F.lit(""))
    replies = {"per_field": F.array(F.lit("none"), "r"), "delimited": F.concat(F.lit("as asked\n[FIELD_1]\n\n[FIELD_2]\n"), said), "json": F.to_json(F.struct(F.nullif(F.nullif(F.regexp_replace(said, r"^\s+|\s+$", ""), F.lit("")), F.lit("None")).alias("field_2")))}
    made = [F.struct(F.lit(k).alias("strategy"), A.payload(k, F.col("f"), replies.get(k, F.col("r"))).alias("p")) for k in _MADE]
    return rows.select("doc_id", F.explode(F.array(*made)).alias("x")).select("doc_id", "x.strategy", "x.p.ok", F.md5("x.p.c").alias("c"))


_ROUND = "CAST(conv_id * 7 + turn * 3 + level * 5 + attempt * 11 AS BIGINT)"


@query(
    "gen01_attempts",
    f"""WITH p AS ({TURNS}), a AS (SELECT conv_id, turn, level, attempt, o, least({CAP}::DOUBLE, round(0.3::DOUBLE + level * 0.1::DOUBLE + 0.1::DOUBLE * (attempt - 1), 2)) AS temperature,
        {_ROUND} % 4 < 2 AS gate, {_ROUND} % 5 < 3 AS level_gate FROM p, range(1, 6) l(level), range(1, 4) n(attempt)),
    f AS (SELECT *, min(CASE WHEN gate AND level_gate THEN attempt END) OVER (PARTITION BY conv_id, turn, level) AS first FROM a)
    SELECT conv_id, turn, level, attempt, temperature, gate, level_gate, md5(coalesce(o, '') || chr(10) || 'Note ' || attempt) AS c FROM f WHERE first IS NULL OR attempt <= first""",
)
def rounds(spark, sf_dir):
    """GEN-01, WIN-06: cells asked in rounds, each only as long as it is not accepted; whole rows of every attempt."""
    cells = turns(spark, sf_dir).select("conv_id", "turn", "o", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("level")).withColumn("base_temperature", F.round(0.3 + F.col("level") * 0.1, 2))

    def respond(frontier):
        n = F.expr(_ROUND)
        made = A.payload("append", A.fields_of(text=F.coalesce("o", F.lit(""))), F.concat(F.lit("Note "), F.col("attempt").cast("string")))
        return frontier.withColumns({"gate": n % 4 < 2, "level_gate": n % 5 < 3, "c": F.md5(made["c"])})

    found = A.ask_until_accepted(cells, respond, _folder(spark), attempts=3)
    return found.select("conv_id", "turn", "level", F.col("attempt").cast("long").alias("attempt"), "temperature", "gate", "level_gate", "c")


@query("gen01_candidates", f"SELECT 35 * 2 * count(*) AS n FROM ({TURNS})")
def candidates(spark, sf_dir):
    """GEN-01, GEN-11: seeds by families, levels and attempts."""
    seeds = turns(spark, sf_dir).select(F.col("conv_id").alias("source_row"), "turn", F.col("o").alias("question"))
    return G.candidates(seeds, registry.test_specs(spark)).agg(F.count("*").alias("n"))


_NUMS, _UNITS = f"list_sort(list_distinct({_numbers('o')}))", f"list_sort(list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: list_contains([{', '.join(_q(w) for w in T.UNIT_WORDS)}], w))))"


@query(
    "txt44_anchors",
    f"""WITH p AS ({XFORM}), a AS (SELECT doc_id, coalesce(o, '') AS o, lower(coalesce(o, '')) AS low FROM p), b AS (SELECT *, {_sentences('trim(low)')} AS ss FROM a),
    g AS (SELECT doc_id, {_NUMS} AS nums, {_UNITS} AS units, {_goal_of('low', 'coalesce(ss[len(ss)], low)')} AS goal FROM b)
    SELECT doc_id, 'SEMANTIC ANCHORS (must be preserved exactly):' || chr(10) || CASE WHEN len(nums) > 0 THEN '- Numbers: ' || array_to_string(nums, ', ') || chr(10) ELSE '' END
        || CASE WHEN len(units) > 0 THEN '- Units: ' || array_to_string(units, ', ') || chr(10) ELSE '' END || CASE WHEN goal <> 'find_unknown' THEN '- Goal: ' || goal || chr(10) ELSE '' END AS block FROM g""",
)
def anchors(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.anchors(G.core("o")).alias("block"))


@query("txt45_validity", "SELECT doc_id, 'SYSTEM UNDER TEST: sorts' || chr(10) || CASE WHEN source IS NULL THEN '' ELSE 'EXPECTED RESPONSE: ' || trim(source) || chr(10) END AS block FROM documents")
def validity(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", G.validity(F.col("source"), F.lit("sorts")).alias("block"))


@query(
    "txt39_number_variants",
    f"WITH p AS ({XFORM}) SELECT doc_id, len({_numbers('c')}) AS n_list, len(list_distinct({_numbers('c')})) AS n_set, array_to_string(regexp_extract_all(c, {_q(T.MONEY_NUMBER)}), '|') AS money FROM p",
)
def number_variants(spark, sf_dir):
    n = T.numbers("c")
    return xform(spark, sf_dir).select("doc_id", F.size(n).cast("long").alias("n_list"), F.size(F.array_distinct(n)).cast("long").alias("n_set"), F.array_join(T.money_numbers("c"), "|").alias("money"))


_LEX = f"list_transform(regexp_extract_all(c, {_q(T.WORD + '|' + T.NUMBER)}), lambda n: CASE WHEN regexp_matches(n, '^-?[0-9]') THEN replace(n, ',', '') ELSE n END)"


@query("txt40_lexical_tokens", f"WITH p AS ({TURNS}) SELECT conv_id, turn, array_to_string({_LEX}, ' ') AS tokens FROM p WHERE c IS NOT NULL")
def lexical(spark, sf_dir):
    return turns(spark, sf_dir).where("c IS NOT NULL").select("conv_id", "turn", F.array_join(T.lexical_tokens("c"), " ").alias("tokens"))
