"""Sources, row selection, joins, sets and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import match as M
from ..operators import curation as C
from ..operators import joins as J
from ..plans.bridge import EVENTS, RUNS, TURNS, XFORM, event_runs, runs, turns, xform
from ..sources import registry as S
from .registry import query
from .texts import _q

R = f"WITH runs AS ({RUNS})"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else _q(v) if isinstance(v, str) else f"{v!r}"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


@query("src06_test_specs", f"SELECT * FROM (VALUES {_values((c, f, f'L{i + 1}', S.PHASES[i], S.TEMPERATURES[f][i]) for c, f in C.FAMILY_TAGS.items() for i in range(5))}) v(category, family, level, phase, temperature)")
def specs(spark, sf_dir):
    """SRC-06, SRC-08: a row for each family and level."""
    return S.test_specs(spark).select("category", "family", "level", "phase", "temperature")


@query("src07_test_names", f"SELECT * FROM (VALUES {_values((c,) for c in C.FAMILY_TAGS)}) v(category)")
def names(spark, sf_dir):
    return S.test_names(spark)


@query("src09_templates", f"SELECT customer.c_custkey, template_id, replace(template, '{{question}}', customer.c_name) AS rendered FROM customer, (VALUES {_values(t for t in S.TEMPLATES if t[1] == 'format')}) v(template_id, family, level, template) WHERE level = 'L2'")
def templates(spark, sf_dir):
    """Every customer's name in the format templates of level 2 (two of them)."""
    rows = _table(spark, sf_dir, "customer").join(F.broadcast(S.templates(spark, "format", "L2")))
    return rows.select("c_custkey", "template_id", S.render(F.col("template"), {"question": F.col("c_name")}).alias("rendered"))


@query("sim14_kb_levels", f"SELECT * FROM (VALUES {_values(S.KB_LEVELS)}) v(level, boundary_type, expected_behavior, level_name)")
def kb_levels(spark, sf_dir):
    return S.kb_levels(spark)


@query("gat20_definitions", "SELECT p_partkey FROM part WHERE NOT (p_size % 6 IN (0, 1, 2, 3, 4) AND p_size % 5 IN (0, 1, 2, 3))")
def definitions(spark, sf_dir):
    """Definitions outside the vocabulary, made of parts."""
    pick = lambda names, x: F.get(F.array(*(F.lit(n) for n in names)), x)
    defs = _table(spark, sf_dir, "part").select("p_partkey", pick([*S.VOCABULARY["aggregation_rule"], "mode"], F.col("p_size") % 6).alias("aggregation_rule"), pick([*S.VOCABULARY["output_type"], "image"], F.col("p_size") % 5).alias("output_type"))
    return S.invalid_definitions(defs).select("p_partkey")


@query("fil01_first_n", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def first_n(spark, sf_dir):
    """FIL-01, LIM-01."""
    return C.select_rows(_table(spark, sf_dir, "customer"), "first_n", 25, key="c_custkey").select("c_custkey", "c_name")


@query("fil01_indices", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9)")
def indices(spark, sf_dir):
    return C.select_rows(_table(spark, sf_dir, "customer"), "indices", ids=[1, 5, 9], key="c_custkey").select("c_custkey", "c_name")


@query("fil01_random_n")
def random_n(spark, sf_dir):
    """A sampling operator: the same rows for a seed, whatever the partitions."""
    return C.select_rows(_table(spark, sf_dir, "customer"), "random_n", 25, key="c_custkey").select("c_custkey")


@query("fil02_admitted", f"{R} SELECT category, count(*) AS n FROM runs WHERE gate GROUP BY category")
def admitted(spark, sf_dir):
    return C.admitted(runs(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query("fil03_without_measurements", f"{R} SELECT test_type, count(*) AS n FROM runs WHERE test_type IS DISTINCT FROM 'measurement' GROUP BY test_type")
def without_measurements(spark, sf_dir):
    return C.without_measurements(runs(spark, sf_dir)).groupBy("test_type").agg(F.count("*").alias("n"))


@query("fil04_split", f"{R} SELECT 'stress' AS part, count(*) AS n FROM runs WHERE level <> 'L0' UNION ALL SELECT 'baseline', count(*) FROM runs WHERE level = 'L0'")
def split(spark, sf_dir):
    a, b = C.split_baseline(runs(spark, sf_dir))
    return a.agg(F.count("*").alias("n")).select(F.lit("stress").alias("part"), "n").unionByName(b.agg(F.count("*").alias("n")).select(F.lit("baseline").alias("part"), "n"))


@query("fil05_kb_rows", f"{R} SELECT source_row, run_id FROM runs WHERE category = 'N'")
def kb_rows(spark, sf_dir):
    return runs(spark, sf_dir).where("category = 'N'").select("source_row", "run_id")


_PLAIN = r"trim(regexp_replace(replace({x}, '[QUESTION]', ''), '\s+', ' ', 'g'))"


@query(
    "fil06_ambiguous",
    f"""WITH p AS ({TURNS}), r AS (SELECT conv_id, turn, coalesce(o, '') AS o, coalesce(o || ' ' || coalesce(c, '') || CASE WHEN conv_id % 3 = 0 THEN ' She also bought a lamp for $12.' ELSE ' Imagine he also paid $5.' END, '') AS c FROM p),
    a AS (SELECT conv_id, turn, replace({_PLAIN.format(x='c')}, {_PLAIN.format(x='o')}, '') AS added FROM r)
    SELECT conv_id, turn, NOT (regexp_matches(added, {_q(C.SAME_SUBJECT)}) AND regexp_matches(added, {_q(C.PRICE)}) AND NOT regexp_matches(added, {_q(C.SET_ASIDE)})) AS kept FROM a""",
)
def ambiguous(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumns({"category": F.lit("Context Interference"), "c": F.concat("o", F.lit(" "), F.coalesce("c", F.lit("")), F.when(F.col("conv_id") % 3 == 0, " She also bought a lamp for $12.").otherwise(" Imagine he also paid $5."))})
    kept, dropped = C.drop_ambiguous(rows)
    return kept.select("conv_id", "turn", F.lit(True).alias("kept")).unionByName(dropped.select("conv_id", "turn", F.lit(False).alias("kept")))


@query("fil07_joined_fields", "SELECT p_partkey, array_to_string(list_filter([trim(p_name), trim(p_brand), trim(p_type)], lambda x: x IS NOT NULL AND lower(x) NOT IN ('', 'nan', 'none')), ' ') AS input FROM part")
def joined_fields(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", C.joined_fields("p_name", "p_brand", "p_type").alias("input"))


_TYPE = "CASE WHEN lower(trim(x)) IN ('', 'nan', 'none', 'n/a', 'null') THEN 'categorical' WHEN regexp_matches(translate(trim(x), ',%$', ''), '^\\s*[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?\\s*$') THEN 'numeric' WHEN length(trim(x)) > 60 OR (length(trim(x)) > 30 AND contains(trim(x), ' ')) THEN 'text' ELSE 'categorical' END"


@query("fil08_detect_type", f"SELECT doc_id, {_TYPE.replace('x)', 'text)')} AS text_type, {_TYPE.replace('x)', 'n_chars::VARCHAR)')} AS size_type, {_TYPE.replace('x)', 'source)')} AS source_type FROM (SELECT doc_id, coalesce(text, '') AS text, n_chars, coalesce(source, '') AS source FROM documents)")
def detect_type(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", M.detect_type(F.col("text")).alias("text_type"), M.detect_type(F.col("n_chars").cast("string")).alias("size_type"), M.detect_type(F.col("source")).alias("source_type"))


@query("fil11_level_int", f"{R} SELECT run_id, CAST(substr(level, 2) AS INT) AS level_no, -1 AS bad FROM runs")
def level_int(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", L.level_int(F.concat(F.lit(" "), F.lower("level"))).alias("level_no"), L.level_int(F.col("category")).alias("bad"))


@query("fil12_risk", f"{R} SELECT run_id, round(score * (1 - sim), 6) AS risk FROM runs")
def risk(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", F.round(C.risk(F.col("score"), F.col("sim")), 6).alias("risk"))


_TAGS = ["Semantic Variation", "Context Load", "Temporal Consistency"]


@query("fil13_family_tag", f"{R} SELECT run_id, CASE category WHEN 'A' THEN 'SV' WHEN 'R' THEN 'CL' END AS family FROM runs")
def family_tag(spark, sf_dir):
    named = F.when(F.col("category") == "A", _TAGS[0]).when(F.col("category") == "R", _TAGS[1]).otherwise(_TAGS[2])
    return runs(spark, sf_dir).select("run_id", C.family_tag(named).alias("family"))


@query("fil14_correct", f"{R} SELECT run_id, coalesce(sim >= 0.8::DOUBLE, FALSE) AS correct FROM runs")
def correct(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", C.correct(F.col("sim")).alias("correct"))


@query("fil15_parse_fields", "SELECT p_partkey, trim(p_name) AS name, trim(p_type) AS kind, '' AS missing FROM part")
def parse_fields(spark, sf_dir):
    text = F.concat(F.lit("[NAME] "), "p_name", F.lit("\n[BRAND] "), "p_brand", F.lit("\n[KIND] "), "p_type", F.lit(" "))
    rows = _table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", C.parse_field(F.col("t"), "NAME", ["BRAND", "KIND"]).alias("name"), C.parse_field(F.col("t"), "KIND", []).alias("kind"), C.parse_field(F.col("t"), "SIZE", []).alias("missing"))


@query("fil16_parse_delimited", "SELECT p_partkey, p_brand AS field_1, p_name AS field_2 FROM part")
def parse_delimited(spark, sf_dir):
    text = F.concat(F.lit("noise\n[FIELD_1]\n\n[FIELD_2]\n"), "p_name")
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", text.alias("t"))
    return rows.select("p_partkey", C.parse_field(F.col("t"), "FIELD_1", ["FIELD_2"], F.col("p_brand")).alias("field_1"), C.parse_field(F.col("t"), "FIELD_2", [], F.lit("?")).alias("field_2"))


@query("fil17_first_filled", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), source) AS level, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang || ' | ' || source END AS prediction FROM documents")
def first_filled(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", C.first_filled(lang, F.col("source")).alias("level"), C.prediction_text([lang, F.col("source")], F.lit("")).alias("prediction"))


# -- joins ----------------------------------------------------------------------------


@query("join01_intake", "SELECT o_orderkey, coalesce(c.c_name, (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1)) AS name FROM orders LEFT JOIN customer c ON CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -1 ELSE o_custkey END = c.c_custkey")
def intake(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 4 == 0, None).when(F.col("o_orderkey") % 4 == 1, -1).otherwise(F.col("o_custkey"))
    responses = _table(spark, sf_dir, "orders").select("o_orderkey", key.alias("source_row"))
    seeds = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_row"), F.col("c_name").alias("name"))
    return J.with_intake(responses, seeds).select("o_orderkey", "name")


@query("join02_criteria", f"{R} SELECT run_id, coalesce(w_sim, 0.5) AS w_sim, coalesce(temperature, 0) AS temperature FROM runs LEFT JOIN (VALUES {_values((f'L{i + 1}', 0.7, S.TEMPERATURES['SV'][i]) for i in range(5))}) v(level, w_sim, temperature) USING (level)")
def criteria(spark, sf_dir):
    """JOIN-02, JOIN-03: levels' criteria, defaults at L0."""
    table = S.test_specs(spark).where("family = 'SV'").select("level", "w_sim", "temperature")
    return J.with_criteria(runs(spark, sf_dir).select("run_id", "level"), table, "level", defaults={"w_sim": 0.5, "temperature": 0.0}).select("run_id", "w_sim", "temperature")


_FALL = _values((i + 1, lo, hi) for i, (lo, hi) in enumerate(L.FALLBACK))


@query("join05_range", f"{R} SELECT run_id, (SELECT min(level_no) FROM (VALUES {_FALL}) b(level_no, lo, hi) WHERE score >= lo::DOUBLE AND score < hi::DOUBLE) AS level_no FROM runs")
def level_ranges(spark, sf_dir):
    bands = [(i + 1, lo, hi) for i, (lo, hi) in enumerate(L.FALLBACK)]
    return runs(spark, sf_dir).select("run_id", J.level_ranges(F.col("score"), bands).alias("level_no"))


@query("join06_inject", f"{R} SELECT category, level, count(*) AS n FROM (SELECT category, level FROM runs WHERE level <> 'L0' UNION ALL SELECT g.category, 'L0' FROM runs, (SELECT DISTINCT category FROM runs WHERE level <> 'L0') g WHERE level = 'L0') GROUP BY ALL")
def inject(spark, sf_dir):
    rows = runs(spark, sf_dir).select("category", "level")
    return J.inject(rows.where("level = 'L0'"), rows.where("level <> 'L0'"), "category").groupBy("category", "level").agg(F.count("*").alias("n"))


@query("join10_undone", "SELECT c_custkey AS source_row FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 11 = 0)")
def undone(spark, sf_dir):
    return C.undone(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_row")), _table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("source_row")))


@query("join12_row_order", "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents), b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS r FROM benchmark) SELECT doc_id, b.text AS source_text FROM d LEFT JOIN b USING (r)")
def row_order(spark, sf_dir):
    tests = J.numbered(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    source = J.numbered(_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source_text")), "item_id")
    return J.link_source(tests, source, "row_order").select("doc_id", "source_text")


@query("join12_multi_chunk", "SELECT c_custkey, s.source_text FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS source_text FROM orders GROUP BY o_custkey) s ON c_custkey = o_custkey")
def multi_chunk(spark, sf_dir):
    source = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("chunk"), F.col("o_orderpriority").alias("source_text"))
    return J.link_source(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id")), source, "multi_chunk").select(F.col("row_id").alias("c_custkey"), "source_text")


@query("join13_verbatim", f"WITH p AS ({XFORM}) SELECT doc_id, contains(c, o) AS verbatim, contains(lower(c), lower(trim(o))) AS loosely FROM p")
def verbatim(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", F.contains("c", "o").alias("verbatim"), F.contains(F.lower("c"), F.lower(F.trim("o"))).alias("loosely"))


@query("join14_matrix", f"{R} SELECT category, " + ", ".join(f"round(avg(CASE WHEN model = 'm{i}' THEN sim END), 4) AS m{i}" for i in range(4)) + " FROM runs GROUP BY category")
def matrix(spark, sf_dir):
    table = runs(spark, sf_dir).groupBy("category").pivot("model", [f"m{i}" for i in range(4)]).agg(F.avg("sim"))
    return table.select("category", *(F.round(f"m{i}", 4).alias(f"m{i}") for i in range(4)))


# -- sets, order ------------------------------------------------------------------------


@query("set01_union", f"{R} SELECT category, level, count(*) AS n FROM (SELECT category, level FROM runs UNION ALL SELECT category, level FROM ({EVENTS})) GROUP BY ALL")
def union(spark, sf_dir):
    return runs(spark, sf_dir).select("category", "level", "sim").unionByName(event_runs(spark, sf_dir).select("category", "level", "score"), allowMissingColumns=True).groupBy("category", "level").agg(F.count("*").alias("n"))


@query("sort01_levels", f"{R} SELECT level, count(*) AS n FROM runs GROUP BY level ORDER BY level")
def levels(spark, sf_dir):
    """SORT-01, SORT-02."""
    return C.order_by_level(runs(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n")))


@query("stream_events", f"WITH e AS ({EVENTS}) SELECT date_trunc('day', ts) AS start, category, count(*) AS n, round(sum(s * score) / nullif(sum(score), 0), 4) AS steadiness FROM (SELECT *, CAST(props->>'$.k' AS DOUBLE) / 100 AS s FROM e) GROUP BY ALL")
def stream_form(spark, sf_dir):
    """The streaming rollup run over the whole table as a batch."""
    from ..streaming.rollup import windowed_steadiness

    rows = event_runs(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "category", "score", (F.get_json_object("props", "$.k").cast("double") / 100).alias("sim"))
    return windowed_steadiness(rows)


@query("agg22_event_latency", f"WITH e AS ({EVENTS}) SELECT category, count(*) AS n, round(avg(score), 4) AS mean_score, round(quantile_cont(score, 0.95), 4) AS p95 FROM e GROUP BY category")
def event_latency(spark, sf_dir):
    return event_runs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.percentile("score", F.lit(0.95)), 4).alias("p95"))


@query("run01_plan", f"WITH p AS ({TURNS}) SELECT conv_id AS source_row, 'Temporal Consistency' AS category, 'L0' AS level, o AS input, unnest([1, 2, 3]) AS round FROM p UNION ALL SELECT conv_id, 'Input Quality', 'L1', c, 1 FROM p WHERE conv_id % 2 = 0")
def plan(spark, sf_dir):
    from ..operators.evaluate import run_plan

    rows = turns(spark, sf_dir)
    seeds = rows.select(F.col("conv_id").alias("source_row"), F.col("o").alias("question"))
    tests = rows.select(F.col("conv_id").alias("source_row"), F.lit("Input Quality").alias("category"), F.lit("L1").alias("level"), "c", (F.col("conv_id") % 2 == 0).alias("gate"))
    return run_plan(seeds, tests)
