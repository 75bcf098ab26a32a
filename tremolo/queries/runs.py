"""Aggregations, windows, meta-metrics and scores over runs (bridged from line items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bins, curation, incremental, meta, quantiles, scoring, stress
from ..plans.bridge import RUNS
from ..plans.bridge import runs as bridge
from ..sources import results
from ..streaming import collapse
from .registry import query

R = f"WITH runs AS ({RUNS}), ok AS (SELECT * FROM runs WHERE gate)"
HIT = "CASE WHEN sim >= 0.8::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END"
STAB = "coalesce(sum(CASE WHEN sim IS NOT NULL AND score IS NOT NULL THEN sim * score END) / nullif(greatest(sum(CASE WHEN sim IS NOT NULL THEN score END), 0), 0), avg(sim))"
P = "coalesce(sum(CASE WHEN score > 0 AND sim IS NOT NULL {x} THEN sim * score END) / sum(CASE WHEN score > 0 AND sim IS NOT NULL {x} THEN score END), avg(sim))"
PS, PX = P.format(x=""), P.format(x="AND level <> 'L0'")
MODELS = ["m0", "m1", "m2", "m3"]
LV = ["L1", "L2", "L3", "L4", "L5"]


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.admitted(bridge(spark, sf_dir))


def _acc(by: str = "category", where: str = "TRUE", src: str = "ok") -> str:
    """CTEs base (L0) and acc (L1 to L5) of accuracies, missing sims incorrect."""
    cols = ", ".join(f"round(avg(CASE WHEN level = '{v}' THEN {HIT} END), 4) AS {v}" for v in LV)
    return f"base AS (SELECT round(avg({HIT}), 4) AS L0 FROM {src} WHERE level = 'L0' AND {where}), acc AS (SELECT {by}, {cols} FROM {src} WHERE level <> 'L0' AND {where} GROUP BY {by})"


def _first_below(tau: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {tau} THEN '{v}'" for v in LV) + " END"


@query("agg07_family_collapse", f"{R}, {_acc()} SELECT category, L0, {', '.join(LV)}, round(0.8::DOUBLE * L0, 4) AS tau, {_first_below('0.8::DOUBLE * L0')} AS cp FROM acc, base")
def family_collapse(spark, sf_dir):
    """The flagship: accuracy of each family by level against the baseline, and where it collapses."""
    return A.level_accuracy(admitted(spark, sf_dir), "category")


@query("agg08_model_collapse", f"{R}, {_acc('model, category')} SELECT model, category, {_first_below('0.8::DOUBLE * L0')} AS cp FROM acc, base")
def model_collapse(spark, sf_dir):
    return A.level_accuracy(admitted(spark, sf_dir), "model", "category").select("model", "category", "cp")


@query("agg01_accuracy", f"{R} SELECT category, level, round(avg({HIT}), 4) AS accuracy FROM ok GROUP BY ALL")
def accuracy(spark, sf_dir):
    return admitted(spark, sf_dir).groupBy("category", "level").agg(A.r4(A.accuracy()).alias("accuracy"))


@query("agg01_accuracy_dropping", f"{R} SELECT category, round(avg(CASE WHEN sim IS NULL THEN NULL ELSE {HIT} END), 4) AS accuracy FROM ok GROUP BY ALL")
def accuracy_dropping(spark, sf_dir):
    return admitted(spark, sf_dir).groupBy("category").agg(A.r4(A.accuracy(missing="drop")).alias("accuracy"))


@query("agg02_magnitude", f"{R} SELECT category, level, round(avg(score), 4) AS magnitude FROM ok GROUP BY ALL")
def magnitude(spark, sf_dir):
    return admitted(spark, sf_dir).groupBy("category", "level").agg(A.r4(F.avg("score")).alias("magnitude"))


@query("agg03_steadiness", f"{R} SELECT model, category, round({STAB}, 4) AS steadiness FROM ok WHERE level <> 'L0' GROUP BY ALL")
def steadiness(spark, sf_dir):
    return admitted(spark, sf_dir).where("level <> 'L0'").groupBy("model", "category").agg(A.r4(A.steadiness()).alias("steadiness"))


@query("agg04_steadiness_curve", f"{R} SELECT model, level, round(CASE WHEN level = 'L0' THEN avg(sim) ELSE {STAB} END, 4) AS steadiness FROM ok GROUP BY model, level")
def steadiness_curve(spark, sf_dir):
    return A.steadiness_curve(admitted(spark, sf_dir), "model")


@query("agg05_overall_steadiness", f"{R} SELECT round({STAB}, 4) AS steadiness FROM ok WHERE level <> 'L0'")
def overall_steadiness(spark, sf_dir):
    return admitted(spark, sf_dir).where("level <> 'L0'").agg(A.r4(A.steadiness()).alias("steadiness"))


@query("agg06_family_level_steadiness", f"{R} SELECT category, level, round(CASE WHEN level = 'L0' THEN avg(sim) ELSE {STAB} END, 4) AS steadiness FROM ok GROUP BY category, level")
def family_level(spark, sf_dir):
    return A.steadiness_curve(admitted(spark, sf_dir), "category")


def _cross() -> str:
    one = "coalesce(sum(CASE WHEN model = '{m}' AND sim IS NOT NULL AND score IS NOT NULL THEN sim * score END) / nullif(greatest(sum(CASE WHEN model = '{m}' AND sim IS NOT NULL THEN score END), 0), 0), avg(CASE WHEN model = '{m}' THEN sim END))"
    rows = ", ".join(f"round({one.format(m=m)}, 3) AS {m}" for m in MODELS)
    base = ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN sim END), 3) AS {m}" for m in MODELS)
    return f"{R} SELECT category, {rows} FROM ok WHERE level <> 'L0' GROUP BY category UNION ALL SELECT 'Baseline', {base} FROM ok WHERE level = 'L0'"


@query("agg09_cross_model_table", _cross())
def cross_model(spark, sf_dir):
    return A.cross_model(admitted(spark, sf_dir), MODELS)


SUMMARY = f"count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(sim), 4) AS mean_steadiness, round(avg(score * (1 - sim)), 4) AS mean_risk, round({PS}, 4) AS p_score"


@query("agg10_group_summary", f"{R} SELECT category, dimension, {SUMMARY} FROM ok GROUP BY ALL")
def group_summary(spark, sf_dir):
    return A.group_summary(admitted(spark, sf_dir), "category", "dimension")


@query(
    "agg10_summaries_grouping_sets",
    f"""{R} SELECT CASE grouping(level, category, dimension) WHEN 3 THEN 'level' WHEN 5 THEN 'category' WHEN 6 THEN 'dimension' ELSE 'all' END AS scheme,
    coalesce(level, category, dimension, 'all') AS name, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(sim), 4) AS mean_steadiness, round({PS}, 4) AS p_score
    FROM ok GROUP BY GROUPING SETS ((level), (category), (dimension), ())""",
)
def summaries(spark, sf_dir):
    return A.summaries(admitted(spark, sf_dir))


#: Admitted rows that are not measurements, accuracy over present sims, tau of the shared baseline.
CLEAN = f"{R}, own AS (SELECT * FROM ok WHERE test_type IS DISTINCT FROM 'measurement'), h AS (SELECT *, CASE WHEN sim IS NOT NULL THEN {HIT} END AS hit FROM own)"


def _curve(by: str) -> str:
    cols = ", ".join(f"avg(CASE WHEN level = '{v}' THEN hit END) AS {v}" for v in LV)
    group = f"{by}, " if by else ""
    return f"{CLEAN}, base AS (SELECT coalesce(avg(hit), 0.8::DOUBLE) AS acc_base FROM h WHERE level = 'L0'), c AS (SELECT {group}{cols} FROM h WHERE level <> 'L0' {f'GROUP BY {by}' if by else ''}), k AS (SELECT c.*, acc_base, round(0.8::DOUBLE * acc_base, 4) AS tau FROM c, base)"


def _survival(by: str) -> str:
    count = " + ".join(f"coalesce(({v} >= tau)::BIGINT, 0)" for v in LV)
    return f"{_curve(by)} SELECT {by or chr(39) + 'overall' + chr(39)} AS \"group\", round(acc_base, 4) AS acc_base, tau, {', '.join(f'{v} >= tau AS {v}' for v in LV)}, {count} AS sr_count, round(({count}) * 20::DOUBLE, 1) AS sr_pct FROM k"


for _by in ("", "category", "dimension"):

    @query(f"agg13_survival_{_by or 'overall'}", _survival(_by))
    def _survive(spark, sf_dir, by=_by):
        return stress.survival(bridge(spark, sf_dir), by or "overall")


def _level_metrics(by: str) -> str:
    r = ", ".join(f"round({v}, 4) AS {v}" for v in LV)
    count = " + ".join(f"coalesce(({v} >= tau)::BIGINT, 0)" for v in LV)
    cd = "CASE " + " ".join(f"WHEN {v} < tau THEN coalesce({LV[i - 1] if i else 'NULL'}, acc_base) - {v}" for i, v in enumerate(LV)) + " ELSE 0 END"
    pts = "list_filter([acc_base, " + ", ".join(LV) + "], lambda x: x IS NOT NULL)"
    return f"""{_curve(by)}, q AS (SELECT {by}, acc_base, tau, {r} FROM k), z AS (SELECT *, {pts} AS pts FROM q)
    SELECT {by}, {count} AS sr_count, round(({count}) * 20::DOUBLE, 1) AS sr_pct, {_first_below('tau')} AS cp, round({cd}, 4) AS cd,
    round(list_min(list_transform(range(1, len(pts)), lambda i: pts[i + 1] - pts[i])), 4) AS ss FROM z WHERE coalesce({', '.join(LV)}) IS NOT NULL"""


@query("agg12_level_metrics", _level_metrics("category"))
def level_metrics(spark, sf_dir):
    return stress.level_metrics(bridge(spark, sf_dir), "category")


@query("agg11_stress_metrics", f"SELECT s.*, m.* EXCLUDE (dimension) FROM ({CLEAN} SELECT dimension, {SUMMARY} FROM own GROUP BY dimension) s LEFT JOIN ({_level_metrics('dimension')}) m USING (dimension)")
def stress_metrics(spark, sf_dir):
    return stress.stress_metrics(bridge(spark, sf_dir), "dimension", 0.8)


@query("agg11_stress_by_level", f"{CLEAN} SELECT level, {SUMMARY} FROM own GROUP BY level")
def stress_by_level(spark, sf_dir):
    return stress.stress_metrics(bridge(spark, sf_dir), "level")


@query("agg15_p_scores", f"{R} SELECT category, round({PX}, 4) AS p_score FROM runs GROUP BY category HAVING avg(sim) IS NOT NULL")
def p_scores(spark, sf_dir):
    return A.p_scores(bridge(spark, sf_dir), "category")


@query("agg14_p_score_overall", f"{R} SELECT round({PX}, 4) AS p_score FROM runs")
def p_score(spark, sf_dir):
    return bridge(spark, sf_dir).agg(A.p_score(stress=F.col("level") != "L0").alias("p_score"))


#: The entropy by its definition: shares first, then their logs.
FWE = """fail AS (SELECT {by} AS g, score, sum(score) OVER (PARTITION BY {by}) AS t, count(*) OVER (PARTITION BY {by}) AS n FROM runs WHERE level <> 'L0' AND score IS NOT NULL AND sim < 0.8::DOUBLE),
ent AS (SELECT g, any_value(n) AS n, any_value(t) AS t, -sum(CASE WHEN score > 0 THEN score / t * ln(score / t) ELSE 0 END) AS h FROM fail GROUP BY g),
fwe AS (SELECT k.g, round(CASE WHEN ent.n IS NULL OR ent.t <= 0 THEN 0.5 WHEN ent.n = 1 THEN 1 ELSE 1 - 0.5 * h / ln(ent.n) END, 6)::DOUBLE AS fwe FROM (SELECT DISTINCT {by} AS g FROM runs) k LEFT JOIN ent ON k.g = ent.g)"""


@query("agg17_fwe_by_category", f"{R}, {FWE.format(by='category')} SELECT g AS category, fwe FROM fwe")
def fwe(spark, sf_dir):
    return A.fwe(bridge(spark, sf_dir), "category")


@query("agg16_fwe_by_level", f"{R}, {FWE.format(by='level')} SELECT g AS level, fwe FROM fwe")
def fwe_by_level(spark, sf_dir):
    return A.fwe(bridge(spark, sf_dir), "level")


COMPOSITE = "SELECT round(sum(fwe * p_score) / sum(fwe), 4) AS p_primary, round(sum(fwe) / sum(fwe / (p_score + 1e-6::DOUBLE)), 4) AS p_harmonic"


@query("agg18_composite", f"{R}, {FWE.format(by='category')}, p AS (SELECT category, round({PX}, 4) AS p_score FROM runs GROUP BY category) {COMPOSITE} FROM p JOIN fwe ON category = g")
def composite(spark, sf_dir):
    return A.composite(A.group_scores(bridge(spark, sf_dir), "category"))


@query("agg19_level_summary", f"{R} SELECT level, count(*) AS n, round(avg(sim), 4) AS mean_sim, round(avg(CASE WHEN sim IS NOT NULL THEN {HIT} END), 4) AS pass_rate FROM runs GROUP BY level")
def level_summary(spark, sf_dir):
    return A.level_summary(bridge(spark, sf_dir))


@query("agg20_threshold", f"{R} SELECT round(avg(CASE WHEN level = 'L0' THEN sim END), 4) AS threshold FROM runs")
def threshold(spark, sf_dir):
    return A.threshold(bridge(spark, sf_dir), "baseline").select(A.r4(F.col("threshold")).alias("threshold"))


@query(
    "agg21_metrics",
    f"""{R}, {FWE.format(by='category')}, p AS (SELECT category, round({PX}, 4) AS p_score FROM runs GROUP BY category),
    s AS (SELECT category, count(*) AS n, round(avg(sim), 4) AS mean_sim FROM runs GROUP BY category), c AS ({COMPOSITE} FROM p JOIN fwe ON category = g)
    SELECT s.category, n, mean_sim, p_score, fwe, p_primary, p_harmonic FROM s JOIN p USING (category) JOIN fwe ON s.category = g, c""",
)
def metrics(spark, sf_dir):
    """The whole flow for categories: summary, P, entropy and the composites of all."""
    groups = A.group_scores(bridge(spark, sf_dir), "category")
    # the composite is one row
    return groups.join(F.broadcast(A.composite(groups)))


@query("agg22_run_summary", f"{R} SELECT level, count(*) AS n, sum((run_status = 'ok')::BIGINT)::BIGINT AS n_ok, round(avg(latency_ms), 2) AS avg_latency, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency FROM runs GROUP BY level")
def run_summary(spark, sf_dir):
    return A.run_summary(bridge(spark, sf_dir))


@query(
    "agg23_display",
    f"""{R}, {FWE.format(by='dimension')} SELECT s.*, fwe FROM (SELECT dimension, count(*) AS n, round(avg(sim), 4) AS mean_sim, round({PX}, 4) AS p_score FROM runs GROUP BY dimension) s LEFT JOIN fwe ON dimension = g""",
)
def display(spark, sf_dir):
    return A.group_scores(bridge(spark, sf_dir), "dimension")


#: Meta-metrics unrolled over six levels.
RECORDS = f"{R}, rec AS (SELECT *, CAST(substr(level, 2) AS INT) AS k, coalesce(score, 0) AS pert, run_status = 'ok' AND coalesce(sim >= 0.8::DOUBLE, FALSE) AS match FROM runs)"


def _bins(by: str) -> str:
    acc = ", ".join(f"avg(match::INT) FILTER (k = {i}) AS a{i}, min(pert) FILTER (k = {i}) AS e{i}" for i in range(1, 6))
    base = "b0 AS (SELECT count(*) AS n0, avg(match::INT) AS a0 FROM rec WHERE k = 0)"
    return f"{base}, g AS (SELECT {by}, {acc} FROM rec WHERE k > 0 GROUP BY {by}), j AS (SELECT g.*, n0, a0, 0::DOUBLE AS e0, CASE WHEN n0 >= 2 THEN a0 ELSE 0.8::DOUBLE END AS acc_base FROM g, b0), m AS (SELECT *, 0.8::DOUBLE * acc_base AS t FROM j)"


def _meta(by: str) -> str:
    worst = "least(" + ", ".join(f"CASE WHEN e{i + 1} > e{i} THEN (a{i + 1} - a{i}) / (e{i + 1} - e{i}) END" for i in range(5)) + ")"
    drops = " + ".join(f"(coalesce(a{i} - a{i + 1} > 0.1::DOUBLE, FALSE))::INT" for i in range(5))
    sr = "greatest(0, " + ", ".join(f"CASE WHEN a{i} >= t THEN {i} ELSE 0 END" for i in range(6)) + ")"
    cp = "CASE " + " ".join(f"WHEN a{i} < t THEN {i}" for i in range(6)) + " END"
    diffs = "list_filter([" + ", ".join(f"a{i + 1} - a{i}" for i in range(5)) + "], lambda x: x IS NOT NULL)"
    return f"""{RECORDS}, {_bins(by)}, v AS (SELECT {by}, acc_base, t, coalesce({worst}, 0) AS w, ({drops}) / 5::DOUBLE AS c, {sr} AS s, {cp} AS p, {diffs} AS d FROM m),
    y AS (SELECT *, len(list_filter(range(1, len(d)), lambda i: d[i] * d[i + 1] < 0)) / 4::DOUBLE AS o FROM v)
    SELECT {by}, round(acc_base, 4) AS acc_base, round(t, 4) AS tau, s::DOUBLE AS sr_max, p::DOUBLE AS cp, round(w, 4) AS ss_worst, round(c, 4) AS cs, round(o, 4) AS osc_rate,
    round(s / 5::DOUBLE, 4) AS sr_norm, round(coalesce(p / 5::DOUBLE, 1), 4) AS cp_norm, round(greatest(0, least(1, w + 1)), 4) AS ss_norm, round(1 - c, 4) AS cs_norm, round(1 - o, 4) AS osc_norm FROM y"""


_META = ["acc_base", "tau", "sr_max", "cp", "ss_worst", "cs", "osc_rate", "sr_norm", "cp_norm", "ss_norm", "cs_norm", "osc_norm"]


@query("agg36_meta_by_category", _meta("category"))
def meta_by_category(spark, sf_dir):
    return meta.by_group(bridge(spark, sf_dir), "category").select("category", *_META)


@query("agg36_meta_by_model", _meta("model, dimension"))
def meta_by_model(spark, sf_dir):
    return meta.by_group(bridge(spark, sf_dir), "model", "dimension").select("model", "dimension", *_META)


@query("agg24_level_bins", f"{RECORDS} SELECT category, k AS level_no, count(*) AS n_runs, sum(match::BIGINT)::BIGINT AS n_match, round(avg(match::INT), 4) AS acc, round(min(pert), 4) AS level_edge FROM rec WHERE k > 0 GROUP BY ALL")
def level_bins(spark, sf_dir):
    cells = meta.with_baseline(meta.records(bridge(spark, sf_dir), 0.8), "category").where("level_no > 0")
    return cells.select("category", "level_no", F.col("n").alias("n_runs"), F.col("hits").alias("n_match"), A.r4(F.col("hits") / F.col("n")).alias("acc"), A.r4(F.col("edge")).alias("level_edge"))


@query(
    "agg34_meta_overall",
    f"""{RECORDS}, x AS (SELECT avg(match::INT) FILTER (phase = 'recovery') - avg(match::INT) FILTER (phase = 'pre_collapse') AS r, 1 - avg(false_signature::INT) AS f FROM rec)
    SELECT round(r, 4) AS recgap, round(f, 4) AS fm_norm, round(greatest(0, least(1, (r + 0.3::DOUBLE) / 0.6::DOUBLE)), 4) AS recgap_norm FROM x""",
)
def meta_overall(spark, sf_dir):
    return meta.overall(bridge(spark, sf_dir)).select("recgap", "fm_norm", "recgap_norm")


@query("agg35_records", f"{RECORDS} SELECT category, k AS level_no, sum(match::BIGINT)::BIGINT AS matches, round(sum(pert), 4) AS perturbation FROM rec GROUP BY ALL")
def records(spark, sf_dir):
    return meta.records(bridge(spark, sf_dir), 0.8).groupBy("category", "level_no").agg(F.sum(F.col("match").cast("long")).alias("matches"), A.r4(F.sum("perturbation")).alias("perturbation"))


#: Families of the scorer from brands of models; one family has no entropy.
FAMILIES = {"m0": "paraphrase", "m1": "noise", "m2": "format", "m3": "distraction"}
_FAMILY = "CASE model " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in FAMILIES.items()) + " END"
_BUSINESS = ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in scoring.BUSINESS_WEIGHTS["Steadiness"].items())
SCORER = f"""{R}, {FWE.format(by='model')}, p AS (SELECT model, {_FAMILY} AS family, round({PX}, 4) AS p_score FROM runs GROUP BY model),
f AS (SELECT family, p_score, CASE WHEN family = 'format' THEN greatest(0, 1 - p_score) ELSE fwe END AS fwe FROM p JOIN fwe ON model = g), b(family, w) AS (VALUES {_BUSINESS}),
w AS (SELECT f.*, w AS w_business, fwe / sum(fwe) OVER () AS w_fwe, 0.6::DOUBLE * w + 0.4::DOUBLE * (fwe / sum(fwe) OVER ()) AS x FROM f JOIN b USING (family)),
z AS (SELECT *, x / sum(x) OVER () AS w_final FROM w)"""


def _families(spark, sf_dir):
    name = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))[F.col("model")]
    rows = A.group_scores(bridge(spark, sf_dir), "model").select(F.lit("Steadiness").alias("category"), name.alias("family"), "p_score", "fwe")
    return rows.withColumn("fwe", F.when(F.col("family") != "format", F.col("fwe")))


@query("agg40_category_score", f"{SCORER} SELECT 'Steadiness' AS category, round(sum(w_final * p_score), 4) AS p_primary, round(1 / sum(w_final / (p_score + 1e-6::DOUBLE)), 4) AS p_harmonic FROM z")
def category_score(spark, sf_dir):
    return scoring.score(_families(spark, sf_dir), scoring.weight_table(spark)).select("category", "p_primary", "p_harmonic")


@query("agg39_final_weights", f"{SCORER} SELECT family, round(w_business, 6) AS w_business, round(w_fwe, 6) AS w_fwe, round(w_final, 6) AS w_final, round(w_final * p_score, 6) AS contribution FROM z")
def final_weights(spark, sf_dir):
    return scoring.breakdown(_families(spark, sf_dir), scoring.weight_table(spark)).select("family", "w_business", "w_fwe", "w_final", "contribution")


@query("join09_weights_full_outer", f"{SCORER} SELECT family, round((0.6::DOUBLE * coalesce(b.w, 0) + 0.4::DOUBLE * coalesce(q.x, 0)) / sum(0.6::DOUBLE * coalesce(b.w, 0) + 0.4::DOUBLE * coalesce(q.x, 0)) OVER (), 6) AS weight FROM b FULL OUTER JOIN (SELECT family, fwe / sum(fwe) OVER () AS x FROM f WHERE family <> 'noise') q USING (family)")
def weights_full_outer(spark, sf_dir):
    rows = _families(spark, sf_dir).where("family <> 'noise'").withColumn("weight", F.coalesce("fwe", F.greatest(F.lit(0.0), 1 - F.col("p_score")))).select("category", "family", "weight")
    return scoring.final_weights(scoring.weight_table(spark), scoring.normalise(rows, "weight", "category")).select("family", F.round("weight", 6).alias("weight"))


@query("agg37_normalised_weights", f"{R}, c AS (SELECT category, model, count(*) FILTER (gate) AS n FROM runs GROUP BY ALL) SELECT category, model, round(n::DOUBLE / sum(n) OVER (PARTITION BY category), 6) AS weight FROM c")
def normalised(spark, sf_dir):
    counts = bridge(spark, sf_dir).groupBy("category", "model").agg(F.sum(F.col("gate").cast("double")).alias("weight"))
    return scoring.normalise(counts, "weight", "category").select("category", "model", F.round("weight", 6).alias("weight"))


@query(
    "agg42_quadrants",
    f"""{R}, q AS (SELECT category, level, avg(score) AS mx, avg(sim) AS my, coalesce(stddev_samp(score), 0) AS sx, coalesce(stddev_samp(sim), 0) AS sy FROM ok WHERE score IS NOT NULL AND sim IS NOT NULL GROUP BY ALL), m AS (SELECT avg(mx) AS mid FROM q)
    SELECT category, level, round(mx, 4) AS mean_x, round(my, 4) AS mean_y, round(sx, 4) AS std_x, round(sy, 4) AS std_y,
    CASE WHEN my >= 0.8::DOUBLE AND mx >= mid THEN 'robust' WHEN my >= 0.8::DOUBLE THEN 'stable' WHEN mx >= mid THEN 'stressed' ELSE 'fragile' END AS quadrant FROM q, m""",
)
def quadrants(spark, sf_dir):
    return A.quadrants(admitted(spark, sf_dir), "category", "level")


@query("agg44_admission", f"{R} SELECT category, level, count(*) AS n, sum(gate::BIGINT)::BIGINT AS admitted, round(avg(gate::INT), 4) AS pass_rate FROM runs GROUP BY ALL")
def admission(spark, sf_dir):
    return A.admission(bridge(spark, sf_dir))


@query("agg45_mean_magnitude", f"{R} SELECT category, round(avg(score), 4) AS mean_magnitude FROM ok WHERE level <> 'L0' GROUP BY category")
def mean_magnitude(spark, sf_dir):
    return A.mean_magnitude(bridge(spark, sf_dir))


@query("agg46_coverage", f"{R} SELECT model, count(*) AS n, count(DISTINCT source_row) AS seeds FROM runs GROUP BY model")
def coverage(spark, sf_dir):
    return A.coverage(bridge(spark, sf_dir))


_RULES_SQL = {
    "mean": "SELECT category, round(avg(sim), 4) AS mean FROM ok GROUP BY category",
    "weighted_mean": "SELECT category, round(sum(sim * score) / sum(score), 4) AS weighted_mean FROM ok GROUP BY category",
    "worst_k": "SELECT category, round(avg(sim), 4) AS worst_k FROM (SELECT category, sim, row_number() OVER (PARTITION BY category ORDER BY sim) AS r FROM ok WHERE sim IS NOT NULL) WHERE r <= 3 GROUP BY category",
    "percentile": "SELECT category, round(quantile_cont(sim, 0.95), 4) AS percentile FROM ok GROUP BY category",
    "auc": "SELECT category, round(sum(a), 4) AS auc FROM (SELECT category, (y + lead(y) OVER w) / 2 * (k - k + lead(k) OVER w - k) AS a FROM (SELECT category, CAST(substr(level, 2) AS INT) AS k, avg(sim) AS y FROM ok GROUP BY ALL) WINDOW w AS (PARTITION BY category ORDER BY k)) GROUP BY category",
}
for _rule, _sql in _RULES_SQL.items():

    @query(f"agg47_rule_{_rule}", f"{R} {_sql}")
    def _by_rule(spark, sf_dir, rule=_rule):
        return A.by_rule(admitted(spark, sf_dir), rule, "sim", "category", weight="score")


@query("win01_level_slopes", f"{RECORDS}, c AS (SELECT category, k, avg(match::INT) AS acc, min(pert) AS e FROM rec WHERE k > 0 GROUP BY ALL) SELECT category, k AS level_no, round(lead(acc) OVER w - acc, 4) AS step FROM c WINDOW w AS (PARTITION BY category ORDER BY k)")
def slopes(spark, sf_dir):
    from pyspark.sql import Window

    cells = meta.with_baseline(meta.records(bridge(spark, sf_dir), 0.8), "category").where("level_no > 0")
    acc = F.col("hits") / F.col("n")
    return cells.select("category", "level_no", A.r4(F.lead(acc).over(Window.partitionBy("category").orderBy("level_no")) - acc).alias("step"))


RANKED = f"{R}, v AS (SELECT * FROM ok WHERE score IS NOT NULL AND sim IS NOT NULL)"


@query(
    "win02_magnitude_bins",
    f"""{RANKED}, s AS (SELECT *, row_number() OVER (ORDER BY score, run_id) - 1 AS r FROM v WHERE level <> 'L0'), z AS (SELECT greatest(1, count(*) // 12) AS size FROM s)
    SELECT r // size AS bin, count(*) AS n, round((sum(score::DECIMAL(28, 12))::DOUBLE / count(score))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_score, round((sum(sim::DECIMAL(28, 12))::DOUBLE / count(sim))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_sim FROM s, z GROUP BY r // size, size HAVING count(*) >= size // 3""",
)
def magnitude_bins(spark, sf_dir):
    return bins.magnitude_bins(bridge(spark, sf_dir))


@query("win03_fixed_bins", f"{RANKED} SELECT r // 500 AS bin, count(*) AS n, round((sum(score::DECIMAL(28, 12))::DOUBLE / count(score))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_score, round((sum(sim::DECIMAL(28, 12))::DOUBLE / count(sim))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_sim FROM (SELECT *, row_number() OVER (ORDER BY score, run_id) - 1 AS r FROM v) GROUP BY ALL")
def fixed_bins(spark, sf_dir):
    return bins.fixed_bins(bridge(spark, sf_dir), 500)


@query("win04_category_bins", f"{RANKED} SELECT r // 500 AS bin, category, count(*) AS n, round((sum(score::DECIMAL(28, 12))::DOUBLE / count(score))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_score, round((sum(sim::DECIMAL(28, 12))::DOUBLE / count(sim))::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS mean_sim FROM (SELECT *, row_number() OVER (ORDER BY score, run_id) - 1 AS r FROM v) GROUP BY ALL")
def category_bins(spark, sf_dir):
    return bins.fixed_bins(bridge(spark, sf_dir), 500, "category")


@query(
    "win06_until_accepted",
    f"""{R}, t AS (SELECT source_row, category, level AS target_level, gate, latency_ms > 2500 AS level_gate, row_number() OVER (PARTITION BY source_row, category, level ORDER BY run_id) AS attempt FROM runs),
    f AS (SELECT *, min(CASE WHEN gate AND level_gate THEN attempt END) OVER (PARTITION BY source_row, category, target_level) AS first FROM t)
    SELECT target_level, count(*) AS attempts, max(attempt) AS longest FROM f WHERE first IS NULL OR attempt <= first GROUP BY target_level""",
)
def until_accepted(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("source_row", "category", "level").orderBy("run_id")
    attempts = bridge(spark, sf_dir).select("source_row", "category", "level", "gate", (F.col("latency_ms") > 2500).alias("level_gate"), F.row_number().over(own).cast("long").alias("attempt")).withColumnRenamed("level", "target_level")
    return curation.until_accepted(attempts).groupBy("target_level").agg(F.count("*").alias("attempts"), F.max("attempt").alias("longest"))


@query("agg22_exact_percentile", f"{R} SELECT model, level, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM runs GROUP BY ALL")
def exact_percentile(spark, sf_dir):
    """AGG-22, AGG-47: the interpolated percentile by counting and refining ranges, no group in one buffer."""
    return quantiles.exact(bridge(spark, sf_dir), "latency_ms", 0.95, "model", "level", name="p95").withColumn("p95", F.round("p95", 4))


@query("agg22_sketched_percentile", f"{R} SELECT level, TRUE AS near FROM runs GROUP BY level")
def sketched_percentile(spark, sf_dir):
    """AGG-22: sketches of four models' runs, merged one after the other; whether each level's answer has its rank within 1 % of the 95th percentile."""
    runs = bridge(spark, sf_dir)
    parts = [quantiles.sketches(runs.where(F.col("model") == f"m{i}"), "latency_ms", "level") for i in range(4)]
    stored = parts[0]
    for new in parts[1:]:
        stored = quantiles.merged(stored, new, "level")
    # six rows
    answers = F.broadcast(quantiles.of_sketches(stored, 0.95, "p95"))
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    ranks = runs.join(answers, "level").groupBy("level").agg(share(F.col("latency_ms") < F.col("p95")).alias("below"), share(F.col("latency_ms") <= F.col("p95")).alias("up_to"))
    return ranks.select("level", ((F.col("below") <= 0.96) & (F.col("up_to") >= 0.94)).alias("near"))


_ASKED_AGAIN = f"""WITH runs AS (SELECT * REPLACE (CASE WHEN source_row % 5 = 0 THEN score / 2 ELSE score END AS score, CASE WHEN source_row % 5 = 0 THEN 1 - sim ELSE sim END AS sim) FROM ({RUNS}))"""


@query(
    "agg01_incremental",
    f"""{_ASKED_AGAIN}, a AS (SELECT category, level, round(avg(CASE WHEN sim >= 0.8::DOUBLE THEN 1 ELSE 0 END), 4) AS accuracy, count(*) AS n FROM runs WHERE category IS NOT NULL AND level IS NOT NULL GROUP BY ALL) SELECT * FROM a""",
)
def incremental_accuracy(spark, sf_dir):
    """AGG-01, AGG-12, AGG-19: sums kept by category and level over three appended batches of runs and one with seeds that were asked again; a batch reads itself and what it replaces."""
    path = bins.work_folder(spark, "sums")
    rows = bridge(spark, sf_dir).select(F.col("model").alias("run"), "source_row", "category", "level", "score", "sim")
    again = rows.where("source_row % 5 = 0").withColumns({"score": F.col("score") / 2, "sim": 1 - F.col("sim")})
    for number, batch in enumerate([*(rows.where(F.col("source_row") % 3 == i) for i in range(3)), again]):
        incremental.take(batch, path, number, "category", "level")
    return incremental.measures(incremental.current(spark, path)).select("category", "level", "accuracy", "n")


@query("stream_collapse", f"{R}, {_acc(src='runs')} SELECT category, {_first_below('0.8::DOUBLE * L0')} AS cp FROM acc, base")
def stream_collapse(spark, sf_dir):
    """AGG-07 as a stream: all runs arrive in files of their own order, events go through the ledger, the last one of each family stands."""
    top = bins.work_folder(spark, "stream")
    runs = bridge(spark, sf_dir).select(F.timestamp_millis(F.col("source_row") * 1000).alias("ts"), "category", "level", "sim")
    runs.repartition(3).write.parquet(f"{top}/in")
    baseline = A.level_accuracy(runs, "category").first()
    if baseline is None:
        return runs.select("category", F.lit(None).cast("string").alias("cp")).limit(0)
    events = collapse.collapse_points(spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), baseline.L0, late="36500 days")
    keyed = events.select(F.col("category").alias("run"), F.lit(0).cast("long").alias("source_row"), "cp")
    keyed.writeStream.outputMode("append").option("checkpointLocation", f"{top}/checkpoint").foreachBatch(results.sink(f"{top}/out", 8)).trigger(availableNow=True).start().awaitTermination()
    return results.read(spark, f"{top}/out").select(F.col("run").alias("category"), "cp")
