"""Text-pair and single-text metrics, levels, gates and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decision as D
from ..functions import difflib_udf as dl
from ..functions import levels as L
from ..functions import text as T
from ..operators import gates as G
from ..operators import specs as S
from ..operators import transforms as X
from ..plans.bridge import TURNS, VECTORS, XFORM, frame, turns, xform
from ..sources.registry import RULES, enabled
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tok(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({x}), '(\d),(\d)', '\1\2', 'g'), {_q(T.TOKEN)})"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {_q(T.NUMBER)}), lambda n: replace(n, ',', ''))"


def _norm(s: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({s}), '\s+', ' ', 'g'), '^[.!?: ]+|[.!?: ]+$', '', 'g')"


def _excess(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda y: greatest(len(list_filter({a}, lambda z: z = y)) - len(list_filter({b}, lambda z: z = y)), 0))), 0)"


def _agree(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]))"


def _any(x: str, what: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in what) + ")"


def prepared(source: str, key: str) -> str:
    """CTE t: the pairs with tokens, letters, numbers, sentences and words of both sides."""
    return f"""WITH p AS ({source}), s AS (SELECT {key}, coalesce(o, '') AS o, coalesce(c, '') AS c, {_squeeze("coalesce(o, '')")} AS oq, {_squeeze("coalesce(c, '')")} AS cq FROM p),
    u AS (SELECT *, {_tok('o')} AS ot, {_tok('c')} AS ct, regexp_extract_all(o, {_q(T.WORD)}) AS ol, regexp_extract_all(c, {_q(T.WORD)}) AS cl, {_numbers('o')} AS onum, {_numbers('c')} AS cnum,
        {_sentences('oq')} AS os, {_sentences('cq')} AS cs, {_words('oq')} AS ow, {_words('cq')} AS cw FROM s),
    n AS (SELECT *, list_transform(os, lambda s: {_norm('s')}) AS known FROM u),
    t AS (SELECT *, list_filter(cs, lambda s: NOT list_contains(known, {_norm('s')})) AS added FROM n)"""


_MEAN = "list_sum(list_transform({x}, lambda s: len(string_split_regex(s, '\\s+'))))::DOUBLE / len({x})"
SLI = f"CASE WHEN len(os) = 0 OR len(cs) = 0 THEN 0 ELSE round(greatest(0, ({_MEAN.format(x='cs')} - {_MEAN.format(x='os')}) / ({_MEAN.format(x='os')})), 4) END"
DC = "greatest(0, len(cs) - len(os))"
DND = f"CASE WHEN len(onum) = 0 THEN 0 ELSE round({_excess('cnum', 'onum')}::DOUBLE / len(onum), 4) END"
CTX = "CASE WHEN len(ow) = 0 THEN 1 ELSE round(len(cw)::DOUBLE / len(ow), 4) END"
CDP = "CASE WHEN oq = '' OR cq = '' THEN 0 WHEN position(oq IN cq) = 0 THEN 1 ELSE round(len(list_filter(string_split(substr(cq, 1, position(oq IN cq) - 1), ' '), lambda w: w <> ''))::DOUBLE / len(cw), 4) END"
_PUNCT = "regexp_extract_all({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')"
SA = "least(1, greatest(0, (length(c) - length(replace(c, ' ', ''))) - (length(o) - length(replace(o, ' ', '')))) / greatest(length(o), 1)::DOUBLE)"
PA = f"least(1, ({_excess(_PUNCT.format(x='o'), _PUNCT.format(x='c'))} + {_excess(_PUNCT.format(x='c'), _PUNCT.format(x='o'))}) / greatest(len({_PUNCT.format(x='o')}), 1)::DOUBLE)"
LINES = "list_filter(string_split(c, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')"
DEPTH = f"list_transform({LINES}, lambda x: (length(x) - length(regexp_replace(x, '^[ \\t]+', '')))::HUGEINT)"
_MARK = T.BLOCK_MARK
CES_TEXT = "' ' || lower(array_to_string(added, ' ')) || ' '"
SQL = {
    "jaccard_tcr": "CASE WHEN len(list_distinct(list_concat(ot, ct))) = 0 THEN 0 ELSE round(1 - len(list_intersect(list_distinct(ot), list_distinct(ct)))::DOUBLE / len(list_distinct(list_concat(ot, ct))), 4) END",
    "tps": f"CASE WHEN len(ot) = 0 THEN 1 ELSE round({_agree('ot', 'ct')}::DOUBLE / len(ot), 4) END",
    "ccr": "CASE WHEN length(o) = 0 THEN 0 ELSE round(abs(length(c) - length(o))::DOUBLE / length(o), 4) END",
    "dc": DC,
    "dnd": DND,
    "sli": SLI,
    "ale": f"round({DC} + {DND} + {SLI}, 4)",
    "wcr": f"CASE WHEN len(ol) = 0 THEN 0 ELSE round((least(len(ol), len(cl)) - {_agree('ol', 'cl')})::DOUBLE / len(ol), 4) END",
    "tis": f"CASE WHEN len(ol) = 0 THEN 1 ELSE round({_agree('ol', 'cl')}::DOUBLE / len(ol), 4) END",
    "sds": f"round(0.4::DOUBLE * {SA} + 0.6::DOUBLE * {PA}, 4)",
    "cc": f"len(list_filter(added, lambda s: {_any('lower(s)', [w for t in T.CONFLICT_TIERS.values() for w in t])}))",
    "ces": "CASE " + " ".join(f"WHEN {_any(CES_TEXT, T.CONFLICT_TIERS[k])} THEN {k}" for k in (5, 4, 3, 2, 1)) + " ELSE 0 END",
    "ihd": " + ".join(f"contains(lower(array_to_string(added, ' ')), {_q(w)})::BIGINT" for w in T.AUTHORITY),
    "ctx_cer": CTX,
    "cdp": CDP,
    "icv": "greatest(0, len(cw) - len(ow))",
    "len_ratio": "CASE WHEN length(o) = 0 THEN 0 ELSE round(length(c)::DOUBLE / length(o), 4) END",
    "adi": f"round(({CTX}) * ({CDP}), 4)",
    "lcs": f"""(200 * least(20, greatest(0, (length(c) - length(replace(c, chr(10), ''))) - (length(o) - length(replace(o, chr(10), '')))))
        + CASE WHEN len({LINES}) = 0 THEN 0 ELSE (2 * (120 * CASE WHEN len({LINES}) < 2 THEN 0 ELSE least(25 * len({LINES})::HUGEINT * len({LINES}), len({LINES})::HUGEINT * list_sum(list_transform({DEPTH}, lambda d: d * d)) - list_sum({DEPTH})::HUGEINT * list_sum({DEPTH})) END
            + 3000::HUGEINT * len({LINES}) * len(list_filter({LINES}, lambda x: regexp_matches(x, {_q(_MARK)}) OR starts_with(trim(x), '---') OR starts_with(trim(x), '===')))) + len({LINES})::HUGEINT * len({LINES})) // (2 * len({LINES})::HUGEINT * len({LINES})) END)::DOUBLE / 10000""",
}
IDS = {"jaccard_tcr": "txt03", "tps": "txt06", "ccr": "txt07", "lcs": "txt11", "dc": "txt14", "dnd": "txt15", "sli": "txt16", "ale": "txt17", "wcr": "txt20", "tis": "txt21", "sds": "txt24", "cc": "txt27", "ces": "txt28", "ihd": "txt29", "ctx_cer": "txt31", "cdp": "txt32", "icv": "txt33", "len_ratio": "txt34", "adi": "txt35"}
#: Metrics that need lines, punctuation or additions are shown on perturbed documents, the others on turns.
ON_DOCUMENTS = {"lcs", "sds", "cc", "ces", "ihd", "dc", "ccr", "icv", "ctx_cer"}
_COUNTS = {"dc", "cc", "ces", "ihd", "icv"}

for _name, _f in T.PAIR_METRICS.items():
    _on = xform if _name in ON_DOCUMENTS else turns
    _key = "doc_id" if _name in ON_DOCUMENTS else "conv_id, turn"
    _cast = "BIGINT" if _name in _COUNTS else "DOUBLE"

    @query(f"{IDS[_name]}_{_name}", f"{prepared(XFORM if _on is xform else TURNS, _key)} SELECT {_key}, ({SQL[_name]})::{_cast} AS {_name} FROM t")
    def _pair_metric(spark, sf_dir, name=_name, f=_f, on=_on, key=_key):
        return on(spark, sf_dir).select(*key.split(", "), f("o", "c").alias(name))


@query("txt01_tokens", f"{prepared(TURNS, 'conv_id, turn')} SELECT conv_id, turn, len(list_distinct(ot)) AS n_tokens, len(ct) AS n_ordered FROM t")
def tokens(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(T.tokens("o")).cast("long").alias("n_tokens"), F.size(T.ordered_tokens("c")).cast("long").alias("n_ordered"))


@query("txt12_numbers", f"{prepared(XFORM, 'doc_id')} SELECT doc_id, array_to_string(cnum, '|') AS numbers FROM t")
def numbers(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", F.array_join(T.numbers("c"), "|").alias("numbers"))


@query("txt13_sentences", f"{prepared(XFORM, 'doc_id')} SELECT doc_id, len(cs) AS n_sentences, len(cw) AS n_words FROM t")
def sentences(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", F.size(T.sentences("c")).cast("long").alias("n_sentences"), T.word_count("c").alias("n_words"))


@query("txt18_letters", f"{prepared(TURNS, 'conv_id, turn')} SELECT conv_id, turn, array_to_string(ol, ' ') AS letters FROM t")
def letters(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(T.letters("o"), " ").alias("letters"))


@query("txt26_added_sentences", f"{prepared(XFORM, 'doc_id')} SELECT doc_id, len(added) AS n_added, array_to_string(added, ' ') AS added FROM t")
def added(spark, sf_dir):
    own = T.added_sentences("o", "c")
    return xform(spark, sf_dir).select("doc_id", F.size(own).cast("long").alias("n_added"), F.array_join(own, " ").alias("added"))


@query(
    "txt04_cosine",
    f"""WITH v AS ({VECTORS}), p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v)
    SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM p WHERE b IS NOT NULL""",
)
def cosine(spark, sf_dir):
    from pyspark.sql import Window

    pairs = frame(spark, sf_dir, VECTORS, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("b"))
    return pairs.where("b IS NOT NULL").select("vec_id", F.round(T.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("txt42_units", f"{prepared(XFORM, 'doc_id')} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: list_contains([{', '.join(_q(w) for w in T.UNIT_WORDS)}], w)))), ',') AS units FROM t")
def units(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(T.units("c")), ",").alias("units"))


def _goal_of(low: str, last: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(p)}) THEN '{g}'" for x in (last, low) for g, p in T.GOALS) + " ELSE 'find_unknown' END"


_GOAL = _goal_of("low", "last")


@query("txt43_goal_type", f"WITH p AS ({TURNS}), a AS (SELECT conv_id, turn, lower(coalesce(c, '')) AS low FROM p), b AS (SELECT *, {_sentences('trim(low)')} AS ss FROM a), d AS (SELECT *, coalesce(ss[len(ss)], low) AS last FROM b) SELECT conv_id, turn, {_GOAL} AS goal FROM d")
def goal(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", T.goal_type("c").alias("goal"))


@query("txt19_difflib")
def difflib(spark, sf_dir):
    """TXT-19, TXT-36 to TXT-38: edit rate, similarity, change rate and magnitude, one matcher call a pair."""
    rows = dl.dealt(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "o", "c", dl.difflib("o", "c").alias("d"))
    sim, tcr = dl.similarity(F.col("d")), dl.change_rate(F.col("d"))
    return rows.select("conv_id", "turn", dl.edit_rate(F.col("d"), F.col("o")).alias("cer"), sim.alias("sim"), tcr.alias("tcr"), L.magnitude(sim, tcr, "SV").alias("magnitude"), L.tcr_level(tcr, "SV").alias("level"))


_LOWC = "lower(coalesce(c, ''))"
RULE_COUNT = "least(8, " + " + ".join(f"len(regexp_extract_all(c, {_q('(?is)' + p)}))" for p in D.RULES) + ")"


def _whole(what: list[str]) -> str:
    return "(" + " + ".join(f"list_contains(regexp_extract_all({_LOWC}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), '{w}')::BIGINT" for w in what) + ")"


def _part(what: list[str]) -> str:
    return "(" + " + ".join(f"contains({_LOWC}, {_q(w)})::BIGINT" for w in what) + ")"


DCM = {
    "num_rules": RULE_COUNT,
    "num_factors": _whole(D.FACTORS),
    "num_exceptions": _part(D.EXCEPTIONS),
    "branch_depth": f"least(4, {_part(D.BRANCHES)})",
}
_TRADE = _any(_LOWC, D.TRADEOFFS)
_TYPE = "CASE " + " ".join(f"WHEN {_any(_LOWC, w)} THEN '{n}'" for n, w in D.DECISIONS) + " ELSE 'unknown' END"


@query(
    "dcm07_decision_complexity",
    f"""WITH p AS ({XFORM}), m AS (SELECT doc_id, {", ".join(f"({v})::BIGINT AS {k}" for k, v in DCM.items())}, {_TRADE} AS has_tradeoff, {_TYPE} AS decision_type FROM p)
    SELECT *, round(0.25::DOUBLE * least(1, num_rules / 8::DOUBLE) + 0.25::DOUBLE * least(1, num_factors / 6::DOUBLE) + 0.2::DOUBLE * least(1, num_exceptions / 4::DOUBLE) + 0.2::DOUBLE * least(1, branch_depth / 4::DOUBLE) + 0.1::DOUBLE * has_tradeoff::INT, 4) AS struct_score FROM m""",
)
def complexity(spark, sf_dir):
    """DCM-01 to DCM-07."""
    return xform(spark, sf_dir).select("doc_id", D.num_rules("c").alias("num_rules"), D.num_factors("c").alias("num_factors"), D.num_exceptions("c").alias("num_exceptions"), D.branch_depth("c").alias("branch_depth"), D.has_tradeoff("c").alias("has_tradeoff"), D.decision_type("c").alias("decision_type"), D.struct_score("c").alias("struct_score"))


_SLEN = "CASE WHEN len({p}) = 0 THEN 5 ELSE list_sum(list_transform({p}, lambda s: len(list_filter(string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))))::DOUBLE / len({p}) END".format(p="list_filter(string_split_regex(c, '[.!?\\n]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') <> '')")
FEATURES = {k: f"len(regexp_extract_all(c, {_q('(?is)' + p)}))" for k, p in D.COUNTED.items()} | {"num_variables": _whole(D.VARIABLES), "sentence_length": f"round({_SLEN}, 2)", "dep_tree_depth": "1", "clause_count": "1"}


def _normal(k: str) -> str:
    lo, hi = D.BOUNDS[k]
    return f"round(greatest(0, least(1, ({k} - {lo}) / {hi - lo}::DOUBLE)), 4)"


@query(
    "dcd06_definition_score",
    f"""WITH p AS ({XFORM}), m AS (SELECT doc_id, {", ".join(f"({FEATURES[k]})::DOUBLE AS {k}" for k in D.BOUNDS)} FROM p)
    SELECT doc_id, {", ".join(D.BOUNDS)}, round((({" + ".join(f"{D.WEIGHTS[k]}::DOUBLE * {_normal(k)}" for k in D.BOUNDS)}) / {sum(D.WEIGHTS.values())!r}::DOUBLE)::VARCHAR::DECIMAL(30, 18), 6)::DOUBLE AS score FROM m""",
)
def definition(spark, sf_dir):
    """DCD-01 to DCD-06."""
    own = D.definition_features("c")
    return xform(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in own.items()), D.definition_score("c", places=6).alias("score"))


_CONTRIBUTIONS = ", ".join(f"{{'c': -round(({D.WEIGHTS[k]}::DOUBLE * {_normal(k)})::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE, 'i': {i}, 'f': '{k}'}}" for i, k in enumerate(D.BOUNDS))


@query("top01_top_features", f"""WITH p AS ({XFORM}), m AS (SELECT doc_id, {", ".join(f"({FEATURES[k]})::DOUBLE AS {k}" for k in D.BOUNDS)} FROM p)
    SELECT doc_id, array_to_string(list_transform(list_sort([{_CONTRIBUTIONS}])[1:3], lambda x: x.f), ',') AS top_features FROM m""")
def top_features(spark, sf_dir):
    """SORT-03, TOP-01: the three features that weigh most in each text, in order."""
    return xform(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.slice(D.ranked_features("c"), 1, 3), lambda x: x["feature"]), ",").alias("top_features"))


# -- levels ------------------------------------------------------------------------


def _bands(value: str, bands: list, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {lo}::DOUBLE AND {value} < {hi}::DOUBLE THEN 'L{i + 1}'" for i, (lo, hi) in enumerate(bands)) + f" ELSE {otherwise} END" if bands else otherwise


TCR = f"{prepared(TURNS, 'conv_id, turn')}, j AS (SELECT conv_id, turn, ({SQL['jaccard_tcr']})::DOUBLE AS tcr, ow, cw FROM t)"


@query("lvl05_tcr_level", f"{TCR} SELECT conv_id, turn, " + ", ".join(f"{_bands('tcr', L.TCR_BANDS[f], _bands('tcr', L.FALLBACK, chr(39) + 'L5' + chr(39)))} AS level_{f.lower()}" for f in L.TCR_BANDS) + " FROM j")
def tcr_level(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", T.jaccard_tcr("o", "c").alias("tcr"))
    return rows.select("conv_id", "turn", *(L.tcr_level(F.col("tcr"), f).alias(f"level_{f.lower()}") for f in L.TCR_BANDS))


@query("gat14_level_gate", f"{TCR} SELECT conv_id, turn, tcr >= 0.35::DOUBLE AND tcr < 0.6::DOUBLE AS sv_l3, tcr > 0.005::DOUBLE AS kb_l1 FROM j")
def level_gate(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", T.jaccard_tcr("o", "c").alias("tcr"))
    return rows.select("conv_id", "turn", L.level_gate(F.col("tcr"), F.lit("L3"), "SV").alias("sv_l3"), L.level_gate(F.col("tcr"), F.lit("L1"), "KB").alias("kb_l1"))


def _cuts(value: str, cuts: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {c}::DOUBLE THEN 'L{i + 1}'" for i, c in enumerate(cuts)) + f" ELSE 'L{len(cuts) + 1}' END"


@query("lvl06_conflict_level", f"{prepared(XFORM, 'doc_id')}, e AS (SELECT doc_id, ({SQL['ces']})::DOUBLE AS ces FROM t) SELECT doc_id, {_cuts('CASE WHEN ces = 0 THEN 0 ELSE (ces - 1) / 4 END', L.CES_CUTS)} AS level FROM e")
def conflict_level(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", L.cut_level(L.ces_norm(T.ces("o", "c")), L.CES_CUTS).alias("level"))


@query("lvl07_context_gate", f"{prepared(XFORM, 'doc_id')}, e AS (SELECT doc_id, ({CTX})::DOUBLE AS x FROM t) SELECT doc_id, x >= 1.1::DOUBLE AND x < 1.2::DOUBLE AS l1, x >= 1.5::DOUBLE AND x < 1.6::DOUBLE AS l5 FROM e")
def context_gate(spark, sf_dir):
    rows = xform(spark, sf_dir).select("doc_id", T.ctx_cer("o", "c").alias("x"))
    return rows.select("doc_id", L.context_gate(F.col("x"), F.lit("L1")).alias("l1"), L.context_gate(F.col("x"), F.lit("L5")).alias("l5"))


def _spec(metrics: list[str], family: str) -> str:
    edges = {k: L.SPEC_EDGES[family][k] for k in metrics}
    rows = []
    for only in (metrics, metrics[:1]):
        rows += [f"WHEN {' AND '.join(f'{k} >= {edges[k][i]}::DOUBLE AND {k} < {edges[k][i + 1]}::DOUBLE' for k in only)} THEN {i + 1}" for i in range(5)]
    return f"CASE {' '.join(rows)} ELSE 1 END"


@query("lvl02_spec_level", f"{prepared(XFORM, 'doc_id')}, e AS (SELECT doc_id, ({SQL['ccr']})::DOUBLE AS ccr, ({SQL['lcs']})::DOUBLE AS lcs FROM t) SELECT doc_id, {_spec(['ccr', 'lcs'], 'F')} AS level, round((0.4::DOUBLE * ccr + 0.6::DOUBLE * lcs) / 1.0::DOUBLE, 4) AS score FROM e")
def spec_level(spark, sf_dir):
    """LVL-01, LVL-02 for the format family."""
    rows = xform(spark, sf_dir).select("doc_id", T.ccr("o", "c").alias("ccr"), T.layout("o", "c").alias("lcs"))
    own = {"ccr": F.col("ccr"), "lcs": F.col("lcs")}
    return rows.select("doc_id", L.spec_level(own, "F").alias("level"), L.spec_score(own, "F").alias("score"))


@query("lvl04_spec_table", f"{prepared(XFORM, 'doc_id')}, e AS (SELECT doc_id, ({SQL['ccr']})::DOUBLE AS ccr, ({SQL['lcs']})::DOUBLE AS lcs FROM t) SELECT doc_id, {_spec(['ccr', 'lcs'], 'F')} AS level FROM e")
def spec_table_level(spark, sf_dir):
    """LVL-03, LVL-04: the format family's levels by a join with the table of specifications."""
    rows = xform(spark, sf_dir).select("doc_id", F.explode(F.create_map(F.lit("ccr"), T.ccr("o", "c"), F.lit("lcs"), T.layout("o", "c"))).alias("metric", "value")).withColumn("family", F.lit("F"))
    return S.classify(rows, S.spec_table(spark), "doc_id").select("doc_id", "level")


@query("lvl09_definition_level", f"WITH d AS (SELECT * FROM ({{}})) SELECT doc_id, {_cuts('score', L.DEFINITION_CUTS)} AS level FROM d".replace("{}", f"""WITH p AS ({XFORM}), m AS (SELECT doc_id, {", ".join(f"({FEATURES[k]})::DOUBLE AS {k}" for k in D.BOUNDS)} FROM p)
    SELECT doc_id, round((({" + ".join(f"{D.WEIGHTS[k]}::DOUBLE * {_normal(k)}" for k in D.BOUNDS)}) / {sum(D.WEIGHTS.values())!r}::DOUBLE)::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS score FROM m"""))
def definition_level(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", L.cut_level(D.definition_score("c"), L.DEFINITION_CUTS).alias("level"))


@query("lvl11_temperature", "SELECT l_orderkey, l_linenumber, round(least(0.95::DOUBLE, l_discount + 0.1::DOUBLE * greatest(0, l_linenumber - 1)), 2) AS temperature FROM lineitem")
def temperature(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", L.temperature(F.col("l_discount"), F.col("l_linenumber")).alias("temperature"))


# -- gates -------------------------------------------------------------------------

_BAG = "list_sort({a}) = list_sort({b})"
_GATES = {
    "noise": (G.noise_gate, TURNS, "conv_id, turn", [("oq <> ''", "original is empty"), ("cq <> ''", "candidate is empty"), (_BAG.format(a="onum", b="cnum"), "numbers changed"), ("len(ol) = len(cl)", "word count changed")]),
    "context": (G.context_gate, XFORM, "doc_id", [("oq <> ''", "original is empty"), ("cq <> ''", "candidate is empty"), (f"{_excess('onum', 'cnum')} = 0", "numbers lost"), ("contains(cq, oq)", "original not verbatim"), (f"{CTX} > 1", "not longer")]),
}
GATE_IDS = {"noise": "gat04", "context": "gat06"}


def _verdict(checks: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN NOT ({ok}) THEN '{why}'" for ok, why in checks) + " ELSE '' END"


for _g, (_fn, _src, _k, _checks) in _GATES.items():

    @query(f"{GATE_IDS[_g]}_{_g}_gate", f"{prepared(_src, _k)}, r AS (SELECT {_k}, {_verdict(_checks)} AS reason FROM t) SELECT {_k}, reason = '' AS passed, reason FROM r")
    def _gate(spark, sf_dir, fn=_fn, src=_src, key=_k):
        rows = (turns if src is TURNS else xform)(spark, sf_dir).select(*key.split(", "), fn("o", "c").alias("g"))
        return rows.select(*key.split(", "), "g.passed", "g.reason")


def _with_goals(source: str, key: str) -> str:
    """prepared() with CTE g: goal types og and cg of both sides."""
    low = f"a AS (SELECT *, lower(o) AS olow, lower(c) AS clow FROM t), b AS (SELECT *, {_sentences('trim(olow)')} AS oss, {_sentences('trim(clow)')} AS css FROM a)"
    return f"{prepared(source, key)}, {low}, g AS (SELECT *, {_goal_of('olow', 'coalesce(oss[len(oss)], olow)')} AS og, {_goal_of('clow', 'coalesce(css[len(css)], clow)')} AS cg FROM b)"


def _gate_sql(ctes: str, last: str, key: str, checks: list[tuple[str, str]]) -> str:
    own = [("oq <> ''", "original is empty"), ("cq <> ''", "candidate is empty"), *checks]
    return f"{ctes}, r AS (SELECT {key}, {_verdict(own)} AS reason FROM {last}) SELECT {key}, reason = '' AS passed, reason FROM r"


def _lexical(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {_q(T.WORD + '|' + T.NUMBER)}), lambda n: CASE WHEN regexp_matches(n, '^-?[0-9]') THEN replace(n, ',', '') ELSE n END)"


_KEPT = (f"{_excess('onum', 'cnum')} = 0", "numbers lost")
_SAME_GOAL = ("og = 'find_unknown' OR cg = og", "goal changed")


@query("gat05_conflict_gate", _gate_sql(prepared(TURNS, "conv_id, turn"), "t", "conv_id, turn", [_KEPT, (f"{_excess(_lexical('o'), _lexical('c'))} = 0", "tokens lost"), (f"({SQL['cc']}) >= 1", "no conflict added")]))
def conflict_gate(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", G.conflict_gate("o", "c").alias("g")).select("conv_id", "turn", "g.passed", "g.reason")


@query("gat02_paraphrase_gate", _gate_sql(_with_goals(TURNS, "conv_id, turn"), "g", "conv_id, turn", [(_BAG.format(a="onum", b="cnum"), "numbers changed"), ("len(cw) <= 1.3::DOUBLE * len(ow)", "too long"), ("abs(len(cs) - len(os)) <= 1", "sentence count changed"), _SAME_GOAL]))
def paraphrase_gate(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", G.paraphrase_gate("o", "c").alias("g")).select("conv_id", "turn", "g.passed", "g.reason")


@query("gat03_distractor_gate", _gate_sql(_with_goals(XFORM, "doc_id"), "g", "doc_id", [_KEPT, _SAME_GOAL, ("len(cs) > len(os)", "no sentence added")]))
def distractor_gate(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.distractor_gate("o", "c").alias("g")).select("doc_id", "g.passed", "g.reason")


@query("gat01_format_gate")
def format_gate(spark, sf_dir):
    rows = dl.dealt(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "o", "c", dl.edits("o", "c").alias("d"))
    return rows.select("conv_id", "turn", G.format_gate("o", "c", F.col("d")["unchanged"]).alias("g")).select("conv_id", "turn", "g.passed", "g.reason")


_TASK = ", ".join(_q(v) for v in G.TASK_VERBS)


@query("gat07_task_gate", f"WITH p AS ({TURNS}), r AS (SELECT conv_id, turn, CASE WHEN length(coalesce(c, '')) < 30 THEN 'too short' WHEN NOT list_has_any({_words(_squeeze('lower(coalesce(c, chr(32)))'))}, [{_TASK}]) THEN 'no action verb' ELSE '' END AS reason FROM p) SELECT conv_id, turn, reason = '' AS passed, reason FROM r")
def task_gate(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", G.task_gate("c").alias("g")).select("conv_id", "turn", "g.passed", "g.reason")


@query("gat08_enrichment_gate", f"WITH p AS ({XFORM}) SELECT doc_id, length(c) > length(o) AS passed FROM p")
def enrichment_gate(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.enrichment_gate("o", "c")["passed"].alias("passed"))


_DVERBS = ", ".join(_q(v) for v in G.DECISION_VERBS)


@query("gat09_decision_gate", f"WITH p AS ({XFORM}) SELECT doc_id, CASE WHEN NOT contains(c, '?') THEN 'no question' WHEN NOT regexp_matches(c, {_q(G.RULE_PATTERN)}) THEN 'no rule' WHEN NOT list_has_any(regexp_extract_all(lower(c), '[a-z]+'), [{_DVERBS}]) THEN 'no action verb' ELSE '' END AS reason FROM p")
def decision_gate(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.decision_gate("c")["reason"].alias("reason"))


_STRUCT = f"round((0.25::DOUBLE * least(1, ({DCM['num_rules']}) / 8::DOUBLE) + 0.25::DOUBLE * least(1, ({DCM['num_factors']}) / 6::DOUBLE) + 0.2::DOUBLE * least(1, ({DCM['num_exceptions']}) / 4::DOUBLE) + 0.2::DOUBLE * least(1, ({DCM['branch_depth']}) / 4::DOUBLE) + 0.1::DOUBLE * ({_TRADE})::INT)::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE"


@query(
    "gat10_decision_level_gate",
    f"""WITH p AS ({XFORM}), m AS (SELECT doc_id, {_STRUCT} AS struct_score, {", ".join(f"({FEATURES[k]})::DOUBLE AS {k}" for k in D.BOUNDS)} FROM p),
    d AS (SELECT doc_id, struct_score, round((({" + ".join(f"{D.WEIGHTS[k]}::DOUBLE * {_normal(k)}" for k in D.BOUNDS)}) / {sum(D.WEIGHTS.values())!r}::DOUBLE)::VARCHAR::DECIMAL(30, 18), 4)::DOUBLE AS score FROM m)
    SELECT doc_id, struct_score >= 0 AND struct_score < 0.16::DOUBLE AS structure, score >= 0 AND score < 0.16::DOUBLE AS definition FROM d""",
)
def decision_level_gate(spark, sf_dir):
    """GAT-10, GAT-11."""
    return xform(spark, sf_dir).select("doc_id", G.decision_level_gate("c", F.lit("L1"))["passed"].alias("structure"), G.definition_level_gate("c", F.lit("L1"))["passed"].alias("definition"))


@query("gat12_meaning", "SELECT doc_id, CASE WHEN quality = 0 AND doc_id % 3 <> 0 THEN FALSE WHEN toxic = 1 THEN FALSE ELSE TRUE END AS passed FROM labels")
def meaning(spark, sf_dir):
    """GAT-12 over injected verdicts: entailment from quality, a judge from toxic."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    entail = F.when(F.col("doc_id") % 3 != 0, F.col("quality").cast("double"))
    return rows.select("doc_id", G.verdict(*G.meaning("noise", entailment=entail, judge=F.col("toxic") == 0, least=0.5))["passed"].alias("passed"))


_MONEY = f"regexp_extract_all({{x}}, {_q(T.MONEY_NUMBER)})"
_SRULES = {
    "preserve_numbers": f"{_excess(_MONEY.format(x='o'), _MONEY.format(x='c'))} = 0",
    "preserve_word_count": "len(ow) = len(cw)",
}


@query("gat13_structural_gate", f"{prepared(TURNS, 'conv_id, turn')}, r AS (SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT ({ok}) THEN {_q(n)} END' for n, ok in _SRULES.items())}], lambda x: x IS NOT NULL), '; ') AS failures FROM t) SELECT conv_id, turn, failures = '' AS passed, failures FROM r")
def structural_gate(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", G.structural("o", "c", enabled(RULES["IQ"])).alias("g"))
    return rows.select("conv_id", "turn", "g.passed", "g.failures")


@query("gat13_structural_all_rules")
def structural_all(spark, sf_dir):
    rules = enabled(["preserve_numbers", "preserve_word_count", "same_sentence_count", "preserve_words_exact", "preserve_word_order", "no_extra_words", "max_length_ratio", "preserve_original_question", "preserve_original_question_verbatim", "no_number_reuse"])
    rows = turns(spark, sf_dir).select("conv_id", "turn", G.structural("o", "c", rules, added=F.col("c"), new_numbers=1).alias("g"))
    return rows.select("conv_id", "turn", "g.passed", "g.failures")


@query("gat15_entailment_label", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'entailment') THEN TRUE WHEN contains(lower(text), 'neutral') THEN FALSE WHEN contains(lower(text), 'contradiction') THEN FALSE ELSE lower(trim(text)) = 'entailment' END AS passed FROM conversations WHERE text IS NOT NULL")
def entailment_label(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    return rows.select("conv_id", "turn", G.entails(F.col("text"), ["entailment"]).alias("passed"))


@query("gat16_changed", f"WITH p AS ({XFORM}) SELECT doc_id, trim(o) <> trim(c) AS changed FROM p")
def changed(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.changed("o", "c").alias("changed"))


@query("gat17_paraphrase_delta", f"{prepared(XFORM, 'doc_id')} SELECT doc_id, abs(len(cs) - len(os)) <= 1 AND len(cw) <= 1.3::DOUBLE * len(ow) AS passed FROM t")
def paraphrase_delta(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.paraphrase_delta("o", "c", F.lit("L3"), {"L1": 0, "L2": 0, "L3": 1}).alias("passed"))


_NEW = " OR ".join(f"(contains(c, {_q(m)}) AND NOT contains(o, {_q(m)}))" for m in G.FORBIDDEN["L1"])


@query("gat18_forbidden_marks", f"WITH p AS ({XFORM}) SELECT doc_id, CASE WHEN {_NEW} THEN 'L2' ELSE 'L1' END AS level, TRUE AS passed FROM p")
def forbidden(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", G.forbidden("o", "c", F.lit("L1"), F.lit("F")).alias("g")).select("doc_id", "g.level", "g.passed")


@query("gat19_final_gate", "SELECT doc_id, coalesce(quality = 1, FALSE) AND coalesce(toxic = 0, TRUE) AS passed FROM labels")
def final_gate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", G.final(F.col("quality") == 1, F.lit(None).cast("boolean"), F.col("toxic") == 0).alias("passed"))


# -- transforms ----------------------------------------------------------------------


@query("gen05_transforms")
def transforms(spark, sf_dir):
    """GEN-05 to GEN-10 on whole documents."""
    return xform(spark, sf_dir).select("doc_id", *(X.apply_transform("o", v, 7).alias(v) for v in X.LEVELS))


@query("gen03_wrap_words", f"WITH p AS ({XFORM}) SELECT doc_id, least(8192, floor(len({_words(_squeeze('o'))}) * 1.35::DOUBLE)::BIGINT) AS target FROM p")
def wrap_words(spark, sf_dir):
    return xform(spark, sf_dir).select("doc_id", X.wrap_words(T.word_count("o"), 1.3, 1.4).alias("target"))


@query("gen04_hints", "SELECT l_orderkey, l_linenumber, CASE (l_linenumber - 1) % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'formal' ELSE 'brief' END AS hint FROM lineitem")
def hints(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("plain", "formal", "brief")))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", X.hint(names, F.col("l_linenumber")).alias("hint"))


_UNITS = f"list_sort(list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: list_contains([{', '.join(_q(w) for w in T.UNIT_WORDS)}], w))))"


@query(
    "gen11_core",
    f"""WITH p AS ({XFORM}), a AS (SELECT doc_id, o, lower(o) AS low FROM p), b AS (SELECT *, {_sentences('trim(low)')} AS ss FROM a), d AS (SELECT *, coalesce(ss[len(ss)], low) AS last FROM b)
    SELECT doc_id, array_to_string(list_sort(list_distinct({_numbers('o')})), ',') AS numbers, array_to_string({_UNITS}, ',') AS units, {_GOAL} AS goal FROM d""",
)
def core(spark, sf_dir):
    """GEN-11: numbers, units and goal of each text."""
    return xform(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_distinct(T.numbers("o"))), ",").alias("numbers"), F.array_join(F.array_sort(T.units("o")), ",").alias("units"), T.goal_type("o").alias("goal"))


@query("set03_multiset_difference", f"{prepared(TURNS, 'conv_id, turn')} SELECT conv_id, turn, ({_excess('ct', 'ot')})::INT AS added, ({_excess('ot', 'ct')})::INT AS removed FROM t")
def multiset(spark, sf_dir):
    a, b = T.ordered_tokens("o"), T.ordered_tokens("c")
    return turns(spark, sf_dir).select("conv_id", "turn", T.excess(b, a).alias("added"), T.excess(a, b).alias("removed"))


@query("set02_token_sets", f"{prepared(TURNS, 'conv_id, turn')} SELECT conv_id, turn, len(list_distinct(list_concat(ot, ct))) AS n_union, len(list_intersect(list_distinct(ot), list_distinct(ct))) AS n_both FROM t")
def token_sets(spark, sf_dir):
    a, b = T.tokens("o"), T.tokens("c")
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(F.array_union(a, b)).cast("long").alias("n_union"), F.size(F.array_intersect(a, b)).cast("long").alias("n_both"))
