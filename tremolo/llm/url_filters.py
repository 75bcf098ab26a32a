"""URL filter by rules and by a tree of path templates (op 6). DataFrame functions only.

Rules (host, path prefix, verdict) come first: a rule fits its host and all
subdomains; the longest one wins. Other URLs are judged by a tree that is grown
for each host from all URLs:

1. Variable segments are generalised: runs of digits become `#`; where more than
   WIDE different segments stand below one node, those seen once become `*`.
2. Statistically similar siblings merge: a segment whose share of bad labels is
   within Z standard errors of its parent's (or that has no labels) becomes `*`.
   Of the directories that stay, those above the parent's share merge likewise if
   they are within Z standard errors of their common share, and those below it.
3. A template is rejected if its share of bad labels, smoothed by WEIGHT labels
   at the overall share, is at least BAD.

Directories are generalised from the host down, a depth at a time, so that what
has merged counts as one node further down; then come the leaves of what the
directories have become. A depth takes one round of joins and a small table in
the shared folder; a directory that is alone below its node is done at once.

The SQL of op6 has the rule for leaves only. Both agree where no merging of
directories changes a verdict, as on the driver's tables (paths of one directory).

Counts are aggregated by template before they are shuffled, so a host with a
third of all URLs is a few rows by then. Nulls: a null URL, or one without
`://`, has an empty host and path, and belongs to one template like others;
pages without a label count for no purity. Several labels of one page: it is bad
if one says so. Repeated rows are judged each. An empty table gives no rows;
other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: Host, path prefix, verdict (fixed values of the query's contract).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
WIDE, Z, WEIGHT, BAD = 64, 2.0, 10.0, 0.5


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-case host, and path; both empty for null and where there is no `://`."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def templates(pages: DataFrame) -> DataFrame:
    """host, branch, leaf, n, labelled, bad of each template; pages: host, path, bad (null: no label)."""
    shape = F.regexp_replace("path", "[0-9]+", "#")
    leaf = F.regexp_extract(shape, "[^/]*/?$", 0)
    rows = pages.select("host", shape.alias("shape"), leaf.alias("leaf"), "bad")
    rows = rows.select("host", F.expr("substring(shape, 1, length(shape) - length(leaf))").alias("branch"), "leaf", "bad")
    return rows.groupBy("host", "branch", "leaf").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def _alike(share: Column) -> Column:
    """Whether labelled and bad are within Z standard errors of a share, or there are no labels."""
    error = F.sqrt(F.try_divide(share * (1 - share), "labelled"))
    return (F.col("labelled") == 0) | F.coalesce(F.abs(F.try_divide("bad", "labelled") - share) <= Z * error, F.lit(False))


def directories(leaves: DataFrame) -> DataFrame:
    """host, branch, node of each branch: node is the branch with merged segments as ?*, ?+ or ?- (no path has a question mark)."""
    parts = F.split("branch", "/")
    first = leaves.groupBy("host", "branch").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    live = first.select("host", "branch", F.substring("branch", 1, 1).alias("node"), F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))).alias("left"), "n", "labelled", "bad")
    done = None
    while True:
        live = written(live, "directories")
        ended = live.where("size(left) = 0").select("host", "branch", "node")
        done = ended if done is None else done.unionByName(ended)
        live = live.where("size(left) > 0")
        if live.isEmpty():
            return done
        live = live.withColumn("part", F.col("left")[0])
        kids = live.groupBy("host", "node", "part").agg(F.count("*").alias("branches"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        above = kids.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("branches").alias("below"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        share = F.try_divide("all_bad", "all_labelled")
        side = F.when(_alike(share) | ((F.col("kinds") > WIDE) & (F.col("n") == 1)), "?*").when(F.try_divide("bad", "labelled") > share, "?+").otherwise("?-")
        kids = kids.join(above, ["host", "node"]).select("host", "node", "part", "labelled", "bad", side.alias("side"), (F.col("below") == 1).alias("alone"))
        pools = kids.groupBy("host", "node", "side").agg(F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
        merges = (F.col("side") == "?*") | _alike(F.try_divide("pool_bad", "pool_labelled"))
        kids = kids.join(pools, ["host", "node", "side"]).select("host", "node", "part", "alone", F.when(merges, F.col("side")).otherwise(F.col("part")).alias("name"))
        name = F.concat("node", "name", F.lit("/"))
        rest = F.expr("slice(left, 2, size(left))")
        # alone: each segment further down has its parent's share
        live = live.join(kids, ["host", "node", "part"]).select("host", "branch", F.when(F.col("alone"), F.concat(name, F.expr("repeat('?*/', size(left) - 1)"))).otherwise(name).alias("node"), F.when(F.col("alone"), F.slice("left", 1, 0)).otherwise(rest).alias("left"), "n", "labelled", "bad")


def rejected(leaves: DataFrame) -> DataFrame:
    """host, branch, leaf of the rejected templates; the branches and leaves that merged are listed each."""
    leaves = written(leaves, "leaves")
    own = leaves.join(directories(leaves), ["host", "branch"])
    merged = own.groupBy("host", "node", "leaf").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    node = merged.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    rare = (F.col("kinds") > WIDE) & (F.col("n") == 1)
    tree = merged.join(node, ["host", "node"]).select("host", "node", "leaf", "n", "labelled", "bad", F.when(_alike(F.try_divide("all_bad", "all_labelled")) | rare, F.lit("*")).otherwise(F.col("leaf")).alias("template"))
    total = leaves.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior"))
    template = tree.groupBy("host", "node", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # the prior is one row
    judged = template.join(F.broadcast(total)).where((F.col("bad") + WEIGHT * F.col("prior")) / (F.col("labelled") + WEIGHT) >= BAD)
    bad = tree.select("host", "node", "leaf", "template").join(judged.select("host", "node", "template"), ["host", "node", "template"])
    return own.join(bad.select("host", "node", "leaf"), ["host", "node", "leaf"]).select("host", "branch", "leaf")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict. labels: page_id, bad (0 or 1)."""
    host, path = host_path()
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    shape = F.regexp_replace("path", "[0-9]+", "#")
    bad = rejected(templates(own.join(known, "page_id", "left")))
    keyed = own.withColumn("leaf", F.regexp_extract(shape, "[^/]*/?$", 0)).withColumn("shape", shape)
    keyed = keyed.select("page_id", "host", "path", "leaf", F.expr("substring(shape, 1, length(shape) - length(leaf))").alias("branch"))
    rule, verdict = rule_of(rules)
    return keyed.join(bad.withColumn("rejected", F.lit(True)), ["host", "branch", "leaf"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))


def oracle_sql() -> str:
    rule = verdict = "NULL"
    for h, p, v in sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM u),
    own AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
    known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
    s AS (SELECT own.*, bad, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM own LEFT JOIN known USING (page_id)),
    l AS (SELECT *, regexp_extract(shape, '[^/]*/?$') AS leaf FROM s),
    k AS (SELECT *, substr(shape, 1, length(shape) - length(leaf)) AS branch FROM l),
    leaves AS (SELECT host, branch, leaf, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM k GROUP BY ALL),
    b AS (SELECT host, branch, count(*) AS kinds, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM leaves GROUP BY ALL),
    tree AS (SELECT leaves.*, CASE WHEN labelled = 0 OR (kinds > {WIDE} AND n = 1)
                 OR abs(bad::DOUBLE / labelled - all_bad::DOUBLE / all_labelled) <= {Z} * sqrt((all_bad::DOUBLE / all_labelled) * (1 - all_bad::DOUBLE / all_labelled) / labelled)
                 THEN '*' ELSE leaf END AS template FROM leaves JOIN b USING (host, branch)),
    p AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0.0) AS prior FROM leaves),
    node AS (SELECT host, branch, template, sum(labelled) AS labelled, sum(bad) AS bad FROM tree GROUP BY ALL),
    judged AS (SELECT node.* FROM node, p WHERE (bad + {WEIGHT} * prior) / (labelled + {WEIGHT}) >= {BAD}),
    bad AS (SELECT host, branch, leaf FROM tree JOIN judged USING (host, branch, template))
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bad.leaf IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM k LEFT JOIN bad USING (host, branch, leaf)"""
