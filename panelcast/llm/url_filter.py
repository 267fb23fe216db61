"""URL filter: a path-template tree per host (DataFrame functions only).

1. Urls become (host, path); fixed rules give some of them a verdict. These are the labels.
2. Path segments that look like values (numbers, long hex, dates, ...) become the wildcard
   '*', and rows are summed to (host, segments) with their label counts: from here on the
   tables hold templates, not urls, and a hot host is one of few summed rows.
3. Depth by depth, sibling branches are compared with the rest of their siblings: a branch
   whose labelled share of blocks does not differ significantly (two-proportion z test), or
   that has too few labels to tell, is merged into the wildcard branch.
4. A template's purity is its labelled share of blocks, smoothed towards its host's, that
   towards its domain's, that towards the global one. Templates at or above `reject` are
   blocked. Rules win over the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table
from panelcast.session import cut_lineage

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment that is a value: only digits (with an ending), 8 or more hex digits, or 4 or more digits in it.
VARIABLE = r"^([0-9]+([.][A-Za-z0-9]+)?|[0-9a-fA-F-]{8,}|.*[0-9].*[0-9].*[0-9].*[0-9].*)$"
LABEL_Z, MIN_LABELS, PRIOR, REJECT, DEPTH = 1.96, 8, 8.0, 0.75, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(at + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def template(path: Column, depth: int) -> Column:
    """The path's first `depth` segments with values as '*'; what lies deeper is '**'."""
    parts = F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/"),
                        lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def merge_branches(nodes: DataFrame, depth: int, z: float, min_labels: int) -> DataFrame:
    """Merges, at one depth, the branches that do not differ from their siblings.

    nodes: (_host, _key, _t, _n, _lab, _blk); _t is the template so far.
    """
    parent = F.concat_ws("/", F.slice("_t", 1, depth - 1))
    seg = F.get("_t", F.lit(depth - 1))
    rows = nodes.withColumn("_p", parent).withColumn("_seg", seg)
    sums = rows.filter("_seg IS NOT NULL").groupBy("_host", "_p", "_seg").agg(
        F.sum("_lab").alias("_l"), F.sum("_blk").alias("_b"))
    whole = sums.groupBy("_host", "_p").agg(F.sum("_l").alias("_pl"), F.sum("_b").alias("_pb"))
    own = sums.join(whole, ["_host", "_p"])
    l, b, rl, rb = F.col("_l"), F.col("_b"), F.col("_pl") - F.col("_l"), F.col("_pb") - F.col("_b")
    pooled = F.col("_pb") / F.col("_pl")
    gap = F.abs(b / l - rb / rl)
    differs = ((l >= min_labels) & (rl >= min_labels)
               & (gap * gap > z * z * pooled * (1 - pooled) * (F.lit(1.0) / l + F.lit(1.0) / rl)))
    # guarded: the division by zero labels is never reached
    own = own.withColumn("_keep", F.when((l > 0) & (rl > 0), differs).otherwise(F.lit(False)))
    kept = own.filter("_keep").select("_host", "_p", "_seg", F.lit(True).alias("_keep"))
    out = rows.join(kept, ["_host", "_p", "_seg"], "left")
    merged = F.when(F.col("_seg").isNull() | F.col("_keep").isNotNull(), F.col("_t")).otherwise(
        F.concat(F.slice("_t", 1, depth - 1), F.array(F.lit("*")), F.slice(F.col("_t"), depth + 1, 100)))
    return out.select("_host", "_key", merged.alias("_t"), "_n", "_lab", "_blk")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               depth: int = DEPTH, z: float = LABEL_Z, min_labels: int = MIN_LABELS,
               prior: float = PRIOR, reject: float = REJECT, salts: int = 16) -> DataFrame:
    """One row per input row: <id_col>, host, path, rule, verdict, template.

    A null url, or one without '://', has an empty host and path, no rule, and the verdict
    of the empty host's template. Ties of rules cannot occur (one text fits once). Repeated
    rows count each. With no labelled row at all the global share is 1/2 and all pass.
    An empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    rule, verdict = matched_rule(F.col("_host"), F.col("_path"), rules)
    rows = rows.select("_id", "_host", "_path", rule.alias("_rule"), verdict.alias("_ruled"),
                       F.concat_ws("/", template(F.col("_path"), depth)).alias("_key"))
    labelled = F.col("_ruled").isNotNull().cast("long")
    blocked = (F.coalesce(F.col("_ruled"), F.lit("")) == "block").cast("long")
    nodes = rows.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n"), F.sum(labelled).alias("_lab"),
                                              F.sum(blocked).alias("_blk"))
    nodes = cut_lineage(nodes.withColumn("_t", F.split("_key", "/")))
    for d in range(1, depth + 1):
        nodes = merge_branches(nodes, d, z, min_labels)
    nodes = cut_lineage(nodes.withColumn("_t", F.concat_ws("/", "_t")))

    domain = F.substring_index("_host", ".", -2)
    per_template = nodes.groupBy("_host", "_t").agg(F.sum("_lab").alias("_l"), F.sum("_blk").alias("_b"))
    per_host = per_template.groupBy("_host").agg(F.sum("_l").alias("_hl"), F.sum("_b").alias("_hb"))
    per_host = per_host.withColumn("_domain", domain)
    per_domain = per_host.groupBy("_domain").agg(F.sum("_hl").alias("_dl"), F.sum("_hb").alias("_db"))
    overall = per_domain.agg(F.coalesce(F.sum("_dl"), F.lit(0)).alias("_gl"),
                             F.coalesce(F.sum("_db"), F.lit(0)).alias("_gb"))
    m = F.lit(prior)
    # one row, so the join without a key does not multiply anything
    per_domain = per_domain.join(F.broadcast(overall)).withColumn(
        "_dp", (F.col("_db") + m * (F.col("_gb") + 1) / (F.col("_gl") + 2)) / (F.col("_dl") + m))
    per_host = per_host.join(per_domain.select("_domain", "_dp"), "_domain").withColumn(
        "_hp", (F.col("_hb") + m * F.col("_dp")) / (F.col("_hl") + m))
    judged = per_template.join(per_host.select("_host", "_hp"), "_host").withColumn(
        "_purity", (F.col("_b") + m * F.col("_hp")) / (F.col("_l") + m))
    verdicts = (nodes.select("_host", "_key", "_t").join(judged.select("_host", "_t", "_purity"), ["_host", "_t"])
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    # urls of a hot host are dealt over `salts` tasks
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_path"), F.lit(salts)).cast("int"))
    out = rows.join(verdicts, ["_host", "_key", "_salt"])
    by_tree = F.when(F.col("_purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule").alias("rule"), F.coalesce("_ruled", by_tree).alias("verdict"),
                      F.concat(F.lit("/"), F.col("_t")).alias("template"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The tree in DuckDB SQL: a list column per template, one pair of CTEs per depth."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits) + " END"
    sql = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
g AS (SELECT *, {rule} AS rule, {ruled} AS ruled,
             list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
                            lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END) AS segs FROM u),
k AS (SELECT *, array_to_string(CASE WHEN len(segs) > {DEPTH} THEN list_append(segs[1:{DEPTH}], '**') ELSE segs END, '/') AS key FROM g),
n0 AS (SELECT host, key, string_split(key, '/') AS t, count(ruled) AS lab, count(*) FILTER (ruled = 'block') AS blk
       FROM k GROUP BY host, key)"""
    for d in range(1, DEPTH + 1):
        sql += f""",
c{d} AS (SELECT *, array_to_string(t[1:{d - 1}], '/') AS p, t[{d}] AS seg FROM n{d - 1}),
s{d} AS (SELECT host, p, seg, sum(lab)::DOUBLE AS l, sum(blk)::DOUBLE AS b FROM c{d} WHERE seg IS NOT NULL GROUP BY ALL),
w{d} AS (SELECT *, sum(l) OVER (PARTITION BY host, p) AS pl, sum(b) OVER (PARTITION BY host, p) AS pb FROM s{d}),
f{d} AS (SELECT host, p, seg FROM w{d} WHERE l >= {MIN_LABELS} AND pl - l >= {MIN_LABELS}
        AND pow(abs(b / l - (pb - b) / (pl - l)), 2) > {LABEL_Z * LABEL_Z} * (pb / pl) * (1 - pb / pl) * (1.0 / l + 1.0 / (pl - l))),
n{d} AS (SELECT c.host, c.key, c.lab, c.blk,
               CASE WHEN c.seg IS NULL OR f.seg IS NOT NULL THEN c.t
                    ELSE list_concat(list_append(c.t[1:{d - 1}], '*'), c.t[{d + 1}:]) END AS t
        FROM c{d} c LEFT JOIN f{d} f ON c.host = f.host AND c.p = f.p AND c.seg = f.seg)"""
    return sql + f""",
pt AS (SELECT host, array_to_string(t, '/') AS t, sum(lab)::DOUBLE AS l, sum(blk)::DOUBLE AS b FROM n{DEPTH} GROUP BY ALL),
ph AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, sum(l) AS hl, sum(b) AS hb FROM pt GROUP BY ALL),
pd AS (SELECT domain, sum(hl) AS dl, sum(hb) AS db FROM ph GROUP BY domain),
pg AS (SELECT (coalesce(sum(db), 0) + 1) / (coalesce(sum(dl), 0) + 2) AS gp FROM pd),
dp AS (SELECT domain, (db + {PRIOR} * gp) / (dl + {PRIOR}) AS dp FROM pd, pg),
hp AS (SELECT host, (hb + {PRIOR} * dp) / (hl + {PRIOR}) AS hp FROM ph JOIN dp USING (domain)),
v AS (SELECT pt.host, pt.t, (b + {PRIOR} * hp) / (l + {PRIOR}) AS purity FROM pt JOIN hp USING (host))
SELECT k.page_id, k.host, k.path, k.rule,
       coalesce(k.ruled, CASE WHEN v.purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       '/' || v.t AS template
FROM k JOIN n{DEPTH} n ON k.host = n.host AND k.key = n.key
       JOIN v ON v.host = n.host AND v.t = array_to_string(n.t, '/')
"""


SQL = _sql()
