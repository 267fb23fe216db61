"""Reference SQL for the query catalogue (plain ANSI SQL, DuckDB dialect).

Used by the driver's cross-check and by tests: every key here has a Spark
implementation of the same name in plans/catalog.py.
"""

from __future__ import annotations

from panelcast.plans.studies import BOOST_SETTINGS
from panelcast.sources.fixture import PANEL_SQL


def R(expr: str, d: int = 6) -> str:
    return f"(round({expr}, {d}) + 0.0)"


BASE = f"""WITH panel AS ({PANEL_SQL}),
clean AS (
  SELECT row_key, unit, item, period, y, kind, p_size, x1, x2, x3, x4, x5 FROM panel
  WHERE p_size IS DISTINCT FROM 50
    AND row_key IS NOT NULL AND unit IS NOT NULL AND item IS NOT NULL AND period IS NOT NULL
    AND y IS NOT NULL AND kind IS NOT NULL AND p_size IS NOT NULL
    AND x1 IS NOT NULL AND NOT isnan(x1) AND x2 IS NOT NULL AND NOT isnan(x2)
    AND x3 IS NOT NULL AND NOT isnan(x3) AND x4 IS NOT NULL AND NOT isnan(x4)
    AND x5 IS NOT NULL AND NOT isnan(x5)
),
bounds AS (
  SELECT min(period) AS min_period, max(period) AS max_period,
         CAST(min(period) + floor((max(period) - min(period)) / 2) AS INT) AS mid_period
  FROM clean
)"""


def _folds(h: int) -> str:
    return f"""folds AS (
  SELECT {h} AS horizon, b.min_period AS train_start, CAST(t.train_end AS INT) AS train_end,
         CAST(t.train_end + {h} AS INT) AS val_period, CAST(t.train_end + {h} + 1 AS INT) AS test_period
  FROM bounds b, range(b.mid_period, b.max_period - {h} + 1) t(train_end)
  WHERE EXISTS (SELECT 1 FROM clean c WHERE c.period = t.train_end + {h} + 1)
)"""


def _all_folds() -> str:
    every = ",\n".join(_folds(h).replace("folds AS", f"folds{h} AS") for h in (1, 5, 10))
    return every + ",\nfolds AS (SELECT * FROM folds1 UNION ALL SELECT * FROM folds5 UNION ALL SELECT * FROM folds10)"


FEATS = ("x1", "x2", "x3", "x4", "x5")


def _scale_expr(f: str, mean: str, var: str, n: str) -> str:
    eps = "2.220446049250313e-16"
    return (f"CASE WHEN {var} <= {n} * {eps} * {var} + pow({n} * {mean} * {eps}, 2) "
            f"THEN 1.0 ELSE sqrt({var}) END")


def _ap_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    part = f"PARTITION BY {k} " if keys else ""
    sel = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""s AS (SELECT {sel}score, CAST(sum(y) AS BIGINT) AS tp, count(*) AS n FROM {src}
             {"GROUP BY " + k + ", score" if keys else "GROUP BY score"}),
c AS (SELECT *, sum(tp) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
               sum(n) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
      FROM s),
ap AS (SELECT {sel}CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) ELSE 0.0 END AS ap,
              CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_pos
       FROM c {grp})"""


def _expanding_counts(h: int) -> str:
    return f"""{BASE},
{_folds(h)},
pc AS (SELECT period, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM clean GROUP BY period),
j AS (
  SELECT f.*, CASE WHEN pc.period <= f.train_end THEN 'train'
                   WHEN pc.period = f.val_period THEN 'val' ELSE 'test' END AS role, pc.n, pc.n_pos
  FROM folds f JOIN pc ON pc.period <= f.train_end OR pc.period = f.val_period
                       OR pc.period = f.test_period
),
r AS (SELECT * FROM j UNION ALL
      SELECT horizon, train_start, train_end, val_period, test_period, 'trainval' AS role, n, n_pos
      FROM j WHERE role IN ('train', 'val'))
SELECT horizon, train_end, val_period, test_period, role,
       CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_pos) AS BIGINT) AS n_pos
FROM r GROUP BY ALL"""


def _rank_sql(src: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', row_key, '1337'))) AS rk
      FROM {src})"""


_MODELS = ("x1", "x2", "x5")

SQL: dict[str, str] = {
    "panel_clean": f"{BASE} SELECT * FROM clean",

    "panel_elapsed": f"""{BASE}
SELECT row_key, period, CAST(period - min_period AS INT) AS elapsed, min_period, max_period, mid_period
FROM clean, bounds""",

    "dummies_kind": f"""{BASE}
SELECT row_key, {", ".join(f"CAST(kind = '{k}' AS INT) AS kind_{k}"
                            for k in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))}
FROM clean""",

    "dummies_aligned": f"""{BASE},
{_all_folds()},
sp AS (SELECT horizon, train_end, CASE WHEN period <= train_end THEN 'train' WHEN period = val_period THEN 'val'
              ELSE 'test' END AS split, unit
       FROM folds JOIN clean ON period <= train_end OR period = val_period OR period = test_period),
fl AS (SELECT horizon, train_end, split, min(unit) AS first FROM sp GROUP BY ALL),
cols AS (SELECT DISTINCT horizon, train_end, unit FROM sp JOIN fl USING (horizon, train_end, split) WHERE unit > first)
SELECT horizon, train_end, split, 'unit_' || CAST(cols.unit AS VARCHAR) AS dummy,
       CAST(count(sp.unit) FILTER (WHERE sp.unit > first) AS BIGINT) AS ones
FROM cols JOIN fl USING (horizon, train_end) LEFT JOIN sp USING (horizon, train_end, split, unit)
GROUP BY ALL""",

    "interactions": f"""{BASE}
SELECT kind, count(*) AS n, {R("sum(x1 * x2)")} AS sum_x1_x2 FROM clean GROUP BY kind""",

    "scale_global": f"""{BASE},
st AS (SELECT count(*) AS n, {", ".join(f"avg({f}) AS {f}_m, var_pop({f}) AS {f}_v" for f in FEATS)}
       FROM clean)
SELECT row_key, {", ".join(R(f"({f} - {f}_m) / ({_scale_expr(f, f'{f}_m', f'{f}_v', 'n')})") + f" AS {f}_z"
                           for f in FEATS)}
FROM clean, st""",

    "scale_per_fold": f"""{BASE},
{_folds(1)},
st AS (SELECT f.train_end, f.test_period, count(*) AS n,
              {", ".join(f"avg(c.{f}) AS {f}_m, var_pop(c.{f}) AS {f}_v" for f in FEATS)}
       FROM folds f JOIN clean c ON c.period <= f.train_end GROUP BY f.train_end, f.test_period)
SELECT st.train_end, c.row_key,
       {", ".join(R(f"(c.{f} - {f}_m) / ({_scale_expr(f, f'{f}_m', f'{f}_v', 'st.n')})") + f" AS {f}_z"
                  for f in FEATS)}
FROM st JOIN clean c ON c.period = st.test_period""",

    "holdout_rows": f"""{BASE},
cc AS (SELECT y, count(*) AS nc FROM clean GROUP BY y),
t AS (SELECT y, nc, sum(nc) OVER () AS n FROM cc),
t2 AS (SELECT *, CAST(ceil(0.2 * n) AS BIGINT) AS n_test FROM t),
t3 AS (SELECT *, n - n_test AS n_train FROM t2),
t4 AS (SELECT *, CAST(floor((nc * n_train) / n) AS BIGINT) AS fl, (nc * n_train) % n AS rem FROM t3),
t5 AS (SELECT *, n_train - sum(fl) OVER () AS short FROM t4),
t6 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, y ASC) AS rr FROM t5),
k AS (SELECT y, nc - fl - CASE WHEN rr <= short THEN 1 ELSE 0 END AS k_test FROM t6),
r AS {_rank_sql("clean")}
SELECT r.row_key, r.y, CASE WHEN r.rk <= k.k_test THEN 'test' ELSE 'train' END AS role
FROM r JOIN k ON r.y = k.y""",

    "kfold_counts": f"""{BASE},
r AS {_rank_sql("clean")}
SELECT CAST((rk - 1) % 10 AS INT) AS fold, y, count(*) AS n FROM r GROUP BY ALL""",

    "kfold_row_order": f"""{BASE},
o AS (SELECT y, row_number() OVER (ORDER BY item, unit, period, row_key) AS row_number FROM clean),
cl AS (SELECT y, min(row_number) AS first, count(*) AS n FROM o GROUP BY y),
srt AS (SELECT y, row_number() OVER (ORDER BY first, row_number) - 1 AS pos FROM o JOIN cl USING (y)),
al AS (SELECT y, CAST(pos % 10 AS INT) AS fold, count(*) AS n FROM srt GROUP BY ALL),
en AS (SELECT y, fold, sum(n) OVER (PARTITION BY y ORDER BY fold) AS hi, n FROM al),
rk AS (SELECT y, row_number, row_number() OVER (PARTITION BY y ORDER BY row_number) AS r FROM o)
SELECT fold, rk.y, count(*) AS n, min(row_number) AS first_row, max(row_number) AS last_row
FROM rk JOIN en ON rk.y = en.y AND r <= hi AND r > hi - en.n GROUP BY ALL""",

    "folds_expanding_h1": _expanding_counts(1),
    "folds_expanding_h5": _expanding_counts(5),
    "folds_expanding_h10": _expanding_counts(10),

    "folds_item_out": f"""{BASE},
ic AS (SELECT item, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM clean GROUP BY item),
tot AS (SELECT sum(n) AS tn, sum(n_pos) AS tp FROM ic)
SELECT item AS held_item, 'test' AS role, n, n_pos FROM ic
UNION ALL
SELECT item AS held_item, 'train' AS role, CAST(tn - n AS BIGINT) AS n, CAST(tp - n_pos AS BIGINT) AS n_pos
FROM ic, tot""",

    "folds_nested": f"""{BASE},
ic AS (SELECT item, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM clean GROUP BY item)
SELECT item, CAST(dense_rank() OVER (ORDER BY item) - 1 AS INT) AS item_index, n, n_pos,
       CAST(count(*) OVER () - 1 AS INT) AS n_inner_folds
FROM ic""",

    "confusion": f"""{BASE}
SELECT y, CAST(x2 * 10 > 0.5 AS INT) AS pred, count(*) AS n FROM clean GROUP BY ALL""",

    "f1_bacc": f"""{BASE},
cf AS (SELECT CAST(sum(CASE WHEN y = 1 AND x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(sum(CASE WHEN y = 0 AND x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN y = 1 AND NOT x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
              CAST(sum(CASE WHEN y = 0 AND NOT x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn
       FROM clean)
SELECT tp, fp, fn, tn,
       {R("CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0.0 END")} AS f1,
       {R("((CASE WHEN tp+fn > 0 THEN tp*1.0/(tp+fn) ELSE 0.0 END) + (CASE WHEN tn+fp > 0 THEN tn*1.0/(tn+fp) ELSE 0.0 END)) / 2")} AS balanced_accuracy
FROM cf""",

    "class_report": f"""{BASE},
cf AS (SELECT CAST(sum(CASE WHEN y = 1 AND x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
              CAST(sum(CASE WHEN y = 0 AND x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
              CAST(sum(CASE WHEN y = 1 AND NOT x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
              CAST(sum(CASE WHEN y = 0 AND NOT x2 * 10 > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
       FROM clean),
cl AS (
  SELECT '0' AS row, CASE WHEN tn+fn > 0 THEN tn/(tn+fn) ELSE 0.0 END AS p,
         CASE WHEN tn+fp > 0 THEN tn/(tn+fp) ELSE 0.0 END AS r, tn+fp AS support, tp+fp+fn+tn AS n FROM cf
  UNION ALL
  SELECT '1', CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END,
         CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END, tp+fn, tp+fp+fn+tn FROM cf),
cl2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0.0 END AS f FROM cl),
rows AS (
  SELECT row, p AS precision, r AS recall, f AS f1, support FROM cl2
  UNION ALL
  SELECT 'accuracy', NULL, NULL, (tp+tn)/(tp+fp+fn+tn), tp+fp+fn+tn FROM cf
  UNION ALL
  SELECT 'macro avg', avg(p), avg(r), avg(f), max(n) FROM cl2
  UNION ALL
  SELECT 'weighted avg', sum(p*support)/max(n), sum(r*support)/max(n), sum(f*support)/max(n), max(n) FROM cl2)
SELECT row, {R("precision")} AS precision, {R("recall")} AS recall, {R("f1")} AS f1,
       CAST(support AS BIGINT) AS support
FROM rows""",

    "ap_by_fold": f"""{BASE},
{_folds(1)},
t AS (SELECT f.train_end, f.test_period, c.y, c.x2 AS score FROM clean c JOIN folds f ON c.period = f.test_period),
{_ap_sql("t", ["train_end", "test_period"])}
SELECT train_end, test_period, {R("ap")} AS ap, n, n_pos FROM ap""",

    "ap_item_out": f"""{BASE},
t AS (SELECT item, y, x2 AS score FROM clean),
{_ap_sql("t", ["item"])}
SELECT item, {R("ap")} AS ap, n, n_pos FROM ap""",

    "pr_curve": f"""{BASE},
s AS (SELECT x2 AS score, CAST(sum(y) AS BIGINT) AS tp, count(*) AS n FROM clean GROUP BY x2),
c AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn,
             sum(tp) OVER () AS pos FROM s)
SELECT {R("ctp / cn")} AS precision, {R("CASE WHEN pos > 0 THEN ctp / pos ELSE 1.0 END")} AS recall,
       {R("CAST(score AS DOUBLE)")} AS threshold FROM c
UNION ALL SELECT 1.0, 0.0, NULL""",

    "class_weights": f"""{BASE},
cc AS (SELECT y, count(*) AS n FROM clean GROUP BY y),
sch AS (SELECT * FROM (VALUES ('none'), ('balanced'), ('3'), ('4'), ('5'), ('6'), ('7'), ('8'), ('9'), ('10')) v(scheme)),
w AS (SELECT sch.scheme, cc.y, cc.n,
             CASE WHEN sch.scheme = 'none' THEN 1.0
                  WHEN sch.scheme = 'balanced' THEN (sum(cc.n) OVER (PARTITION BY sch.scheme)) / (count(*) OVER (PARTITION BY sch.scheme) * cc.n)
                  WHEN cc.y = 1 THEN CAST(sch.scheme AS DOUBLE) ELSE 1.0 END AS weight
      FROM sch CROSS JOIN cc)
SELECT scheme, y, {R("weight")} AS weight, n, {R("weight * n")} AS total_weight FROM w""",
}

_model_long = f"""{BASE},
{_folds(1)},
t AS (SELECT f.train_end, f.test_period, c.y, m.model,
             CASE m.model WHEN 'x1' THEN c.x1 WHEN 'x2' THEN c.x2 ELSE c.x5 END AS score
      FROM clean c JOIN folds f ON c.period = f.test_period
      CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in _MODELS)}) m(model)),
{_ap_sql("t", ["model", "train_end", "test_period"])}"""

SQL["ap_summary"] = f"""{_model_long}
SELECT model, {R("avg(ap)")} AS mean_ap, {R("stddev_pop(ap)")} AS std_ap, count(*) AS n_folds
FROM ap GROUP BY model"""

SQL["ap_pivot"] = f"""{_model_long}
SELECT test_period, {", ".join(f"{R(f'max(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN ap END)')} AS {m}_ap"
                              for m in _MODELS)}
FROM ap GROUP BY test_period"""

SQL["holdout_counts"] = SQL["holdout_rows"].replace(
    "SELECT r.row_key, r.y, CASE WHEN r.rk <= k.k_test THEN 'test' ELSE 'train' END AS role\nFROM r JOIN k ON r.y = k.y",
    "SELECT CASE WHEN r.rk <= k.k_test THEN 'test' ELSE 'train' END AS role, r.y, count(*) AS n\n"
    "FROM r JOIN k ON r.y = k.y GROUP BY ALL")


def R5(expr: str) -> str:
    return R(expr, 5)


_Z = "1.959963984540054"


def _coef_select(src: str) -> str:
    return (f"SELECT term, {R5('coef')} AS coef, {R5('se')} AS std_err, {R5('coef / se')} AS z, "
            f"{R5(f'coef - {_Z} * se')} AS ci_low, {R5(f'coef + {_Z} * se')} AS ci_high FROM {src}")


_CELLS = f"""{BASE},
g AS (SELECT kind, count(*) AS n, avg(y) AS p FROM clean GROUP BY kind),
b AS (SELECT * FROM g WHERE kind = (SELECT min(kind) FROM g))"""

SQL["logit_saturated"] = f"""{_CELLS},
t AS (SELECT 'const' AS term, ln(b.p / (1 - b.p)) AS coef, sqrt(1 / (b.n * b.p * (1 - b.p))) AS se FROM b
      UNION ALL
      SELECT 'kind_' || g.kind, ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)),
             sqrt(1 / (g.n * g.p * (1 - g.p)) + 1 / (b.n * b.p * (1 - b.p)))
      FROM g, b WHERE g.kind <> b.kind)
{_coef_select("t")}"""

SQL["logit_cluster"] = f"""{_CELLS},
s AS (SELECT c.unit, c.kind, sum(c.y - g.p) AS s FROM clean c JOIN g ON c.kind = g.kind GROUP BY c.unit, c.kind),
cnt AS (SELECT count(DISTINCT unit) AS gg, count(*) AS nn, (SELECT count(*) FROM g) AS kk FROM clean),
cf AS (SELECT gg / (gg - 1.0) * (nn - 1.0) / (nn - kk) AS c FROM cnt),
d AS (SELECT kind, n * p * (1 - p) AS d FROM g),
mkk AS (SELECT kind, sum(s * s) AS m FROM s GROUP BY kind),
mkb AS (SELECT s1.kind, sum(s1.s * s2.s) AS m FROM s s1 JOIN s s2
        ON s1.unit = s2.unit AND s2.kind = (SELECT kind FROM b) GROUP BY s1.kind),
db AS (SELECT d.d AS db, mkk.m AS mbb FROM d JOIN mkk ON d.kind = mkk.kind WHERE d.kind = (SELECT kind FROM b)),
t AS (SELECT 'const' AS term, ln(b.p / (1 - b.p)) AS coef, sqrt(cf.c * db.mbb / (db.db * db.db)) AS se
      FROM b, cf, db
      UNION ALL
      SELECT 'kind_' || g.kind, ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)),
             sqrt(cf.c * (mkk.m / (d.d * d.d) + db.mbb / (db.db * db.db) - 2 * coalesce(mkb.m, 0) / (d.d * db.db)))
      FROM g JOIN d ON g.kind = d.kind JOIN mkk ON g.kind = mkk.kind
           LEFT JOIN mkb ON g.kind = mkb.kind, b, cf, db
      WHERE g.kind <> b.kind)
{_coef_select("t")}"""

SQL["probit_saturated"] = f"""{BASE}
SELECT kind, count(*) AS n, {R("avg(y)")} AS fitted_p FROM clean GROUP BY kind"""

SQL["coef_prefix_filter"] = f"""{BASE},
h AS (SELECT kind, CAST(x2 > 0.05 AS INT) AS hi, count(*) AS n, avg(y) AS p FROM clean GROUP BY ALL),
b0 AS (SELECT * FROM h WHERE hi = 0 AND kind = (SELECT min(kind) FROM h)),
b1 AS (SELECT * FROM h WHERE hi = 1 AND kind = (SELECT min(kind) FROM h)),
t AS (SELECT 'const' AS term, ln(b0.p / (1 - b0.p)) AS coef, sqrt(1 / (b0.n * b0.p * (1 - b0.p))) AS se FROM b0
      UNION ALL
      SELECT 'hi', ln(b1.p / (1 - b1.p)) - ln(b0.p / (1 - b0.p)),
             sqrt(1 / (b0.n * b0.p * (1 - b0.p)) + 1 / (b1.n * b1.p * (1 - b1.p))) FROM b0, b1)
{_coef_select("t")}"""

def _anova_long(metric: str, recursive: str = "") -> str:
    levels = "\n      UNION ALL ".join(f"SELECT '{c}' AS param, CAST({c} AS VARCHAR) AS level, {metric} AS metric FROM panel"
                                      for c in ("kind", "unit", "x3", "x2"))
    return f"""WITH {recursive}panel AS ({PANEL_SQL}),
l AS ({levels}),
st AS (SELECT param, level, count(*) AS n, avg(metric) AS mean, var_pop(metric) * count(*) AS m2
       FROM l WHERE level IS NOT NULL AND metric IS NOT NULL GROUP BY param, level)"""


_ANOVA_LONG = _anova_long("x1")

SQL["anova_f"] = f"""{_ANOVA_LONG},
st2 AS (SELECT *, sum(n) OVER (PARTITION BY param) AS nn,
               sum(n * mean) OVER (PARTITION BY param) / sum(n) OVER (PARTITION BY param) AS grand FROM st)
SELECT param, CAST(count(*) AS INT) AS k, CAST(max(nn) AS BIGINT) AS n,
       {R("CASE WHEN count(*) >= 2 THEN (sum(n * pow(mean - grand, 2)) / (count(*) - 1)) / (sum(m2) / (max(nn) - count(*))) ELSE 'NaN'::DOUBLE END", 4)} AS f_stat
FROM st2 GROUP BY param"""

SQL["level_means"] = f"""{_ANOVA_LONG}
SELECT param, level, n, {R("mean")} AS mean_metric,
       CAST(row_number() OVER (PARTITION BY param ORDER BY mean DESC, level) AS INT) AS rank
FROM st"""

_FE = f"""{BASE},
fe AS (SELECT unit, item, min(period) AS first_period FROM clean WHERE y = 1 GROUP BY unit, item)"""

SQL["first_event"] = f"{_FE} SELECT * FROM fe"

SQL["cascade_lists"] = f"""{_FE}
SELECT item, count(*) AS n_nodes,
       string_agg(CAST(first_period AS VARCHAR) || ':' || CAST(unit AS VARCHAR), ',' ORDER BY first_period, unit) AS events
FROM fe GROUP BY item"""

SQL["cascade_sample"] = f"""{_FE},
smp AS (SELECT item FROM (SELECT DISTINCT item FROM fe) ORDER BY md5(concat_ws('|', item, '1333')) LIMIT 10)
SELECT item, unit, first_period FROM fe WHERE item IN (SELECT item FROM smp)"""

# Model workflows: fitted values of the kind models are the training means of each kind.
_KIND_FOLDS = ",\n".join(_folds(h).replace("folds AS", f"folds{h} AS") for h in (1, 5, 10))


def _forecast_kind(model: str) -> str:
    keys = ["horizon", "train_end", "test_period"]
    return f"""{BASE},
{_KIND_FOLDS},
fo AS (SELECT * FROM folds1 UNION ALL SELECT * FROM folds5 UNION ALL SELECT * FROM folds10),
kp AS (SELECT kind, period, count(*) AS n, sum(y) AS s FROM clean GROUP BY ALL),
km AS (SELECT f.horizon, f.train_end, f.test_period, k.kind, round(sum(k.s) / sum(k.n), 6) AS score
       FROM fo f JOIN kp k ON k.period <= f.train_end GROUP BY f.horizon, f.train_end, f.test_period, k.kind),
t AS (SELECT km.horizon, km.train_end, km.test_period, c.y, km.score
      FROM clean c JOIN km ON c.period = km.test_period AND c.kind = km.kind),
{_ap_sql("t", keys)}
SELECT '{model}' AS model, {", ".join(keys)}, {R("ap")} AS ap, n, n_pos FROM ap"""


def _item_out_kind(model: str) -> str:
    return f"""{BASE},
ki AS (SELECT item, kind, count(*) AS n, sum(y) AS s FROM clean GROUP BY ALL),
ka AS (SELECT kind, sum(n) AS n, sum(s) AS s FROM ki GROUP BY kind),
t AS (SELECT c.item, c.y, round((ka.s - ki.s) / (ka.n - ki.n), 6) AS score
      FROM clean c JOIN ki ON c.item = ki.item AND c.kind = ki.kind JOIN ka ON c.kind = ka.kind),
{_ap_sql("t", ["item"])}
SELECT '{model}' AS model, item, {R("ap")} AS ap, n, n_pos FROM ap"""


for _m in ("logit", "tree"):
    _q = {"logit": "logit", "tree": "rf"}[_m]
    SQL[f"forecast_{_q}"] = _forecast_kind(_m)
    SQL[f"item_out_{_q}"] = _item_out_kind(_m)

_split = SQL["holdout_rows"].removeprefix(BASE + ",\n").replace("SELECT r.row_key, r.y, ", "SELECT r.row_key, r.kind, r.y, ")
SQL["holdout_kind"] = f"""{BASE},
{_split.rsplit("SELECT r.row_key", 1)[0].rstrip()},
sp AS (SELECT r.kind, r.y, CASE WHEN r.rk <= k.k_test THEN 'test' ELSE 'train' END AS role FROM r JOIN k ON r.y = k.y),
km AS (SELECT kind, round(avg(y), 6) AS score FROM sp WHERE role = 'train' GROUP BY kind),
tt AS (SELECT 0 AS g, sp.y, km.score FROM sp JOIN km ON sp.kind = km.kind WHERE role = 'test'),
{_ap_sql("tt", ["g"])},
cf AS (SELECT CAST(sum(CASE WHEN y = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
              CAST(sum(CASE WHEN y = 0 AND score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
              CAST(sum(CASE WHEN y = 1 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
              CAST(sum(CASE WHEN y = 0 AND score <= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM tt),
m AS (SELECT 'f1' AS metric, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS value FROM cf
      UNION ALL SELECT 'balanced_accuracy', (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END
                                             + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END) / 2 FROM cf
      UNION ALL SELECT 'ap', ap FROM ap
      UNION ALL SELECT 'tp', tp FROM cf UNION ALL SELECT 'fp', fp FROM cf
      UNION ALL SELECT 'fn', fn FROM cf UNION ALL SELECT 'tn', tn FROM cf)
SELECT v.model, m.metric, {R("m.value")} AS value FROM m CROSS JOIN (VALUES ('logit'), ('tree')) v(model)"""

SQL["logit_no_const"] = f"""{_CELLS},
t AS (SELECT 'kind_' || kind AS term, ln(p / (1 - p)) AS coef, sqrt(1 / (n * p * (1 - p))) AS se FROM g)
{_coef_select("t")}"""

# The normal quantile by Acklam's rational approximation (relative error 1.2e-9 for shares between
# 0.02425 and 0.97575, which the kinds' shares are).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
      -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
      -1.328068155288572e+01, 1.0)


def _horner(c: tuple, x: str) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for v in c[1:]:
        out = f"({out} * {x} + ({v!r}::DOUBLE))"
    return out


SQL["probit_coef"] = f"""{_CELLS},
q AS (SELECT kind, n, p, p - 0.5 AS d, (p - 0.5) * (p - 0.5) AS r FROM g),
z AS (SELECT kind, n, p, {_horner(_A, "r")} * d / {_horner(_B, "r")} AS z FROM q),
t AS (SELECT 'kind_' || kind AS term, z AS coef, sqrt(p * (1 - p) / n) / (exp(-z * z / 2) / sqrt(2 * pi())) AS se FROM z)
{_coef_select("t")}"""

SQL["logo_inner_folds"] = f"""{BASE},
i AS (SELECT item, CAST(dense_rank() OVER (ORDER BY item) - 1 AS INT) AS x FROM (SELECT DISTINCT item FROM clean))
SELECT h.item, o.x AS other_index,
       CAST(row_number() OVER (PARTITION BY h.item ORDER BY o.x) - 1 AS INT) AS inner_fold
FROM i h JOIN i o ON h.x <> o.x"""

# Coefficients of y ~ C(kind) + C(kind):hi - 1 are the logits of the cells and their differences.
SQL["logit_formula"] = f"""{BASE},
h AS (SELECT kind, CAST(x2 > 0.05 AS INT) AS hi, count(*) AS n, avg(y) AS p FROM clean GROUP BY ALL),
c AS (SELECT kind, hi, ln(p / (1 - p)) AS l, 1 / (n * p * (1 - p)) AS v FROM h),
t AS (SELECT 'kind_' || kind AS term, l AS coef, sqrt(v) AS se FROM c WHERE hi = 0
      UNION ALL
      SELECT 'kind_' || a.kind || ':hi', b.l - a.l, sqrt(a.v + b.v) FROM c a JOIN c b ON a.kind = b.kind AND a.hi = 0 AND b.hi = 1)
{_coef_select("t")}"""

# The F tail is an incomplete beta function; its continued fraction is walked by a recursive query.
SQL["anova_p"] = f"""{_anova_long("x4", "RECURSIVE ")},
st2 AS (SELECT *, sum(n) OVER (PARTITION BY param) AS nn,
               sum(n * mean) OVER (PARTITION BY param) / sum(n) OVER (PARTITION BY param) AS grand FROM st),
g AS (SELECT param, CAST(count(*) AS INT) AS k, CAST(max(nn) AS BIGINT) AS n,
             (sum(n * pow(mean - grand, 2)) / (count(*) - 1)) / (sum(m2) / (max(nn) - count(*))) AS f,
             CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(max(nn) - count(*) AS DOUBLE) AS d2 FROM st2 GROUP BY param),
x AS (SELECT *, d2 / (d2 + d1 * f) >= (d2 / 2 + 1) / (d2 / 2 + d1 / 2 + 2) AS swap FROM g),
ab AS (SELECT *, CASE WHEN swap THEN d1 / 2 ELSE d2 / 2 END AS a, CASE WHEN swap THEN d2 / 2 ELSE d1 / 2 END AS b,
              CASE WHEN swap THEN d1 * f / (d2 + d1 * f) ELSE d2 / (d2 + d1 * f) END AS z FROM x),
cf AS (SELECT param, a, b, z, 2 AS i, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * z / (a + 1)) AS d, 1 / (1 - (a + b) * z / (a + 1)) AS h FROM ab
       UNION ALL
       SELECT param, a, b, z, i + 1, 1 + term / c, 1 / (1 + term * d), h * (1 + term / c) / (1 + term * d)
       FROM (SELECT *, CASE WHEN i % 2 = 1 THEN -(a + i // 2) * (a + b + i // 2) * z / ((a + 2 * (i // 2)) * (a + 2 * (i // 2) + 1))
                            ELSE (i // 2) * (b - i // 2) * z / ((a + i - 1) * (a + i)) END AS term FROM cf WHERE i < 600)),
v AS (SELECT ab.*, exp(lgamma(ab.a + ab.b) - lgamma(ab.a) - lgamma(ab.b) + ab.a * ln(ab.z) + ab.b * ln(1 - ab.z)) / ab.a * cf.h AS tail
      FROM ab JOIN cf ON cf.param = ab.param AND cf.i = 600)
SELECT param, k, n, {R("f", 4)} AS f_stat, {R("CASE WHEN swap THEN 1 - tail ELSE tail END")} AS p_value FROM v"""

# A free logistic model of the kind dummies returns the weighted share of positives of each kind, and one half for
# the first kind where there is no intercept.
SQL["grid_logit_free"] = f"""{BASE},
r AS {_rank_sql("clean")},
fd AS (SELECT kind, y, CAST((rk - 1) % 10 AS INT) AS fold FROM r),
k AS (SELECT fold, kind, count(*) AS n, sum(y) AS s FROM fd GROUP BY ALL),
a AS (SELECT kind, sum(n) AS n, sum(s) AS s FROM k GROUP BY kind),
w AS (SELECT o.fold, sum(a.n - coalesce(k.n, 0)) AS n, sum(a.s - coalesce(k.s, 0)) AS s
      FROM (SELECT DISTINCT fold FROM fd) o CROSS JOIN a LEFT JOIN k ON k.fold = o.fold AND k.kind = a.kind GROUP BY o.fold),
sch AS (SELECT * FROM (VALUES ('none', 0.0), ('balanced', -1.0), {", ".join(f"('{v}', {v}.0)" for v in range(3, 11))}) t(scheme, v),
        (VALUES (true), (false)) i(intercept)),
km AS (SELECT sch.scheme, sch.intercept, w.fold, a.kind,
              CASE WHEN NOT sch.intercept AND a.kind = (SELECT min(kind) FROM a) THEN 0.5 ELSE
                   round(p1 * (a.s - coalesce(k.s, 0)) / (p1 * (a.s - coalesce(k.s, 0)) + p0 * (a.n - coalesce(k.n, 0) - a.s + coalesce(k.s, 0))), 6)
              END AS score
       FROM sch CROSS JOIN w CROSS JOIN a LEFT JOIN k ON k.fold = w.fold AND k.kind = a.kind,
            LATERAL (SELECT CASE WHEN sch.v < 0 THEN w.n / (2.0 * w.s) WHEN sch.v = 0 THEN 1.0 ELSE sch.v END AS p1,
                            CASE WHEN sch.v < 0 THEN w.n / (2.0 * (w.n - w.s)) ELSE 1.0 END AS p0) q),
t AS (SELECT km.scheme, km.intercept, km.fold, fd.y, km.score FROM fd JOIN km ON km.fold = fd.fold AND km.kind = fd.kind),
{_ap_sql("t", ["scheme", "intercept", "fold"])}
SELECT scheme, intercept, fold, {R("ap")} AS ap, n, n_pos FROM ap"""


def _stump_sql(settings) -> str:
    rows = ", ".join(f"({i}, {lam}::DOUBLE, {alpha}::DOUBLE, {child}::DOUBLE, {gamma}::DOUBLE, {spw}::DOUBLE)"
                     for i, (lam, alpha, child, gamma, spw) in enumerate(settings))

    def part(g, h):
        return f"pow(greatest(abs({g}) - alpha, 0), 2) / ({h} + lam)"

    def leaf(g, h):
        return f"1 / (1 + exp(0.3 * sign({g}) * greatest(abs({g}) - alpha, 0) / ({h} + lam)))"
    return f"""{BASE},
par AS (SELECT * FROM (VALUES {rows}) t(setting, lam, alpha, child, gamma, spw)),
k AS (SELECT setting, lam, alpha, child, gamma, kind, sum((0.5 - y) * CASE WHEN y = 1 THEN spw ELSE 1 END) AS g,
             sum(0.25 * CASE WHEN y = 1 THEN spw ELSE 1 END) AS h FROM clean CROSS JOIN par GROUP BY ALL),
a AS (SELECT *, sum(g) OVER w AS tg, sum(h) OVER w AS th, kind = min(kind) OVER w AS base FROM k WINDOW w AS (PARTITION BY setting)),
c AS (SELECT *, {part("tg - g", "th - h")} + {part("g", "h")} - {part("tg", "th")} AS gain FROM a),
b AS (SELECT setting, arg_max(kind, gain) AS best FROM c
      WHERE NOT base AND least(h, th - h) >= child AND gain > greatest(gamma, 1e-6) GROUP BY setting),
v AS (SELECT c.*, b.best, sum(CASE WHEN kind = best THEN g END) OVER w AS bg, sum(CASE WHEN kind = best THEN h END) OVER w AS bh
      FROM c LEFT JOIN b USING (setting) WINDOW w AS (PARTITION BY c.setting))
SELECT setting, kind, {R(f"CASE WHEN best IS NULL THEN {leaf('tg', 'th')} WHEN kind = best THEN {leaf('bg', 'bh')} ELSE {leaf('(tg - bg)', '(th - bh)')} END")} AS score
FROM v"""


SQL["boost_stumps"] = _stump_sql(BOOST_SETTINGS)

SQL["item_out_nested"] = f"""{BASE},
ki AS (SELECT item, kind, count(*) AS n, sum(y) AS s FROM clean GROUP BY ALL),
ka AS (SELECT kind, sum(n) AS n, sum(s) AS s FROM ki GROUP BY kind),
km AS (SELECT o.item, i.item AS inner_item, ka.kind,
              round((ka.s - coalesce(ko.s, 0) - coalesce(kk.s, 0)) / (ka.n - coalesce(ko.n, 0) - coalesce(kk.n, 0)), 6) AS score
       FROM (SELECT DISTINCT item FROM ki) o JOIN (SELECT DISTINCT item FROM ki) i ON o.item <> i.item CROSS JOIN ka
            LEFT JOIN ki ko ON ko.item = o.item AND ko.kind = ka.kind LEFT JOIN ki kk ON kk.item = i.item AND kk.kind = ka.kind),
t AS (SELECT km.item, km.inner_item, c.y, km.score FROM clean c JOIN km ON km.inner_item = c.item AND km.kind = c.kind),
{_ap_sql("t", ["item", "inner_item"])}
SELECT item, inner_item, {R("ap")} AS ap, n, n_pos FROM ap"""
