"""Registered queries on fitted models: folds, selection, transfer, leaks, calibration, boosting. The SQL fits them, too."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.functions import derive
from lapsewise.operators import experiments, fingerprint, folds, isotonic, metrics, models, panel, waves
from lapsewise.operators.boosting import BoostedTrees
from lapsewise.plans import crawl_view as V
from lapsewise.registry import BIN, EMBARGO, FOLDS, SPLIT, annotated, known, query, r, split_rows
from lapsewise.registry_operators import stored

# ---- pieces of SQL ------------------------------------------------------------------------------------------------


def ap_sql(rows: str, score: str, by: str, more: str = "") -> str:
    """Average precision (ap, null without positives) and roc of rows by score, for each by."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {keys}sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, CASE WHEN sum(p) > 0 THEN sum(p::DOUBLE / nullif(ap, 0) * cp / cn) END AS ap, sum((n - p) * (cp - p + 0.5 * p)) / nullif(max(ap) * max(an - ap), 0) AS roc{more}
FROM (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (a) AS ap, sum(n) OVER (a) AS an FROM (SELECT {keys}{score} AS s, count(*) AS n, sum(y)::BIGINT AS p FROM {rows} GROUP BY ALL) WINDOW w AS ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING), a AS ({part})) GROUP BY {by or 'ALL'})"""


def rates_sql(name: str, train: str, val: str, key: str, by: str = "") -> str:
    """CTE name: the rows of val with s, the mean of y of their key in train, the pooled mean elsewhere; by: columns that parts agree in."""
    keys = f"{by}, " if by else ""
    on = f"v.{by} = t.{by} AND " if by else ""
    pooled = f"(SELECT avg(y) FROM {train} p" + (f" WHERE p.{by} = v.{by})" if by else ")")
    return f", {name} AS (SELECT v.*, coalesce(t.r, {pooled}) AS s FROM (SELECT *, {key} AS k FROM {val}) v LEFT JOIN (SELECT {keys}k, avg(y) AS r FROM (SELECT *, {key} AS k FROM {train}) GROUP BY ALL) t ON {on}t.k = v.k)"


def bins_sql(name: str, train: str, val: str, column: str, bins: int, by: str = "") -> str:
    """The same by quantile bins of a column, whose edges train gives."""
    at = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    keys, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    out = f", {name}_e AS (SELECT {keys}list_distinct(quantile_cont({column}, {at})) AS e FROM {train} GROUP BY {by or 'ALL'})"
    for part, rows in (("t", train), ("v", val)):
        out += f", {name}_{part} AS (SELECT x.*, CASE WHEN {column} IS NULL THEN -1 ELSE len(list_filter(e, lambda q: {column} > q)) END AS bin FROM {rows} x JOIN {name}_e {on})"
    return out + rates_sql(name, f"{name}_t", f"{name}_v", "bin", by)


def logit_sql(name: str, train: str, column: str, ridge: float = 0.01, steps: int = 14) -> str:
    """CTE name (a, b, m, sd): ridge logistic regression of y on the filled and standardised column, by Newton steps."""
    out = f", {name}_st AS (SELECT med AS fill, avg(coalesce({column}, med)) AS m, CASE WHEN stddev_pop(coalesce({column}, med)) > 0 THEN stddev_pop(coalesce({column}, med)) ELSE 1 END AS sd FROM {train} CROSS JOIN (SELECT median({column}) AS med FROM {train}) GROUP BY med)"
    out += f", {name}_z AS MATERIALIZED (SELECT y::DOUBLE AS y, (coalesce({column}, fill) - m) / sd AS z FROM {train} CROSS JOIN {name}_st), {name}_0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    for k in range(steps):
        out += f", {name}_{k + 1} AS MATERIALIZED (SELECT a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (SELECT a, b, avg(p - y) AS g1, avg((p - y) * z) + {ridge} * b AS g2, avg(p * (1 - p)) AS h11, avg(p * (1 - p) * z) AS h12, avg(p * (1 - p) * z * z) + {ridge} AS h22 FROM (SELECT a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM {name}_z CROSS JOIN {name}_{k}) GROUP BY a, b))"
    return out + f", {name} AS (SELECT a, b, fill, m, sd FROM {name}_{steps} CROSS JOIN {name}_st)"


def logit_score(name: str, column: str) -> str:
    return f"1 / (1 + exp(-({name}.a + {name}.b * (coalesce({column}, {name}.fill) - {name}.m) / {name}.sd)))"


BLOCKS = SPLIT + ", tr AS (SELECT * FROM ss WHERE split = 'train'), va AS (SELECT * FROM ss WHERE split = 'val'), te AS (SELECT * FROM ss WHERE split = 'test')"
#: Training and validation rows of each fold, and what the table of folds says of them.
FOLDED = FOLDS + """, ft AS (SELECT fold, k.* FROM fo JOIN known k ON k.t <= te), fw AS (SELECT fold, k.* FROM fo JOIN known k ON k.t > te + 7 AND k.t <= vs),
fs AS (SELECT fo.fold, (SELECT count(*) FROM ft WHERE ft.fold = fo.fold) AS train_rows, (SELECT sum(y)::BIGINT FROM ft WHERE ft.fold = fo.fold) AS train_positives, (SELECT count(*) FROM fw WHERE fw.fold = fo.fold) AS val_rows, (SELECT coalesce(sum(y), 0)::BIGINT FROM fw WHERE fw.fold = fo.fold) AS val_positives FROM fo)"""


def folded_sql(candidates: dict[str, str]) -> str:
    """CTE cv (candidate, fold, sizes, ap) from CTEs named c0, c1, ... of scored validation rows."""
    each = [f"SELECT '{name}' AS candidate, fs.*, CASE WHEN train_positives > 0 AND train_positives < train_rows THEN a.ap END AS ap FROM fs LEFT JOIN {ap_sql(f'c{i}', 's', 'fold')} a ON a.fold = fs.fold" for i, name in enumerate(candidates)]
    return "".join(sql.replace("{c}", f"c{i}") for i, sql in enumerate(candidates.values())) + ", cv AS (" + " UNION ALL ".join(each) + ")"


TITLES = rates_sql("{c}", "ft", "fw", "title", "fold")
AGES = {n: bins_sql("{c}", "ft", "fw", "age_days", n, "fold") for n in (2, 5, 10)}
PRIOR = rates_sql("{c}", "ft", "fw", "0", "fold")
OLD = rates_sql("{c}", "ft", "fw", "coalesce(age_days > 30, false)", "fold")
SUMMARY = "SELECT candidate, count(*) AS folds, count(ap) AS scored, avg(ap) AS mean, stddev_samp(ap) AS sd FROM cv GROUP BY candidate"

STEPS = {
    "prior": models.Rung(0, True, lambda: models.GroupRates(F.lit(0))), "rule_old": models.Rung(1, True, lambda: models.GroupRates(derive.older_than_thirty_days(F.col("age_days")))),
    "title_rates": models.Rung(2, False, lambda: models.GroupRates(F.col("title"))), "age_bins": models.Rung(3, False, lambda: models.QuantileRates("age_days")),
}
STEPS_SQL = {"prior": PRIOR, "rule_old": OLD, "title_rates": TITLES, "age_bins": AGES[10]}


def fold_table(rows: DataFrame) -> DataFrame:
    return waves.fold_table(rows.where("label_observable"), EMBARGO)


def on_folds(s: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    rows = stored(s, known(s, d))
    return models.cross_validate(rows, fold_table(rows), EMBARGO, {n: STEPS[n].build for n in names})


# ---- folds side by side -------------------------------------------------------------------------------------------


@query("x10_cross_validated", V.sql(FOLDED + folded_sql({n: STEPS_SQL[n] for n in ("title_rates", "age_bins")}) + "SELECT candidate, fold, train_rows, train_positives, val_rows, val_positives, round(ap, 6) AS pr_auc FROM cv"))
def _(s, d):
    out = on_folds(s, d, ("title_rates", "age_bins"))
    return out.select("candidate", "fold", "train_rows", "train_positives", "val_rows", "val_positives", r("pr_auc"))


@query("x10_membership", V.sql(FOLDED + "SELECT fs.*, te::VARCHAR AS train_end, vs::VARCHAR AS val_until FROM fs JOIN fo ON fo.fold = fs.fold"))
def _(s, d):
    rows = known(s, d)
    day = lambda c: F.to_date(F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))).cast("string").alias(c)
    return folds.membership(rows, fold_table(rows), EMBARGO).select("fold", "train_rows", "train_positives", "val_rows", "val_positives", day("train_end"), day("val_until"))


ONCE = rates_sql("once0", "tr", "va", "title") + bins_sql("once1", "tr", "va", "age_days", 10)


@query("x11_compared", V.sql(FOLDED + folded_sql({n: STEPS_SQL[n] for n in ("title_rates", "age_bins")}) + BLOCKS + ONCE + f", su AS ({SUMMARY}) SELECT su.candidate, folds, scored, round(mean, 6) AS mean, round(sd, 6) AS sd, round(o.ap, 6) AS pr_auc, round(o.roc, 6) AS roc_auc FROM su JOIN (SELECT 'title_rates' AS candidate, * FROM {ap_sql('once0', 's', '')} UNION ALL SELECT 'age_bins', * FROM {ap_sql('once1', 's', '')}) o ON o.candidate = su.candidate"))
def _(s, d):
    cut = lambda x: F.lit(x).cast("timestamp")
    rows = known(s, d).withColumn("split", waves.split_column(cut("2024-01-05"), cut("2024-01-13"), EMBARGO))  # the panel is stored as it is
    out = models.compare(rows, fold_table(rows), EMBARGO, {n: STEPS[n].build for n in ("title_rates", "age_bins")})
    return out.select("candidate", "folds", "scored", r("mean"), r("sd"), r("pr_auc"), r("roc_auc"))


@query("x12_selected", V.sql(FOLDED + folded_sql(STEPS_SQL) + """
, cx AS (SELECT * FROM (VALUES ('prior', 0, true), ('rule_old', 1, true), ('title_rates', 2, false), ('age_bins', 3, false)) v(candidate, complexity, heuristic)),
us AS (SELECT cx.*, avg(ap) AS mean FROM cv JOIN cx ON cx.candidate = cv.candidate GROUP BY ALL HAVING count(ap) >= 3),
ld AS (SELECT candidate FROM us WHERE NOT heuristic ORDER BY mean DESC, complexity LIMIT 1),
pr AS (SELECT a.candidate AS a, b.candidate AS b, avg(a.ap - b.ap) AS m, coalesce(stddev_samp(a.ap - b.ap), 0) AS sd FROM cv a JOIN cv b ON a.fold = b.fold WHERE a.ap IS NOT NULL AND b.ap IS NOT NULL GROUP BY ALL),
si AS (SELECT us.candidate FROM us CROSS JOIN ld JOIN pr ON pr.a = ld.candidate AND pr.b = us.candidate WHERE NOT heuristic AND abs(m) <= sd ORDER BY complexity, us.candidate LIMIT 1),
fl AS (SELECT candidate FROM us WHERE heuristic ORDER BY mean DESC, complexity LIMIT 1)
SELECT CASE WHEN pr.m <= pr.sd THEN fl.candidate ELSE si.candidate END AS selected, CASE WHEN pr.m <= pr.sd THEN 'no model clears the best heuristic' ELSE 'simplest of those tied with the leader' END AS reason, ld.candidate AS leader FROM si CROSS JOIN ld CROSS JOIN fl JOIN pr ON pr.a = si.candidate AND pr.b = fl.candidate"""))
def _(s, d):
    found = models.chosen(on_folds(s, d, tuple(STEPS)), STEPS)
    return s.createDataFrame([(found["selected"], found["reason"], found["leader"])], "selected string, reason string, leader string")


@query("x16_board_context_folds", V.sql(", bs AS (SELECT source, run_index, count(*) AS size FROM feat GROUP BY ALL), kb AS (SELECT k.*, floor(size / 3) AS band FROM known k JOIN bs ON bs.source = k.source AND bs.run_index = k.run_index)" + FOLDED.replace("known k", "kb k") + rates_sql("c0", "ft", "fw", "band", "fold") + f", cw AS {ap_sql('c0', 's', 'fold')} SELECT fs.fold, CASE WHEN ok THEN round(ap, 6) END AS with_context, CASE WHEN ok AND val_positives > 0 THEN round(val_positives::DOUBLE / val_rows, 6) END AS context_nulled, CASE WHEN ok THEN round(ap - val_positives::DOUBLE / val_rows, 6) END AS difference FROM (SELECT *, train_positives > 0 AND train_positives < train_rows AS ok FROM fs) fs LEFT JOIN cw ON cw.fold = fs.fold"))
def _(s, d):
    rows = stored(s, panel.with_board_context(V.labelled_panel(s, d)).where("label_observable"))
    out = experiments.board_context_folds(rows, fold_table(rows), EMBARGO, lambda: models.GroupRates(F.floor(F.col("board_size_at_t") / 3)))
    return out.select("fold", r("with_context"), r("context_nulled"), r("difference"))


@query("x17_ship_without_context", V.sql(FOLDED + folded_sql({"title_rates": TITLES}) + ", nu AS (SELECT avg(b) AS m, stddev_samp(b) AS sd FROM (SELECT CASE WHEN train_positives > 0 AND train_positives < train_rows AND val_positives > 0 THEN val_positives::DOUBLE / val_rows END AS b FROM fs)), wo AS (SELECT avg(ap) AS m FROM cv) SELECT round(nu.m, 6) AS imputed, round(nu.sd, 6) AS fold_sd, round(wo.m, 6) AS without, nu.m + nu.sd < wo.m AS ships FROM nu CROSS JOIN wo"))
def _(s, d):
    """A model of board context, scored without it, against a refit on titles alone: means over the folds decide."""
    rows = stored(s, panel.with_board_context(V.labelled_panel(s, d)).where("label_observable"))
    table = fold_table(rows)
    nulled = experiments.board_context_folds(rows, table, EMBARGO, lambda: models.GroupRates(F.floor(F.col("board_size_at_t") / 3)))
    imputed = nulled.agg(F.avg("context_nulled").alias("m"), F.stddev_samp("context_nulled").alias("sd")).first()
    without = metrics.fold_summary(models.cross_validate(rows, table, EMBARGO, {"titles": STEPS["title_rates"].build})).first()["mean"]
    ships = experiments.ship_without_context(imputed["m"], imputed["sd"], without)
    return s.createDataFrame([(imputed["m"], imputed["sd"], without, ships)], "m double, sd double, w double, ships boolean").select(r("m", name="imputed"), r("sd", name="fold_sd"), r("w", name="without"), "ships")


@query("x18_tuned", V.sql(FOLDED + folded_sql({f"bins {n}": AGES[n] for n in (2, 5, 10)}) + f", su AS ({SUMMARY}) SELECT candidate AS setting, folds, scored, round(mean, 6) AS mean, round(sd, 6) AS sd FROM su"))
def _(s, d):
    rows = stored(s, known(s, d))
    grid = {f"bins {n}": lambda n=n: models.QuantileRates("age_days", n) for n in (2, 5, 10)}
    return experiments.tune(rows, fold_table(rows), EMBARGO, grid).select("setting", "folds", "scored", r("mean"), r("sd"))


# ---- one split ----------------------------------------------------------------------------------------------------

AGE_LOGIT = logit_sql("lo", "tr", "age_days")


@query("x13_both_blocks", V.sql(BLOCKS + AGE_LOGIT + f", sc AS (SELECT ss.*, {logit_score('lo', 'age_days')} AS s FROM ss CROSS JOIN lo WHERE split IN ('train', 'val')), rk AS {ap_sql('(SELECT split, y, round(s, 12) AS s FROM sc)', 's', 'split')}, br AS (SELECT split, avg(pow(s - y, 2)) AS brier FROM sc GROUP BY split) SELECT rk.split, n, positives, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(brier, 6) AS brier, round((SELECT ap FROM rk WHERE split = 'train') - (SELECT ap FROM rk WHERE split = 'val'), 6) AS gap FROM rk JOIN br ON br.split = rk.split"))
def _(s, d):
    out = models.fit_and_score(stored(s, split_rows(s, d)), models.pipeline(["age_days"], [], models.logistic()))
    return out.select("split", "n", "positives", r("pr_auc"), r("roc_auc"), r("brier"), r("gap"))


@query("x15_sweep", V.sql(BLOCKS + "".join(bins_sql(f"s{b}{n}", "tr", rows, "age_days", n) for n in (2, 10) for b, rows in (("t", "tr"), ("v", "va"))) + " UNION ALL ".join(f" SELECT 'bins {n}' AS setting, round(a.ap, 6) AS train_pr_auc, round(b.ap, 6) AS val_pr_auc, round(a.ap - b.ap, 6) AS gap FROM {ap_sql(f'st{n}', 's', '')} a CROSS JOIN {ap_sql(f'sv{n}', 's', '')} b" for n in (2, 10))))
def _(s, d):
    out = models.sweep(stored(s, split_rows(s, d)), {f"bins {n}": lambda n=n: models.QuantileRates("age_days", n) for n in (2, 10)})
    return out.select("setting", r("train_pr_auc"), r("val_pr_auc"), r("gap"))


LADDER = {
    "prior": rates_sql("l_prior", "tr", "va", "0"), "rule_old": rates_sql("l_rule_old", "tr", "va", "coalesce(age_days > 30, false)"), "rule_fresh": rates_sql("l_rule_fresh", "tr", "va", "coalesce(age_days <= 7, false)"),
    "age_ceiling": bins_sql("l_age_ceiling", "tr", "va", "age_days", 10), "board_hazard": rates_sql("l_board_hazard", "tr", "va", "source"),
    "age_logistic": AGE_LOGIT + f", l_age_logistic AS (SELECT va.*, round({logit_score('lo', 'age_days')}, 12) AS s FROM va CROSS JOIN lo)",
}


@query("x8_ladder", V.sql(BLOCKS + "".join(LADDER.values()) + " UNION ALL ".join(f" SELECT '{n}' AS rung, n, positives, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc FROM {ap_sql(f'l_{n}', 's', '')}" for n in LADDER)))
def _(s, d):
    """The rungs that SQL can fit."""
    steps = models.rungs(["age_days"], ["title"])
    return models.ladder(stored(s, split_rows(s, d)), {n: steps[n] for n in LADDER}).select("rung", "n", "positives", r("pr_auc"), r("roc_auc"))


@query("x8_logistic_ladder")
def _(s, d):
    """All ten rungs."""
    return models.ladder(stored(s, split_rows(s, d)), models.rungs(["age_days"], ["title", "company"], trees=20, rounds=5)).select("rung", "n", "positives", r("pr_auc"), r("roc_auc"))


# ---- boosted trees ------------------------------------------------------------------------------------------------

BOOSTED = {"rounds": 3, "depth": 2, "rate": 0.3, "subsample": 0.8, "columns": 0.6, "bins": 8}
BOOSTED_ON = (["age_days"], ["title", "company"])


def boosted_sql(least: float = 1.0, l2: float = 1.0, unit: int = 1 << 20) -> str:
    """CTE bm: all rows of ss with the margin that the trees give, grown from histograms as the operator states them."""
    names = [c for part in BOOSTED_ON for c in part]
    out = f""", aq AS (SELECT age_days AS v, sum(count(*)) OVER (ORDER BY age_days) AS cum, sum(count(*)) OVER () AS n FROM tr GROUP BY age_days), ae AS (SELECT list(DISTINCT v ORDER BY v) AS e FROM (SELECT k.range, min(v) AS v FROM aq JOIN range(1, {BOOSTED['bins']}) k ON cum >= ceil(k.range * n / {BOOSTED['bins']}.0) GROUP BY k.range))"""
    for c in BOOSTED_ON[1]:
        out += f", lv_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS b FROM tr GROUP BY {c} HAVING count(*) >= 5 QUALIFY b < {BOOSTED['bins']})"
    up = "((SELECT count(*) FROM tr WHERE y = 0)::DOUBLE / (SELECT count(*) FROM tr WHERE y = 1))"
    base = f"ln({up} * (SELECT sum(y) FROM tr) / (SELECT count(*) - sum(y) FROM tr))"
    joins = " ".join(f"LEFT JOIN lv_{c} ON lv_{c}.v = ss.{c}" for c in BOOSTED_ON[1])
    out += f", m0 AS MATERIALIZED (SELECT ss.source, ss.source_id, ss.run_index, split, y::DOUBLE AS y, CASE WHEN y > 0 THEN {up} ELSE 1.0 END AS w, ss.source || '|' || ss.source_id || '|' || ss.run_index AS id, len(list_filter(e, lambda q: age_days > q)) AS b0, " + ", ".join(f"coalesce(lv_{c}.b, -1) AS b{i + 1}" for i, c in enumerate(BOOSTED_ON[1])) + f", {base} AS margin FROM ss CROSS JOIN ae {joins})"
    for k in range(BOOSTED["rounds"]):
        may = sorted(sorted(range(len(names)), key=lambda f: hashlib.md5(f"columns|0|{k}|{names[f]}".encode()).hexdigest())[: math.ceil(BOOSTED["columns"] * len(names))])
        g = f"t{k}"
        out += f", {g}g0 AS MATERIALIZED (SELECT *, floor(w * (p - y) * {unit} + 0.5)::BIGINT AS g, floor(w * p * (1 - p) * {unit} + 0.5)::BIGINT AS h, split = 'train' AND ('0x' || substr(md5('rows|0|{k}|' || id), 1, 8))::BIGINT / 4294967296.0 < {BOOSTED['subsample']} AS drawn, 1 AS node FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{k}))"
        for level in range(BOOSTED["depth"]):
            at = f"{g}g{level}"
            hist = " UNION ALL ".join(f"SELECT node, {f} AS f, b{f} AS b, sum(g) AS g, sum(h) AS h FROM {at} WHERE drawn GROUP BY node, b{f}" for f in may)
            out += f", {at}h AS (SELECT *, sum(g) OVER (PARTITION BY node, f) / {unit}.0 AS ag, sum(h) OVER (PARTITION BY node, f) / {unit}.0 AS ah, CASE WHEN f = 0 THEN sum(g) OVER o ELSE g END / {unit}.0 AS lg, CASE WHEN f = 0 THEN sum(h) OVER o ELSE h END / {unit}.0 AS lh FROM ({hist}) WINDOW o AS (PARTITION BY node, f ORDER BY b))"
            out += f", {at}s AS MATERIALIZED (SELECT node AS nd, f, b FROM (SELECT *, round(lg * lg / (lh + {l2}) + (ag - lg) * (ag - lg) / (ah - lh + {l2}) - ag * ag / (ah + {l2}), 9) AS gain FROM {at}h WHERE b >= 0 AND lh >= {least} AND ah - lh >= {least}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1)"
            left = "CASE f " + " ".join(f"WHEN {f} THEN b{f} {'<=' if f == 0 else '='} b" for f in may) + " END"
            out += f", {g}g{level + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node), CASE WHEN nd IS NULL THEN node WHEN {left} THEN 2 * node ELSE 2 * node + 1 END AS node FROM {at} x LEFT JOIN {at}s ON nd = node)"
        last = f"{g}g{BOOSTED['depth']}"
        out += f", m{k + 1} AS MATERIALIZED (SELECT source, source_id, run_index, split, y, w, id, b0, b1, b2, margin + v AS margin FROM {last} JOIN (SELECT node, -{BOOSTED['rate']} * (coalesce(sum(g) FILTER (drawn), 0) / {unit}.0) / (coalesce(sum(h) FILTER (drawn), 0) / {unit}.0 + {l2}) AS v FROM {last} GROUP BY node) USING (node))"
    return out + f", bm AS (SELECT * FROM m{BOOSTED['rounds']})"


@query("x9_boosted", V.sql(BLOCKS + boosted_sql() + "SELECT source, source_id, run_index, round(1 / (1 + exp(-margin)), 6) AS score FROM bm WHERE split = 'val'"))
def _(s, d):
    rows = stored(s, split_rows(s, d))
    model = models.Pipeline(stages=[BoostedTrees(*BOOSTED_ON, key=("source", "source_id", "run_index"), **BOOSTED)]).fit(rows.where("split = 'train'"))
    return models.predict(model, rows.where("split = 'val'")).select("source", "source_id", "run_index", r("score"))


# ---- transfer -----------------------------------------------------------------------------------------------------


#: Positives that a board needs to be measured: fewer than by default, as the boards of small tables have few.
TRANSFER_LEAST = 2


def transfer_sql(key: str) -> str:
    """CTE lb (board, eval_rows, eval_positives, train_share, transfer, ceiling): every board left out of its own fit."""
    return f""", tk AS (SELECT source, {key} AS k, y FROM tr), vk AS (SELECT source, {key} AS k, y FROM va),
vs_ AS (SELECT source, y, coalesce((SELECT avg(y) FROM tk WHERE tk.source <> vk.source AND tk.k IS NOT DISTINCT FROM vk.k), (SELECT avg(y) FROM tk WHERE tk.source <> vk.source)) AS a, coalesce((SELECT avg(y) FROM tk WHERE tk.k IS NOT DISTINCT FROM vk.k), (SELECT avg(y) FROM tk)) AS b FROM vk),
bo_ AS (SELECT source AS board, count(*) FILTER (split = 'val') AS eval_rows, count(*) FILTER (split = 'val' AND y = 1) AS eval_positives, count(*) FILTER (split = 'train') AS tn, 1 - count(*) FILTER (split = 'train' AND y = 1)::DOUBLE / (SELECT sum(y) FROM tr) AS train_share FROM ss GROUP BY source),
lb AS (SELECT board, eval_rows, eval_positives, train_share, CASE WHEN ok THEN a.ap END AS transfer, CASE WHEN ok THEN b.ap END AS ceiling FROM (SELECT *, eval_positives >= {TRANSFER_LEAST} AND train_share >= 0.6 AND eval_rows > 0 AND tn > 0 AS ok FROM bo_) o LEFT JOIN {ap_sql('vs_', 'a', 'source')} a ON a.source = board LEFT JOIN {ap_sql('vs_', 'b', 'source')} b ON b.source = board)"""


def old_or_new() -> F.Column:
    return derive.older_than_thirty_days(F.col("age_days"))


for _name, _key, _by in (("title", "title", lambda: F.col("title")), ("rule", "coalesce(age_days > 30, false)", old_or_new)):

    @query(f"x21_transfer_{_name}", V.sql(BLOCKS + transfer_sql(_key) + "SELECT board, eval_rows, eval_positives, round(train_share, 6) AS train_share, round(transfer, 6) AS transfer_pr_auc, round(ceiling, 6) AS ceiling_pr_auc FROM lb"))
    def _(s, d, by=_by):
        out = models.group_rates_transfer(stored(s, split_rows(s, d)), "source", by(), TRANSFER_LEAST)
        return out.select("board", "eval_rows", "eval_positives", r("train_share"), r("transfer_pr_auc"), r("ceiling_pr_auc"))


@query("x21_transfer")
def _(s, d):
    """A fitted pipeline for each board, side by side."""
    out = models.leave_one_group_out(stored(s, split_rows(s, d)), "source", lambda: models.pipeline(["age_days"], ["title"], models.logistic()), TRANSFER_LEAST)
    return out.select("board", "eval_rows", "eval_positives", r("train_share"), r("transfer_pr_auc"), r("ceiling_pr_auc"))


@query("x22_transfer_assessed", V.sql(BLOCKS + transfer_sql("title") + ", z AS (SELECT count(*) AS boards, avg(ceiling - transfer) AS g, stddev_samp(ceiling - transfer) AS sd, avg(transfer - eval_positives::DOUBLE / eval_rows) AS l FROM lb WHERE transfer IS NOT NULL) SELECT boards, round(g, 6) AS mean_gap, round(sd, 6) AS sd_gap, round(l, 6) AS mean_lift, CASE WHEN boards < 2 THEN 'unmeasured' WHEN l <= 0 THEN 'collapsed' WHEN abs(g) <= sd THEN 'intact' WHEN g > 0 THEN 'board-specific' ELSE 'reversed' END AS status FROM z"))
def _(s, d):
    found = models.group_rates_transfer(stored(s, split_rows(s, d)), "source", F.col("title"), TRANSFER_LEAST)
    return models.assess_transfer(found).select("boards", r("mean_gap"), r("sd_gap"), r("mean_lift"), "status")


# ---- runs, replay, leak -------------------------------------------------------------------------------------------

HONEST = experiments.RunSpec("age", "bins", ("age_days",), parameters=(("bins", 10.0),))
PROBED = BLOCKS.replace("ss AS (SELECT *,", "ss AS (SELECT *, count(*) OVER pw AS n_observations_total,").replace("FROM sp WHERE split <> 'embargo')", "FROM sp WHERE split <> 'embargo' WINDOW pw AS (PARTITION BY source, source_id))")
LEAKS = PROBED + bins_sql("hon", "tr", "va", "age_days", 10) + bins_sql("lea", "tr", "va", "n_observations_total", 10) + f", ha AS {ap_sql('hon', 's', '')}, la AS {ap_sql('lea', 's', '')}"


@query("x20_leak_delta", V.sql(LEAKS + " SELECT round(ha.ap, 6) AS honest, round(la.ap, 6) AS leaked, round(ha.ap, 6) AS after_removal, round(la.ap - ha.ap, 6) AS inflation, round(la.ap - ha.ap, 6) AS restored FROM ha CROSS JOIN la"))
def _(s, d):
    runs = experiments.execute(stored(s, split_rows(s, d)), experiments.leak_specs(HONEST))
    return experiments.leak_delta(runs).select(*[r(c) for c in ("honest", "leaked", "after_removal", "inflation", "restored")])


@query("x19_replayed", V.sql(LEAKS + " SELECT run, true AS same_data, round(ap, 6) AS pr_auc, round(ap, 6) AS replayed_pr_auc, true AS replayed FROM (SELECT 'age' AS run, ap FROM ha UNION ALL SELECT 'age leaked', ap FROM la UNION ALL SELECT 'age removed', ap FROM ha)"))
def _(s, d):
    rows = stored(s, split_rows(s, d))
    recorded = experiments.execute(rows, experiments.leak_specs(HONEST))
    return experiments.replay(rows, recorded).select("run", "same_data", r("pr_auc"), r("replayed_pr_auc"), "replayed")


# ---- calibration and the frozen evaluation ------------------------------------------------------------------------

ISO = """, dv AS (SELECT score, count(*) AS n, sum(y)::BIGINT AS p, row_number() OVER (ORDER BY score) AS i FROM va GROUP BY score),
cs AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(p) OVER (ORDER BY i) AS cp FROM dv),
ab AS (SELECT a.i AS a, b.i AS b, (b.cp - a.cp + a.p)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM cs a JOIN cs b ON b.i >= a.i),
lowest AS (SELECT c.i, ab.a, min(m) AS m FROM cs c JOIN ab ON ab.a <= c.i AND ab.b >= c.i GROUP BY c.i, ab.a),
iso AS (SELECT dv.score, max(m) AS v FROM lowest JOIN dv USING (i) GROUP BY dv.score)"""
NEEDED = f", ec AS (SELECT sum(abs(p - o) * n) / sum(n) AS ece FROM (SELECT {BIN} AS bin, count(*) AS n, avg(score) AS p, avg(y) AS o FROM va GROUP BY 1)), nd AS (SELECT sum(y) >= 30 AND (SELECT ece FROM ec) > 0.25 * avg(y) AS needed FROM va)"


@query("x24_recalibrated", V.sql(BLOCKS + ISO + NEEDED + """, tv AS (SELECT t.*, (SELECT max(score) FROM iso WHERE iso.score <= t.score) AS l, (SELECT min(score) FROM iso WHERE iso.score >= t.score) AS h FROM te t),
ca AS (SELECT tv.*, CASE WHEN l IS NULL THEN b.v WHEN h IS NULL OR h = l THEN a.v ELSE a.v + (b.v - a.v) * (tv.score - l) / (h - l) END AS c FROM tv LEFT JOIN iso a ON a.score = l LEFT JOIN iso b ON b.score = h)
SELECT source, source_id, run_index, round(c, 6) AS calibrated, needed, round(CASE WHEN needed THEN c ELSE score END, 6) AS served FROM ca CROSS JOIN nd"""))
def _(s, d):
    rows = stored(s, split_rows(s, d))
    val, test = rows.where("split = 'val'"), rows.where("split = 'test'")
    served, needed = models.recalibrated_if_needed(val, models.recalibrate(val, test).withColumnRenamed("calibrated", "c"))
    return served.select("source", "source_id", "run_index", r("c", name="calibrated"), F.lit(needed).alias("needed"), r("calibrated", name="served"))


@query("x24_blocks", V.sql(BLOCKS + ISO + "SELECT min(score) AS lo, max(score) AS hi, round(v, 9) AS value FROM iso GROUP BY round(v, 9)"))
def _(s, d):
    return isotonic.fit(split_rows(s, d).where("split = 'val'")).select("lo", "hi", r("value", 9))


FROZEN = BLOCKS.replace("ss AS (SELECT *,", "ss AS (SELECT sp.*, (SELECT any_value(cohort) FROM kc c WHERE c.source = sp.source AND c.source_id = sp.source_id) AS cohort, (SELECT min(x.run_index) FROM feat x WHERE x.source = sp.source AND x.source_id = sp.source_id) = sp.run_index AS first_observation,") + logit_sql("lo", "(SELECT * FROM ss WHERE split IN ('train', 'val'))", "age_days") + f"""
, vs_ AS (SELECT va.*, round({logit_score('lo', 'age_days')}, 12) AS s FROM va CROSS JOIN lo), ts AS (SELECT te.*, round({logit_score('lo', 'age_days')}, 12) AS s FROM te CROSS JOIN lo),
vc AS (SELECT s, sum(count(*)) OVER (ORDER BY s DESC) AS cn FROM vs_ GROUP BY s), th AS (SELECT max(s) AS t FROM vc WHERE cn >= least((SELECT count(*) FROM va), 20)) """


def frozen(s: SparkSession, d: str) -> experiments.Frozen:
    cohorts = annotated(s, d).select("source", "source_id", "run_index", "cohort", "first_observation")
    rows = stored(s, split_rows(s, d).join(cohorts, ["source", "source_id", "run_index"]))
    # digits that any order of summing agrees in
    build = lambda: models.pipeline(["age_days"], [], models.Rounded(models.logistic(), 12))
    return experiments.freeze(rows, build, resamples=20, blocks=("train", "val"), recalibrate=False)


@query("x26_frozen", V.sql(FROZEN + "SELECT round(th.t, 6) AS threshold, count(*) FILTER (s >= th.t AND y = 1) AS tp, count(*) FILTER (s >= th.t AND y = 0) AS fp, count(*) FILTER (s < th.t AND y = 1) AS fn, count(*) FILTER (s < th.t AND y = 0) AS tn FROM ts CROSS JOIN th GROUP BY th.t"))
def _(s, d):
    f = frozen(s, d)
    return f.overall.withColumn("threshold", F.lit(f.threshold)).select(r("threshold"), "tp", "fp", "fn", "tn")


@query("x26_slices", V.sql(FROZEN + ", sl AS (SELECT 'carry_over' AS slice, sit::VARCHAR AS value, y, s FROM ts UNION ALL SELECT 'cohort', cohort, y, s FROM ts UNION ALL SELECT 'first_observation', first_observation::VARCHAR, y, s FROM ts), kl AS (SELECT slice || '/' || value AS k, y, s FROM sl), hits AS (SELECT k, count(*) FILTER (y = 1 AND s >= t) AS tp, count(*) FILTER (y = 0 AND s >= t) AS fp FROM kl CROSS JOIN th GROUP BY k)" + f" SELECT split_part(a.k, '/', 1) AS slice, split_part(a.k, '/', 2) AS value, n, positives, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, tp, fp FROM {ap_sql('kl', 's', 'k')} a JOIN hits ON hits.k = a.k"))
def _(s, d):
    return frozen(s, d).slices.select("slice", "value", "n", "positives", r("pr_auc"), r("roc_auc"), "tp", "fp")


# ---- fingerprint of boards ----------------------------------------------------------------------------------------

PRINT_ON = (["age_days"], ["title", "company", "location", "requisition_id"])
PRINT_SQL = BLOCKS + """, aq AS (SELECT age_days AS v, sum(count(*)) OVER (ORDER BY age_days) AS cum, sum(count(*)) OVER () AS n FROM tr GROUP BY age_days), ae AS (SELECT list(DISTINCT v ORDER BY v) AS e FROM (SELECT k.range, min(v) AS v FROM aq JOIN range(1, 8) k ON cum >= ceil(k.range * n / 8.0) GROUP BY k.range)),
br AS (SELECT row_number() OVER () AS r, ss.* FROM ss),
ln_ AS (SELECT r, split, source AS board, f.f AS feature, CASE f.f WHEN 'age_days' THEN coalesce('b' || len(list_filter(e, lambda q: age_days > q)), 'null') WHEN 'title' THEN coalesce('v' || title, 'null') WHEN 'company' THEN coalesce('v' || company, 'null') WHEN 'location' THEN coalesce('v' || location, 'null') ELSE coalesce('v' || requisition_id, 'null') END AS bin FROM br CROSS JOIN ae CROSS JOIN (SELECT unnest(['age_days', 'title', 'company', 'location', 'requisition_id']) AS f) f),
ct AS (SELECT feature, bin, board, count(*) AS n FROM ln_ WHERE split = 'train' GROUP BY ALL), nb AS (SELECT source AS board, count(*)::DOUBLE AS n FROM tr GROUP BY source), kf AS (SELECT feature, count(DISTINCT bin) AS k FROM ct GROUP BY feature),
mk AS (SELECT feature, bin = 'null' AS isn, board, sum(n) AS n FROM ct GROUP BY ALL),
wt AS (SELECT l.r, l.board AS actual, l.feature, nb.board, ln((coalesce(ct.n, 0) + 1.0) / (nb.n + k)) AS w, ln((coalesce(mk.n, 0) + 1.0) / (nb.n + 2)) AS m FROM ln_ l JOIN kf ON kf.feature = l.feature CROSS JOIN nb LEFT JOIN ct ON ct.feature = l.feature AND ct.bin = l.bin AND ct.board = nb.board LEFT JOIN mk ON mk.feature = l.feature AND mk.isn = (l.bin = 'null') AND mk.board = nb.board WHERE l.split = 'val'),
sm AS (SELECT r, actual, wt.board, sum(w) + ln(max(nb.n) / (SELECT sum(n) FROM nb)) AS s, sum(m) + ln(max(nb.n) / (SELECT sum(n) FROM nb)) AS ms FROM wt JOIN nb ON nb.board = wt.board GROUP BY r, actual, wt.board),
vr AS (SELECT 'all' AS variant, r, actual, board, s FROM sm UNION ALL SELECT 'without board context', r, actual, board, s FROM sm UNION ALL SELECT 'nulls alone', r, actual, board, ms FROM sm UNION ALL SELECT 'without ' || feature, wt.r, wt.actual, wt.board, s - w FROM wt JOIN sm ON sm.r = wt.r AND sm.board = wt.board),
pd AS (SELECT variant, r, actual, board AS predicted FROM vr QUALIFY row_number() OVER (PARTITION BY variant, r ORDER BY round(s, 9) DESC, board) = 1) """


def class_sql(rows: str, key: str) -> str:
    return f"(SELECT {key}, (SELECT avg((actual = predicted)::INT) FROM {rows} x WHERE x.{key} = l.{key}) AS accuracy, avg(coalesce(2.0 * (SELECT count(*) FROM {rows} x WHERE x.{key} = l.{key} AND actual = l.c AND predicted = l.c) / nullif((SELECT count(*) FROM {rows} x WHERE x.{key} = l.{key} AND actual = l.c) + (SELECT count(*) FROM {rows} x WHERE x.{key} = l.{key} AND predicted = l.c), 0), 0)) AS macro_f1, (SELECT count(*) FROM {rows} x WHERE x.{key} = l.{key}) AS rows FROM (SELECT {key}, actual AS c FROM {rows} UNION SELECT {key}, predicted FROM {rows}) l GROUP BY {key})"


def boards_print(s: SparkSession, d: str) -> fingerprint.Fingerprint:
    rows = stored(s, split_rows(s, d))
    return fingerprint.fingerprint(rows.where("split = 'train'"), rows.where("split = 'val'"), *PRINT_ON, bins=8)


@query("x25_scores", V.sql(PRINT_SQL + f"SELECT variant, rows, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM {class_sql('pd', 'variant')} WHERE variant IN ('all', 'without board context', 'nulls alone')"))
def _(s, d):
    return boards_print(s, d).scores.select("variant", "rows", r("accuracy"), r("macro_f1"))


@query("x25_stumps", V.sql(PRINT_SQL + f", al AS (SELECT feature, bin, board AS predicted FROM ct QUALIFY row_number() OVER (PARTITION BY feature, bin ORDER BY n DESC, board) = 1), st AS (SELECT l.feature, l.board AS actual, coalesce(al.predicted, (SELECT board FROM nb ORDER BY n DESC, board LIMIT 1)) AS predicted FROM ln_ l LEFT JOIN al ON al.feature = l.feature AND al.bin = l.bin WHERE split = 'val') SELECT feature, rows, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM {class_sql('st', 'feature')}"))
def _(s, d):
    return boards_print(s, d).stumps.select("feature", "rows", r("accuracy"), r("macro_f1"))


@query("x25_drop_one", V.sql(PRINT_SQL + ", a AS (SELECT variant, avg((actual = predicted)::INT) AS acc FROM pd GROUP BY variant) SELECT variant[9:] AS removed, round(acc, 6) AS accuracy_without, round((SELECT acc FROM a WHERE variant = 'all') - acc, 6) AS drop FROM a WHERE variant LIKE 'without %' AND variant <> 'without board context'"))
def _(s, d):
    return boards_print(s, d).drop_one.select("removed", r("accuracy_without"), r("drop"))


@query("x25_confusion", V.sql(PRINT_SQL + "SELECT actual, predicted, count(*) AS n FROM pd WHERE variant = 'all' GROUP BY ALL"))
def _(s, d):
    return boards_print(s, d).confusion


@query("x25_recall", V.sql(PRINT_SQL + "SELECT actual AS board, count(*) AS rows, round(avg((actual = predicted)::INT), 6) AS recall FROM pd WHERE variant = 'all' GROUP BY actual"))
def _(s, d):
    return boards_print(s, d).recall.select("board", "rows", r("recall"))
