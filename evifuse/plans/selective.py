"""Selective evaluation of semantic errors: four rankings of pixels, metrics of each capture group, resampled groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.operators import selective
from evifuse.plans.evaluation import rounded
from evifuse.sources.scratch import written
from evifuse.sources.tables import PIXELS, pixels

REPLICATES, STRIDE, IGNORED = 50, 2, (0,)
RANKINGS = ("uncertainty", "abstention", "insufficiency", "disagreement")


def _ranked(spark, sf_dir):
    """Rasters as semantic masks with four rankings of the pixels of a regular grid; ignored classes are left out, frames are captures of five groups."""
    rows = pixels(spark, sf_dir).where((F.col("y") % STRIDE == 0) & (F.col("x") % STRIDE == 0))
    q, v = F.floor(F.col("v") * 8).cast("int"), F.col("v")
    truth, wrong = q % 4, (F.col("frame") * 3 + F.col("x") + F.col("y") * q) % 5 == 0
    predicted = F.when(wrong, (q + 1) % 4).otherwise(q % 4)
    scores = {
        "uncertainty": F.round(1 - F.abs(v - 0.5) * 2, 2), "abstention": F.when(wrong, 0.75).otherwise(F.round(v, 1)),
        "insufficiency": 1 - (F.col("frame") % 4) / F.lit(4.0), "disagreement": F.when(F.col("x") > 4, None).otherwise(F.round(v * 1.25 - 0.1, 2)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ranking"), s.cast("double").alias("score")) for k, s in scores.items())))
    kept = rows.where(~truth.isin(*IGNORED)).select((F.col("frame") % 5).alias("grp"), (predicted != truth).cast("int").alias("risk"), each.alias("r"))
    return kept.select("grp", "risk", "r.*")


def selective_by_group(spark, sf_dir):
    found = selective.group_metrics(_ranked(spark, sf_dir), ["ranking", "grp"])
    return rounded(found, *selective.NAMES)


def selective_bootstrap(spark, sf_dir):
    wide = written(selective.group_metrics(_ranked(spark, sf_dir), ["ranking", "grp"]), "selective-groups")
    return rounded(selective.bootstrap(wide, ["ranking"], REPLICATES, "selective"), "point", "low", "high")


RANKED = f"""{PIXELS}, q0 AS (SELECT *, CAST(floor(v * 8) AS INTEGER) AS q FROM px WHERE y % {STRIDE} = 0 AND x % {STRIDE} = 0),
q1 AS (SELECT *, q % 4 AS truth, (frame * 3 + x + y * q) % 5 = 0 AS wrong FROM q0),
q2 AS (SELECT frame % 5 AS grp, CASE WHEN wrong THEN 1e0 ELSE 0e0 END AS risk, unnest([
    {{'ranking': 'uncertainty', 'score': round(1 - abs(v - 0.5) * 2, 2)}}, {{'ranking': 'abstention', 'score': CASE WHEN wrong THEN 0.75e0 ELSE round(v, 1) END}},
    {{'ranking': 'insufficiency', 'score': 1 - (frame % 4) / 4e0}}, {{'ranking': 'disagreement', 'score': CASE WHEN x <= 4 THEN round(v * 1.25e0 - 0.1e0, 2) END}}]) AS r FROM q1 WHERE truth <> 0),
s AS (SELECT r.ranking AS ranking, grp, least(greatest(r.score, 0), 1) AS score, risk FROM q2 WHERE r.score IS NOT NULL)"""
BIN = "CASE " + " ".join(f"WHEN score < {i / 15!r} THEN {i - 1}" for i in range(1, 15)) + " ELSE 14 END"


def _curve(name: str, by: str) -> str:
    return f"""{name}0 AS (SELECT ranking, grp, {by} AS by_, count(*) AS n, sum(risk) AS risk FROM s GROUP BY 1, 2, 3),
{name} AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS kept, sum(risk) OVER w AS lost, CAST(sum(n) OVER (PARTITION BY ranking, grp) AS DOUBLE) AS total
  FROM {name}0 WINDOW w AS (PARTITION BY ranking, grp ORDER BY by_ ROWS UNBOUNDED PRECEDING))"""


AREAS = "sum(n / total * lost / kept) AS {0}aurc, sum(n / total * (lost + lost - risk) / total / 2) AS {0}augrc"
GROUPED = f"""WITH {RANKED}, {_curve('c', 'score')}, {_curve('o', 'risk')},
mean AS (SELECT ranking, grp, count(*) AS samples, avg(pow(score - risk, 2)) AS brier, avg(risk) AS mean_risk, avg(score) AS mean_score, sum(risk) AS p FROM s GROUP BY 1, 2),
bin AS (SELECT ranking, grp, {BIN} AS bin, count(*) AS n, abs(avg(score) - avg(risk)) AS gap FROM s GROUP BY 1, 2, 3),
ece AS (SELECT ranking, grp, sum(n * gap) / sum(n) AS ece FROM bin GROUP BY 1, 2),
area AS (SELECT ranking, grp, {AREAS.format('')}, sum(risk * (kept - (n - 1) / 2e0)) AS ranks,
  arg_min(lost / kept, kept) FILTER (kept / total >= 0.8) AS risk_at, arg_min(kept / total, kept) FILTER (kept / total >= 0.8) AS coverage_at FROM c GROUP BY 1, 2),
ideal AS (SELECT ranking, grp, {AREAS.format('o_')} FROM o GROUP BY 1, 2),
w AS (SELECT ranking, grp, samples, brier, ece AS expected_calibration_error, aurc AS risk_coverage_area, o_aurc AS oracle_risk_coverage_area,
  mean_risk AS random_order_expected_risk_coverage_area, aurc - o_aurc AS excess_risk_coverage_area,
  augrc AS generalized_risk_coverage_area, o_augrc AS oracle_generalized_risk_coverage_area, mean_risk / 2 AS random_order_expected_generalized_risk_coverage_area,
  augrc - o_augrc AS excess_generalized_risk_coverage_area,
  risk_at AS selective_risk_at_80_percent_requested_coverage, coverage_at AS realized_coverage_at_80_percent_requested_coverage,
  CASE WHEN p > 0 AND p < samples THEN (ranks - p * (p + 1) / 2) / (p * (samples - p)) END AS uncertainty_auroc, mean_risk AS mean_target_risk, mean_score AS mean_uncertainty
  FROM mean JOIN ece USING (ranking, grp) JOIN area USING (ranking, grp) JOIN ideal USING (ranking, grp))"""
LONG = " UNION ALL ".join(f"SELECT ranking, grp, '{n}' AS metric, {n} AS value FROM w" for n in selective.NAMES)
QUERIES = {
    "selective_by_group": (selective_by_group, GROUPED + " SELECT ranking, grp, samples, " + ", ".join(f"round({n}, 6) + 0 AS {n}" for n in selective.NAMES) + " FROM w"),
    "selective_bootstrap": (
        selective_bootstrap,
        f"""{GROUPED}, long AS ({LONG}), g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS number, count(*) OVER () AS size FROM (SELECT DISTINCT grp FROM w)),
h AS (SELECT rep, CAST('0x' || substr(sha256('selective:' || rep || ':' || draw), 1, 8) AS BIGINT) AS h FROM range({REPLICATES}) a(rep), range((SELECT count(*) FROM g)) b(draw)),
d AS (SELECT ranking, metric, rep, avg(value) AS value FROM h JOIN g ON h.h % g.size = g.number JOIN long USING (grp) GROUP BY 1, 2, 3),
e AS (SELECT ranking, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM d WHERE value IS NOT NULL GROUP BY 1, 2),
p AS (SELECT ranking, metric, count(value) AS groups, avg(value) AS point FROM long GROUP BY 1, 2 HAVING count(value) > 0)
SELECT ranking, metric, groups, round(point, 6) + 0 AS point, round(low, 6) + 0 AS low, round(high, 6) + 0 AS high FROM p LEFT JOIN e USING (ranking, metric)""",
    ),
}
