"""Judging runs: gates, outcomes, blame, reports and regression against a frozen table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c
from .ordered import running_sums

RANKS = {
    "accepted_wrong": -20, "error": -10, "refused": 0, "refused_floor1": 0, "refused_floor2": 0, "pose_wrong_gated": 0,
    "pose_correct_gated": 1, "accepted_unverified": 2, "pose_gated_unverified": 1, "accepted_correct": 3,
}
CONFIG_KEYS = tuple(
    "cell_px correct_m encoder manual_tol_frac matcher matcher_max_side max_ellipse_m max_fine_window_px min_inliers min_photometric overlap pca_dim photometric radius_km ransac_px scale_iters top_k".split()
)
THRESHOLDS = {"ncc": 0.12, "dino": 0.35}


def tolerance(truth_source="truth_source", footprint_m="footprint_m", correct_m: float = 50.0, fraction: float = 0.25) -> Column:
    """A hand-set truth is only as good as a share of the footprint."""
    return F.when(_c(truth_source) == "manual", F.greatest(F.lit(correct_m), fraction * _c(footprint_m))).otherwise(F.lit(correct_m))


def confidence(*scores: Column) -> Column:
    """Geometric mean of scores clipped to [1e-6, 1]; a null score takes no part."""
    logs = [F.when(s.isNotNull(), F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), s)))) for s in scores]
    return F.exp(sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0)) / sum((x.isNotNull().cast("int") for x in logs), F.lit(0)))


def passes_gate(*, ellipse_m, n_inliers, bar, measure, threshold, max_ellipse_m: float = 3.0) -> Column:
    """A finite, small enough ellipse, inliers enough, and the measure, where there is one, above its threshold."""
    finite = F.coalesce(~F.isnan(_c(ellipse_m)) & (_c(ellipse_m) <= max_ellipse_m), F.lit(False))
    return finite & F.coalesce(_c(n_inliers) >= _c(bar), F.lit(False)) & (_c(measure).isNull() | F.coalesce(_c(measure) >= _c(threshold), F.lit(False)))


def failed_gate(*, n_inliers, bar, measure, threshold, ellipse_m, max_ellipse_m: float = 3.0) -> Column:
    """The conditions that failed, comma-separated, held against the row's own bar."""
    parts = F.array_compact(
        F.array(
            F.when(_c(n_inliers) < _c(bar), "inliers"), F.when(_c(measure) < _c(threshold), "measure"), F.when(_c(ellipse_m) > max_ellipse_m, "ellipse")
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("gate")


def blame(*, status="status", accepted="accepted", rank="true_cell_rank", error_m="error_m", tolerance_m, gate, top_k: int = 15) -> Column:
    """Whose fault a result is: of retrieval (floor 1), of pose (floor 2), of the gate, or nobody's."""
    right = _c(error_m) <= _c(tolerance_m)
    no_pose = F.when(_c(rank) > top_k, "floor 1").when(_c(rank).isNotNull(), "floor 2").otherwise("no pose")
    taken = F.when(_c(error_m).isNull(), "accepted, no truth").when(right, "ok").otherwise("FALSE")
    held = F.when(_c(error_m).isNull(), F.concat(F.lit("pose held: "), gate)).when(right, F.concat(F.lit("gate held a CORRECT one: "), gate)).otherwise(F.concat(F.lit("gate held a wrong one: "), gate))
    return F.when(~_c(status).isin("localized", "low_confidence"), no_pose).when(_c(accepted) == 1, taken).otherwise(held)


def outcome(*, status="status", accepted="accepted", correct="correct", blame="blame") -> Column:
    """One of ten classes; robust where metres and inliers are not."""
    yes, right = _c(accepted) == 1, _c(correct) == 1
    refused = F.when(_c(blame).startswith("floor 1"), "refused_floor1").when(_c(blame).startswith("floor 2"), "refused_floor2").otherwise("refused")
    unknown = F.when(yes, "accepted_unverified").otherwise("pose_gated_unverified")
    known = F.when(yes & right, "accepted_correct").when(yes, "accepted_wrong").when(right, "pose_correct_gated").otherwise("pose_wrong_gated")
    return (
        F.when(F.trim(_c(status)) == "error", "error").when(F.trim(_c(status)).isin("localized", "low_confidence"), F.when(_c(correct).isNull(), unknown).otherwise(known)).otherwise(refused)
    )


def outcome_rank(o) -> Column:
    out = F.when(_c(o).isNull(), None)
    for name, rank in RANKS.items():
        out = out.when(_c(o) == name, rank)
    return out.otherwise(0)


def drift(*, was_m, now_m, outcome_, slack_frac: float = 0.5, slack_m: float = 10.0) -> Column:
    """'worse', 'better' or '' for an unchanged class; silent for wrong places and missing errors."""
    w, n = _c(was_m), _c(now_m)
    skip = w.isNull() | n.isNull() | _c(outcome_).isin("pose_wrong_gated", "accepted_wrong")
    return F.when(skip, "").when(n > F.greatest(w + slack_m, w * (1 + slack_frac)), "worse").when((n + slack_m < w) & (n * (1 + slack_frac) < w), "better").otherwise("")


def compare(run: DataFrame, golden: DataFrame) -> DataFrame:
    """(case, was, now, severity), by case, of a full outer join of (case, outcome, error_m); an accepted wrong place is always a regression."""
    a, b = run.select("case", F.col("outcome").alias("now"), F.col("error_m").alias("now_m")), golden.select("case", F.col("outcome").alias("was"), F.col("error_m").alias("was_m"))
    j = a.join(b, "case", "full_outer")
    d = drift(was_m="was_m", now_m="now_m", outcome_="was")
    severity = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") == "accepted_wrong", "regression")
        .when(outcome_rank("now") < outcome_rank("was"), "regression").when(outcome_rank("now") > outcome_rank("was"), "improvement")
        .when(d == "better", "improvement").when(d == "worse", "degraded").otherwise("ok")
    )
    return j.select("case", "was", "now", severity.alias("severity")).orderBy("case")


def freeze(rows: DataFrame, order: str) -> DataFrame:
    """(case, outcome, error_m, n_inliers, ncc): the last row of each case by order, rounded as the frozen table keeps it."""
    last = rows.selectExpr("*", f"row_number() over (partition by `case` order by {order} desc) as __n").filter("__n = 1")
    return last.select("case", "outcome", F.bround("error_m", 1).alias("error_m"), "n_inliers", F.bround("photometric", 4).alias("ncc"))


def config_diff(was: DataFrame, now: DataFrame) -> DataFrame:
    """(key, was, now) of keys whose values, as strings, differ between two tables (key, value); null on both sides is no difference."""
    a, b = was.select("key", F.col("value").cast("string").alias("was")), now.select("key", F.col("value").cast("string").alias("now"))
    return a.join(b, "key", "full_outer").filter(F.col("key").isin(*CONFIG_KEYS) & ~F.col("was").eqNullSafe(F.col("now")))


def exclusive_quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """(by..., q): the quantile at rank q (n + 1), linear between neighbours and clamped to the outer pairs; a lone value is itself.

    It differs from `percentile`, which is the inclusive one.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    run = running_sums(counts, "v", ["c"], by)
    n = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    j = run.join(n, by) if by else run.crossJoin(n)
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(q * (F.col("n") + 1))))
    j = j.withColumn("j", at).withColumn("frac", q * (F.col("n") + 1) - F.col("j"))
    g = j.groupBy(*by).agg(F.first("n").alias("n"), F.first("frac").alias("frac"), F.min(F.when(F.col("run_c") >= F.col("j"), F.col("v"))).alias("lo"), F.min(F.when(F.col("run_c") >= F.col("j") + 1, F.col("v"))).alias("hi"))
    return g.select(*by, F.when(F.col("n") == 1, F.col("lo")).otherwise(F.col("lo") * (1 - F.col("frac")) + F.col("hi") * F.col("frac")).alias("q"))


def auc(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """(by, auc): chance that a positive beats a negative, ties a half, from counts by score; null without both."""
    counts = df.groupBy(by, F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    run = running_sums(counts, "s", ["n"], [by])
    # a positive beats the negatives below it and half of those at its value
    wins = F.sum(F.col("p") * (F.col("run_n") - F.col("n") + F.col("n") / 2))
    g = run.groupBy(by).agg(wins.alias("w"), F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    return g.select(by, F.when((F.col("pp") > 0) & (F.col("nn") > 0), F.col("w") / (F.col("pp") * F.col("nn"))).alias("auc"))


def grid_summary(rows: DataFrame, by, value, success) -> DataFrame:
    """(grid, median, p90, max, success): quantiles of a value over a grid's successes, and their share."""
    good = F.when(_c(success), _c(value))
    return rows.groupBy(_c(by).alias("grid")).agg(F.percentile(good, 0.5).alias("median"), F.percentile(good, 0.9).alias("p90"), F.max(good).alias("max"), F.avg(_c(success).cast("double")).alias("success"))


def breakpoint(rows: DataFrame, kind, strength, success, least: float = 0.75) -> DataFrame:
    """(kind, breaks_at): the least strength of each kind of disturbance at which under least of the rows succeed, null where none is."""
    r = rows.groupBy(_c(kind).alias("kind"), _c(strength).alias("strength")).agg(F.avg(_c(success).cast("double")).alias("rate"))
    return r.groupBy("kind").agg(F.min(F.when(F.col("rate") < least, F.col("strength"))).alias("breaks_at"))


def rollup(rows: DataFrame, value: str = "accepted", score: str = "photometric", bins: int = 5) -> DataFrame:
    """(regime, status, bin, n, share): counts and the mean of value by regime and status, by regime, by bins of a score from 0 to 1 (its reliability), and over all."""
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.col(score), F.lit(0.0)) * bins)).cast("bigint")
    b = rows.select("regime", "status", at.alias("bin"), value)
    g = b.groupingSets([[F.col("regime"), F.col("status")], [F.col("regime")], [F.col("bin")], []], "regime", "status", "bin")
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("share"))


def within_case(scores: DataFrame, case: str = "case") -> DataFrame:
    """One row (wins, total, median_margin) over cases with both: how often, and by how much, the right place's score exceeds the best wrong one's, of (case, right, wrong)."""
    m = scores.filter("right is not null and wrong is not null").select((F.col("right") - F.col("wrong")).alias("m"))
    return m.agg(F.count_if(F.col("m") > 0).alias("wins"), F.count("*").alias("total"), F.percentile("m", 0.5).alias("median_margin"))


def outcome_histogram(rows: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def top_wrong(rows: DataFrame, most: int = 12) -> DataFrame:
    """The wrong poses of (case, outcome, n_inliers, …) with the most inliers, ties by case."""
    return rows.filter("outcome in ('accepted_wrong', 'pose_wrong_gated')").orderBy(F.desc("n_inliers"), "case").limit(most)


def thinned(rows: DataFrame, by: str, order: str, about: int = 50) -> DataFrame:
    """Every so many-th row of each group in order, so that about so many are left, or a few more."""
    w = f"over (partition by {by}"
    t = rows.selectExpr("*", f"row_number() {w} order by {order}) as __n", f"count(*) {w}) as __total")
    return t.filter(f"pmod(__n - 1, greatest(1, __total div {int(about)})) = 0").drop("__n", "__total")
