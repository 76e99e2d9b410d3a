"""Forecast scoring: every metric as an aggregate over a prediction log.

A log row has an ``outcome`` (0, 1, 2) and three probabilities; any grouping columns
(model, split, year) score all models in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PROBABILITIES, col, of_outcome, top_class

EPS = 1e-15


def log_loss(columns=PROBABILITIES, y: str = "outcome") -> Column:
    """Row loss; its mean is the log loss."""
    return -F.log(F.least(F.greatest(of_outcome(columns, y), F.lit(EPS)), F.lit(1.0)))


def brier(columns=PROBABILITIES, y: str = "outcome") -> Column:
    parts = [F.pow(col(c) - (F.col(y) == i).cast("double"), F.lit(2.0)) for i, c in enumerate(columns)]
    return sum(parts[1:], parts[0])


def ranked_probability(columns=PROBABILITIES, y: str = "outcome") -> Column:
    """Squared differences of the two cumulative probabilities, halved."""
    first = F.pow(col(columns[0]) - (F.col(y) <= 0).cast("double"), F.lit(2.0))
    second = F.pow(col(columns[0]) + col(columns[1]) - (F.col(y) <= 1).cast("double"), F.lit(2.0))
    return (first + second) / 2.0


def confidence(columns=PROBABILITIES) -> Column:
    return F.greatest(*map(col, columns))


def correct(columns=PROBABILITIES, y: str = "outcome") -> Column:
    return (top_class(columns) == F.col(y)).cast("double")


def calibration_error(log: DataFrame, by: Sequence[str] = (), bins: int = 10, columns=PROBABILITIES, y: str = "outcome") -> DataFrame:
    """``by, ece``: mean distance of confidence and accuracy over confidence bins, weighted by their rows."""
    bin_of = F.least(F.floor(confidence(columns) * bins), F.lit(bins - 1))
    cells = log.groupBy(*by, bin_of.alias("__bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence(columns)).alias("c"), F.sum(correct(columns, y)).alias("a"))
    return cells.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def evaluate(log: DataFrame, by: Sequence[str] = (), columns=PROBABILITIES, y: str = "outcome", bins: int = 10) -> DataFrame:
    """All metrics per group: two aggregations (by group and bin, then by group)."""
    bin_of = F.least(F.floor(confidence(columns) * bins), F.lit(bins - 1))
    measures = {"log_loss": log_loss(columns, y), "brier": brier(columns, y), "rps": ranked_probability(columns, y), "accuracy": correct(columns, y), "sharpness": confidence(columns)}
    cells = log.groupBy(*by, bin_of.alias("__bin")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for n, c in measures.items()))
    gap = F.sum(F.abs(F.col("sharpness") - F.col("accuracy")))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), *((F.sum(m) / F.sum("n")).alias(m) for m in measures), (gap / F.sum("n")).alias("ece"))


def slices(log: DataFrame, gap: str = "elo_gap", y: str = "outcome") -> DataFrame:
    """``log`` with a ``slice`` column; a row comes once for each of the overlapping slices it is in."""
    tests = {"overall": F.lit(True), "neutral": F.col("neutral"), "non_neutral": ~F.col("neutral"), "low_elo_gap": F.abs(gap) < 100, "high_elo_gap": F.abs(gap) >= 200, "draws": F.col(y) == 1}
    return log.withColumn("slice", F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda s: s.isNotNull())))


def gap_bucket(gap: str = "elo_gap") -> Column:
    g = F.abs(gap)
    return F.when(g.isNull(), None).when(g == 0, None).when(g <= 50, "0-50").when(g <= 150, "50-150").when(g <= 300, "150-300").otherwise("300+")


def sliced_by_value(log: DataFrame, keys: dict[str, Column], columns=PROBABILITIES, y: str = "outcome") -> DataFrame:
    """``dimension, value`` and metrics, for each value of each key, from one scan by grouping sets."""
    rows = log.select(*(c.cast("string").alias(f"__{k}") for k, c in keys.items()), log_loss(columns, y).alias("ll"), brier(columns, y).alias("br"), correct(columns, y).alias("ok"))
    names = [f"__{k}" for k in keys]
    grouped = rows.groupingSets([[F.col(n)] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), F.avg("ll").alias("log_loss"), F.avg("br").alias("brier"), F.avg("ok").alias("accuracy"), *(F.grouping(n).alias(f"g{n}") for n in names))
    which = F.coalesce(*(F.when(F.col(f"g__{k}") == 0, F.lit(k)) for k in keys))
    return grouped.select(which.alias("dimension"), F.coalesce(*names).alias("value"), "n", "log_loss", "brier", "accuracy").where("value is not null")


def reliability(log: DataFrame, by: Sequence[str] = (), bins: int = 10, columns=PROBABILITIES, y: str = "outcome") -> DataFrame:
    """``by, class, bin, p_min, p_max, n, mean_predicted, empirical_rate`` per class; empty bins have no row."""
    long = log.select(*by, F.inline(F.array(*(F.struct(F.lit(i).alias("class"), col(c).alias("p"), (F.col(y) == i).cast("double").alias("hit")) for i, c in enumerate(columns)))))
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return (
        long.groupBy(*by, "class", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("empirical_rate"))
        .withColumns({"p_min": F.col("bin") / bins, "p_max": (F.col("bin") + 1) / bins})
    )


def selective(log: DataFrame, threshold: float, by: str = "yr", columns=PROBABILITIES, y: str = "outcome") -> DataFrame:
    """Coverage and accuracy of confident picks, per group and pooled (null group)."""
    sure = confidence(columns) >= threshold
    rows = log.select(F.col(by), sure.cast("int").alias("sure"), correct(columns, y).alias("ok"))
    return rows.groupingSets([[F.col(by)], []], by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sure").alias("n_selected"), F.avg("sure").alias("coverage"), F.avg(F.when(F.col("sure") == 1, F.col("ok"))).alias("selected_accuracy"), F.avg("ok").alias("full_accuracy")
    )


def stable_threshold(log: DataFrame, by: str = "yr", *, target: float = 0.65, least: int = 100, thresholds: Sequence[float] = tuple(round(0.40 + 0.01 * i, 2) for i in range(41)), columns=PROBABILITIES, y: str = "outcome") -> DataFrame:
    """One row: the smallest threshold at which every group has enough picks and is accurate enough (null if none).

    One pass: each row counts for the highest threshold it reaches, and sums from
    there down give the picks at each threshold.
    """
    grid = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    reached = F.size(F.filter(grid, lambda t: confidence(columns) >= t))
    cells = log.groupBy(by, reached.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(correct(columns, y)).alias("ok"))
    # the grid has 41 values: cells are at most 42 per group
    each = cells.select(by, "n", "ok", F.posexplode(grid).alias("i", "threshold"), "r").groupBy("threshold", by).agg(
        F.sum(F.when(F.col("r") > F.col("i"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("r") > F.col("i"), F.col("ok")).otherwise(0.0)).alias("ok")
    )
    good = (F.col("n") >= least) & (F.col("ok") >= F.lit(target) * F.col("n"))
    return each.groupBy("threshold").agg(F.bool_and(good).alias("good")).agg(F.min(F.when(F.col("good"), F.col("threshold"))).alias("threshold"))


def class_prior(train: DataFrame, y: str = "outcome") -> DataFrame:
    """``p_team2_win, p_draw, p_team1_win``: (count + 1) / (n + 3)."""
    return train.agg(*(((F.count_if(F.col(y) == i) + 1) / (F.count(F.lit(1)) + 3)).alias(c) for i, c in enumerate(PROBABILITIES)))


def pooled_candidates(log: DataFrame, candidate: str = "candidate", fold: str = "yr") -> DataFrame:
    """Pooled metrics per candidate with the spread of its log loss over folds, best first by (log loss, Brier, RPS)."""
    folds = evaluate(log, [candidate, fold])
    spread = folds.groupBy(candidate).agg(F.stddev_pop("log_loss").alias("log_loss_std"), F.count(F.lit(1)).alias("folds"))
    return evaluate(log, [candidate]).join(spread, candidate)


def promotion(metrics: DataFrame, baseline: str, *, name: str = "model", gain: float = 0.01, slack: float = 0.01) -> DataFrame:
    """Each candidate against the baseline per split: better log loss by ``gain``, Brier and RPS worse by ``slack`` at most; promoted if all splits pass."""
    base = metrics.where(F.col(name) == baseline).select("split", *(F.col(m).alias(f"base_{m}") for m in ("log_loss", "brier", "rps")))
    rows = metrics.where(F.col(name) != baseline).join(base, "split")
    passes = (F.col("log_loss") <= F.col("base_log_loss") * (1 - gain)) & (F.col("brier") <= F.col("base_brier") * (1 + slack)) & (F.col("rps") <= F.col("base_rps") * (1 + slack))
    return rows.groupBy(name).agg(F.bool_and(passes).alias("promoted"), F.count(F.lit(1)).alias("splits"))


def blend(columns: Sequence[Sequence[str]], weights: Sequence[float] | None = None) -> list[Column]:
    """Weighted mean of several probability triples, normalised; equal weights by default."""
    w = list(weights) if weights is not None else [1.0] * len(columns)
    total = sum(w)
    mixed = [sum((col(c[i]) * (x / total) for c, x in zip(columns, w)), F.lit(0.0)) for i in range(len(columns[0]))]
    clipped = [F.least(F.greatest(m, F.lit(1e-12)), F.lit(1.0)) for m in mixed]
    whole = sum(clipped[1:], clipped[0])
    return [(c / whole).alias(n) for c, n in zip(clipped, PROBABILITIES)]
