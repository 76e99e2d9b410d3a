"""Outcome and score models: Spark ML fits and a few distributed aggregates, each predicting W/D/L probabilities."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PROBABILITIES
from ..functions.score_matrix import cells, outcome_probabilities

ELO_COLUMNS = ["elo_diff_pre", "neutral_int", "tournament_importance", "days_rest_diff"]


@dataclass
class Scaling:
    """Medians for missing values, then means and population deviations of the filled columns.

    The medians are within one part in 10,000 of the middle rank, so that no task holds a column's distinct values.
    """

    columns: list[str]
    medians: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaling:
        found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in columns)).first()
        kept = [c for c in columns if found[c] is not None]  # all-null columns say nothing
        out = cls(kept, [found[c] for c in kept])
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(kept, out.medians)]
        row = df.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
        out.means = [row[f"m{i}"] for i in range(len(kept))]
        out.scales = [row[f"s{i}"] or 1.0 for i in range(len(kept))]
        return out

    def vector(self, df: DataFrame, name: str = "__x") -> DataFrame:
        parts = [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(s)).alias(f"__f{i}") for i, (c, m, a, s) in enumerate(zip(self.columns, self.medians, self.means, self.scales))]
        wide = df.select("*", *parts)
        names = [f"__f{i}" for i in range(len(parts))]
        return VectorAssembler(inputCols=names, outputCol=name).transform(wide).drop(*names)


def regularisation(df: DataFrame, c: float, weight: str | None) -> float:
    total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    return 1.0 / (c * float(total))


class Multinomial:
    """Multinomial logistic regression on standardised columns with weights; C as in the inverse-penalty form."""

    def __init__(self, columns: Sequence[str], c: float = 1.0, weight: str | None = None, y: str = "outcome"):
        self.columns, self.c, self.weight, self.y = list(columns), c, weight, y

    def fit(self, train: DataFrame) -> Multinomial:
        self.scaling = Scaling.fit(train, self.columns)
        rows = self.scaling.vector(train).withColumn("__y", F.col(self.y).cast("double"))
        lr = LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", standardization=False, regParam=regularisation(train, self.c, self.weight), maxIter=200, tol=1e-9, probabilityCol="__p")
        self.model = (lr.setWeightCol(self.weight) if self.weight else lr).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        p = vector_to_array("__p")
        n = self.model.numClasses
        scored = self.model.transform(self.scaling.vector(df))
        return scored.select(*df.columns, *((F.get(p, i) if i < n else F.lit(0.0)).alias(c) for i, c in enumerate(PROBABILITIES)))

    def importance(self, spark) -> DataFrame:
        """``feature, importance, rank``: length of each coefficient over the classes."""
        size = np.linalg.norm(self.model.coefficientMatrix.toArray(), axis=0)
        order = np.argsort(-size, kind="stable")
        rows = [(self.scaling.columns[int(j)], float(size[j]), r + 1) for r, j in enumerate(order)]
        return spark.createDataFrame(rows, "feature string, importance double, rank int")


def elo_baseline(columns: Sequence[str], **options) -> Multinomial:
    return Multinomial([c for c in ELO_COLUMNS if c in columns], **options)


class TwoStage:
    """P(draw), then P(team1 wins | someone wins); ``kind`` is "logistic" or "trees"."""

    def __init__(self, columns: Sequence[str], c: float = 1.0, kind: str = "logistic", weight: str | None = None, y: str = "outcome", rounds: int = 20, depth: int = 3, seed: int = 7):
        self.columns, self.c, self.kind, self.weight, self.y, self.rounds, self.depth, self.seed = list(columns), c, kind, weight, y, rounds, depth, seed

    def _binary(self, rows: DataFrame):
        if self.kind == "trees":
            model = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=self.rounds, maxDepth=self.depth, stepSize=0.1, seed=self.seed)
        else:
            model = LogisticRegression(featuresCol="__x", labelCol="__y", standardization=False, regParam=regularisation(rows, self.c, self.weight), maxIter=200, tol=1e-9)
        return (model.setWeightCol(self.weight) if self.weight else model).fit(rows)

    def fit(self, train: DataFrame) -> TwoStage:
        self.scaling = Scaling.fit(train, self.columns)
        rows = self.scaling.vector(train).cache()
        self.draw = self._binary(rows.withColumn("__y", (F.col(self.y) == 1).cast("double")))
        self.first = self._binary(rows.where(F.col(self.y) != 1).withColumn("__y", (F.col(self.y) == 2).cast("double")))
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self.scaling.vector(df)
        for model, name in ((self.draw, "__d"), (self.first, "__w")):
            scored = model.transform(rows)
            rows = scored.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        d, w = F.col("__d"), F.col("__w")
        return rows.select(*df.columns, ((1 - d) * (1 - w)).alias("p_team2_win"), d.alias("p_draw"), ((1 - d) * w).alias("p_team1_win"))


def poisson_step(rows: DataFrame, betas: dict[str, np.ndarray], p: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """X'WX and X'(y - mu), weighted, for each response with its coefficients: one pass; each task sends one row of p * p + p numbers a response."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {y: np.zeros(p * p + p) for y in betas}
        for batch in batches:
            if batch.num_rows:
                column = lambda n: batch.column(batch.schema.get_field_index(n))
                x = np.column_stack([np.ones(batch.num_rows), column("x").flatten().to_numpy().reshape(batch.num_rows, p - 1)])
                w = column("w").to_numpy()
                for y, beta in betas.items():
                    mu = np.exp(np.clip(x @ beta, -30, 30))
                    sums[y][: p * p] += ((x * (w * mu)[:, None]).T @ x).ravel()
                    sums[y][p * p :] += x.T @ (w * (column(y).to_numpy() - mu))
        yield pa.record_batch([pa.array([np.concatenate(list(sums.values()))], pa.list_(pa.float64()))], names=["v"])

    parts = rows.mapInArrow(partial, "v array<double>")
    total = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy().reshape(len(betas), -1)
    return {y: (v[: p * p].reshape(p, p), v[p * p :]) for y, v in zip(betas, total)}


class TwoPoisson:
    """Two log-link Poisson regressions with an L2 penalty (mean loss + alpha/2 |b|^2), by Newton steps."""

    def __init__(self, columns: Sequence[str], alpha: float = 0.03, weight: str | None = None, steps: int = 25, max_goals: int = 7):
        self.columns, self.alpha, self.weight, self.steps, self.max_goals, self.rho = list(columns), alpha, weight, steps, max_goals, None

    def fit(self, train: DataFrame) -> TwoPoisson:
        self.scaling = Scaling.fit(train, self.columns)
        rows = self.scaling.vector(train).select(
            vector_to_array("__x").alias("x"), F.col("team1_goals").cast("double").alias("y1"), F.col("team2_goals").cast("double").alias("y2"), (F.col(self.weight) if self.weight else F.lit(1.0)).alias("w")
        ).cache()
        total, *means = rows.agg(F.sum("w"), *(F.sum(F.col("w") * F.col(y)) / F.sum("w") for y in ("y1", "y2"))).first()
        p = len(self.scaling.columns) + 1
        penalty = np.r_[0.0, np.full(p - 1, self.alpha * total)]
        betas = {y: np.r_[np.log(max(mean, 1e-6)), np.zeros(p - 1)] for y, mean in zip(("y1", "y2"), means)}
        open_ = set(betas)
        for _ in range(self.steps):
            if not open_:
                break
            for y, (h, g) in poisson_step(rows, {y: betas[y] for y in sorted(open_)}, p).items():
                step = np.linalg.solve(h + np.diag(penalty + 1e-9), g - penalty * betas[y])
                betas[y] = betas[y] + step
                if np.abs(step).max() < 1e-8:
                    open_.remove(y)
        self.betas = [betas["y1"], betas["y2"]]
        rows.unpersist()
        return self

    def rates(self, df: DataFrame) -> DataFrame:
        """``df`` with ``lambda1, lambda2``, clipped to [0.02, 5]."""
        x = vector_to_array("__x")
        rows = self.scaling.vector(df)
        for i, beta in enumerate(self.betas, 1):
            slopes = F.array(*map(F.lit, map(float, beta[1:])))
            z = F.aggregate(F.zip_with(x, slopes, lambda a, b: a * b), F.lit(float(beta[0])), lambda acc, v: acc + v)
            rows = rows.withColumn(f"lambda{i}", F.least(F.greatest(F.exp(z), F.lit(0.02)), F.lit(5.0)))
        return rows.drop("__x")

    def predict(self, df: DataFrame) -> DataFrame:
        matrix = cells("lambda1", "lambda2", self.max_goals, self.rho)
        return self.rates(df).withColumn("__m", matrix).select(*df.columns, "lambda1", "lambda2", *outcome_probabilities("__m"))


def fit_rho(scored: DataFrame, low: float = -0.2, high: float = 0.2, rounds: int = 3, points: int = 41, weight: str | None = None) -> float:
    """The low-score correction with the highest likelihood: a grid in one aggregate, refined around its best point."""
    a, b, x, y = F.col("lambda1"), F.col("lambda2"), F.col("team1_goals"), F.col("team2_goals")
    w = F.col(weight) if weight else F.lit(1.0)
    rows = scored.where((x <= 1) & (y <= 1))  # the other scores do not depend on it
    for _ in range(rounds):
        grid = np.linspace(low, high, points)

        def gain(r: float):
            tau = F.when((x == 0) & (y == 0), 1 - a * b * r).when((x == 0) & (y == 1), 1 + a * r).when((x == 1) & (y == 0), 1 + b * r).otherwise(1 - F.lit(r))
            return F.sum(w * F.log(F.greatest(tau, F.lit(1e-10))))

        found = rows.agg(*(gain(float(r)).alias(f"g{i}") for i, r in enumerate(grid))).first()
        best = int(np.argmax([v if v is not None else -np.inf for v in found]))
        low, high = float(grid[max(0, best - 1)]), float(grid[min(points - 1, best + 1)])
    return float(grid[best])


class DixonColes(TwoPoisson):
    """TwoPoisson with a correction of the scores 0:0, 0:1, 1:0 and 1:1; unweighted unless ``weighted``."""

    weighted = False

    def fit(self, train: DataFrame) -> DixonColes:
        super().fit(train)
        self.rho = fit_rho(self.rates(train), weight=self.weight if self.weighted else None)
        return self


MODELS = {"logistic": Multinomial, "two_stage": TwoStage, "poisson": TwoPoisson, "dixon_coles": DixonColes}


def save_model(model, path: str) -> None:
    """Scaling and coefficients as JSON; Spark ML parts beside it. Paths may be in any store Spark writes to."""
    state = {"kind": type(model).__name__, "columns": model.scaling.columns, "medians": model.scaling.medians, "means": model.scaling.means, "scales": model.scaling.scales}
    if isinstance(model, TwoPoisson):
        state |= {"betas": [list(map(float, b)) for b in model.betas], "rho": model.rho}
    else:
        for name in ("model", "draw", "first"):
            if hasattr(model, name):
                getattr(model, name).write().overwrite().save(f"{path}/{name}")
    from pyspark.sql import SparkSession

    text = json.dumps(state, sort_keys=True)
    row = SparkSession.active().createDataFrame([(text,)], "value string").withColumn("sha256", F.sha2("value", 256))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_state(spark, path: str) -> dict:
    """The JSON state of a saved model; its checksum is verified."""
    row = spark.read.parquet(f"{path}/state").withColumn("again", F.sha2("value", 256)).first()
    if row["sha256"] != row["again"]:
        raise ValueError(f"the model in {path} has changed")
    return json.loads(row["value"])
