"""Models, folds, searches and blends against plain NumPy and Python on small tables."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions.columns import PROBABILITIES
from tidecast.operators import calibration, context, models, search

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """Matches on the days of 1990 to 1993; "a" tells the winner, a missing "b" says nothing."""
    rng = random.Random(11)
    data = []
    for i in range(480):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        goals = min(7, int(rng.expovariate(1) * math.exp(0.4 * a))), min(7, int(rng.expovariate(1) * math.exp(-0.4 * a)))
        outcome = 2 if goals[0] > goals[1] else 1 if goals[0] == goals[1] else 0
        data.append((f"m{i:03}", dt.datetime(1990, 1, 1) + dt.timedelta(days=3 * i), a, b if i % 9 else None, *goals, outcome))
    df = spark.createDataFrame(data, "match_id string, kickoff_utc timestamp, a double, b double, team1_goals int, team2_goals int, outcome int")
    return df.coalesce(2).cache()


def matrix(scaling, rows):
    """Filled and standardised columns, as NumPy has them."""
    pdf = rows.orderBy("match_id").toPandas()
    x = pdf[COLUMNS].to_numpy(float)
    for j, m in enumerate(scaling.medians):
        x[np.isnan(x[:, j]), j] = m
    z = (x - x.mean(0)) / x.std(0)
    return pdf, z


def probabilities(df):
    return df.orderBy("match_id").select(*PROBABILITIES).toPandas().to_numpy()


def test_multinomial_is_the_penalised_optimum(spark, rows):
    c = 0.3
    model = models.Multinomial(COLUMNS, c=c).fit(rows)
    pdf, z = matrix(model.scaling, rows)
    p, hit = probabilities(model.predict(rows)), np.eye(3)[pdf["outcome"]]
    w = model.model.coefficientMatrix.toArray()
    assert np.abs(z.T @ (p - hit) + w.T / c).max() < 0.05  # slope of loss and penalty
    assert np.abs((p - hit).sum(0)).max() < 0.05 and np.allclose(p.sum(1), 1)
    found = model.importance(spark).orderBy("rank").collect()
    assert [r.feature for r in found] == ["a", "b"] and found[0].importance == pytest.approx(np.linalg.norm(w[:, 0]))


def test_poisson_is_the_penalised_optimum(spark, rows, tmp_path):
    model = models.TwoPoisson(COLUMNS, alpha=0.05).fit(rows)
    pdf, z = matrix(model.scaling, rows)
    x = np.column_stack([np.ones(len(z)), z])
    for beta, y in zip(model.betas, ("team1_goals", "team2_goals")):
        slope = x.T @ (pdf[y] - np.exp(x @ beta)) - np.array([0, 0.05, 0.05]) * len(z) * beta
        assert np.abs(slope).max() < 1e-5
    one, two = (np.clip(np.exp(x @ b), 0.02, 5) for b in model.betas)
    goals = [np.stack([np.exp(-m) * m**k / math.factorial(k) for k in range(8)]) for m in (one, two)]
    joint = goals[0][:, None] * goals[1][None]
    joint /= joint.sum((0, 1))
    win = sum(joint[i, j] for i in range(8) for j in range(i))
    assert np.allclose(probabilities(model.predict(rows))[:, PROBABILITIES.index("p_team1_win")], win, atol=1e-9)

    models.save_model(model, str(tmp_path / "m"))
    state = models.load_state(spark, str(tmp_path / "m"))
    assert state["kind"] == "TwoPoisson" and np.allclose(state["betas"], model.betas) and state["columns"] == COLUMNS
    other = spark.read.parquet(f"{tmp_path}/m/state").withColumn("value", F.concat("value", F.lit(" "))).collect()
    spark.createDataFrame(other).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/m/state")
    with pytest.raises(ValueError):
        models.load_state(spark, str(tmp_path / "m"))


def test_trees_find_what_lines_cannot(spark):
    """Whether there is a winner depends on the signs of both columns together."""
    rng = random.Random(2)
    data = []
    for i in range(400):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append((f"m{i:03}", a, b, 1 if a * b > 0 else (2 if a > 0 else 0)))
    df = spark.createDataFrame(data, "match_id string, a double, b double, outcome int").coalesce(2).cache()
    p = probabilities(models.TwoStage(COLUMNS, kind="trees", rounds=8).fit(df).predict(df))
    truth = np.array([r[3] for r in sorted(data)])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == truth).mean() > 0.9
    lines = probabilities(models.TwoStage(COLUMNS).fit(df).predict(df))
    assert np.allclose(lines.sum(1), 1) and (lines.argmax(1) == truth).mean() < 0.8


def losses(rows, first, last):
    """Log loss of the smoothed shares of earlier years, by fold and pooled; plain Python."""
    data, by_fold = [(r.kickoff_utc.year, r.outcome) for r in rows.collect()], {}
    for year in range(first, last + 1):
        past = [y for t, y in data if t < year]
        now = [y for t, y in data if t == year]
        if past and now:
            by_fold[str(year)] = [-math.log((past.count(y) + 1) / (len(past) + 3)) for y in now]
    return by_fold


def test_folds_learn_from_what_came_before(spark, rows):
    folds, want = search.annual_folds(spark, 1990, 1995), losses(rows, 1990, 1995)
    log = search.out_of_fold(rows, folds, search.Prior)
    of = F.element_at(F.array(*PROBABILITIES), F.col("outcome") + 1)
    got = {r.fold: (r.n, r.loss) for r in log.groupBy("fold").agg(F.count("*").alias("n"), F.avg(-F.log(of)).alias("loss")).collect()}
    assert got.keys() == want.keys() == {"1991", "1992", "1993"}  # 1990 has no past, 1994 and 1995 no matches
    for fold, each in want.items():
        assert got[fold] == (len(each), pytest.approx(sum(each) / len(each)))
    assert search.out_of_fold(rows, search.annual_folds(spark, 2001, 2001), search.Prior).isEmpty()


def test_rolling_search_pools_the_folds(spark, rows):
    made = {"prior": search.Prior, "logistic": lambda: models.Multinomial(COLUMNS)}
    got = search.rolling_search(rows, search.annual_folds(spark, 1991, 1993), made).collect()
    want = losses(rows, 1991, 1993)
    pooled = [x for each in want.values() for x in each]
    assert [r.candidate for r in got] == ["logistic", "prior"] and got[1].n == len(pooled) and got[1].folds == 3
    assert got[1].log_loss == pytest.approx(sum(pooled) / len(pooled))
    assert got[1].log_loss_std == pytest.approx(np.std([np.mean(x) for x in want.values()]))


def test_replay_windows_are_half_open(spark):
    folds = search.window_folds(spark, {"cup": ("1991-05-01", "1991-06-01")})
    days = [(str(i), dt.datetime(1991, *d)) for i, d in enumerate([(4, 30), (5, 1), (5, 31), (6, 1)])]
    roles = search.fold_roles(spark.createDataFrame(days, "match_id string, kickoff_utc timestamp"), folds)
    assert {r.match_id: r.role for r in roles.collect()} == {"0": "train", "1": "test", "2": "test"}


def test_recency_weights_reach_the_model(rows):
    class Seen:
        weight = None

        def fit(self, train):
            w = F.col(self.weight) if self.weight else F.lit(1.0)
            self.mean, self.most = train.agg(F.avg(w), F.max(w)).first()

    seen = Seen()
    search.Weighted(seen, 2.0).fit(rows)
    days = np.array([3.0 * (479 - i) for i in range(480)])
    raw = 0.5 ** (days / 365.25 / 2)
    assert seen.mean == pytest.approx(1.0) and seen.most == pytest.approx(raw.max() / raw.mean())
    plain = Seen()
    search.Weighted(plain, None).fit(rows)
    assert plain.weight is None and plain.mean == plain.most == 1.0


def test_grid_names_every_candidate():
    grid = search.candidates(COLUMNS, kinds=["logistic", "poisson"], cs=(0.1, 1.0), half_lives=(None, 4.0), alphas=(0.03, 0.3))
    assert len(grid) == 8 and grid["logistic C=0.1 hl=4.0"]().model.c == 0.1 and grid["poisson alpha=0.3 hl=None"]().model.alpha == 0.3


def two_models(seed=5, n=600):
    rng = np.random.default_rng(seed)
    truth = rng.dirichlet([2, 2, 2], n)
    one, two = (truth * rng.uniform(0.3, 1.7, (n, 3)) for _ in range(2))
    return [int(rng.choice(3, p=p)) for p in truth], one / one.sum(1, keepdims=True), two / two.sum(1, keepdims=True)


def test_pairwise_blends_reach_the_best_weight(spark):
    y, one, two = two_models()
    data = [(name, "f", str(i), y[i], *map(float, p[i])) for name, p in (("one", one), ("two", two)) for i in range(len(y))]
    log = spark.createDataFrame(data, ["candidate", "fold", "match_id", "outcome", *PROBABILITIES]).coalesce(2)
    got = search.pairwise_blends(log, "one", ["two"]).first()
    at = np.arange(len(y))
    grid = np.linspace(0, 1, 2001)
    loss = [-np.log(w * one[at, y] + (1 - w) * two[at, y]).mean() for w in grid]
    assert got.base_weight == pytest.approx(grid[int(np.argmin(loss))], abs=2e-3) and got.base_weight + got.other_weight == pytest.approx(1)
    assert got.log_loss == pytest.approx(min(loss), abs=1e-6) and got.n == len(y)


def test_ensemble_mixes_row_by_row(rows):
    fitted = [search.Prior().fit(rows), models.Multinomial(COLUMNS).fit(rows)]
    parts = [probabilities(m.predict(rows)) for m in fitted]
    mixed = probabilities(calibration.Ensemble(fitted, [1.0, 3.0]).predict(rows))
    assert np.allclose(mixed, 0.25 * parts[0] + 0.75 * parts[1], atol=1e-9)


def test_temperature_against_a_fine_grid(spark):
    y, p, _ = two_models(8)
    df = spark.createDataFrame([(y[i], *map(float, p[i])) for i in range(len(y))], ["outcome", *PROBABILITIES]).coalesce(2)
    at, grid = np.arange(len(y)), np.linspace(-1.5, 1.5, 6001)

    def loss(u):
        q = p ** (1 / np.exp(u))
        return -np.log((q / q.sum(1, keepdims=True))[at, y]).mean() + 0.05 * u * u

    best = grid[int(np.argmin([loss(u) for u in grid]))]
    assert math.log(calibration.Temperature().fit(df).temperature) == pytest.approx(best, abs=2e-3)
    with pytest.raises(ValueError):
        calibration.Isotonic().fit(df)


def test_chronological_search_scores_both_splits(spark, rows):
    made = search.candidates(COLUMNS, kinds=["logistic", "poisson"], cs=(1.0,), half_lives=(None,))
    dates = ("1991-07-01", "1992-01-01", "1992-07-01", "1993-01-01", "1994-01-01")
    got = {(r.model, r.split): r for r in search.chronological_search(rows, COLUMNS, *dates, models=made).collect()}
    assert {m for m, _ in got} == {"baseline", "blend", *made} and len(got) == 8
    data = [(str(r.kickoff_utc), r.outcome) for r in rows.collect()]
    past = [y for t, y in data if t < dates[1]]
    for split, low, high in (("validation", *dates[2:4]), ("holdout", *dates[3:5])):
        each = [-math.log((past.count(y) + 1) / (len(past) + 3)) for t, y in data if low <= t < high]
        assert got[("baseline", split)].n == len(each) and got[("baseline", split)].log_loss == pytest.approx(sum(each) / len(each))
    passed = all(got[("blend", s)].log_loss <= 0.99 * got[("baseline", s)].log_loss and all(got[("blend", s)][m] <= 1.01 * got[("baseline", s)][m] for m in ("brier", "rps")) for s in ("validation", "holdout"))
    assert got[("blend", "holdout")].promoted == passed and got[("baseline", "holdout")].promoted is None


def test_feature_sets_hold_no_result(spark):
    df = spark.createDataFrame([], "match_id string, outcome int, team1_goals int, team2_goals int, elo_diff_pre double, win_streak_diff double, goals_for_roll5_diff double, neutral_int int, tournament string")
    for name in ("default", "compact", "advanced"):
        found = context.feature_columns(df, name)
        assert not set(found) & {"match_id", "outcome", "team1_goals", "team2_goals", "win_streak_diff", "tournament"}
        assert "elo_diff_pre" in found and found == [c for c in df.columns if c in found]


def test_grid_has_every_feature_set_and_baselines_stand_beside_it(spark, rows):
    grid = search.grid({"both": COLUMNS, "one": ["a"]}, kinds=["logistic"], cs=(1.0,), half_lives=(4.0,))
    assert list(grid) == ["both: logistic C=1.0 hl=4.0", "one: logistic C=1.0 hl=4.0"]
    assert grid["one: logistic C=1.0 hl=4.0"]().model.columns == ["a"]
    got = [r.candidate for r in search.rolling_search(rows, search.annual_folds(spark, 1993, 1993), grid, baselines={"prior": search.Prior}).collect()]
    assert sorted(got) == sorted([*grid, "prior"]) and got[-1] == "prior"  # it knows no feature


def test_replay_windows_train_on_what_came_before(spark, rows):
    folds = search.window_folds(spark, {"spring": ("1992-03-01", "1992-05-01"), "later": ("2014-06-12", "2014-07-14")})
    log = search.out_of_fold(rows, folds, search.Prior).toPandas()
    pdf = rows.toPandas()
    inside = pdf[(pdf["kickoff_utc"] >= "1992-03-01") & (pdf["kickoff_utc"] < "1992-05-01")]
    assert sorted(log["match_id"]) == sorted(inside["match_id"]) and set(log["fold"]) == {"spring"}
    assert list(search.REPLAYS) == ["world_cup_2014", "world_cup_2018", "world_cup_2022", "tournaments_2024"]


def test_finalise_needs_both_gates(spark):
    """The blend's weights come from the validation; a model that fails on the holdout alone is not promoted."""
    rng = random.Random(3)
    data = []
    for fold in ("1", "2"):
        for i in range(400):
            y = rng.randint(0, 2)
            sure = [0.7 if k == y else 0.15 for k in range(3)]
            wrong = [0.1 if k == y else 0.45 for k in range(3)]
            for name, p in (("base", [1 / 3] * 3), ("good", sure), ("lucky", sure if fold == "1" else wrong)):
                data.append((name, fold, f"m{i}", y, *map(float, p)))
    log = spark.createDataFrame(data, f"candidate string, fold string, match_id string, outcome int, {', '.join(f'{c} double' for c in PROBABILITIES)}")
    got, w = search.finalise(log, "base", ["good", "base"], ["2"])
    found = {(r.model, r.split): r for r in got.collect()}
    assert len(found) == 8 and w[0] == pytest.approx(1, abs=1e-3)
    assert all(found[m, s].promoted is p for m, p in (("good", True), ("lucky", False), ("blend", True)) for s in ("validation", "holdout"))
    assert found["lucky", "validation"].log_loss == pytest.approx(-math.log(0.7)) and found["lucky", "holdout"].log_loss == pytest.approx(-math.log(0.1))
    assert found["base", "holdout"].promoted is None


def test_many_fits_are_the_single_ones(spark, rows):
    """Every kind of candidate in one grid: the log of candidate-by-candidate fits, in a number of jobs that the grid does not change."""
    from tidecast.operators.many_fits import Grid

    folds = search.annual_folds(spark, 1991, 1995)
    made = search.candidates(COLUMNS, kinds=["logistic", "two_stage", "poisson", "dixon_coles"], cs=(0.3, 1.0), half_lives=(None, 2.0))
    made = {"prior": search.Prior, "one": lambda: models.Multinomial(["a"]), **made}
    key = ["candidate", "fold", "match_id"]
    one = search.backtest_log(rows, folds, made).toPandas().sort_values(key)
    grid = Grid(rows, folds, {n: search.spec_of(m()) for n, m in made.items()})
    many = grid.log().toPandas().sort_values(key)
    assert (one[key].to_numpy() == many[key].to_numpy()).all() and len(one) == 14 * 358
    assert np.abs(one[list(PROBABILITIES)].to_numpy() - many[list(PROBABILITIES)].to_numpy()).max() < 2e-5
    small = Grid(rows, folds, {"logistic": search.spec_of(models.Multinomial(COLUMNS, c=1.0)), "dixon": search.spec_of(models.DixonColes(COLUMNS))})
    assert grid.jobs <= small.jobs + 4 and grid.jobs < 30


def test_many_fits_reach_the_optimum(spark, rows):
    """The slopes of loss and penalty vanish, far below what the single fits stop at."""
    from tidecast.operators.many_fits import Grid, Spec

    specs = {"l": Spec("logistic", tuple(COLUMNS), 0.3, 2.0), "t": Spec("two_stage", tuple(COLUMNS), 0.3), "none": Spec("logistic", ("nothing",), 1.0)}
    grid = Grid(rows.withColumn("nothing", F.lit(None).cast("double")), search.annual_folds(spark, 1993, 1993), specs)
    pdf = rows.orderBy("match_id").toPandas()
    pdf = pdf[pdf["kickoff_utc"] < "1993-01-01"]
    fold = grid.folds[0]
    x = np.column_stack([np.ones(len(pdf)), (pdf[COLUMNS].fillna(dict(zip(COLUMNS, fold.medians))).to_numpy(float) - fold.means[:2]) / fold.scales[:2]])
    age = (pdf["kickoff_utc"].max() - pdf["kickoff_utc"]).dt.total_seconds() / (365.25 * 86400)
    w = 0.5 ** (age.to_numpy() / 2)
    w /= w.mean()
    beta = grid.fits["l", 0, "classes"].beta.reshape(3, 3)
    q = np.exp(x @ beta.T)
    q /= q.sum(1, keepdims=True)
    slope = ((q - np.eye(3)[pdf["outcome"]]) * w[:, None]).T @ x + np.array([0, 1, 1]) * beta / 0.3
    assert np.abs(slope).max() < 1e-6
    share = grid.log().where("candidate = 'none'").select(*PROBABILITIES).distinct().collect()
    assert len(share) == 1 and share[0].p_draw == pytest.approx((pdf["outcome"] == 1).mean())


def test_boosted_classes_against_plain_boosting(spark):
    """Histogram boosting finds the interaction, and its first trees are those of a plain search over all splits."""
    from tidecast.operators.boosting import BoostedClasses, softmax

    rng = random.Random(2)
    data = []
    for i in range(600):
        a, b = rng.randrange(-8, 8) / 8, rng.randrange(-8, 8) / 8
        data.append((f"m{i:03}", a, b if i % 11 else None, 1 if a * b > 0 else (2 if a > 0 else 0)))
    df = spark.createDataFrame(data, "match_id string, a double, b double, outcome int").repartition(3).cache()
    model = BoostedClasses(COLUMNS, rounds=12, rate=0.3, least=0.0).fit(df)
    p = probabilities(model.predict(df))
    truth = np.array([r[3] for r in sorted(data)])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == truth).mean() > 0.9

    x = np.array([[r[1], np.nan if r[2] is None else r[2]] for r in sorted(data)])
    one = BoostedClasses(COLUMNS, rounds=1, depth=1, rate=0.3, least=0.0).fit(df)
    q = softmax(np.tile(one.start, (len(x), 1)))
    for k in range(3):
        g, h = q[:, k] - (truth == k), q[:, k] * (1 - q[:, k])
        best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)), j, v) for j in (0, 1) for v in np.unique(x[~np.isnan(x[:, j]), j]) for left in [np.isnan(x[:, j]) | (x[:, j] < v)])
        left = np.isnan(x[:, best[1]]) | (x[:, best[1]] < best[2])
        want = np.where(left, -0.3 * g[left].sum() / (h[left].sum() + 1), -0.3 * g[~left].sum() / (h[~left].sum() + 1))
        got = one.trees[0][k].scores(one.binned(x))
        assert np.allclose(got, want)


def test_boosting_compares_whole_columns():
    """Nodes are those of a walk of each row, and no array as long as the batch serves to look rows up; batches may be slices of others."""
    import pyarrow as pa

    from tidecast.operators.boosting import BoostedClasses, Tree

    class Bins(np.ndarray):
        def __getitem__(self, key):
            assert not (isinstance(key, tuple) and isinstance(key[0], np.ndarray)), "rows are looked up one by one"
            return super().__getitem__(key)

    rng = np.random.default_rng(5)
    bins = rng.integers(0, 9, (200, 4)).astype(np.uint8)
    for _ in range(20):
        tree = Tree(3)
        tree.column, tree.cut, tree.values = rng.integers(-1, 4, 7), rng.integers(0, 8, 7), rng.normal(size=8)
        for levels in range(4):
            want = []
            for row in bins:
                at = 0
                for level in range(levels):
                    i = at + 2**level - 1
                    at = 2 * at + int(tree.column[i] >= 0 and row[tree.column[i]] > tree.cut[i])
                want.append(at)
            assert np.asarray(tree.nodes(bins.view(Bins), levels)).tolist() == want
    start = rng.normal(size=(200, 3))
    batch = pa.record_batch([pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([1] * 200, pa.int32()), pa.array([1.0] * 200), pa.array([s.tobytes() for s in start], pa.binary())], names=["b", "y", "w", "s"])
    got, score = BoostedClasses(list("abcd")).read(batch.slice(30, 50), [[tree] * 3])
    assert got.tolist() == bins[30:80].tolist() and np.array_equal(score, start[30:80] + tree.scores(bins[30:80])[:, None])
    assert got.flags.f_contiguous


def test_low_score_correction_against_a_fine_grid(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0.5, 2, 3000), rng.uniform(0.4, 1.6, 3000)
    g = np.stack([rng.poisson(a), rng.poisson(b)], 1)
    low = (g <= 1).all(1)
    keep = ~low | (g[:, 0] == g[:, 1]) | (rng.random(3000) < 0.7)  # draws are more frequent than independent goals have them
    a, b, g = a[keep], b[keep], g[keep]
    df = spark.createDataFrame([(float(x), float(y), int(m), int(n)) for x, y, (m, n) in zip(a, b, g)], "lambda1 double, lambda2 double, team1_goals int, team2_goals int")

    def gain(r):
        tau = np.select([(g == [0, 0]).all(1), (g == [0, 1]).all(1), (g == [1, 0]).all(1), (g == [1, 1]).all(1)], [1 - a * b * r, 1 + a * r, 1 + b * r, np.full(len(a), 1 - r)], 1.0)
        return np.log(np.maximum(tau, 1e-10)).sum()

    grid = np.linspace(-0.2, 0.2, 8001)
    best = grid[int(np.argmax([gain(r) for r in grid]))]
    assert models.fit_rho(df) == pytest.approx(best, abs=2e-4) and abs(best) > 0.02


def test_elo_baseline_is_the_model_of_its_columns(spark, rows):
    named = rows.withColumnsRenamed({"a": "elo_diff_pre", "b": "days_rest_diff"})
    p = probabilities(models.elo_baseline(["x", "days_rest_diff", "elo_diff_pre"]).fit(named).predict(named))
    assert np.allclose(p, probabilities(models.Multinomial(["elo_diff_pre", "days_rest_diff"]).fit(named).predict(named)), atol=1e-6)


def test_finalise_fits_its_folds_in_the_same_passes(spark, monkeypatch):
    from tidecast.plans import scoring_queries

    def alone(*_, **__):
        raise AssertionError("linear models are fitted one by one")

    monkeypatch.setattr(scoring_queries.X, "backtest_log", alone)
    rows = scoring_queries.m22_finalise(spark, "/root/testdata/sf0.001").collect()
    assert {(r.model, r.split) for r in rows} == {(m, s) for m in ("baseline", "logistic", "poisson", "blend") for s in ("validation", "holdout")}
