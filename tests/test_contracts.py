"""Contracts, sources, names, scoring, standings and models on small tables."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import columns as C
from tidecast.functions import score_matrix
from tidecast.operators import calibration, contracts, models, scorers, scoring, search, squads, standings
from tidecast.sources import names, readers

RAW = "date string, team1 string, team2 string, team1_goals string, team2_goals string, tournament string, neutral string"


def rules(spark, *rows):
    _, violations = contracts.canonical_matches(spark.createDataFrame(list(rows), RAW))
    return sorted(r.rule for r in violations.collect())


def test_match_contract(spark):
    good = ("2020-01-01", " A ", "B", "1", "0", "Friendly", " Yes ")
    matches, violations = contracts.canonical_matches(spark.createDataFrame([good], RAW))
    row = matches.first()
    assert violations.isEmpty() and (row.team1, row.neutral, row.team1_goals) == ("A", True, 1)
    assert row.available_at - row.kickoff_utc == dt.timedelta(hours=3) and len(row.match_id) == 20
    assert rules(spark, (*good[:3], "-1", "0.5", *good[5:])) == ["goals"]
    assert rules(spark, ("2020-01-01", "A", "A", "1", "0", "x", "no")) == ["same team", "team twice"]
    assert rules(spark, (None, "A", "B", "1", "0", "x", "perhaps")) == ["kickoff", "neutral"]
    assert rules(spark, good, ("2020-01-01", "B", "A", "1", "0", "x", "no")) == ["repeated pair", "team twice", "team twice"]
    assert rules(spark, good, ("2020-01-01", "A", "C", "1", "0", "x", "no")) == ["team twice"]


def test_preparation(spark):
    rows = [
        ("2019-01-01", "A", "B", 1, 0, "t", "c", "x", "no"), ("2020-01-01", "A", "B", None, 0, "t", "c", "x", "no"), ("2020-01-02", "A", "B", None, None, "t", "c", "x", "no"),
        ("2021-06-01", "A", "B", 1, 0, "t", "c", "x", "no"), ("2020-03-01", "A", "B", 1, 0, "t", "c", "x", "no"), ("2020-03-01", "A", "C", 1, 0, "t", "c", "x", "no"), ("2020-04-01", "A", "B", 1, 0, "t", "c", "x", "no"),
    ]
    raw = spark.createDataFrame(rows, "date string, home_team string, away_team string, home_score int, away_score int, tournament string, city string, country string, neutral string")
    audit = contracts.preparation_audit(contracts.completed_results(raw, "2020-01-01", "2021-01-01")).first()
    assert (audit.n_input, audit.n_kept, audit.n_pre_start, audit.n_incomplete, audit.n_after_cutoff, audit.n_ambiguous, audit.n_teams) == (7, 1, 1, 2, 1, 2, 2)


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    one = contracts.fingerprint(df).first()
    assert one == contracts.fingerprint(df.orderBy(F.desc("x")).select("y", "x")).first() and one != contracts.fingerprint(df.distinct()).first()


def test_names(spark):
    aliases = spark.createDataFrame([("United States", "USA"), ("Netherlands", "Holland")], "canonical string, alias string")
    df = spark.createDataFrame([(" usa ", "Unknown  Team"), ("ＨＯＬＬＡＮＤ", "Netherlands")], "a string, b string")
    got = [tuple(r) for r in names.resolve_names(df, aliases, ["a", "b"]).collect()]
    assert sorted(got) == [("Netherlands", "Netherlands"), ("United States", "Unknown  Team")]
    report = names.name_report(df, aliases, ["a", "b"]).first()
    assert (report.total_values, report.alias_matches, report.unresolved) == (4, 2, ["Unknown  Team"])
    clash = aliases.union(spark.createDataFrame([("Mexico", "usa")], "canonical string, alias string"))
    assert [tuple(r) for r in names.alias_conflicts(clash).collect()] == [("usa", 2)]


def test_fixtures(spark):
    plain = {"matches": [{"num": 1, "round": "Matchday 1", "date": "2026-06-11", "time": "13:00 UTC-6", "team1": "Mexico", "team2": {"name": "South Africa"}, "group": "Group A"}, {"date": "2026-07-01", "team1": "W101", "team2": "Winner X"}]}
    nested = {"rounds": [{"name": "Final", "matches": [{"id": "f", "kickoff_utc": "2026-07-19T19:00:00Z", "team1": "W1", "team2": None}]}]}
    df = spark.createDataFrame([("a", json.dumps(plain)), ("b", json.dumps(nested))], "source string, payload string")
    rows = {(r.source, r.match_id): r for r in readers.parse_fixtures(df).collect()}
    first = rows[("a", "1")]
    assert (first.team2, first.group, first.stage, first.team1_open) == ("South Africa", "A", "Matchday 1", False)
    assert first.kickoff_utc.astimezone(dt.timezone.utc).hour == 19 if first.kickoff_utc.tzinfo else True
    assert rows[("a", "2")].team1_open and rows[("a", "2")].team2_open and rows[("b", "f")].team2 == "UNRESOLVED" and rows[("b", "f")].stage == "Final"
    assert readers.repeated_fixture_ids(readers.parse_fixtures(df.union(df))).count() == 3


def test_pages(spark):
    ranking = {"dates": [{"dates": [{"id": "id1", "iso": "2024-04-04T10:00:00Z"}]}], "allAvailableDates": [{"id": "id1", "date": "2024-04-03"}, {"id": "id2", "date": "2024-05-01", "matchWindowEndDate": "2024-05-02"}, {"id": "id2", "date": "2000-01-01"}]}
    page = '<p></p><script type="x" id="__NEXT_DATA__">' + json.dumps({"buildId": "b", "props": {"pageProps": {"pageData": {"ranking": ranking}}}}).replace('"', "&quot;") + "</script>"
    df = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "page_id int, html string")
    got = {r.schedule_id: r.at for r in readers.page_schedules(df).select("schedule_id", F.date_format("published_at", "yyyy-MM-dd HH").alias("at")).collect()}
    assert got == {"id1": "2024-04-04 10", "id2": "2024-05-03 00"}


PROBS = "outcome int, p_team2_win double, p_draw double, p_team1_win double, yr int"


def test_metrics(spark):
    perfect = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1), (1, 0.0, 1.0, 0.0, 1), (2, 0.0, 0.0, 1.0, 1)], PROBS)
    row = scoring.evaluate(perfect).first()
    assert row.log_loss == pytest.approx(0) and row.brier == row.rps == row.ece == 0 and row.accuracy == row.sharpness == 1
    even = scoring.evaluate(spark.createDataFrame([(2, 1 / 3, 1 / 3, 1 / 3, 1)], PROBS)).first()
    assert even.log_loss == pytest.approx(np.log(3)) and even.accuracy == 0  # the first index at ties
    bad = spark.createDataFrame([(0, 0.5, 0.5, 0.1, 1), (0, None, 0.5, 0.5, 1), (0, 0.5, 0.25, 0.25, 1)], PROBS)
    assert tuple(contracts.probability_report(bad).first()) == (3, 1, 1)


def test_selective(spark):
    log = spark.createDataFrame([(2, 0.1, 0.2, 0.7, 1), (0, 0.6, 0.2, 0.2, 1), (1, 0.4, 0.3, 0.3, 2)], PROBS)
    pooled = next(r for r in scoring.selective(log, 0.5).collect() if r.yr is None)
    assert (pooled.n, pooled.n_selected, pooled.selected_accuracy) == (3, 2, 1.0)
    none = next(r for r in scoring.selective(log, 0.5).collect() if r.yr == 2)
    assert none.selected_accuracy is None
    assert scoring.stable_threshold(log.where("yr = 1"), least=1, thresholds=[0.5, 0.65, 0.9]).first()[0] == 0.5
    assert scoring.stable_threshold(log, least=1, target=1.0, thresholds=[0.5]).first()[0] is None


def test_odds(spark):
    df = spark.createDataFrame([(2.0, 4.0, 4.0), (1.0, 3.0, 3.0)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(*contracts.implied_probabilities(["a", "b", "c"])).collect()]
    assert got == [(0.5, 0.25, 0.25), (None, None, None)]


def test_score_matrix(spark):
    df = spark.createDataFrame([(1.4, 0.9)], "a double, b double").withColumn("matrix", score_matrix.cells("a", "b"))
    row = df.select("matrix", *score_matrix.outcome_probabilities(), *score_matrix.expected_goals()).first()
    from math import exp, factorial

    raw = {(i, j): exp(-1.4) * 1.4**i / factorial(i) * exp(-0.9) * 0.9**j / factorial(j) for i in range(8) for j in range(8)}
    total = sum(raw.values())
    assert sum(c.p for c in row.matrix) == pytest.approx(1) and len(row.matrix) == 64
    assert row.p_draw == pytest.approx(sum(p for (i, j), p in raw.items() if i == j) / total)
    assert row.team1_xg == pytest.approx(sum(i * p for (i, _), p in raw.items()) / total)


def test_group_ranking(spark):
    rows = [("g", "A", "B", 1, 0), ("g", "A", "C", 0, 3), ("g", "B", "C", 5, 0), ("g", "A", "D", 1, 0), ("g", "B", "D", 1, 1), ("g", "C", "D", 0, 0)]
    results = spark.createDataFrame(rows, "grp string, team1 string, team2 string, team1_goals int, team2_goals int")
    got = {r.team: r for r in standings.rank_groups(results).collect()}
    assert got["A"].points == 6 and got["A"].position == 1
    assert got["B"].points == got["C"].points == 4 and got["B"].position == 2  # B beat C
    even = spark.createDataFrame([("g", "A", "B", 0, 0), ("g", "C", "D", 0, 0)], results.schema)
    extra = spark.createDataFrame([("g", t, c, r) for t, c, r in (("A", -1, 1), ("B", 0, 9), ("C", 0, 2), ("D", 0, 3))], "grp string, team string, conduct int, rank int")
    order = [r.team for r in standings.rank_groups(even, extra).orderBy("position").collect()]
    assert order == ["C", "D", "B", "A"]  # conduct before rank


def test_squads(spark):
    rows = [("s", f"p{i}", "A", dt.datetime(2020, 1, 1), 50.0 + i, "available" if i else "injured", "starter" if i < 3 else "bench") for i in range(13)]
    df = spark.createDataFrame(rows, "snapshot_id string, player_id string, team string, available_at timestamp, player_rating double, availability_status string, lineup_status string")
    df = df.withColumns({"position": F.lit("DF"), "start_probability": F.lit(0.5), "expected_minutes": F.lit(None).cast("double"), "age_years": F.lit(25.0)})
    row = squads.squad_rows(df).first()
    assert (row.squad_size, row.unavailable_count, row.official_starter_count) == (13, 1, 3)
    assert row.rating_top11 == np.mean([52 + i for i in range(11)]) == row.available_rating_top11 and row.expected_xi_rating == 51.5
    assert squads.snapshot_violations(df).isEmpty()
    assert [r.rule for r in squads.snapshot_violations(df.union(df.limit(1))).collect()] == ["repeated player"]


def synthetic(spark, n=1200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    z = np.column_stack([-x[:, 0], 0.3 * x[:, 1], x[:, 0]])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    goals = rng.poisson(np.exp(0.2 + 0.4 * x))
    rows = [(f"m{i}", dt.datetime(2015, 1, 1) + dt.timedelta(days=i), float(x[i, 0]), float(x[i, 1]) if i % 9 else None, y[i], int(goals[i, 0]), int(goals[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "match_id string, kickoff_utc timestamp, a double, b double, outcome int, team1_goals int, team2_goals int")


def test_models_beat_the_prior(spark):
    df = synthetic(spark).cache()
    train, test = df.where("kickoff_utc < '2017-06-01'"), df.where("kickoff_utc >= '2017-06-01'")
    loss = lambda m: scoring.evaluate(m.fit(train).predict(test)).first()["log_loss"]
    base = loss(search.Prior())
    assert loss(models.Multinomial(["a", "b"])) < base - 0.1 and loss(models.TwoStage(["a", "b"])) < base - 0.1
    fitted = models.TwoPoisson(["a", "b"], alpha=0.0).fit(train)
    assert fitted.betas[0][1] == pytest.approx(0.4, abs=0.1)
    out = models.DixonColes(["a", "b"]).fit(train).predict(test)
    assert contracts.probability_report(out).first()["n_sum"] == 0


def test_calibration_and_blending(spark):
    df = synthetic(spark).cache()
    sharp = models.Multinomial(["a", "b"]).fit(df).predict(df)
    over = sharp.withColumns(dict(zip(C.PROBABILITIES, calibration.tempered(0.4))))
    fit = calibration.Temperature().fit(over)
    assert 1.8 < fit.temperature < 3.2
    loss = lambda d: scoring.evaluate(d).first()["log_loss"]
    assert loss(fit.transform(over)) < loss(over) and loss(calibration.Sigmoid().fit(over).transform(over)) < loss(over)
    assert loss(calibration.Isotonic().fit(over).transform(over)) < loss(over)
    with pytest.raises(ValueError):
        calibration.Isotonic().fit(over.limit(10))
    both = sharp.select("*", *(F.lit(1 / 3).alias(f"u_{c}") for c in C.PROBABILITIES))
    w = calibration.blend_weights(both, [C.PROBABILITIES, [f"u_{c}" for c in C.PROBABILITIES]])
    assert sum(w) == pytest.approx(1) and w[0] > 0.8


def test_folds(spark):
    folds = search.annual_folds(spark, 2016, 2017)
    roles = search.fold_roles(synthetic(spark), folds).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in roles} == {("2016", "train"): 365, ("2016", "test"): 366, ("2017", "train"): 731, ("2017", "test"): 365}
    split = dict(search.chronological_split(synthetic(spark, 100)).groupBy("split").count().collect())
    assert split == {"train": 60, "tune": 20, "test": 20}


def test_scorers(spark):
    t = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    m = spark.createDataFrame([("1", t(0), "A", "B", 2, 0, t(0.2)), ("2", t(10), "A", "C", 1, 0, t(10.2)), ("3", t(800), "A", "B", 0, 0, t(801))], "match_id string, kickoff_utc timestamp, team1 string, team2 string, team1_goals int, team2_goals int, available_at timestamp")
    g = spark.createDataFrame([("1", t(0), "A", "B", "A", "x", False, True), ("1", t(0), "A", "B", "A", "y", False, False)], "match_id string, kickoff_utc timestamp, team1 string, team2 string, team string, scorer string, own_goal boolean, penalty boolean")
    got = {r.match_id: r for r in scorers.scorer_features(m, g).collect()}
    assert got["1"].team1_scorer_active_players == 0 and got["2"].team1_scorer_active_players == 2 and got["2"].team1_scorer_penalty_share == 0.5
    assert got["2"].team1_scorer_coverage == 1 and got["3"].team1_scorer_history_matches == 0


def test_whole_numbers(spark):
    df = spark.createDataFrame([("3",), ("-1",), ("0.5",), ("x",), (None,), ("99999999999",), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(C.nonnegative_int("v")).collect()] == [3, None, None, None, None, None, 7]
