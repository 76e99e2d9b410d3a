"""History, as-of joins and ratings on small tables: strictness, gating, order independence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import asof, history, ratings

UTC = dt.timezone.utc


def day(n, hour=0):
    return dt.datetime(2020, 1, 1, hour, tzinfo=UTC) + dt.timedelta(days=n)


def table(spark, rows):
    """(id, day, team1, team2, goals1, goals2[, available day])"""
    data = [(r[0], day(r[1]), r[2], r[3], r[4], r[5], day(r[6]) if len(r) > 6 else day(r[1], 3), "Friendly", True) for r in rows]
    return spark.createDataFrame(data, "match_id string, kickoff_utc timestamp, team1 string, team2 string, team1_goals int, team2_goals int, available_at timestamp, tournament string, neutral boolean")


def by_side(df, *columns):
    return {(r.match_id, r.side): tuple(r[c] for c in columns) for r in df.collect()}


def test_equal_times_do_not_join(spark):
    asked = spark.createDataFrame([(1, "A", day(5)), (2, "A", day(6)), (3, "B", day(6)), (4, "A", day(900))], "id int, team string, t timestamp")
    rated = spark.createDataFrame([("A", day(1), 1500.0), ("A", day(5), 9999.0)], "team string, at timestamp, points double")
    got = {r.id: r.points for r in asof.latest_before(asked, rated, ["team"], "t", "at", ["points"]).collect()}
    assert got == {1: 1500.0, 2: 9999.0, 3: None, 4: 9999.0}


@pytest.mark.parametrize("bucket", [1, 30, 5000])
def test_prefix_does_not_depend_on_buckets(spark, bucket):
    events = spark.createDataFrame([(k, t, v) for k in "ab" for t, v in [(1, 1), (40, 2), (40, 3), (400, 4)]], "k string, t long, v int")
    asked = spark.createDataFrame([(k, t) for k in "abc" for t in (0, 1, 2, 40, 41, 500)], "k string, q long")
    t = F.col("t") * asof.DAY_MICROS
    got = asof.prefix(asked, events, ["k"], F.col("q") * asof.DAY_MICROS, t, sums={"s": F.col("v")}, maxima={"m": F.col("v")}, bucket_days=bucket)
    want = {0: (0, None), 1: (0, None), 2: (1, 1), 40: (1, 1), 41: (6, 3), 500: (10, 4)}
    for r in got.collect():
        assert (r.s, r.m) == (want[r.q] if r.k != "c" else (0, None))


def test_last_means_and_batches(spark):
    m = table(spark, [("1", 0, "A", "B", 3, 0), ("2", 1, "A", "C", 1, 0), ("3", 2, "A", "D", 2, 0), ("4", 2, "A", "E", 0, 0)])
    got = by_side(history.last_means(history.team_rows(m), [2], ["goals_for"]), "goals_for_roll2")
    assert got[("1", "team1")] == (None,) and got[("2", "team1")] == (3.0,) and got[("3", "team1")] == (2.0,) and got[("4", "team1")] == (2.0,)


def test_pending_results_are_not_seen(spark):
    rows = [("1", 0, "A", "B", 3, 0, 10), ("2", 1, "A", "C", 1, 0), ("3", 2, "A", "D", 0, 1), ("4", 10, "A", "E", 0, 0), ("5", 11, "A", "F", 0, 0)]
    m = table(spark, rows)
    r = history.team_rows(m)
    got = by_side(history.last_means(r, [2], ["goals_for"]), "goals_for_roll2")
    assert got[("3", "team1")] == (1.0,) and got[("4", "team1")] == (0.5,) and got[("5", "team1")] == (0.0,)
    streaks = by_side(history.streaks(r), "win_streak", "loss_streak", "unbeaten_streak")
    assert streaks[("3", "team1")] == (1.0, 0.0, 1.0) and streaks[("4", "team1")] == (0.0, 1.0, 0.0) and streaks[("5", "team1")] == (0.0, 0.0, 1.0)
    rest = by_side(history.recency(r), "days_rest")
    assert rest[("4", "team1")] == (8.0,) and rest[("1", "team1")] == (None,)


def test_results_do_not_depend_on_row_order(spark):
    rows = [(str(i), i % 17, f"T{i % 5}", f"U{i % 7}", i % 4, i % 3, i % 17 + i % 6) for i in range(120)]
    one = history.rolling_features(table(spark, rows), [3]).orderBy("match_id").collect()
    two = history.rolling_features(table(spark, rows[::-1]).repartition(7), [3]).orderBy("match_id").collect()
    near = lambda x, y: x == y or (isinstance(x, float) and abs(x - y) < 1e-9)
    assert all(near(x, y) for a, b in zip(one, two) for x, y in zip(a, b))


def test_elo_by_hand(spark):
    m = table(spark, [("1", 0, "A", "B", 1, 0), ("2", 0, "A", "C", 0, 0), ("3", 0, "X", "Y", 1, 0), ("4", 400, "A", "B", 0, 3)])
    got = {r.match_id: r for r in ratings.elo_features(m, windows=(1,)).collect()}
    assert got["1"].elo_team1_pre == got["2"].elo_team1_pre == 1500.0  # one batch
    keep = 0.9 ** (400 / 365.25)
    assert got["4"].elo_team1_pre == pytest.approx(1500 + 5 * keep) and got["4"].elo_team2_pre == pytest.approx(1500 - 5 * keep)
    assert got["4"].elo_momentum_team1_roll1 == pytest.approx(5 * keep)
    pools = {r.team: r.pool for r in ratings.team_pools(m).collect()}
    assert pools == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}


def test_elo_gate(spark):
    m = table(spark, [("1", 0, "A", "B", 1, 0, 5), ("2", 1, "A", "B", 1, 0), ("3", 6, "A", "B", 1, 0)])
    got = {r.match_id: r.elo_team1_pre for r in ratings.elo_features(m, ratings.Elo(gate="available")).collect()}
    assert got["2"] == 1500.0 and got["3"] > 1505


def test_online_strengths_by_hand(spark):
    m = table(spark, [("1", 0, "A", "B", 3, 0), ("2", 1, "A", "B", 0, 0)])
    got = {r.match_id: r for r in ratings.online_strengths(m).collect()}
    assert got["1"].online_lambda_team1_pre == pytest.approx(1.25)
    assert got["2"].online_attack_team1_pre == pytest.approx(0.035 * 1.75 * 0.5 ** (1 / 365.25 / 4))
    assert got["2"].online_global_goals_pre == pytest.approx(253 / 202)


def test_head_to_head_orientation(spark):
    m = table(spark, [("1", 0, "B", "A", 2, 0), ("2", 1, "A", "B", 1, 1), ("3", 2, "A", "B", 0, 0), ("4", 3, "B", "A", 0, 0)])
    got = {r.match_id: r for r in history.head_to_head(m).collect()}
    assert got["1"].h2h_total_matches == 0 and got["1"].h2h_last_outcome == 0
    assert got["2"].h2h_last_outcome == -1 and got["2"].h2h_team2_win_pct == 1
    assert got["3"].h2h_team1_goals_mean == 0.5 and got["4"].h2h_team1_goals_mean == 1.0
