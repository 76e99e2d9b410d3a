"""Sweeps against brute force: late results, hot teams cut into stretches, long ages, entry and expiry."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidecast.operators import history, scorers, sweep

UTC = dt.timezone.utc


def day(n):
    return dt.datetime(1900, 1, 1, tzinfo=UTC) + dt.timedelta(days=n)


def games(seed, n=400, teams=6, days=300, late=60, hot=0.4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        d = rng.randrange(days)
        x, y = (0, rng.randrange(1, teams)) if rng.random() < hot else rng.sample(range(teams), 2)
        rows.append((f"m{i:04}", d, f"T{x}", f"T{y}", rng.choice([0, 1, 1, 2, 5]), rng.choice([0, 0, 1, 2]), d + (rng.randrange(late) if rng.random() < 0.7 else 0)))
    return rows


def table(spark, rows):
    data = [(i, day(d), x, y, g, h, day(a)) for i, d, x, y, g, h, a in rows]
    return spark.createDataFrame(data, "match_id string, kickoff_utc timestamp, team1 string, team2 string, team1_goals int, team2_goals int, available_at timestamp")


def sides(rows):
    for i, d, x, y, g, h, a in rows:
        yield i, "team1", x, d, a, g, h
        yield i, "team2", y, d, a, h, g


def past(rows, team, d):
    """Known results of a team before day d, in order of kickoff: (day, goals for, goals against)."""
    found = sorted((k, i, s, g, h) for i, s, t, k, a, g, h in sides(rows) if t == team and k < d and a < d)
    return [(k, g, h) for k, _, _, g, h in found]


def streak(known, breaks):
    n = 0
    for _, g, h in reversed(known):
        if breaks(g, h):
            break
        n += 1
    return float(n)


def check(spark, rows, half_life=30.0):
    r = history.team_rows(table(spark, rows))
    got = {(x.match_id, x.side): x for x in history.side_history(r, [2, 5], history.STATS, half_life).collect()}
    assert len(got) == 2 * len(rows)
    for i, s, t, d, _, _, _ in sides(rows):
        known, x = past(rows, t, d), got[i, s]
        assert (x.win_streak, x.loss_streak, x.unbeaten_streak) == (streak(known, lambda g, h: g <= h), streak(known, lambda g, h: g >= h), streak(known, lambda g, h: g < h)), (i, s)
        if not known:
            assert x.goals_for_roll2 is x.goals_for_ewm is x.days_rest is None
            continue
        assert x.days_rest == d - known[-1][0]
        for n in (2, 5):
            last = known[-n:]
            assert abs(x[f"goals_for_roll{n}"] - sum(g for _, g, _ in last) / len(last)) < 1e-9
        newest = known[-1][0]
        w = [0.5 ** ((newest - k) / half_life) for k, _, _ in known]
        assert abs(x.goals_for_ewm - sum(a * g for a, (_, g, _) in zip(w, known)) / sum(w)) < 1e-9


@pytest.mark.parametrize("limit", [10**6, 40, 7])
def test_history_of_hot_teams_and_late_results(spark, monkeypatch, limit):
    monkeypatch.setattr(sweep, "SWEEP_ROWS", limit)
    check(spark, games(limit))


def test_long_streaks_are_counted(spark, monkeypatch):
    """One team wins hundreds of times with results up to 20 days late, with and without cuts."""
    rng = random.Random(2)
    rows = [(f"m{i:04}", i, "A", f"B{i % 3}", 0 if i in (3, 450) else 2, 1, i + rng.randrange(20)) for i in range(500)]
    check(spark, rows)
    monkeypatch.setattr(sweep, "SWEEP_ROWS", 90)
    check(spark, rows)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_half_life_of_a_day_over_150_years(spark, monkeypatch, limit):
    monkeypatch.setattr(sweep, "SWEEP_ROWS", limit)
    check(spark, games(9, n=80, days=150 * 365, late=2), half_life=1.0)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_scorers_against_pairs(spark, monkeypatch, limit):
    rows, rng = games(5, n=150, days=900, late=200), random.Random(5)
    m = table(spark, rows)
    struck = [(i, day(d), x, y, rng.choice([x, y]), rng.choice("pqrs"), rng.random() < 0.1, rng.random() < 0.3) for i, d, x, y, g, h, _ in rows for _ in range(rng.choice([g + h, g + h, 1]))]
    goals = spark.createDataFrame(struck, "match_id string, kickoff_utc timestamp, team1 string, team2 string, team string, scorer string, own_goal boolean, penalty boolean")
    monkeypatch.setattr(sweep, "SWEEP_ROWS", limit)
    got = {r.match_id: r for r in scorers.scorer_features(m, goals, half_life_days=20.0, window_days=100.5).collect()}
    by_id, n_events = {r[0]: r for r in rows}, {}
    for g in struck:
        n_events[g[1], g[2], g[3]] = n_events.get((g[1], g[2], g[3]), 0) + 1
    seen = 0
    for i, s, t, d, _, _, _ in sides(rows):
        w, p = {}, {}
        for g in struck:
            _, e, _, _, _, _, a = by_id[g[0]]
            if g[4] == t and not g[6] and e < d and a < d and e >= d - 100.5:
                x = 0.5 ** ((d - e) / 20)
                w[g[5]], p[g[5]] = w.get(g[5], 0) + x, p.get(g[5], 0) + x * g[7]
        total = sum(w.values())
        h = [r for r in rows if t in r[2:4] and r[1] < d and r[6] < d and r[1] >= d - 100.5]
        full = sum(n_events.get((day(r[1]), r[2], r[3]), 0) == r[4] + r[5] for r in h)
        top = sorted(w.values(), reverse=True)
        want = [len(w), total, top[0] if w else 0, sum(top[:3]) / total if w else 0, sum(x * x for x in top) / total**2 if w else 0, sum(p.values()) / total if w else 0, full, len(h), full / len(h) if h else 0]
        for n, x in zip(scorers.NAMES, want):
            assert abs(got[i][f"{s}_scorer_{n}"] - x) < 1e-9, (i, s, n)
        seen += bool(w)
    assert seen > 100


def test_plan_holds_no_window_and_no_list(spark):
    r = history.team_rows(table(spark, games(1, n=20)))
    plan = history.side_history(r, [5])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_null_keys_and_times(spark):
    rows = spark.createDataFrame([(None, 5, 0, "q", 0), ("a", None, 0, "r", 0), ("a", None, 1, "e", 4), ("a", 3, 1, "f", 2), ("a", 3, 0, "s", 0), ("a", 4, 0, "u", 0)], "team string, t long, tag int, id string, v int")

    class Sum:
        def __init__(self):
            self.n = 0

        def add(self, row):
            self.n += row[3]

        def answer(self, row):
            return [self.n]

    got = sweep.sweep(rows, ["team"], ["id"], ["v"], Sum, "n long").collect()
    assert sorted((r.id, r.n) for r in got) == [("q", 0), ("r", 0), ("s", 0), ("u", 2)]
    assert sweep.sweep(rows.limit(0), ["team"], ["id"], ["v"], Sum, "n long").collect() == []


def test_short_history_is_part_of_the_whole(spark):
    r = history.team_rows(table(spark, games(3, n=120)))
    key = lambda x: (x.match_id, x.side)
    whole = {key(x): x for x in history.side_history(r, [5]).collect()}
    counts = {key(x): x.n for x in history.prefix(r.select("match_id", "side", "team", "k"), r, ["team"], F.col("k"), history.known_from(), sums={"n": F.lit(1)}).collect()}
    for x in history.short_history(r, 5, ["goals_for", "win"], ["goal_diff"]).collect():
        y = whole[key(x)]
        assert (x.days_rest, x.goals_for_roll5, x.win_roll5, x.goal_diff_ewm) == (y.days_rest, y.goals_for_roll5, y.win_roll5, y.goal_diff_ewm) and x.prior_matches == counts[key(x)]
