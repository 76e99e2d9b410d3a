"""Queries that work on all of their table, whatever part of it an oracle can check."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidecast.operators import history, ratings
from tidecast.plans import features
from tidecast.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def union_find(pairs):
    parent = {}

    def find(t):
        parent.setdefault(t, t)
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {t: find(t) for t in parent}


def test_pools_of_all_matches(spark):
    played = [(r.team1, r.team2) for r in view(spark, SF, "matches").collect()]
    assert {r.team: r.pool for r in entry.queries()["w11_pools"](spark, SF).collect()} == union_find(played)


def test_pools_of_many_components(spark):
    rng = random.Random(3)
    played = [(f"L{k}T{i}", f"L{k}T{rng.randrange(max(0, i - 2), i)}") for k in range(12) for i in range(1, 2 + 5 * k)]
    rng.shuffle(played)
    got = ratings.team_pools(spark.createDataFrame(played, "team1 string, team2 string")).collect()
    assert {r.team: r.pool for r in got} == union_find(played) and len({r.pool for r in got}) == 12


def test_ratings_carry_over_between_tournaments(spark):
    """One rating per team: each rating follows from the team's last match, whatever its tournament."""
    got = {r.match_id: r for r in entry.queries()["w11_elo"](spark, SF).collect()}
    rows = sorted(view(spark, SF, "matches").collect(), key=lambda r: (r.kickoff_utc, r.match_id))
    rating, played, checked = {}, {}, 0
    for day in sorted({r.kickoff_utc for r in rows}):
        batch, change = [r for r in rows if r.kickoff_utc == day], {}
        now = {}
        for r in batch:
            for t in (r.team1, r.team2):
                years = (day - played.get(t, day)).total_seconds() / (365.25 * 86400)
                now[t] = 1500 + (rating.get(t, 1500.0) - 1500) * 0.9**years
        for r in batch:
            x = got[r.match_id]
            assert abs(x.elo_team1_pre - now[r.team1]) < 1e-5 and abs(x.elo_team2_pre - now[r.team2]) < 1e-5
            expected = 1 / (1 + 10 ** ((now[r.team2] - now[r.team1] - (0 if r.neutral else 60)) / 400))
            gap = r.team1_goals - r.team2_goals
            delta = 20 * x.elo_importance * (1 + math.log(max(1, abs(gap)))) * (0.5 + 0.5 * ((gap > 0) - (gap < 0)) - expected)
            change[r.team1] = change.get(r.team1, 0.0) + delta
            change[r.team2] = change.get(r.team2, 0.0) - delta
            checked += 1
        for t in now:
            rating[t], played[t] = now[t] + change[t], day
    assert checked == len(got) > 100


def test_checksums_cover_the_growing_table(spark):
    out = entry.queries()["s13_checksums"](spark, SF)
    rows = spark.read.json(sorted(set(out.inputFiles())))
    assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert out.count() == len(set(out.inputFiles())) and out.where(F.col("wanted") != "0").isEmpty()


@pytest.mark.parametrize("gate", ["kickoff", "available"])
def test_slices_of_time_hand_on_their_state(spark, monkeypatch, gate):
    """Ratings in many slices are those of one pass."""
    matches = view(spark, SF, "matches").orderBy("match_id").limit(400).withColumn("half", F.length("team1") % 2)
    cfg = ratings.Elo(gate=gate)
    whole = {r.match_id: r for r in ratings.elo_features(matches, cfg, pool="half").collect()}
    strengths = {r.match_id: r for r in ratings.online_strengths(matches).collect()}
    monkeypatch.setattr(ratings, "SLICE_ROWS", 90)
    assert {r.match_id: r for r in ratings.elo_features(matches, cfg, pool="half").collect()} == whole and len(whole) == 400
    assert {r.match_id: r for r in ratings.online_strengths(matches).collect()} == strengths


def test_opponents_rating_adjusts_the_goal_difference(spark):
    """In the whole table a win over a stronger side counts for more."""
    rows = [("1", "2020-01-01", "a", "b", 1, 0), ("2", "2020-02-01", "a", "c", 0, 0), ("3", "2020-02-01", "b", "c", 0, 0), ("4", "2020-03-01", "a", "d", 0, 0)]
    m = spark.createDataFrame(rows, "match_id string, day string, team1 string, team2 string, team1_goals int, team2_goals int")
    m = m.select("*", F.to_timestamp("day").alias("kickoff_utc"), F.to_timestamp("day").alias("available_at"), F.lit("Friendly").alias("tournament"), F.lit(True).alias("neutral"))
    elo = {"1": (1900.0, 1500.0), "2": (1500.0, 1500.0), "3": (1500.0, 1500.0), "4": (1500.0, 1500.0)}
    rated = m.join(spark.createDataFrame([(k, *v) for k, v in elo.items()], "match_id string, elo_team1_pre double, elo_team2_pre double"), "match_id")
    sides = {(r.match_id, r.side): r.opponent_adjusted_goal_diff for r in history.team_rows(rated, elo=("elo_team1_pre", "elo_team2_pre")).collect()}
    assert sides[("1", "team1")] == 1.0 and sides[("1", "team2")] == 0.0
    table = {r.match_id: r for r in features.feature_table(m).collect()}
    pre = {r.match_id: r for r in ratings.elo_features(m).collect()}
    want = 0 + (pre["2"].elo_team2_pre - 1500) / 400  # a's last match before the fourth was that with c
    both = (1.0 + (pre["1"].elo_team2_pre - 1500) / 400 + want) / 2
    assert abs(table["4"].team1_opponent_adjusted_goal_diff_roll5 - both) < 1e-9


def test_feature_table_holds_every_part(spark):
    """Each column of the whole table is that of the operator it comes from (which brute force checks elsewhere), or follows from others of its row."""
    from tidecast.operators import scorers

    m, goals = view(spark, SF, "matches"), view(spark, SF, "goals")
    key = lambda rows: {r.match_id: r for r in rows.collect()}
    whole = key(features.feature_table(m, goals=goals, advanced=True))
    elo = ratings.elo_features(m)
    rated = m.join(elo, "match_id")
    parts = [elo, history.rolling_features(rated, (5, 10), elo=("elo_team1_pre", "elo_team2_pre")), history.head_to_head(m), scorers.scorer_features(m, goals), history.prior_counts(m), ratings.online_strengths(m)]
    seen = set()
    for part in parts:
        for k, r in key(part).items():
            for c in part.columns:
                x, y = r[c], whole[k][c]
                assert x == y or (isinstance(x, float) and abs(x - y) < 1e-9), (k, c)
        seen |= set(part.columns)
    assert len(whole) == m.count() and len(seen) > 100
    for r in list(whole.values())[:200]:
        assert r.outcome == (2 if r.team1_goals > r.team2_goals else 1 if r.team1_goals == r.team2_goals else 0) and r.neutral_int == int(r.neutral)
