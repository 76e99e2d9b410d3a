"""What slices of ratings write and hand on: small states in columns, only the results that are asked for, changes that wait by whole arrays."""

import random
import time

import numpy as np
import pandas as pd

from tests.test_ratings import collected, season, table
from tidecast.operators import ratings


def plain_strengths(pdf, cfg):
    """Match by match, each team with a list of what is not known yet."""
    state, out = {}, {}
    for now, batch in sorted(pdf.sort_values(["k", "match_id"]).groupby("k"), key=lambda x: x[0]):
        seen = {}
        for t in {*batch["team1"], *batch["team2"]}:
            up, down, played, pending = state.get(t, (0.0, 0.0, None, []))
            for _, u, d in (p for p in pending if p[0] < now):
                up, down = up + u, down + d
            fade = 1.0 if played is None else 0.5 ** (max(0, now - played) / ratings.YEAR_MICROS / cfg.half_life_years)
            seen[t] = state[t] = (up * fade, down * fade, now, [p for p in pending if p[0] >= now])
        for r in batch.itertuples():
            (u1, d1, *_), (u2, d2, *_) = seen[r.team1], seen[r.team2]
            home = 0.0 if r.neutral else cfg.home_log_advantage
            x, y = (min(max(r.goals_rate * np.exp(v), 0.15), 5.0) for v in (u1 - d2 + home, u2 - d1))
            a, b = (cfg.learning_rate * min(max(g - v, -cfg.max_residual), cfg.max_residual) for g, v in ((r.team1_goals, x), (r.team2_goals, y)))
            state[r.team1][3].append((r.a, a, -b))
            state[r.team2][3].append((r.a, b, -a))
            out[r.match_id] = (u1, d1, u2, d2, x, y)
    return out


def matches(n, days, teams, late, seed=5):
    rng, day = random.Random(seed), 86_400_000_000
    rows = []
    for i in range(n):
        d, (x, y) = rng.randrange(days), rng.sample(range(teams), 2)
        rows.append((f"m{i:06}", d * day, (d + rng.choice([0, 0, 1, late])) * day + 1, f"T{x}", f"T{y}", rng.randrange(5), rng.randrange(4), rng.random() < 0.3, 1.25))
    return pd.DataFrame(rows, columns=["match_id", "k", "a", "team1", "team2", "team1_goals", "team2_goals", "neutral", "goals_rate"])


def test_late_changes_wait_by_whole_arrays():
    cfg = ratings.OnlinePoisson()
    pdf = matches(2_000, 60, 25, 20)
    want = plain_strengths(pdf, cfg)
    got, states = ratings.StrengthRun(cfg).run(pdf, {})
    for r in got.itertuples():
        mine = (r.online_attack_team1_pre, r.online_defence_team1_pre, r.online_attack_team2_pre, r.online_defence_team2_pre, r.online_lambda_team1_pre, r.online_lambda_team2_pre)
        assert np.allclose(mine, want[r.match_id], atol=1e-9)
    # handed on in the middle, late results and all
    cut = pdf["k"] < pdf["k"].median()
    _, half = ratings.StrengthRun(cfg).run(pdf[cut], {})
    rest, again = ratings.StrengthRun(cfg).run(pdf[~cut], half)
    assert any(s[3] for s in half.values())
    assert np.allclose(rest["online_lambda_team1_pre"], [want[m][4] for m in rest["match_id"]], atol=1e-9)
    assert np.allclose([again[t][0] for t in sorted(again)], [states[t][0] for t in sorted(again)], atol=1e-9)


def test_a_match_costs_no_python_steps():
    """No step by match: 60,000 matches of 60 kickoffs take a small part of what going match by match takes."""
    cfg, pdf = ratings.OnlinePoisson(), matches(60_000, 60, 3_000, 3)
    began = time.process_time()
    ratings.StrengthRun(cfg).run(pdf, {})
    fast = time.process_time() - began
    began = time.process_time()
    plain_strengths(pdf, cfg)
    assert fast < (time.process_time() - began) / 2.5


def test_slices_write_only_what_is_asked(spark, monkeypatch, tmp_path):
    m = table(spark, season(7, n=300))
    whole = collected(ratings.elo_features(m))
    monkeypatch.setattr(ratings, "SLICE_ROWS", 40)
    monkeypatch.setattr(ratings, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    got = collected(ratings.elo_features(m, windows=(), columns=["elo_diff_pre"]))
    assert set(got) == set(whole) and all(r.asDict().keys() == {"match_id", "elo_diff_pre"} and abs(r.elo_diff_pre - whole[k].elo_diff_pre) < 1e-9 for k, r in got.items())
    written = spark.read.parquet(f"{tmp_path}/ratings/run")
    assert set(written.columns) == {"match_id", "elo_diff_pre", "team", "rating", "played", "known", "past", "pending", "to", "to_bin"}
    # a state is three numbers and no bytes, and goes to the team's next slice alone
    states = written.where(f"to <> {ratings.RESULTS}")
    assert states.count() > 80 and states.where("past is not null or pending is not null or rating is null").count() == 0
