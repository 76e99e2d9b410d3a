"""Ratings in slices, groups, single instants and streams are those of one pass over all matches."""

import datetime as dt
import pickle
import random

import pytest
from pyspark.sql import functions as F

from tidecast.operators import ratings
from tidecast.streaming import ratings as streamed

UTC = dt.timezone.utc


def table(spark, rows):
    """(id, day, team1, team2, goals1, goals2, available day)"""
    day = lambda n: dt.datetime(2020, 1, 1, tzinfo=UTC) + dt.timedelta(days=n)
    data = [(i, day(d), x, y, g, h, day(a), "FIFA World Cup" if d % 3 else "Friendly", d % 2 == 0, "A") for i, d, x, y, g, h, a in rows]
    return spark.createDataFrame(data, "match_id string, kickoff_utc timestamp, team1 string, team2 string, team1_goals int, team2_goals int, available_at timestamp, tournament string, neutral boolean, league string")


def season(seed, n=500, teams=80, days=60, hot=0.0):
    """Matches of small groups of teams; ``hot`` of them with one team."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        d, base = rng.randrange(days), rng.randrange(teams // 4) * 4
        x, y = rng.sample(range(base, base + 4), 2) if rng.random() < 0.95 else rng.sample(range(teams), 2)
        if rng.random() < hot:
            x, y = 999, rng.randrange(teams)
        rows.append((f"m{i:04}", d, f"T{x}", f"T{y}", rng.randrange(6), rng.randrange(5), d + rng.choice([0, 0, 1, 3, 20])))
    return rows


def same(a, b):
    assert set(a) == set(b) and len(a) > 0
    for k, r in a.items():
        for x, y in zip(r, b[k]):
            assert x == y or abs(x - y) < 1e-9, (r, b[k])


def collected(df):
    return {r.match_id: r for r in df.collect()}


@pytest.mark.parametrize("gate", ["kickoff", "available"])
@pytest.mark.parametrize("limit,hot", [(40, 0.0), (25, 0.4)])
def test_slices_groups_and_instants(spark, monkeypatch, gate, limit, hot):
    m = table(spark, season(1, hot=hot, days=60 if not hot else 8))
    cfg = ratings.Elo(gate=gate)
    whole, strengths = collected(ratings.elo_features(m, cfg, (1, 3))), collected(ratings.online_strengths(m))
    monkeypatch.setattr(ratings, "SLICE_ROWS", limit)
    report = ratings.slice_groups(m).collect()
    kinds = {r.kind for r in report}
    assert sum(r.matches for r in report) == 500 and ("instant" in kinds if hot else kinds >= {"whole"} and len(report) > 5)
    same(whole, collected(ratings.elo_features(m, cfg, (1, 3))))
    same(strengths, collected(ratings.online_strengths(m)))


def test_components_run_side_by_side(spark, monkeypatch):
    """Leagues that never meet need no slices: the largest group does not grow with the number of leagues."""
    monkeypatch.setattr(ratings, "SLICE_ROWS", 60)
    largest = []
    for leagues in (10, 30):
        rng = random.Random(leagues)
        rows = [(f"{n}-{i}", i, f"L{n}T{a}", f"L{n}T{b}", rng.randrange(4), rng.randrange(4), i) for n in range(leagues) for i in range(20) for a, b in [rng.sample(range(5), 2)]]
        m = table(spark, rows)
        report = ratings.slice_groups(m).collect()
        assert {r.kind for r in report} == {"components"} and all(r.groups > 1 for r in report)
        largest.append(max(r.largest_group for r in report))
        got = collected(ratings.elo_features(m))
        monkeypatch.setattr(ratings, "SLICE_ROWS", 10_000)
        same(collected(ratings.elo_features(m)), got)
        monkeypatch.setattr(ratings, "SLICE_ROWS", 60)
    assert max(largest) <= 140


def test_last_states_carry_on(spark, monkeypatch):
    """The state after half of the matches, handed to a run over the rest, gives the ratings of one pass."""
    rows = season(3, n=200, teams=20)
    m = table(spark, rows)
    whole = collected(ratings.elo_features(m, windows=(2,)))
    cut = sorted(r[1] for r in rows)[100]
    monkeypatch.setattr(ratings, "SLICE_ROWS", 30)
    run = ratings.EloRun(ratings.Elo(), (2,))
    day = F.datediff("kickoff_utc", F.lit("2020-01-01"))
    before, after = (ratings.rated_rows(m.where(c), ratings.Elo(), None, "available_at") for c in (day < cut, day >= cut))
    _, states = ratings.in_slices(before, run)
    out, _ = run.run(after.toPandas(), {r.team: pickle.loads(r.state) for r in states.collect()})
    for r in out.itertuples():
        assert abs(r.elo_diff_pre - whole[r.match_id].elo_diff_pre) < 1e-9
    assert len(out) > 50


@pytest.mark.parametrize("gate", ["kickoff", "available"])
def test_stream_in_any_order(spark, tmp_path, gate):
    """Matches in files of random order, two leagues, history from a batch run: the stream's ratings are those of the batch."""
    spark.conf.set(*streamed.STATE_STORE)
    cfg = ratings.Elo(gate=gate)
    rows = season(4, n=160, teams=16, days=80)
    m = table(spark, rows).withColumn("league", F.when(F.expr("abs(hash(match_id)) % 2 = 0"), "A").otherwise("B"))
    whole = collected(ratings.elo_features(m, cfg, (2,), pool="league"))
    day = F.datediff("kickoff_utc", F.lit("2020-01-01"))
    history = streamed.elo_states(m.where(day < 40), "league", cfg, (2,)).checkpoint()
    # a last match, far off, lets the watermark pass all others
    end = table(spark, [("end", 400, "X", "Y", 0, 0, 400)])
    later = m.where(day >= 40)
    for i in range(3):
        later.where(F.expr(f"abs(hash(match_id, 7)) % 3 = {i}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streamed.elo_stream(stream, "league", "60 days", cfg, (2,), history)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = collected(spark.read.parquet(f"{tmp_path}/out"))
    assert set(got) == {r.match_id for r in later.select("match_id").collect()}
    for k, r in got.items():
        for c in ("elo_team1_pre", "elo_team2_pre", "elo_exp_team1", "elo_momentum_roll2_diff"):
            assert abs(r[c] - whole[k][c]) < 1e-9
        assert r.elo_team1_available_at == whole[k].elo_team1_available_at
