"""Components of teams: tasks send forests on, not all matches, and what planning has found is not sought again."""

import random

import pyarrow as pa
import pytest

from tidecast.operators import ratings, sweep

from .test_ratings import collected, same, season, table


def linked(pairs):
    """Each team with the least name of its component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("limit", [50, 10_000])
def test_forests_link_the_same_teams_in_few_rows(monkeypatch, limit):
    monkeypatch.setattr(ratings, "FOREST_ROWS", limit)
    rng = random.Random(3)
    pairs = [(f"T{g}-{rng.randrange(9)}", f"T{g}-{rng.randrange(9)}é") for g in (rng.randrange(40) for _ in range(4_000))]
    batches = [pa.record_batch([pa.array(c) for c in zip(*pairs[i : i + 300])], names=["team1", "team2"]) for i in range(0, 4_000, 300)]
    out = [(a, b) for batch in ratings.forest(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert linked(out) == linked(pairs)
    if limit == 10_000:
        assert len(out) == len(linked(pairs)) < 800


def test_pools_with_missing_opponents(spark):
    rows = [("a", "b"), ("c", "b"), ("d", None), (None, "e"), (None, None), ("f", "f")]
    pools = ratings.team_pools(spark.createDataFrame(rows, "team1 string, team2 string")).collect()
    assert {r.team: r.pool for r in pools} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"} and len(pools) == 6


def test_components_are_sought_once(spark, monkeypatch):
    rows = [(f"{p}{i}", d, f"{p}{x}", f"{p}{y}", g, h, a) for p in "ABCDEFG" for i, d, x, y, g, h, a in season(5, n=60)]
    m = table(spark, rows)
    whole = collected(ratings.elo_features(m))
    calls = []
    pools = ratings.team_pools
    monkeypatch.setattr(ratings, "team_pools", lambda edges: calls.append(1) or pools(edges))
    monkeypatch.setattr(ratings, "SLICE_ROWS", 60)
    same(whole, collected(ratings.elo_features(m)))
    assert len(calls) == 1


def test_values_of_columns_without_scalars():
    columns = [
        pa.array([1, None, -(2**62)], pa.int64()), pa.array([1, 2, 3], pa.int32()), pa.array([0.5, None, float("inf")]), pa.array([True, None, False]), pa.array([True, False]),
        pa.array(["a", None, "é"]), pa.array([b"x", None]), pa.array([None, None], pa.float64()), pa.array([], pa.string()), pa.array([1, None, 3]).slice(1),
    ]
    for c in columns:
        assert [(type(x), x) for x in sweep.values(c)] == [(type(x), x) for x in c.to_pylist()]
