"""Sweeps that take a key's rows as arrays answer as row by row does, and faster."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_sweep import check, table
from tidecast.operators import history, sweep


def games(seed, n, teams, days, delay):
    """Every result is known ``delay`` days after kickoff, some teams play twice a day."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        d, (x, y) = rng.randrange(days), rng.sample(range(teams), 2)
        rows.append((f"m{i:04}", d, f"T{x}", f"T{y}", rng.choice([0, 1, 1, 2, 5]), rng.choice([0, 0, 1, 2]), d + delay))
    return rows


@pytest.mark.parametrize("delay", [0, 9])
def test_blocks_against_brute_force(spark, monkeypatch, delay):
    monkeypatch.setattr(sweep, "BLOCK_ROWS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # states go on from batch to batch
    try:
        check(spark, games(3, 300, 5, 120, delay))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_all_kinds_against_rows(spark, monkeypatch):
    """Late results among others, far-off kickoffs and missing availability: the same answers with and without blocks."""
    rows = games(4, 400, 6, 200, 0)
    rng = random.Random(4)
    rows = [(*r[:6], r[1] + rng.choice([0, 0, 0, 0, 30]) if r[1] > 100 else r[1]) for r in rows] + [("z1", 30_000, "T0", "T1", 1, 0, 30_000), ("z2", 30_001, "T0", "T2", 1, 0, 30_001)]
    m = table(spark, rows).withColumn("available_at", F.when(F.col("match_id") != "m0007", F.col("available_at")))
    r = history.team_rows(m)
    found = []
    for block in (2, 10**9):
        monkeypatch.setattr(sweep, "BLOCK_ROWS", block)
        found.append({(x.match_id, x.side): x for x in history.side_history(r, [2, 5], history.STATS, 20.0).collect()})
    assert len(found[0]) == 804 and set(found[0]) == set(found[1])
    for k, a in found[0].items():
        for x, y in zip(a, found[1][k]):
            assert x == y or (isinstance(x, float) and abs(x - y) < 1e-9), (k, a, found[1][k])


def test_blocks_take_no_steps_by_row():
    """Answers to 20,000 queries among 20,000 events of 20 keys, in the task's own time."""
    n, day = 20_000, 86_400_000_000
    names, places = ["t", "tag", "match", "side", "k", "a", "x", "y"], [6, 7]
    rng = random.Random(1)
    start = lambda: sweep.All(history.Recent(), history.Counted(), history.Decayed(places, 365.0), history.Last(places, [5]))
    batches = []
    for _ in range(20):
        rows = [r for i in range(n // 20) for r in ((i * day, sweep.QUERY, f"m{i}", "team1", i * day, None, None, None), (i * day + 1, sweep.EVENT, f"m{i}", "team1", i * day, i * day + 1, float(rng.randrange(5)), float(rng.randrange(5))))]
        batches.append(pa.record_batch([pa.array(c) for c in zip(*rows)], names=names))

    def by_rows():
        out = []
        for batch in batches:
            state = start()
            for row in zip(*map(sweep.values, batch.columns)):
                state.add(row) if row[1] == sweep.EVENT else out.append(state.answer(row))
        return out

    def by_blocks():
        out = []
        for batch in batches:
            state, block = start(), sweep.Block(batch.columns, {}, batch.column(1).to_numpy(), 0)
            assert state.fits(block)
            out.append([pa.array(v, mask=~there) for v, there in state.block(block)])
        return out

    began = time.process_time()
    want = by_rows()
    slow, began = time.process_time() - began, time.process_time()
    got = by_blocks()
    fast = time.process_time() - began
    got = [row for columns in got for row in zip(*(c.to_pylist() for c in columns))]
    assert all(x == y or abs(x - y) < 1e-9 for a, b in zip(got, want) for x, y in zip(a, b)) and len(got) == n
    assert fast < slow / 4, (fast, slow)
