"""Periodic runs against a search of all lags, and the query against its definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidecast.llm import periodic_runs, registry


def all_runs(w, least=12):
    """Every maximal stretch of every period, the smallest period of each."""
    runs = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                runs.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in runs.items())


def text(rng):
    """Words of few letters: repeated pieces, powers of powers, stretches that meet out of step."""
    pick = lambda n, letters: [rng.choice(letters) for _ in range(n)]
    letters, w = rng.choice(["a", "ab", "abc", "abcdefghijklmnop"]), []
    for _ in range(rng.randint(0, 6)):
        unit = pick(rng.choice([1, 2, 3, 7, rng.randint(1, 50), rng.randint(30, 150)]), letters)
        if rng.random() < 0.3:
            unit = (pick(rng.choice([1, 2, 3]), "ab") * 200)[: rng.randint(20, 150)] + pick(rng.choice([0, 0, 1, 2]), "abz")
        turns = rng.choice([1, 2, 2, 3, rng.randint(1, 6)])
        w += (unit * (turns + 1))[: int(len(unit) * (turns + rng.random()))]
        if rng.random() < 0.3:
            w += pick(rng.randint(0, 30), "abcdefghijklmnop")
    return w * 2 if rng.random() < 0.2 else w


@pytest.mark.parametrize("least", [12, 5, 40])
def test_runs_are_those_of_all_lags(least):
    rng, found = random.Random(least), 0
    for _ in range(60):
        words = [text(rng)[:700] for _ in range(rng.randint(1, 6))]
        for w, (rows, _) in zip(words, periodic_runs.runs_of([" ".join(w).encode() for w in words], least)):
            want = all_runs(w, least)
            assert [tuple(r) for r in rows.tolist()] == want
            found += len(want)
    assert found > 1000


def test_words_of_fibonacci_and_one_word():
    a, b = ["b"], ["a"]
    while len(b) < 900:
        a, b = b, b + a
    (rows, _), (one, _), (none, _) = periodic_runs.runs_of([" ".join(b).encode(), b"x\x0bx " * 3000, "x\xa0x ".encode() * 5])
    assert [tuple(r) for r in rows.tolist()] == all_runs(b) and len(rows) > 150
    assert one.tolist() == [[0, 6000, 1]] and none.tolist() == []


def test_long_texts_stay_linear():
    """A megabyte that only a long period repeats, and one of two stretches out of step."""
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 70_000).astype(str).tolist()
    words = unit * 2 + unit[:123] + ["end"]
    step = ["a", "b"] * 20_000 + ["b", "a"] * 20_000
    (rows, _), (odd, _) = periodic_runs.runs_of([" ".join(words).encode(), " ".join(step).encode()])
    assert [140_123, 70_000] in rows[:, 1:].tolist()
    assert len(odd) == 2 + 20_000 - 3 and (odd[:, 1] >= 12).all()  # both stretches, and each odd lag around the seam of 12 words or more


def test_operator_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (3, " \n ", 3), (4, "u v " * 6 + "w", 3), (4, "u v " * 6 + "w", 3), (None, "a b c d e f " * 2, 3)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()), key=str)
    run = (4, 13, [(0, 12, 2)], "u v w")
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), run, run, (None, 12, [(0, 12, 6)], "a b c d e f")], key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_its_definition(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", " "]) if i % 9 == 0 else " ".join(text(rng)[:300]) + " x y") for i in range(250)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc_id, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p, planted = 1 + (n - a) // (3 + h // 10 % 8), planted + 1
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, gone = all_runs(w), set()
        for a, length, q in runs:
            gone.update(range(a + q, a + length))
        r, best = got[doc_id], min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 10
