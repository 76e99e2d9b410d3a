"""Near-duplicates, line dedup, decontamination, classifiers and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidecast.llm import common, decontaminate, line_dedup, quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components_of(fps, reach):
    label = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= reach and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint():
    for text in ("", "A", "a b", "The the THE cat\x0bsat on é É", "x " * 50):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("rows", [40, 6000])
def test_leaves_lose_no_link(rows):
    """Every linked pair meets in a leaf, and the edges of the leaves connect just the linked pairs."""
    rng = np.random.default_rng(rows)
    centres = rng.integers(0, 2**63, rows // 4, dtype=np.uint64)
    points = np.unique(np.concatenate([centres, *(centres ^ (np.uint64(1) << rng.integers(0, 64, len(centres), dtype=np.uint64)) for _ in range(3))]))
    tree = simhash.Tree(points[:: max(1, len(points) // 500)], 4, 2)
    index, leaf = tree.leaves(points)
    edges = []
    for x in np.unique(leaf):
        own = index[leaf == x]
        edges += [(int(a), int(b)) for u, v in simhash.links(points[own], own, 2) for a, b in zip(u, v)]
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)
        assert len({find(int(j)) for j in near}) == 1
    assert all(find(a) == find(b) for a, b in edges)


def test_simhash_groups(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(20)]
    docs = [(i, base[i % 20] if i % 3 else base[i % 20].upper()) for i in range(60)] + [(100, None), (101, ""), (102, " \t"), (103, "one"), (103, "one")]
    rows = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, fp int, component_id string")
    got = simhash.simhash_groups(rows).collect()
    assert len(got) == len(docs)
    label = components_of([(d, slow_fingerprint(t)) for d, t in docs], 2)
    for r in got:
        assert r.component_id == label[r.doc_id]
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (None, "q r s t")], "doc_id long, text string")
    assert sorted(simhash.simhash_groups(nulls).select("component_id").collect(), key=str) == sorted([(7,), (7,), (7,), (None,)], key=str)
    assert simhash.simhash_groups(rows.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i != 20] + [(50, 50), (60, 61), (61, 60)]
    got = dict(common.components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {i: 1 for i in range(1, 21)} | {i: 21 for i in range(21, 41)} | {60: 60, 61: 60}
    assert got == want


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def slow_lines(docs, least):
    first = {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if line:
                first.setdefault(line, (d, i))
    long = [x for x in first if len(x) >= least]
    near = {x for x in long if any(first[y] < first[x] and within_one(x, y) for y in long if y != x)}
    out = {}
    for d, t in docs:
        kept = [x for i, x in enumerate((t or "").split("\n")) if not x or (x not in near and first[x] == (d, i))]
        out[d] = None if t is None else "\n".join(kept)
    return out


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(12)] + ["é" * 300, "é" * 299, "é" * 150 + "x" + "é" * 150, "", "ab"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id long, text string, line string, h int")
    got = line_dedup.dedup_lines(df, min_chars=4)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == slow_lines(docs, 4)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a line that repeats\nx"), (1, "a line that repeats\nx"), (2, "a line that repeats\ny"), (2, "a line that repeatS\nz")], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(df, min_chars=5).collect())
    assert got == [(1, "a line that repeats\nx"), (1, "a line that repeats\nx"), (2, "y"), (2, "z")]


def test_line_dedup_long_text(spark):
    """Many lines in one text take linear time, and counts replace columns of their names."""
    lines = [f"line number {i} of a very long text" for i in range(0, 40_000, 20)]
    df = spark.createDataFrame([(1, "\n".join(lines), 7), (2, "\n".join(lines * 10), 8)], "doc_id long, text string, n_lines int")
    out = line_dedup.dedup_lines(df, counts=True)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].n_lines == 20_000 and rows[2].n_dropped == 20_000 and rows[2].text == ""


def test_alignment_against_edit_distance():
    rng = random.Random(9)

    def edits(p, t):  # whole pattern against any piece of the text
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(1, 25)))
        around = " " * len(p) + t + " " * (2 * len(p))
        pattern, text = (np.array(list(map(ord, x)))[None] for x in (p, around))
        found, end = decontaminate.align(pattern, text[:, : 2 * len(p) + len(t) + len(p)], 0, True)
        assert found[0] == edits(p, around)


def test_leaks(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("aeioukrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(40).capitalize() + ".") for i in range(6)] + [(6, None), (7, "ab"), (8, say(200))]
    docs, want = [(100, None), (101, ""), (102, say(3000))], set()
    for i in range(60):
        item = rng.choice(items[:6])
        text = item[1]
        n = i % 4  # unharmed, other case and spaces, and twice with edits
        if n == 1:
            text = text.upper().replace(" ", "  ")
        if n >= 2:  # a few edits
            chars = list(text)
            for _ in range(3):
                chars[rng.randrange(len(chars))] = "z"
            text = "".join(chars)
        docs.append((i, f"{say(rng.randint(0, 300))} İ {text} {say(rng.randint(0, 300))}"))
        want.add((i, item[0]))
    docs.append((200, say(20) + items[8][1][400:900] + say(20)))
    want.add((200, 8))
    got = decontaminate.leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, edits int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got:
        if r.doc_id < 100 and r.doc_id % 4 == 0:
            assert decontaminate.normalise(text[r.doc_id][r.start : r.end]) in decontaminate.normalise(dict(items)[r.item_id])
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {100, 101, 102}
    none = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def accuracy(rows, labels, name):
    known = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([a == b for a, b in held]), max(np.mean([b for _, b in held]), 1 - np.mean([b for _, b in held]))


@pytest.mark.parametrize(("name", "run"), [("quality", registry.op2_quality), ("toxic", registry.op10_toxicity)])
def test_held_out_accuracy(spark, name, run):
    """At the scale of 0.01 (about 110 held-out labels) the classifiers beat the more frequent class."""
    folder = SF.replace("0.001", "0.01")
    rows = run(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    got, base = accuracy(rows, common.read_table(spark, folder, "labels"), name)
    assert got > base + 0.03


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_on_odd_tables(spark, score):
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 6000)]], "doc_id long, text string, score double, x int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = score(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in rows)
    assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_index_vectors():
    v = quality.index_vectors()
    assert (v[0] == 0).all() and (np.abs(v[1:]).sum(1) <= quality.NONZERO).all() and np.abs(v[1:].sum(1)).mean() < 1
    rows, total = np.array([1, 2, 3, 1], np.int32), np.zeros((quality.BUCKETS, quality.DIMS))
    quality.add_contexts(rows, v, total)
    assert np.allclose(total[2], v[1] + v[3] + v[1]) and np.allclose(total[1], v[2] + v[3] + v[2] + v[3])


def test_pipeline(spark, tmp_path):
    docs = common.read_table(spark, SF, "documents")
    clashing = docs.withColumns({"score": docs.doc_id, "line": docs.doc_id, "fp": docs.doc_id})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, after = clashing.count(), spark.read.parquet(path)
        if name != "packing":
            assert after.columns == clashing.columns and 0.5 * before <= after.count() <= before
            clashing = after
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in clashing.select("doc_id").collect()}


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
