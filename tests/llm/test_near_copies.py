"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
from tidecast.llm import near_copies, simhash


def slow_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def slow_components(docs):
    sets, label, changed = {d: slow_set(t) for d, t in docs}, {d: d for d, _ in docs}, True
    linked = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def near_documents():
    rng = random.Random(12)
    say = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(n)]
    docs = []
    for i in range(40):
        base = say(rng.randint(60, 400))
        docs.append((10 * i, " ".join(base)))
        for k in range(1, 5):  # copies, and copies of copies, with 0 to 4 % of the words changed
            base = [w if rng.random() > 0.01 * rng.randint(0, 4) else "changed" for w in base]
            docs.append((10 * i + k, " ".join(base)))
    return docs + [(900, None), (901, ""), (902, "one two"), (903, "one  TWO"), (904, "one two three")]


def test_stage_drops_all_near_copies(spark):
    docs = near_documents()
    want = {d for d, c in slow_components(docs).items() if d == c}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()} == want
    # many of those that go are further apart than the links of op3
    text = dict(docs)
    label = slow_components(docs)
    far = [d for d, c in label.items() if d != c and (simhash.fingerprint(text[d] or "") ^ simhash.fingerprint(text[c] or "")).bit_count() > 2]
    assert len(far) > 20


def test_middle_of_a_key_is_compared(spark):
    """Documents that share a key but are not like its smallest one are compared with each other."""
    base = [f"w{i}" for i in range(204)]
    docs = [(1, " ".join(base[:104] + [f"x{i}" for i in range(60)])), (2, " ".join(base)), (3, " ".join(base[:-10]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert slow_components(docs) == {1: 1, 2: 2, 3: 2}
    assert [r.doc_id for r in near_copies.drop_near_copies(df).orderBy("doc_id").collect()] == [1, 2]


def test_rows_go_not_ids(spark):
    """Null ids are no protection, equal rows count as copies, and other texts under an id of a copy stay."""
    rows = [(None, "a b", 1), (None, "a b", 2), (3, "a b", 3), (3, "a b", 4), (4, "A  b", 5), (4, "quite another text", 6), (None, "third", 7), (9, None, 8), (8, "", 9), (None, " ", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int")
    got = near_copies.drop_near_copies(df)
    kept = {r.th for r in got.collect()}
    assert got.columns == df.columns and got.count() == 4 and kept - {3, 4} == {6, 7, 9} and len(kept & {3, 4}) == 1
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0


def test_long_texts(spark):
    words = [f"w{i % 977}x{i}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[: 55_000])), (3, "x " * 100_000), (4, "x x x x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == [1, 3]


def test_rows_without_an_id_link_others(spark):
    """Null ids as the bridge of two documents, as the only members, and repeated."""
    rows = [(7, 0), (None, 3), (None, 3), (9, 15), (None, 1023 << 40), (None, 1023 << 40 | 1), (20, 1023 << 50)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in got), key=str) == sorted([(7, 0, 7), (None, 3, 7), (None, 3, 7), (9, 15, 7), (None, 1023 << 40, None), (None, 1023 << 40 | 1, None), (20, 1023 << 50, 20)], key=str)
