"""Decontamination against a search of all places, on long and repetitive texts, and row by row."""

import random
import time
import tracemalloc

import numpy as np

from tidecast.llm import decontaminate
from tidecast.llm.decontaminate import Index, Settings, normalise, normalised


def least_edits(pattern, text):
    """Of the whole pattern against any piece of the text."""
    row = np.zeros(len(text) + 1, int)
    steps = np.arange(len(text) + 1)
    text = np.array(list(map(ord, text)), int)
    for i, x in enumerate(pattern, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (text != ord(x)))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def slow_leaks(docs, items, settings):
    out = set()
    for d, text in docs:
        for i, item in items:
            t = normalise(item or "")
            m = min(len(t), settings.window)
            if m >= settings.q and any(least_edits(t[s : s + m], normalise(text or "")) <= settings.edits(m) for s in settings.starts(len(t))):
                out.add((d, i))
    return out


def damaged(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("abcz")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcz"))
    return "".join(chars)


def test_leaks_against_all_places(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioukrst") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(3, 40))) for i in range(10)] + [(40, "abcdefgh"), (41, "short"), (42, None), (43, "ab" * 60), (43, say(30)), (None, say(20))]
    docs = []
    for d in range(30):
        item = rng.choice(items[:10])[1]
        a = rng.randrange(max(1, len(item) // 2))
        piece = damaged(rng, item[a : a + rng.choice([60, 90, 110, 400])], rng.choice([0, 1, 3, 5, 6, 7, 8, 12]))
        docs.append((d, f"{say(rng.randint(0, 40))} {piece} {say(rng.randint(0, 40))}"))
    docs += [(200, None), (201, ""), (202, "xx abcdefgh yy"), (203, "abcdefg"), (204, "ab" * 300), (205, " ,;! "), (None, items[-1][1])]
    for settings in (Settings(), Settings(window=40, stride=7, edit_rate=0.05)):
        df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, edits int").repartition(3)
        got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"), settings=settings).collect()
        want = slow_leaks(docs, items, settings)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
        for r in got:
            text = dict(docs)[r.doc_id]
            assert 0 <= r.start < r.end <= len(text)
            if r.edits == 0:
                assert any(normalise(text[r.start : r.end]) in normalise(t or "") for i, t in items if i == r.item_id)


def test_runs_of_95_characters_are_found():
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghij ") for _ in range(300))
    codes = normalised(item)[0]
    text = normalise(item)
    index = Index([1], [codes], Settings())
    assert all(index.search(["q" * 30 + text[a : a + 95] + "q" * 30])[0] for a in range(len(text) - 95))


def test_regions_at_the_ends_of_stretches(monkeypatch):
    """Small stretches and batches lose nothing."""
    rng = random.Random(5)
    items = ["".join(rng.choice("abc ") for _ in range(120)) for _ in range(6)]
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 900))) + rng.choice(items) + "b" * rng.randint(0, 50) for _ in range(40)]
    index = Index(list(range(6)), [normalised(t)[0] for t in items], Settings())
    want = index.search(texts)
    assert all(want)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    monkeypatch.setattr(decontaminate, "PASSAGES", 3)
    assert [index.search([t])[0] for t in texts] == want == index.search(texts)


def test_phrase_of_many_items_in_a_long_text():
    """A long text of a phrase that 2,000 items share needs bounded memory and time."""
    rng = random.Random(6)
    phrase = "the following phrase stands in very many items "
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    index = Index(list(range(2000)), [normalised(say(100) + phrase + say(100))[0] for _ in range(2000)], Settings())
    normalised("")
    text = phrase * (100_000 // len(phrase))
    tracemalloc.start()
    began = time.time()
    assert index.search([text]) == [{}]
    assert tracemalloc.get_traced_memory()[1] < 600e6 and time.time() - began < 60
    tracemalloc.stop()


def test_rows_go_not_ids(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    leaked, clean = "so one two three four five six seven eight nine ten it is", "nothing of that kind"
    rows = [(5, leaked, "a"), (5, clean, "b"), (None, leaked, "c"), (None, clean, "d"), (6, None, "e"), (6, "", "f"), (5, leaked, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(r.item_id for r in got.collect()) == ["b", "d", "e", "f"]
    assert len(decontaminate.leaks(docs, bench).collect()) == 3
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 7
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_blocks(spark, monkeypatch):
    """Many indexes one after another give what one gives."""
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(150))) for i in range(60)]
    docs = [(i, "z" * 50 + items[i][1] + "z" * 50) for i in range(0, 60, 7)] + [(100, "z" * 200)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(i, i) for i in range(0, 60, 7)}
    assert [r.doc_id for r in decontaminate.decontaminate(df, bench).collect()] == [100]


def test_repetitive_items_take_bounded_memory():
    """An item of a million characters that repeats itself, in a text that does too and in one that holds it once."""
    import tracemalloc

    items = ["ab " * 333_334, "x1 y2 z3 " * 100 + " ".join(f"w{i}" for i in range(3000))]
    texts = [np.frombuffer(decontaminate.normalise(t).encode("utf-32-le"), np.uint32) for t in items]
    tracemalloc.start()
    index = decontaminate.Index([7, 8], texts, decontaminate.Settings())
    found = index.search(["zz " + "ab " * 30 + "zz", "ab " * 30_000, "q " * 200, items[1][:400], "ab " * 20] + ["clean words only"] * 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [sorted(f) for f in found[:5]] == [[0], [0], [], [1], []] and not any(found[5:])
    assert found[0][0][0] == 0 and peak < 1 << 30
