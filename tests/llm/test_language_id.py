"""Language identification: the network against plain loops, its gradient, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import language_id, registry


def by_hand(net, text):
    """Mean log-probabilities of one text's windows, place by place."""
    t = text.lower()
    out = []
    for start in range(0, max(1, len(t) - 3), language_id.PLACES):
        window = t[start : start + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
        h = []
        for w, side, bias in zip(language_id.WIDTHS, net.tables, net.bias):
            for f in range(language_id.FILTERS):
                h.append(max(0.0, max(sum(float(side[j][window[i + j], f]) for j in range(w)) for i in range(language_id.PLACES)) + float(bias[f])))
        z = np.array(h) @ net.out + net.out_bias
        out.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
    return np.mean(out, 0)


def test_windows_hold_every_place():
    texts = [b"", b"ab", bytes(range(1, 254)), bytes(range(1, 255)) * 9, b"x" * 253 + b"yyz"]
    flat, starts, own = language_id.windows(texts)
    for i, t in enumerate(texts):
        seen = {bytes(flat[s + p : s + p + 4].tobytes()) for s in starts[own == i] for p in range(language_id.PLACES)}
        low = t.lower()
        assert {low[p : p + 4] for p in range(len(low) - 3)} <= seen


def test_reader_is_the_network():
    net = language_id.Network(3)
    net.bias += 0.1
    texts = ["Où est-ce?".encode(), b"", b"The End " * 70, bytes(range(256)) * 2]
    got = language_id.Reader(net).log_probabilities(texts)
    assert np.allclose(got, [by_hand(net, t) for t in texts], atol=1e-4)


def test_gradient():
    rng = np.random.default_rng(0)
    net = language_id.Network(3)
    net.bias += 0.5
    x, y = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grads = net.loss(x, y)
    for p, g in zip(net.parameters(), grads):
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, ends = p[place], []
        for step in (1e-2, -1e-2):
            p[place] = old + step
            ends.append(net.loss(x, y)[0])
        p[place] = old
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[place], rel=0.05, abs=1e-3)


def test_held_out_accuracy(spark):
    out = registry.op12_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows[0] > 0.97 and rows[1] > 200
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog of", "en", 1) if i % 2 else (i, "der hund und die katze", "de", 1) for i in range(40)]
    odd = [(100, None, "en", 1), (101, "", "de", 1), (102, "12 ²³ — 34", "en", 1), (None, "the dog", "fr", 1), (103, "the cat", None, 1), (103, "the cat", None, 1), (104, "Ω" * 3, None, 1), (105, "und die katze " * 20_000, None, 1)]
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in language_id.identify_languages(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")).collect() if r.doc_id is None or r.doc_id >= 100]
    by = dict((d, lang) for d, lang, _ in got)
    assert len(got) == 8 and [by[i] for i in (100, 101, 102)] == ["und"] * 3 and by[103] == by[None] == "en" and by[104] in ("en", "de") and by[105] == "de"
    assert all(h is False for d, _, h in got if d is None)
    none = language_id.identify_languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert language_id.identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
