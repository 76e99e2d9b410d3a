"""The toxicity model's counts are exact: by whole keys, not by hashed slots."""

from collections import Counter

import numpy as np

from tidecast.llm import common, toxicity


def test_keys_of_one_slot_do_not_add_up(spark):
    rows = [(k, 10 + k) for k in range(50)] + [(-(2**63) + 7, 3)]
    counts = toxicity.Counts(toxicity.keyed(spark.createDataFrame(rows, "key long, t long").repartition(3), ["t"]), ["t"])
    asked = np.array([3, 3, 60, -(2**63) + 7, 49, -1], np.int64).view(np.uint64)
    assert counts.of(asked)["t"].tolist() == [13, 13, 0, 3, 59, 0]
    empty = toxicity.Counts(toxicity.keyed(spark.createDataFrame([], "key long, t long"), ["t"]), ["t"])
    assert empty.of(asked)["t"].tolist() == [0] * 6


def test_model_counts_are_those_of_the_grams(spark):
    texts = [("alpha beta alphabet", 0, 1), ("beta gamma", 1, 1), ("alpha delta", 0, 0), ("gamma gamma", 1, 0)]
    words = toxicity.word_counts(spark.createDataFrame(texts, "text string, fold int, y int"))
    paths = toxicity.tables(common.cut(toxicity.gram_counts(words)))
    want, below = {c: Counter() for c in toxicity.COUNTS}, {}
    for text, fold, y in texts:
        for w in text.split():
            _, gram, context = toxicity.grams([w])
            want[f"{'t' if y else 'o'}{fold}"].update(gram[-1].tolist())
            for i in range(1, len(gram)):
                for long, short in zip(gram[i].tolist(), gram[i - 1].tolist()):
                    below.setdefault(short, set()).add(long)
    halves, whole = toxicity.Model(paths, True), toxicity.Model(paths, False)
    keys = np.array(sorted(set().union(*want.values())), np.uint64)
    for c, counts in want.items():
        assert halves.grams.of(keys)[c].tolist() == [counts[k] for k in keys.tolist()]
    assert whole.grams.of(keys)["t"].tolist() == [want["t0"][k] + want["t1"][k] for k in keys.tolist()]
    keys = np.array(sorted(below), np.uint64)
    assert whole.ends.of(keys)["ends"].tolist() == [len(below[k]) for k in keys.tolist()]


def test_every_order_is_counted(spark):
    """A gram that was never seen backs off to the one that is a single character shorter."""
    words = toxicity.word_counts(spark.createDataFrame([("alphabetical", 0, 1)], "text string, fold int, y int"))
    assert {r.n for r in toxicity.gram_counts(words).select("n").distinct().collect()} == set(range(1, toxicity.ORDER + 1)) and toxicity.ORDER == 8


def plain_log_ratio(texts, word, fold=None):
    """The Kneser-Ney ratio of a word, counted and summed place by place from the texts."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def windows(w):
        padded = "\x02" * (n - 1) + w + "\x03"
        return [padded[i - n + 1 : i + 1] for i in range(n - 1, len(padded))]

    whole, classes = set(), {"t": Counter(), "o": Counter()}
    for text, f, y in texts:
        for w in text.split():
            whole |= set(windows(w))
            if fold is None or f == fold:
                classes["t" if y else "o"].update(windows(w))
    seen = {k: {g[-k:] for g in whole} for k in range(1, n + 1)}
    ratio = 0.0
    for g in windows(word):
        p = 1e-4
        for k in range(1, n):
            ends = Counter(x[1:] for x in seen[k + 1])  # different grams one longer that end in each
            context = {x: ends[x] for x in seen[k] if x[:-1] == g[-k:-1]}
            if total := sum(context.values()):
                p = (max(ends[g[-k:]] - d, 0) + d * len(context) * p) / total
        logs = []
        for c in (classes["t"], classes["o"]):
            context = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
            logs.append(np.log((max(c[g] - d, 0) + d * (len(context) + 1) * p) / (sum(context.values()) + d)))
        ratio += logs[0] - logs[1]
    return ratio


def test_log_ratio_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    texts = [(" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 11))) for _ in range(12)), int(f), int(y)) for f in (0, 1) for y in (0, 1) for _ in range(3)]
    words = toxicity.word_counts(spark.createDataFrame(texts, "text string, fold int, y int"))
    paths = toxicity.tables(common.cut(toxicity.gram_counts(words)))
    asked = ["a", "abcabcab", "ééé", "zzz", "abz", *texts[0][0].split()[:4], *texts[-1][0].split()[:4], "abcaabcbé"]
    whole, halves = toxicity.Model(paths, False), toxicity.Model(paths, True)
    assert np.allclose(whole.log_ratio(asked), [plain_log_ratio(texts, w) for w in asked], atol=1e-9)
    for fold in (0, 1):
        assert np.allclose(halves.log_ratio(asked, fold), [plain_log_ratio(texts, w, fold) for w in asked], atol=1e-9)


def test_workers_give_back_freed_memory():
    import numpy as np

    from tidecast.llm.common import give_back

    def resident():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) // 1024 for line in f if line.startswith("VmRSS"))

    kept = []
    pieces = [np.ones(6_000) for _ in range(4_000)]  # each too small to be mapped on its own: 190 MB
    kept.append(pieces.pop())
    high = resident()
    del pieces
    give_back()
    assert kept and resident() < high - 150
