"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, of toxic and of ordinary labelled documents, predict each character of a
word from the seven before it. Their discounted mass backs off to one shared model whose
counts are continuation counts over both classes, so an expression seen once or never
is judged by its shorter parts. A word's evidence is its toxic minus its ordinary
log-likelihood; a document is described by its length-normalised evidence and by that
of its most telling words, and a logistic calibration turns these into a probability.
Calibration uses each half of the labelled rows under the model of the other half.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Timer

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, give_back, held_out, shared_root
from .quality import label_rows

#: Lengths of the character grams, from the shared model's shortest to the class models'.
ORDERS = (1, 2, 3, 4, 5, 6, 7, 8)
ORDER = ORDERS[-1]
DISCOUNT = 0.75
#: Bound of the labelled sample on which the calibration is fitted.
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
FEATURES = 9
#: So long a worker keeps the counts after its last task with them.
HELD_SECONDS = 8

_WORDS = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ["t0", "o0", "t1", "o1"]


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For the characters to predict in ``words`` (each with an end mark): the word of each,
    and for each of ORDERS the hashes of the gram and of its context."""
    c = np.frombuffer("".join("\x02" * (ORDER - 1) + w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(w) for w in words], np.int64) + ORDER
    ends = np.cumsum(lengths)
    places = np.ones(len(c), bool)
    for k in range(ORDER - 1):
        places[ends - lengths + k] = False
    at = np.flatnonzero(places)
    owner = np.repeat(np.arange(len(words)), lengths - ORDER + 1)
    last, context = mix(c[at] * _P), np.zeros(len(at), np.uint64)
    whole, contexts = [], []
    for n in range(1, ORDER + 1):
        if n in ORDERS:
            contexts.append(mix(context + np.uint64(n)))
            whole.append(mix(last + contexts[-1]))
        if n < ORDER:
            context = mix(context + c[at - n] + np.uint64(n << 32))
    return owner, whole, contexts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` and its counts by fold and class, over ``text, fold, y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in COUNTS]

        def flush() -> pa.RecordBatch:
            words = list(set().union(*counts))
            out = pa.record_batch([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], names=["word", *COUNTS])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, fold, y in zip(*(c.to_pylist() for c in batch.columns)):
                counts[2 * fold + (0 if y else 1)].update(_WORDS.findall((text or "").lower()))
                if sum(map(len, counts)) > 200_000:
                    yield flush()
        yield flush()

    rows = texts.mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def gram_counts(words: DataFrame) -> DataFrame:
    """``n, gram, context, suffix`` (hashes; the suffix is the gram of the next shorter order) and counts.

    Only the longest grams have counts: of the shorter ones it matters only which there are.
    """
    names = ["n", "gram", "context", "suffix", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, gram, context = grams(batch.column(0).to_pylist())
            counts = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)[owner]
            for i, n in enumerate(ORDERS):
                keys, first, back = np.unique(gram[i], return_index=True, return_inverse=True)
                sums = [np.bincount(back, c, len(keys)).astype(np.int64) if n == ORDER else np.zeros(len(keys), np.int64) for c in counts.T]
                suffix = gram[i - 1][first] if i else np.zeros(len(keys), np.uint64)
                yield pa.record_batch(
                    [pa.array(np.full(len(keys), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (keys, context[i][first], suffix)), *map(pa.array, sums)], names=names
                )

    rows = words.mapInArrow(run, "n int, gram long, context long, suffix long, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.groupBy("n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), *(F.sum(c).alias(c) for c in COUNTS))


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written as Parquet to the shared folder (smaller than a checkpoint) and read again."""
    path = f"{shared_root(rows.sparkSession)}/toxicity-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def keyed(rows: DataFrame, names: list[str]) -> str:
    """The folder to which ``key`` and counts are written; tasks read it, so nothing passes through the driver."""
    path = f"{shared_root(rows.sparkSession)}/toxicity-{uuid.uuid4().hex}"
    small = [F.when(F.col(c) < 2**31, F.col(c)).otherwise(F.raise_error(F.lit(f"a count of {c} is beyond an integer"))).cast("int").alias(c) for c in names]
    rows.select("key", *small).write.parquet(path)
    return path


class Counts:
    """Counts by whole 64-bit key, sorted; keys that are not there have none."""

    def __init__(self, path: str, names: list[str]):
        from pyarrow import fs, parquet

        system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        files = [parquet.ParquetFile(system.open_input_file(f.path)) for f in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda f: f.path) if f.path.endswith(".parquet")]
        n = sum(f.metadata.num_rows for f in files)
        keys, columns, at = np.empty(n, np.int64), {c: np.empty(n, np.int32) for c in names}, 0
        for f in files:  # a part at a time into arrays of the right size: no second copy of the table
            for batch in f.iter_batches(1 << 18, columns=["key", *names], use_threads=False):
                for out, c in ((keys, "key"), *((columns[c], c) for c in names)):
                    out[at : at + batch.num_rows] = batch.column(batch.schema.get_field_index(c)).to_numpy()
                at += batch.num_rows
        order = np.argsort(keys)
        self.keys = keys[order]
        del keys
        self.columns = {}
        for c in names:
            self.columns[c] = columns.pop(c)[order]
        pa.default_memory_pool().release_unused()

    def of(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Each column's counts of ``keys`` (hashes)."""
        if not len(self.keys):
            return {c: np.zeros(len(keys), np.int32) for c in self.columns}
        few, back = np.unique(keys.view(np.int64), return_inverse=True)  # in order, as neighbours are found in the cache
        at = np.minimum(np.searchsorted(self.keys, few), len(self.keys) - 1)
        there = self.keys[at] == few
        return {c: np.where(there, x[at], 0)[back] for c, x in self.columns.items()}


def tables(table: DataFrame) -> dict[str, str]:
    """Folders with the keyed counts of ``gram_counts``' result (materialised): by fold and class, and kinds also by class."""
    top = table.where(F.col("n") == ORDER)
    # shared model: how many different grams of the next longer order end in this one
    below = F.create_map(*(F.lit(x) for pair in zip(ORDERS[1:], ORDERS[:-1]) for x in pair))
    ends = table.where("n > 1").groupBy(below[F.col("n")].alias("n"), F.col("suffix").alias("gram")).agg(F.count(F.lit(1)).alias("ends"))
    shared = table.where(F.col("n") < ORDER).join(ends, ["n", "gram"]).select("gram", "context", "ends")
    kinds = [F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in COUNTS] + [F.count_if(F.col(f"{k}0") + F.col(f"{k}1") > 0).alias(f"k_{k}") for k in "to"]
    return {
        "ends": keyed(shared.withColumnRenamed("gram", "key"), ["ends"]),
        "totals": keyed(shared.groupBy(F.col("context").alias("key")).agg(F.sum("ends").alias("ends"), F.count(F.lit(1)).alias("kinds")), ["ends", "kinds"]),
        "grams": keyed(top.withColumnRenamed("gram", "key"), COUNTS),
        "contexts": keyed(top.groupBy(F.col("context").alias("key")).agg(*(F.sum(c).alias(c) for c in COUNTS), *kinds), [*COUNTS, *(f"k_{c}" for c in [*COUNTS, "t", "o"])]),
    }


class Model:
    """Keyed count tables; ``log_ratio`` compares the classes by the labels of one fold or all."""

    def __init__(self, paths: dict[str, str], halves: bool):
        self.ends, self.totals = Counts(paths["ends"], ["ends"]), Counts(paths["totals"], ["ends", "kinds"])
        self.grams = Counts(paths["grams"], COUNTS)
        self.contexts = Counts(paths["contexts"], [*COUNTS, *(f"k_{c}" for c in (COUNTS if halves else "to"))])
        if not halves:
            for side in (self.grams.columns, self.contexts.columns):
                for k in "to":
                    side[k] = side.pop(f"{k}0")
                    side[k] += side.pop(f"{k}1")

    _held: tuple = (None, None)
    _users = 0
    _clock: Timer | None = None

    @classmethod
    @contextmanager
    def opened(cls, paths: dict[str, str], halves: bool) -> Iterator[Model]:
        """The model of ``paths``, read once by a worker for all of its tasks, and let go some seconds after the last of them."""
        if cls._clock:
            cls._clock.cancel()
        if cls._held[0] != (paths, halves):
            cls._held = (None, None)
            cls._held = ((paths, halves), cls(paths, halves))
        cls._users += 1
        try:
            yield cls._held[1]
        finally:
            cls._users -= 1
            cls._clock = Timer(HELD_SECONDS, cls.let_go)
            cls._clock.daemon = True
            cls._clock.start()

    @classmethod
    def let_go(cls) -> None:
        if not cls._users:
            cls._held = (None, None)
            give_back()

    def log_ratio(self, words: list[str], fold: int | None = None) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        owner, gram, context = grams(words)
        p = np.full(len(owner), 1e-4)
        # a longer gram or context can only be there if the shorter ones are, so ever fewer places are asked for
        live, found = np.arange(len(owner)), np.ones(len(owner), bool)
        for i in range(len(ORDERS) - 1):
            totals = self.totals.of(context[i][live])
            there = totals["ends"] > 0
            live, total, kinds = live[there], totals["ends"][there], totals["kinds"][there]
            asked = found[live]
            ends = np.zeros(len(live), np.int32)
            ends[asked] = self.ends.of(gram[i][live[asked]])["ends"]
            found[live] = ends > 0
            p[live] = (np.maximum(ends - DISCOUNT, 0) + DISCOUNT * kinds * p[live]) / total
        of_gram, of_context = ({c: np.zeros(len(owner), np.int32) for c in side.columns} for side in (self.grams, self.contexts))
        for c, v in self.contexts.of(context[-1][live]).items():
            of_context[c][live] = v
        live = live[found[live]]
        for c, v in self.grams.of(gram[-1][live]).items():
            of_gram[c][live] = v
        logs = []
        for kind in "to":
            name = kind if fold is None else f"{kind}{fold}"
            count, total, kinds = of_gram[name], of_context[name], of_context[f"k_{name}"]
            # one more shared observation of mass DISCOUNT steadies contexts that a class has hardly seen
            logs.append(np.log((np.maximum(count - DISCOUNT, 0) + DISCOUNT * (kinds + 1) * p) / (np.maximum(total, 0) + DISCOUNT)))
        return np.bincount(owner, logs[0] - logs[1], len(words))


class Evidence(dict):
    """word -> log ratio, filled for many new words at a time; of an older generation only words that come again stay."""

    def __init__(self, model: Model, fold: int | None):
        self.model, self.fold, self.old = model, fold, {}

    def __missing__(self, word: str) -> float:
        self[word] = found = self.old[word]
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > 200_000:
            self.old = dict(self)
            self.clear()
        words = [_WORDS.findall((t or "").lower()) for t in texts]
        new = list(set().union(*map(set, words)) - self.keys() - self.old.keys())
        for a in range(0, len(new), 5_000):
            part = new[a : a + 5_000]
            self.update(zip(part, self.model.log_ratio(part, self.fold).tolist()))
        out = np.zeros((len(texts), FEATURES))
        for i, w in enumerate(words):
            if w:
                e = np.fromiter(map(self.__getitem__, w), float, len(w))
                top = np.sort(np.partition(e, max(0, len(e) - 5))[-5:])[::-1]
                over = [np.maximum(e - least, 0).sum() for least in (1, 2, 3)]
                out[i] = (e.sum() / (sum(map(len, w)) + len(w)), top[0], top[:2].mean(), top.mean(), *np.log1p(over), np.log1p(100 * over[1] / len(w)), np.log(len(w)))
        return out


class Calibration:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        if self.constant is not None:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            self.w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(self.w)), z.T @ (p - y) + penalty @ self.w)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -500, 500)))


def features(docs: DataFrame, model, id_col: str, text_col: str, fold_col: str | None = None) -> DataFrame:
    """``doc_id, x``; with ``fold_col`` each row is judged by the model of that fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Model.opened(model, fold_col is not None) as counts:
            own = {f: Evidence(counts, f) for f in ((None,) if fold_col is None else (0, 1))}
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    texts, folds = part.column(1).to_pylist(), part.column(2).to_pylist()
                    x = np.zeros((len(texts), FEATURES))
                    for f, evidence in own.items():
                        rows = [i for i, of in enumerate(folds) if of == f]
                        if rows:
                            x[rows] = evidence.features([texts[i] for i in rows])
                    yield pa.record_batch([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])
            own.clear()

    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), fold.alias("fold"))
    return rows.mapInArrow(run, "doc_id long, x binary")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id"):
    """(folders of the model, calibration), learned from the labels whose id is not held out."""
    known = cut(label_rows(labels, label_col, label_id).withColumn("fold", F.pmod(F.xxhash64("lab_id"), F.lit(2)).cast("int")))
    side = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    texts = docs.select(F.col(id_col).cast("long").alias("lab_id"), F.col(text_col).cast("string").alias("text")).join(side, "lab_id")
    table = stored(gram_counts(word_counts(texts.select("text", "fold", "y"))))
    model = tables(table)
    sample = cut(bounded_sample(known, "lab_id", CALIBRATION_ROWS, known.count()))
    chosen = docs.select(F.col(id_col).cast("long").alias("lab_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "lab_id")
    # the fold that was not learned from
    x = features(chosen.withColumn("other", 1 - F.col("fold")), model, "lab_id", "text", "other").join(F.broadcast(sample.select(F.col("lab_id").alias("doc_id"), "y")), "doc_id")
    rows = x.toPandas().sort_values(["doc_id", "x"])
    values = np.frombuffer(b"".join(rows["x"]), float).reshape(-1, FEATURES)
    return model, Calibration(values, rows["y"].to_numpy(int))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **columns) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null and empty texts have no evidence and are scored like the rest; texts of any length are
    scored whole; without both classes among the labels all scores are the smoothed share of
    label 1. Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """
    model, calibration = train(docs, labels, id_col=id_col, text_col=text_col, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(-1, FEATURES)
            yield pa.record_batch([batch.column(0), pa.array(calibration.probability(x))], names=["doc_id", "score"])

    scored = features(docs, model, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **columns) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``: row by row, without a join.

    Nulls, empty and long texts are treated as in ``score_toxicity``; repeated rows get equal scores; null ids and all columns stay.
    """
    model, calibration = train(docs, labels, id_col=id_col, text_col=text_col, **columns)
    at, names = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Model.opened(model, False) as counts:
            evidence = Evidence(counts, None)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    x = evidence.features(part.column(at).to_pylist())
                    yield part.filter(pa.array(calibration.probability(x) < threshold))

    return docs.mapInArrow(run, names)
