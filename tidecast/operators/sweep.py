"""Sweeps: questions about a key's past, answered by small states that run through its events in order of time.

Where a running answer is no sum or maximum (the last N by another order, streaks under late results, decay,
entry and expiry), rows are shuffled by key, sorted by time and streamed through states in the tasks: memory is that of one
state, however many rows a key has. Keys with more than SWEEP_ROWS rows are cut into stretches of time
of about that size, which are swept at the same time: first each stretch alone is summed up as a state, then the states of a key
are merged in order, and each stretch begins from what came before it. States that can (``block``) take the rows of a key in
a batch as whole arrays; where their results did not become known in the order of play, and for short keys, rows go one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_folder

#: Rows of a key up to which it is swept as one; beyond, it is cut at quantiles of its times, CUTS at most.
SWEEP_ROWS = 2_000_000
CUTS = 256
#: Up to so many large keys, each with CUTS times at most, are broadcast.
BROADCAST_KEYS = 1_000
QUERY, EVENT, CARRY = 0, 1, -1
#: Rows of a key in a batch from which on they are taken as arrays.
BLOCK_ROWS = 32


class Block:
    """Rows of one key in a batch: places of its events and queries, and how many of the events come before each query."""

    def __init__(self, columns: list[pa.Array], numbers: dict, tags: np.ndarray, low: int):
        self.columns, self.numbers = columns, numbers
        is_event = tags == EVENT
        self.events, self.queries = low + np.flatnonzero(is_event), low + np.flatnonzero(~is_event)
        self.before = np.cumsum(is_event)[~is_event]

    def whole(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a column of the batch, and which of them are there."""
        if i not in self.numbers:
            c = self.columns[i]
            there = np.ones(len(c), bool) if not c.null_count else c.is_valid().to_numpy(zero_copy_only=False)
            self.numbers[i] = ((c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False), there)
        return self.numbers[i]

    def event(self, i: int) -> np.ndarray:
        return self.whole(i)[0][self.events]

    def complete(self, *places: int) -> bool:
        """Whether all events have these columns."""
        return all(self.whole(i)[1][self.events].all() for i in places)

    def values(self, i: int, events: slice) -> list:
        return values(self.columns[i].take(pa.array(self.events[events])))


class State(Protocol):
    """What is known of a key so far. ``row`` has the sweep's columns by position.

    A state may also have ``fits``, whether it can take a block, and ``block``, which adds its events and gives a column (values, which are there)
    of answers for each column of ``answer``.
    """

    def add(self, row: tuple) -> None: ...

    def answer(self, row: tuple) -> Sequence[Any]: ...

    def merge(self, earlier: Any) -> None:
        """Take in ``earlier``, the state of events that became known before all of this one's."""


def stretches(rows: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """``key`` columns and ``__cuts``, the times at which the rows of a large key are cut; None if there is no such key."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= SWEEP_ROWS:
        return None
    shared_folder(rows.sparkSession)
    large = small_side(sizes.where(F.col("__n") > SWEEP_ROWS).checkpoint())
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]
    side = large.select(*(F.col(k).alias(f"__k_{k}") for k in key), "__n")
    quantiles = F.percentile_approx("t", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), 4 * CUTS)
    found = rows.join(side, same).groupBy(*key).agg(quantiles.alias("q"), F.first("__n").alias("__n"))
    # every so many quantiles, as the rows of the key need
    every = F.greatest(F.lit(1), F.floor(F.lit(float(CUTS * SWEEP_ROWS)) / F.col("__n")).cast("int"))
    return small_side(found.select(*key, F.array_distinct(F.filter("q", lambda _, i: (i + 1) % every == 0)).alias("__cuts")).checkpoint())


def small_side(keys: DataFrame) -> DataFrame:
    """Large keys (materialised), broadcast where they are few, so that their rows are not shuffled by key to be marked."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def sweep(rows: DataFrame, key: Sequence[str], ident: Sequence[str], columns: Sequence[str], start: Callable[[], State], out: str, ties: Sequence[str] = ()) -> DataFrame:
    """``ident`` columns of each query row and the columns of ``out`` (a schema), as the key's state answers.

    ``rows`` has the key, ``t`` (long), ``tag`` (QUERY or EVENT), ``ident`` and ``columns``; a query sees the events of its key
    with a smaller ``t``; rows of equal ``t`` come in the order of ``ties``. Rows of a null key are answered like any other key's; queries without a time see nothing, events without one are never seen.
    """
    spark_type = {f.name: f for f in rows.schema}
    names = [*key, "__b", "t", "tag", *ident, *columns]
    rows = rows.where((F.col("tag") == QUERY) | F.col("t").isNotNull())
    cuts = stretches(rows, key)
    if cuts is None:
        placed = rows.withColumn("__b", F.lit(0))
    else:
        joined = rows.alias("r").join(cuts.select(*(F.col(k).alias(f"__k_{k}") for k in key), "__cuts"), [F.col(f"r.{k}").eqNullSafe(F.col(f"__k_{k}")) for k in key], "left")
        # a row at a cut belongs before it
        placed = joined.withColumn("__b", F.when(F.col("__cuts").isNull() | F.col("t").isNull(), F.lit(0)).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("t")))))
    placed = placed.select(*names)
    own, at_t, at_tag, at_row = len(key) + 1, len(key) + 1, len(key) + 2, len(key) + 1
    ident_from = len(key) + 3

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
        """Rows as tuples, and whether each begins a new key or stretch."""
        current: tuple | None = None
        for batch in batches:
            for row in zip(*map(values, batch.columns)):
                new = row[:own] != current
                current = row[:own]
                yield new, row
            yield False, ()  # the batch is over

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, ident_to = start(), None, ident_from + len(ident)
        kinds = [f.type for f in arrow][len(ident) :]
        for batch in batches:
            if not batch.num_rows:
                continue
            tags, ends = batch.column(at_tag).to_numpy(), changes(batch.columns[:own])
            short = len(ends) * BLOCK_ROWS > batch.num_rows or not hasattr(state, "block")
            low, numbers, lists, pieces, found = 0, {}, None, [], []
            for high in ends:
                at = tuple(c[low].as_py() for c in batch.columns[:own])
                if at != current:
                    state, current = start(), at
                block = None
                if not short and high - low >= BLOCK_ROWS and tags[low] != CARRY:
                    block = Block(batch.columns[at_row:], numbers, tags[low:high], low)
                if block is not None and state.fits(block):
                    if found:
                        pieces.append([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)])
                        found = []
                    pieces.append([pa.array(v, kind, mask=~there) for (v, there), kind in zip(state.block(block), kinds)])
                else:
                    if short and lists is None:
                        lists = list(map(values, batch.columns[at_row:]))
                    own_lists = [c[low:high] for c in lists] if short else [values(c.slice(low, high - low)) for c in batch.columns[at_row:]]
                    for tag, row in zip(tags[low:high].tolist(), zip(*own_lists)):
                        if tag == EVENT:
                            state.add(row)
                        elif tag == QUERY:
                            found.append(state.answer(row))
                        else:
                            state = pickle.loads(row[-1])
                low = high
            if found:
                pieces.append([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)])
            if pieces:
                # the identity of query rows goes on as it came
                asked = batch.filter(pc.equal(batch.column(at_tag), QUERY)).columns[ident_from:ident_to]
                yield pa.record_batch([*(c.cast(f.type) for c, f in zip(asked, arrow)), *(pa.concat_arrays(c) for c in zip(*pieces))], schema=arrow)

    schema = T.StructType([spark_type[c] for c in ident] + list(T._parse_datatype_string(out).fields))
    arrow = arrow_schema(schema)
    if cuts is None:
        return placed.repartition(*key).sortWithinPartitions(*key, "__b", "t", "tag", *ties).mapInArrow(answers, schema)

    kinds = T.StructType([spark_type[k] for k in key] + [T.StructField("__b", T.IntegerType()), T.StructField("state", T.BinaryType())])
    arrow_states = arrow_schema(kinds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, done = None, None, []
        for new, row in grouped(batches):
            if new:
                if state is not None:
                    done.append((*current, pickle.dumps(state)))
                state, current = start(), row[:own]
            if row and row[at_tag] == EVENT:
                state.add(row[at_row:])
            if not row and done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), arrow_states)], schema=arrow_states)
                done = []
        if state is not None:
            done.append((*current, pickle.dumps(state)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), arrow_states)], schema=arrow_states)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, current = None, None
        for batch in batches:
            done = []
            for row in zip(*map(values, batch.columns)):
                if row[:-2] != current:
                    before, current = None, row[:-2]
                if before is not None:
                    done.append((*row[:-1], pickle.dumps(before)))
                state = pickle.loads(row[-1])
                if before is not None:
                    state.merge(before)
                before = state
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), arrow_states)], schema=arrow_states)

    cut_keys = cuts.select(*(F.col(k).alias(f"__k_{k}") for k in key))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]
    hot = placed.join(cut_keys, same, "left_semi")
    sums = hot.repartition(*key, "__b").sortWithinPartitions(*key, "__b", "t", "tag").mapInArrow(summed, kinds)
    starts = sums.repartition(*key).sortWithinPartitions(*key, "__b").mapInArrow(carried, kinds)
    carry = starts.select(*key, "__b", F.lit(None).cast("long").alias("t"), F.lit(CARRY).alias("tag"), *(F.lit(None).cast(spark_type[c].dataType).alias(c) for c in (*ident, *columns)), "state")
    both = placed.withColumn("state", F.lit(None).cast("binary")).unionByName(carry)
    # the state a stretch begins from stands before its rows
    order = F.when(F.col("tag") == CARRY, F.lit(0)).otherwise(F.lit(1))
    return both.repartition(*key, "__b").sortWithinPartitions(*key, "__b", order, "t", "tag", *ties).mapInArrow(answers, schema)


def values(column: pa.Array) -> list:
    """``to_pylist`` by whole columns: it makes an Arrow scalar of each value, which took most of a sweep's time."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).astype(object)
    out[column.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def changes(columns: Sequence[pa.Array]) -> list[int]:
    """The places behind the last of equal rows, the end included."""
    new = np.zeros(len(columns[0]), bool)
    new[-1] = True
    for c in columns:
        codes = c.dictionary_encode("encode").indices.to_numpy()
        new[:-1] |= codes[1:] != codes[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


class All:
    """Several states side by side."""

    def __init__(self, *states: State):
        self.states = states

    def add(self, row: tuple) -> None:
        for s in self.states:
            s.add(row)

    def answer(self, row: tuple) -> list:
        return [x for s in self.states for x in s.answer(row)]

    def fits(self, rows: Block) -> bool:
        return all(s.fits(rows) for s in self.states)

    def block(self, rows: Block) -> list:
        return [x for s in self.states for x in s.block(rows)]

    def merge(self, earlier: All) -> None:
        for s, e in zip(self.states, earlier.states):
            s.merge(e)
