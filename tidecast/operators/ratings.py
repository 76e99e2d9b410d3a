"""Sequential ratings: Elo and online Poisson strengths, exact and in bounded tasks.

The recurrence couples both teams of each match, so along a chain of matches it is sequential. But within a short
slice of time the graph of who plays whom falls apart. Time is cut into slices in which every connected component
has at most SLICE_ROWS matches (``plan_slices`` halves those with larger ones); components are packed into groups of about
that size, which run at the same time. A team's state after its matches of a slice is written straight to the next slice
in which it plays, so a slice reads the states of its own teams and no others. A single instant in which
more matches hang together needs no order at all: its matches see the same state, and their changes are added up by team.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import IMPORTANCE, importance, micros
from ..sources.scratch import scratch, shared_folder
from .history import rate_by_kickoff

YEAR_MICROS = 365.25 * 86_400e6
#: A slice of so many matches or fewer is one group; in a larger one no component, and about no group, has more.
SLICE_ROWS = 1_000_000
#: Groups of components are about so many to the matches of one slice.
GROUPS = 10
#: Slices are first tried with so many teams for each match, below the point where most teams of a random graph hang together.
TEAMS_A_MATCH = 4
#: Edges that a task holds while it reduces them to a forest.
FOREST_ROWS = 1_000_000
NEVER = np.iinfo(np.int64).min
#: Where rows of a run's table go besides slices.
RESULTS, LAST_STATES = -1, -2


@dataclass(frozen=True)
class Elo:
    initial: float = 1500.0
    k: float = 20.0
    home: float = 60.0
    host: float = 35.0
    goal_difference: bool = True
    regression_per_year: float = 0.10
    weights: dict[str, float] = field(default_factory=lambda: dict(IMPORTANCE))
    #: "kickoff" applies a result at its teams' next kickoff; "available" only once it was known.
    gate: str = "kickoff"


@dataclass(frozen=True)
class OnlinePoisson:
    initial_goals: float = 1.25
    prior_matches: float = 100.0
    learning_rate: float = 0.035
    half_life_years: float = 4.0
    home_log_advantage: float = 0.16
    max_residual: float = 3.0


def team_pools(matches: DataFrame) -> DataFrame:
    """``team, pool``: connected components of the graph of who played whom, by spreading the least name.

    Each task first reduces its matches to a forest, which links the same teams in at most one row for each. Labels jump
    along their own labels, so rounds grow with the logarithm of the longest chain; each round is checkpointed.
    """
    shared_folder(matches.sparkSession)
    edges = matches.select(F.coalesce("team1", "team2").alias("team1"), F.coalesce("team2", "team1").alias("team2")).where("team1 is not null")
    edges = edges.mapInArrow(forest, "team1 string, team2 string")
    both = edges.unionByName(edges.select(F.col("team2").alias("team1"), F.col("team1").alias("team2"))).distinct().checkpoint()
    labels = both.groupBy(F.col("team1").alias("team")).agg(F.least(F.min("team1"), F.min("team2")).alias("pool")).checkpoint()
    changed = 1
    while changed:
        near = both.join(labels.withColumnRenamed("team", "team2"), "team2").groupBy(F.col("team1").alias("team")).agg(F.min("pool").alias("near"))
        new = labels.join(near, "team").select("team", F.least("pool", "near").alias("pool"))
        jump = labels.select(F.col("team").alias("pool"), F.col("pool").alias("further"))
        new = new.join(jump, "pool", "left").select("team", F.least("pool", F.coalesce("further", "pool")).alias("pool")).checkpoint()
        changed = new.join(labels.withColumnRenamed("pool", "old"), "team").where("pool <> old").limit(1).count()
        labels = new
    return labels


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same teams as those of ``batches``: each team with the least name that it is linked to here.

    At most about FOREST_ROWS edges are held; what they link goes on as a forest, or out where that has as many rows again.
    """
    kept: list[pa.Table] = []
    rows = 0
    for batch in batches:
        kept.append(pa.Table.from_arrays(batch.columns, names=["team1", "team2"]))
        rows += batch.num_rows
        if rows >= FOREST_ROWS:
            tree = stars(pa.concat_tables(kept))
            kept, rows = [tree], tree.num_rows
            if rows > FOREST_ROWS // 2:
                yield from tree.to_batches(10_000)
                kept, rows = [], 0
    if kept:
        yield from stars(pa.concat_tables(kept)).to_batches(10_000)


def stars(edges: pa.Table) -> pa.Table:
    """``team1, team2``: each team of ``edges`` and the least name of its component."""
    names = pa.chunked_array([*edges["team1"].chunks, *edges["team2"].chunks], pa.string()).combine_chunks().dictionary_encode()
    dictionary = names.dictionary.to_numpy(zero_copy_only=False)
    # names in the order of their bytes, as Spark compares them
    order = np.argsort(np.array([n.encode() for n in dictionary], object), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b = place[names.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(order))
    while True:
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[a], label[b]):
            break
    names = dictionary[order]
    return pa.table({"team1": pa.array(names, pa.string()), "team2": pa.array(names[label], pa.string())})


class Group:
    """Matches of one group in order, their teams as numbers, and where batches of equal kickoffs begin and end."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.rows = rows.take(pc.sort_indices(rows, sort_keys=[("k", "ascending"), ("match_id", "ascending")]))
        names = pa.chunked_array([*self.rows["team1"].chunks, *self.rows["team2"].chunks], pa.string()).combine_chunks().dictionary_encode("encode")
        self.teams = names.dictionary
        #: both teams of each match, one after the other
        self.both = paired(*names.indices.to_numpy().astype(np.int64).reshape(2, -1))
        k = self.column("k").astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, int)
        self.batches = list(zip(k[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist()))

    def column(self, name: str) -> np.ndarray:
        return self.rows[name].to_numpy()

    def known(self) -> np.ndarray:
        """When the result of each match was known; at once where nothing is said."""
        return pc.fill_null(self.rows["a"], NEVER).to_numpy().astype(np.int64)

    def places(self) -> np.ndarray:
        """How often each team stands before in the same batch."""
        twice = np.repeat(self.column("k").astype(np.int64), 2)
        order = np.lexsort((np.arange(len(twice)), self.both, twice))
        new = np.concatenate([[True], (self.both[order][1:] != self.both[order][:-1]) | (twice[order][1:] != twice[order][:-1])]) if len(twice) else np.zeros(0, bool)
        first, rank = np.flatnonzero(new), np.zeros(len(twice), np.int64)
        rank[order] = np.arange(len(twice)) - np.repeat(first, np.diff(np.append(first, len(twice))))
        return rank


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([x, y], 1).ravel()


class Pending:
    """Changes by team that count once their result is known. Each batch adds one run of them in order of that time; the runs wait in a heap.

    A change that is known may be applied at any kickoff up to the team's next one, as nothing fades in between.
    """

    def __init__(self, width: int):
        self.heap: list[tuple] = []
        self.kind, self.n = np.dtype([("at", np.int64), ("by", np.float64, (width,))]), 0

    def add(self, team: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
        if len(at):
            order = np.argsort(at, kind="stable")
            self.put(0, (at[order], team[order], by[order]))

    def put(self, place: int, run: tuple) -> None:
        self.n += 1
        heappush(self.heap, (int(run[0][place]), self.n, place, run))

    def due(self, now: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(teams, changes) whose time is before ``now``; they are taken out."""
        while self.heap and self.heap[0][0] < now:
            _, _, place, run = heappop(self.heap)
            end = int(np.searchsorted(run[0], now))
            yield run[1][place:end], run[2][place:end]
            if end < len(run[0]):
                self.put(end, run)

    def read(self, team: np.ndarray, values: list) -> None:
        """Take in what ``packed`` wrote for some teams."""
        held = [(t, v) for t, v in zip(team.tolist(), values) if v]
        rows = np.frombuffer(b"".join(v for _, v in held), self.kind)
        self.add(np.repeat([t for t, _ in held], [len(v) // self.kind.itemsize for _, v in held]).astype(np.int64), rows["at"], rows["by"])

    def packed(self, teams: int) -> list:
        """The rest for each of ``teams``, as bytes; None where there is nothing."""
        runs = [tuple(x[place:] for x in run) for _, _, place, run in sorted(self.heap, key=lambda x: x[:2])]
        if not runs:
            return [None] * teams
        at, team, by = (np.concatenate(x) for x in zip(*runs))
        order, rows = np.argsort(team, kind="stable"), np.empty(len(at), self.kind)
        rows["at"], rows["by"] = at[order], by[order]
        data, ends = rows.tobytes(), (np.cumsum(np.bincount(team, minlength=teams)) * self.kind.itemsize).tolist()
        return [data[a:b] or None for a, b in zip([0, *ends], ends)]

    def tuples(self, data: bytes | None) -> list[tuple]:
        return [(int(at), *by.tolist()) for at, by in np.frombuffer(data or b"", self.kind)]

    def bytes_of(self, changes: list[tuple]) -> bytes | None:
        return np.array([(at, by) for at, *by in changes], self.kind).tobytes() or None


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (part.split() for part in schema.split(", "))])


class Run:
    """Steps of a rating through a group. Teams' states go from slice to slice as columns; streams and single instants hold them as tuples."""

    schema: str
    state: str

    def opened(self, g: Group, came: pa.Table) -> tuple[dict, Pending]:
        """The state of each team of the group by column, and what is pending; ``came`` has those that are known."""

    def played(self, g: Group, s: dict, pending: Pending, parts: bool) -> tuple[list, object]:
        """Plays the group: result columns without the match, and changes of each team if ``parts``."""

    def closed(self, s: dict, pending: Pending, teams: int) -> dict[str, pa.Array]:
        """The columns of ``state`` for each team."""

    def results(self, g: Group, columns: dict[str, np.ndarray]) -> pa.Table:
        kinds = arrow_schema(self.schema)
        return pa.table({"match_id": g.rows["match_id"], **{c: columns[c] for c in kinds.names[1:]}}, schema=kinds)

    def state_schema(self) -> pa.Schema:
        return arrow_schema(f"team string, {self.state}")

    def run(self, pdf: pd.DataFrame, states: dict, parts: bool = False) -> tuple[pd.DataFrame, dict]:
        """Results, and the new state of each team; with ``parts`` (one instant) its changes instead, for ``merged``."""
        g = Group(pa.Table.from_pandas(pdf, preserve_index=False))
        came = pa.Table.from_pylist([{"team": t, **self.as_row(v)} for t, v in states.items()], self.state_schema())
        s, pending = self.opened(g, came.filter(pc.is_in(came["team"], g.teams)))
        columns, changes = self.played(g, s, pending, parts)
        table = self.results(g, columns).to_pandas(integer_object_nulls=True)
        names = g.teams.to_pylist()
        if parts:
            return table, dict(zip(names, changes))
        closed = pa.table(self.closed(s, pending, len(names))).to_pylist()
        return table, {t: self.as_tuple(r) for t, r in zip(names, closed)}


class EloRun(Run):
    """Elo of a group. A team's state: rating, last kickoff, latest availability, last ratings and pending changes.

    ``columns`` are the results that are written; all of them if None.
    """

    def __init__(self, cfg: Elo, windows: Sequence[int], columns: Sequence[str] | None = None):
        self.cfg, self.windows, self.keep = cfg, tuple(windows), max(windows, default=0)
        momentum = [c for n in self.windows for c in (f"elo_momentum_team1_roll{n}", f"elo_momentum_team2_roll{n}", f"elo_momentum_roll{n}_diff")]
        self.numbers = ["elo_team1_pre", "elo_team2_pre", "elo_diff_pre", "elo_exp_team1", "elo_importance", *momentum]
        kinds = {**{c: "double" for c in self.numbers}, "elo_team1_known": "long", "elo_team2_known": "long"}
        self.schema = "match_id string, " + ", ".join(f"{c} {k}" for c, k in kinds.items() if columns is None or c in columns)
        self.state = "rating double, played long, known long, past binary, pending binary"

    def faded(self, rating, years):
        return self.cfg.initial + (rating - self.cfg.initial) * (1 - self.cfg.regression_per_year) ** years

    def opened(self, g: Group, came: pa.Table) -> tuple[dict, Pending]:
        n, width, pending = len(g.teams), self.keep, Pending(1)
        s = {"rating": np.full(n, self.cfg.initial), "played": np.full(n, NEVER), "known": np.full(n, NEVER), "past": np.zeros((n, width)), "count": np.zeros(n, np.int64)}
        at = pc.index_in(came["team"], g.teams).to_numpy().astype(np.int64)
        for c in ("rating", "played", "known"):
            s[c][at] = came[c].to_numpy()
        if width:
            for i, data in zip(at.tolist(), came["past"].to_pylist()):
                last = np.frombuffer(data or b"")
                s["past"][i, : len(last)], s["count"][i] = last, len(last)
        pending.read(at, came["pending"].to_pylist())
        return s, pending

    def played(self, g: Group, s: dict, pending: Pending, parts: bool) -> tuple[dict, list | None]:
        cfg, late, width = self.cfg, self.cfg.gate == "available", self.keep
        rating, played, known, past, count = (s[c] for c in ("rating", "played", "known", "past", "count"))
        a, rank = np.repeat(g.known(), 2), g.places() if width else None
        weight, margin = g.column("importance").astype(float), g.column("team1_goals").astype(np.int64) - g.column("team2_goals").astype(np.int64)
        scale = np.where((np.abs(margin) > 1) & cfg.goal_difference, 1 + np.log(np.maximum(np.abs(margin), 1)), 1.0)
        gap = cfg.host * g.column("host2") - np.where(g.column("neutral").astype(bool), 0.0, cfg.home) - cfg.host * g.column("host1")
        size, actual = cfg.k * weight * scale, 0.5 + 0.5 * np.sign(margin)
        out = {c: np.empty(len(g.rows)) for c in self.numbers}
        out["elo_importance"], seen, change = weight, np.empty(len(a), np.int64), np.zeros(len(rating))
        new = Pending(1) if parts else pending
        for now, lo, hi in g.batches:
            both, rows, sides = g.both[2 * lo : 2 * hi], slice(lo, hi), slice(2 * lo, 2 * hi)
            for team, by in pending.due(now):
                np.add.at(rating, team, by[:, 0])
            before = played[both]
            current = self.faded(rating[both], np.where(before == NEVER, 0.0, np.maximum(0.0, (now - np.where(before == NEVER, now, before)) / YEAR_MICROS)))
            c1, c2 = current[::2], current[1::2]
            expected = 1 / (1 + 10 ** ((c2 - c1 + gap[rows]) / 400))
            delta = size[rows] * (actual[rows] - expected)
            for name, v in zip(self.numbers, (c1, c2, c1 - c2, expected)):
                out[name][rows] = v
            for w in self.windows:
                m = current - np.where(count[both] >= w, past[both, (count[both] - w) % width], cfg.initial)
                for name, v in zip((f"elo_momentum_team1_roll{w}", f"elo_momentum_team2_roll{w}", f"elo_momentum_roll{w}_diff"), (m[::2], m[1::2], m[::2] - m[1::2])):
                    out[name][rows] = v
            seen[sides] = known[both]
            moved = paired(delta, -delta)
            rating[both] = current
            if late:
                new.add(both, a[sides], moved[:, None])
            else:
                change[both] = 0.0
                np.add.at(change, both, moved)
                rating[both] = current + change[both]
            played[both] = now
            np.maximum.at(known, both, a[sides])
            if width:
                past[both, (count[both] + rank[sides]) % width] = current
                np.add.at(count, both, 1)
        for side in (1, 2):
            out[f"elo_team{side}_known"] = pa.array(seen[side - 1 :: 2], mask=seen[side - 1 :: 2] == NEVER)
        if not parts:
            return out, None
        own, waits = np.bincount(g.both, minlength=len(rating)), new.packed(len(rating))
        return out, [(float(change[i]), int(own[i]), int(known[i]), by_time(new.tuples(waits[i]))) for i in range(len(rating))]

    def closed(self, s: dict, pending: Pending, teams: int) -> dict[str, pa.Array]:
        width, past = self.keep, [None] * teams
        if width:  # the oldest first
            turn = (np.maximum(s["count"], width)[:, None] + np.arange(width)) % width
            rows = np.take_along_axis(s["past"], np.where(s["count"][:, None] >= width, turn, np.arange(width)), 1)
            past = [r[:n].tobytes() for r, n in zip(rows, np.minimum(s["count"], width).tolist())]
        return {**{c: pa.array(s[c]) for c in ("rating", "played", "known")}, "past": pa.array(past, pa.binary()), "pending": pa.array(pending.packed(teams), pa.binary())}

    def as_tuple(self, row: dict) -> tuple:
        return row["rating"], row["played"], row["known"], np.frombuffer(row["past"] or b"").tolist(), Pending(1).tuples(row["pending"])

    def as_row(self, state: tuple) -> dict:
        rating, played, known, past, pending = state
        return {"rating": rating, "played": played, "known": known, "past": np.array(past, float).tobytes(), "pending": Pending(1).bytes_of(pending)}

    def merged(self, state: tuple | None, now: int, parts: list[tuple]) -> tuple:
        """The state after one instant, whose changes come in parts."""
        rating, played, known, past, pending = state or (self.cfg.initial, NEVER, NEVER, [], [])
        if self.cfg.gate == "available":
            rating += sum(d for at, d in pending if at < now)
            pending = [p for p in pending if p[0] >= now]
        current = self.faded(rating, 0.0 if played == NEVER else max(0.0, (now - played) / YEAR_MICROS))
        past = [*past, *[current] * min(self.keep, sum(p[1] for p in parts))][-self.keep :] if self.keep else []
        return current + sum(p[0] for p in parts), now, max(known, *(p[2] for p in parts)), past, [*pending, *by_time([x for p in parts for x in p[3]])]


def by_time(changes: list[tuple]) -> list[tuple]:
    """(time, amounts) added up for each time."""
    total: dict[int, tuple] = {}
    for at, *d in changes:
        total[at] = tuple(x + y for x, y in zip(total[at], d)) if at in total else tuple(d)
    return [(at, *d) for at, d in sorted(total.items())]


class StrengthRun(Run):
    """Online Poisson strengths of a group. A team's state: attack, defence, last kickoff and pending changes."""

    numbers = ["online_attack_team1_pre", "online_defence_team1_pre", "online_attack_team2_pre", "online_defence_team2_pre", "online_global_goals_pre", "online_lambda_team1_pre", "online_lambda_team2_pre"]
    schema = "match_id string, " + ", ".join(f"{c} double" for c in numbers)
    state = "attack double, defence double, played long, pending binary"

    def __init__(self, cfg: OnlinePoisson):
        self.cfg = cfg

    def fade(self, years):
        return 0.5 ** (years / self.cfg.half_life_years)

    def opened(self, g: Group, came: pa.Table) -> tuple[dict, Pending]:
        n, pending = len(g.teams), Pending(2)
        s = {"attack": np.zeros(n), "defence": np.zeros(n), "played": np.full(n, NEVER)}
        at = pc.index_in(came["team"], g.teams).to_numpy().astype(np.int64)
        for c, v in s.items():
            v[at] = came[c].to_numpy()
        pending.read(at, came["pending"].to_pylist())
        return s, pending

    def played(self, g: Group, s: dict, pending: Pending, parts: bool) -> tuple[dict, list | None]:
        cfg, attack, defence, played = self.cfg, s["attack"], s["defence"], s["played"]
        a, goals = np.repeat(g.known(), 2), np.stack([g.column("team1_goals"), g.column("team2_goals")], 1).astype(float)
        home, rate = np.where(g.column("neutral").astype(bool), 0.0, cfg.home_log_advantage), g.column("goals_rate").astype(float)
        out, new = {c: np.empty(len(g.rows)) for c in self.numbers}, Pending(2) if parts else pending
        for now, lo, hi in g.batches:
            both, rows = g.both[2 * lo : 2 * hi], slice(lo, hi)
            for team, by in pending.due(now):
                np.add.at(attack, team, by[:, 0])
                np.add.at(defence, team, by[:, 1])
            fade = self.fade(np.where(played[both] == NEVER, 0.0, np.maximum(0, now - np.where(played[both] == NEVER, now, played[both])) / YEAR_MICROS))
            up, down = attack[both] * fade, defence[both] * fade
            attack[both], defence[both], played[both] = up, down, now
            lx = np.clip(rate[rows] * np.exp(up[::2] - down[1::2] + home[rows]), 0.15, 5.0)
            ly = np.clip(rate[rows] * np.exp(up[1::2] - down[::2]), 0.15, 5.0)
            for c, v in zip(self.numbers, (up[::2], down[::2], up[1::2], down[1::2], rate[rows], lx, ly)):
                out[c][rows] = v
            moved = cfg.learning_rate * np.clip(goals[rows] - np.stack([lx, ly], 1), -cfg.max_residual, cfg.max_residual)
            new.add(both, a[2 * lo : 2 * hi], np.stack([moved.ravel(), -moved[:, ::-1].ravel()], 1))
        if not parts:
            return out, None
        return out, [by_time(new.tuples(x)) for x in new.packed(len(attack))]

    def closed(self, s: dict, pending: Pending, teams: int) -> dict[str, pa.Array]:
        return {**{c: pa.array(v) for c, v in s.items()}, "pending": pa.array(pending.packed(teams), pa.binary())}

    def as_tuple(self, row: dict) -> tuple:
        return row["attack"], row["defence"], row["played"], Pending(2).tuples(row["pending"])

    def as_row(self, state: tuple) -> dict:
        attack, defence, played, pending = state
        return {"attack": attack, "defence": defence, "played": played, "pending": Pending(2).bytes_of(pending)}

    def merged(self, state: tuple | None, now: int, parts: list) -> tuple:
        attack, defence, played, pending = state or (0.0, 0.0, NEVER, [])
        for at, up, down in pending:
            if at < now:
                attack, defence = attack + up, defence + down
        fade = self.fade(0.0 if played == NEVER else max(0, now - played) / YEAR_MICROS)
        return attack * fade, defence * fade, now, [*(p for p in pending if p[0] >= now), *by_time([x for p in parts for x in p])]


def slice_of(bounds: list[int]):
    """The number of a time's slice: slices end at ``bounds`` (inclusive), the last one has no end."""
    if not bounds:
        return F.lit(0)
    ends = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, k.to_numpy(np.int64), "left").astype(np.int32))

    return find("k")


def components_of(rows: DataFrame) -> DataFrame:
    """``slice, team, pool``: components within each slice of ``rows``."""
    node = lambda c: F.concat_ws(":", F.col("slice").cast("string"), F.col(c))
    pools = team_pools(rows.select(node("team1").alias("team1"), node("team2").alias("team2")))
    at = F.instr("team", ":")
    return pools.select(F.substring_index("team", ":", 1).cast("int").alias("slice"), F.expr("substring(team, instr(team, ':') + 1)").alias("team"), "pool")


def plan_slices(rows: DataFrame) -> tuple[list[int], DataFrame, dict[int, str]]:
    """(bounds, rows with ``slice`` and ``bin``, kind of each slice) of ``rows`` (a written table).

    A slice of at most SLICE_ROWS matches is one group ("whole"). In others components make groups of about that size; a slice with a larger component
    is halved at its middle match until there is none ("components"), or until it is one instant ("instant"), which any split by match serves.
    """
    bounds: list[int] = []
    accepted: set[tuple] = set()
    found: list[tuple[DataFrame, dict[tuple, int]]] = []  # components of the slices that a round accepted, under their numbers then
    while True:
        placed = rows.withColumn("slice", slice_of(bounds))
        ends = [None, *bounds, None]
        spans = [(ends[i], ends[i + 1]) for i in range(len(bounds) + 1)]
        sizes = {r["slice"]: r for r in placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.percentile_approx("k", 0.5).alias("middle")).collect()}
        kinds = {s: "whole" if r["n"] <= SLICE_ROWS else "instant" if r["low"] == r["high"] else "components" for s, r in sizes.items()}
        open_ = [s for s, kind in kinds.items() if kind == "components" and spans[s] not in accepted]
        if not open_:
            break
        part = placed.where(F.col("slice").isin(open_))
        pools = components_of(part).select("slice", F.col("team").alias("team1"), "pool")
        by_team = part.groupBy("slice", "team1").agg(F.count(F.lit(1)).alias("n"))  # so that teams meet their pools, not matches
        largest = {r["slice"]: r["n"] for r in by_team.join(pools, ["slice", "team1"]).groupBy("slice", "pool").agg(F.sum("n").alias("n")).groupBy("slice").agg(F.max("n").alias("n")).collect()}
        if not bounds and largest[0] > SLICE_ROWS:  # no pools that never meet: a first guess at once
            teams = rows.select(F.explode(F.array("team1", "team2")).alias("t")).agg(F.approx_count_distinct("t")).first()[0]
            room = max(1, SLICE_ROWS * 9 // 10)  # as kickoffs are not cut, slices differ in size
            slices = max(2, -(-sizes[0]["n"] // max(room, teams // TEAMS_A_MATCH)))
            inner = rows.agg(F.percentile_approx("k", [i / slices for i in range(1, slices)], max(10_000, 4 * slices))).first()[0]
            bounds = sorted({int(b) if b < sizes[0]["high"] else sizes[0]["high"] - 1 for b in inner})
            continue
        found.append((pools, {spans[s]: s for s in open_ if largest[s] <= SLICE_ROWS}))
        for s in open_:
            if largest[s] <= SLICE_ROWS:
                accepted.add(spans[s])
            else:  # both halves hold a kickoff
                r = sizes[s]
                bounds = sorted({*bounds, r["middle"] if r["middle"] < r["high"] else r["middle"] - 1})
    split = [s for s, kind in kinds.items() if kind == "components"]
    groups = F.create_map(*(F.lit(x) for s, r in sizes.items() for x in (s, max(1, -(-GROUPS * r["n"] // SLICE_ROWS))))) if sizes else None
    placed = placed.withColumn("bin", F.lit(0))
    if any(kind != "whole" for kind in kinds.values()):
        key = F.when(F.col("slice").isin([s for s, kind in kinds.items() if kind == "instant"]), F.col("match_id"))
        if split:
            numbers = {spans[s]: s for s in split}
            turns = [(pools, F.create_map(*(F.lit(x) for span, old in own.items() for x in (old, numbers[span])))) for pools, own in found if own]
            pools = reduce(DataFrame.unionByName, (p.withColumn("slice", to[F.col("slice")]).where("slice is not null") for p, to in turns))
            placed = placed.join(pools, ["slice", "team1"], "left")
            key = F.coalesce(key, "pool")
        placed = placed.withColumn("bin", F.when(key.isNotNull(), F.pmod(F.xxhash64(key), groups[F.col("slice")]).cast("int")).otherwise(0)).select(*rows.columns, "slice", "bin")
    return bounds, placed, kinds


def in_slices(rows: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """(results, last states of all teams as ``team, state``) of ``run`` over ``rows``: ``match_id, k, team1, team2`` and what ``run`` needs."""
    spark = rows.sparkSession
    path = scratch(spark, "ratings")
    rows.write.parquet(f"{path}/rows")  # once, whatever the number of slices
    rows = spark.read.parquet(f"{path}/rows")
    schema = f"{run.schema}, team string, {run.state}, to int, to_bin int"
    if rows.count() <= SLICE_ROWS:
        out = rows.groupBy().applyInArrow(lambda table: stepped(run, table, None), schema)
        return finished(out, run)

    _, placed, kinds = plan_slices(rows)
    # as many files as groups, not one for each slice and task
    placed.repartition("slice", "bin").write.partitionBy("slice").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    # where each team's state goes: its next slice, and its group there
    own = placed.select("slice", "bin", F.explode(F.array("team1", "team2")).alias("team")).groupBy("slice", "team").agg(F.min("bin").alias("bin"))
    ahead = F.lead(F.struct("slice", "bin")).over(W.partitionBy("team").orderBy("slice"))
    moves = own.withColumn("next", ahead).select("slice", "bin", "team", F.col("next.slice").alias("to"), F.col("next.bin").alias("to_bin"))
    moves.where("to is not null").repartition("slice", "bin").write.partitionBy("slice").parquet(f"{path}/moves")
    moves = spark.read.schema("bin int, team string, to int, to_bin int, slice int").parquet(f"{path}/moves")
    fed = {r["to"] for r in moves.select("to").distinct().collect()}

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        return stepped(run, left, right)

    states = f"team string, {run.state}, to_bin int"
    for s in sorted(kinds):
        part = placed.where(F.col("slice") == s).drop("slice")
        to = moves.where(F.col("slice") == s).drop("slice")
        state = spark.read.schema(states).parquet(f"{path}/run/to={s}") if s in fed else spark.createDataFrame([], states)
        state = state.withColumnRenamed("to_bin", "bin")
        if kinds[s] == "instant":
            out = one_instant(part, state.drop("bin"), to.drop("bin").checkpoint(), run, schema)
        else:
            beside = state.unionByName(to, allowMissingColumns=True)
            out = part.groupBy("bin").cogroup(beside.groupBy("bin")).applyInArrow(step, schema)
        out.write.mode("append").partitionBy("to").parquet(f"{path}/run")
    return finished(spark.read.schema(schema).parquet(f"{path}/run"), run)


def finished(found: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """Results, and last states as pickled tuples."""

    def pickled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [pickle.dumps(run.as_tuple(r)) for r in batch.to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(states, pa.binary())], names=["team", "state"])

    last = found.where(F.col("to") == LAST_STATES).select(*run.state_schema().names)
    return found.where(F.col("to") == RESULTS).select(*arrow_schema(run.schema).names), last.mapInArrow(pickled, "team string, state binary")


def stepped(run: Run, matches: pa.Table, beside: pa.Table | None) -> pa.Table:
    """Results of a group and the states of its teams after it. ``beside`` has a row for each state that comes in (without ``to``) and for each that goes on."""
    g, kinds = Group(matches), run.state_schema()
    came = kinds.empty_table() if beside is None else beside.filter(pc.is_null(beside["to"])).select(kinds.names)
    s, pending = run.opened(g, came.cast(kinds))
    columns, _ = run.played(g, s, pending, False)
    states = pa.table({"team": g.teams, **run.closed(s, pending, len(g.teams))})
    to, to_bin = np.full(len(g.teams), LAST_STATES, np.int32), np.zeros(len(g.teams), np.int32)
    if beside is not None:
        goes = beside.filter(pc.is_valid(beside["to"]))
        at = pc.index_in(goes["team"], g.teams).to_numpy()
        to[at], to_bin[at] = goes["to"].to_numpy(), goes["to_bin"].to_numpy()
    return beside_results(run.results(g, columns), states, to, to_bin)


def beside_results(results: pa.Table, states: pa.Table, to: np.ndarray, to_bin: np.ndarray) -> pa.Table:
    """Results and states as rows of one table."""
    results = results.append_column("to", pa.array(np.full(len(results), RESULTS, np.int32)))
    states = states.append_column("to", pa.array(to, pa.int32())).append_column("to_bin", pa.array(to_bin, pa.int32()))
    names = [*results.column_names[:-1], *states.column_names]
    return pa.concat_tables([results, states], promote_options="default").select(names)


def one_instant(part: DataFrame, state: DataFrame, to: DataFrame, run: Run, schema: str) -> DataFrame:
    """A slice of one kickoff: groups of any matches see the same states, and what they change is merged by team."""
    spark, kinds = part.sparkSession, run.state_schema()
    asked = part.select(F.col("bin").alias("of"), F.explode(F.array("team1", "team2")).alias("team")).distinct().join(state, "team")

    def see(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left)
        columns, changes = run.played(g, *run.opened(g, right.select(kinds.names).cast(kinds)), True)
        rows = pa.Table.from_pylist([{"team": t, "pending": pickle.dumps(c)} for t, c in zip(g.teams.to_pylist(), changes)], kinds)
        return beside_results(run.results(g, columns), rows, np.full(len(rows), LAST_STATES), np.zeros(len(rows)))

    path = scratch(spark, "instant")
    part.groupBy("bin").cogroup(asked.groupBy("of")).applyInArrow(see, schema).write.partitionBy("to").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    now = part.select("k").first()["k"]
    bins = part.agg(F.max("bin")).first()[0] + 1
    spread = F.pmod(F.xxhash64("team"), F.lit(bins))
    parts = out.where(F.col("to") == LAST_STATES).select("team", F.col("pending").alias("part")).join(to, "team", "left").withColumn("at", spread)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        before, found, moves = {r["team"]: run.as_tuple(r) for r in right.select(kinds.names).to_pylist()}, {}, {}
        for r in left.to_pylist():
            found.setdefault(r["team"], []).append(pickle.loads(r["part"]))
            moves[r["team"]] = (LAST_STATES, 0) if r["to"] is None else (r["to"], r["to_bin"])
        after = pa.Table.from_pylist([{"team": t, **run.as_row(run.merged(before.get(t), now, p))} for t, p in found.items()], kinds)
        where = np.array([moves[t] for t in found]).reshape(-1, 2)
        return beside_results(arrow_schema(run.schema).empty_table(), after, where[:, 0], where[:, 1])

    merged = parts.groupBy("at").cogroup(state.withColumn("near", spread).groupBy("near")).applyInArrow(merge, schema)
    return out.where(F.col("to") == RESULTS).select(*merged.columns).unionByName(merged)


def rated_rows(matches: DataFrame, cfg: Elo, pool: str | None, available_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """The columns that Elo needs, and ``extra`` ones."""
    hosts = [(F.col("host_team") == F.col(f"team{s}")).cast("int") if "host_team" in matches.columns else F.lit(0) for s in (1, 2)]
    return matches.select(
        "match_id", micros("kickoff_utc").alias("k"), micros(available_col).alias("a"), *named(pool), "team1_goals", "team2_goals",
        "neutral", importance("tournament", cfg.weights).alias("importance"), *(F.coalesce(h, F.lit(0)).alias(f"host{s}") for s, h in zip((1, 2), hosts)), *extra,
    )


def named(pool: str | None) -> list:
    """Teams; those of different pools are not the same."""
    return [(F.concat_ws("\x1f", F.col(pool).cast("string"), F.col(t)) if pool else F.col(t)).alias(t) for t in ("team1", "team2")]


def elo_features(matches: DataFrame, cfg: Elo = Elo(), windows: Sequence[int] = (5, 10), pool: str | None = None, available_col: str = "available_at", columns: Sequence[str] | None = None) -> DataFrame:
    """``match_id`` with pre-match ratings, expectation and momentum, or with the ``columns`` among them. With ``pool`` a team has a rating in each pool of its own."""
    out, _ = in_slices(rated_rows(matches, cfg, pool, available_col), EloRun(cfg, windows, columns))
    if columns is not None:
        return out.select("match_id", *columns)
    return out.withColumns({f"elo_team{s}_available_at": F.timestamp_micros(f"elo_team{s}_known") for s in (1, 2)}).drop("elo_team1_known", "elo_team2_known")


def online_strengths(matches: DataFrame, cfg: OnlinePoisson = OnlinePoisson(), pool: str | None = None, available_col: str = "available_at") -> DataFrame:
    """``match_id`` with attack and defence of both teams and the expected goals they imply.

    The global scoring rate couples all teams; it is a prefix aggregate over all
    of them, computed first and joined in.
    """
    rate = rate_by_kickoff(matches, available_col, 2 * cfg.initial_goals * cfg.prior_matches, 2 * cfg.prior_matches)
    rows = matches.select("match_id", micros("kickoff_utc").alias("k"), micros(available_col).alias("a"), *named(pool), "team1_goals", "team2_goals", "neutral").join(rate, "k")
    out, _ = in_slices(rows, StrengthRun(cfg))
    a, b = F.col("online_lambda_team1_pre"), F.col("online_lambda_team2_pre")
    return out.select("*", (a - b).alias("online_lambda_diff_pre"), (a + b).alias("online_lambda_total_pre"), F.log(a / b).alias("online_log_lambda_ratio_pre"))


def slice_groups(matches: DataFrame, available_col: str = "available_at") -> DataFrame:
    """``slice, kind, matches, groups, largest_group``: how the ratings of ``matches`` are cut up; no group is sent whole beyond ``largest_group``."""
    spark = matches.sparkSession
    path = scratch(spark, "slices")
    rated_rows(matches, Elo(), None, available_col).write.parquet(path)
    _, placed, kinds = plan_slices(spark.read.parquet(path))
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("slice")] if kinds else F.lit(None).cast("string")
    sizes = placed.groupBy("slice", "bin").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("slice").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest_group")).withColumn("kind", kind)
