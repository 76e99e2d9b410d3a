"""Ratings of a stream of matches, whatever the order in which they arrive.

Matches wait in the state of their pool until the watermark has passed their kickoff, when none can come before them any more.
Then a timer takes all that are due, in order, through the same steps as the batch form, and only the teams that
play are read from and written to the state. A change whose result was not known yet stays with its team until the next kickoff after it was.
The last states of a batch run can be handed over, so a stream goes on where history ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratings import Elo, EloRun, in_slices, rated_rows

#: The state store that timers and map states need; the caller sets it on the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ratings(StatefulProcessor):
    """State of a pool: waiting matches by kickoff (microseconds) and the state of each team."""

    def __init__(self, run: EloRun):
        self.run_of = run
        self.columns = [part.split()[0] for part in run.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "k long", "matches binary")
        self.teams = handle.getMapState("teams", "team string", "state binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for team, state in zip(initialState["team"], initialState["state"]):
            self.teams.updateValue((team,), (bytes(state),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for k, part in pdf.drop(columns=["pool", "kickoff_utc"]).groupby("k"):
                at = (int(k),)
                more = part.to_dict("records")
                if self.waiting.containsKey(at):
                    more = pickle.loads(self.waiting.getValue(at)[0]) + more
                else:
                    self.handle.registerTimer(-(-int(k) // 1000))
                self.waiting.updateValue(at, (pickle.dumps(more),))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted(k for (k,) in self.waiting.keys() if k <= now)
        rows = []
        for k in due:
            rows += pickle.loads(self.waiting.getValue((k,))[0])
            self.waiting.removeKey((k,))
        if rows:
            pdf = pd.DataFrame(rows)
            teams = set(pdf["team1"]) | set(pdf["team2"])
            known = {t: pickle.loads(self.teams.getValue((t,))[0]) for t in teams if self.teams.containsKey((t,))}
            table, states = self.run_of.run(pdf, known)
            for t, state in states.items():
                self.teams.updateValue((t,), (pickle.dumps(state),))
            yield table[self.columns].astype({c: object for c in self.columns if c.endswith("_known")})
        else:
            yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def elo_stream(matches: DataFrame, pool: str, late: str = "30 days", cfg: Elo = Elo(), windows: Sequence[int] = (5, 10), history: DataFrame | None = None, available_col: str = "available_at") -> DataFrame:
    """``match_id`` with the columns of ``elo_features``, for a stream of matches; each pool (a column) has its own ratings and runs on its own.

    A match may arrive up to ``late`` after later ones. A match's row comes out once the watermark has passed its kickoff; one that comes
    later than that is left out. ``history`` has ``pool, team, state`` of earlier matches, from ``elo_states``; the stream must then begin after them.
    Null pools are a pool of their own; matches without a kickoff are left out.
    """
    named = F.coalesce(F.col(pool).cast("string"), F.lit(""))
    rows = rated_rows(matches.withColumn("__pool", named), cfg, None, available_col, extra=("__pool", "kickoff_utc"))
    rows = rows.withColumnRenamed("__pool", "pool").withColumn("kickoff_utc", F.col("kickoff_utc").cast("timestamp")).where("kickoff_utc is not null").withWatermark("kickoff_utc", late)
    run = EloRun(cfg, windows)
    initial = history.select(F.coalesce(F.col("pool").cast("string"), F.lit("")).alias("pool"), "team", "state").groupBy("pool") if history is not None else None
    out = rows.groupBy("pool").transformWithStateInPandas(Ratings(run), run.schema, "Append", "EventTime", initialState=initial)
    return out.withColumns({f"elo_team{s}_available_at": F.timestamp_micros(f"elo_team{s}_known") for s in (1, 2)}).drop("elo_team1_known", "elo_team2_known")


def elo_states(matches: DataFrame, pool: str, cfg: Elo = Elo(), windows: Sequence[int] = (5, 10), available_col: str = "available_at") -> DataFrame:
    """``pool, team, state`` after all of ``matches``, for a stream to go on from."""
    _, states = in_slices(rated_rows(matches.withColumn("__pool", F.coalesce(F.col(pool).cast("string"), F.lit(""))), cfg, "__pool", available_col), EloRun(cfg, windows))
    parts = F.split("team", "\x1f", 2)
    return states.select(parts[0].alias("pool"), parts[1].alias("team"), "state")
