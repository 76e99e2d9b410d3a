"""History features: what each side had done, by results known before kickoff.

A row sees a result if its kickoff and its availability both lie strictly before the
row's kickoff; matches at one kickoff see the same history. Counts, sums and latest times
are prefix aggregates over the time at which a result counts, the later of kickoff and availability. What
depends on the order of kickoffs among results known in another order (the last N, streaks), and decay, are
small states swept through that time: no list of results stands in a row, and no key is held as a whole.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MICROS, micros
from .asof import prefix, widen
from .sweep import EVENT, QUERY, All, Block, sweep

STATS = ["goals_for", "goals_against", "goal_diff", "win", "draw", "opponent_adjusted_goal_diff", "clean_sheet", "failed_to_score"]


def team_rows(matches: DataFrame, available_col: str = "available_at", elo: tuple[str, str] | None = None) -> DataFrame:
    """Two rows per match: ``match_id, side, team, k, a`` (micros) and the eight statistics.

    ``elo`` names the pre-match ratings of team1 and team2 (1500 where there are none).
    """

    def one(s: int) -> Column:
        own, other = f"team{s}", f"team{3 - s}"
        gf, ga = F.col(f"{own}_goals").cast("double"), F.col(f"{other}_goals").cast("double")
        strength = F.coalesce(F.col(elo[2 - s]), F.lit(1500.0)) if elo else F.lit(1500.0)
        values = {
            "goals_for": gf, "goals_against": ga, "goal_diff": gf - ga, "win": (gf > ga).cast("double"), "draw": (gf == ga).cast("double"),
            "opponent_adjusted_goal_diff": gf - ga + (strength - 1500.0) / 400.0, "clean_sheet": (ga == 0).cast("double"), "failed_to_score": (gf == 0).cast("double"),
        }
        return F.struct(F.lit(own).alias("side"), F.col(own).alias("team"), *(v.alias(n) for n, v in values.items()))

    return matches.select("match_id", micros("kickoff_utc").alias("k"), micros(available_col).alias("a"), F.inline(F.array(one(1), one(2))))


def known_from(k: str = "k", a: str = "a") -> Column:
    """The time after which a result counts as history."""
    return F.greatest(F.col(k), F.coalesce(F.col(a), F.col(k)))


def prior_counts(matches: DataFrame, available_col: str = "available_at") -> DataFrame:
    """``match_id`` with both sides' numbers of known results, their minimum, difference and logarithms."""
    rows = team_rows(matches, available_col)
    found = prefix(rows.select("match_id", "side", "team", "k"), rows, ["team"], F.col("k"), known_from(), sums={"prior_matches": F.lit(1)})
    wide = widen(found, ["prior_matches"])
    a, b = F.col("team1_prior_matches"), F.col("team2_prior_matches")
    return wide.select(
        "*", F.least(a, b).alias("prior_matches_min"), (a - b).alias("prior_matches_diff"),
        F.log1p(a.cast("double")).alias("team1_prior_matches_log1p"), F.log1p(b.cast("double")).alias("team2_prior_matches_log1p"),
    )


class Known:
    """Places of a history row in a sweep: time, tag, match, side, kickoff, availability, statistics from 6 on."""

    T, TAG, MATCH, SIDE, K, A, STATS = range(7)


def in_order(rows: Block, last: tuple | None) -> bool:
    """Whether the events became known in the order of kickoff, match and side, and all after ``last``. Those of one time come in this order."""
    if not len(rows.events):
        return True
    k, t = rows.event(Known.K), rows.event(Known.T)
    step = np.diff(k)
    if (step < 0).any() or ((step == 0) & (np.diff(t) != 0)).any():
        return False
    return last is None or (int(k[0]), *(rows.values(c, slice(1))[0] for c in (Known.MATCH, Known.SIDE))) > last


NOTHING = np.iinfo(np.int64).min


def running_max(first: int | None, values: np.ndarray) -> np.ndarray:
    """The largest value so far, before the first one and after each; NOTHING where there is none."""
    return np.maximum.accumulate(np.concatenate([[NOTHING if first is None else first], values]).astype(np.int64))


class Decayed:
    """Sums weighted by 0.5 ** (age / half-life), seen from the latest kickoff among them, so that nothing overflows or vanishes."""

    def __init__(self, places: Sequence[int], half_life_days: float):
        self.places, self.scale = places, half_life_days * DAY_MICROS
        self.at, self.weight, self.sums = None, 0.0, [0.0] * len(places)

    def add(self, row: tuple) -> None:
        self.take(row[Known.K], 1.0, [row[p] for p in self.places])

    def take(self, k: int, weight: float, sums: Sequence[float]) -> None:
        if self.at is None or k > self.at:
            old = 0.0 if self.at is None else 0.5 ** ((k - self.at) / self.scale)
            self.at, self.weight, self.sums = k, weight + old * self.weight, [x + old * y for x, y in zip(sums, self.sums)]
        else:
            w = 0.5 ** ((self.at - k) / self.scale)
            self.weight, self.sums = self.weight + w * weight, [y + w * x for x, y in zip(sums, self.sums)]

    def answer(self, row: tuple) -> list:
        return [s / self.weight if self.at is not None else None for s in self.sums]

    def fits(self, rows: Block) -> bool:
        """Weights seen from one kickoff must not overflow."""
        if not rows.complete(Known.K, *self.places):
            return False
        k = rows.event(Known.K)
        return not len(k) or np.abs(k - (k[0] if self.at is None else self.at)).max() < 500 * self.scale

    def block(self, rows: Block) -> list:
        k = rows.event(Known.K)
        seen = self.at if self.at is not None or not len(k) else int(k[0])
        w = 2.0 ** ((k - (seen or 0)) / self.scale)
        weight = np.cumsum(np.concatenate([[self.weight], w]))
        sums = [np.cumsum(np.concatenate([[s], w * rows.event(p)])) for s, p in zip(self.sums, self.places)]
        there = (rows.before > 0) | (self.at is not None)
        found = [(s[rows.before] / np.where(there, weight[rows.before], 1.0), there) for s in sums]
        if len(k):
            self.at = max(seen, int(k.max()))
            fade = 0.5 ** ((self.at - seen) / self.scale)
            self.weight, self.sums = float(weight[-1]) * fade, [float(s[-1]) * fade for s in sums]
        return found

    def merge(self, earlier: Decayed) -> None:
        if earlier.at is not None:
            self.take(earlier.at, earlier.weight, earlier.sums)


class Last:
    """The last results by kickoff among those known, as many as the largest window."""

    def __init__(self, places: Sequence[int], windows: Sequence[int]):
        self.places, self.windows, self.most = places, windows, max(windows)
        self.items: list[tuple] = []

    def add(self, row: tuple) -> None:
        self.put((row[Known.K], row[Known.MATCH], row[Known.SIDE], *(row[p] for p in self.places)))

    def put(self, item: tuple) -> None:
        if len(self.items) == self.most:
            if item < self.items[0]:
                return
            del self.items[0]
        insort(self.items, item)

    def answer(self, row: tuple) -> list:
        if not self.items:
            return [None] * (len(self.windows) * len(self.places))
        columns = list(zip(*self.items))[3:]
        return [sum(c[-n:]) / min(n, len(c)) for n in self.windows for c in columns]

    def fits(self, rows: Block) -> bool:
        return rows.complete(Known.K, *self.places) and in_order(rows, self.items[-1][:3] if self.items else None)

    def block(self, rows: Block) -> list:
        old, new = np.array([x[3:] for x in self.items], float).reshape(-1, len(self.places)), np.column_stack([rows.event(p) for p in self.places])
        padded = np.concatenate([np.zeros((self.most, len(self.places))), old, new])
        known = len(old) + rows.before
        found = []
        for n in self.windows:
            total = np.zeros((len(known), len(self.places)))
            for back in range(n, 0, -1):
                total += padded[self.most + known - back]
            found += [(m, known > 0) for m in (total / np.maximum(1, np.minimum(n, known))[:, None]).T]
        last = slice(max(0, len(new) - self.most), len(new))
        names = [rows.values(c, last) for c in (Known.K, Known.MATCH, Known.SIDE)]
        self.items = [*self.items, *zip(*names, *new[last].T.tolist())][-self.most :]
        return found

    def merge(self, earlier: Last) -> None:
        for item in earlier.items:
            self.put(item)


class Streaks:
    """Known results after the last known one that breaks a streak, for each of its three kinds.

    A result that becomes known is never older than the largest ``delay``, so results older than that are only counted: a break yet to come
    ends them all. Those from before the state's first event stay in the list, as an earlier state may know a later break.
    """

    def __init__(self, win: int, goal_diff: int, delay: int):
        self.places, self.delay, self.first = (win, goal_diff), delay, None
        #: the last break, the number of counted results after it, and the listed ones in order
        self.kinds: list[list] = [[None, 0, []] for _ in range(3)]

    def add(self, row: tuple) -> None:
        order, win, gap = (row[Known.K], row[Known.MATCH], row[Known.SIDE]), row[self.places[0]], row[self.places[1]]
        self.first = row[Known.T] if self.first is None else self.first
        for kind, breaks in zip(self.kinds, (win != 1.0, gap >= 0, gap < 0)):
            last, _, recent = kind
            if last is not None and order < last:
                continue
            if breaks:
                kind[:] = [order, 0, recent[bisect(recent, order) :]]
                continue
            insort(recent, order)
            if len(recent) % 64 == 0:
                low, high = bisect(recent, (self.first,)), bisect(recent, (row[Known.T] - self.delay,))
                if low < high:
                    kind[1:] = [kind[1] + high - low, recent[:low] + recent[high:]]

    def answer(self, row: tuple) -> list:
        return [float(n + len(recent)) for _, n, recent in self.kinds]

    def fits(self, rows: Block) -> bool:
        latest = [x for last, _, recent in self.kinds for x in (last, *recent[-1:]) if x is not None]
        return rows.complete(Known.K, *self.places) and in_order(rows, max(latest, default=None))

    def block(self, rows: Block) -> list:
        win, gap = (rows.event(p) for p in self.places)
        size, found, after = len(win), [], []
        for (_, n, recent), breaks in zip(self.kinds, (win != 1.0, gap >= 0, gap < 0)):
            latest = np.maximum.accumulate(np.concatenate([[-1], np.where(breaks, np.arange(size), -1)]))
            at = latest[rows.before]
            found.append((np.where(at >= 0, rows.before - 1 - at, n + len(recent) + rows.before).astype(float), np.ones(len(at), bool)))
            after.append(int(latest[-1]))
        if not size:
            return found
        t, low = rows.event(Known.T), max(0, min(after))
        self.first = int(t[0]) if self.first is None else self.first
        orders = list(zip(*(rows.values(c, slice(low, size)) for c in (Known.K, Known.MATCH, Known.SIDE))))
        for kind, at in zip(self.kinds, after):
            kind[:] = [orders[at - low], 0, orders[at - low + 1 :]] if at >= 0 else [kind[0], kind[1], [*kind[2], *orders]]
            recent = kind[2]
            begin, end = bisect(recent, (self.first,)), bisect(recent, (int(t[-1]) - self.delay,))
            if begin < end:
                kind[1:] = [kind[1] + end - begin, recent[:begin] + recent[end:]]
        return found

    def merge(self, earlier: Streaks) -> None:
        self.first = earlier.first if earlier.first is not None else self.first
        for kind, (last, n, recent) in zip(self.kinds, earlier.kinds):
            if kind[0] is None or last is not None and last > kind[0]:
                kind[:] = [last, kind[1] + n, sorted([*recent, *(x for x in kind[2] if last is None or x > last)])]
            else:  # what the earlier one has counted is older than this one's break
                kind[2] = sorted([*(x for x in recent if x > kind[0]), *kind[2]])


class Recent:
    """The latest kickoff and the latest availability among the known results."""

    def __init__(self) -> None:
        self.k = self.a = None

    def add(self, row: tuple) -> None:
        self.k = row[Known.K] if self.k is None else max(self.k, row[Known.K])
        if row[Known.A] is not None:
            self.a = row[Known.A] if self.a is None else max(self.a, row[Known.A])

    def answer(self, row: tuple) -> list:
        return [None if self.k is None or row[Known.K] is None else (row[Known.K] - self.k) / DAY_MICROS, self.a]

    def fits(self, rows: Block) -> bool:
        return rows.complete(Known.K)

    def block(self, rows: Block) -> list:
        (k, k_there), (a, a_there) = rows.whole(Known.K), rows.whole(Known.A)
        played = running_max(self.k, k[rows.events])
        known = running_max(self.a, np.where(a_there, a, NOTHING)[rows.events])
        self.k, self.a = (None if m[-1] == NOTHING else int(m[-1]) for m in (played, known))
        before, at = played[rows.before], known[rows.before]
        there = (before != NOTHING) & k_there[rows.queries]
        return [((k[rows.queries] - np.where(there, before, 0)) / DAY_MICROS, there), (at, at != NOTHING)]

    def merge(self, earlier: Recent) -> None:
        self.k = max((x for x in (self.k, earlier.k) if x is not None), default=None)
        self.a = max((x for x in (self.a, earlier.a) if x is not None), default=None)


class Counted:
    """The number of known results."""

    def __init__(self) -> None:
        self.n = 0

    def add(self, row: tuple) -> None:
        self.n += 1

    def answer(self, row: tuple) -> list:
        return [self.n]

    def fits(self, rows: Block) -> bool:
        return True

    def block(self, rows: Block) -> list:
        found = self.n + rows.before
        self.n += len(rows.events)
        return [(found, np.ones(len(found), bool))]

    def merge(self, earlier: Counted) -> None:
        self.n += earlier.n


def swept(rows: DataFrame, stats: Sequence[str], start, out: str) -> DataFrame:
    """``match_id, side`` and ``out``: a sweep by team, each row once as a query at kickoff and once as an event when known."""
    ask = F.struct(F.col("k").alias("t"), F.lit(QUERY).alias("tag"))
    tell = F.struct(known_from().alias("t"), F.lit(EVENT).alias("tag"))
    both = rows.select("team", "match_id", "side", "k", "a", *stats, F.inline(F.array(ask, tell)))
    both = both.select("team", "t", "tag", "match_id", "side", "k", "a", *(F.when(F.col("tag") == EVENT, F.col(c)).alias(c) for c in stats))
    return sweep(both, ["team"], ["match_id", "side"], ["k", "a", *stats], start, out, ties=["k", "match_id", "side"])


def doubles(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


def decayed_means(rows: DataFrame, stats: Sequence[str] = STATS, half_life_days: float = 365.0) -> DataFrame:
    """``match_id, side, {stat}_ewm``: means weighted by 0.5 ** (age / half-life), at any half-life and age."""
    places = range(Known.STATS, Known.STATS + len(stats))
    return swept(rows, stats, lambda: Decayed(places, half_life_days), doubles([f"{s}_ewm" for s in stats]))


def recency(rows: DataFrame) -> DataFrame:
    """``match_id, side, days_rest, history_available_at``: since the latest known kickoff, and the latest availability used."""
    found = prefix(rows.select("match_id", "side", "team", "k"), rows, ["team"], F.col("k"), known_from(), maxima={"__k": F.col("k"), "__a": F.col("a")})
    return found.select("match_id", "side", ((F.col("k") - F.col("__k")) / F.lit(float(DAY_MICROS))).alias("days_rest"), F.timestamp_micros("__a").alias("history_available_at"))


def last_means(rows: DataFrame, windows: Sequence[int], stats: Sequence[str] = STATS) -> DataFrame:
    """``match_id, side, {stat}_roll{n}``: means over the last n known results by kickoff (null if none)."""
    places = range(Known.STATS, Known.STATS + len(stats))
    return swept(rows, stats, lambda: Last(places, windows), doubles([f"{s}_roll{n}" for n in windows for s in stats]))


def longest_delay(rows: DataFrame) -> int:
    """The longest time from kickoff until a result was known, in microseconds."""
    return rows.agg(F.max(known_from() - F.col("k"))).first()[0] or 0


STREAKS = ["win_streak", "loss_streak", "unbeaten_streak"]


def streaks(rows: DataFrame) -> DataFrame:
    """``match_id, side`` and the win, loss and unbeaten streaks that end at the latest known result."""
    delay = longest_delay(rows)
    return swept(rows, ["win", "goal_diff"], lambda: Streaks(Known.STATS, Known.STATS + 1, delay), doubles(STREAKS))


def side_history(rows: DataFrame, windows: Sequence[int], stats: Sequence[str] = STATS, half_life_days: float = 365.0) -> DataFrame:
    """``match_id, side`` with rest, availability, decayed means, last-n means and streaks: all in one sweep."""
    delay, places = longest_delay(rows), range(Known.STATS, Known.STATS + len(stats))
    win, gap = Known.STATS + stats.index("win"), Known.STATS + stats.index("goal_diff")
    names = doubles([*(f"{s}_ewm" for s in stats), *(f"{s}_roll{n}" for n in windows for s in stats), *STREAKS])
    out = swept(rows, stats, lambda: All(Recent(), Decayed(places, half_life_days), Last(places, windows), Streaks(win, gap, delay)), f"days_rest double, __a long, {names}")
    return out.withColumn("history_available_at", F.timestamp_micros("__a")).drop("__a")


def short_history(rows: DataFrame, window: int, stats: Sequence[str], decayed: Sequence[str], half_life_days: float = 365.0) -> DataFrame:
    """``match_id, side`` with rest, number of known results, decayed means of ``decayed`` and last-n means of ``stats``: one sweep."""
    every = list(dict.fromkeys([*stats, *decayed]))
    place = {c: Known.STATS + i for i, c in enumerate(every)}
    names = doubles([*(f"{s}_ewm" for s in decayed), *(f"{s}_roll{window}" for s in stats)])
    start = lambda: All(Recent(), Counted(), Decayed([place[c] for c in decayed], half_life_days), Last([place[c] for c in stats], [window]))
    return swept(rows, every, start, f"days_rest double, __a long, prior_matches long, {names}").drop("__a")


def rolling_features(matches: DataFrame, windows: Sequence[int] = (5, 10), *, half_life_days: float = 365.0, available_col: str = "available_at", elo=None) -> DataFrame:
    """``match_id`` with every rolling column of both sides and their differences (team1 minus team2)."""
    long = side_history(team_rows(matches, available_col, elo), windows, STATS, half_life_days)
    numbers = [c for c in long.columns if c not in ("match_id", "side", "history_available_at")]
    wide = widen(long, [*numbers, "history_available_at"])
    return wide.select("*", *((F.col(f"team1_{c}") - F.col(f"team2_{c}")).alias(f"{c}_diff") for c in numbers))


def head_to_head(matches: DataFrame, available_col: str = "available_at") -> DataFrame:
    """``match_id`` with the pair's known meetings: number, shares won, mean goals, last outcome; 0 where there are none."""
    first = F.col("team1") <= F.col("team2")
    rows = matches.select(
        "match_id", F.least("team1", "team2").alias("p"), F.greatest("team1", "team2").alias("q"), first.alias("first"), micros("kickoff_utc").alias("k"), micros(available_col).alias("a"),
        F.when(first, F.col("team1_goals")).otherwise(F.col("team2_goals")).alias("g1"), F.when(first, F.col("team2_goals")).otherwise(F.col("team1_goals")).alias("g2"),
    )
    sums = {"n": F.lit(1), "w1": (F.col("g1") > F.col("g2")).cast("int"), "w2": (F.col("g2") > F.col("g1")).cast("int"), "s1": F.col("g1"), "s2": F.col("g2")}
    last = F.struct("k", "match_id", F.signum(F.col("g1") - F.col("g2")).alias("o"))
    asked = rows.select("match_id", "first", "p", "q", "k")
    out = prefix(asked, rows, ["p", "q"], F.col("k"), known_from(), sums=sums, maxima={"last": last})
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    side = lambda x, y: F.when(F.col("first"), share(x)).otherwise(share(y))
    result = F.coalesce(F.col("last.o"), F.lit(0.0))
    return out.select(
        "match_id", F.col("n").cast("double").alias("h2h_total_matches"), side("w1", "w2").alias("h2h_team1_win_pct"), side("w2", "w1").alias("h2h_team2_win_pct"),
        side("s1", "s2").alias("h2h_team1_goals_mean"), side("s2", "s1").alias("h2h_team2_goals_mean"), (F.when(F.col("first"), result).otherwise(-result) + F.lit(0.0)).alias("h2h_last_outcome"),
    )


def global_rate(matches: DataFrame, available_col: str = "available_at", prior_goals: float = 250.0, prior_matches: float = 200.0) -> DataFrame:
    """``match_id, goals_rate``: (250 + goals) / (200 + 2 matches) per side over all results known before kickoff."""
    rates = rate_by_kickoff(matches, available_col, prior_goals, prior_matches)
    return matches.select("match_id", micros("kickoff_utc").alias("k")).join(rates, "k").select("match_id", "goals_rate")


def rate_by_kickoff(matches: DataFrame, available_col: str, prior_goals: float, prior_matches: float) -> DataFrame:
    """``k, goals_rate`` for each kickoff.

    Keyless, so results are summed per instant first; the running sum over
    instants is two-level (by year), and matches join it through their kickoff.
    """
    known = F.greatest(micros("kickoff_utc"), F.coalesce(micros(available_col), micros("kickoff_utc")))
    events = matches.select(known.alias("t"), (F.col("team1_goals") + F.col("team2_goals")).alias("g")).groupBy("t").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    moments = matches.select(micros("kickoff_utc").alias("k")).distinct()
    one = F.lit(0).alias("one")
    sums = prefix(moments.select("k", one), events.select("t", "g", "n", one), ["one"], F.col("k"), F.col("t"), sums={"g": F.col("g"), "n": F.col("n")})
    rate = (F.lit(prior_goals) + F.col("g")) / (F.lit(prior_matches) + 2 * F.col("n"))
    return sums.select("k", rate.alias("goals_rate"))
