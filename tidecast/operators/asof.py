"""Prefix aggregates and strict as-of joins.

A query at time t sees the events of its key with time < t. Both are tagged and
united, queries before events at equal times, so "all rows before this one" is
strict. The frame is split into time buckets: a window inside each (key, bucket), and
one over the much smaller per-bucket totals of each key. A key that holds a large
share of all rows is thereby spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import DAY_MICROS, days_between, micros

BUCKET_DAYS = 366


def prefix(
    queries: DataFrame,
    events: DataFrame,
    key: Sequence[str],
    query_time: Column,
    event_time: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """``queries`` with the sum (0 if none) or maximum (null if none) over each one's earlier events.

    ``query_time`` and ``event_time`` are microseconds; the expressions of
    ``sums`` and ``maxima`` are over ``events``. Every query row comes back once.
    Queries with a null time or key see no events.
    """
    sums, maxima = sums or {}, maxima or {}
    width = F.lit(bucket_days * DAY_MICROS)
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]
    k_cols = [f"__k{i}" for i in range(len(key))]
    row = F.struct(*(F.col(c) for c in queries.columns))
    measures = {**{n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}, **maxima}
    facts = events.select(*keys, event_time.alias("__t"), F.lit(1).alias("__tag"), *(c.alias(f"__m_{n}") for n, c in measures.items()))
    kind = dict(facts.dtypes)
    asked = queries.select(*keys, query_time.alias("__t"), F.lit(0).alias("__tag"), *(F.lit(None).cast(kind[f"__m_{n}"]).alias(f"__m_{n}") for n in measures), row.alias("__row"))
    both = facts.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked).withColumn("__b", F.floor(F.col("__t") / width))
    fold = lambda n: F.sum(f"__m_{n}") if n in sums else F.max(f"__m_{n}")
    inside = W.partitionBy(*k_cols, "__b").orderBy("__t", "__tag").rowsBetween(W.unboundedPreceding, -1)
    near = both.select(*k_cols, "__b", "__tag", "__row", *(fold(n).over(inside).alias(f"__n_{n}") for n in measures)).where("__tag = 0")
    totals = facts.withColumn("__b", F.floor(F.col("__t") / width)).groupBy(*k_cols, "__b").agg(*(fold(n).alias(f"__m_{n}") for n in measures))
    # buckets that are only asked about need a total too
    asked_buckets = asked.select(*k_cols, F.floor(F.col("__t") / width).alias("__b")).distinct()
    all_totals = asked_buckets.join(totals, [*k_cols, "__b"], "full_outer")
    before = W.partitionBy(*k_cols).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = all_totals.select(*k_cols, "__b", *(fold(n).over(before).alias(f"__c_{n}") for n in measures))
    out = near.join(carried, [*k_cols, "__b"], "left")
    merged = [
        (F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__n_{n}", F.lit(0)) if n in sums else F.greatest(f"__c_{n}", f"__n_{n}")).alias(n)
        for n in measures
    ]
    return out.select("__row.*", *merged)


def latest_before(queries: DataFrame, events: DataFrame, key: Sequence[str], query_time: str, event_time: str, columns: Sequence[str]) -> DataFrame:
    """As-of join: ``queries`` with ``columns`` of the last event strictly before each, and its time as ``available_at``.

    At equal event times the row with the largest columns counts. No event: nulls.
    """
    last = F.struct(micros(event_time).alias("__at"), *(F.col(c).alias(c) for c in columns))
    found = prefix(queries, events.where(F.col(event_time).isNotNull()), key, micros(query_time), micros(event_time), maxima={"__last": last})
    return found.select(*queries.columns, *(F.col(f"__last.{c}").alias(c) for c in columns), F.timestamp_micros("__last.__at").alias("available_at"))


def both_sides(matches: DataFrame, id_col: str = "match_id", kickoff: str = "kickoff_utc") -> DataFrame:
    pair = F.inline(F.array(*(F.struct(F.lit(f"team{s}").alias("side"), F.col(f"team{s}").alias("team")) for s in (1, 2))))
    return matches.select(F.col(id_col), F.col(kickoff).alias("kickoff_utc"), pair)


def widen(long: DataFrame, columns: Sequence[str], id_col: str = "match_id", naming: str = "{side}_{column}") -> DataFrame:
    """One row per match from one row per side."""
    picks = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(naming.format(side=side, column=c)) for side in ("team1", "team2") for c in columns
    ]
    return long.groupBy(id_col).agg(*picks)


def ratings_asof(matches: DataFrame, ratings: DataFrame, columns: Sequence[str], *, prefix_name: str, numeric: Sequence[str] | None = None) -> DataFrame:
    """Both sides' rating columns as of kickoff, from one snapshot each and in one shuffle by team.

    Adds ``{side}_{prefix}_{column}``, ``{side}_{prefix}_available_at`` and, for
    the numeric columns, ``{prefix}_{column}_diff`` (team1 minus team2). Ratings at
    the time of kickoff are not used; unmatched sides are null.
    """
    asked = both_sides(matches)
    found = latest_before(asked, ratings, ["team"], "kickoff_utc", "rating_date", columns)
    wide = widen(found, [*columns, "available_at"], naming=f"{{side}}_{prefix_name}_{{column}}")
    numbers = numeric if numeric is not None else [c for c, t in ratings.select(*columns).dtypes if t not in ("string", "timestamp", "boolean")]
    diffs = [(F.col(f"team1_{prefix_name}_{c}") - F.col(f"team2_{prefix_name}_{c}")).alias(f"{prefix_name}_{c}_diff") for c in numbers]
    return matches.join(wide.select("*", *diffs), "match_id", "left")


def rank_position(rankings: DataFrame, by: str = "schedule_id", rank: str = "fifa_rank", points: str = "fifa_points") -> DataFrame:
    """Rank percentile (1 is best) and standardised points within each snapshot."""
    w = W.partitionBy(by)
    spread = F.stddev_pop(points).over(w)
    return rankings.withColumns(
        {
            "rank_percentile": 1 - (F.col(rank) - 1) / F.greatest(F.count(rank).over(w) - 1, F.lit(1)),
            "points_z": F.when(spread > 0, (F.col(points) - F.avg(points).over(w)) / spread).otherwise(F.lit(0.0)),
        }
    )


def ranking_features(matches: DataFrame, rankings: DataFrame) -> DataFrame:
    """As-of ranking columns of both sides and what derives from them.

    ``rankings``: team, rating_date, confederation, rank, points, rated_matches,
    rank_percentile, points_z. Uses ``elo_diff_pre``, ``neutral_int`` and
    ``tournament_importance`` where the matches have them.
    """
    numbers = ["rank", "points", "rated_matches", "rank_percentile", "points_z"]
    out = ratings_asof(matches, rankings, ["confederation", *numbers], prefix_name="fifa", numeric=numbers)
    conf = {s: F.upper(F.coalesce(f"team{s}_fifa_confederation", F.lit(""))) for s in (1, 2)}
    new: dict[str, Column] = {"fifa_same_confederation_int": ((conf[1] == conf[2]) & (conf[1] != "")).cast("int")}
    for s in (1, 2):
        for c in CONFEDERATIONS:
            new[f"team{s}_fifa_confederation_{c.lower()}"] = (conf[s] == c).cast("int")
        new[f"team{s}_fifa_snapshot_age_days"] = days_between("kickoff_utc", f"team{s}_fifa_available_at")
        new[f"team{s}_fifa_missing_int"] = F.col(f"team{s}_fifa_points").isNull().cast("int")
    for c in numbers:
        a, b = F.col(f"team1_fifa_{c}"), F.col(f"team2_fifa_{c}")
        new[f"fifa_{c}_diff_abs"], new[f"fifa_{c}_mean"] = F.abs(a - b), (a + b) / 2.0
    fewest = F.least("team1_fifa_rated_matches", "team2_fifa_rated_matches")
    new["fifa_rated_matches_min_log1p"] = F.when(fewest.isNotNull(), F.log1p(F.greatest(fewest, F.lit(0)).cast("double")))
    out = out.withColumns(new)
    more: dict[str, Column] = {
        "fifa_snapshot_age_days_max": F.greatest("team1_fifa_snapshot_age_days", "team2_fifa_snapshot_age_days"),
        "fifa_any_missing_int": F.greatest("team1_fifa_missing_int", "team2_fifa_missing_int"),
    }
    if "elo_diff_pre" in out.columns:
        z, e = F.col("fifa_points_z_diff"), F.col("elo_diff_pre") / 400.0
        more |= {"fifa_elo_consensus_diff": z + e, "fifa_elo_disagreement": z - e}
        more["fifa_points_neutral_interaction"] = z * (F.col("neutral_int") if "neutral_int" in out.columns else F.lit(0))
        more["fifa_points_importance_interaction"] = z * (F.col("tournament_importance") if "tournament_importance" in out.columns else F.lit(1.0))
    return out.withColumns(more)


#: The confederations.
CONFEDERATIONS = ["AFC", "CAF", "CONCACAF", "CONMEBOL", "OFC", "UEFA"]
