"""Contracts of the match table: canonical form, constraint violations, snapshots, preparation, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import PROBABILITIES, col, nonnegative_int, parse_boolean, stable_id, text

REQUIRED = ["kickoff_utc", "team1", "team2", "team1_goals", "team2_goals", "tournament", "neutral"]


def column_report(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """One row: whether all required columns are there, those missing, and the row count."""
    missing = [c for c in required if c not in df.columns]
    lacking = F.array(*map(F.lit, missing)) if missing else F.array().cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(not missing).alias("is_valid"), lacking.alias("missing"), "n_rows")


def sides(matches: DataFrame, *keep: str | Column) -> DataFrame:
    """Two rows per match, one for each side, from a single scan."""

    def one(side: int) -> Column:
        own, other = f"team{side}", f"team{3 - side}"
        return F.struct(
            F.lit(own).alias("side"), F.col(own).alias("team"), F.col(other).alias("opponent"),
            F.col(f"{own}_goals").alias("gf"), F.col(f"{other}_goals").alias("ga"),
        )

    return matches.select(*keep, F.inline(F.array(one(1), one(2))))


def duplicate_violations(matches: DataFrame, id_col: str = "match_id", time_col: str = "kickoff_utc") -> DataFrame:
    """``rule, key, n``: repeated ids, repeated pairs at one kickoff, and teams that play twice at one kickoff."""

    def more_than_once(rule: str, key: Column, rows: DataFrame) -> DataFrame:
        return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")

    at = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    pair = F.concat_ws("|", at, F.least("team1", "team2"), F.greatest("team1", "team2"))
    both = matches.select(at.alias("at"), F.explode(F.array("team1", "team2")).alias("team"))
    return (
        more_than_once("repeated id", F.col(id_col), matches)
        .unionByName(more_than_once("repeated pair", pair, matches))
        .unionByName(more_than_once("team twice", F.concat_ws("|", "at", "team"), both))
    )


def canonical_matches(raw: DataFrame, *, source: str = "unknown", delay_hours: int = 3) -> tuple[DataFrame, DataFrame]:
    """(matches, violations): typed and defaulted rows, and one row per broken rule.

    The time is ``kickoff_utc`` or else ``date``; a missing ``available_at`` is
    ``delay_hours`` after it; a missing id is derived. Rows with a violation stay
    in the first table, so the caller decides; null kickoffs are violations.
    """
    have = set(raw.columns)
    pick = lambda name, default: F.col(name) if name in have else F.lit(default)
    kickoff = F.coalesce(*(F.col(c).cast("string").try_cast("timestamp") for c in ("kickoff_utc", "date") if c in have))
    base = raw.withColumns(
        {
            "kickoff_utc": kickoff, "team1": text("team1"), "team2": text("team2"), "tournament": text("tournament"),
            "team1_goals": nonnegative_int("team1_goals"), "team2_goals": nonnegative_int("team2_goals"), "neutral": parse_boolean("neutral"),
        }
    )
    base = base.withColumns(
        {
            "source": F.coalesce(pick("source", None).cast("string"), F.lit(source)),
            "source_version": F.coalesce(pick("source_version", None).cast("string"), F.lit("unversioned")),
            "available_at": F.coalesce(pick("available_at", None).cast("timestamp"), F.col("kickoff_utc") + F.expr(f"interval {int(delay_hours)} hours")),
            "went_extra_time": F.coalesce(parse_boolean(pick("went_extra_time", "false")), F.lit(False)),
        }
    )
    regulation = {f"team{s}_goals_90": nonnegative_int(F.coalesce(pick(f"team{s}_goals_90", None).cast("string"), F.col(f"team{s}_goals").cast("string"))) for s in (1, 2)}
    extra = {f"team{s}_goals_{k}": nonnegative_int(pick(f"team{s}_goals_{k}", None).cast("string")) for s in (1, 2) for k in ("et", "pen")}
    ident = stable_id("source", "kickoff_utc", "team1", "team2")
    matches = base.withColumns(regulation | extra).withColumn("match_id", F.coalesce(text(pick("match_id", None)), ident))
    rules = {
        "kickoff": F.col("kickoff_utc").isNull(), "team1": F.col("team1").isNull(), "team2": F.col("team2").isNull(), "tournament": F.col("tournament").isNull(),
        "goals": F.col("team1_goals").isNull() | F.col("team2_goals").isNull(), "neutral": F.col("neutral").isNull(),
        "same team": F.coalesce(F.col("team1") == F.col("team2"), F.lit(False)),
    }
    broken = F.explode(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull()))
    rows = matches.select(broken.alias("rule"), F.col("match_id").alias("key"), F.lit(1).cast("long").alias("n"))
    return matches, rows.unionByName(duplicate_violations(matches))


def between(df: DataFrame, start, end, time_col: str = "kickoff_utc") -> DataFrame:
    """Rows in [start, end); either may be None. A plain predicate that scans push down."""
    for bound, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c < b)):
        if bound is not None:
            df = df.where(test(F.col(time_col), F.lit(bound).cast("timestamp")))
    return df


def known_at(matches: DataFrame, cutoff, available_col: str = "available_at") -> DataFrame:
    """What was known before ``cutoff``, stamped with it."""
    at = F.lit(cutoff).cast("timestamp")
    return matches.where(F.col(available_col) < at).withColumn("snapshot_at", at)


def manifest(snapshot: DataFrame, time_col: str = "kickoff_utc", version_col: str = "source_version") -> DataFrame:
    """One row: count, first and last kickoff, and the sorted source versions."""
    return snapshot.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time_col).alias("first_kickoff"), F.max(time_col).alias("last_kickoff"),
        F.array_sort(F.collect_set(version_col)).alias("source_versions"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Content digest that does not depend on the order of rows or columns; repeated rows count."""
    row = F.concat_ws("\x1f", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))) for c in sorted(df.columns)))
    hashed = df.select(F.sha2(row, 256).alias("r"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64("r")).alias("x"), F.sum(F.xxhash64(F.lit(1), "r").cast("decimal(38,0)")).alias("s")
    ).select("n_rows", F.sha2(F.concat_ws("|", "n_rows", F.coalesce(F.col("x"), F.lit(0)), F.coalesce(F.col("s"), F.lit(0))), 256).alias("digest"))


def leakage(df: DataFrame, time_columns: Sequence[str], kickoff: str = "kickoff_utc") -> DataFrame:
    """One row: for each feature time, how many rows have it at or after kickoff (0 everywhere is clean)."""
    return df.agg(*(F.count_if(F.col(c) >= F.col(kickoff)).alias(f"n_{c}") for c in time_columns))


def completed_results(raw: DataFrame, start, cutoff, *, date_col: str = "date", goals=("home_score", "away_score"), teams=("home_team", "away_team")) -> DataFrame:
    """Rows with a ``status``: kept, incomplete, pre-start, after cutoff, duplicate or ambiguous.

    Duplicates agree in everything but place; the first by (city, country) stays
    and null places sort first. Ambiguous rows are those of a team that has several
    kept results on one day.
    """
    key = [date_col, *teams, *goals, "tournament", "neutral"]
    rows = raw.withColumn("__row", F.row_number().over(W.partitionBy(*key).orderBy(*(c for c in ("city", "country") if c in raw.columns), F.lit(0))))
    day = F.col(date_col).cast("timestamp")
    status = (
        F.when(F.col(goals[0]).isNull() | F.col(goals[1]).isNull(), "incomplete")
        .when(day < F.lit(start).cast("timestamp"), "pre-start")
        .when(day >= F.lit(cutoff).cast("timestamp"), "after cutoff")
        .when(F.col("__row") > 1, "duplicate")
        .otherwise("kept")
    )
    rows = rows.withColumn("status", status).drop("__row")
    kept = F.col("status") == "kept"
    several = (
        rows.where(kept).select(F.col(date_col).alias("__day"), F.explode(F.array(*teams)).alias("__team"))
        .groupBy("__day", "__team").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__day", "__team", F.lit(True).alias("__many"))
    )
    for i, team in enumerate(teams):
        marked = several.select(F.col("__day").alias(f"__d{i}"), F.col("__team").alias(f"__t{i}"), F.col("__many").alias(f"__m{i}"))
        rows = rows.join(marked, (F.col(date_col) == F.col(f"__d{i}")) & (F.col(team) == F.col(f"__t{i}")), "left").drop(f"__d{i}", f"__t{i}")
    ambiguous = (F.col("status") == "kept") & (F.col("__m0").isNotNull() | F.col("__m1").isNotNull())
    return rows.withColumn("status", F.when(ambiguous, "ambiguous").otherwise(F.col("status"))).drop("__m0", "__m1")


def preparation_audit(statuses: DataFrame, date_col: str = "date", teams=("home_team", "away_team")) -> DataFrame:
    """One row of counts by status, with the first and last day and the number of teams kept."""
    kept = F.col("status") == "kept"
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.replace(' ', '_').replace('-', '_')}") for s in ("kept", "incomplete", "pre-start", "after cutoff", "duplicate", "ambiguous")]
    days = [F.min(F.when(kept, F.col(date_col))).alias("first_day"), F.max(F.when(kept, F.col(date_col))).alias("last_day")]
    one = statuses.agg(F.count(F.lit(1)).alias("n_input"), *counts, *days)
    named = statuses.where(kept).select(F.explode(F.array(*teams)).alias("t")).agg(F.count_distinct("t").alias("n_teams"))
    return one.crossJoin(named)  # one row each


def probability_report(df: DataFrame, columns: Sequence[str] = PROBABILITIES, tolerance: float = 1e-8) -> DataFrame:
    """One row: rows, and how many have a missing, infinite or out-of-range probability or a sum other than 1."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(~F.col(c).between(0, 1) | F.isnan(c), F.lit(True))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_range"), F.count_if(~bad & (F.abs(total - 1) > tolerance)).alias("n_sum"))


def implied_probabilities(odds: Sequence[str | Column]) -> list[Column]:
    """Bookmaker odds without their margin; null where one is not a finite number above 1."""
    good = F.lit(True)
    for o in odds:
        good = good & F.coalesce((col(o) > 1) & (col(o) < float("inf")), F.lit(False))
    inverse = [1 / col(o) for o in odds]
    total = sum(inverse[1:], inverse[0])
    return [F.when(good, i / total) for i in inverse]


def recency_weights(df: DataFrame, reference, half_life_years: float | None, time_col: str = "kickoff_utc") -> DataFrame:
    """``df`` with ``weight``: halves every ``half_life_years`` before ``reference``, mean 1."""
    if half_life_years is None:
        return df.withColumn("weight", F.lit(1.0))
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(F.col(time_col).cast("timestamp"))) / F.lit(365.25 * 86_400e6))
    raw = df.withColumn("weight", F.exp(F.lit(-0.6931471805599453 / half_life_years) * age))
    mean = raw.agg(F.avg("weight").alias("__mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("__mean")).drop("__mean")  # one row


def confident_pick(threshold: float, columns: Sequence[str] = PROBABILITIES) -> Column:
    """Index of the likeliest class, or null (abstain) where it is below ``threshold``."""
    every = F.array(*map(F.col, columns))
    return F.when(F.array_max(every) >= threshold, (F.array_position(every, F.array_max(every)) - 1).cast("int"))
