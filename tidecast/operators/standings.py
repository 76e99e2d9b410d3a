"""Standings of groups from played results, with the mini-table tie-break, and shares of trial outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contracts import sides


def standings(results: DataFrame, group: str = "grp") -> DataFrame:
    """``grp, team, points, gf, ga, gd, played``: 3, 1 and 0 points."""
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    return sides(results, group).groupBy(group, "team").agg(
        F.sum(points).alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.count(F.lit(1)).alias("played")
    )


def mini_table(results: DataFrame, tied: DataFrame, group: str = "grp", tie: str = "tie") -> DataFrame:
    """``grp, team, m_points, m_gd, m_gf``: only the matches between teams of one tied set (``grp, team, tie``)."""
    rows = sides(results, group)
    own = tied.select(F.col(group), F.col("team"), F.col(tie))
    other = tied.select(F.col(group), F.col("team").alias("opponent"), F.col(tie).alias("__o"))
    between = rows.join(own, [group, "team"]).join(other, [group, "opponent"]).where(F.col(tie) == F.col("__o"))
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    return between.groupBy(group, "team").agg(F.sum(points).alias("m_points"), F.sum(F.col("gf") - F.col("ga")).alias("m_gd"), F.sum("gf").alias("m_gf"))


def rank_groups(results: DataFrame, teams: DataFrame | None = None, group: str = "grp", passes: int = 3) -> DataFrame:
    """``grp, team, position`` and the table's columns.

    Order: points, then the mini-table among level teams, applied again to those
    still level (a tied set of a group of four can shrink twice), then goal
    difference, goals, conduct, rank and name (descending). ``teams`` may give
    ``conduct`` and ``rank`` (0 and none by default).
    """
    table = standings(results, group)
    table = table.join(teams, [group, "team"], "left") if teams is not None else table.withColumns({"conduct": F.lit(0), "rank": F.lit(None).cast("int")})
    table = table.withColumn("tie", F.dense_rank().over(W.partitionBy(group).orderBy(F.desc("points"))))
    for _ in range(passes):
        mini = mini_table(results, table, group)
        table = table.drop("m_points", "m_gd", "m_gf").join(mini, [group, "team"], "left").na.fill(0, ["m_points", "m_gd", "m_gf"])
        table = table.withColumn("tie", F.dense_rank().over(W.partitionBy(group).orderBy("tie", F.desc("m_points"), F.desc("m_gd"), F.desc("m_gf"))))
    order = ["tie", F.desc("gd"), F.desc("gf"), F.desc(F.coalesce("conduct", F.lit(0))), F.coalesce("rank", F.lit(2**31 - 1)), F.desc("team")]
    return table.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(*order))).drop("tie", "m_points", "m_gd", "m_gf")


def best_thirds(ranked: DataFrame, take: int = 8, group: str = "grp") -> DataFrame:
    """The best third-placed teams over all groups: points, goal difference, goals, conduct, rank, group (descending)."""
    thirds = ranked.where(F.col("position") == 3)
    order = [F.desc("points"), F.desc("gd"), F.desc("gf"), F.desc(F.coalesce("conduct", F.lit(0))), F.coalesce("rank", F.lit(2**31 - 1)), F.desc(group)]
    return thirds.orderBy(*order).limit(take)


def allocation_violations(allocations: DataFrame, groups: str = "groups", ident: str | None = None) -> DataFrame:
    """``key, rule``: rows whose key is not eight distinct groups or that do not assign each of them once; repeated keys.

    The key is the sorted groups, or ``ident`` where that column is given.
    """
    letters = F.array_sort(F.split(groups, ""))
    slots = [c for c in allocations.columns if c not in (groups, ident)]
    rows = allocations.select(
        (F.col(ident) if ident else F.array_join(letters, "")).alias("key"), (F.size(F.array_distinct(letters)) != 8).alias("bad_key"), (F.array_sort(F.array(*slots)) != letters).alias("bad_slots")
    )
    bad = rows.select("key", F.explode(F.filter(F.array(F.when(F.col("bad_key"), "not eight groups"), F.when(F.col("bad_slots"), "not each once")), lambda r: r.isNotNull())).alias("rule"))
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("repeated key").alias("rule"))
    return bad.unionByName(twice)


def allocate(thirds: DataFrame, allocations: DataFrame, group: str = "grp", groups: str = "groups") -> DataFrame:
    """The allocation row for the set of groups whose third-placed teams went through."""
    key = thirds.agg(F.array_join(F.array_sort(F.collect_set(group)), "").alias("__key"))  # eight values
    keyed = allocations.withColumn("__key", F.array_join(F.array_sort(F.split(groups, "")), ""))
    return keyed.join(F.broadcast(key), "__key").drop("__key")


def outcome_shares(trials: DataFrame, entity: str, stage: str, trial: str) -> DataFrame:
    """``entity, stage, p, se``: share of trials in which an entity reached a stage, with its binomial standard error."""
    n = trials.agg(F.count_distinct(trial).alias("n"))  # one row
    hits = trials.groupBy(entity, stage).agg(F.count_distinct(trial).alias("hits"))
    p = F.col("hits") / F.col("n")
    return hits.crossJoin(F.broadcast(n)).select(entity, stage, p.alias("p"), F.sqrt(p * (1 - p) / F.col("n")).alias("se"))
