"""The alias dimension: name keys, conflicts, resolution of name columns, and a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unicode_key

#: Largest alias dimension that is broadcast; beyond it the names are joined by shuffle.
BROADCAST_ALIASES = 100_000


def alias_keys(aliases: DataFrame) -> DataFrame:
    """``key, canonical`` of ``aliases(canonical, alias)``; each canonical name is an alias of itself."""
    every = aliases.select("canonical", F.col("alias").alias("name")).unionByName(aliases.select("canonical", F.col("canonical").alias("name")))
    return every.where("name is not null").select(unicode_key("name").alias("key"), "canonical").distinct()


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """``key, n``: keys that stand for several canonical names."""
    return alias_keys(aliases).groupBy("key").agg(F.count_distinct("canonical").alias("n")).where("n > 1")


def name_lookup(df: DataFrame, aliases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, canonical, resolved`` for the distinct names of some columns (the key function runs on these only)."""
    names = df.select(F.explode(F.array(*columns)).alias("name")).where("name is not null").distinct()
    keys = alias_keys(aliases).groupBy("key").agg(F.min("canonical").alias("canonical"))
    found = names.select("name", unicode_key("name").alias("key")).join(keys, "key", "left")
    return found.select("name", F.coalesce("canonical", F.trim("name")).alias("canonical"), F.col("canonical").isNotNull().alias("resolved"))


def resolve_names(df: DataFrame, aliases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with canonical names; names without an entry keep their trimmed text."""
    lookup = name_lookup(df, aliases, columns)
    out = df
    for i, c in enumerate(columns):
        own = lookup.select(F.col("name").alias(f"__n{i}"), F.col("canonical").alias(f"__c{i}"))
        out = out.join(own, F.col(c) == F.col(f"__n{i}"), "left").withColumn(c, F.coalesce(f"__c{i}", F.trim(c))).drop(f"__n{i}", f"__c{i}")
    return out


def name_report(df: DataFrame, aliases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: values, values changed through an alias, and the sorted names without an entry. Where these may be many, ``unresolved_names`` has them as rows."""
    values = df.select(F.explode(F.array(*columns)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    joined = values.join(name_lookup(df, aliases, columns), "name")
    changed = F.col("resolved") & (F.col("canonical") != F.trim("name"))
    return joined.agg(F.sum("n").alias("total_values"), F.sum(F.when(changed, F.col("n")).otherwise(0)).alias("alias_matches"), F.array_sort(F.collect_set(F.when(~F.col("resolved"), F.trim("name")))).alias("unresolved"))


def unresolved_names(df: DataFrame, aliases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, n``: the trimmed names without an entry, and how many values have each."""
    values = df.select(F.explode(F.array(*columns)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    missing = values.join(name_lookup(df, aliases, columns).where(~F.col("resolved")), "name")
    return missing.groupBy(F.trim("name").alias("name")).agg(F.sum("n").alias("n"))
