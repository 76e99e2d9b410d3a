"""Structured Streaming ingest: results checked as they arrive, and event counts per window with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import nonnegative_int, parse_boolean, stable_id, text


def stream_table(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def checked_results(raw: DataFrame, delay_hours: int = 3) -> DataFrame:
    """Row-wise part of the match contract, for streams: typed columns and ``valid``; repeats within the watermark are dropped."""
    typed = raw.withColumns(
        {
            "kickoff_utc": F.col("kickoff_utc").cast("timestamp"), "team1": text("team1"), "team2": text("team2"), "team1_goals": nonnegative_int("team1_goals"),
            "team2_goals": nonnegative_int("team2_goals"), "neutral": parse_boolean("neutral"),
        }
    )
    good = F.coalesce((F.col("team1") != F.col("team2")) & F.col("kickoff_utc").isNotNull() & F.col("team1_goals").isNotNull() & F.col("team2_goals").isNotNull() & F.col("neutral").isNotNull(), F.lit(False))
    ident = stable_id(F.lit("stream"), "kickoff_utc", "team1", "team2")
    out = typed.withColumns({"valid": good, "match_id": F.coalesce("match_id", ident), "available_at": F.col("kickoff_utc") + F.expr(f"interval {int(delay_hours)} hours")})
    return out.withWatermark("kickoff_utc", "365 days").dropDuplicatesWithinWatermark(["match_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events per tumbling window and type; events later than ``late`` are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there now, exactly once, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
