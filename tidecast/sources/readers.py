"""Sources and sinks: result tables, goal events, fixtures, ranking pages and snapshots, squads, files."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nonnegative_int, parse_boolean, unescape
from ..operators.asof import rank_position
from ..operators.contracts import canonical_matches
from .names import resolve_names

MATCH_CSV = "match_id string, kickoff_utc string, date string, available_at string, team1 string, team2 string, team1_goals string, team2_goals string, tournament string, neutral string, source string, source_version string"
RESULTS_CSV = "date string, home_team string, away_team string, home_score string, away_score string, tournament string, city string, country string, neutral string"
GOALS_CSV = "date string, home_team string, away_team string, team string, scorer string, minute string, own_goal string, penalty string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV; columns are matched by name, so files may leave out some or have them in another order."""
    header = spark.read.option("header", True).csv(path)
    names = [f.split()[0] for f in schema.split(", ")]
    return header.select(*(F.col(n) if n in header.columns else F.lit(None).cast("string").alias(n) for n in names))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_matches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(matches, violations) of match CSV files."""
    return canonical_matches(read_csv(spark, path, MATCH_CSV))


def file_checksums(spark: SparkSession, path: str, glob: str = "*", block_bytes: int = 8 << 20) -> DataFrame:
    """``path, length, sha256`` of every file below ``path``.

    Spark lists the files without their content; tasks then read them block by block through the file system, so a file of any size
    takes the memory of one block. Empty files are left out, as by all of Spark's file readers. Stores that only Spark opens are read as whole files (2 GB at most).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    listed = files.select("path", "length")
    first = listed.first()
    if first is None:
        return listed.withColumn("sha256", F.lit(None).cast("string"))
    if not opens(first["path"]):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, file in enumerate(batch.column(0).to_pylist()):
                digest = sha256()
                system, place = located(file)
                with system.open_input_stream(place) as stream:
                    while block := stream.read(block_bytes):
                        digest.update(block)
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([digest.hexdigest()])], names=["path", "length", "sha256"])

    # one file after another in a task, large ones spread over tasks
    return listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, length long, sha256 string")


def located(uri: str):
    """(file system, place in it) of a path as Spark gives it, which is not escaped."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    rest = rest if rest.startswith("//") else "//" + rest
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def opens(uri: str) -> bool:
    try:
        system, place = located(uri)
        system.open_input_stream(place).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of ``expected(name, sha256)`` that are missing or differ; the case of digits does not matter."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lower("sha256").alias("found"))
    joined = expected.select("name", F.lower("sha256").alias("wanted")).join(have, "name", "left")
    return joined.where(~F.coalesce(F.col("found") == F.col("wanted"), F.lit(False)))


def ingest_results(raw: DataFrame, aliases: DataFrame, *, version: str, snapshot_at) -> tuple[DataFrame, DataFrame]:
    """(matches, violations) of international results: renamed, stamped, names resolved, canonical."""
    named = raw.withColumnsRenamed({"home_team": "team1", "away_team": "team2", "home_score": "team1_goals", "away_score": "team2_goals"})
    resolved = resolve_names(named, aliases, ["team1", "team2"])
    stamped = resolved.withColumns({"source": F.lit("international_results"), "source_version": F.lit(version), "snapshot_at": F.lit(snapshot_at).cast("timestamp")})
    return canonical_matches(stamped)


def ingest_goals(raw: DataFrame, aliases: DataFrame, *, version: str) -> DataFrame:
    """Goal events: three team columns resolved, minutes that are no number null, strict booleans, scorers trimmed (null: empty)."""
    resolved = resolve_names(raw, aliases, ["home_team", "away_team", "team"])
    return resolved.select(
        F.col("date").try_cast("timestamp").alias("date"), "home_team", "away_team", "team", F.trim(F.coalesce("scorer", F.lit(""))).alias("scorer"),
        nonnegative_int("minute").alias("minute"), parse_boolean("own_goal").alias("own_goal"), parse_boolean("penalty").alias("penalty"), F.lit(version).alias("source_version"),
    )


FIXTURE = "num: bigint, id: string, match_id: string, round: string, stage: string, date: string, time: string, kickoff_utc: string, team1: string, team2: string, group: string"
PAYLOAD = f"struct<rounds: array<struct<name: string, round: string, matches: array<struct<{FIXTURE}>>>>, matches: array<struct<{FIXTURE}>>>"


def team_name(c: str) -> tuple[Column, Column]:
    """(name, unresolved) of a team given as text or as an object with a name, title, team or code."""
    value = F.trim(c)
    inner = F.when(value.startswith("{"), F.coalesce(*(F.nullif(F.trim(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in ("name", "title", "team", "code")))).otherwise(F.nullif(value, F.lit("")))
    open_slot = inner.rlike(r"(?i)^[WLR][0-9]+$") | F.lower(inner).contains("winner")
    return F.coalesce(inner, F.lit("UNRESOLVED")), F.coalesce(open_slot, F.lit(True))


def fixture_kickoff() -> Column:
    """``kickoff_utc``, else date and a time such as "13:00 UTC-6" or "13:00 UTC+5:30"."""
    time = F.coalesce(F.nullif(F.trim("time"), F.lit("")), F.lit("00:00"))
    clock = F.trim(F.regexp_replace(time, r"(?i)UTC\s*[+-]\s*\d{1,2}(:\d{2})?", ""))
    offset = r"(?i)UTC\s*([+-])\s*(\d{1,2})(?::(\d{2}))?"
    minutes = F.coalesce(F.regexp_extract(time, offset, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.regexp_extract(time, offset, 3).try_cast("int"), F.lit(0))
    signed = F.when(F.regexp_extract(time, offset, 1) == "-", -minutes).otherwise(minutes)
    local = F.try_to_timestamp(F.concat_ws(" ", "date", clock), F.lit("yyyy-MM-dd H:mm"))
    return F.coalesce(F.col("kickoff_utc").try_cast("timestamp"), F.timestamp_micros(F.unix_micros(local) - signed.cast("long") * 60_000_000))


def parse_fixtures(payloads: DataFrame, payload: str = "payload", key: str = "source") -> DataFrame:
    """One row per match of JSON payloads in either layout, with flags for sides that are still open.

    The id is match_id, id, num or the match's place in its payload.
    """
    doc = payloads.select(F.col(key).alias("source"), F.from_json(payload, PAYLOAD).alias("p"))
    by_round = F.flatten(F.transform("p.rounds", lambda r: F.transform(r["matches"], lambda m: F.struct(F.coalesce(r["name"], r["round"], F.lit("unknown")).alias("of"), m.alias("m")))))
    plain = F.transform("p.matches", lambda m: F.struct(F.coalesce(m["round"], m["stage"], F.lit("unknown")).alias("of"), m.alias("m")))
    every = doc.select("source", F.posexplode(F.when(F.size("p.rounds") > 0, by_round).otherwise(plain)).alias("at", "x")).select("source", "at", F.col("x.of").alias("phase"), "x.m.*")
    (one, open1), (two, open2) = team_name("team1"), team_name("team2")
    return every.select(
        "source", F.coalesce("match_id", "id", F.col("num").cast("string"), (F.col("at") + 1).cast("string")).alias("match_id"), F.col("phase").alias("stage"), fixture_kickoff().alias("kickoff_utc"),
        one.alias("team1"), two.alias("team2"), F.trim(F.regexp_replace("group", r"(?i)^\s*group\s+", "")).alias("group"), open1.alias("team1_open"), open2.alias("team2_open"),
    )


def repeated_fixture_ids(fixtures: DataFrame) -> DataFrame:
    return fixtures.groupBy("source", "match_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(mirror: DataFrame, official: DataFrame, fields=("kickoff_utc", "team1", "team2", "group", "stage"), key: str = "match_id") -> DataFrame:
    """``match_id, field, mirror, official, status``: rows on one side only, and fields that differ (null-safe, by type)."""
    sides = [df.select(F.col(key).alias(f"{p}_key"), F.struct(*fields).alias(p)) for df, p in ((mirror, "mirror"), (official, "official"))]
    both = sides[0].join(sides[1], F.col("mirror_key") == F.col("official_key"), "full_outer")
    alone = F.when(F.col("mirror_key").isNull(), "right_only").when(F.col("official_key").isNull(), "left_only")
    none = F.lit(None).cast("string")
    differ = [F.when(~F.col(f"mirror.{f}").eqNullSafe(F.col(f"official.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"mirror.{f}").cast("string").alias("mirror"), F.col(f"official.{f}").cast("string").alias("official"), F.lit("mismatch").alias("status"))) for f in fields]
    lone = F.struct(F.lit(key).alias("field"), none.alias("mirror"), none.alias("official"), alone.alias("status"))
    found = F.when(alone.isNotNull(), F.array(lone)).otherwise(F.filter(F.array(*differ), lambda x: x.isNotNull()))
    return both.select(F.coalesce("mirror_key", "official_key").alias(key), F.inline(found))


def key_prefix(bits: int, name: str = "__h") -> Column:
    return F.shiftrightunsigned(F.col(name), 64 - bits)


def differing_ranges(mirror: DataFrame, official: DataFrame, fields, key: str = "match_id", *, bits: int = 10, leaf_rows: int = 1_000, most: int = 100_000) -> tuple[DataFrame | None, int]:
    """(prefixes of key hashes in which two tables differ, their bits): a hash tree, descended only where sums differ.

    Each level adds up number and hashes of the rows of each range, on both sides; what moves is one row for each range and task. It goes down until ranges that
    differ hold few rows. None if more than ``most`` ranges differ: then the tables have little in common.
    """
    wanted, depth = None, 0
    while True:
        depth += bits

        def sums(df: DataFrame, side: str, depth=depth, wanted=wanted) -> DataFrame:
            rows = df.select(F.xxhash64(key).alias("__h"), F.xxhash64(key, *(F.col(f).cast("string") for f in fields), *(F.col(f).isNull() for f in fields)).alias("__r"))
            if wanted is not None:
                rows = rows.join(F.broadcast(wanted), key_prefix(depth - bits) == F.col("prefix"), "left_semi")
            return rows.groupBy(key_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor("__r").alias(f"x_{side}"), F.sum(F.col("__r").cast("decimal(38,0)")).alias(f"s_{side}"))

        both = sums(mirror, "a").join(sums(official, "b"), "prefix", "full_outer")
        same = F.coalesce((F.col("n_a") == F.col("n_b")) & (F.col("x_a") == F.col("x_b")) & (F.col("s_a") == F.col("s_b")), F.lit(False))
        found = both.where(~same).select("prefix", F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("n")).limit(most + 1).toPandas()
        if len(found) > most:
            return None, depth
        spark = mirror.sparkSession
        wanted = spark.createDataFrame([(int(p),) for p in found["prefix"]], "prefix long")
        if not len(found) or found["n"].max() <= leaf_rows or depth + bits > 40:
            return wanted, depth


def reconcile_ranges(mirror: DataFrame, official: DataFrame, fields=("kickoff_utc", "team1", "team2", "group", "stage"), key: str = "match_id", **options) -> DataFrame:
    """The report of ``reconcile`` for tables that differ in few rows: only the rows of hash ranges that differ are joined.

    Rows without a key are on one side only, as there. Two tables whose rows of a range differ but have equal number, exclusive-or and sum of 64-bit hashes are taken for equal.
    """
    ranges, depth = differing_ranges(mirror, official, fields, key, **options)
    if ranges is None:
        return reconcile(mirror, official, fields, key)
    own = F.shiftrightunsigned(F.xxhash64(key), 64 - depth) == F.col("prefix")
    sides = [df.join(F.broadcast(ranges), own, "left_semi") for df in (mirror, official)]
    return reconcile(*sides, fields, key)


PAGE = (
    "struct<buildId: string, props: struct<pageProps: struct<pageData: struct<ranking: struct<dates: array<struct<dates: array<struct<id: string, iso: string>>>>, "
    "allAvailableDates: array<struct<id: string, date: string, matchWindowEndDate: string>>>>>>>"
)


def page_schedules(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``page_id, schedule_id, ranking_date, published_at, build_id`` from the JSON that pages embed.

    A schedule is published at its exact time, or a day after its ranking date
    where none is given. Of repeated ids the first stands; pages without the
    script give no rows.
    """
    script = F.regexp_extract(html, r"(?is)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    doc = pages.select(F.col(key).alias("page_id"), F.nullif(script, F.lit("")).alias("s")).where("s is not null").select("page_id", F.from_json(unescape("s"), PAGE).alias("j"))
    ranking = doc.select("page_id", F.coalesce("j.buildId", F.lit("unknown")).alias("build_id"), F.col("j.props.pageProps.pageData.ranking").alias("r"))
    exact = F.map_from_entries(F.array_distinct(F.transform(F.coalesce(F.flatten(F.transform("r.dates", lambda y: y["dates"])), F.array().cast("array<struct<id: string, iso: string>>")), lambda d: F.struct(d["id"], d["iso"]))))
    rows = ranking.select("page_id", "build_id", exact.alias("exact"), F.posexplode("r.allAvailableDates").alias("at", "d"))
    firsts = rows.groupBy("page_id", F.col("d.id").alias("schedule_id")).agg(F.min_by(F.struct("build_id", "d", F.element_at("exact", F.col("d.id")).alias("iso")), "at").alias("x"))
    day = F.coalesce("x.d.matchWindowEndDate", "x.d.date")
    published = F.coalesce(F.col("x.iso").try_cast("timestamp"), day.try_cast("timestamp") + F.expr("interval 1 day"))
    return firsts.select("page_id", "schedule_id", day.alias("ranking_date"), published.alias("published_at"), F.col("x.build_id").alias("build_id"))


SNAPSHOT = "struct<Results: array<struct<TeamName: array<struct<Locale: string, Description: string>>, IdCountry: string, ConfederationName: string, Rank: string, PrevRank: string, TotalPoints: string, PrevPoints: string, RatedMatches: string>>>"


def ranking_rows(payloads: DataFrame, payload: str = "payload", schedule: str = "schedule_id", published: str = "published_at") -> DataFrame:
    """Ranking payloads as rows with rank percentile and standardised points within each schedule."""
    doc = payloads.select(F.col(schedule).alias("schedule_id"), F.col(published).alias("rating_date"), F.explode(F.from_json(payload, SNAPSHOT)["Results"]).alias("r"))
    english = F.filter("r.TeamName", lambda n: F.lower(n["Locale"]).startswith("en"))
    flat = doc.select(
        "schedule_id", "rating_date", F.trim(F.get(english, 0)["Description"]).alias("team"), F.col("r.IdCountry").alias("country"), F.col("r.ConfederationName").alias("confederation"),
        F.col("r.Rank").try_cast("int").alias("fifa_rank"), F.col("r.PrevRank").try_cast("int").alias("fifa_previous_rank"), F.col("r.TotalPoints").try_cast("double").alias("fifa_points"),
        F.col("r.PrevPoints").try_cast("double").alias("fifa_previous_points"), F.col("r.RatedMatches").try_cast("int").alias("fifa_rated_matches"),
    )
    return rank_position(flat)


def extend_ranking_corpus(spark: SparkSession, files: str, corpus: str, schedules: DataFrame, glob: str = "*.json.gz", name: str = r"([^/.]+)[^/]*$") -> int:
    """Add to ``corpus`` the ranking snapshots below ``files`` that it does not have; the number of files read.

    A file is known by the hash of its content, kept in the corpus' manifest; the group of ``name`` in its path is its schedule. New snapshots
    are one batch, in a folder named by their hashes, and count once the manifest has that batch: a run that broke off is done again in the same place.
    """
    listed = file_checksums(spark, files, glob).select("path", "sha256").dropDuplicates(["sha256"])
    known = corpus_manifest(spark, corpus)
    new = listed.join(known.select("sha256"), "sha256", "left_anti").select("sha256", "path").checkpoint()
    digest = new.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sha256")).alias("x"), F.sum(F.xxhash64("sha256").cast("decimal(38,0)")).alias("s")).first()
    if not digest["n"]:
        return 0
    batch = sha256(f"{digest['n']}|{digest['x']}|{digest['s']}".encode()).hexdigest()[:16]
    content = spark.read.option("wholetext", True).text([r["path"] for r in new.select("path").collect()]).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    stamped = content.withColumn("schedule_id", F.regexp_extract("path", name, 1)).join(schedules.select("schedule_id", "published_at"), "schedule_id")
    ranking_rows(stamped).write.mode("overwrite").parquet(f"{corpus}/rows/batch={batch}")
    new.select("sha256", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{corpus}/manifest")
    return digest["n"]


def corpus_manifest(spark: SparkSession, corpus: str) -> DataFrame:
    """``sha256, batch`` of the snapshots that a corpus has."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{corpus}/manifest").dropDuplicates(["sha256"])
    except AnalysisException:
        return spark.createDataFrame([], "sha256 string, batch string")


def read_extended_corpus(spark: SparkSession, corpus: str) -> DataFrame:
    """The rows of all batches in the manifest."""
    done = corpus_manifest(spark, corpus).select("batch").distinct()
    return spark.read.option("basePath", f"{corpus}/rows").parquet(f"{corpus}/rows").join(F.broadcast(done), "batch").drop("batch")


def read_ranking_corpus(spark: SparkSession, folder: str, schedules: DataFrame, start, end) -> DataFrame:
    """All cached payloads (``{schedule_id}.json.gz``) whose schedule was published in [start, end), in one scan."""
    files = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json(\.gz)?$", 1).alias("schedule_id"), F.col("value").alias("payload"))
    wanted = schedules.where((F.col("published_at") >= F.lit(start).cast("timestamp")) & (F.col("published_at") < F.lit(end).cast("timestamp")))
    return ranking_rows(files.join(wanted.select("schedule_id", "published_at"), "schedule_id"))
