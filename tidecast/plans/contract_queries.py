"""Queries for sources, contracts, entity resolution, sets and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import contracts as K
from ..operators.asof import rank_position
from ..operators.context import base_context, feature_columns
from ..sources import names as N
from ..sources import readers as R
from ..sources.fixtures import stored, table, view
from ..sources.scratch import scratch
from .registry import query, rounded


def matches(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "matches")


def preds(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "preds")


# --- sources and sinks

def results_raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw results: names in several spellings, text columns, some scores missing."""
    orders, nation = table(spark, d, "orders"), table(spark, d, "nation")
    key = F.col("n_nationkey")
    spelled = F.concat(F.when(key % 3 == 0, " ").otherwise(""), F.when(key % 2 == 0, F.lower("n_name")).otherwise(F.translate("n_name", "_", " ")))
    return orders.join(F.broadcast(nation), F.col("o_custkey") % 25 == key).select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), spelled.alias("home_team"), F.concat(F.lit("NATION_"), (F.col("o_custkey") * 7 + 3) % 25).alias("away_team"),
        F.when(F.col("o_orderkey") % 50 != 0, (F.col("o_orderkey") % 5).cast("string")).alias("home_score"), (F.col("o_custkey") % 4).cast("string").alias("away_score"),
        F.col("o_orderpriority").alias("tournament"), F.concat(F.lit("c"), F.col("o_orderkey") % 10).alias("city"), F.lit("x").alias("country"), F.when(F.col("o_orderstatus") == "P", "Yes").otherwise("no").alias("neutral"),
    )


RESULTS_SQL = """results as (
  select strftime(o_orderdate, '%Y-%m-%d') as date,
         concat(case when n_nationkey % 3 = 0 then ' ' else '' end, case when n_nationkey % 2 = 0 then lower(n_name) else replace(n_name, '_', ' ') end) as home_team,
         concat('NATION_', cast((o_custkey * 7 + 3) % 25 as varchar)) as away_team, case when o_orderkey % 50 <> 0 then o_orderkey % 5 end as home_score, o_custkey % 4 as away_score,
         o_orderpriority as tournament, concat('c', cast(o_orderkey % 10 as varchar)) as city, case when o_orderstatus = 'P' then 'Yes' else 'no' end as neutral, n_name
  from orders join nation on n_nationkey = o_custkey % 25)"""


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("canonical"), F.translate("n_name", "_", " ").alias("alias"))


@query("select match_id, epoch_us(kickoff_utc) as k, team1, team2, team1_goals, team2_goals, neutral, epoch_us(available_at) as a from matches", "matches")
def s1_match_csv(spark, d):
    path = scratch(spark, "matches")
    text = matches(spark, d).select("match_id", F.date_format("kickoff_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("kickoff_utc"), "team1", "team2", "team1_goals", "team2_goals", "tournament", "neutral")
    R.write_csv(text, path)
    read, _ = R.read_matches(spark, path)
    return read.select("match_id", C.micros("kickoff_utc").alias("k"), "team1", "team2", "team1_goals", "team2_goals", "neutral", C.micros("available_at").alias("a"))


@query("select team, count(*) as n, cast(sum(points) as double) as points from ratings group by team", "ratings")
def s2_csv_sink(spark, d):
    path = scratch(spark, "ratings")
    R.write_csv(view(spark, d, "ratings").select("team", "rating_date", "points"), path)
    back = R.read_csv(spark, path, "team string, rating_date string, points string")
    return back.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("points").cast("double")).alias("points"))


@query(f"with {RESULTS_SQL} select n_name as team1, away_team as team2, cast(home_score as int) as g1, cast(away_score as int) as g2, neutral = 'Yes' as neutral, date, tournament, 'v1' as source_version, city from results")
def s3_results_ingest(spark, d):
    out, _ = R.ingest_results(results_raw(spark, d), aliases(spark, d), version="v1", snapshot_at="2030-01-01")
    return out.select("team1", "team2", F.col("team1_goals").alias("g1"), F.col("team2_goals").alias("g2"), "neutral", "date", "tournament", "source_version", "city")


@query("select match_id, team, trim(scorer) as scorer, own_goal, penalty, case when length(scorer) % 2 = 0 then 45 end as minute from goals", "goals")
def s4_goal_ingest(spark, d):
    g = view(spark, d, "goals")
    raw = g.select(
        F.date_format("kickoff_utc", "yyyy-MM-dd").alias("date"), F.col("match_id").alias("home_team"), F.col("team2").alias("away_team"), "team", F.concat(F.lit("  "), "scorer").alias("scorer"),
        F.when(F.length("scorer") % 2 == 0, "45").otherwise("n/a").alias("minute"), F.col("own_goal").cast("string").alias("own_goal"), F.when(F.col("penalty"), "YES").otherwise("f").alias("penalty"),
    )
    path = scratch(spark, "goals")
    R.write_csv(raw, path)
    out = R.ingest_goals(R.read_csv(spark, path, R.GOALS_CSV), aliases(spark, d), version="v1")
    return out.select(F.col("home_team").alias("match_id"), "team", "scorer", "own_goal", "penalty", "minute")


def fixture_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload per month of matches, in either layout, with local times and open slots."""
    m = matches(spark, d).withColumn("num", F.substring("match_id", 2, 20).cast("long"))
    item = F.struct(
        "num", F.date_format("kickoff_utc", "yyyy-MM-dd").alias("date"), F.when(F.col("num") % 2 == 0, "13:00 UTC-6").otherwise("9:30 UTC+5:30").alias("time"),
        F.when(F.col("num") % 10 == 0, F.concat(F.lit("W"), F.col("num").cast("string"))).otherwise(F.col("team1")).alias("team1"), F.struct(F.col("team2").alias("name")).alias("team2"), F.lit("Group A").alias("group"), F.lit("R1").alias("round"),
    )
    months = m.groupBy(F.date_format("kickoff_utc", "yyyy-MM").alias("source")).agg(F.collect_list(item).alias("matches"))
    nested = F.to_json(F.struct(F.array(F.struct(F.lit("R1").alias("name"), "matches")).alias("rounds")))
    return months.select("source", F.when(F.substring("source", 6, 2).cast("int") % 2 == 0, nested).otherwise(F.to_json(F.struct("matches"))).alias("payload"))


@query(
    """select substring(match_id, 2) as match_id, 'R1' as stage, epoch_us(kickoff_utc) + case when k % 2 = 0 then 19 * 3600000000 else 4 * 3600000000 end as k,
    case when k % 10 = 0 then concat('W', cast(k as varchar)) else team1 end as team1, team2, 'A' as grp, k % 10 = 0 as team1_open, false as team2_open
    from (select *, cast(substring(match_id, 2) as bigint) as k from matches)""", "matches")  # fmt: skip
def s5_fixtures(spark, d):
    out = R.parse_fixtures(fixture_payloads(spark, d))
    return out.select("match_id", "stage", C.micros("kickoff_utc").alias("k"), "team1", "team2", F.col("group").alias("grp"), "team1_open", "team2_open")


@query("""select cast(o_custkey as bigint) as page_id, concat('id', cast(o_orderkey as varchar)) as schedule_id, strftime(max(o_orderdate), '%Y-%m-%d') as ranking_date,
          epoch_us(max(o_orderdate)) + case when o_orderkey % 2 = 0 then 36000000000 else 86400000000 end as published, 'b1' as build_id from orders group by o_custkey, o_orderkey""")
def s6_ranking_pages(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderkey").agg(F.max("o_orderdate").alias("t"))
    day = F.date_format("t", "yyyy-MM-dd")
    one = F.struct(F.concat(F.lit("id"), "o_orderkey").alias("id"), day.alias("date"))
    exact = F.struct(F.concat(F.lit("id"), "o_orderkey").alias("id"), F.concat(day, F.lit("T10:00:00Z")).alias("iso"))
    grouped = o.groupBy("o_custkey").agg(F.collect_list(one).alias("one"), F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, exact)).alias("exact"))
    ranking = F.struct(F.array(F.struct(F.col("exact").alias("dates"))).alias("dates"), F.concat("one", "one").alias("allAvailableDates"))
    doc = F.to_json(F.struct(F.lit("b1").alias("buildId"), F.struct(F.struct(F.struct(ranking.alias("ranking")).alias("pageData")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.replace(doc, F.lit('"'), F.lit("&quot;")), F.lit("</script></html>"))
    out = R.page_schedules(grouped.select(F.col("o_custkey").alias("page_id"), html.alias("html")))
    return out.select("page_id", "schedule_id", "ranking_date", C.micros("published_at").alias("published"), "build_id")


def ranking_payloads(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "ratings").withColumn("rank", F.rank().over(W.partitionBy("rating_date").orderBy(F.desc("points"))))
    name = F.array(F.struct(F.lit("fr-FR").alias("Locale"), F.lit("x").alias("Description")), F.struct(F.lit("en-GB").alias("Locale"), F.col("team").alias("Description")))
    item = F.struct(name.alias("TeamName"), F.col("rank").cast("string").alias("Rank"), F.col("points").cast("string").alias("TotalPoints"), F.col("n_rows").cast("string").alias("RatedMatches"), F.when(F.col("block") == 0, "UEFA").otherwise("CAF").alias("ConfederationName"))
    schedule = F.date_format("rating_date", "yyyyMMdd")
    return r.groupBy(schedule.alias("schedule_id"), F.col("rating_date").cast("timestamp").alias("published_at")).agg(F.collect_list(item).alias("Results")).select("schedule_id", "published_at", F.to_json(F.struct("Results")).alias("payload"))


RANKING_SQL = """select strftime(rating_date, '%Y%m%d') as schedule_id, team, cast(rank() over w as int) as fifa_rank, points as fifa_points, cast(n_rows as int) as fifa_rated_matches,
  round(1 - (rank() over w - 1) / greatest(count(*) over (partition by rating_date) - 1, 1), 6) + 0.0 as rank_percentile,
  coalesce(round((points - avg(points) over (partition by rating_date)) / nullif(stddev_pop(points) over (partition by rating_date), 0), 6), 0) + 0.0 as points_z
  from ratings {where} window w as (partition by rating_date order by points desc)"""


@query(RANKING_SQL.format(where=""), "ratings")
def s7_ranking_rows(spark, d):
    return rounded(R.ranking_rows(ranking_payloads(spark, d)).select("schedule_id", "team", "fifa_rank", "fifa_points", "fifa_rated_matches", "rank_percentile", "points_z"))


@query(RANKING_SQL.format(where="where rating_date >= timestamp '1999-01-01' and rating_date < timestamp '2001-01-01'"), "ratings")
def s8_ranking_corpus(spark, d):
    payloads, path = ranking_payloads(spark, d), scratch(spark, "rankings")
    # partitioned writing gives one folder per schedule; the reader takes the schedule from the path
    payloads.select(F.concat(F.col("schedule_id"), F.lit(".json")).alias("f"), F.col("payload").alias("value")).repartition("f").write.partitionBy("f").text(path, compression="gzip")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    named = files.select(F.regexp_extract(F.input_file_name(), r"f=([^/]+)\.json/", 1).alias("schedule_id"), F.rtrim("value").alias("payload"))
    wanted = K.between(payloads.select("schedule_id", "published_at"), "1999-01-01", "2001-01-01", "published_at")
    out = R.ranking_rows(named.join(wanted, "schedule_id"))
    return rounded(out.select("schedule_id", "team", "fifa_rank", "fifa_points", "fifa_rated_matches", "rank_percentile", "points_z"))


@query(RANKING_SQL.format(where=""), "ratings")
def s8_incremental_corpus(spark, d):
    """The corpus in two runs: the second reads only the snapshots that came since."""
    payloads, path = ranking_payloads(spark, d), scratch(spark, "snapshots")
    corpus = f"{path}/corpus"
    parts = payloads.select(F.col("schedule_id").alias("f"), F.col("payload").alias("value"), (F.col("published_at") < "1999-01-01").alias("early"))
    for early in (True, False):
        parts.where(F.col("early") == early).select("f", "value").repartition("f").write.partitionBy("f").text(f"{path}/files/{early}", compression="gzip")
        R.extend_ranking_corpus(spark, f"{path}/files", corpus, payloads, "*.txt.gz", r"f=([^/]+)/")
    return rounded(R.read_extended_corpus(spark, corpus).select("schedule_id", "team", "fifa_rank", "fifa_points", "fifa_rated_matches", "rank_percentile", "points_z"))


@query("select team, count(*) as n, round(avg(player_rating), 4) as rating, count(distinct snapshot_id) as snapshots from players group by team", "players")
def s9_player_ingest(spark, d):
    path = scratch(spark, "players")
    N.resolve_names(view(spark, d, "players"), aliases(spark, d), ["team"]).write.parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("player_rating"), 4).alias("rating"), F.count_distinct("snapshot_id").alias("snapshots"))


@query("select concat('s', cast(s_nationkey as varchar)) as key, count(distinct s_name) as n from supplier group by s_nationkey having count(distinct s_name) > 1")
def s10_alias_conflicts(spark, d):
    s = table(spark, d, "supplier")
    return N.alias_conflicts(s.select(F.col("s_name").alias("canonical"), F.concat(F.lit(" S"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("alias"))).where(F.col("key").rlike("^s[0-9]+$"))


@query("select match_id, team1, year(kickoff_utc) as yr from matches where year(kickoff_utc) >= 2000", "matches")
def s11_parquet_subset(spark, d):
    path = scratch(spark, "by_year")
    matches(spark, d).withColumn("yr", F.year("kickoff_utc")).write.partitionBy("yr").parquet(path)
    return spark.read.parquet(path).select("match_id", "team1", F.col("yr").cast("long").alias("yr")).where("yr >= 2000")


@query("""with t as (select cast(p_partkey as varchar) as id, p_partkey % 9 as bad from part)
select id as key, 'not each once' as rule from t where bad = 1 union all select id, 'repeated key' from t where bad = 2""")
def s12_allocation_check(spark, d):
    """Allocation rows made from parts: rotations of eight groups, a ninth of them wrong and a ninth repeated."""
    from ..operators.standings import allocation_violations

    p = table(spark, d, "part").select("p_partkey")
    letters = "ABCDEFGH"
    shift = (F.col("p_partkey") % 8).cast("int")
    slot = lambda i: F.when((F.col("p_partkey") % 9 == 1) & F.lit(i == 0), F.lit("Z")).otherwise(F.substring(F.lit(letters * 2), shift + (i + 1), F.lit(1)))
    rows = p.select(F.lit(letters).alias("groups"), F.col("p_partkey").cast("string").alias("id"), *(slot(i).alias(f"s{i}") for i in range(8)))
    rows = rows.unionByName(rows.where(F.col("id").cast("long") % 9 == 2))
    return allocation_violations(rows, ident="id")


@query()
def s13_checksums(spark, d):
    path = scratch(spark, "files")
    # a file's content is one cell, so files are bounded and their number grows with the table
    table(spark, d, "lineitem").write.option("maxRecordsPerFile", 50_000).json(path)
    files = R.file_checksums(spark, path, "*.json")
    upper = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.upper("sha256").alias("sha256"))
    return R.verify_checksums(files, upper).unionByName(R.verify_checksums(files, upper.withColumn("sha256", F.lit("0"))))


@query("select count(*) as n_rows, epoch_us(min(kickoff_utc)) as first_k, epoch_us(max(kickoff_utc)) as last_k from matches where available_at < timestamp '2000-01-01'", "matches")
def s14_manifest_sink(spark, d):
    snap = K.known_at(matches(spark, d).withColumn("source_version", F.lit("v1")), "2000-01-01")
    path = scratch(spark, "manifest")
    K.manifest(snap).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "n_rows long, first_kickoff timestamp, last_kickoff timestamp").alias("j")).select("j.*")
    return back.select("n_rows", C.micros("first_kickoff").alias("first_k"), C.micros("last_kickoff").alias("last_k"))


# --- contracts

@query("select true as is_valid, count(*) as n_rows, 0 as n_missing from matches", "matches")
def p1_required_columns(spark, d):
    return K.column_report(matches(spark, d)).select("is_valid", "n_rows", F.size("missing").alias("n_missing"))


@query("""with teams as (select epoch_us(kickoff_utc) k, team1 as team from matches union all select epoch_us(kickoff_utc), team2 from matches)
select rule, count(*) as n_keys, cast(sum(n) as bigint) as n_rows from (
  select 'repeated pair' as rule, count(*) as n from matches group by kickoff_utc, least(team1, team2), greatest(team1, team2) having count(*) > 1
  union all select 'team twice', count(*) from teams group by k, team having count(*) > 1) group by rule""", "matches")
def p2_canonical(spark, d):
    raw = matches(spark, d).select("match_id", F.col("kickoff_utc").cast("string").alias("date"), F.concat(F.lit(" "), "team1").alias("team1"), "team2", "team1_goals", "team2_goals", "tournament", F.col("neutral").cast("string").alias("neutral"))
    _, violations = K.canonical_matches(raw)
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


@query("select o_orderkey, case o_orderstatus when 'P' then true when 'F' then false end as flag, o_custkey from orders")
def p3_boolean_parse(spark, d):
    word = F.when(F.col("o_orderstatus") == "P", " Yes ").when(F.col("o_orderstatus") == "F", "FALSE").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", C.parse_boolean(word).alias("flag"), "o_custkey")


@query("select o_orderkey, case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then cast(o_custkey as int) end as whole from orders")
def p4_nonnegative_int(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_custkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("-"), key)).when(key % 3 == 1, key.cast("string")).otherwise(F.concat(key.cast("string"), F.lit(".5")))
    return o.select("o_orderkey", C.nonnegative_int(F.when(key == 0, "x").otherwise(raw)).alias("whole"))


@query("select match_id, left(sha256(concat('src|', strftime(kickoff_utc, '%Y-%m-%dT%H:%M:%S+00:00'), '|', team1, '|', team2)), 20) as stable_id from matches", "matches")
def p5_stable_id(spark, d):
    return matches(spark, d).select("match_id", C.stable_id(F.lit("src"), "kickoff_utc", "team1", "team2").alias("stable_id"))


@query("""select 'repeated pair' as rule, concat(strftime(kickoff_utc, '%Y-%m-%d %H:%M:%S'), '|', least(team1, team2), '|', greatest(team1, team2)) as key, count(*) as n
from matches group by kickoff_utc, least(team1, team2), greatest(team1, team2) having count(*) > 1
union all select 'team twice', concat(strftime(k, '%Y-%m-%d %H:%M:%S'), '|', team), count(*) from (select kickoff_utc k, team1 team from matches union all select kickoff_utc, team2 from matches) group by k, team having count(*) > 1""", "matches")
def p6_duplicates(spark, d):
    return K.duplicate_violations(matches(spark, d))


@query("select match_id, case when team1_goals > team2_goals then 2 when team1_goals = team2_goals then 1 else 0 end as outcome from matches", "matches")
def p7_outcome(spark, d):
    return matches(spark, d).select("match_id", C.outcome().alias("outcome"))


@query("select match_id, team1 from matches where kickoff_utc >= timestamp '1998-06-01' and kickoff_utc < timestamp '1999-06-01'", "matches")
def p8_date_filter(spark, d):
    return K.between(matches(spark, d), "1998-06-01", "1999-06-01").select("match_id", "team1")


@query("select match_id, epoch_us(timestamp '2000-01-01') as snapshot from matches where late_available_at < timestamp '2000-01-01'", "matches")
def p9_snapshot(spark, d):
    return K.known_at(matches(spark, d), "2000-01-01", "late_available_at").select("match_id", C.micros("snapshot_at").alias("snapshot"))


@query("""select rule, count(*) as n_snapshots, cast(sum(n) as bigint) as n_rows from (
  select 'start_probability' as rule, snapshot_id, count(*) as n from players where start_probability > 1 group by snapshot_id
  union all select 'age_years', snapshot_id, count(*) from players where age_years - 6 < 14 group by snapshot_id) group by rule""", "players")
def p10_squad_contract(spark, d):
    from ..operators.squads import snapshot_violations

    return snapshot_violations(view(spark, d, "players").withColumn("age_years", F.col("age_years") - 6)).groupBy("rule").agg(F.count(F.lit(1)).alias("n_snapshots"), F.sum("n").alias("n_rows"))


STATUS_SQL = f"""with {RESULTS_SQL},
st as (select *, case when home_score is null or away_score is null then 'incomplete' when date < '1998-01-01' then 'pre-start' when date >= '2001-01-01' then 'after cutoff'
  when row_number() over (partition by date, home_team, away_team, home_score, away_score, tournament, neutral order by city) > 1 then 'duplicate' else 'kept' end as s0 from results),
many as (select date, team from (select date, home_team as team from st where s0 = 'kept' union all select date, away_team from st where s0 = 'kept') group by date, team having count(*) > 1),
final as (select st.*, case when s0 = 'kept' and (a.team is not null or b.team is not null) then 'ambiguous' else s0 end as status
  from st left join many a on a.date = st.date and a.team = home_team left join many b on b.date = st.date and b.team = away_team)"""


def statuses(spark: SparkSession, d: str) -> DataFrame:
    return K.completed_results(results_raw(spark, d), "1998-01-01", "2001-01-01")


@query(STATUS_SQL + " select date, home_team, away_team, status, count(*) as n from final group by all")
def p11_completed_results(spark, d):
    return statuses(spark, d).groupBy("date", "home_team", "away_team", "status").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) filter (where late_available_at >= kickoff_utc) as n_late_available_at, 0 as n_earlier from matches", "matches")
def p12_leakage(spark, d):
    m = matches(spark, d).withColumn("earlier", F.col("kickoff_utc") - F.expr("interval 1 day"))
    return K.leakage(m, ["late_available_at", "earlier"])


@query("select count(*) as n_rows, count(*) filter (where p_draw > 0.3) as n_range, count(*) filter (where p_draw <= 0.3 and p_draw > 0.2) as n_sum from preds", "preds")
def p13_probability_contract(spark, d):
    p = preds(spark, d)
    broken = p.withColumns({"p_draw": F.when(F.col("p_draw") > 0.3, -F.col("p_draw")).when(F.col("p_draw") > 0.2, F.col("p_draw") + 0.01).otherwise(F.col("p_draw"))})
    return K.probability_report(broken)


@query("select match_id, round(greatest(least(p_team2_win * 2, 1), 1e-12) / s, 6) as p_team2_win, round(p_draw / s, 6) as p_draw, round(p_team1_win / s, 6) as p_team1_win from (select *, greatest(least(p_team2_win * 2, 1), 1e-12) + p_draw + p_team1_win as s from preds)", "preds")
def p14_normalise(spark, d):
    p = preds(spark, d).withColumn("p_team2_win", F.col("p_team2_win") * 2)
    return rounded(p.select("match_id", *C.normalised()))


CATEGORY_SQL = """case when lower(tournament) like '%friendly%' then 'friendly' when lower(tournament) like '%nations league%' then 'nations_league'
 when lower(tournament) like '%qualif%' and lower(tournament) like '%world cup%' then 'world_cup_qualifier' when lower(tournament) like '%qualif%' then 'continental_qualifier'
 when lower(tournament) like '%world cup%' then 'world_cup' when lower(tournament) like '%copa am%' then 'continental_final' else 'other' end"""
IMPORTANCE_SQL = "case tournament when 'FIFA World Cup' then 2.0 when 'FIFA World Cup qualification' then 2.0 when 'UEFA Nations League' then 1.0 when 'Copa America' then 1.5 else 0.5 end"


@query(f"select match_id, {CATEGORY_SQL} as category, cast({CATEGORY_SQL} = 'friendly' as int) as is_friendly from matches", "matches")
def p15_category(spark, d):
    return matches(spark, d).select("match_id", C.category().alias("category"), (C.category() == "friendly").cast("int").alias("is_friendly"))


@query(f"select match_id, cast({IMPORTANCE_SQL} as double) as importance from matches", "matches")
def p16_importance(spark, d):
    return matches(spark, d).select("match_id", C.importance().alias("importance"))


@query("""select match_id, round((year(kickoff_utc) + (dayofyear(kickoff_utc) - 1) / 365.25 - 2000.0) / 10.0, 6) as calendar_year_scaled, round(sin(2 * pi() * month(kickoff_utc) / 12.0), 6) + 0.0 as month_sin,
 round(cos(2 * pi() * month(kickoff_utc) / 12.0), 6) + 0.0 as month_cos, round(elo_gap / 400, 6) as elo_diff_scaled, round(power(elo_gap / 400, 2), 6) as elo_diff_squared, round(power(elo_gap / 400, 3), 6) as elo_diff_cubic,
 round(case when neutral then elo_gap / 400 else 0 end, 6) as elo_diff_neutral_interaction from preds""", "preds")
def p17_advanced_context(spark, d):
    from ..operators.context import advanced_context

    p = preds(spark, d).withColumns({"elo_diff_pre": F.col("elo_gap"), "tournament": F.lit("Friendly")})
    cols = ["calendar_year_scaled", "month_sin", "month_cos", "elo_diff_scaled", "elo_diff_squared", "elo_diff_cubic", "elo_diff_neutral_interaction"]
    return rounded(advanced_context(p).select("match_id", *cols))


@query(f"""select match_id, cast(neutral as int) as neutral_int, cast({IMPORTANCE_SQL} as double) as tournament_importance, cast(match_id[-1] in ('1', '3') as int) as host_team1_int, cast(match_id[-1] = '2' as int) as host_team2_int,
cast(substring(team1, 2, 1) = substring(team2, 2, 1) as int) as same_confederation_int from matches""", "matches")
def p18_base_context(spark, d):
    last = F.substring("match_id", -1, 1)
    m = matches(spark, d).withColumns({"host_team": F.when(last.isin("1", "3"), F.col("team1")).when(last == "2", F.col("team2")), "team1_confederation": F.substring("team1", 2, 1), "team2_confederation": F.substring("team2", 2, 1)})
    return base_context(m).select("match_id", "neutral_int", "tournament_importance", "host_team1_int", "host_team2_int", "same_confederation_int")


@query()
def p20_feature_columns(spark, d):
    """Feature sets of the whole table, by name rules over its schema (the rows say which column is in which set)."""
    from .features import feature_table

    m = stored(spark, d, "matches")
    wide = feature_table(m, advanced=True)
    rows = [(s, c) for s in ("default", "compact", "advanced") for c in feature_columns(wide, s)]
    return spark.createDataFrame(rows, "feature_set string, column string").join(m.agg(F.count(F.lit(1)).alias("n_rows")))


@query("""select match_id, round((1/(1+b/a+c/a)) , 6) as p_team2_win from (select match_id, p_team2_win a, p_draw b, p_team1_win c from preds)""", "preds")
def p21_odds(spark, d):
    p = preds(spark, d)
    odds = [1.05 / F.col(c) for c in C.PROBABILITIES]
    return rounded(p.select("match_id", K.implied_probabilities([F.greatest(o, F.lit(1.0000001)) for o in odds])[0].alias("p_team2_win")))


@query("""select match_id, round(w / avg(w) over (), 6) as weight from (select match_id, exp(-ln(2) / 8 * greatest(0, (epoch_us(timestamp '2001-01-01') - epoch_us(kickoff_utc)) / 1e6 / 86400 / 365.25)) as w from matches)""", "matches")
def p22_recency(spark, d):
    return rounded(K.recency_weights(matches(spark, d), "2001-01-01", 8.0).select("match_id", "weight"))


@query("""select match_id, case when greatest(p_team2_win, p_draw, p_team1_win) >= 0.5 then case greatest(p_team2_win, p_draw, p_team1_win) when p_team2_win then 0 when p_draw then 1 else 2 end end as pick from preds""", "preds")
def p23_selective_pick(spark, d):
    return preds(spark, d).select("match_id", K.confident_pick(0.5).alias("pick"))


@query("""select p.match_id, team1, team2, round(p_team2_win, 6) as p_team2_win, round(p_draw, 6) as p_draw, round(p_team1_win, 6) as p_team1_win,
case when greatest(p_team2_win, p_draw, p_team1_win) < 0.5 then 'abstain' else 'pick' end as policy from preds p join matches m on p.match_id = m.match_id""", "preds", "matches")
def p24_prediction_table(spark, d):
    p = preds(spark, d).withColumn("policy", F.when(K.confident_pick(0.5).isNull(), "abstain").otherwise("pick"))
    return rounded(matches(spark, d).select("match_id", "team1", "team2").join(p.select("match_id", *C.PROBABILITIES, "policy"), "match_id"))


@query(STATUS_SQL + """ select count(*) as n_input, count(*) filter (where status = 'kept') as n_kept, count(*) filter (where status = 'incomplete') as n_incomplete, count(*) filter (where status = 'pre-start') as n_pre_start,
 count(*) filter (where status = 'after cutoff') as n_after_cutoff, count(*) filter (where status = 'duplicate') as n_duplicate, count(*) filter (where status = 'ambiguous') as n_ambiguous,
 min(case when status = 'kept' then date end) as first_day, max(case when status = 'kept' then date end) as last_day,
 (select count(distinct t) from (select home_team t from final where status = 'kept' union all select away_team from final where status = 'kept')) as n_teams from final""")
def a1_preparation_audit(spark, d):
    return K.preparation_audit(statuses(spark, d))


@query("select count(*) as n_rows, epoch_us(min(kickoff_utc)) as first_k, epoch_us(max(kickoff_utc)) as last_k, (select string_agg(distinct t, ',' order by t) from (select left(tournament, 4) t from matches)) as versions from matches", "matches")
def a2_manifest(spark, d):
    m = matches(spark, d).withColumn("source_version", F.left("tournament", F.lit(4)))
    return K.manifest(m).select("n_rows", C.micros("first_kickoff").alias("first_k"), C.micros("last_kickoff").alias("last_k"), F.array_join("source_versions", ",").alias("versions"))


@query()
def a24_fingerprint(spark, d):
    return K.fingerprint(matches(spark, d))


# --- joins of entities, sets, sorting

@query(f"""with {RESULTS_SQL} select 2 * count(*) as total_values, count(*) filter (where trim(home_team) <> n_name) as alias_matches, '' as unresolved from results""")
def j10_name_report(spark, d):
    return N.name_report(results_raw(spark, d), aliases(spark, d), ["home_team", "away_team"]).select("total_values", "alias_matches", F.array_join("unresolved", ",").alias("unresolved"))


@query("select name, count(*) as n from (select concat('customer ', cast(c_custkey % 50 as varchar(20))) as name from customer union all select n_name from nation) where name not in (select n_name from nation) group by name")
def j10_unresolved_names(spark, d):
    """Names that no alias knows, as rows, however many there are."""
    label = F.concat(F.lit(" customer "), (F.col("c_custkey") % 50).cast("string"))
    names = table(spark, d, "customer").select(label.alias("name")).unionByName(table(spark, d, "nation").select(F.lower("n_name").alias("name")))
    return N.unresolved_names(names, aliases(spark, d), ["name"])


@query("""with o as (select match_id, team1 as t from matches where cast(substring(match_id, 2) as bigint) % 7 <> 0), m as (select match_id, case when cast(substring(match_id, 2) as bigint) % 5 = 0 then team2 else team1 end as t from matches where cast(substring(match_id, 2) as bigint) % 11 <> 0)
select coalesce(m.match_id, o.match_id) as match_id, case when m.match_id is null or o.match_id is null then 'match_id' else 'team1' end as field, case when m.match_id is null or o.match_id is null then null else m.t end as mirror,
 case when m.match_id is null or o.match_id is null then null else o.t end as official, case when m.match_id is null then 'right_only' when o.match_id is null then 'left_only' else 'mismatch' end as status
from m full join o on m.match_id = o.match_id where m.match_id is null or o.match_id is null or m.t is distinct from o.t""", "matches")
def j5_reconcile(spark, d):
    m, k = matches(spark, d), F.substring("match_id", 2, 20).cast("long")
    mirror = m.where(k % 11 != 0).withColumn("team1", F.when(k % 5 == 0, F.col("team2")).otherwise(F.col("team1")))
    return R.reconcile(mirror, m.where(k % 7 != 0), ["kickoff_utc", "team1", "team2"])


@query("""with o as (select match_id, team1 as t from matches where cast(substring(match_id, 2) as bigint) % 997 <> 0), m as (select match_id, case when cast(substring(match_id, 2) as bigint) % 1009 = 0 then team2 else team1 end as t from matches)
select coalesce(m.match_id, o.match_id) as match_id, case when o.match_id is null then 'match_id' else 'team1' end as field, case when o.match_id is null then null else m.t end as mirror, case when o.match_id is null then null else o.t end as official,
 case when o.match_id is null then 'left_only' else 'mismatch' end as status from m left join o on m.match_id = o.match_id where o.match_id is null or m.t is distinct from o.t""", "matches")
def j5_reconcile_ranges(spark, d):
    """Two tables that differ in about one row in 500: only the hash ranges that differ are joined."""
    m, k = matches(spark, d), F.substring("match_id", 2, 20).cast("long")
    mirror = m.withColumn("team1", F.when(k % 1009 == 0, F.col("team2")).otherwise(F.col("team1")))
    return R.reconcile_ranges(mirror, m.where(k % 997 != 0), ["kickoff_utc", "team1", "team2"])


@query(STATUS_SQL + " select date, home_team, away_team, count(*) as n from final where status = 'ambiguous' group by all")
def j6_ambiguous(spark, d):
    return statuses(spark, d).where("status = 'ambiguous'").groupBy("date", "home_team", "away_team").agg(F.count(F.lit(1)).alias("n"))


@query("select match_id, tournament, s_acctbal from matches left join supplier on team1 = concat('S', cast(s_suppkey as varchar)) where team2 in (select concat('S', cast(s_suppkey as varchar)) from supplier where s_nationkey < 12)", "matches")
def j13_semi_and_context(spark, d):
    s = table(spark, d, "supplier").withColumn("team", F.concat(F.lit("S"), "s_suppkey"))
    kept = matches(spark, d).join(s.where("s_nationkey < 12").select(F.col("team").alias("team2")), "team2", "left_semi")
    return kept.join(s.select(F.col("team").alias("team1"), "s_acctbal"), "team1", "left").select("match_id", "tournament", "s_acctbal")


@query("select distinct team from ratings where team not in (select team1 from matches where team1 is not null and year(kickoff_utc) = 1998)", "ratings", "matches")
def j14_unseen_teams(spark, d):
    seen = matches(spark, d).where(F.year("kickoff_utc") == 1998).select(F.col("team1").alias("team"))
    return view(spark, d, "ratings").select("team").distinct().join(seen, "team", "left_anti")


@query("select match_id, team1 as team, 1 as side from matches union all select match_id, team2, 2 from matches", "matches")
def u1_union_sides(spark, d):
    m = matches(spark, d)
    return m.select("match_id", F.col("team1").alias("team"), F.lit(1).alias("side")).unionByName(m.select("match_id", F.col("team2").alias("team"), F.lit(2).alias("side")))


@query("select team1 as team from matches union select team2 from matches", "matches")
def u2_team_universe(spark, d):
    m = matches(spark, d)
    return m.select(F.col("team1").alias("team")).union(m.select("team2")).distinct()


@query("select team1 as team from matches except select team2 from matches", "matches")
def u3_except(spark, d):
    m = matches(spark, d)
    return m.select(F.col("team1").alias("team")).subtract(m.select("team2"))


@query("select match_id, len(list_intersect([team1, 'S5', 'S7', 'S9'], [team2, 'S7', 'S9', 'S11'])) as n_common from matches", "matches")
def u4_intersect(spark, d):
    m = matches(spark, d)
    left, right = F.array("team1", *map(F.lit, ("S5", "S7", "S9"))), F.array("team2", *map(F.lit, ("S7", "S9", "S11")))
    return m.select("match_id", F.size(F.array_intersect(left, right)).alias("n_common"))


@query("select team1, team2, count(*) as n from matches group by team1, team2 having count(*) > 1", "matches")
def u5_repeated_keys(spark, d):
    return matches(spark, d).groupBy("team1", "team2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select match_id, row_number() over (partition by team1 order by kickoff_utc, match_id) as place from matches", "matches")
def t1_chronological(spark, d):
    return matches(spark, d).select("match_id", F.row_number().over(W.partitionBy("team1").orderBy("kickoff_utc", "match_id")).alias("place"))


@query("select match_id from matches order by kickoff_utc, match_id limit 20", "matches")
def t8_head(spark, d):
    """A sample of the first rows: the limit is the feature."""
    return matches(spark, d).orderBy("kickoff_utc", "match_id").select("match_id").limit(20)


@query(f"""with {RESULTS_SQL} select date, home_team, away_team, home_score, away_score, tournament, neutral, city from (select *, row_number() over (partition by date, home_team, away_team, home_score, away_score, tournament, neutral order by city) as r from results) where r = 1""")
def t9_semantic_dedupe(spark, d):
    key = ["date", "home_team", "away_team", "home_score", "away_score", "tournament", "neutral"]
    w = W.partitionBy(*key).orderBy("city", "country")
    kept = results_raw(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1")
    return kept.select(*(F.col(c).cast("long").alias(c) if c in ("home_score", "away_score") else c for c in key), "city")


@query("select schedule_id, team, fifa_rank, fifa_points, fifa_rated_matches, rank_percentile, points_z from (" + RANKING_SQL.format(where="") + ")", "ratings")
def w15_rank_position(spark, d):
    r = view(spark, d, "ratings")
    ranked = r.select(F.date_format("rating_date", "yyyyMMdd").alias("schedule_id"), "team", F.rank().over(W.partitionBy("rating_date").orderBy(F.desc("points"))).alias("fifa_rank"), F.col("points").alias("fifa_points"), F.col("n_rows").cast("int").alias("fifa_rated_matches"))
    return rounded(rank_position(ranked))
