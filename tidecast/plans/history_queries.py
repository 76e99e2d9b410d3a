"""Queries for as-of joins, history features, squads, scorers and sequential ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import asof as A
from ..operators import history as H
from ..operators import ratings as E
from ..operators.scorers import NAMES, completeness, scorer_features
from ..operators.squads import SQUAD_NUMBERS, snapshot_violations, squad_features, squad_rows
from ..sources.fixtures import stored, view
from .contract_queries import matches
from .features import feature_table, form_and_rating
from .registry import query, rounded

SIDES = """sides as (
  select match_id, 'team1' as side, team1 as team, team2 as opp, epoch_us(kickoff_utc) as k, epoch_us(late_available_at) as a, cast(team1_goals as double) as gf, cast(team2_goals as double) as ga from matches
  union all select match_id, 'team2', team2, team1, epoch_us(kickoff_utc), epoch_us(late_available_at), team2_goals, team1_goals from matches)"""
HIST = f"""{SIDES},
hist as (
  select q.match_id, q.side, q.k, h.match_id as hid, h.side as hside, h.k as hk, h.a as ha, h.gf, h.ga, h.gf - h.ga as gd, row_number() over (partition by q.match_id, q.side order by h.k desc, h.match_id desc, h.side desc) as back
  from sides q join sides h on h.team = q.team and h.k < q.k and h.a < q.k)"""
WIDE = "max(case when s.side = 'team1' then {0} end) as team1_{1}, max(case when s.side = 'team2' then {0} end) as team2_{1}"
LATE = "late_available_at"


def ratings(spark, d):
    return view(spark, d, "ratings")


@query("""select m.match_id, a.points as team1_rating_points, epoch_us(a.rating_date) as team1_at, b.points as team2_rating_points, epoch_us(b.rating_date) as team2_at
from matches m asof left join ratings a on m.team1 = a.team and m.kickoff_utc > a.rating_date asof left join ratings b on m.team2 = b.team and m.kickoff_utc > b.rating_date""", "matches", "ratings")
def j1_ratings_asof(spark, d):
    out = A.ratings_asof(matches(spark, d), ratings(spark, d), ["points"], prefix_name="rating")
    return out.select("match_id", "team1_rating_points", C.micros("team1_rating_available_at").alias("team1_at"), "team2_rating_points", C.micros("team2_rating_available_at").alias("team2_at"))


@query("""select m.match_id, a.points - b.points as r_points_diff, cast(a.n_rows - b.n_rows as bigint) as r_n_rows_diff, a.block as team1_r_block
from matches m asof left join ratings a on m.team1 = a.team and m.kickoff_utc > a.rating_date asof left join ratings b on m.team2 = b.team and m.kickoff_utc > b.rating_date""", "matches", "ratings")
def j2_snapshot_asof(spark, d):
    out = A.ratings_asof(matches(spark, d), ratings(spark, d), ["points", "n_rows", "block"], prefix_name="r", numeric=["points", "n_rows"])
    return out.select("match_id", "r_points_diff", "r_n_rows_diff", "team1_r_block")


RANKED = """ranked as (select team, rating_date, case block when 0 then 'UEFA' when 1 then 'CAF' else 'AFC' end as confederation, rank() over (partition by rating_date order by points desc) as rk, points, n_rows,
  round(1 - (rank() over (partition by rating_date order by points desc) - 1) / greatest(count(*) over (partition by rating_date) - 1, 1), 9) as pct,
  round(coalesce((points - avg(points) over (partition by rating_date)) / nullif(stddev_pop(points) over (partition by rating_date), 0), 0), 9) as z from ratings)"""


def rankings(spark, d):
    from pyspark.sql import Window as W

    conf = F.when(F.col("block") == 0, "UEFA").when(F.col("block") == 1, "CAF").otherwise("AFC")
    r = ratings(spark, d).withColumn("rank", F.rank().over(W.partitionBy("rating_date").orderBy(F.desc("points"))))
    return A.rank_position(r, by="rating_date", rank="rank", points="points").select("team", "rating_date", conf.alias("confederation"), "rank", "points", F.col("n_rows").alias("rated_matches"), F.round("rank_percentile", 9).alias("rank_percentile"), F.round("points_z", 9).alias("points_z"))


RANK_COLS = ["fifa_same_confederation_int", "team1_fifa_confederation_uefa", "fifa_rank_diff_abs", "fifa_points_mean", "fifa_points_z_diff", "fifa_rated_matches_min_log1p", "fifa_snapshot_age_days_max", "team1_fifa_missing_int", "fifa_any_missing_int", "fifa_elo_consensus_diff", "fifa_points_neutral_interaction"]
RANK_SQL = f"""with {RANKED} select m.match_id, cast(coalesce(a.confederation = b.confederation, false) as int) as fifa_same_confederation_int, cast(coalesce(a.confederation = 'UEFA', false) as int) as team1_fifa_confederation_uefa,
 abs(a.rk - b.rk) as fifa_rank_diff_abs, round((a.points + b.points) / 2.0, 6) as fifa_points_mean, round(a.z - b.z, 6) + 0.0 as fifa_points_z_diff,
 round(ln(1 + coalesce(least(a.n_rows, b.n_rows), a.n_rows, b.n_rows)), 6) as fifa_rated_matches_min_log1p,
 round(greatest((epoch_us(m.kickoff_utc) - epoch_us(a.rating_date)) / 86400e6, (epoch_us(m.kickoff_utc) - epoch_us(b.rating_date)) / 86400e6), 6) as fifa_snapshot_age_days_max,
 cast(a.points is null as int) as team1_fifa_missing_int, cast(a.points is null or b.points is null as int) as fifa_any_missing_int, round(a.z - b.z + p.elo_gap / 400, 6) + 0.0 as fifa_elo_consensus_diff,
 round(case when m.neutral then a.z - b.z else (a.z - b.z) * 0 end, 6) + 0.0 as fifa_points_neutral_interaction
from matches m join preds p on p.match_id = m.match_id asof left join ranked a on m.team1 = a.team and m.kickoff_utc > a.rating_date asof left join ranked b on m.team2 = b.team and m.kickoff_utc > b.rating_date"""


@query(RANK_SQL, "matches", "ratings", "preds")
def j3_ranking_features(spark, d):
    elo = view(spark, d, "preds").select("match_id", F.col("elo_gap").alias("elo_diff_pre"))
    m = matches(spark, d).join(elo, "match_id").withColumn("neutral_int", F.col("neutral").cast("int"))
    return rounded(A.ranking_features(m, rankings(spark, d)).select("match_id", *RANK_COLS))


QUERY_P19 = ["fifa_rank_diff_abs", "fifa_points_mean", "fifa_snapshot_age_days_max", "fifa_any_missing_int", "fifa_elo_consensus_diff"]


@query(f"select match_id, {', '.join(QUERY_P19)} from ({RANK_SQL})", "matches", "ratings", "preds")
def p19_ranking_columns(spark, d):
    return j3_ranking_features(spark, d).select("match_id", *QUERY_P19)


SQUAD_SQL = """squad as (
 select snapshot_id, any_value(team) as team, any_value(available_at) as rating_date, count(*) as squad_size, count(*) filter (where availability_status <> 'injured') as available_count,
  count(*) filter (where availability_status = 'injured') as unavailable_count, avg(player_rating) as rating_mean, list_avg(list_sort(list(player_rating), 'DESC')[1:11]) as rating_top11,
  list_avg(list_sort(list(player_rating) filter (where availability_status <> 'injured'), 'DESC')[1:11]) as available_rating_top11,
  sum(case when availability_status <> 'injured' and lineup_status = 'starter' then player_rating end) / nullif(sum(case when availability_status <> 'injured' and lineup_status = 'starter' then 1.0 end), 0) as expected_xi_rating,
  sum(case when expected_minutes > 0 then player_rating * expected_minutes end) / nullif(sum(case when expected_minutes > 0 then expected_minutes end), 0) as expected_minutes_rating,
  avg(age_years) as age_mean, stddev_pop(age_years) as age_std, count(distinct club) as club_diversity, count(*) filter (where lineup_status = 'starter') as official_starter_count,
  count(*) filter (where position = 'GK' and availability_status <> 'injured') as available_gk_count, max(case when position = 'FW' and availability_status <> 'injured' then player_rating end) as fw_rating_top
 from players group by snapshot_id)"""
SQUAD_COLS = ["squad_size", "available_count", "unavailable_count", "club_diversity", "official_starter_count", "available_gk_count"]
SQUAD_NUM = ["rating_mean", "rating_top11", "available_rating_top11", "expected_xi_rating", "expected_minutes_rating", "age_mean", "age_std", "fw_rating_top"]


@query(f"with {SQUAD_SQL} select snapshot_id, team, {', '.join(SQUAD_COLS)}, {', '.join(f'round({c}, 6) as {c}' for c in SQUAD_NUM)}, round(rating_top11 - available_rating_top11, 6) + 0.0 as absence_rating_loss from squad", "players")
def a3_squad_rows(spark, d):
    return rounded(squad_rows(view(spark, d, "players")).select("snapshot_id", "team", *SQUAD_COLS, *SQUAD_NUM, "absence_rating_loss"))


@query("select 'several available_at' as rule, snapshot_id, count(distinct x) as n from (select *, case when player_id in ('P1', 'P2', 'P3') then available_at + interval 1 day else available_at end as x from players) group by snapshot_id having count(distinct x) > 1", "players")
def a4_snapshot_consistency(spark, d):
    moved = F.when(F.col("player_id").isin("P1", "P2", "P3"), F.col("available_at") + F.expr("interval 1 day")).otherwise(F.col("available_at"))
    return snapshot_violations(view(spark, d, "players").withColumn("available_at", moved)).where("rule = 'several available_at'")


@query("select team, count(*) as n_rows, round(avg(cast(player_rating > 40 as int)), 6) as rating_known, count(distinct player_id) as n_players, round(avg(cast(availability_status <> 'injured' as int)), 6) as available_share from players group by team", "players")
def a5_coverage(spark, d):
    known = F.when(F.col("player_rating") > 40, F.col("player_rating"))
    return rounded(view(spark, d, "players").groupBy("team").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(known.isNotNull().cast("double")).alias("rating_known"), F.count_distinct("player_id").alias("n_players"), F.avg((F.col("availability_status") != "injured").cast("double")).alias("available_share")
    ))


@query(f"""with {SQUAD_SQL} select m.match_id, cast(a.squad_size as bigint) as team1_player_squad_size, round(a.rating_top11 - b.rating_top11, 6) + 0.0 as player_rating_top11_diff, a.available_count - b.available_count as player_available_count_diff,
 cast(a.squad_size is null as int) as team1_player_missing_int, round((epoch_us(m.kickoff_utc) - epoch_us(b.rating_date)) / 86400e6, 6) as team2_player_snapshot_age_days
from matches m asof left join squad a on m.team1 = a.team and m.kickoff_utc > a.rating_date asof left join squad b on m.team2 = b.team and m.kickoff_utc > b.rating_date""", "matches", "players")
def j4_squad_asof(spark, d):
    out = squad_features(matches(spark, d), view(spark, d, "players"), SQUAD_NUMBERS)
    return rounded(out.select("match_id", "team1_player_squad_size", "player_rating_top11_diff", "player_available_count_diff", "team1_player_missing_int", "team2_player_snapshot_age_days"))


@query(f"with {SQUAD_SQL} select snapshot_id, round(rating_top11, 6) as rating_top11, round(available_rating_top11, 6) as available_rating_top11, round(fw_rating_top, 6) as fw_rating_top from squad", "players")
def t4_top_means(spark, d):
    return rounded(squad_rows(view(spark, d, "players")).select("snapshot_id", "rating_top11", "available_rating_top11", "fw_rating_top"))


SCORERS = """known as (select match_id, epoch_us(kickoff_utc) as e, epoch_us(late_available_at) as known, team1, team2, team1_goals + team2_goals as goals, cast(kickoff_utc as date) as day from matches),
asked as (select match_id, 'team1' as side, team1 as team, epoch_us(kickoff_utc) as k from matches union all select match_id, 'team2', team2, epoch_us(kickoff_utc) from matches),
ev as (select g.team, g.scorer, cast(g.penalty as int) as pen, n.e, n.known from goals g join known n on n.match_id = g.match_id where not g.own_goal),
hit as (select q.match_id, q.side, scorer, pen, power(0.5, (q.k - v.e) / 86400e6 / 365) as w from asked q join ev v on v.team = q.team and v.e < q.k and v.known < q.k and v.e >= q.k - 63115200000000),
pl as (select match_id, side, scorer, sum(w) as w, sum(w * pen) as p from hit group by all),
th as (select match_id, side, count(*) as active_players, sum(w) as goals_decay, max(w) as top1_goals_decay, list_sum(list_sort(list(w), 'DESC')[1:3]) / sum(w) as top3_share, sum(w * w) / (sum(w) * sum(w)) as hhi, sum(p) / sum(w) as penalty_share from pl group by all),
evn as (select cast(kickoff_utc as date) as day, team1, team2, count(*) as n from goals group by all),
cm as (select n.match_id, n.e, n.known, n.team1, n.team2, coalesce(v.n, 0) = n.goals as complete, coalesce(v.n, 0) as n_events from known n left join evn v on v.day = n.day and v.team1 = n.team1 and v.team2 = n.team2),
past as (select q.match_id, q.side, count(*) filter (where complete) as complete_matches, count(*) as history_matches from asked q join (select team1 as team, * from cm union all select team2, * from cm) c on c.team = q.team and c.e < q.k and c.known < q.k and c.e >= q.k - 63115200000000 group by all),
lng as (select q.match_id, q.side, coalesce(active_players, 0) as active_players, coalesce(goals_decay, 0) as goals_decay, coalesce(top1_goals_decay, 0) as top1_goals_decay, coalesce(top3_share, 0) as top3_share, coalesce(hhi, 0) as hhi,
 coalesce(penalty_share, 0) as penalty_share, coalesce(complete_matches, 0) as complete_matches, coalesce(history_matches, 0) as history_matches, coalesce(complete_matches / history_matches, 0) as coverage
 from asked q left join th on th.match_id = q.match_id and th.side = q.side left join past on past.match_id = q.match_id and past.side = q.side)"""


@query("with " + SCORERS + " select match_id, complete, n_events from cm", "matches", "goals")
def j8_event_completeness(spark, d):
    return completeness(matches(spark, d), view(spark, d, "goals"))


@query("with " + SCORERS + " select match_id, side, count(*) as n_goals, round(sum(w), 6) as decayed from hit group by all", "matches", "goals")
def j7_interval_join(spark, d):
    from ..operators.scorers import in_window

    m = matches(spark, d)
    asked = A.both_sides(m).select("match_id", "side", "team", C.micros("kickoff_utc").alias("k"))
    known = m.select("match_id", C.micros("kickoff_utc").alias("e"), C.micros(LATE).alias("known"))
    events = view(spark, d, "goals").where(~F.col("own_goal")).select("match_id", "team", "scorer", F.lit(0).alias("penalty")).join(known, "match_id").drop("match_id")
    none = events.select("team", "e", "known", F.lit(True).alias("complete")).limit(0)
    return rounded(in_window(asked, events, none, 730.5, 365.0).where("n_goals > 0").select("match_id", "side", "n_goals", F.col("goals_decay").alias("decayed")))


@query("with " + SCORERS + " select match_id, " + ", ".join(f"round(max(case when side = '{s}' then {n} end), 6) + 0.0 as {s}_scorer_{n}" for s in ("team1", "team2") for n in NAMES) + ", " + ", ".join(f"round(max(case when side = 'team1' then {n} end) - max(case when side = 'team2' then {n} end), 6) + 0.0 as scorer_{n}_diff" for n in NAMES) + " from lng group by match_id", "matches", "goals")
def w10_scorer_features(spark, d):
    return rounded(scorer_features(stored(spark, d, "matches"), view(spark, d, "goals"), available_col=LATE))


def rows(spark, d):
    return H.team_rows(stored(spark, d, "matches"), LATE)


LAST = ["goals_for", "goals_against", "goal_diff", "win", "draw", "clean_sheet", "failed_to_score"]
LAST_EXPR = {"goals_for": "gf", "goals_against": "ga", "goal_diff": "gd", "win": "cast(gd > 0 as int)", "draw": "cast(gd = 0 as int)", "clean_sheet": "cast(ga = 0 as int)", "failed_to_score": "cast(gf = 0 as int)"}


@query(f"with {HIST} select s.match_id, s.side, " + ", ".join(f"round(x.{n}_roll{w}, 6) + 0.0 as {n}_roll{w}" for w in (5, 10) for n in LAST) + " from sides s left join (select match_id, side, " + ", ".join(f"avg({e}) filter (where back <= {w}) as {n}_roll{w}" for w in (5, 10) for n, e in LAST_EXPR.items()) + " from hist group by all) x on x.match_id = s.match_id and x.side = s.side", "matches")
def w1_last_means(spark, d):
    return rounded(H.last_means(rows(spark, d), [5, 10], LAST))


DECAY = "power(0.5, (k - hk) / 86400e6 / 365)"


@query(f"with {HIST} select s.match_id, s.side, " + ", ".join(f"round(x.{n}_ewm, 6) + 0.0 as {n}_ewm" for n in LAST) + " from sides s left join (select match_id, side, " + ", ".join(f"sum({DECAY} * {e}) / sum({DECAY}) as {n}_ewm" for n, e in LAST_EXPR.items()) + " from hist group by all) x on x.match_id = s.match_id and x.side = s.side", "matches")
def w2_decayed_means(spark, d):
    return rounded(H.decayed_means(rows(spark, d), LAST))


def streak_sql(name: str, breaks: str) -> str:
    return f"coalesce(min(case when {breaks} then back end) - 1, count(*)) as {name}"


@query(f"with {HIST} select s.match_id, s.side, cast(coalesce(win_streak, 0) as double) as win_streak, cast(coalesce(loss_streak, 0) as double) as loss_streak, cast(coalesce(unbeaten_streak, 0) as double) as unbeaten_streak from sides s left join (select match_id, side, " + ", ".join((streak_sql("win_streak", "gd <= 0"), streak_sql("loss_streak", "gd >= 0"), streak_sql("unbeaten_streak", "gd < 0"))) + " from hist group by all) x on x.match_id = s.match_id and x.side = s.side", "matches")
def w3_streaks(spark, d):
    return H.streaks(rows(spark, d))


RECENT_SQL = f"with {HIST} select s.match_id, s.side, {{}} from sides s left join (select match_id, side, max(hk) as hk, max(ha) as ha from hist group by all) x on x.match_id = s.match_id and x.side = s.side"


@query(RECENT_SQL.format("round((s.k - hk) / 86400e6, 6) as days_rest"), "matches")
def w4_days_rest(spark, d):
    return rounded(H.recency(rows(spark, d)).select("match_id", "side", "days_rest"))


@query(RECENT_SQL.format("ha as history_at"), "matches")
def w5_history_time(spark, d):
    return H.recency(rows(spark, d)).select("match_id", "side", C.micros("history_available_at").alias("history_at"))


W6_SQL = f"with {HIST}, x as (select match_id, side, max(k) - max(hk) as rest, avg(gf) filter (where back <= 5) as r5 from hist group by all) select m.match_id, round((a.rest - b.rest) / 86400e6, 6) + 0.0 as days_rest_diff, round(a.r5 - b.r5, 6) + 0.0 as goals_for_roll5_diff from matches m left join x a on a.match_id = m.match_id and a.side = 'team1' left join x b on b.match_id = m.match_id and b.side = 'team2'"


@query(W6_SQL, "matches")
def w6_side_differences(spark, d):
    return rounded(H.rolling_features(stored(spark, d, "matches"), [5], available_col=LATE).select("match_id", "days_rest_diff", "goals_for_roll5_diff"))


@query("""select match_id, 'team1' as side, team1 as team, round(team1_goals - team2_goals + (1500 + elo_gap - 1500) / 400, 6) + 0.0 as adjusted from (select m.*, elo_gap from matches m join preds p on p.match_id = m.match_id)
union all select match_id, 'team2', team2, round(team2_goals - team1_goals + 0.0, 6) + 0.0 from matches""", "matches", "preds")
def w7_team_rows(spark, d):
    elo = view(spark, d, "preds").select("match_id", (F.lit(1500.0) + F.col("elo_gap")).alias("e2"), F.lit(None).cast("double").alias("e1"))
    out = H.team_rows(matches(spark, d).join(elo, "match_id"), elo=("e1", "e2"))
    return rounded(out.select("match_id", "side", "team", F.col("opponent_adjusted_goal_diff").alias("adjusted")))


@query(f"with {HIST}, c as (select s.match_id, s.side, count(h.hid) as n from sides s left join hist h on h.match_id = s.match_id and h.side = s.side group by all) select m.match_id, a.n as team1_prior_matches, b.n as team2_prior_matches, least(a.n, b.n) as prior_matches_min, a.n - b.n as prior_matches_diff, round(ln(1 + a.n), 6) as team1_prior_matches_log1p, round(ln(1 + b.n), 6) as team2_prior_matches_log1p from matches m join c a on a.match_id = m.match_id and a.side = 'team1' join c b on b.match_id = m.match_id and b.side = 'team2'", "matches")
def w8_prior_counts(spark, d):
    return rounded(H.prior_counts(matches(spark, d), LATE))


@query(f"with {SIDES}, n as (select q.match_id, q.side, count(h.team) as n_before from sides q left join sides h on h.team = q.team and h.k < q.k and h.a < q.k group by all) select match_id, side, n_before from n", "matches")
def j11_history_join(spark, d):
    r = rows(spark, d)
    return A.prefix(r.select("match_id", "side", "team", "k"), r, ["team"], F.col("k"), H.known_from(), sums={"n_before": F.lit(1).cast("long")}).select("match_id", "side", "n_before")


@query("select match_id, team1 as team1_team, team1_goals as team1_gf, team2 as team2_team, team2_goals as team2_gf from matches", "matches")
def j9_long_to_wide(spark, d):
    from ..operators.contracts import sides

    long = sides(matches(spark, d), "match_id")
    return A.widen(long, ["team", "gf"])


H2H_SQL = """with mm as (select match_id, team1 <= team2 as f, least(team1, team2) as p, greatest(team1, team2) as q, epoch_us(kickoff_utc) as k, epoch_us(late_available_at) as a,
  case when team1 <= team2 then team1_goals else team2_goals end as g1, case when team1 <= team2 then team2_goals else team1_goals end as g2 from matches),
x as (select n.match_id, count(*) as c, avg(cast(h.g1 > h.g2 as int)) as w1, avg(cast(h.g2 > h.g1 as int)) as w2, avg(h.g1) as s1, avg(h.g2) as s2, arg_max(sign(h.g1 - h.g2), struct_pack(k := h.k, i := h.match_id)) as o
  from mm n join mm h on h.p = n.p and h.q = n.q and h.k < n.k and h.a < n.k group by n.match_id)
select mm.match_id, cast(coalesce(c, 0) as double) as h2h_total_matches, round(coalesce(case when f then w1 else w2 end, 0), 6) as h2h_team1_win_pct, round(coalesce(case when f then w2 else w1 end, 0), 6) as h2h_team2_win_pct,
 round(coalesce(case when f then s1 else s2 end, 0), 6) as h2h_team1_goals_mean, round(coalesce(case when f then s2 else s1 end, 0), 6) as h2h_team2_goals_mean, cast(coalesce(case when f then o else -o end, 0) as double) + 0.0 as h2h_last_outcome
from mm left join x on x.match_id = mm.match_id"""


@query(H2H_SQL, "matches")
def w9_head_to_head(spark, d):
    return rounded(H.head_to_head(matches(spark, d), LATE))


@query("""with e as (select epoch_us(kickoff_utc) as k, epoch_us(late_available_at) as a, team1_goals + team2_goals as g, match_id from matches),
t as (select a, sum(g) as g, count(*) as n from e group by a), r as (select a, sum(g) over (order by a) as g, sum(n) over (order by a) as n from t)
select e.match_id, round((250 + coalesce(r.g, 0)) / (200 + 2 * coalesce(r.n, 0)), 6) as goals_rate from e asof left join r on e.k > r.a""", "matches")
def w14_global_rate(spark, d):
    return rounded(H.global_rate(matches(spark, d), LATE))


@query()
def w11_elo(spark, d):
    return rounded(E.elo_features(matches(spark, d), windows=(), columns=["elo_team1_pre", "elo_team2_pre", "elo_diff_pre", "elo_exp_team1", "elo_importance"]))


@query()
def w12_elo_momentum(spark, d):
    return rounded(E.elo_features(matches(spark, d), windows=(5, 10), columns=["elo_momentum_roll5_diff", "elo_momentum_roll10_diff"]))


@query()
def w13_online_strengths(spark, d):
    return rounded(E.online_strengths(stored(spark, d, "matches")))


@query()
def w11_pools(spark, d):
    """The pools of all matches. No SQL: the recursive form is too slow on whole tables; tests hold it against union-find."""
    from ..sources.scratch import scratch

    scratch(spark, "pools")  # sets the checkpoint folder
    return E.team_pools(stored(spark, d, "matches"))


@query()
def feature_table_full(spark, d):
    """The whole feature table: every history, rating, ranking, squad, scorer and context column."""
    return rounded(feature_table(stored(spark, d, "matches"), rankings=rankings(spark, d), goals=view(spark, d, "goals"), players=view(spark, d, "players"), advanced=True))


FLAGSHIP = f"""with {SIDES.replace('late_available_at', 'available_at')},
h as (select q.match_id, q.side, h.gf, row_number() over (partition by q.match_id, q.side order by h.k desc, h.match_id desc, h.side desc) as back from sides q join sides h on h.team = q.team and h.k < q.k and h.a < q.k),
f as (select match_id, side, avg(gf) as v from h where back <= 5 group by all)
select m.match_id, m.team1, m.team2, round(x.v, 6) as team1_goals_for_roll5, round(y.v, 6) as team2_goals_for_roll5, a.points as team1_rating_points, b.points as team2_rating_points, a.points - b.points as rating_points_diff, a.rating_date < m.kickoff_utc as team1_prior
from matches m left join f x on x.match_id = m.match_id and x.side = 'team1' left join f y on y.match_id = m.match_id and y.side = 'team2'
asof left join ratings a on m.team1 = a.team and m.kickoff_utc > a.rating_date asof left join ratings b on m.team2 = b.team and m.kickoff_utc > b.rating_date"""


@query(FLAGSHIP, "matches", "ratings")
def flagship_form_and_rating(spark, d):
    return rounded(form_and_rating(stored(spark, d, "matches"), ratings(spark, d)))
