"""Queries for forecast scoring, standings, models, calibration and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import score_matrix as M
from ..operators import scoring as S
from ..operators import search as X
from ..operators import standings as T
from ..operators.calibration import Ensemble, Isotonic, Sigmoid, Temperature, blend_weights
from ..operators.asof import widen
from ..operators.boosting import BoostedClasses
from ..operators.history import short_history, team_rows
from ..operators.models import DixonColes, Multinomial, TwoPoisson, TwoStage, elo_baseline, fit_rho, load_state, save_model
from ..operators.ratings import elo_features
from ..operators.scorers import scorer_features
from ..sources.fixtures import stored, view
from ..sources.scratch import scratch
from .contract_queries import matches, preds
from .registry import query, rounded

P = ["p_team2_win", "p_draw", "p_team1_win"]
ROW = """rows as (select *, case outcome when 0 then p_team2_win when 1 then p_draw else p_team1_win end as py, greatest(p_team2_win, p_draw, p_team1_win) as conf,
 case greatest(p_team2_win, p_draw, p_team1_win) when p_team2_win then 0 when p_draw then 1 else 2 end as pick from preds),
m as (select *, -ln(py) as ll, power(p_team2_win - cast(outcome = 0 as int), 2) + power(p_draw - cast(outcome = 1 as int), 2) + power(p_team1_win - cast(outcome = 2 as int), 2) as br,
 (power(p_team2_win - cast(outcome <= 0 as int), 2) + power(p_team2_win + p_draw - cast(outcome <= 1 as int), 2)) / 2 as rp, cast(pick = outcome as int) as ok, least(floor(conf * 10), 9) as bin from rows)"""
METRICS = "count(*) as n, round(avg(ll), 6) as log_loss, round(avg(br), 6) as brier, round(avg(rp), 6) as rps, round(avg(ok), 6) as accuracy, round(avg(conf), 6) as sharpness"


@query("select (count(*) filter (where outcome = 0) + 1) / (count(*) + 3.0) as p_team2_win, (count(*) filter (where outcome = 1) + 1) / (count(*) + 3.0) as p_draw, (count(*) filter (where outcome = 2) + 1) / (count(*) + 3.0) as p_team1_win from preds", "preds")
def a6_class_prior(spark, d):
    return S.class_prior(preds(spark, d))


@query(f"with {ROW} select yr, round(avg(ll), 6) as log_loss from m group by yr", "preds")
def a7_log_loss(spark, d):
    return rounded(preds(spark, d).groupBy("yr").agg(F.avg(S.log_loss()).alias("log_loss")))


@query(f"with {ROW} select yr, round(avg(br), 6) as brier from m group by yr", "preds")
def a8_brier(spark, d):
    return rounded(preds(spark, d).groupBy("yr").agg(F.avg(S.brier()).alias("brier")))


@query(f"with {ROW} select yr, round(avg(rp), 6) as rps from m group by yr", "preds")
def a9_ranked_probability(spark, d):
    return rounded(preds(spark, d).groupBy("yr").agg(F.avg(S.ranked_probability()).alias("rps")))


@query(f"with {ROW} select yr, round(avg(ok), 6) as accuracy from m group by yr", "preds")
def a10_accuracy(spark, d):
    return rounded(preds(spark, d).groupBy("yr").agg(F.avg(S.correct()).alias("accuracy")))


@query(f"with {ROW}, b as (select yr, bin, abs(sum(conf) - sum(ok)) as gap, count(*) as n from m group by all) select yr, round(sum(gap) / sum(n), 6) as ece from b group by yr", "preds")
def a11_calibration_error(spark, d):
    return rounded(S.calibration_error(preds(spark, d), ["yr"]))


@query(f"with {ROW} select yr, round(avg(conf), 6) as sharpness from m group by yr", "preds")
def a12_sharpness(spark, d):
    return rounded(preds(spark, d).groupBy("yr").agg(F.avg(S.confidence()).alias("sharpness")))


@query(f"with {ROW}, e as (select yr, neutral, sum(gap) / sum(n) as ece from (select yr, neutral, bin, abs(sum(conf) - sum(ok)) as gap, count(*) as n from m group by all) group by all) select a.*, round(ece, 6) as ece from (select yr, neutral, {METRICS} from m group by all) a join e on a.yr = e.yr and a.neutral = e.neutral", "preds")
def a13_metric_bundle(spark, d):
    return rounded(S.evaluate(preds(spark, d), ["yr", "neutral"]))


SLICES = "unnest(list_filter(['overall', case when neutral then 'neutral' else 'non_neutral' end, case when elo_gap < 100 then 'low_elo_gap' end, case when elo_gap >= 200 then 'high_elo_gap' end, case when outcome = 1 then 'draws' end], lambda x: x is not null)) as slice"


@query(f"with {ROW}, s as (select *, {SLICES} from m) select slice, {METRICS} from s group by slice", "preds")
def a14_slices(spark, d):
    return rounded(S.evaluate(S.slices(preds(spark, d)), ["slice"]).drop("ece"))


@query(f"""with {ROW}, v as (select *, case when elo_gap = 0 then null when elo_gap <= 50 then '0-50' when elo_gap <= 150 then '50-150' when elo_gap <= 300 then '150-300' else '300+' end as gap from m)
select 'neutral' as dimension, cast(neutral as varchar) as value, count(*) as n, round(avg(ll), 6) as log_loss, round(avg(br), 6) as brier, round(avg(ok), 6) as accuracy from v group by neutral
union all select 'gap', gap, count(*), round(avg(ll), 6), round(avg(br), 6), round(avg(ok), 6) from v where gap is not null group by gap""", "preds")
def a15_slices_by_value(spark, d):
    return rounded(S.sliced_by_value(preds(spark, d), {"neutral": F.col("neutral"), "gap": S.gap_bucket()}))


@query("""with l as (select unnest([struct_pack(c := 0, p := p_team2_win), struct_pack(c := 1, p := p_draw), struct_pack(c := 2, p := p_team1_win)]) as x, outcome from preds)
select x.c as class, cast(least(floor(x.p * 10), 9) as int) as bin, count(*) as n, round(avg(x.p), 6) as mean_predicted, round(avg(cast(outcome = x.c as int)), 6) as empirical_rate,
 round(least(floor(x.p * 10), 9) / 10, 6) as p_min, round((least(floor(x.p * 10), 9) + 1) / 10, 6) as p_max from l group by x.c, least(floor(x.p * 10), 9)""", "preds")
def a16_reliability(spark, d):
    return rounded(S.reliability(preds(spark, d)))


SELECTIVE = "count(*) as n, cast(sum(cast(conf >= 0.5 as int)) as bigint) as n_selected, round(avg(cast(conf >= 0.5 as int)), 6) as coverage, round(avg(case when conf >= 0.5 then ok end), 6) as selected_accuracy, round(avg(ok), 6) as full_accuracy"


@query(f"with {ROW} select yr, {SELECTIVE} from m group by yr union all select null, {SELECTIVE} from m", "preds")
def a17_selective(spark, d):
    return rounded(S.selective(preds(spark, d), 0.5))


@query(f"""with {ROW}, t as (select 0.4 + 0.01 * i as thr from range(41) r(i)), g as (select distinct yr from m),
c as (select round(thr, 2) as thr, g.yr, count(m.yr) as n, coalesce(avg(ok), 0) as acc from t cross join g left join m on m.yr = g.yr and m.conf >= round(cast(thr as double), 2) group by all)
select min(thr) as threshold from (select cast(thr as double) as thr, bool_and(n >= 20 and acc >= 0.3) as good from c group by thr) where good""", "preds")
def a18_stable_threshold(spark, d):
    return S.stable_threshold(preds(spark, d), target=0.3, least=20)


def candidate_log(spark: SparkSession, d: str) -> DataFrame:
    """Three candidates: the log's triple, the triple turned around, and one that leans to draws."""
    p = preds(spark, d)
    a, b, c = P
    turned = p.withColumns({a: F.col(c), c: F.col(a)})
    flat = p.withColumns({x: (F.col(x) + 1) / 4 for x in P})
    tag = lambda df, n: df.withColumn("candidate", F.lit(n))
    return tag(p, "plain").unionByName(tag(turned, "turned")).unionByName(tag(flat, "flat"))


CANDIDATES = """logs as (select 'plain' as candidate, * from preds union all select 'turned', match_id, kickoff_utc, outcome, yr, neutral, p_team1_win, p_draw, p_team2_win, elo_gap from preds
 union all select 'flat', match_id, kickoff_utc, outcome, yr, neutral, (p_team2_win + 1) / 4, (p_draw + 1) / 4, (p_team1_win + 1) / 4, elo_gap from preds)"""
CAND_ROW = CANDIDATES + ",\n" + ROW.replace("from preds)", "from logs)")


@query(f"with {CAND_ROW}, f as (select candidate, yr, avg(ll) as ll from m group by all) select a.*, round(s.sd, 6) as log_loss_std, s.folds from (select candidate, {METRICS} from m group by candidate) a join (select candidate, stddev_pop(ll) as sd, count(*) as folds from f group by candidate) s on s.candidate = a.candidate", "preds")
def a19_pooled_candidates(spark, d):
    return rounded(S.pooled_candidates(candidate_log(spark, d)).drop("ece"))


@query(f"with {CAND_ROW} select candidate, round(avg(ll), 6) as log_loss from m group by candidate order by avg(ll), avg(br), avg(rp) limit 1", "preds")
def t2_best_candidate(spark, d):
    return rounded(S.evaluate(candidate_log(spark, d), ["candidate"]).orderBy("log_loss", "brier", "rps").limit(1).select("candidate", "log_loss"))


@query(f"with {CAND_ROW}, e as (select yr, candidate, avg(ll) as ll, avg(br) as br, avg(rp) as rp from m group by all) select yr, candidate, round(ll, 6) as log_loss from (select *, row_number() over (partition by yr order by ll, br, rp, candidate) as r from e) where r = 1", "preds")
def t3_best_per_group(spark, d):
    w = W.partitionBy("yr").orderBy("log_loss", "brier", "rps", "candidate")
    best = S.evaluate(candidate_log(spark, d), ["yr", "candidate"]).withColumn("r", F.row_number().over(w)).where("r = 1")
    return rounded(best.select("yr", "candidate", "log_loss"))


@query(f"with {CAND_ROW}, e as (select candidate, case when yr < 1999 then 'validation' else 'holdout' end as split, avg(ll) as ll, avg(br) as br, avg(rp) as rp from m group by all) select e.candidate as model, bool_and(e.ll <= b.ll * 0.99 and e.br <= b.br * 1.01 and e.rp <= b.rp * 1.01) as promoted, count(*) as splits from e join e b on b.split = e.split and b.candidate = 'turned' where e.candidate <> 'turned' group by e.candidate", "preds")
def m20_promotion(spark, d):
    log = candidate_log(spark, d).withColumns({"split": F.when(F.col("yr") < 1999, "validation").otherwise("holdout"), "model": F.col("candidate")})
    return S.promotion(S.evaluate(log, ["model", "split"]), "turned")


@query(f"with {CANDIDATES} select x.yr, x.match_id, round(y.p_draw - x.p_draw, 6) + 0.0 as draw_gap from logs x join logs y on x.yr = y.yr and x.match_id = y.match_id and x.candidate = 'plain' and y.candidate = 'flat'", "preds")
def j15_align_candidates(spark, d):
    log = candidate_log(spark, d)
    one = log.where("candidate = 'plain'").select("yr", "match_id", F.col("p_draw").alias("a"))
    two = log.where("candidate = 'flat'").select("yr", "match_id", F.col("p_draw").alias("b"))
    return rounded(one.join(two, ["yr", "match_id"]).select("yr", "match_id", (F.col("b") - F.col("a")).alias("draw_gap")))


FOLDS_SQL = """folds as (select cast(y as varchar) as fold, make_timestamp(y, 1, 1, 0, 0, 0) as s, make_timestamp(y + 1, 1, 1, 0, 0, 0) as e from range(1997, 2001) r(y))"""


@query(f"with {FOLDS_SQL} select fold, case when kickoff_utc < s then 'train' else 'test' end as role, count(*) as n from matches join folds on kickoff_utc < e group by all", "matches")
def j12_fold_join(spark, d):
    return X.fold_roles(matches(spark, d), X.annual_folds(spark, 1997, 2000)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""select match_id, case when i < floor(n * 0.6) then 'train' when i < floor(n * 0.8) then 'tune' else 'test' end as split from (select match_id, row_number() over (order by kickoff_utc, match_id) - 1 as i, count(*) over () as n from matches)""", "matches")
def t7_chronological_split(spark, d):
    return X.chronological_split(matches(spark, d)).select("match_id", "split")


@query("""with l as (select *, cast(1 + hash_k % 3 as double) / 1.7 as l1, cast(1 + hash_k % 5 as double) / 2.3 as l2 from (select match_id, cast(substring(match_id, 2) as bigint) as hash_k from matches)),
g as (select match_id, i, j, exp(-l1) * power(l1, i) / gamma(i + 1) * exp(-l2) * power(l2, j) / gamma(j + 1) as p from l, range(8) a(i), range(8) b(j))
select match_id, round(sum(p) filter (where i < j) / sum(p), 6) as p_team2_win, round(sum(p) filter (where i = j) / sum(p), 6) as p_draw, round(sum(p) filter (where i > j) / sum(p), 6) as p_team1_win from g group by match_id""", "matches")
def m6_score_matrix(spark, d):
    return rounded(with_matrix(spark, d).select("match_id", *M.outcome_probabilities()))


def with_matrix(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("match_id", 2, 20).cast("long")
    rates = matches(spark, d).select("match_id", ((1 + k % 3) / F.lit(1.7)).alias("l1"), ((1 + k % 5) / F.lit(2.3)).alias("l2"))
    return rates.withColumn("matrix", M.cells("l1", "l2"))


@query("""with l as (select *, cast(1 + hash_k % 3 as double) / 1.7 as l1, cast(1 + hash_k % 5 as double) / 2.3 as l2 from (select match_id, cast(substring(match_id, 2) as bigint) as hash_k from matches)),
g as (select match_id, i, j, exp(-l1) * power(l1, i) / gamma(i + 1) * exp(-l2) * power(l2, j) / gamma(j + 1) as p from l, range(8) a(i), range(8) b(j))
select match_id, round(sum(p * i) / sum(p), 6) as team1_xg, round(sum(p * j) / sum(p), 6) as team2_xg from g group by match_id""", "matches")
def m8_expected_goals(spark, d):
    return rounded(with_matrix(spark, d).select("match_id", *M.expected_goals()))


@query("select match_id, round((0.7 * p_team2_win + 0.3 * p_team1_win), 6) as p_team2_win, round(p_draw, 6) as p_draw, round(0.7 * p_team1_win + 0.3 * p_team2_win, 6) as p_team1_win from preds", "preds")
def m12_blend(spark, d):
    a, b, c = P
    return rounded(preds(spark, d).select("match_id", *S.blend([[a, b, c], [c, b, a]], [0.7, 0.3])))


# --- standings: groups of four suppliers, from their first results

def group_results(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    number = lambda c: F.substring(c, 2, 20).cast("int")
    return m.where(F.floor((number("team1") - 1) / 4) == F.floor((number("team2") - 1) / 4)).select(F.floor((number("team1") - 1) / 4).cast("int").alias("grp"), "team1", "team2", "team1_goals", "team2_goals")


GROUPS = """res as (select cast(floor((cast(substring(team1, 2) as int) - 1) / 4) as int) as grp, team1, team2, team1_goals as g1, team2_goals as g2 from matches where floor((cast(substring(team1, 2) as int) - 1) / 4) = floor((cast(substring(team2, 2) as int) - 1) / 4)),
s as (select grp, team1 as team, team2 as opp, g1 as gf, g2 as ga from res union all select grp, team2, team1, g2, g1 from res),
tab as (select grp, team, sum(case when gf > ga then 3 when gf = ga then 1 else 0 end) as points, sum(gf) as gf, sum(ga) as ga, sum(gf - ga) as gd, count(*) as played from s group by all)"""


@query(f"with {GROUPS} select grp, team, cast(points as bigint) as points, cast(gf as bigint) as gf, cast(ga as bigint) as ga, cast(gd as bigint) as gd, played from tab", "matches")
def a20_standings(spark, d):
    return T.standings(group_results(spark, d))


@query(f"with {GROUPS} select s.grp, s.team, cast(sum(case when s.gf > s.ga then 3 when s.gf = s.ga then 1 else 0 end) as bigint) as m_points, cast(sum(s.gf - s.ga) as bigint) as m_gd, cast(sum(s.gf) as bigint) as m_gf from s join tab a on a.grp = s.grp and a.team = s.team join tab b on b.grp = s.grp and b.team = s.opp and a.points % 7 = b.points % 7 group by all", "matches")
def a21_mini_table(spark, d):
    r = group_results(spark, d)
    return T.mini_table(r, T.standings(r).withColumn("tie", F.col("points") % 7))


@query(f"with {GROUPS}, n as (select count(distinct grp) as n from tab) select team, case when played > 4 then 'many' else 'few' end as stage, round(1.0 / n.n, 6) as p, round(sqrt(1.0 / n.n * (1 - 1.0 / n.n) / n.n), 6) as se from tab, n", "matches")
def a22_outcome_shares(spark, d):
    t = T.standings(group_results(spark, d)).withColumn("stage", F.when(F.col("played") > 4, "many").otherwise("few"))
    return rounded(T.outcome_shares(t, "team", "stage", "grp"))


@query()
def t5_rank_groups(spark, d):
    return T.rank_groups(group_results(spark, d)).select("grp", "team", "points", "gd", "gf", "position")


@query(f"with {GROUPS}, r as (select *, row_number() over (partition by grp order by points desc, gd desc, gf desc, team desc) as position from tab) select grp, team, cast(points as bigint) as points, cast(gd as bigint) as gd from r where position = 3 order by points desc, gd desc, gf desc, grp desc limit 8", "matches")
def t6_best_thirds(spark, d):
    """A top-8 report: the limit is the feature. Positions here are by points, goal difference, goals and name."""
    w = W.partitionBy("grp").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), F.desc("team"))
    ranked = T.standings(group_results(spark, d)).withColumn("position", F.row_number().over(w)).withColumns({"conduct": F.lit(0), "rank": F.lit(None).cast("int")})
    return T.best_thirds(ranked).select("grp", "team", "points", "gd")


@query("""with g as (select distinct substring('ABCDEFGHIJKL', cast(1 + s_suppkey % 12 as int), 1) as grp from supplier where s_suppkey % 12 < 8), k as (select string_agg(grp, '' order by grp) as key from g)
select distinct p_size, k.key as groups from part, k where k.key = 'ABCDEFGH'""")
def j16_allocation(spark, d):
    """Allocation rows keyed by sets of eight groups, one per part size; the groups that came through pick theirs."""
    from ..sources.fixtures import table

    letter = F.substring(F.lit("ABCDEFGHIJKL"), (1 + F.col("s_suppkey") % 12).cast("int"), F.lit(1))
    thirds = table(spark, d, "supplier").where("s_suppkey % 12 < 8").select(letter.alias("grp"))
    sizes = table(spark, d, "part").select("p_size").distinct()
    rows = sizes.select("p_size", F.explode(F.array(F.lit("HGFEDCBA"), F.lit("ABCDEFGI"))).alias("groups"))
    return T.allocate(thirds, rows).select("p_size", F.array_join(F.array_sort(F.split("groups", "")), "").alias("groups"))


# --- models: features of the history, trained before 2000 and scored on 2000

COLUMNS = ["elo_diff_pre", "elo_exp_team1", "neutral_int", "tournament_importance", "days_rest_diff", "goal_diff_ewm_diff", "goals_for_roll5_diff", "win_roll5_diff", "prior_matches_min"]


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Features of all matches, written once per query so that fits read them and not the history again."""
    m = stored(spark, d, "matches").withColumns({"outcome": C.outcome(), "neutral_int": F.col("neutral").cast("int"), "tournament_importance": C.importance()})
    rows = team_rows(m)
    names = ["days_rest", "goal_diff_ewm", "goals_for_roll5", "win_roll5"]
    both = widen(short_history(rows, 5, ["goals_for", "win"], ["goal_diff"]), [*names, "prior_matches"])
    form = both.select("match_id", F.least("team1_prior_matches", "team2_prior_matches").alias("prior_matches_min"), *((F.col(f"team1_{c}") - F.col(f"team2_{c}")).alias(f"{c}_diff") for c in names))
    wide = m.join(elo_features(m, windows=(), columns=["elo_diff_pre", "elo_exp_team1"]), "match_id").join(form, "match_id")
    path = scratch(spark, "model_table")
    wide.select("match_id", F.col("kickoff_utc").cast("timestamp").alias("kickoff_utc"), "outcome", "team1_goals", "team2_goals", *COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = F.lit("2000-01-01").cast("timestamp")
    return rows.where(F.col("kickoff_utc") < last), rows.where(F.col("kickoff_utc") >= last)


def scored(model, spark: SparkSession, d: str) -> DataFrame:
    train, test = parts(model_table(spark, d))
    return rounded(model.fit(train).predict(test).select("match_id", "outcome", *P), 4)


@query()
def m1_multinomial(spark, d):
    return scored(Multinomial(COLUMNS), spark, d)


@query()
def m2_elo_baseline(spark, d):
    return scored(elo_baseline(COLUMNS), spark, d)


@query()
def m3_boosted_trees(spark, d):
    return scored(BoostedClasses(COLUMNS, rounds=20), spark, d)


@query()
def m4_two_stage(spark, d):
    return scored(TwoStage(COLUMNS), spark, d)


@query()
def m5_two_poisson(spark, d):
    return scored(TwoPoisson(COLUMNS), spark, d)


@query()
def m7_dixon_coles(spark, d):
    return scored(DixonColes(COLUMNS), spark, d)


@query()
def m7_rho(spark, d):
    k = F.substring("match_id", 2, 20).cast("long")
    rates = matches(spark, d).select("team1_goals", "team2_goals", ((1 + k % 3) / F.lit(1.7)).alias("lambda1"), ((1 + k % 5) / F.lit(2.3)).alias("lambda2"))
    rho = fit_rho(rates)
    return rates.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("rho", F.lit(rho))


def calibrated(model, spark, d):
    path = scratch(spark, "preds")
    preds(spark, d).select("match_id", "outcome", *P).write.parquet(path)
    p = spark.read.parquet(path)
    return rounded(model.fit(p).transform(p).select("match_id", *P), 4)


@query()
def m9_temperature(spark, d):
    return calibrated(Temperature(), spark, d)


@query()
def m10_sigmoid(spark, d):
    return calibrated(Sigmoid(), spark, d)


@query()
def m11_isotonic(spark, d):
    """Isotonic curves need 1000 rows, and fail on fewer."""
    p = preds(spark, d)
    return rounded(Isotonic().fit(p).transform(p).select("match_id", *P), 4)


@query()
def m13_blend_weights(spark, d):
    p = preds(spark, d)
    flat = p.select("*", *(((F.col(c) + 1) / 4).alias(f"flat_{c}") for c in P))
    w = blend_weights(flat, [P, [f"flat_{c}" for c in P]])
    return p.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(round(w[0], 4)).alias("w_plain"), F.lit(round(w[1], 4)).alias("w_flat"))


@query()
def m14_ensemble(spark, d):
    train, test = parts(model_table(spark, d))
    models = [Multinomial(COLUMNS).fit(train), TwoPoisson(COLUMNS).fit(train)]
    return rounded(Ensemble(models, [0.6, 0.4]).predict(test).select("match_id", "outcome", *P), 4)


@query()
def m15_out_of_fold(spark, d):
    log = X.out_of_fold(model_table(spark, d), X.annual_folds(spark, 1998, 2000), lambda: Multinomial(COLUMNS))
    return rounded(log, 4)


#: Replay windows in the years of the tables.
SUMMERS = {"summer_1998": ("1998-06-10", "1998-07-13"), "summer_2000": ("2000-06-10", "2000-07-03")}
#: Five years of validation; the tables begin in 1995.
YEARS = (1997, 2001)
FEATURE_SETS = {"all": COLUMNS, "form": [c for c in COLUMNS if not c.startswith("elo")]}


def baselines():
    return {"class_prior": X.Prior, "elo_logistic": lambda: elo_baseline(COLUMNS)}


@query()
def m16_backtest(spark, d):
    """Annual folds and the replay of windows."""
    rows = model_table(spark, d)
    models = {"prior": X.Prior, "elo": lambda: elo_baseline(COLUMNS), "logistic": lambda: Multinomial(COLUMNS), "poisson": lambda: TwoPoisson(COLUMNS), "two_stage": lambda: TwoStage(COLUMNS)}
    folds = X.annual_folds(spark, 1999, 2000).unionByName(X.window_folds(spark, SUMMERS))
    return rounded(S.evaluate(X.grid_log(rows, folds, models), ["candidate", "fold"]), 4)


@query()
def m17_rolling_search(spark, d):
    """The whole grid of penalties and half-lives over two feature sets and five years, with both baselines."""
    grid = X.grid(FEATURE_SETS, kinds=["logistic"], cs=X.CS, half_lives=X.HALF_LIVES)
    return rounded(X.rolling_search(model_table(spark, d), X.annual_folds(spark, *YEARS), grid, baselines=baselines()), 4)


@query()
def m18_rolling_two_stage(spark, d):
    grid = X.candidates(COLUMNS, kinds=["two_stage"], cs=X.CS, half_lives=X.HALF_LIVES)
    return rounded(X.rolling_search(model_table(spark, d), X.annual_folds(spark, *YEARS), grid, baselines=baselines()), 4)


@query()
def m19_model_search(spark, d):
    """Logistic and two-stage candidates of four penalties and three half-lives, Poisson and low-score ones of three: 30 in the same passes."""
    grid = X.candidates(COLUMNS, kinds=["logistic", "two_stage"], cs=X.CS, half_lives=X.HALF_LIVES) | X.candidates(COLUMNS, kinds=["poisson", "dixon_coles"], half_lives=X.HALF_LIVES)
    return rounded(X.chronological_search(model_table(spark, d), COLUMNS, "1998-01-01", "1999-01-01", "1999-07-01", "2000-01-01", "2003-01-01", models=grid), 4)


SCORERS = ["scorer_goals_decay_diff", "scorer_top1_goals_decay_diff", "scorer_top3_share_diff", "scorer_active_players_diff", "scorer_coverage_diff"]


@query()
def m21_pairwise_blends(spark, d):
    """Over three years: the logistic model blended with trees of three classes, with trees of two stages, and with models that see the scorers too."""
    threats = scorer_features(matches(spark, d), view(spark, d, "goals")).select("match_id", *SCORERS)
    path = scratch(spark, "scorers")
    model_table(spark, d).join(threats, "match_id").write.parquet(path)
    with_scorers = [*COLUMNS, *SCORERS]
    models = {
        "logistic": lambda: Multinomial(COLUMNS), "trees": lambda: BoostedClasses(COLUMNS, rounds=20), "two-stage trees": lambda: TwoStage(COLUMNS, kind="trees", rounds=10),
        "scorers": lambda: Multinomial(with_scorers), "scorer trees": lambda: BoostedClasses(with_scorers, rounds=20),
    }
    log = X.grid_log(spark.read.parquet(path), X.annual_folds(spark, 1998, 2000), models)
    return rounded(X.pairwise_blends(log, "logistic", [n for n in models if n != "logistic"]), 4)


@query()
def m22_finalise(spark, d):
    """Blend weights from out-of-fold predictions, both gates (validation 1998 and 1999, holdout 2000), and the refitted model saved and read again (s15)."""
    rows = model_table(spark, d)
    models = {"baseline": lambda: elo_baseline(COLUMNS), "logistic": lambda: Multinomial(COLUMNS), "poisson": lambda: TwoPoisson(COLUMNS)}
    log = X.grid_log(rows, X.annual_folds(spark, 1998, 2000), models)
    verdict, weights = X.finalise(log, "baseline", ["logistic", "poisson"], ["2000"])
    path = scratch(spark, "champion")
    save_model(Multinomial(COLUMNS).fit(rows), path)
    state = load_state(spark, path)
    extra = {"kind": F.lit(state["kind"]), "n_columns": F.lit(len(state["columns"])), "logistic_weight": F.lit(weights[0]), "poisson_weight": F.lit(weights[1])}
    return rounded(verdict.withColumns(extra), 4)


@query()
def s15_model_artifact(spark, d):
    rows = model_table(spark, d)
    path = scratch(spark, "poisson")
    save_model(TwoPoisson(COLUMNS).fit(rows), path)
    state = load_state(spark, path)
    return spark.read.parquet(f"{path}/state").select(F.length("sha256").alias("digits"), F.lit(len(state["betas"])).alias("n_models"), F.lit(state["kind"]).alias("kind"))


@query()
def a23_coefficient_importance(spark, d):
    model = Multinomial(COLUMNS).fit(parts(model_table(spark, d))[0])
    return rounded(model.importance(spark), 3)


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by all")
def streaming_windows(spark, d):
    """The events table as a stream: counts per hour and type, all windows closed at its end."""
    from ..streaming.ingest import stream_table

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path = scratch(spark, "windows")
    events = stream_table(spark, d, schema, "events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(path)

    q = counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
