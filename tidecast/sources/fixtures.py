"""The driver's star-schema tables seen as matches, ratings, goal events, players and forecasts.

Each view is one SQL text that Spark and DuckDB read alike, so a query and its oracle
start from the same rows. Tables are named in braces for Spark and plainly for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scratch import scratch

VIEWS = {
    # one row per order that at least two suppliers share
    "matches": """
select concat('M', cast(o_orderkey as varchar(20))) as match_id, o_orderdate as kickoff_utc,
       concat('S', cast(s1 as varchar(20))) as team1, concat('S', cast(s2 as varchar(20))) as team2,
       cast(g1 as int) as team1_goals, cast(g2 as int) as team2_goals,
       case o_orderpriority when '1-URGENT' then 'FIFA World Cup' when '2-HIGH' then 'FIFA World Cup qualification'
            when '3-MEDIUM' then 'UEFA Nations League' when '4-NOT SPECIFIED' then 'Copa America' else 'Friendly' end as tournament,
       o_orderstatus = 'P' as neutral, o_orderdate + interval '3' hour as available_at,
       case when last_ship > o_orderdate then last_ship else o_orderdate + interval '3' hour end as late_available_at
from (select o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, min(l_suppkey) s1, max(l_suppkey) s2,
             cast(sum(l_quantity) as bigint) % 5 as g1, (count(*)*3 + sum(l_linenumber)) % 4 as g2, max(l_shipdate) last_ship
      from {orders} join {lineitem} on o_orderkey = l_orderkey
      group by o_orderkey, o_orderdate, o_orderpriority, o_orderstatus) x
where s1 < s2""",
    # monthly snapshots of suppliers, published at the start of the next month
    "ratings": """
select concat('S', cast(l_suppkey as varchar(20))) as team, date_trunc('month', l_shipdate) + interval '1' month as rating_date,
       cast(sum(l_quantity) as double) as points, count(*) as n_rows, cast(l_suppkey % 6 as int) as block
from {lineitem} group by 1, 2, l_suppkey""",
    "goals": """
select m.match_id, m.kickoff_utc, m.team1, m.team2, concat('S', cast(l_suppkey as varchar(20))) as team,
       concat('P', cast(l_partkey % 50 as varchar(20))) as scorer,
       l_linestatus = 'F' and l_linenumber = 7 as own_goal, l_returnflag = 'R' as penalty
from {lineitem} join {matches} m on m.match_id = concat('M', cast(l_orderkey as varchar(20)))
 and (concat('S', cast(l_suppkey as varchar(20))) = m.team1 or concat('S', cast(l_suppkey as varchar(20))) = m.team2)""",
    # deterministic probability triples
    "preds": """
select match_id, kickoff_utc, outcome, yr, neutral, a/(a+b+c) as p_team2_win, b/(a+b+c) as p_draw, c/(a+b+c) as p_team1_win,
       cast(k % 500 as double) as elo_gap
from (select match_id, kickoff_utc, neutral, k, year(kickoff_utc) as yr,
             case when team1_goals > team2_goals then 2 when team1_goals = team2_goals then 1 else 0 end as outcome,
             cast(1+(k*7)%11 as double) a, cast(1+(k*13)%7 as double) b, cast(1+(k*5)%9 as double) c
      from (select *, cast(substring(match_id, 2) as bigint) k from {matches}) q) z""",
    # squads: a supplier's parts of one quarter, known at the start of the next
    "players": """
select concat('S', cast(s as varchar(20)), '-', cast(q as varchar(20))) as snapshot_id, concat('P', cast(p as varchar(20))) as player_id,
       concat('S', cast(s as varchar(20))) as team, q_end as available_at, price as player_rating,
       case p % 4 when 0 then 'GK' when 1 then 'DF' when 2 then 'MF' else 'FW' end as position,
       case flag when 'A' then 'available' when 'N' then 'available' else 'injured' end as availability_status,
       case when n % 2 = 0 then 'starter' else 'bench' end as lineup_status,
       cast(n as double) / 10 as start_probability, cast(q % 90 as double) as expected_minutes, cast(18 + p % 20 as double) as age_years,
       concat('C', cast(p % 7 as varchar(20))) as club
from (select l_suppkey s, l_partkey p, year(l_shipdate) * 4 + quarter(l_shipdate) q, date_trunc('quarter', min(l_shipdate)) + interval '3' month as q_end,
             min(l_returnflag) flag, cast(cast(sum(l_quantity) as bigint) % 97 as double) price, sum(l_linenumber) n
      from {lineitem} group by l_suppkey, l_partkey, year(l_shipdate) * 4 + quarter(l_shipdate)) x""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view above, or else a table of the driver."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"{(\w+)}", text))})


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, written once for operators that pass over their input several times."""
    path = scratch(spark, name)
    view(spark, sf_dir, name).write.parquet(path)
    return spark.read.parquet(path)


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: ``sql`` behind the views it names (and those they need)."""
    need: list[str] = []

    def add(name: str) -> None:
        for inner in re.findall(r"{(\w+)}", VIEWS[name]):
            if inner in VIEWS:
                add(inner)
        if name not in need:
            need.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n]).strip()})" for n in need]
    own = sql.strip()
    if not parts:
        return own
    if own.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + own[15:]
    if own.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + own[5:]
    return "with " + ",\n".join(parts) + "\n" + own
