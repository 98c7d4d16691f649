"""Queries of the token economy over the events table: a user is a session, an event is a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PROFILES, Config
from tidemark.operators import economy as E
from tidemark.plans.fixtures import table
from tidemark.registry import query

CONFIG = Config(compact_threshold_tokens=9_000, agent_spawn_cost=350)
BUDGET = CONFIG.budget
#: user_id, call (event_id), tool, tokens of each event
CALLS = "select user_id, event_id as call, event_type as tool, cast(floor(value * 10) as bigint) as tokens from events"
USED = f"select *, cast(sum(tokens) over (partition by user_id order by call rows unbounded preceding) as bigint) as used from ({CALLS})"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id as call", "event_type as tool", "cast(floor(value * 10) as bigint) as tokens")


@query("running_budget", f"select user_id, call, tokens, used, used >= {BUDGET} as exhausted from ({USED})")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_totals(calls(spark, sf_dir), "user_id", "call").select("user_id", "call", "tokens", "used", (F.col("used") >= BUDGET).alias("exhausted"))


_TIER = f"case when used * 10000 >= {BUDGET} * 6500 then 'ultra' else 'full' end"


@query("adaptive_tier", f"select user_id, call, used, {_TIER} as tier from ({USED})")
def adaptive_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_totals(calls(spark, sf_dir), "user_id", "call").select("user_id", "call", "used", E.tier(F.col("used"), CONFIG).alias("tier"))


@query("scaled_limits", f"""
select user_id, call, tier, case tier when 'full' then 72 else 36 end::int as max_lines, case tier when 'full' then 12 else 6 end::int as git_log_max_commits, case tier when 'full' then 90 else 45 end::int as git_diff_max_lines,
  case tier when 'full' then 60 else 30 end::int as docker_logs_max_lines, case tier when 'full' then 30 else 15 end::int as find_max_results, case tier when 'full' then 180 else 90 end::int as summarize_threshold_lines, 2::int as dedup_min
from (select user_id, call, {_TIER} as tier from ({USED}))
""")
def scaled_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scaled_limits(adaptive_tier(spark, sf_dir).drop("used"), "tier", CONFIG)


_BURN = f"""
select user_id, call, tool, tokens, used, window_n, total // window_n as avg_tokens,
  case when window_n >= 3 and total // window_n > 0 then case when used >= {BUDGET} then 0 else ({BUDGET} - used) // (total // window_n) end end as remaining
from (select *, count(*) over w as window_n, cast(sum(tokens) over w as bigint) as total,
    cast(sum(case when tool <> 'signup' then tokens else 0 end) over (partition by user_id order by call rows unbounded preceding) as bigint) as used
  from ({CALLS}) window w as (partition by user_id order by call rows between 15 preceding and current row))
"""


def burned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.burn(calls(spark, sf_dir), "user_id", "call", BUDGET, F.col("tool") != "signup")


@query("burn_rate", f"select user_id, call, window_n, avg_tokens from ({_BURN})")
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burned(spark, sf_dir).select("user_id", "call", "window_n", "avg_tokens")


@query("calls_remaining", f"select user_id, call, used, remaining, coalesce(remaining < 30, false) as warn from ({_BURN})")
def calls_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burned(spark, sf_dir).select("user_id", "call", "used", "remaining", F.coalesce(F.col("remaining") < CONFIG.burn_rate_warn_calls, F.lit(False)).alias("warn"))


@query("context_pressure", f"""
select user_id, call, pressure_pct, case when pressure_pct >= 75 or coalesce(remaining <= 10, false) then 'use_state_first' when pressure_pct >= 55 then 'compact_soon' else 'ok' end as recommendation
from (select *, least(100, used * 100 // {BUDGET})::bigint as pressure_pct from ({_BURN}))
""")
def context_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pressure(burned(spark, sf_dir), BUDGET, CONFIG.state_warn_calls).select("user_id", "call", "pressure_pct", "recommendation")


@query("agent_costs", f"select user_id, spawns, spawns * 350 as estimated, spawns > 0 and spawns * 350 >= {int(BUDGET * 0.5)} as warn from (select user_id, count(*) filter (where tool = 'purchase') as spawns from ({CALLS}) group by user_id)")
def agent_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = calls(spark, sf_dir).withColumn("tool", F.when(F.col("tool") == "purchase", "Task").otherwise(F.col("tool")))
    return E.agent_costs(named, "user_id", "tool", CONFIG)


@query("first_warning", f"select user_id, min(call) as first_call, min(used) as used from ({USED}) where used >= 4500 group by user_id")
def first_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_crossing(E.running_totals(calls(spark, sf_dir), "user_id", "call"), "user_id", "call", 4500)


_SUMS = f"""
select user_id, sum(tokens)::bigint as total_tokens, sum(tokens)::bigint as total_in, sum(tokens // 3)::bigint as total_out, (count(*) filter (where tool = 'purchase') * 350)::bigint as agent_tokens,
  count(*) - count(distinct tokens) as hits, count(*) as calls from ({CALLS}) group by user_id
"""


@query("efficiency_score", f"""
select *, (compression_ratio_bp * 30 + tool_choice_efficiency_bp * 30 + context_reuse_rate_bp * 20 + budget_utilization_bp * 20) // 100 as overall_bp
from (select user_id,
  case when total_in > 0 then least(10000, greatest(total_in - total_out, 0) * 10000 // total_in) else 0 end as compression_ratio_bp,
  case when total_tokens > 0 then 10000 - least(10000, agent_tokens * 10000 // total_tokens) else 10000 end as tool_choice_efficiency_bp,
  case when calls > 0 then least(10000, hits * 10000 // calls) else 0 end as context_reuse_rate_bp, 10000 - least(10000, total_tokens * 10000 // {BUDGET}) as budget_utilization_bp from ({_SUMS}))
""")
def efficiency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = calls(spark, sf_dir).groupBy("user_id").agg(
        F.sum("tokens").alias("total_tokens"), F.sum("tokens").alias("total_in"), F.sum(F.expr("tokens div 3")).alias("total_out"), (F.count_if(F.col("tool") == "purchase") * 350).alias("agent_tokens"),
        (F.count(F.lit(1)) - F.count_distinct("tokens")).alias("hits"), F.count(F.lit(1)).alias("calls"),
    )
    return E.efficiency(sums, BUDGET).drop("total_tokens", "total_in", "total_out", "agent_tokens", "hits", "calls")


@query("tokens_by_tool", f"""
select user_id, sum(case when tool = 'click' then tokens else 0 end)::bigint as tokens_bash, sum(case when tool = 'view' then tokens else 0 end)::bigint as tokens_read,
  sum(case when tool = 'signup' then tokens else 0 end)::bigint as tokens_grep, sum(case when tool not in ('click', 'view', 'signup') then tokens else 0 end)::bigint as tokens_other
from ({CALLS}) group by user_id
""")
def tokens_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("tool") == "click", "bash").when(F.col("tool") == "view", "read").when(F.col("tool") == "signup", "grep").otherwise("other")
    own = lambda k: F.sum(F.when(kind == k, F.col("tokens")).otherwise(0)).alias(f"tokens_{k}")
    return calls(spark, sf_dir).groupBy("user_id").agg(own("bash"), own("read"), own("grep"), own("other"))


@query("status_line", f"""
select coalesce(user_id, -1) as user_id, count(*) as n_calls, sum(tokens)::bigint as total_in, sum(tokens // 3)::bigint as total_out, count(*) filter (where (tokens // 3) * 100 < 5 * tokens) as redundant
from ({CALLS}) where tool = 'click' and tokens > 0 group by grouping sets ((user_id), ())
""")
def status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session and, as session -1, all of them."""
    rows = calls(spark, sf_dir).where("tool = 'click' and tokens > 0").withColumn("out", F.expr("tokens div 3"))
    sums = [F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("total_in"), F.sum("out").alias("total_out"), F.count_if(F.col("out") * 100 < 5 * F.col("tokens")).alias("redundant")]
    return rows.groupBy("user_id").agg(*sums).unionByName(rows.agg(*sums).withColumn("user_id", F.lit(-1).cast("long")))


@query("cost_model", "select v as calls_per_day, p as price, round(v * 2000 * 30 * p / 1000000 * 84.9 / 100, 4)::double as saved from (values (100), (1000), (10000)) a(v), (values (3.0::double), (15.0::double)) b(p)")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(v, p) for v in (100, 1000, 10000) for p in (3.0, 15.0)], "calls_per_day int, price double")
    return rows.withColumn("saved", E.monthly_cost(F.col("calls_per_day"), F.lit(84.9), F.col("price")))


_SCENARIOS = "select source, lang, sum(strlen(text) // 4)::bigint as before_tk, sum(case when doc_id % 3 = 0 then strlen(text) // 4 else strlen(text) // 20 end)::bigint as after_tk, count(*) as n from documents group by source, lang"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    after = F.when(F.col("doc_id") % 3 == 0, F.floor(size / 4)).otherwise(F.floor(size / 20))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.floor(size / 4)).alias("before_tk"), F.sum(after).alias("after_tk"), F.count(F.lit(1)).alias("n"))


@query("reduction_report", f"""
select coalesce(lang, 'all') as lang, sum(before_tk)::bigint as before_tk, sum(after_tk)::bigint as after_tk, round((sum(before_tk) - sum(after_tk)) * 100.0::double / sum(before_tk), 4) as reduction_pct,
  list_sort(list(before_tk))[(count(*) // 2 + 1)::int] as median_tk, list_sort(list(before_tk))[(floor(count(*) * 0.95::double) + 1)::int] as p95_tk
from ({_SCENARIOS}) group by rollup (lang)
""")
def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios are sources by language: weighted reduction, upper median and p95 by language and in all.

    The lists that the percentiles are read from hold one number for each scenario.
    """
    n = F.count(F.lit(1))
    ranked = F.sort_array(F.collect_list("before_tk"))
    sums = scenarios(spark, sf_dir).rollup("lang").agg(
        F.sum("before_tk").alias("before_tk"), F.sum("after_tk").alias("after_tk"), F.round((F.sum("before_tk") - F.sum("after_tk")) * 100.0 / F.sum("before_tk"), 4).alias("reduction_pct"),
        F.element_at(ranked, (F.floor(n / 2) + 1).cast("int")).alias("median_tk"), F.element_at(ranked, (F.floor(n * F.lit(0.95)) + 1).cast("int")).alias("p95_tk"),
    )
    return sums.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("calibrate_profile", f"""
select source, case when r > 70 and passed = total then 'aggressive' when r > 50 then 'balanced' else 'conservative' end as profile, case when r > 70 and passed = total then 120 when r > 50 then 200 else 350 end::int as max_lines
from (select source, avg((before_tk - after_tk) * 100.0::double / before_tk) as r, count(*) filter (where n >= 3) as passed, count(*) as total from ({_SCENARIOS}) group by source)
""")
def calibrate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = scenarios(spark, sf_dir).groupBy("source").agg(F.avg((F.col("before_tk") - F.col("after_tk")) * 100.0 / F.col("before_tk")).alias("r"), F.count_if(F.col("n") >= 3).alias("passed"), F.count(F.lit(1)).alias("total"))
    lines = F.create_map(*[F.lit(x) for name, p in PROFILES.items() for x in (name, p["max_lines"])])
    return sums.select("source", E.profile(F.col("r"), F.col("passed"), F.col("total")).alias("profile")).withColumn("max_lines", lines[F.col("profile")].cast("int"))


_GRID = "(values ('C0', 1.0::double, 0), ('C1', 0.9::double, 0), ('C2', 0.6::double, 0), ('C3', 0.3::double, 0), ('C4', 0.25::double, 0), ('C5', 0.2::double, 500), ('C6', 0.15::double, 500))"


@query("hypothesis_grid", f"""
select name, before_tk, after_tk, round((before_tk - after_tk) * 100.0::double / before_tk, 4) as reduction_pct, row_number() over (order by (before_tk - after_tk) * 100.0::double / before_tk desc, name) as place,
  (before_tk - after_tk) * 100.0::double / before_tk >= 80 as passes_floor
from (select name, before_tk, greatest(floor(before_tk * share)::bigint - less, 0) as after_tk from (select sum(strlen(text) // 4)::bigint as before_tk from documents), {_GRID} g(name, share, less))
""")
def hypothesis_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven configurations against one corpus, best reduction first."""
    total = table(spark, sf_dir, "documents").agg(F.sum(F.floor(F.octet_length("text").cast("long") / 4)).alias("before_tk"))
    grid = [("C0", 1.0, 0), ("C1", 0.9, 0), ("C2", 0.6, 0), ("C3", 0.3, 0), ("C4", 0.25, 0), ("C5", 0.2, 500), ("C6", 0.15, 500)]
    each = total.select("before_tk", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("share"), F.lit(x).alias("less")) for n, s, x in grid])).alias("g"))
    rows = each.select("g.name", "before_tk", F.greatest(F.floor(F.col("before_tk") * F.col("g.share")) - F.col("g.less"), F.lit(0)).alias("after_tk"))
    pct = (F.col("before_tk") - F.col("after_tk")) * 100.0 / F.col("before_tk")
    from pyspark.sql.window import Window

    return rows.select("name", "before_tk", "after_tk", F.round(pct, 4).alias("reduction_pct"), F.row_number().over(Window.orderBy(pct.desc(), "name")).cast("long").alias("place"), (pct >= 80).alias("passes_floor"))
