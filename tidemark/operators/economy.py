"""Token economy: budgets, tiers, burn rate, pressure, efficiency, costs. All integer arithmetic, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import SCALED, TIERS, Config
from tidemark.functions import text as X


def running_totals(calls: DataFrame, session: str, order: str, tokens: str = "tokens") -> DataFrame:
    """``calls`` with used, the tokens of the session up to and with this call."""
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("used", F.sum(tokens).over(upto).cast("long"))


def tier(used: Column, config: Config) -> Column:
    """lite where adaption is off, ultra from a share of the budget on, else full."""
    if not config.adaptive_intensity:
        return F.lit("lite")
    if config.budget == 0:
        return F.lit("ultra")
    share = round(min(max(config.ultra_trigger_pct, 0.0), 1.0) * 10_000)
    return F.when(used * 10_000 >= F.lit(config.budget * share), "ultra").otherwise("full")


def scaled_limits(rows: DataFrame, tier_column: str, config: Config) -> DataFrame:
    """``rows`` with the limits that their tier allows."""
    which = F.col(tier_column)
    for name, floor in SCALED:
        value = getattr(config, name)
        out = F.lit(value)
        for t in ("full", "ultra"):
            out = F.when(which == t, max(value * TIERS[t][0] // 10, floor)).otherwise(out)
        rows = rows.withColumn(name, out.cast("int"))
    out = F.lit(config.dedup_min)
    for t in ("full", "ultra"):
        out = F.when(which == t, max(config.dedup_min * TIERS[t][1] // 100, 2)).otherwise(out)
    return rows.withColumn("dedup_min", out.cast("int"))


def burn(calls: DataFrame, session: str, order: str, budget: int, counted: Column | None = None, frame: int = 16, least: int = 3) -> DataFrame:
    """``calls`` (tokens) with window_n, avg_tokens and remaining: calls left at the recent rate.

    remaining is null before ``least`` calls or at a rate of 0, and 0 once the budget is used. ``counted`` marks the
    calls whose tokens count as used.
    """
    recent = Window.partitionBy(session).orderBy(order).rowsBetween(-(frame - 1), 0)
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(counted, F.col("tokens")).otherwise(0) if counted is not None else F.col("tokens")
    rows = calls.withColumn("window_n", F.count(F.lit(1)).over(recent)).withColumn("_sum", F.sum("tokens").over(recent)).withColumn("used", F.sum(own).over(upto).cast("long"))
    rows = rows.withColumn("avg_tokens", F.expr("_sum div window_n")).drop("_sum")
    left = F.when(F.col("used") >= budget, F.lit(0).cast("long")).otherwise(F.expr(f"({budget} - used) div nullif(avg_tokens, 0)"))
    return rows.withColumn("remaining", F.when((F.col("window_n") >= least) & (F.col("avg_tokens") > 0), left))


def pressure(rows: DataFrame, budget: int, state_warn_calls: int) -> DataFrame:
    """``rows`` (used, remaining) with pressure_pct and what to do about it."""
    pct = F.least(F.lit(100), F.expr(f"used * 100 div {budget}")) if budget else F.lit(0)
    rows = rows.withColumn("pressure_pct", pct.cast("long"))
    few = F.coalesce(F.col("remaining") <= state_warn_calls, F.lit(False))
    return rows.withColumn("recommendation", F.when((F.col("pressure_pct") >= 75) | few, "use_state_first").when(F.col("pressure_pct") >= 55, "compact_soon").otherwise("ok"))


def efficiency(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (total_in, total_out, agent_tokens, total_tokens, hits, calls) with the four scores and the overall one, in basis points."""
    share = lambda a, b: F.expr(f"least(10000, greatest({a}, 0) * 10000 div nullif({b}, 0))")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("compression_ratio_bp", F.coalesce(share("total_in - total_out", "total_in"), zero))
    rows = rows.withColumn("tool_choice_efficiency_bp", 10_000 - F.coalesce(share("agent_tokens", "total_tokens"), zero))
    rows = rows.withColumn("context_reuse_rate_bp", F.coalesce(share("hits", "calls"), zero))
    rows = rows.withColumn("budget_utilization_bp", 10_000 - share("total_tokens", str(budget)) if budget else zero)
    return rows.withColumn("overall_bp", F.expr("(compression_ratio_bp * 30 + tool_choice_efficiency_bp * 30 + context_reuse_rate_bp * 20 + budget_utilization_bp * 20) div 100"))


def agent_costs(calls: DataFrame, session: str, tool: str, config: Config) -> DataFrame:
    """Per session the agent calls, their estimated tokens and whether they pass a share of the budget."""
    is_agent = F.lower(tool).isin("agent", "task")
    sums = calls.groupBy(session).agg(F.count_if(is_agent).alias("spawns")).withColumn("estimated", F.col("spawns") * config.agent_spawn_cost)
    return sums.withColumn("warn", (F.col("spawns") > 0) & (F.col("estimated") >= int(config.budget * config.agent_warn_threshold_pct)))


def first_crossing(rows: DataFrame, session: str, order: str, threshold: int) -> DataFrame:
    """Per session the first call at which used reached the threshold."""
    return rows.where(F.col("used") >= threshold).groupBy(session).agg(F.min(order).alias("first_call"), F.min("used").alias("used"))


def warnings(rows: DataFrame, session: str, order: str, budget: int, compact_at: int, state_warn_calls: int) -> DataFrame:
    """(session, call, warning): each of two warnings once, of ``rows`` (used, remaining).

    compact at the first call that reaches its threshold; state at the first other call at nine tenths of the budget or
    with few calls left. The call that gives the first doesn't give the second.
    """
    crossing = F.when(F.col("used") >= compact_at, F.col(order))
    marked = rows.withColumn("_compact", F.min(crossing).over(Window.partitionBy(session)))
    critical = (F.expr(f"used * 100 div {max(budget, 1)}") >= 90) | F.coalesce(F.col("remaining") <= state_warn_calls, F.lit(False))
    marked = marked.withColumn("_state", F.min(F.when(critical & ~F.col(order).eqNullSafe(F.col("_compact")), F.col(order))).over(Window.partitionBy(session)))
    kinds = F.when(F.col(order) == F.col("_compact"), "compact").when(F.col(order) == F.col("_state"), "state")
    return marked.select(session, F.col(order).alias("call"), kinds.alias("warning")).where("warning is not null")


def calls_through(rows: DataFrame, session: str, order: str, config: Config) -> DataFrame:
    """``rows`` (n_lines, benign, in_tk, out_tk) with what each call goes through, in order: its tier by what the session
    used before it, the threshold of that tier, whether and how it is summarized, and the whole per cent saved.
    """
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used_before", F.coalesce(F.sum("out_tk").over(before), F.lit(0)).cast("long")).withColumn("tier", tier(F.col("used_before"), config))
    limits = scaled_limits(rows, "tier", config)
    long = F.col("n_lines") > F.when(F.col("benign"), 2 * F.col("summarize_threshold_lines")).otherwise(F.col("summarize_threshold_lines"))
    form = F.when(long & (F.col("tier") == "ultra"), "structured").when(long, "prose").otherwise("handler")
    return limits.withColumn("form", form).withColumn("saved_pct", X.reduction_pct(F.col("in_tk"), F.col("out_tk")))


def bypassed(cmd: Column, config: Config) -> Column:
    """Commands that pass untouched: those with a prefix of the configured ones."""
    return F.lit(False) if not config.bypass else X.any_of([cmd.startswith(p) for p in config.bypass])


def handled(cmd: Column, plan_mode: Column, config: Config) -> Column:
    """Whether a command's output is touched at all: not if the library is off, it is passed by, or it is run to plan."""
    passes = bypassed(cmd, config) | (plan_mode if config.plan_mode_passthrough else F.lit(False))
    return ~passes if config.enabled else F.lit(False)


def profile(reduction_pct: Column, passed: Column, total: Column) -> Column:
    return F.when((reduction_pct > 70) & (passed == total), "aggressive").when(reduction_pct > 50, "balanced").otherwise("conservative")


def monthly_cost(calls_per_day: Column, saved_pct: Column, price_per_million: Column, tokens_per_call: int = 2000, days: int = 30) -> Column:
    """Money saved a month by a reduction."""
    return F.round(calls_per_day * tokens_per_call * days * price_per_million / 1_000_000 * saved_pct / 100, 4)
