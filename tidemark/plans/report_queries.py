"""Reports: scenarios through the real pipeline, comparison, totals, proofs of efficiency and configurations side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators import economy as E
from tidemark.operators import lines as L
from tidemark.plans import oracle as O
from tidemark.plans.fixtures import event_lines, event_lines_sql, table
from tidemark.plans.line_queries import _GENERIC, generic_pipeline
from tidemark.registry import query

_DOCS = f"select k as doc_id, sum(strlen(line) + 1)::bigint as out_bytes, count(*) as n_lines from ({_GENERIC}) group by k"
_RUN = f"""
select lang as category, coalesce(source, 'none') as name, sum(strlen(text) // 4)::bigint as before_tk, sum(coalesce(out_bytes, 0) // 4)::bigint as after_tk, sum(coalesce(n_lines, 0))::bigint as n_lines, count(*) as iterations,
  count(quality) as n_labels, coalesce(sum(quality), 0)::bigint as n_good
from documents left join ({_DOCS}) using (doc_id) left join labels using (doc_id) where lang is not null group by lang, source
"""


def scenario_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of scenarios, a source in a language each: tokens before and after the generic pipeline, and labels of quality."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("category"), F.coalesce("source", F.lit("none")).alias("name"), F.floor(F.octet_length("text") / 4).alias("before"))
    out = generic_pipeline(spark, sf_dir).select("doc_id", "out_tk", F.col("n_lines").alias("lines"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = docs.join(out, "doc_id", "left").join(labels, "doc_id", "left").groupBy("category", "name")
    return rows.agg(zero("before").alias("before_tk"), zero("out_tk").alias("after_tk"), zero("lines").alias("n_lines"), F.count(F.lit(1)).alias("iterations"), F.count("quality").alias("n_labels"), zero("quality").alias("n_good"))


def reduction(before, after):
    return F.when(before > 0, (before - after) * 100.0 / before).otherwise(0.0)


_PCT = "case when before_tk > 0 then (before_tk - after_tk) * 100.0::double / before_tk else 0 end"


@query("scenario_run", f"select category, name, before_tk, after_tk, iterations, round({_PCT}, 4)::double as reduction_pct, case when n_labels = 0 then 'skip' when n_good * 2 >= n_labels then 'pass' else 'fail' end as outcome from ({_RUN})")
def scenario_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scenario's reduction, and whether half of its labelled documents at least are good."""
    rows = scenario_results(spark, sf_dir)
    outcome = F.when(F.col("n_labels") == 0, "skip").when(F.col("n_good") * 2 >= F.col("n_labels"), "pass").otherwise("fail")
    return rows.select("category", "name", "before_tk", "after_tk", "iterations", F.round(reduction(F.col("before_tk"), F.col("after_tk")), 4).alias("reduction_pct"), outcome.alias("outcome"))


@query("ab_table", f"""
select coalesce(category, 'TOTAL') as category, coalesce(name, 'all') as name, before_tk, after_tk, greatest(before_tk - after_tk, 0) as saved_tk, round({_PCT}, 1)::double as reduction_pct
from (select category, name, sum(before_tk)::bigint as before_tk, sum(after_tk)::bigint as after_tk from ({_RUN}) group by grouping sets ((category, name), ()))
""")
def ab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without and with the pipeline: a row for each scenario and one for all of them."""
    rows = scenario_results(spark, sf_dir).select("category", "name", "before_tk", "after_tk")
    total = rows.agg(F.lit("TOTAL").alias("category"), F.lit("all").alias("name"), F.sum("before_tk").alias("before_tk"), F.sum("after_tk").alias("after_tk"))
    every = rows.unionByName(total)
    return every.withColumn("saved_tk", F.greatest(F.col("before_tk") - F.col("after_tk"), F.lit(0))).withColumn("reduction_pct", F.round(reduction(F.col("before_tk"), F.col("after_tk")), 1))


@query("report_totals", f"""
with r as materialized ({_RUN}), ranked as (select list_sort(list(n_lines)) as ls from r where n_lines > 0)
select coalesce(category, 'all') as category, sum(before_tk)::bigint as before_tk, sum(after_tk)::bigint as after_tk, round((sum(before_tk) - sum(after_tk)) * 100.0::double / sum(before_tk), 4) as reduction_pct, (sum(n_lines) // count(*))::bigint as mean_lines,
  list_sort(list(n_lines))[least((floor(count(*) * 0.95::double))::int + 1, count(*)::int)] as p95_lines,
  count(*) filter (where n_labels > 0 and n_good * 2 >= n_labels) as n_pass, count(*) filter (where n_labels > 0 and n_good * 2 < n_labels) as n_fail, count(*) filter (where n_labels = 0) as n_skip
from r where n_lines > 0 group by grouping sets ((category), ())
""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language and in all: weighted reduction, mean and p95 of the lines left, and numbers of scenarios that pass, fail or are skipped.

    The list that p95 is read from holds one number for each scenario.
    """
    rows = scenario_results(spark, sf_dir).where("n_lines > 0")
    n = F.count(F.lit(1))
    good, labelled = F.col("n_good") * 2 >= F.col("n_labels"), F.col("n_labels") > 0
    sums = rows.rollup("category").agg(
        F.sum("before_tk").alias("before_tk"), F.sum("after_tk").alias("after_tk"), F.round((F.sum("before_tk") - F.sum("after_tk")) * 100.0 / F.sum("before_tk"), 4).alias("reduction_pct"), F.expr("sum(n_lines) div count(*)").alias("mean_lines"),
        F.element_at(F.sort_array(F.collect_list("n_lines")), F.least(F.floor(n * F.lit(0.95)) + 1, n).cast("int")).alias("p95_lines"),
        F.count_if(labelled & good).alias("n_pass"), F.count_if(labelled & ~good).alias("n_fail"), F.count_if(~labelled).alias("n_skip"),
    )
    return sums.withColumn("category", F.coalesce("category", F.lit("all")))


#: name, limit of lines, tokens that a configuration saves besides
CONFIGS = (("C2", 120, 0), ("C3", 72, 0), ("C4", 36, 0), ("C5", 36, 500), ("C6", 10, 500))
_STRIPPED = "not contains(line, 'Agent(Explore)') and not contains(line, 'Agent(Plan)') and not contains(line, 'Sub-agent')"


def _run_sql(limit: int) -> str:
    return f"select sum(strlen(line) + 1)::bigint as bytes from ({O.truncate(O.group(O.dedup(O.clean(O.DOCUMENT_LINES), 2), 5), limit, False)})"


_CONFIG_ROWS = " union all ".join(
    [f"select 'C0' as name, sum(strlen(line) + 1)::bigint as bytes, 0 as less from ({O.DOCUMENT_LINES})", f"select 'C1', sum(strlen(line) + 1)::bigint, 0 from ({O.DOCUMENT_LINES}) where {_STRIPPED}"]
    + [f"select '{name}', bytes, {less} from ({_run_sql(limit)})" for name, limit, less in CONFIGS]
)


@query("hypothesis_run", f"""
with r as (select name, greatest(bytes // 4 - less, 0)::bigint as after_tk from ({_CONFIG_ROWS})), b as (select after_tk as before_tk from r where name = 'C0')
select name, before_tk, after_tk, round({_PCT}, 4)::double as reduction_pct, row_number() over (order by {_PCT} desc, name) as place, {_PCT} >= 80 as passes_floor from r, b
""")
def hypothesis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven configurations run over one corpus, best reduction first: none, agents' lines dropped, and five of the generic handler.

    The four pipelines differ in their last limit only, so lines go through one of them and are truncated by configuration.
    """
    lines = L.to_lines(table(spark, sf_dir, "documents"), "doc_id")
    size = F.sum(F.octet_length("line") + 1).cast("long").alias("bytes")
    agent = X.has_any(F.col("line"), ("Agent(Explore)", "Agent(Plan)", "Sub-agent"))
    raw = lines.agg(size, F.sum(F.when(~agent, F.octet_length("line") + 1)).cast("long").alias("stripped"))
    raw = raw.select(F.explode(F.array(F.struct(F.lit("C0").alias("name"), "bytes"), F.struct(F.lit("C1").alias("name"), F.col("stripped").alias("bytes")))).alias("x")).select("x.name", "x.bytes", F.lit(0).alias("less"))
    rule = L.rule_for("generic", max_lines=1 << 30)
    done = L.run_rule(lines, "doc_id", rule)
    configs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(limit).alias("limit"), F.lit(less).alias("less")) for n, limit, less in CONFIGS])).alias("x")
    each = done.select("doc_id", "n", "line", configs).select(F.struct("doc_id", "x.name", "x.less").alias("_id"), "n", "line", F.col("x.limit").alias("_limit"))
    kept = L.truncate(each, "_id", F.col("_limit")).groupBy("_id.name", "_id.less").agg(size).select("name", "bytes", "less")
    rows = raw.unionByName(kept).select("name", F.greatest(F.expr("bytes div 4") - F.col("less"), F.lit(0)).cast("long").alias("after_tk"))
    # seven rows
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("before_tk", F.max(F.when(F.col("name") == "C0", F.col("after_tk"))).over(every))
    pct = reduction(F.col("before_tk"), F.col("after_tk"))
    return rows.select("name", "before_tk", "after_tk", F.round(pct, 4).alias("reduction_pct"), F.row_number().over(Window.orderBy(pct.desc(), "name")).cast("long").alias("place"), (pct >= 80).alias("passes_floor"))


_PROOFS = ("dedup", 10, O.dedup(event_lines_sql(), 2)), ("clean", 5, O.clean(event_lines_sql())), ("group", 80, O.group(event_lines_sql(), 4)), ("collapse", 1, O.hits(event_lines_sql())), ("truncate", 50, O.truncate(event_lines_sql(), 60, True))


@query("efficiency_proof", " union all ".join(f"""
select '{name}' as name, before_tk, after_tk, {floor}::double as floor_pct, {_PCT} >= {floor} as passed
from (select sum(strlen(line) + 1)::bigint // 4 as before_tk from ({event_lines_sql()})), (select sum(strlen(line) + 1)::bigint // 4 as after_tk from ({sql}))""" for name, floor, sql in _PROOFS))
def efficiency_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five operators over the noisy lines, each against the reduction that it should reach."""
    lines = event_lines(spark, sf_dir)
    made = {"dedup": L.dedup(lines, "k", 2), "clean": L.clean(lines), "group": L.group_by_dir(lines, "k", 4), "collapse": L.collapse_hits(lines, "k"), "truncate": L.truncate(lines, "k", 60, tail=True)}
    tokens = lambda df, name: df.agg(F.expr("cast(sum(octet_length(line) + 1) as bigint) div 4").alias(name))
    out = None
    for name, floor, _ in _PROOFS:
        # two single rows side by side
        row = tokens(lines, "before_tk").join(F.broadcast(tokens(made[name], "after_tk"))).withColumn("name", F.lit(name)).withColumn("floor_pct", F.lit(float(floor)))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", reduction(F.col("before_tk"), F.col("after_tk")) >= F.col("floor_pct"))


#: lines as definitions begin in several languages, and near misses
_CODE = (
    "pub fn run()", "async fn x()", "impl A for B {", "  fn inner()", "pub const N: u8", "use std::io", "def f():", "async def g():", "class A:", "  def method", "export function a() {", "const x = 1", "export default class B", "interface C {", "let y = 2",
    "func main() {", "package main", "type T struct {", "public class D {", "private interface E", "public static void main", "module F", "struct G {", "enum H {", "int main(void) {", "static int x(int a)", "return f(x);", "fun k()", "// fn no", "",
)
# How definitions begin, by language.
_BEGINS = {
    "rust": "pub fn |fn |async fn |pub async fn |unsafe fn |pub unsafe fn |impl |trait |struct |enum |pub mod |pub use |pub struct |pub enum |pub trait |pub type |pub const |pub impl ",
    "python": "def |async def |class ",
    "ts": "export function |export default function |export async function |function |async function |export class |export default class |class |export const |export let |export var |export type |export interface |export enum |export default |const |interface |type ",
    "go": "func |type |package ",
    "java": "public class |private class |protected class |public interface |private interface |protected interface |class |interface |public static |fun |public fun |private fun |protected fun |public enum |private enum |enum ",
    "ruby": "def |class |module |func |struct |enum ",
}
_BEGINS |= {"kotlin": _BEGINS["java"], "swift": _BEGINS["ruby"]}
_LANGS = (*_BEGINS, "c")
_AT = f"(event_id % {len(_CODE)} + 1)"
_IS = " ".join(f"when '{lang}' then regexp_matches(line, '^({begins})')" for lang, begins in _BEGINS.items())


@query("signature_lines", f"""
select event_id, lang, line, case lang {_IS} else regexp_matches(line, '^[A-Za-z_]') and contains(line, '(') and regexp_matches(line, '(\\)|\\) \\{{|\\)\\{{)$') end as hit
from (select event_id, ls[{_AT}] as line, [{', '.join(map(O.quoted, _LANGS))}][(event_id // {len(_CODE)}) % {len(_LANGS)} + 1] as lang from events, (select [{', '.join(map(O.quoted, _CODE))}] as ls))
""")
def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lines begin a definition, in nine languages."""
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (F.floor(F.col("event_id") / len(_CODE)) % len(_LANGS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", lang.alias("lang"), F.element_at(F.array(*map(F.lit, _CODE)), (F.col("event_id") % len(_CODE) + 1).cast("int")).alias("line"))
    hit = F.lit(None).cast("boolean")
    for name in _LANGS:
        hit = F.when(F.col("lang") == name, L.is_signature(F.col("line"), name)).otherwise(hit)
    return rows.withColumn("hit", hit)


@query("cost_of_scenarios", f"select category, v as calls_per_day, round(v * 2000 * 30 * 3.0::double / 1000000 * r / 100, 4)::double as saved from (select category, round((sum(before_tk) - sum(after_tk)) * 100.0::double / sum(before_tk), 4) as r from ({_RUN}) group by category), (values (100), (1000), (10000)) a(v)")
def cost_of_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the measured reductions save a month, by language and volume."""
    rows = scenario_results(spark, sf_dir).groupBy("category").agg(F.round((F.sum("before_tk") - F.sum("after_tk")) * 100.0 / F.sum("before_tk"), 4).alias("r"))
    each = rows.select("category", "r", F.explode(F.array(*map(F.lit, (100, 1000, 10000)))).alias("calls_per_day"))
    return each.select("category", "calls_per_day", E.monthly_cost(F.col("calls_per_day"), F.col("r"), F.lit(3.0)).alias("saved"))
