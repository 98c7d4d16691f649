"""Queries of the line pipeline and its handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lines as L
from tidemark.plans import oracle as O
from tidemark.plans import stated as V
from tidemark.plans.fixtures import command_sql, event_lines, event_lines_sql, table
from tidemark.registry import query

_EVENTS = event_lines_sql()


@query("line_split", f"select k as doc_id, n, line from ({O.DOCUMENT_LINES})")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_lines(table(spark, sf_dir, "documents"), "doc_id")


@query("smart_filter", O.clean(_EVENTS))
def smart_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean(event_lines(spark, sf_dir))


@query("ansi_strip", f"select k, n, regexp_replace(line, chr(27) || '\\[[^A-Za-z]*([A-Za-z]|\\z)', '', 'g') as line from ({_EVENTS}) where contains(line, chr(27))")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).where(F.contains("line", F.lit("\x1b"))).withColumn("line", X.strip_ansi(F.col("line")))


@query("strip_timestamp", f"select k, n, case when starts_with(line, '[2024') then line[position('] ' in line) + 2:] else line end as line from ({_EVENTS})")
def strip_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).withColumn("line", X.strip_timestamp(F.col("line")))


_PREDICATES = f"""
select k, n, t = '' as blank, {O.starts('h', V.SPINNERS)} as spinner,
  (contains(t, '█') or contains(t, '░') or (contains(t, '[') and contains(t, ']') and contains(t, '=') and contains(t, '>')) or (ends_with(t, '%') and regexp_matches(t, '[0-9]'))) as progress,
  starts_with(h, 'hint:') as hint, {O.starts('h', V.NPM_NOISE)} as npm, {O.starts('h', V.BUNDLER_NOISE)} as bundler,
  contains(line, 'node_modules/') and (starts_with(h, 'at ') or contains(line, '(/.')) as frame, {O.has('line', V.ERROR_MARKERS)} as marker
from (select *, {O.trim('line')} as t, {O.ltrim('line')} as h from ({_EVENTS}))
"""


@query("line_predicates", _PREDICATES)
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    h = X.ltrim(c)
    return event_lines(spark, sf_dir).select(
        "k", "n", X.is_blank(c).alias("blank"), X.is_spinner(c).alias("spinner"), X.is_progress(c).alias("progress"), h.startswith("hint:").alias("hint"),
        X.starts_any(h, X.NPM_NOISE).alias("npm"), X.starts_any(h, X.BUNDLER_NOISE).alias("bundler"), X.is_module_frame(c).alias("frame"), X.has_error_marker(c).alias("marker"),
    )


@query("dedup_lines", f"select k as doc_id, n, line from ({O.dedup(O.DOCUMENT_LINES, 2)})")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedup(L.to_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", 2)


@query("dedup_lines_three", O.dedup(_EVENTS, 3))
def dedup_lines_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedup(event_lines(spark, sf_dir), "k", 3)


@query("group_by_dir", O.group(_EVENTS, 4))
def group_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_by_dir(event_lines(spark, sf_dir), "k", 4)


@query("grep_collapse", O.hits(_EVENTS))
def grep_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapse_hits(event_lines(spark, sf_dir), "k")


@query("truncate_head", f"select k as doc_id, n, line from ({O.truncate(O.DOCUMENT_LINES, 20, False)})")
def truncate_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.truncate(L.to_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", 20)


@query("truncate_tail", f"select k as doc_id, n, line from ({O.truncate(O.DOCUMENT_LINES, 20, True)})")
def truncate_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.truncate(L.to_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", 20, tail=True)


@query("tail_keep", f"select k as doc_id, n, line from (select *, row_number() over (partition by k order by n desc) as r from ({O.DOCUMENT_LINES})) where r <= 5")
def tail_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_lines(L.to_lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", 5)


_GENERIC = O.truncate(O.group(O.dedup(O.clean(O.DOCUMENT_LINES), 2), 5), 20, False)


@query("generic_pipeline", f"""
select k as doc_id, count(*) as n_lines, sum(strlen(line) + 1)::bigint as out_bytes, any_value(b) as in_bytes, any_value(b) // 4 as in_tk, (sum(strlen(line) + 1) // 4)::bigint as out_tk
from ({_GENERIC}) join (select doc_id, strlen(text) as b from documents) d on d.doc_id = k group by k
""")
def generic_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic handler over documents, with token estimates before and after."""
    docs = table(spark, sf_dir, "documents")
    lines = L.to_lines(docs.withColumn("in_bytes", F.octet_length("text").cast("long")).withColumn("_id", F.struct("doc_id", "in_bytes")), "_id")
    out = L.run_rule(lines, "_id", L.rule_for("generic", max_lines=20))
    sums = out.groupBy("_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("out_bytes"))
    return sums.select("_id.doc_id", "n_lines", "out_bytes", "_id.in_bytes", F.expr("_id.in_bytes div 4").alias("in_tk"), F.expr("out_bytes div 4").alias("out_tk"))


# each handler over the noisy lines: name, command, and what its lines go through in DuckDB
_CLEAN = O.clean(_EVENTS)
_TS = f"{O.has('line', ('error TS', 'warning TS'))} or (contains(line, ':') and contains(line, '(') and contains(line, ')')) or starts_with(t, 'Found ') or starts_with(t, 'error:')"
_TF = (
    "not (starts_with(t, 'Refreshing state...') or starts_with(t, 'Reading...') or (starts_with(t, '#') and contains(t, 'is up-to-date')) or t = 'Terraform will perform the following actions:')"
    f" and ({O.starts('t', V.TERRAFORM_STARTS)} or {O.has('t', V.TERRAFORM_PARTS)})"
)
_PW = f"((starts_with(t, '✓') or starts_with(t, 'ok ') or contains(t, ' ✓ ')) and not {O.has('t', ('failed', 'Error'))}) or regexp_full_match(t, '[.FT]*') or {O.starts('t', V.PLAYWRIGHT_NOISE)}"
_HANDLERS = {
    "git_log": ("git", "git log", O.truncate(O.dedup(_CLEAN, 2), 20, False)),
    "git_diff": ("git", "git diff", O.truncate(O.dedup(_CLEAN, 2), 150, False)),
    "git_status": ("git", "git status", O.truncate(O.group(O.dedup(_CLEAN, 2), 4), 60, False)),
    "docker": ("docker", "docker logs", O.truncate(O.dedup(_CLEAN, 2), 100, True)),
    "package_mgr": ("package_mgr", "npm install", O.truncate(O.dedup(_CLEAN, 2), 50, True)),
    "test_runner": ("test_runner", "pytest", O.truncate(O.dedup(O.where(_CLEAN, f"not ({O.has('line', ('✓', '✔', ' ok'))} and not {O.has('line', ('failed', 'FAIL'))})"), 2), 100, True)),
    "playwright": ("playwright", "playwright test", O.truncate(O.dedup(O.where(_CLEAN, f"not ({_PW})"), 2), 120, True)),
    "typescript": ("typescript", "tsc", O.truncate(O.where(_CLEAN, _TS), 100, False)),
    "build": ("build", "make", O.truncate(O.dedup(O.where(_CLEAN, f"not {O.starts('line', V.GRADLE_NOISE)}"), 2), 100, True)),
    "xcodebuild": ("build", "xcodebuild", O.truncate(O.dedup(O.where(_CLEAN, f"not {O.starts('line', V.GRADLE_NOISE)} and not {O.starts('line', V.XCODE_NOISE)} and not {O.has('line', V.XCODE_NOTES)}"), 2), 100, True)),
    "next_build": ("next_build", "next build", O.truncate(O.dedup(O.where(_CLEAN, f"not {O.starts('t', V.NEXT_NOISE)} and not (regexp_full_match(t, '\\([0-9/()]*\\)') and contains(t, '/'))"), 2), 140, False)),
    "wrangler": ("wrangler", "wrangler deploy", O.truncate(O.dedup(O.where(_CLEAN, f"not {O.starts('t', V.WRANGLER_NOISE)} and not {O.has('t', (' KiB / gzip:', ' MiB / gzip:'))}"), 2), 80, True)),
    "cloud": ("cloud", "kubectl get pods", O.truncate(O.where(_CLEAN, "not starts_with(line, '---')"), 100, False)),
    "database": ("database", "psql", O.truncate(O.where(_CLEAN, "not starts_with(line, '+')"), 52, False)),
    "prisma_generate": ("database", "prisma generate", O.where(_CLEAN, O.has("lower(line)", V.PRISMA_PARTS))),
    "network": ("network", "curl", O.truncate(O.where(_CLEAN, "not starts_with(line, '< ') or starts_with(line, '< HTTP')"), 60, False)),
    "runtime": ("runtime", "python3 a.py", O.truncate(O.where(_CLEAN, "not starts_with(h, 'at internal/') and not starts_with(h, 'at async internal/')"), 50, False)),
    "fs_list": ("fs", "ls -la", O.truncate(O.group(_CLEAN, 5), 50, False)),
    "fs_env": ("fs", "env", O.truncate(O.where(_CLEAN, f"not {O.starts('line', V.ENV_NOISE)}"), 80, False)),
    "fs_tail": ("fs", "tail -n 5 a.log", O.truncate(_CLEAN, 50, True)),
    "terraform": ("data_tool", "terraform plan", O.truncate(O.where(_EVENTS, _TF), 120, False)),
    "helm": ("data_tool", "helm status", O.truncate(O.where(_CLEAN, f"not {O.starts('t', V.HELM_NOISE)}"), 120, False)),
    "json_tool": ("data_tool", "jq .", O.truncate(O.where(_EVENTS, "t not in ('', '{}', '[]', 'null')"), 120, False)),
    "text_proc": ("text_proc", "rg foo", O.truncate(O.dedup(O.hits(_EVENTS), 2), 120, False)),
    "generic": ("generic", "x", O.truncate(O.group(O.dedup(_CLEAN, 2), 5), 120, False)),
}


def _handler_query(handler: str, cmd: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.run_rule(event_lines(spark, sf_dir), "k", L.rule_for(handler, cmd))

    return run


for _name, (_handler, _cmd, _sql) in _HANDLERS.items():
    query(f"handler_{_name}", _sql)(_handler_query(_handler, _cmd))


_GRAPHQL = "select conv_id as k, turn as n, case turn % 3 when 0 then '{\"errors\":[{\"message\":\"bad ' || turn || '\",\"code\":\"E' || conv_id || '\"}]}' when 1 then '\"code\":\"X' || turn || '\"' else text end as line from conversations"
_GRAPHQL_ERRORS = f"""
with c as ({O.clean(_GRAPHQL)}), flagged as (select * from c where k in (select k from c where contains(line, '"errors"') and contains(line, '"message"')))
select k as conv_id, 0 as n, '[GraphQL Error]' as line from flagged group by k union all
select k, n * 2, 'Error: ' || regexp_extract(line, '"message":"*([^"]*)"', 1) from flagged where regexp_matches(line, '"message":"*[^"]*"') union all
select k, n * 2 + 1, 'Code: ' || regexp_extract(line, '"code":"*([^"]*)"', 1) from flagged where regexp_matches(line, '"code":"*[^"]*"')
"""
_GRAPHQL_FLAGGED = f"select k from ({O.clean(_GRAPHQL)}) where contains(line, '\"errors\"') and contains(line, '\"message\"')"


#: which of the statements above each of the fixture's commands goes through
_MIXED = (
    "git_log", "git_diff", "git_status", "docker", "package_mgr", "test_runner", "package_mgr", "playwright", "typescript", "build",
    "next_build", "wrangler", "cloud", "database", "network", "runtime", "fs_list", "fs_env", "fs_tail", "fs_view",
    "terraform", "helm", "json_tool", "text_proc", "git_status", "text_proc", "test_runner", "test_runner", "package_mgr", "build", "generic", "generic",
)


def _mixed_sql() -> str:
    by = {name: sql for name, (_, _, sql) in _HANDLERS.items()} | {"fs_view": O.truncate(_CLEAN, 50, False)}
    parts = []
    for name in sorted(set(_MIXED)):
        at = ", ".join(str(i) for i, x in enumerate(_MIXED) if x == name)
        parts.append(f"select k, n, line from ({by[name].replace(_EVENTS, f'select k, n, line from ev where k % {len(_MIXED)} in ({at})')})")
    return f"with ev as ({_EVENTS}) " + " union all ".join(parts)


@query("handler_mixed", _mixed_sql())
def handler_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of all kinds of commands, each session's of its own, in one plan."""
    return L.run_mixed(event_lines(spark, sf_dir).withColumn("cmd", F.expr(command_sql("k"))), "k")


@query("handler_network_graphql", f"""
select conv_id, n, line from ({_GRAPHQL_ERRORS}) union all
select k, n, line from ({O.truncate(O.where(O.clean(f"select * from ({_GRAPHQL}) where k not in ({_GRAPHQL_FLAGGED})"), "not starts_with(line, '< ') or starts_with(line, '< HTTP')"), 60, False)})
""")
def handler_network_graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with errors give these, others their first lines without headers."""
    return L.run_rule(_answers(spark, sf_dir), "conv_id", L.rule_for("network", "curl x"))


_ITEM = (
    "{", '  "id": 7,', '  "rev": 3,', '  "fields": {', '    "System.Title": "one",', '    "Custom.Size": 4', "  },", '  "_links": {', '    "self": {', '      "id": 9', "    }", "  },", '  "relations": null,',
    '  "url": "x"', "}", "tail line",
)
_ITEM_KEPT = (1, 2, 3, 4, 5, 7, 14, 15)
_ITEMS = f"select conv_id as k, turn * 100 + i as n, [{', '.join(map(O.quoted, _ITEM))}][i] as line from conversations, unnest(range(1, {len(_ITEM) + 1})) as t(i) where turn = 0 and conv_id % 3 <> 0 union all select conv_id, turn, text from conversations where conv_id % 3 = 0"


@query("handler_work_items", f"""
select k, n, line from ({_ITEMS}) where k % 3 <> 0 and n in ({', '.join(map(str, _ITEM_KEPT))}) union all
select k, 0, '[work items: main fields kept; links, relations and extensions dropped]' from ({_ITEMS}) where k % 3 <> 0 group by k union all
select k, n, line from ({O.truncate(O.where(O.clean(f"select * from ({_ITEMS}) where k % 3 = 0"), "not starts_with(line, '---')"), 100, False)})
""")
def handler_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items as JSON, and tables of them for every third conversation."""
    turns = table(spark, sf_dir, "conversations")
    items = turns.where("turn = 0 and conv_id % 3 <> 0").select(F.col("conv_id").alias("k"), F.posexplode(F.array(*map(F.lit, _ITEM))).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))
    plain = turns.where("conv_id % 3 = 0").select(F.col("conv_id").alias("k"), F.col("turn").alias("n"), F.col("text").alias("line"))
    return L.run_rule(items.unionByName(plain), "k", L.rule_for("cloud", "az boards work-item show"))


_NAME = f"lower(regexp_extract(regexp_replace(regexp_replace(cmd, '^([^ ]*=[^ ]* +)+', ''), '^(npx |bunx |pnpm exec |yarn exec )', ''), '^([^ ]*/)?([^ /]*)', 2))"  # noqa: F541
_DISPATCH = " ".join(f"when name in ({', '.join(map(O.quoted, names))}) then '{h}'" for h, names in V.HANDLERS.items())


@query("handler_dispatch", f"""
select conv_id, turn, cmd, name, case when name = 'bun' then case when regexp_matches(cmd, ' (test|vitest|jest|playwright)( |$)') then 'test_runner' else 'package_mgr' end
  when name = 'cargo' then case when regexp_matches(cmd, ' test( |$)') then 'test_runner' else 'package_mgr' end
  when name = 'next' then case when regexp_matches(cmd, 'build|dev|start') then 'next_build' else 'generic' end
  when name in ('vite', 'turbo') then case when contains(cmd, 'build') then 'build' else 'generic' end {_DISPATCH} else 'generic' end as handler
from (select *, {_NAME} as name from (select conv_id, turn, {command_sql('(conv_id * 7 + turn)')} as cmd from conversations))
""")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(command_sql("(conv_id * 7 + turn)")).alias("cmd"))
    return calls.select("*", X.command_name(F.col("cmd")).alias("name"), L.handler_of(F.col("cmd")).alias("handler"))


_CODE = "select doc_id as k, i as n, case i % 5 when 0 then 'def f' || i || '():' when 1 then 'class A' || i when 2 then '    return ' || i when 3 then '# note' else '' end as line from documents, unnest(range(1, 401 + doc_id % 50)) as t(i)"


@query("signature_mode", f"""
with s as (select *, row_number() over (partition by k order by n) as r, count(*) over (partition by k) as a from ({O.clean(_CODE)})),
raw as (select k, count(*) as raw from ({_CODE}) group by k having count(*) >= 400),
body as (
  select k, 1 as section, n, line from s where r <= least(3, a // 2) union all
  select k, 2, n, line from s where {O.starts('line', V.PYTHON_STARTS)} union all
  select k, 3, n, line from s where r > a - least(3, a // 2)
),
held as (select body.* from body join raw using (k))
select k as doc_id, section, n, line from held union all
select k, 0, 0, '[' || count(*) || ' signatures from ' || any_value(raw) || ' lines]' from held join raw using (k) group by k
""")
def signature_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of 400 lines and more, one for each document."""
    i = F.col("n")
    files = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(1L, 400 + doc_id % 50)")).alias("n"))
    text = F.when(i % 5 == 0, F.concat(F.lit("def f"), i.cast("string"), F.lit("():"))).when(i % 5 == 1, F.concat(F.lit("class A"), i.cast("string"))).when(i % 5 == 2, F.concat(F.lit("    return "), i.cast("string"))).when(i % 5 == 3, "# note").otherwise("")
    return L.signatures(files.withColumn("line", text), "doc_id", "python")


@query("graphql_errors", _GRAPHQL_ERRORS)
def graphql_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all conversations."""
    return L.graphql_errors(_answers(spark, sf_dir), "conv_id")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    error = F.concat(F.lit('{"errors":[{"message":"bad '), turn, F.lit('","code":"E'), F.col("conv_id").cast("string"), F.lit('"}]}'))
    line = F.when(F.col("turn") % 3 == 0, error).when(F.col("turn") % 3 == 1, F.concat(F.lit('"code":"X'), turn, F.lit('"'))).otherwise(F.col("text"))
    return turns.select("conv_id", F.col("turn").alias("n"), line.alias("line"))
