"""Queries of the session state, its history and the calls that make it; their statements are shared where both engines read them alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import economy as E
from tidemark.operators import extract, sessions, similarity
from tidemark.plans import oracle as O
from tidemark.plans import session_queries as S
from tidemark.plans.economy_queries import _BURN, BUDGET, CONFIG, burned
from tidemark.plans.extract_queries import _hex_sql, _fnv_sql, _octets_sql
from tidemark.plans.fixtures import command_sql, table
from tidemark.registry import query
from tidemark.sources import events as sources
from tidemark.sources.shared import shared_folder

# calls of sessions: columns that both engines compute from events by the same text
_TOOL = "case event_type when 'click' then 'bash' when 'view' then 'read' when 'signup' then 'grep' else event_type end"
_CALL = f"user_id, event_id as call, {_TOOL} as tool, cast(floor(value) as bigint) as in_tk, cast(floor(value / 3) as bigint) as out_tk, concat('src/f', cast(event_id % 13 as string), '.py') as file, case when event_type = 'error' then concat('error: ', cast(event_id % 5 as string)) end as err, case when event_id % 17 = 0 then concat('ab12cd', cast(event_id % 10 as string)) end as git"
_CALLS = f"select {_CALL} from events"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "value", "ts").selectExpr(*_split(_CALL))


def _split(columns: str) -> list[str]:
    """The columns of a select list: commas outside of brackets part them."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


_SEEN = ", ".join(f"least((select count(distinct {c}) from ({_CALLS}) x where x.user_id = c.user_id), {cap}) as seen_{n}" for c, n, cap in (("file", "files", 256), ("err", "errors", 128), ("git", "git", 64)))
_TOKENS = ", ".join(f"sum(case when {test} then in_tk else 0 end)::bigint as tokens_{name}" for name, test in (("bash", "tool = 'bash'"), ("read", "tool = 'read'"), ("grep", "tool = 'grep'"), ("other", "tool not in ('bash', 'read', 'grep')")))


@query("session_summary", f"""
select *, case when total_tokens + tokens_saved > 0 then tokens_saved * 100 // (total_tokens + tokens_saved) else 0 end::bigint as compression_pct from (
  select user_id, count(*) as calls, least(count(*), 32) as calls_logged, {_TOKENS}, sum(out_tk)::bigint as total_tokens, sum(greatest(in_tk - out_tk, 0))::bigint as tokens_saved, min(call) as started,
    {_SEEN}, count(file) - count(distinct file) as rereads from ({_CALLS}) c group by user_id)
""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.array_compact(F.array(c)).alias({"file": "files", "err": "errors", "git": "git"}[c])
    rows = _calls(spark, sf_dir).select("user_id", "call", "tool", "in_tk", "out_tk", one("file"), one("err"), one("git"))
    return sessions.counters(rows, "user_id", "call")


_STATS = "user_id, case when event_id % 7 = 0 then 'exact' when event_id % 11 = 0 then 'similar' end as hit_kind, value > 150 as summarized, case when event_id % 5 = 0 then 'ultra' else 'full' end as tier, " + _TOOL + " as tool, cast(floor(value / 2) as bigint) as saved"


@query("session_stats", f"""
select user_id, count(*) filter (where hit_kind = 'exact') as exact_hits, count(*) filter (where hit_kind = 'similar') as similar_hits, count(*) filter (where summarized) as summarized, count(*) filter (where tier = 'ultra') as ultra_calls,
  sum(case when tool = 'bash' then saved else 0 end)::bigint as saved_bash, sum(case when tool = 'read' then saved else 0 end)::bigint as saved_read, sum(case when tool not in ('bash', 'read') then saved else 0 end)::bigint as saved_other, count(*) as calls
from (select {_STATS} from events) group by user_id
""")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.stats(table(spark, sf_dir, "events").selectExpr(*_split(_STATS)), "user_id")


#: summaries with all lists: what was committed is the files of every third event
_COMMITTED = S._first_sql("file", "ord % 3 = 0", "files_committed", 20)
_ERRORS, _GIT = S._first_sql("err", "err is not null", "errors_resolved", 128), S._first_sql("git", "git is not null", "git_events", 64)
_SUMMARY = f"""
select f.*, coalesce(c.files_committed, []) as files_committed, coalesce(e.errors_resolved, []) as errors_resolved, coalesce(g.git_events, []) as git_events
from ({S._FINAL}) f left join ({_COMMITTED}) c using (user_id) left join ({_ERRORS}) e using (user_id) left join ({_GIT}) g using (user_id)
"""
FIELDS = ["files_touched", "files_committed", "errors_resolved", "git_events", "investigated", "learned", "completed", "next_steps", "test_summary"]


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.command_log(spark, sf_dir).withColumn("committed", F.when(F.col("ord") % 3 == 0, F.col("files")).otherwise(F.array().cast("array<string>")))
    return sessions.finalize(log, "user_id", "ord").withColumn("files_touched", F.col("investigated"))


_LISTED = {"files_touched": "string_split(investigated, '|')", "investigated": "string_split(investigated, '|')", "learned": "string_split(learned, '|')", "completed": "string_split(completed, '|')", "next_steps": "string_split(next_steps, '|')", "test_summary": "[test_summary]"}
_EACH = " union all ".join(f"select user_id, {k} as place, '{f}' as field, {_LISTED.get(f, f)} as vs from s" for k, f in enumerate(FIELDS))


@query("search_all_fields", f"""
with s as materialized (select * from ({_SUMMARY}) order by user_id desc limit 200), hits as (select user_id, place, field, list_filter(vs, lambda v: contains(lower(v), 'r'))[1] as hit from ({_EACH}))
select user_id, field, left(hit, 80) as hit from hits where hit is not null order by user_id desc, place limit 60
""")
def search_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sessions' first values that hold a letter, over all nine fields, sixty at most."""
    return sessions.search(summaries(spark, sf_dir), "user_id", "user_id", FIELDS, "R", 200, 60)


@query("file_history_committed", f"""
select user_id, tokens_saved, len(list_filter(files_committed, lambda f: contains(lower(f), 'f12'))) > 0 as is_committed from ({_SUMMARY})
where contains(investigated, 'f12') or len(list_filter(files_committed, lambda f: contains(lower(f), 'f12'))) > 0
""")
def file_history_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.file_history(summaries(spark, sf_dir), "user_id", ["files_touched"], "F12", "files_committed")
    return rows.select("user_id", "tokens_saved", "is_committed")


_COUNTED = "len(string_split(investigated, '|'))", "len(git_events)", "case when next_steps = '' then 0 else len(string_split(next_steps, '|')) end"


@query("display_line", f"""
select user_id, 'Prior session (2024-01-' || lpad((user_id % 28 + 1)::varchar, 2, '0') || '): ' || a || ' file' || case when a = 1 then '' else 's' end || case when b > 0 then ', ' || b || ' commit' || case when b = 1 then '' else 's' end else '' end
  || case when c > 0 then ', ' || c || ' pending' else '' end as line from (select user_id, {_COUNTED[0]} as a, {_COUNTED[1]} as b, {_COUNTED[2]} as c from ({_SUMMARY}))
""")
def display_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"))
    return summaries(spark, sf_dir).select("user_id", sessions.display_line(date, F.size("files_touched"), F.size("git_events"), F.size("next_steps")).alias("line"))


_DAY = "cast(cast(ts as date) as string) as day, user_id, event_id as ord, concat('src/f', cast(event_id % 70 as string), '.py') as path, case when event_type = 'error' then concat('error: code ', cast(event_id % 9 as string), ' ', repeat('long ', cast(event_id % 40 as int))) end as error, case when event_id % 17 = 0 then concat('git commit ', cast(event_id % 3 as string)) end as git, case when event_id % 11 = 0 then concat('test result: ', repeat('ok ', cast(event_id % 50 as int))) end as test"


def _firsts_sql(name: str, most: int, width: int, different: bool) -> str:
    rows = f"select day, left({name}, {width}) as v, {'min(ord)' if different else 'ord'} as o from d where {name} is not null{f' group by day, left({name}, {width})' if different else ''}"
    return f"select day, list('  ' || v order by o, v)[:{most}] as xs from ({rows}) group by day"


_BLOCKS = " || ".join(f"coalesce((select '{title}:' || chr(10) || array_to_string(xs, chr(10)) || chr(10) from ({_firsts_sql(*args)}) x where x.day = s.day), '')" for title, args in (("errors", ("error", 5, 100, True)), ("git_events", ("git", 5, 80, False)), ("test_results", ("test", 3, 80, False))))


@query("session_detail_lists", f"""
with d as materialized (select {_DAY} from events),
t as (select day, 'date=' || day || ' sessions=' || n || chr(10) || 'events=' || c || ' files=' || f || chr(10) || {_BLOCKS} as text
  from (select day, count(distinct user_id) as n, count(*) as c, least(count(distinct path), 64) as f from d group by day) s)
select day, case when strlen(text) > 900 then left(text, 1800) || chr(10) || '[truncated]' || chr(10) || right(text, 200) else text end as text from t
""")
def session_detail_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's sessions as a text with lists; the limit is lower than usual, so that some texts are cut."""
    return sessions.detail(table(spark, sf_dir, "events").selectExpr(*_split(_DAY)), "day", "user_id", "ord", 900)


@query("warnings_once", f"""
with r as (select *, min(case when used >= 4500 then call end) over (partition by user_id) as compact from ({_BURN})),
w as (select *, min(case when (used * 100 // {BUDGET} >= 90 or coalesce(remaining <= 10, false)) and call is distinct from compact then call end) over (partition by user_id) as state from r)
select user_id, call, case when call = compact then 'compact' else 'state' end as warning from w where call = compact or call = state
""")
def warnings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.warnings(burned(spark, sf_dir), "user_id", "call", BUDGET, 4500, CONFIG.state_warn_calls)


_LINES = "user_id, event_id as call, cast(floor(value * 4) as bigint) as n_lines, event_type <> 'error' as benign, cast(floor(value * 10) as bigint) as in_tk, cast(floor(value * 3) as bigint) as out_tk"


@query("call_state", f"""
with c as (select *, coalesce(sum(out_tk) over (partition by user_id order by call rows between unbounded preceding and 1 preceding), 0)::bigint as used_before from (select {_LINES} from events)),
t as (select *, case when used_before * 10000 >= {BUDGET} * 6500 then 'ultra' else 'full' end as tier from c),
l as (select *, case tier when 'ultra' then 90 else 180 end as limit_lines from t)
select user_id, call, used_before, tier, case when n_lines > limit_lines * case when benign then 2 else 1 end then case tier when 'ultra' then 'structured' else 'prose' end else 'handler' end as form,
  case when in_tk > 0 then greatest(0, 100 - out_tk * 100 // in_tk) else 0 end::bigint as saved_pct from l
""")
def call_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call goes through, by what its session used before."""
    rows = E.calls_through(table(spark, sf_dir, "events").selectExpr(*_split(_LINES)), "user_id", "call", CONFIG)
    return rows.select("user_id", "call", "used_before", "tier", "form", "saved_pct")


_PLANNED = f"select conv_id, turn, {command_sql('(conv_id * 7 + turn)')} as cmd, turn % 5 = 4 as planning from conversations"


@query("bypass", f"select conv_id, turn, cmd, starts_with(cmd, 'psql') or starts_with(cmd, 'docker exec') or starts_with(cmd, 'mysql') or starts_with(cmd, 'ssh') as bypassed, not (starts_with(cmd, 'psql') or starts_with(cmd, 'docker exec') or starts_with(cmd, 'mysql') or starts_with(cmd, 'ssh') or planning) as handled from ({_PLANNED})")
def bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that pass untouched: those with a configured prefix, and those run to plan."""
    cmd = F.col("cmd")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(command_sql("(conv_id * 7 + turn)")).alias("cmd"), (F.col("turn") % 5 == 4).alias("planning"))
    return rows.select("conv_id", "turn", "cmd", E.bypassed(cmd, Config()).alias("bypassed"), E.handled(cmd, F.col("planning"), Config()).alias("handled"))


_VIEWS = ("cat README.md", "head -n 5 docs/a.MD", "bat -p src/x.rs", "less notes.txt", "tail -c 10 b.py", "cat .md", "ls x.md", "more a/b.tsx", "cat x.go", "cat A.java", "cat a.rb", "cat a.kt", "cat a.swift", "cat a.hpp")
_TARGETS = ("README.md", "docs/a.MD", None, None, None, None, None, None, None, None, None, None, None, None)
_LANGS = (None, None, "rust", None, "python", None, None, "ts", "go", "java", "ruby", "kotlin", "swift", "c")


def _pick_sql(values) -> str:
    return f"[{', '.join('null' if v is None else O.quoted(v) for v in values)}][(conv_id + turn) % {len(values)} + 1]"


@query("view_modes", f"""
select conv_id, turn, cmd, target, lang, case when lang is not null and (conv_id + turn) % 2 = 0 then 'signatures' when target is not null then 'markdown' else 'rule' end as mode
from (select conv_id, turn, {_pick_sql(_VIEWS)} as cmd, {_pick_sql(_TARGETS)} as target, {_pick_sql(_LANGS)} as lang from conversations)
""")
def view_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files are shown: code of 400 lines and more by its signatures, Markdown compressed."""
    at = (F.col("conv_id") + F.col("turn")) % len(_VIEWS) + 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(*map(F.lit, _VIEWS)), at.cast("int")).alias("cmd"))
    n_lines = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, 400).otherwise(399)
    cmd = F.col("cmd")
    return rows.select("conv_id", "turn", "cmd", extract.markdown_target(cmd).alias("target"), extract.viewed_file(cmd)[1].alias("lang"), extract.view_mode(cmd, n_lines, Config()).alias("mode"))


@query("capped_errors", f"select user_id, err, first_seen from (select *, row_number() over (partition by user_id order by first_seen desc, err desc) as r from (select user_id, err, min(call) as first_seen from ({_CALLS}) where err is not null group by user_id, err)) where r <= 3")
def capped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state keeps so many different errors, three here, and forgets the oldest."""
    return sessions.capped(_calls(spark, sf_dir).where("err is not null"), "user_id", "err", "call", 3)


@query("call_ring", f"select user_id, call, tool, left({_hex_sql(_fnv_sql(_octets_sql('file')))}, 8) as short_hash from (select *, row_number() over (partition by user_id order by call desc) as r from ({_CALLS})) where r <= 32")
def call_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 32 calls of each session, with the short hashes of what they gave."""
    last = sessions.last_calls(_calls(spark, sf_dir), "user_id", "call", 32)
    return similarity.fingerprints(last, "file").select("user_id", "call", "tool", "short_hash")


@query("new_errors", f"select user_id, err, min(call) as call from ({_CALLS}) c where err is not null and call % 2 = 1 and not exists (select 1 from ({_CALLS}) h where h.user_id = c.user_id and h.err = c.err and h.call % 2 = 0) group by user_id, err")
def new_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that the history lacks: odd calls come in, even ones are the history."""
    rows = _calls(spark, sf_dir).where("err is not null").select("user_id", "err", "call")
    return sessions.unseen(rows.where("call % 2 = 1"), rows.where("call % 2 = 0"), ["user_id", "err"], "call")


@query("budget_by_tool", "select event_id, tool, coalesce(own, amount) as amount, name from (select event_id, event_type as tool, nullif(event_id % 4, 0) as own from events) left join (values ('view', 'limit', 300), ('click', 'head_limit', 100)) p(tool, name, amount) using (tool)")
def budget_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits joined by tool; what a call brings along stays."""
    limits = spark.createDataFrame([("view", "limit", CONFIG.read_max_lines), ("click", "head_limit", CONFIG.grep_max_results)], "tool string, name string, amount long")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.expr("nullif(event_id % 4, 0)").alias("own"))
    return rows.join(F.broadcast(limits), "tool", "left").select("event_id", "tool", F.coalesce("own", "amount").alias("amount"), "name")


@query("track_results", f"""
select conv_id, row_number() over (partition by conv_id order by turn) as call_n, 'lib/x' || (turn % 3) || '.rs src/f' || turn || '.py' as files, 'error: bad ' || turn as errors, (strlen('error: bad ' || turn || chr(10) || 'see src/f' || turn || '.py') // 4)::bigint as tokens from conversations
""")
def track_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results: each bumps its session's call number and gives its files, errors and tokens."""
    turn = F.col("turn").cast("string")
    content = F.concat(F.lit("error: bad "), turn, F.lit("\nsee src/f"), turn, F.lit(".py"))
    given = F.concat(F.lit("lib/x"), (F.col("turn") % 3).cast("string"), F.lit(".rs"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(given.alias("file_path")).alias("tool_input"), F.struct(content.alias("content")).alias("tool_result"))).alias("json"))
    found = extract.tracked(rows, "conv_id", "turn", "json")
    return found.select("conv_id", "call_n", F.array_join("files", " ").alias("files"), F.array_join("errors", "|").alias("errors"), "tokens")


@query("event_log", f"select user_id, call as ts, tool, in_tk as tokens_est, coalesce(err, '') as err from ({_CALLS})")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in two goes and read back, by a pattern of its folders."""
    at = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = _calls(spark, sf_dir).select(F.lit("tool").alias("type"), "tool", F.col("in_tk").alias("tokens_est"), F.col("user_id").cast("string").alias("cmd"), F.coalesce("err", F.lit("")).alias("log"), F.col("call").alias("ts"))
    sources.append_events(rows.where("ts % 2 = 0"), f"{at}/2024-01-01")
    sources.append_events(rows.where("ts % 2 = 1"), f"{at}/2024-01-02")
    sources.append_events(rows.where("ts % 2 = 1"), f"{at}/2025-01-01")
    sources.forget_later(spark, at)
    return sources.read_events(spark, f"{at}/2024-*").select(F.col("cmd").cast("long").alias("user_id"), "ts", "tool", "tokens_est", F.col("log").alias("err"))


@query("summary_store", f"select '2024-01-' || lpad((user_id % 28 + 1)::varchar, 2, '0') as date, user_id as ts, user_id as valid_from, tokens_saved, investigated as files from ({S._FINAL}) where user_id % 28 + 1 <= 9")
def summary_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries appended to a table by date, of which the first days are read."""
    at = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"))
    sources.append_summaries(summaries(spark, sf_dir).select(date.alias("date"), F.col("user_id").alias("ts"), F.lit(0).cast("long").alias("valid_from"), "tokens_saved", "files_touched"), at)
    sources.forget_later(spark, at)
    rows = sources.read_summary_table(spark, at).where("date < '2024-01-10'")
    return rows.select("date", "ts", "valid_from", "tokens_saved", F.array_join("files_touched", "|").alias("files"))


@query("whole_texts", "select item_id, text || chr(10) as text from benchmark")
def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as files, one each, and read back as whole texts."""
    at = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(at)
    sources.forget_later(spark, at)
    return sources.read_outputs(spark, f"{at}/item_id=*").select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text")


@query("size_guard", "select doc_id, n_chars from documents where strlen('{\"ts\":' || doc_id || ',\"log\":' || to_json(text)::varchar || '}') <= 3000")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over a size, three thousand bytes here, are passed over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.to_json(F.struct(F.col("doc_id").alias("ts"), F.col("text").alias("log"))).alias("value"))
    kept = sources.parsed(docs, "value", "ts bigint, log string", 3000).select(F.col("ts").alias("doc_id"), F.char_length("log").cast("long").alias("n_chars"))
    return kept


@query("current_session", f"select user_id, sum(out_tk)::bigint as total_tokens, sum(greatest(in_tk - out_tk, 0))::bigint as tokens_saved, count(*) as total_calls, bool_or(in_tk > 190) as compact_warned, min(call) as start_ts from ({_CALLS}) group by user_id")
def current_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each session after its last call: states are appended call by call and the newest one is read."""
    return sessions.newest_state(sessions.states(_calls(spark, sf_dir), "user_id", "call", F.col("in_tk") > 190), "user_id", "call")
