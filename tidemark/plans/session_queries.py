"""Queries of sessions, history, JSON readers and prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lines as L
from tidemark.operators import prose, sessions
from tidemark.plans import oracle as O
from tidemark.plans.economy_queries import CALLS, calls
from tidemark.plans.fixtures import command_sql, table
from tidemark.registry import query
from tidemark.sources import events as sources


@query("recent_calls", f"select user_id, call, tool, tokens, rank from (select *, row_number() over (partition by user_id order by call desc) as rank from ({CALLS})) where rank <= 10")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_calls(calls(spark, sf_dir), "user_id", "call", 10).withColumn("rank", F.col("rank").cast("long"))


_TOUCHED = "select user_id, event_id as call, 'src/mod' || (event_id % 7) || '/f' || (event_id % 13) || '.py' as path, case event_type when 'purchase' then 'W' when 'error' then 'D' else 'R' end as access from events"


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/mod"), (F.col("event_id") % 7).cast("string"), F.lit("/f"), (F.col("event_id") % 13).cast("string"), F.lit(".py"))
    access = F.when(F.col("event_type") == "purchase", "W").when(F.col("event_type") == "error", "D").otherwise("R")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("call"), path.alias("path"), access.alias("access"))


_FILES = f"select user_id, path, min(call) as first_seen, max(call) as last_seen, arg_max(access, call) as access, count(*) - 1 as rereads from ({_TOUCHED}) group by user_id, path"


@query("seen_files", f"select user_id, path, first_seen, last_seen, access, rereads from (select *, row_number() over (partition by user_id order by last_seen desc, path desc) as r from ({_FILES})) where r <= 20")
def seen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.files(touched(spark, sf_dir), "user_id", "call", 20)


_ERRORS = "select user_id, event_id as call, 'error: code ' || cast(floor(value / 50) as bigint) as line from events where event_type = 'error'"


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("error: code "), F.floor(F.col("value") / 50).cast("string"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("call"), line.alias("line"))


@query("seen_errors", f"select user_id, array_to_string(list(line order by c, line)[:5], '|') as errors, count(*) as n from (select user_id, line, min(call) as c from ({_ERRORS}) group by user_id, line) group by user_id")
def seen_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = error_rows(spark, sf_dir)
    first = sessions.ordered_distinct(rows, "user_id", "line", "call", 5).select("user_id", F.array_join("values", "|").alias("errors"))
    return first.join(rows.groupBy("user_id").agg(F.count_distinct("line").alias("n")), "user_id")


@query("seen_error_details", f"select user_id, md5(line) as fp, replace(left(line, 128), '[', '(') as snippet, count(*) as n from ({_ERRORS}) group by user_id, line")
def seen_error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints joined with their snippets."""
    rows = error_rows(spark, sf_dir).withColumn("fp", F.md5("line"))
    snippets = rows.groupBy("fp").agg(F.replace(F.left(F.min("line"), F.lit(128)), F.lit("["), F.lit("(")).alias("snippet"))
    return rows.groupBy("user_id", "fp").agg(F.count(F.lit(1)).alias("n")).join(snippets, "fp").select("user_id", "fp", "snippet", "n")


_VIEWS = "select conv_id, turn, 'cat src/mod' || (turn % 7) || '/f' || (conv_id % 26) || '.py' as cmd from conversations"


@query("raw_read_hint", f"select conv_id, turn, cmd from ({_VIEWS}) where split_part(cmd, ' ', 2) in (select path from ({_TOUCHED}))")
def raw_read_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that read a file already seen: a semi-join on each argument."""
    path = F.concat(F.lit("cat src/mod"), (F.col("turn") % 7).cast("string"), F.lit("/f"), (F.col("conv_id") % 26).cast("string"), F.lit(".py"))
    views = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("cmd"))
    words = views.withColumn("path", F.explode(X.tokens(F.col("cmd"))))
    return words.join(touched(spark, sf_dir).select("path").distinct(), "path", "left_semi").select("conv_id", "turn", "cmd").distinct()


@query("files_committed", f"select distinct user_id, path from ({_TOUCHED}) t where not exists (select 1 from events s where s.user_id = t.user_id and s.event_id % 3 = 0 and ends_with(' M src/mod' || (s.event_id % 7) || '/f' || (s.event_id % 13) || '.py', t.path))")
def files_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touched files that end no line of their session's status: an anti-join on session and suffix."""
    rows = touched(spark, sf_dir)
    status = rows.where("call % 3 = 0").select("user_id", F.concat(F.lit(" M "), "path").alias("line")).distinct()
    return sessions.committed_less(rows.select("user_id", "path").distinct(), status, ["user_id"], "path", "line")


@query("session_windows", """
select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s
  from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as new from events)) group by user_id, s
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of twelve hours."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "started", "ended", "n")


#: command events: one for each event, by session (user_id)
_TEST = "case event_id % 11 when 0 then 'test result: ok. ' || (event_id % 9) || ' passed' when 5 then 'test result: FAILED. 1 failed' else '' end"
_LOG = f"""
select user_id, event_id as ord, {command_sql('event_id')} as cmd, cast(floor(value) as bigint) as in_tk, cast(floor(value / 3) as bigint) as out_tk, 'src/f' || (event_id % 13) || '.py' as file,
  case when event_type = 'error' then 'error: ' || (event_id % 5) end as err, case when event_id % 17 = 0 then 'ab12cd' || (event_id % 10) || ' msg' end as git, {_TEST} as test_summary from events
"""


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command events with list columns, as the event log stores them."""
    named = "case event_id % 11 when 0 then concat('test result: ok. ', cast(event_id % 9 as string), ' passed') when 5 then 'test result: FAILED. 1 failed' else '' end"
    one = lambda c: F.array_compact(F.array(c))
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("ord"), F.expr(command_sql("event_id")).alias("cmd"), F.floor("value").alias("in_tk"), F.floor(F.col("value") / 3).alias("out_tk"),
        F.array(F.concat(F.lit("src/f"), (F.col("event_id") % 13).cast("string"), F.lit(".py"))).alias("files"),
        one(F.when(F.col("event_type") == "error", F.concat(F.lit("error: "), (F.col("event_id") % 5).cast("string")))).alias("errors"),
        one(F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("ab12cd"), (F.col("event_id") % 10).cast("string"), F.lit(" msg")))).alias("git"), F.expr(named).alias("test_summary"),
    )


def _first_sql(value: str, condition: str, name: str, most: int) -> str:
    return f"select user_id, list(v order by o, v)[:{most}] as {name} from (select user_id, {value} as v, min(ord) as o from ({_LOG}) where {condition} group by user_id, {value}) group by user_id"


_DONE = f"""
select user_id, list(v order by o, v)[:5] as completed from (select user_id, v, min(ord) as o from (
  select user_id, ord, left(test_summary, 80) as v from ({_LOG}) where starts_with(test_summary, 'test result: ok') union all
  select user_id, ord, 'build OK: ' || left(cmd, 30) from ({_LOG}) where err is null and contains(cmd, 'cargo build') union all
  select user_id, ord, left(cmd, 60) from ({_LOG}) where err is null and contains(cmd, 'git push')) group by user_id, v) group by user_id
"""
_joined = "array_to_string(coalesce({}, []), '|') as {}"
_FINAL = f"""
select s.user_id, total_in, total_out, total_in - total_out as tokens_saved, test_summary, {_joined.format('investigated', 'investigated')}, {_joined.format('completed', 'completed')}, {_joined.format('next_steps', 'next_steps')},
  array_to_string(list_concat(coalesce(errors_resolved, [])[:3], list_transform(coalesce(git_events, []), lambda g: 'git:' || left(g, 7)))[:5], '|') as learned
from (select user_id, sum(in_tk)::bigint as total_in, sum(out_tk)::bigint as total_out, coalesce(arg_max(test_summary, ord) filter (where test_summary <> ''), '') as test_summary from ({_LOG}) group by user_id) s
left join ({_first_sql('file', 'true', 'investigated', 20)}) a using (user_id) left join ({_DONE}) b using (user_id) left join ({_first_sql('test_summary', "contains(test_summary, 'FAILED')", 'next_steps', 5)}) c using (user_id)
left join ({_first_sql('err', 'err is not null', 'errors_resolved', 128)}) d using (user_id) left join ({_first_sql('git', 'git is not null', 'git_events', 64)}) e using (user_id)
"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.finalize(command_log(spark, sf_dir), "user_id", "ord")


@query("session_finalize", _FINAL)
def session_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = [F.array_join(c, "|").alias(c) for c in ("investigated", "completed", "next_steps", "learned")]
    return summaries(spark, sf_dir).select("user_id", "total_in", "total_out", "tokens_saved", "test_summary", *flat)


@query("session_detail", "select cast(ts as date)::varchar as day, count(*) as n_events, count(distinct user_id) as n_users, sum(cast(floor(value) as bigint))::bigint as tokens, count(*) filter (where event_type = 'error') as n_errors, count(distinct event_id % 13) as n_files from events group by 1")
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.sum(F.floor("value")).alias("tokens"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_distinct(F.col("event_id") % 13).alias("n_files"))


@query("prior_summaries", f"select user_id, last, tokens_saved from (select user_id, max(ord) as last, (sum(in_tk) - sum(out_tk))::bigint as tokens_saved from ({_LOG}) group by user_id) order by last desc, user_id limit 5")
def prior_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = command_log(spark, sf_dir).groupBy("user_id").agg(F.max("ord").alias("last"), (F.sum("in_tk") - F.sum("out_tk")).alias("tokens_saved"))
    return sums.orderBy(F.col("last").desc(), "user_id").limit(5)


@query("search_history", f"""
with f as (select user_id, investigated, completed, next_steps from ({_FINAL}) order by user_id desc limit 200),
each as (select user_id, 'investigated' as field, string_split(investigated, '|') as vs from f union all select user_id, 'completed', string_split(completed, '|') from f union all select user_id, 'next_steps', string_split(next_steps, '|') from f)
select user_id, field, left(list_filter(vs, lambda v: contains(lower(v), 'f1'))[1], 80) as hit from each where len(list_filter(vs, lambda v: contains(lower(v), 'f1'))) > 0
""")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.search(summaries(spark, sf_dir), "user_id", "user_id", ["investigated", "completed", "next_steps"], "F1", 200)


@query("file_history", f"select user_id, tokens_saved from ({_FINAL}) where contains(investigated, 'src/f12.py')")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.file_history(summaries(spark, sf_dir), "user_id", ["investigated"], "SRC/F12.py").select("user_id", "tokens_saved")


_VALID = "select event_id, floor(epoch(ts))::bigint as ts, case when event_id % 3 = 0 then 0 else floor(epoch(ts))::bigint - 86400 * (event_id % 40) end as valid_to, floor(epoch(ts))::bigint - 86400 * 50 as valid_from from events"


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select("event_id", ts.alias("ts"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(ts - 86400 * (F.col("event_id") % 40)).alias("valid_to"), (ts - 86400 * 50).alias("valid_from"))


@query("retention_prune", f"select v.event_id, v.ts from ({_VALID}) v, (select max(floor(epoch(ts))::bigint) as now from events) where case when valid_to <> 0 then valid_to else ts end = 0 or case when valid_to <> 0 then valid_to else ts end >= now - 30 * 86400")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validity(spark, sf_dir)
    # the newest time is one row
    return sessions.retained(rows.join(F.broadcast(rows.agg(F.max("ts").alias("now")))), F.col("now"), 30).select("event_id", "ts")


@query("validity_asof", f"select v.event_id, v.ts from ({_VALID}) v, (select min(floor(epoch(ts))::bigint) as moment from events) where valid_from <= moment and (valid_to = 0 or moment < valid_to)")
def validity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validity(spark, sf_dir)
    return sessions.valid_at(rows.join(F.broadcast(rows.agg(F.min("ts").alias("at")))), F.col("at")).select("event_id", "ts")


@query("budget_patch", "select event_id, event_type as tool, case event_type when 'view' then coalesce(nullif(event_id % 4, 0), 300) end as read_limit, case event_type when 'click' then 100 end as grep_limit from events")
def budget_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits by tool; one that a call brings along stays."""
    own = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.when(F.col("event_type") == "view", F.coalesce(own, F.lit(300).cast("long"))).alias("read_limit"), F.when(F.col("event_type") == "click", 100).alias("grep_limit"))


@query("json_props", "select event_id, json_extract_string(props, '$.k') as k, len(json_keys(props))::int as n_keys from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), F.size(F.map_keys(props)).alias("n_keys"))


@query("tool_result_json", "select conv_id, turn, case when turn % 2 = 0 then text else text || chr(10) || role end as content, length(case when turn % 2 = 0 then text else text || chr(10) || role end)::int as n_chars from conversations")
def tool_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose content is a string, or a list of parts with a text each, written as JSON and read back."""
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))
    whole = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("tool_result")))
    listed = F.to_json(F.struct(F.struct(parts.alias("content")).alias("tool_result")))
    rows = table(spark, sf_dir, "conversations").withColumn("json", F.when(F.col("turn") % 2 == 0, whole).otherwise(listed))
    return rows.select("conv_id", "turn", sources.result_content(F.col("json")).alias("content")).withColumn("n_chars", F.char_length("content"))


_MD = "select doc_id, case doc_id % 3 when 0 then '# Title' || chr(10) || chr(10) || chr(10) || '```' || chr(10) || 'the code' || chr(10) || '```' || chr(10) || text when 1 then '| a | b' || chr(10) || 'see https://x.example/a?to=http://y.example/b the end' || chr(10) || '  ' || chr(10) || chr(10) || text else '- the item' || chr(10) || '> quote' || chr(10) || text end as text from documents"
_MD_LINES = f"select doc_id as k, i as n, ls[i] as line from (select doc_id, string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') as ls from ({_MD})), unnest(range(1, len(ls) + 1)) as t(i)"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nl = "\n"
    heads = [f"# Title{nl}{nl}{nl}```{nl}the code{nl}```{nl}", f"| a | b{nl}see https://x.example/a?to=http://y.example/b the end{nl}  {nl}{nl}", f"- the item{nl}> quote{nl}"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))


@query("fence_state", f"""
select k as doc_id, n, case when starts_with(h, '```') then 'fence' when before % 2 = 1 then 'code' when regexp_matches(t, '(?s)^\\|.*\\|') then 'table' when t = '' or regexp_matches(t, '^(#|<!--|>|---|===)') then 'protected' else 'prose' end as kind
from (select *, coalesce(sum(case when starts_with(h, '```') then 1 else 0 end) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) as before
  from (select *, {O.ltrim('line')} as h, {O.trim('line')} as t from ({_MD_LINES})))
""")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.fence_state(L.to_lines(markdown(spark, sf_dir), "doc_id"), "doc_id").drop("line")


@query("blank_run_collapse", f"select k as doc_id, n, case when b then '' else line end as line from (select *, coalesce(lag(b) over (partition by k order by n), false) as again from (select *, {O.trim('line')} = '' as b from ({_MD_LINES}))) where not (b and again)")
def blank_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.collapse_blank(L.to_lines(markdown(spark, sf_dir), "doc_id"), "doc_id")


@query("md_counters", f"""
select k as doc_id, (count(*) filter (where starts_with(h, '```')) // 2)::int as fences, sum(len(regexp_extract_all(line, 'https?://[^{O.WS})\\]\"]*')))::int as links, count(*) filter (where starts_with(h, '#'))::int as headings from (select *, {O.ltrim('line')} as h from ({_MD_LINES})) group by k
""")
def md_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return markdown(spark, sf_dir).select("doc_id", prose.fences(c).alias("fences"), prose.links(c).alias("links"), prose.headings(c).alias("headings"))


@query("md_integrity")
def md_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether compression is safe, text by text; the compressed text itself is prose_compress_full."""
    rows = markdown(spark, sf_dir).withColumn("out", prose.compressed(F.col("text")))
    return rows.select("doc_id", F.octet_length("text").alias("before"), F.octet_length("out").alias("after"), prose.is_safe(F.col("text"), F.col("out")).alias("safe"))


@query("filler_drop", "select doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '^[ \\n]+', ''), '[ \\n]+'), lambda w: lower(rtrim(w, ',.')) not in ('the', 'a', 'an', 'just', 'really', 'basically', 'actually', 'simply', 'sure', 'certainly', 'perhaps', 'maybe')), ' ') as words from documents")
def filler_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each whole text without fillers, articles and hedges, in the JVM."""
    gone = prose.LOCALES["en"].articles + prose.LOCALES["en"].fillers + prose.LOCALES["en"].hedges
    words = F.split(F.regexp_replace("text", "^[ \n]+", ""), "[ \n]+")
    kept = F.filter(words, lambda w: ~F.lower(F.regexp_replace(w, "[,.]+$", "")).isin(*gone))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, " ").alias("words"))


@query("prose_compress_full")
def prose_compress_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", prose.compressed(F.col("text")).alias("text"))


@query("prose_compress_ultra")
def prose_compress_ultra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", prose.compressed(F.col("text"), ultra=True).alias("text"))


#: prose without any word that compression drops or shortens: cutting alone decides
_DIGITS = "select doc_id, regexp_replace(text, '[^0-9\\n]+', '7', 'g') as text from documents"


@query("prompt_budget", f"select doc_id, case when length(text) // 4 > 100 then left(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), 390) || chr(10) || '[... cut]' else text end as text from (select doc_id, text || repeat('9', case when length(text) // 4 > 100 then 400 else 0 end) as text from ({_DIGITS}))")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of digits and line ends: those over the budget are compressed first, which only joins blank lines, and then cut."""
    bare = F.regexp_replace("text", "[^0-9\n]+", "7")
    text = F.concat(bare, F.when(F.floor(F.char_length(bare) / 4) > 100, F.lit("9" * 400)).otherwise(""))
    return prose.prompt_budget(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", 100)


@query("prompt_replacement", f"select doc_id, case when doc_id % 2 = 0 and length(text) > 5 then '12345' else text end as prompt from ({_DIGITS})")
def prompt_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are replaced by a shorter form, and not by an empty one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^0-9\n]+", "7").alias("text"))
    after = F.when(F.col("doc_id") % 2 == 0, "12345").otherwise("")
    return rows.select("doc_id", prose.replaced_prompt(F.col("text"), after).alias("prompt"))


_NOTES = "select doc_id, case when doc_id % 2 = 0 then '<!-- tidemark:start -->' || repeat('x', 500) || '<!-- tidemark:end -->' || chr(10) else '' end || text as text, text as own from documents"


@query("memory_size_warning", f"select doc_id, 'NOTES.md is ~' || (strlen(own) // 4) || ' tokens (> 200 recommended)' as warning from ({_NOTES}) where strlen(own) // 4 > 200")
def memory_size_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes files that are too long, a block of ours at their begin not counted."""
    block = F.when(F.col("doc_id") % 2 == 0, "<!-- tidemark:start -->" + "x" * 500 + "<!-- tidemark:end -->\n").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(block, "text").alias("text"))
    return rows.select("doc_id", prose.memory_warning(F.col("text"), F.lit("NOTES.md"), 200).alias("warning")).where("warning is not null")


@query("prose_safe")
def prose_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed texts, and the texts themselves where compression isn't safe."""
    return prose.safely_compressed(markdown(spark, sf_dir), "text", ultra=True).select("doc_id", F.col("out").alias("text"), "safe")


@query("prose_compress_pt")
def prose_compress_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the Portuguese word lists, in full."""
    return markdown(spark, sf_dir).select("doc_id", prose.compressed(F.col("text"), "pt-BR", ultra=True).alias("text"))


@query("spawn_line_strip", f"select k as doc_id, n, line from ({_MD_LINES}) where not contains(line, 'Agent(Explore)') and not contains(line, 'Agent(Plan)') and not contains(line, 'Sub-agent')")
def spawn_line_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines without those of spawned agents."""
    lines = L.to_lines(markdown(spark, sf_dir), "doc_id")
    return lines.where(~X.has_any(F.col("line"), ("Agent(Explore)", "Agent(Plan)", "Sub-agent")))

