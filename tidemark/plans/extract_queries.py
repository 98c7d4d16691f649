"""Queries of extraction, summaries, similarity and redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions import text as X
from tidemark.operators import extract, similarity
from tidemark.plans import oracle as O
from tidemark.plans import stated as V
from tidemark.plans.fixtures import command_sql, event_lines, event_lines_sql, table
from tidemark.registry import query

#: pages as words: html with tags' brackets and quotes turned into spaces
_WORDS = "select page_id, translate(html, '<>\"=', '    ') as text from pages"
_TOKENS = f"list_filter(string_split_regex(text, '[{O.WS}]+'), lambda w: w <> '')"
_BARE = f"list_transform({_TOKENS}, lambda w: regexp_replace(regexp_replace(w, '^[,:()''\"]+', ''), '[,:()''\"]+$', ''))"
_PATH = "contains(w, '/') and contains(w, '.') and not starts_with(w, 'http') and not starts_with(w, '//') and strlen(w) > 4 and strlen(w) < 160 and regexp_full_match(w, '[\\p{L}\\p{N}/_.:-]+')"
#: list_distinct doesn't keep the order, so places are compared
def _paths_sql(key: str, source: str) -> str:
    return f"select {key}, w, min(i) as first_n from (select {key}, ws[i] as w, i from (select {key}, {_BARE} as ws from ({source})), unnest(range(1, len(ws) + 1)) as t(i)) where {_PATH} group by {key}, w"


@query("extract_paths", f"select page_id, array_to_string(list(w order by first_n)[:100], ' ') as paths, least(count(*), 100)::int as n_paths from ({_paths_sql('page_id', _WORDS)}) group by page_id")
def extract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at least one path among the words of their html."""
    found = table(spark, sf_dir, "pages").select("page_id", X.paths(F.translate("html", '<>"=', "    ")).alias("p"))
    return found.where(F.size("p") > 0).select("page_id", F.array_join("p", " ").alias("paths"), F.size("p").alias("n_paths"))


@query("extract_urls", "select page_id, regexp_extract_all(url || ' ' || html, 'https?://[^\\s)\\]\">]+')[1] as first_url, len(regexp_extract_all(url || ' ' || html, 'https?://[^\\s)\\]\">]+'))::int as n_urls from pages")
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.regexp_extract_all(F.concat("url", F.lit(" "), "html"), F.lit('https?://[^\\s)\\]">]+'), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(urls, F.lit(1)).alias("first_url"), F.size(urls).alias("n_urls"))


#: sessions' output as one text
_OUTPUT = f"select k, string_agg(line, chr(10) order by n) as text from ({event_lines_sql()}) group by k"


_ERRORS = f"select k, array_to_string(list(left({O.trim('line')}, 120) order by n)[:3], '|') as errors from ({event_lines_sql()}) where {O.starts(O.ltrim('line'), V.ERROR_STARTS)} group by k"


@query("extract_errors", _ERRORS)
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.errors(event_lines(spark, sf_dir), "k").withColumn("errors", F.array_join("errors", "|"))


_RESULT = "starts_with(t, 'test result:') or (contains(t, ' passed') and contains(t, ' failed')) or starts_with(t, 'PASSED') or starts_with(t, 'FAILED')"


@query("test_summary", f"select k, coalesce(left(arg_min(t, n) filter (where {_RESULT}), 80), '') as test_summary from (select *, {O.trim('line')} as t from ({event_lines_sql()})) group by k")
def test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.test_summary(event_lines(spark, sf_dir), "k")


@query("git_events", f"select k, array_to_string(list(left(t, 100) order by n)[:5], '|') as events from (select *, {O.trim('line')} as t from ({event_lines_sql()})) where regexp_matches(t, '^[0-9a-fA-F]{{7}}') and k % 4 <> 3 group by k")
def git_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all sessions, git's under several names; only its output has commits."""
    cmd = F.element_at(F.array(F.lit("git log"), F.lit("/usr/bin/git show"), F.lit("  git status"), F.lit("gitk")), (F.col("k") % 4 + 1).cast("int"))
    return extract.git_events(event_lines(spark, sf_dir).withColumn("cmd", cmd), "k").withColumn("events", F.array_join("events", "|"))


_COMMANDS = f"select conv_id, turn, {command_sql('(conv_id * 7 + turn)')} || case turn % 4 when 0 then ' > out.txt' when 1 then ' -n 5 src/main.rs' when 2 then ' -f lib/x.py' else '' end as cmd from conversations"
_FIRST = "regexp_extract(cmd, '^([^ ]*/)?([^ /]*)', 2)"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(F.lit(" > out.txt"), F.lit(" -n 5 src/main.rs"), F.lit(" -f lib/x.py"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.expr(command_sql("(conv_id * 7 + turn)")), more).alias("cmd"))


@query("file_access", f"""
select conv_id, turn, cmd, case when {_FIRST} in ('rm', 'unlink', 'rmdir') then 'Deleted' when {_FIRST} = 'tee' then 'Write' when {_FIRST} in ('cat', 'head', 'tail', 'less', 'more', 'bat') then 'Read'
  when contains(cmd, ' > ') or contains(cmd, ' >> ') then 'Write' else 'Read' end as access,
  regexp_matches(split_part(cmd, ' ', 1), 'tail|docker|kubectl') and regexp_matches(cmd, ' (-f|--follow)( |$)') as streaming from ({_COMMANDS})
""")
def file_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cmd")
    return commands(spark, sf_dir).select("conv_id", "turn", "cmd", extract.access_type(c).alias("access"), extract.is_streaming(c).alias("streaming"))


@query("viewed_files", f"""
select conv_id, turn, path, case regexp_extract(path, '\\.([^./]+)$', 1) when 'rs' then 'rust' when 'py' then 'python' end as lang
from (select conv_id, turn, case when starts_with(cmd, 'cat ') or starts_with(cmd, 'tail ') then regexp_extract(regexp_replace(cmd, ' -(n 5|f)', '', 'g'), '^[a-z]+ +([^ ]+)', 1) end as path from ({_COMMANDS})) where path is not null
""")
def viewed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, lang = extract.viewed_file(F.col("cmd"))
    return commands(spark, sf_dir).select("conv_id", "turn", path.alias("path"), lang.alias("lang")).where("path is not null")


@query("summarize_trigger", f"select k, count(*) as total, not bool_or({O.has('line', V.ERROR_MARKERS)}) as benign, count(*) > case when not bool_or({O.has('line', V.ERROR_MARKERS)}) then 400 else 200 end as summarize from ({event_lines_sql()}) group by k")
def summarize_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.summary_trigger(event_lines(spark, sf_dir), "k", 200)


_SESSION_PATHS = f"select k, count(*) as n, list(w order by first_n)[:5] as top from ({_paths_sql('k', _OUTPUT)}) group by k"
_FIELDS = f"""
select o.k, 'cmd ' || o.k as cmd, len(string_split(o.text, chr(10)))::int as total, least(coalesce(p.n, 0), 100)::int as unique_files, coalesce(e.errors, '') as top_errors, coalesce(array_to_string(p.top, '|'), '') as top_files,
  s.test_summary, least(20, len(string_split(o.text, chr(10))))::int as tail_preserved
from ({_OUTPUT}) o left join ({_SESSION_PATHS}) p using (k) left join ({_ERRORS}) e using (k)
join (select k, coalesce(left(arg_min(t, n) filter (where {_RESULT}), 80), '') as test_summary from (select *, {O.trim('line')} as t from ({event_lines_sql()})) group by k) s using (k)
"""


def _cmd():
    return F.concat(F.lit("cmd "), F.col("k").cast("string"))


@query("summary_fields", _FIELDS)
def summary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.summary_fields(event_lines(spark, sf_dir), "k", _cmd(), 20)
    return found.withColumn("top_errors", F.array_join("top_errors", "|")).withColumn("top_files", F.array_join("top_files", "|"))


_PROSE = f"""
with f as ({_FIELDS}), rows as (
  select k, 1 as s, 0 as i, 'summary cmd=' || cmd as line from f union all select k, 2, 0, 'total_lines=' || total from f union all select k, 3, 0, 'unique_files=' || unique_files from f
  union all select k, 4, 0, 'top_errors:' from f where top_errors <> ''
  union all select k, 4, i, '  - ' || xs[i] from (select k, string_split(top_errors, '|') as xs from f where top_errors <> ''), unnest(range(1, len(xs) + 1)) as t(i)
  union all select k, 5, 0, 'top_files:' from f where top_files <> ''
  union all select k, 5, i, '  - ' || xs[i] from (select k, string_split(top_files, '|') as xs from f where top_files <> ''), unnest(range(1, len(xs) + 1)) as t(i)
  union all select k, 6, 0, 'test_summary=' || test_summary from f where test_summary <> '' union all select k, 7, 0, 'tail_preserved=' || tail_preserved from f
  union all select k, 8, n, line from (select *, row_number() over (partition by k order by n desc) as r from ({event_lines_sql()})) where r <= 20
) select k, row_number() over (partition by k order by s, i) as n, line from rows
"""


@query("summary_prose", _PROSE)
def summary_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prose_summary(event_lines(spark, sf_dir), "k", _cmd())


@query("summary_structured", f"select k, 'summary' as kind, cmd, total, case when top_files = '' then 0 else len(string_split(top_files, '|')) end::int as n_files, top_errors as errors, test_summary as test, least(5, total)::int as tail from ({_FIELDS})")
def summary_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON summary, read back by its schema."""
    made = extract.structured(extract.summary_fields(event_lines(spark, sf_dir), "k", _cmd(), 5), "k")
    parsed = made.select("k", F.from_json("summary", "kind string, cmd string, total int, files array<string>, errors array<string>, test string, tail int").alias("s"))
    return parsed.select("k", "s.kind", "s.cmd", "s.total", F.size("s.files").alias("n_files"), F.array_join("s.errors", "|").alias("errors"), "s.test", "s.tail")


_JSON = "'{\"kind\":\"summary\",\"cmd\":\"' || cmd || '\",\"total\":' || total || ',\"files\":' || to_json(case when top_files = '' then [] else string_split(top_files, '|') end)::varchar || ',\"errors\":' || to_json(case when top_errors = '' then [] else string_split(top_errors, '|') end)::varchar || ',\"test\":\"' || test_summary || '\",\"tail\":' || least(5, total) || '}'"


@query("summary_auto", f"""
with f as ({_FIELDS}), brief as (select k, 1 as n, {_JSON} as line from f where k % 3 = 0 union all
  select k, least(5, c) - r + 2, line from (select *, row_number() over (partition by k order by n desc) as r, count(*) over (partition by k) as c from ({event_lines_sql()})) where r <= 5 and k % 3 = 0)
select k, n, line from brief union all select k, n, line from ({_PROSE}) where k % 3 <> 0
""")
def summary_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as the session's tier asks for: brief ones under pressure, with the last lines after them."""
    lines = event_lines(spark, sf_dir)
    tiers = lines.select("k", F.when(F.col("k") % 3 == 0, "ultra").otherwise("full").alias("tier")).distinct()
    return extract.auto_summary(lines, "k", _cmd(), tiers)


_SHAPE = f"left(regexp_replace(regexp_replace(regexp_replace(lower({O.trim('line')}), '/[^{O.WS}\"]+', 'PATH', 'g'), '[a-f][0-9a-f]{{5,}}', 'HEX', 'g'), '[0-9]+', 'N', 'g'), 200)"


@query("normalize_error", f"select k, n, {_SHAPE} as shape from ({event_lines_sql()})")
def normalize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("k", "n", X.normalize_error(F.col("line")).alias("shape"))


@query("error_fingerprints", f"""
select k, md5(shape) as fp, replace(left(arg_min(line, n), 128), '[', '(') as snippet, min(n) as first_n from (select *, {_SHAPE} as shape from ({event_lines_sql()}) where {O.has('line', V.ERROR_MARKERS)}) group by k, shape
""")
def error_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.distinct_errors(event_lines(spark, sf_dir).where(X.has_error_marker(F.col("line"))), "k")


_ALONE = " or ".join(f"(regexp_matches(l, '{w}') and regexp_matches(l, '^(.*?[^a-z0-9])?{w}([^a-z0-9]|$)') and not regexp_matches(split_part(l, '{w}', 1), '[a-z0-9]$') and not regexp_matches(l[position('{w}' in l) + {len(w)}:], '^[a-z0-9]'))" for w in V.DIAGNOSTIC)
_TERMS = f"""
select distinct k, term from (select k, lower(regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}/._:\\[]+', ''), '[^\\p{{L}}\\p{{N}}/._:\\[]+$', '')) as term
  from (select k, unnest(list_filter(string_split_regex(line, '[{O.WS}]+'), lambda w: w <> '')) as w from (select *, lower(line) as l, {O.trim('line')} as t from ({event_lines_sql()}))
  where not (not contains(t, ' ') and (starts_with(t, './') or starts_with(t, '/'))) and ({_ALONE})))
where strlen(term) >= 4 and not regexp_full_match(term, '[0-9]+') and term not in ({', '.join(map(O.quoted, V.STOP))})
"""


@query("signal_terms", _TERMS)
def signal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.signal_terms(event_lines(spark, sf_dir), "k")


_SHORT = f"select k, string_agg(line, chr(10) order by n) as text from ({event_lines_sql()}) where n % 3 <> 0 group by k"


def _quality_sql(share: str) -> str:
    return f"""
    select k, count(term) as n_terms, round({share}, 6)::double as score, {share} >= 0.5 as passed from ({_SHORT}) left join ({_TERMS}) using (k) group by k
    """


_SHARE = "case when max(length(text)) = 0 then 0 when count(term) = 0 then 1 else sum(contains(lower(text), term)::int)::double / count(term) end"


@query("quality_score", _quality_sql(_SHARE))
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a session's signal terms when every third line is dropped."""
    lines = event_lines(spark, sf_dir)
    return extract.quality(extract.signal_terms(lines, "k"), lines.where("n % 3 <> 0"), "k")


_KEYWORDS = ("error TS2345", "user")
_LACKS = " or ".join(f"not contains(any_value(text), {O.quoted(w)})" for w in _KEYWORDS)


@query("quality_required", _quality_sql(f"case when {_LACKS} then 0 else {_SHARE} end"))
def quality_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As quality_score, 0 where a keyword is missing."""
    lines = event_lines(spark, sf_dir)
    return extract.quality(extract.signal_terms(lines, "k"), lines.where("n % 3 <> 0"), "k", _KEYWORDS)


@query("quality_keywords", _quality_sql(f"case when max(length(text)) = 0 or {_LACKS} then 0 else 1 end"))
def quality_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only whether all keywords are left."""
    lines = event_lines(spark, sf_dir)
    return extract.quality(extract.signal_terms(lines, "k"), lines.where("n % 3 <> 0"), "k", _KEYWORDS, "keywords")


_OCTETS = "list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || hex(array_slice(encode(text), i, i)))::utinyint::uhugeint)"


@query("fnv_fingerprint", f"""
select item_id, strlen(text)::int as n_bytes, list_reduce(list_prepend(14695981039346656037::uhugeint, {_OCTETS}), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::varchar as fnv from benchmark
""")
def fnv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of each whole passage, as a decimal number, with the passage's bytes."""
    high = lambda h: F.conv(h, 16, 10)
    return table(spark, sf_dir, "benchmark").select("item_id", F.octet_length("text").alias("n_bytes"), high(hashing.fnv1a_long(F.col("text"))).alias("fnv"))


def _grams_sql(key: str, source: str) -> str:
    return f"select {key}, md5(array_to_string(ws[i:i + 2], ' ')) as h from (select {key}, list_filter(string_split_regex(text, '[{O.WS}]+'), lambda w: w <> '') as ws from {source}), unnest(range(1, len(ws) - 1)) as t(i)"


def _fnv_sql(octets: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::uhugeint, {octets}), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"


def _octets_sql(text: str) -> str:
    return f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || hex(array_slice(encode({text}), i, i)))::utinyint::uhugeint)"


def _hex_sql(number: str) -> str:
    return f"lower(lpad(hex(({number})::ubigint), 16, '0'))"


def _sketch_sql(key: str, source: str) -> str:
    """(key, sketch): hashes as 16 hex digits."""
    runs = f"select distinct {key}, array_to_string(ws[i:i + 2], ' ') as g from (select {key}, list_filter(string_split_regex(text, '[{O.WS}]+'), lambda w: w <> '') as ws from {source}), unnest(range(1, len(ws) - 1)) as t(i)"
    hashed = f"select g, {_hex_sql(_fnv_sql('os'))} as h from (select g, {_octets_sql('g')} as os from (select distinct g from ({runs})))"
    return f"select {key}, list(distinct h order by h)[:96] as sketch from ({runs}) join ({hashed}) using (g) group by {key}"


@query("shingle_sketch", f"select doc_id, len(sketch)::int as n, sketch[1] as lowest, md5(array_to_string(sketch, ',')) as digest from ({_sketch_sql('doc_id', 'documents')})")
def shingle_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = similarity.sketches(table(spark, sf_dir, "documents"), "doc_id").where(F.size("sketch") > 0)
    return made.select("doc_id", F.size("sketch").alias("n"), hashing.hex_of(F.element_at("sketch", 1)).alias("lowest"), F.md5(F.array_join(F.transform("sketch", hashing.hex_of), ",")).alias("digest"))


_OUTS = r"select conv_id, turn, array_to_string(string_split_regex(regexp_replace(t, '\r?\n\z', ''), '\r?\n'), chr(10)) as j from (select conv_id, turn, text || chr(13) || chr(10) || role || chr(10) as t from conversations)"


@query("output_fingerprint", f"select conv_id, turn, {_hex_sql(_fnv_sql(_octets_sql('j')))} as fp, left({_hex_sql(_fnv_sql(_octets_sql('j')))}, 8) as short_hash, strlen(j)::bigint as n_bytes from ({_OUTS})")
def output_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of outputs, which don't depend on how lines end."""
    text = F.concat("text", F.lit("\r\n"), "role", F.lit("\n"))
    return similarity.fingerprints(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")), "text").drop("text")


def _pairs_sql(source: str, least: float) -> str:
    return f"""
    select a, b, i::float / (x + y - i)::float as similarity from (
      select a.id as a, b.id as b, any_value(a.n) as x, any_value(b.n) as y, count(*) as i
      from (select id, len(sketch) as n, unnest(sketch) as h from ({source})) a join (select id, len(sketch) as n, unnest(sketch) as h from ({source})) b on a.h = b.h and a.id < b.id group by 1, 2)
    where i::float / (x + y - i)::float >= {least}::float
    """


_REPS = f"select min(doc_id) as id, sketch from ({_sketch_sql('doc_id', 'documents')}) group by sketch"


@query("near_dup_documents", f"select a, b, round(similarity::double, 4)::double as similarity from ({_pairs_sql(_REPS, 0.85)})")
def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of representatives: the smallest doc_id of each class of equal sketches (see exact_dup_documents)."""
    made = similarity.sketches(table(spark, sf_dir, "documents"), "doc_id").where(F.size("sketch") > 0)
    reps = made.groupBy("sketch").agg(F.min("doc_id").alias("doc_id"))
    return similarity.similar_pairs(reps, "doc_id").select("a", "b", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


@query("exact_dup_documents", "select doc_id, first_id, n from (select doc_id, min(doc_id) over (partition by text) as first_id, count(*) over (partition by text) as n from documents) where n > 1")
def exact_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in classes of equal texts, by hash and length; classes are counted before they are joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size"))
    classes = docs.groupBy("h", "size").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(classes, ["h", "size"]).select("doc_id", "first_id", "n")


@query("jaccard_pairs", f"select a, b, round(similarity::double, 4)::double as similarity from ({_pairs_sql(_REPS, 0.6)})")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As near_dup_documents, from a similarity of six tenths on."""
    made = similarity.sketches(table(spark, sf_dir, "documents"), "doc_id").where(F.size("sketch") > 0)
    reps = made.groupBy("sketch").agg(F.min("doc_id").alias("doc_id"))
    return similarity.similar_pairs(reps, "doc_id", 0.6).select("a", "b", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


@query("benchmark_overlap", f"""
select d.doc_id, b.item_id, count(*)::int as shared from (select distinct * from ({_grams_sql('doc_id', 'documents')})) d
join (select distinct * from ({_grams_sql('item_id', 'benchmark')})) b on d.h = b.h group by all having count(*) >= 8
""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share eight trigrams or more with a known passage; only trigrams of passages are shuffled."""
    grams = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(X.trigrams(F.col("text"))).alias("g"))
    shared = grams("documents", "doc_id").join(grams("benchmark", "item_id"), "g")
    return shared.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).cast("int").alias("shared")).where("shared >= 8")


#: calls in which each conversation repeats what it said a few turns before
_CALLS = "select conv_id * 8 + turn % 2 as session, conv_id * 100 + turn as call, case when turn % 4 = 3 then repeat('line one two ' || conv_id || chr(10) || 'more words here ' || chr(10), 4) else repeat(text || chr(10), 6) end as text from conversations"


def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.expr("repeat(concat('line one two ', cast(conv_id as string), chr(10), 'more words here ', chr(10)), 4)")
    text = F.when(F.col("turn") % 4 == 3, odd).otherwise(F.expr("repeat(concat(text, chr(10)), 6)"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 8 + F.col("turn") % 2).alias("session"), (F.col("conv_id") * 100 + F.col("turn")).alias("call"), text.alias("text"))


@query("redundancy_window_exact", f"""
select n.session, n.call, min(o.call) as ref from (select *, row_number() over (partition by session order by call) as i from ({_CALLS})) n
join (select *, row_number() over (partition by session order by call) as i from ({_CALLS})) o on o.session = n.session and o.text = n.text and o.i < n.i and o.i >= n.i - 16 group by n.session, n.call
""")
def redundancy_window_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_repeats(repeated_calls(spark, sf_dir), "session", "call", "text")


_NUMBERED = f"select c.*, s.sketch, row_number() over (partition by session order by c.call) as i from ({_CALLS}) c left join ({_sketch_sql('call', '(' + _CALLS + ')')}) s using (call)"
_SHARED = "len(list_intersect(n.sketch, o.sketch))"


@query("redundancy_window_fuzzy", f"""
select session, call, ref, round(similarity::double, 4)::double as similarity from (
  select *, row_number() over (partition by session, call order by similarity desc, j) as r from (
    select n.session, n.call, o.call as ref, o.i as j, {_SHARED}::float / (len(n.sketch) + len(o.sketch) - {_SHARED})::float as similarity
    from ({_NUMBERED}) n join ({_NUMBERED}) o on o.session = n.session and o.i < n.i and o.i >= n.i - 16
    where least(strlen(n.text), strlen(o.text))::float / greatest(strlen(n.text), strlen(o.text))::float >= 0.8::float and len(n.sketch) > 0 and len(o.sketch) > 0)
  where similarity >= 0.85::float) where r = 1
""")
def redundancy_window_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.similar_repeats(repeated_calls(spark, sf_dir), "session", "call", "text")
    return found.withColumn("similarity", F.round(F.col("similarity").cast("double"), 4))


@query("redundancy_fold")
def redundancy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent: hits are not recorded. Tested against a plain loop."""
    return similarity.redundancy_fold(repeated_calls(spark, sf_dir), "session", "call", "text")
