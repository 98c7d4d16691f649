"""Session analytics: event logs to summaries, and queries over their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X


def last_calls(calls: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """The last calls of each session, newest first by ``rank``."""
    newest = Window.partitionBy(session).orderBy(F.col(order).desc())
    return calls.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most)


def files(touched: DataFrame, session: str, order: str, most: int = 256) -> DataFrame:
    """(session, path, first_seen, last_seen, access, rereads) of (session, order, path, access) rows; the ``most`` files seen last."""
    seen = touched.groupBy(session, "path").agg(
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.max_by("access", order).alias("access"), (F.count(F.lit(1)) - 1).alias("rereads")
    )
    newest = Window.partitionBy(session).orderBy(F.col("last_seen").desc(), F.col("path").desc())
    return seen.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """(key, values): the first distinct values in order of their first place.

    Values are reduced to their first place before they meet, and ranked before they are collected.
    """
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o", value))).where(F.col("_r") <= most)
    kept = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", value))).alias("_x"))
    return kept.select(key, F.transform("_x", lambda x: x[value]).alias("values"))


def outcomes(test: Column) -> tuple[Column, Column]:
    """Whether a test result says that all went well, or that something failed."""
    low = F.lower(test)
    ok = F.contains(low, F.lit("test result: ok")) | (F.contains(low, F.lit("ok")) & ~F.contains(low, F.lit("test result: failed")) & ~F.contains(low, F.lit(": failed")))
    bad = F.contains(low, F.lit("test result: failed")) | F.contains(low, F.lit("error"))
    return ok & ~bad, bad


#: Lists of a summary and how many values each keeps.
LISTS = {"investigated": 20, "errors_resolved": 128, "git_events": 64, "completed": 5, "next_steps": 5, "files_committed": 20}


def finalize(events: DataFrame, session: str, order: str) -> DataFrame:
    """One row per session of its command events (cmd, in_tk, out_tk, files, errors, git, test_summary, committed if there).

    Token sums, distinct files, errors and commits in order, the last test result, and what is completed, next and learned.
    The events are read once: each gives its values by list, and one value more that carries its sums. Values are reduced
    to their first place before they meet, and ranked before they are collected.
    """
    passed, failed = outcomes(F.col("test_summary"))
    quiet = F.size("errors") == 0
    cut = F.left("test_summary", F.lit(80))
    kind = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("list"), v.alias("value")))
    one = lambda name, condition, v: F.array(F.struct(F.when(condition, F.lit(name)).alias("list"), v.alias("value")))
    values = F.concat(
        F.array(F.struct(F.lit("").alias("list"), F.lit("").alias("value"))),
        kind("investigated", F.col("files")), kind("errors_resolved", F.col("errors")), kind("git_events", F.col("git")),
        one("completed", passed & (F.col("test_summary") != ""), cut),
        one("completed", quiet & F.col("cmd").rlike("cargo build|cargo check"), F.concat(F.lit("build OK: "), F.left("cmd", F.lit(30)))),
        one("completed", quiet & F.col("cmd").rlike("git push|git commit"), F.left("cmd", F.lit(60))),
        one("next_steps", failed, cut), *([kind("files_committed", F.col("committed"))] if "committed" in events.columns else []),
    )
    each = events.select(session, F.col(order).alias("_o"), "in_tk", "out_tk", "test_summary", F.explode(values).alias("_x")).select("*", "_x.list", "_x.value").where("list is not null and value is not null")
    own = F.col("list") == ""
    first = each.groupBy(session, "list", "value").agg(
        F.min("_o").alias("_o"), F.sum(F.when(own, F.col("in_tk"))).alias("_in"), F.sum(F.when(own, F.col("out_tk"))).alias("_out"),
        F.max_by("test_summary", F.when(own & (F.col("test_summary") != ""), F.col("_o"))).alias("_test"),
    )
    most = F.expr("case list " + " ".join(f"when '{name}' then {n}" for name, n in LISTS.items()) + " else 1 end")
    ranked = first.repartition(session).withColumn("_r", F.row_number().over(Window.partitionBy(session, "list").orderBy("_o", "value"))).where(F.col("_r") <= most)
    values = F.sort_array(F.collect_list(F.struct("list", "_r", "value")))
    sums = ranked.groupBy(session).agg(
        F.max("_in").alias("total_in"), F.max("_out").alias("total_out"), F.coalesce(F.max("_test"), F.lit("")).alias("test_summary"), values.alias("_x")
    ).withColumn("tokens_saved", F.greatest(F.col("total_in") - F.col("total_out"), F.lit(0)))
    listed = lambda name: F.transform(F.filter("_x", lambda x: x["list"] == name), lambda x: x["value"])
    sums = sums.select(session, "total_in", "total_out", "test_summary", "tokens_saved", *[listed(name).alias(name) for name in LISTS])
    learned = F.concat(F.transform(F.slice("errors_resolved", 1, 3), lambda e: F.left(e, F.lit(80))), F.transform("git_events", lambda g: F.concat(F.lit("git:"), F.left(g, F.lit(7)))))
    return sums.withColumn("learned", F.slice(learned, 1, 5))


def search(summaries: DataFrame, session: str, order: str, fields: list[str], query: str, sessions: int = 200, most: int | None = None) -> DataFrame:
    """(session, field, hit): of the newest sessions the first value of each field that holds the query, 80 characters.

    Fields are lists or strings. At most ``most`` hits, the newest sessions' first, by field in the order given.
    """
    newest = summaries.orderBy(F.col(order).desc(), F.col(session).desc()).limit(sessions)
    kinds = dict(summaries.dtypes)
    listed = [F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), (F.col(f) if kinds[f].startswith("array") else F.array(f)).alias("values")) for k, f in enumerate(fields)]
    each = newest.select(session, F.col(order).alias("_o"), F.explode(F.array(*listed)).alias("x")).select(session, "_o", "x.place", "x.field", "x.values")
    hits = F.filter("values", lambda v: F.contains(F.lower(v), F.lit(query.lower())))
    found = each.withColumn("hits", hits).where(F.size("hits") > 0)
    if most is not None:
        found = found.orderBy(F.col("_o").desc(), F.col(session).desc(), "place").limit(most)
    return found.select(session, "field", F.left(F.element_at("hits", 1), F.lit(80)).alias("hit"))


def file_history(summaries: DataFrame, session: str, touched: list[str], path: str, committed: str | None = None) -> DataFrame:
    """Sessions whose files, in any of the columns, hold the path, whatever its case; is_committed tells if they committed it."""
    holds = lambda c: F.exists(c, lambda f: F.contains(F.lower(f), F.lit(path.lower())))
    rows = summaries.withColumn("is_committed", holds(committed) if committed else F.lit(False))
    return rows.where(X.any_of([holds(c) for c in touched]) | F.col("is_committed"))


def display_line(date: Column, files: Column, commits: Column, pending: Column) -> Column:
    """One line about a session, from its date and the numbers of its files, commits and open steps."""
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    git = F.when(commits > 0, F.concat(F.lit(", "), many(commits, "commit"))).otherwise("")
    left = F.when(pending > 0, F.concat(F.lit(", "), pending.cast("string"), F.lit(" pending"))).otherwise("")
    return F.concat(F.lit("Prior session ("), date, F.lit("): "), many(files, "file"), git, left)


def counters(calls: DataFrame, session: str, order: str) -> DataFrame:
    """One row per session of its calls (tool, in_tk, out_tk, files, errors, git): what was seen, by the caps of its state, and tokens.

    Distinct values are counted by value first, so that no session's values are collected.
    """
    kind = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("list"), v.alias("value")))
    each = calls.select(session, F.explode(F.concat(kind("files", F.col("files")), kind("errors", F.col("errors")), kind("git", F.col("git")))).alias("x")).select(session, "x.*")
    values = each.groupBy(session, "list", "value").agg(F.count(F.lit(1)).alias("c")).groupBy(session).agg(
        *[F.least(F.count_if(F.col("list") == name), F.lit(cap)).alias(f"seen_{name}") for name, cap in (("files", 256), ("errors", 128), ("git", 64))],
        F.sum(F.when(F.col("list") == "files", F.col("c") - 1).otherwise(0)).alias("rereads"),
    )
    tools = {"bash": F.col("tool") == "bash", "read": F.col("tool") == "read", "grep": F.col("tool") == "grep", "other": ~F.col("tool").isin("bash", "read", "grep")}
    saved = F.greatest(F.col("in_tk") - F.col("out_tk"), F.lit(0))
    sums = calls.groupBy(session).agg(
        F.count(F.lit(1)).alias("calls"), F.least(F.count(F.lit(1)), F.lit(32)).alias("calls_logged"), *[F.sum(F.when(test, F.col("in_tk")).otherwise(0)).alias(f"tokens_{name}") for name, test in tools.items()],
        F.sum("out_tk").alias("total_tokens"), F.sum(saved).alias("tokens_saved"), F.min(order).alias("started"),
    )
    rows = sums.join(values, session, "left").fillna(0, ["seen_files", "seen_errors", "seen_git", "rereads"])
    return rows.withColumn("compression_pct", F.coalesce(F.expr("tokens_saved * 100 div nullif(total_tokens + tokens_saved, 0)"), F.lit(0).cast("long")))


def stats(calls: DataFrame, session: str) -> DataFrame:
    """Per session how often calls (hit_kind, summarized, tier, tool, saved) repeated others, were summarized or came under pressure."""
    own = lambda tool: F.sum(F.when(F.col("tool") == tool, F.col("saved")).otherwise(0))
    return calls.groupBy(session).agg(
        F.count_if(F.col("hit_kind") == "exact").alias("exact_hits"), F.count_if(F.col("hit_kind") == "similar").alias("similar_hits"), F.count_if("summarized").alias("summarized"),
        F.count_if(F.col("tier") == "ultra").alias("ultra_calls"), own("bash").alias("saved_bash"), own("read").alias("saved_read"),
        F.sum(F.when(~F.col("tool").isin("bash", "read"), F.col("saved")).otherwise(0)).alias("saved_other"), F.count(F.lit(1)).alias("calls"),
    )


def detail(events: DataFrame, day: str, session: str, order: str, most_bytes: int = 2048) -> DataFrame:
    """(day, text): what happened on each day, from events (path, error, git, test, null where there is none).

    Numbers of sessions, events and files (64 at most), the first 5 different errors, 5 commits and 3 test results; a long
    text keeps its first 1800 and last 200 characters.
    """
    sums = events.groupBy(day).agg(F.count_distinct(session).alias("n_sessions"), F.count(F.lit(1)).alias("n_events"), F.least(F.count_distinct("path"), F.lit(64)).alias("n_files"))
    none = F.array().cast("array<string>")

    def firsts(name: str, most: int, width: int, different: bool) -> DataFrame:
        rows = events.where(F.col(name).isNotNull()).select(day, F.col(order).alias("_o"), F.left(name, F.lit(width)).alias("_v"))
        rows = rows.groupBy(day, "_v").agg(F.min("_o").alias("_o")) if different else rows
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(day).orderBy("_o", "_v"))).where(F.col("_r") <= most)
        return ranked.groupBy(day).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(f"_{name}"))

    for name, most, width, different in (("error", 5, 100, True), ("git", 5, 80, False), ("test", 3, 80, False)):
        sums = sums.join(firsts(name, most, width, different), day, "left")
    block = lambda title, c: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.array(F.lit(title)), F.transform(c, lambda v: F.concat(F.lit("  "), v)))).otherwise(none)
    head = F.array(F.format_string("date=%s sessions=%d", F.col(day), F.col("n_sessions")), F.format_string("events=%d files=%d", F.col("n_events"), F.col("n_files")))
    text = F.concat(F.array_join(F.concat(head, block("errors:", F.col("_error")), block("git_events:", F.col("_git")), block("test_results:", F.col("_test"))), "\n"), F.lit("\n"))
    made = sums.select(day, F.explode(F.array(text)).alias("text"))
    cut = F.concat(F.left("text", F.lit(1800)), F.lit("\n[truncated]\n"), F.right("text", F.lit(200)))
    return made.withColumn("text", F.when(F.octet_length("text") > most_bytes, cut).otherwise(F.col("text")))


def capped(rows: DataFrame, session: str, value: str, order: str, most: int) -> DataFrame:
    """(session, value, first_seen): of a session's different values the ``most`` that came last; older ones have dropped out."""
    first = rows.groupBy(session, value).agg(F.min(order).alias("first_seen"))
    newest = Window.partitionBy(session).orderBy(F.col("first_seen").desc(), F.col(value).desc())
    return first.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")


def unseen(incoming: DataFrame, history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows whose keys history lacks, the first of each."""
    first = incoming.join(history.select(keys).distinct(), keys, "left_anti").groupBy(keys).agg(F.min(order).alias(order))
    return incoming.join(first, [*keys, order], "left_semi")


def retained(summaries: DataFrame, now: Column, days: int) -> DataFrame:
    """Summaries whose end, or else start, is not older than ``days``; such without either stay."""
    effective = F.when(F.col("valid_to") != 0, F.col("valid_to")).otherwise(F.col("ts"))
    return summaries.where((effective == 0) | (effective >= now - days * 86_400))


def valid_at(summaries: DataFrame, at: Column) -> DataFrame:
    """Summaries valid at a time: from valid_from on, before valid_to unless that is 0."""
    return summaries.where((F.col("valid_from") <= at) & ((F.col("valid_to") == 0) | (at < F.col("valid_to"))))


def states(calls: DataFrame, session: str, order: str, warned: Column) -> DataFrame:
    """After each call (in_tk, out_tk) the state of its session: running totals and whether it was warned."""
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.select(
        session, order, F.sum("out_tk").over(upto).cast("long").alias("total_tokens"), F.sum(F.greatest(F.col("in_tk") - F.col("out_tk"), F.lit(0))).over(upto).cast("long").alias("tokens_saved"),
        F.count(F.lit(1)).over(upto).alias("total_calls"), F.max(warned).over(upto).alias("compact_warned"), F.min(order).over(upto).alias("start_ts"),
    )


def newest_state(log: DataFrame, session: str, order: str) -> DataFrame:
    """The newest of each session's appended states; partial aggregates, no sort."""
    rest = [c for c in log.columns if c not in (session, order)]
    return log.groupBy(session).agg(F.max_by(F.struct(*rest), order).alias("x")).select(session, "x.*")


def committed_less(touched: DataFrame, status: DataFrame, keys: list[str], path: str, line: str) -> DataFrame:
    """Rows of ``touched`` whose path ends no line of ``status`` with the same keys.

    A line's endings are its own rows, so that the anti-join is one of equals and no session's paths meet all its lines.
    """
    ends = F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.substring(line, i, F.length(line)))
    endings = status.where(F.length(line) > 0).select(*keys, F.explode(ends).alias(path)).distinct()
    return touched.join(endings, [*keys, path], "left_anti")
