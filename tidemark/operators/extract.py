"""Extraction from output: paths, errors, test results, commits; summaries and their trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Config
from tidemark.functions import text as X
from tidemark.sources.events import result_content


def first_lines(lines: DataFrame, key: str, value: Column, name: str, most: int) -> DataFrame:
    """(key, name): the values of the first ``most`` lines, in order. Lines are ranked before they are collected."""
    ranked = lines.select(key, "n", value.alias("_v")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("n"))).where(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(name))


def errors(lines: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, errors): the first lines that begin as errors do, 120 characters of each; texts with one at least."""
    hits = lines.where(X.starts_any(X.ltrim(F.col("line")), X.ERROR_STARTS))
    return first_lines(hits, key, F.left(X.trim(F.col("line")), F.lit(120)), "errors", most)


def _is_test_result(line: Column) -> Column:
    return line.startswith("test result:") | (F.contains(line, F.lit(" passed")) & F.contains(line, F.lit(" failed"))) | line.startswith("PASSED") | line.startswith("FAILED")


def test_summary(lines: DataFrame, key: str) -> DataFrame:
    """(key, test_summary): the first line that tells a test run's result, 80 characters; empty without one."""
    t = X.trim(F.col("line"))
    return lines.groupBy(key).agg(F.coalesce(F.min_by(F.left(t, F.lit(80)), F.when(_is_test_result(t), F.col("n"))), F.lit("")).alias("test_summary"))


def is_git(cmd: Column) -> Column:
    return F.regexp_extract(X.ltrim(cmd), f"^([^{X.WS}]*)", 1).rlike("(^|/)git$")


def git_events(lines: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, events): of the output of git commands (``cmd``) the first lines that begin with a short commit id."""
    t = X.trim(F.col("line"))
    return first_lines(lines.where(is_git(F.col("cmd")) & t.rlike("^[0-9a-fA-F]{7}")), key, F.left(t, F.lit(100)), "events", most)


def line_paths(lines: DataFrame, key: str, most: int = 100) -> DataFrame:
    """(key, path, place): the first distinct paths of a text's lines, place from 1."""
    words = lines.select(key, "n", F.posexplode(X.tokens(F.col("line"))).alias("_p", "path"))
    bare = words.withColumn("path", F.regexp_replace("path", "^[,:()'\"]+|[,:()'\"]+$", "")).where(X.looks_like_path(F.col("path")))
    first = bare.groupBy(key, "path").agg(F.min(F.struct("n", "_p")).alias("_o"))
    return first.select(key, "path", F.row_number().over(Window.partitionBy(key).orderBy("_o")).alias("place")).where(F.col("place") <= most)


def access_type(cmd: Column) -> Column:
    """What a command does to the files that it names: Deleted, Write or Read."""
    name = F.regexp_extract(F.regexp_extract(X.ltrim(cmd), f"^([^{X.WS}]*)", 1), "([^/]*)$", 1)
    return (
        F.when(name.isin("rm", "unlink", "rmdir"), "Deleted").when(name == "tee", "Write").when(name.isin("cat", "head", "tail", "less", "more", "bat"), "Read")
        .when(F.contains(cmd, F.lit(" > ")) | F.contains(cmd, F.lit(" >> ")), "Write").otherwise("Read")
    )


# Languages by the extension of a viewed file.
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyw"), "ts": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "go": ("go",), "java": ("java",), "ruby": ("rb",),
    "kotlin": ("kt", "kts"), "swift": ("swift",), "c": ("c", "cc", "cpp", "cxx", "h", "hpp", "hxx"),
}


def viewed_file(cmd: Column) -> tuple[Column, Column]:
    """The file that a viewer command shows, and the language of its code; null for other commands and extensions."""
    path = viewed_path(cmd)
    kind = F.regexp_extract(path, "[^/.][^/]*\\.([^./]+)$", 1)
    lang = F.lit(None).cast("string")
    for language, kinds in LANGUAGES.items():
        lang = F.when(kind.isin(*kinds), language).otherwise(lang)
    return path, lang


def viewed_path(cmd: Column) -> Column:
    name = X.command_name(cmd)
    rest = F.regexp_replace(X.trim(cmd), f"^[^{X.WS}]+[{X.WS}]*", "")
    # a count's number goes with its flag
    bare = F.regexp_replace(rest, f"(?:^|(?<=[{X.WS}]))-[nc][{X.WS}]+[^{X.WS}]+[{X.WS}]*", "")
    path = F.element_at(F.filter(X.tokens(bare), lambda t: ~t.startswith("-")), 1)
    return F.when(name.isin("cat", "head", "tail", "less", "more", "bat") & (F.size(F.filter(X.tokens(bare), lambda t: ~t.startswith("-"))) > 0), path)


def markdown_target(cmd: Column) -> Column:
    """The Markdown file that a viewer command shows."""
    path = viewed_path(cmd)
    return F.when(F.lower(F.regexp_extract(path, "[^/.][^/]*\\.([^./]+)$", 1)) == "md", path)


def view_mode(cmd: Column, n_lines: Column, config: Config) -> Column:
    """How a file system command's output is shown: by signatures, as compressed Markdown, or by the handler's rule."""
    _, lang = viewed_file(cmd)
    out = F.lit("rule")
    if config.auto_compress_md:
        out = F.when(markdown_target(cmd).isNotNull(), "markdown").otherwise(out)
    return F.when(lang.isNotNull() & (n_lines >= config.sig_mode_threshold_lines), "signatures").otherwise(out) if config.sig_mode_enabled else out


def tracked(results: DataFrame, session: str, order: str, json: str) -> DataFrame:
    """(session, call_n, files, errors, tokens) of tool results as JSON: given files first, then those named in the content."""
    rows = results.withColumn("call_n", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))
    rows = rows.withColumn("_c", F.explode(F.array(F.coalesce(result_content(F.col(json)), F.lit("")))))
    given = F.array_compact(F.array(F.get_json_object(json, "$.tool_input.file_path"), F.get_json_object(json, "$.tool_input.path")))
    hits = F.filter(X.lines(F.col("_c")), lambda line: X.starts_any(X.ltrim(line), X.ERROR_STARTS))
    errors_ = F.transform(F.slice(hits, 1, 3), lambda line: F.left(X.trim(line), F.lit(120)))
    return rows.select(session, "call_n", F.array_distinct(F.concat(given, X.paths(F.col("_c")))).alias("files"), errors_.alias("errors"), F.floor(F.octet_length("_c") / 4).alias("tokens"))


def is_streaming(cmd: Column) -> Column:
    """Commands that follow their input."""
    words = X.tokens(cmd)
    first = F.element_at(words, 1)
    return F.coalesce(X.has_any(first, ("tail", "docker", "kubectl")) & F.arrays_overlap(words, F.array(F.lit("-f"), F.lit("--follow"))), F.lit(False))


def summary_trigger(lines: DataFrame, key: str, threshold: int) -> DataFrame:
    """(key, total, benign, summarize): long output is summarized, without any error marker only from twice the length."""
    sums = lines.groupBy(key).agg(F.count(F.lit(1)).alias("total"), (~F.coalesce(F.bool_or(X.has_error_marker(F.col("line"))), F.lit(False))).alias("benign"))
    return sums.withColumn("summarize", F.col("total") > F.when(F.col("benign"), 2 * threshold).otherwise(threshold))


def summary_fields(lines: DataFrame, key: str, cmd: Column, tail: int, top: int = 5) -> DataFrame:
    """Per text: cmd, total lines, number of files, the first errors and files, the test result and how many lines follow."""
    found = line_paths(lines, key)
    paths = found.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("unique_files"), F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "path")))), lambda x: x["path"]).alias("top_files")
    )
    total = lines.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("total"))
    rows = total.join(paths, key, "left").join(errors(lines, key).withColumnRenamed("errors", "top_errors"), key, "left").join(test_summary(lines, key), key)
    none = F.array().cast("array<string>")
    return rows.select(
        key, F.left(cmd, F.lit(30)).alias("cmd"), "total", F.coalesce("unique_files", F.lit(0)).alias("unique_files"), F.slice(F.coalesce("top_errors", none), 1, top).alias("top_errors"),
        F.coalesce("top_files", none).alias("top_files"), "test_summary", F.least(F.lit(tail), F.col("total")).alias("tail_preserved"),
    )


def _tail(lines: DataFrame, key: str, most: int) -> DataFrame:
    """(key, from_end, line): the last lines, from_end falling to 0."""
    last = Window.partitionBy(key).orderBy(F.col("n").desc())
    return lines.withColumn("from_end", F.row_number().over(last) - 1).where(F.col("from_end") < most).select(key, "from_end", "line")


def prose_summary(lines: DataFrame, key: str, cmd: Column) -> DataFrame:
    """(key, n, line): the summary as lines, a head of fields and then the last 20 lines."""
    f = summary_fields(lines, key, cmd, 20)
    none = F.array().cast("array<string>")
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.array(F.lit(name)), F.transform(xs, lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)
    field = lambda name, c: F.array(F.concat(F.lit(name + "="), c.cast("string")))
    head = F.concat(
        F.array(F.concat(F.lit("summary cmd="), "cmd")), field("total_lines", F.col("total")), field("unique_files", F.col("unique_files")), listed("top_errors:", F.col("top_errors")),
        listed("top_files:", F.col("top_files")), F.when(F.col("test_summary") != "", field("test_summary", F.col("test_summary"))).otherwise(none), field("tail_preserved", F.col("tail_preserved")),
    )
    return _after(f.withColumn("_head", head), lines, key, 20)


def _after(heads: DataFrame, lines: DataFrame, key: str, most: int) -> DataFrame:
    """(key, n, line): the lines of ``_head`` and then the last lines of each text."""
    top = heads.select(key, F.posexplode("_head").alias("n", "line")).select(key, (F.col("n") + 1).cast("long").alias("n"), "line")
    end = _tail(lines, key, most).join(heads.select(key, F.size("_head").alias("_h"), "tail_preserved"), key)
    return top.unionByName(end.select(key, (F.col("_h") + F.col("tail_preserved") - F.col("from_end")).cast("long").alias("n"), "line"))


def structured(fields: DataFrame, key: str) -> DataFrame:
    """(key, summary, tail_preserved): one JSON object of the fields of a summary."""
    body = F.struct(F.lit("summary").alias("kind"), "cmd", "total", F.col("top_files").alias("files"), F.col("top_errors").alias("errors"), F.col("test_summary").alias("test"), F.col("tail_preserved").alias("tail"))
    return fields.select(key, F.to_json(body).alias("summary"), "tail_preserved")


def structured_summary(lines: DataFrame, key: str, cmd: Column) -> DataFrame:
    """(key, n, line): one line of JSON and then the last 5 lines."""
    made = structured(summary_fields(lines, key, cmd, 5), key)
    return _after(made.withColumn("_head", F.array("summary")), lines, key, 5)


def auto_summary(lines: DataFrame, key: str, cmd: Column, tier: DataFrame) -> DataFrame:
    """(key, n, line): the structured summary of texts whose tier (key, tier) is ultra, the prose one of others."""
    ultra = tier.where("tier = 'ultra'").select(key)
    brief = structured_summary(lines.join(ultra, key, "left_semi"), key, cmd)
    return brief.unionByName(prose_summary(lines.join(ultra, key, "left_anti"), key, cmd))


def distinct_errors(lines: DataFrame, key: str, most: int = 128) -> DataFrame:
    """Per key the first places of differently shaped errors: fp, snippet and first n, at most ``most`` of them."""
    shaped = lines.withColumn("shape", X.normalize_error(F.col("line")))
    first = shaped.groupBy(key, "shape").agg(F.min("n").alias("first_n"), F.min_by("line", "n").alias("line"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("first_n"))).where(F.col("_r") <= most)
    return ranked.select(key, F.md5("shape").alias("fp"), F.replace(F.left("line", F.lit(128)), F.lit("["), F.lit("(")).alias("snippet"), "first_n")


# What marks a diagnostic line, and words that say nothing.
DIAGNOSTIC = ("error", "warning", "failed", "fatal", "panic", "exception")
STOP = ("the", "and", "for", "this", "that", "with", "from", "into", "was")


def signal_terms(lines: DataFrame, key: str) -> DataFrame:
    """(key, term): distinct words of the lines in which a diagnostic word stands alone at its first place."""
    low = F.lower("line")

    def alone(word: str) -> Column:
        # the first occurrence counts; a neighbour that is a letter or digit makes it part of another word
        return low.rlike(f"(?s)\\A(?:(?!{word}).)*(?<![a-z0-9]){word}(?![a-z0-9])")

    bare = X.trim(F.col("line"))
    path_only = ~F.contains(bare, F.lit(" ")) & (bare.startswith("./") | bare.startswith("/"))
    hits = lines.where(~path_only & X.any_of([alone(w) for w in DIAGNOSTIC]))
    words = hits.select(key, F.explode(X.tokens(F.col("line"))).alias("w"))
    edge = "[^\\p{L}\\p{N}/._:\\[]+"
    words = words.withColumn("term", F.lower(F.regexp_replace("w", f"^{edge}|{edge}$", "")))
    return words.where((F.octet_length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*STOP)).select(key, "term").distinct()


def quality(terms: DataFrame, kept: DataFrame, key: str, required: tuple[str, ...] = (), mode: str = "signal", least: float = 0.5) -> DataFrame:
    """Per text of (key, terms' text) the share of its signal terms that its kept lines (key, n, line) still hold.

    1 without terms; 0 if nothing is kept or a required keyword is missing; in keywords mode 1 else. Terms have no white
    space, so a text holds one if a line does: lines look for their text's terms, nothing is paired with whole texts.
    """
    listed = terms.groupBy(key).agg(F.collect_set("term").alias("_terms"))
    low = F.lower("line")
    own = [F.bool_or(F.contains("line", F.lit(w))).alias(f"_k{i}") for i, w in enumerate(required) if w]
    texts = kept.groupBy(key).agg((F.sum(F.length("line")) + F.count(F.lit(1)) <= 1).alias("_empty"), *own)
    held = kept.join(listed, key).select(key, F.explode(F.filter("_terms", lambda t: F.contains(low, t))).alias("_t")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_held"))
    rows = texts.join(listed, key, "left").join(held, key, "left").withColumn("n_terms", F.coalesce(F.size("_terms"), F.lit(0)).cast("long"))
    missing = X.any_of([~F.coalesce(F.col(c), F.lit(False)) for c in rows.columns if c.startswith("_k")] or [F.lit(False)])
    share = F.lit(1.0) if mode == "keywords" else F.when(F.col("n_terms") <= 0, 1.0).otherwise(F.coalesce("n_held", F.lit(0)) / F.col("n_terms"))
    score = F.when(F.col("_empty") | missing, 0.0).otherwise(share)
    return rows.select(key, F.greatest("n_terms", F.lit(0)).alias("n_terms"), F.round(score, 6).alias("score"), (score >= least).alias("passed"))
