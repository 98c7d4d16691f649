"""Ordered lines of texts: cleaning, dedup, grouping, truncation and the rules of each kind of command.

A line table has a key column, ``n`` (1-based order) and ``line``. Operators need equal lines, groups or whole texts together;
``run_rule`` deals lines out by text once, which serves all of its operators, since truncation needs a text in one place.
Operators by themselves deal by text and line or group, so that long texts spread.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X

NOTICE = "[... {} lines truncated]"


def to_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, line) of each text."""
    return texts.select(key, F.posexplode(X.lines(F.col(text))).alias("n", "line")).select(key, (F.col("n") + 1).cast("long").alias("n"), "line")


def clean(lines: DataFrame) -> DataFrame:
    """Lines without escapes and CRs that are not noise; a leading time stamp goes last."""
    bare = lines.withColumn("line", F.replace(X.strip_ansi(F.col("line")), F.lit("\r"), F.lit("")))
    return bare.where(~X.is_noise(F.col("line"))).withColumn("line", X.strip_timestamp(F.col("line")))


def _often(least: Column | int) -> Column:
    """Whether a count reaches a threshold; no threshold, none does."""
    return F.coalesce(F.col("_c") >= least, F.lit(False))


def dedup(lines: DataFrame, key: str, least: Column | int = 2) -> DataFrame:
    """Lines that occur ``least`` times or more in a text stay once, at their first place, with their count."""
    same = Window.partitionBy(key, "line")
    counted = lines.withColumn("_c", F.count(F.lit(1)).over(same)).withColumn("_first", F.min("n").over(same))
    kept = counted.where(~_often(least) | (F.col("n") == F.col("_first")))
    return kept.withColumn("line", F.when(_often(least), F.concat("line", F.lit("  [×"), F.col("_c").cast("string"), F.lit("]"))).otherwise(F.col("line"))).drop("_c", "_first")


def status_parts(line: Column) -> tuple[Column, Column]:
    """The part up to the first colon, and the folder of the rest ("." without a slash)."""
    bare = X.ltrim(line)
    at = F.instr(bare, ":")
    prefix = F.when(at > 0, F.substring(bare, F.lit(1), at)).otherwise("")
    path = F.when(at > 0, X.trim(F.substring(bare, at + 1, F.length(bare)))).otherwise(line)
    return prefix, F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^(.*)/", 1)).otherwise(".")


def group_by_dir(lines: DataFrame, key: str, least: Column | int = 5) -> DataFrame:
    """Lines that share prefix and folder ``least`` times or more become one, at their first place."""
    prefix, folder = status_parts(F.col("line"))
    same = Window.partitionBy(key, "_group")
    counted = lines.withColumn("_group", F.concat(prefix, folder)).withColumn("_c", F.count(F.lit(1)).over(same)).withColumn("_first", F.min("n").over(same))
    kept = counted.where(~_often(least) | (F.col("n") == F.col("_first")))
    grouped = F.concat("_group", F.lit("/  "), F.col("_c").cast("string"), F.lit(" modified  [grouped]"))
    return kept.withColumn("line", F.when(_often(least), grouped).otherwise(F.col("line"))).drop("_group", "_c", "_first")


def grep_file(line: Column) -> Column:
    """The file of a search hit ``file:number:match`` or ``file:match``; null for other lines."""
    head = F.regexp_extract(line, "^([^:]*):", 1)
    usable = ~X.is_blank(line) & ~line.startswith("Binary file") & F.contains(line, F.lit(":")) & (F.contains(head, F.lit(".")) | F.contains(head, F.lit("/")))
    return F.when(usable, head)


def collapse_hits(lines: DataFrame, key: str, least: int = 5, where: Column | None = None) -> DataFrame:
    """Hits of a file with ``least`` or more become one line with their number, in texts ``where`` that is asked for."""
    same = Window.partitionBy(key, "_file")
    file = grep_file(F.col("line"))
    counted = lines.withColumn("_file", file if where is None else F.when(where, file)).withColumn("_c", F.count(F.lit(1)).over(same)).withColumn("_first", F.min("n").over(same))
    large = F.col("_file").isNotNull() & (F.col("_c") >= least)
    kept = counted.where(~large | (F.col("n") == F.col("_first")))
    return kept.withColumn("line", F.when(large, F.concat("_file", F.lit(": "), F.col("_c").cast("string"), F.lit(" matches [collapsed]"))).otherwise(F.col("line"))).drop("_file", "_c", "_first")


def truncate(lines: DataFrame, key: str, limit: Column | int, tail: Column | bool = False) -> DataFrame:
    """The first ``limit`` lines of a text and a notice of how many are missing, or the notice and its last lines.

    Texts within the limit stay as they are. The notice takes the place of the line next to the kept ones.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    tail = tail if isinstance(tail, Column) else F.lit(tail)
    ranked = lines.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("n"))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    edge = F.when(tail, F.col("_r") == F.col("_all") - limit).otherwise(F.col("_r") == limit + 1)
    inside = F.when(tail, F.col("_r") > F.col("_all") - limit).otherwise(F.col("_r") <= limit)
    marked = ranked.where((F.col("_all") <= limit) | inside | edge)
    notice = F.format_string(NOTICE.replace("{}", "%d"), F.col("_all") - limit)
    return marked.withColumn("line", F.when((F.col("_all") > limit) & edge, notice).otherwise(F.col("line"))).drop("_r", "_all")


def last_lines(lines: DataFrame, key: str, most: int) -> DataFrame:
    """The last lines of each text."""
    return lines.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc()))).where(F.col("_r") <= most).drop("_r")


# Which handler a command name has.
HANDLERS = {
    "git": ("git",),
    "docker": ("docker", "docker-compose", "podman"),
    "package_mgr": ("npm", "pnpm", "yarn"),
    "test_runner": ("jest", "vitest", "pytest", "py.test", "nextest"),
    "playwright": ("playwright",),
    "typescript": ("tsc", "eslint", "biome"),
    "build": ("make", "cmake", "gradle", "mvn", "xcodebuild"),
    "wrangler": ("wrangler",),
    "cloud": ("kubectl", "gh", "aws", "gcloud", "az"),
    "database": ("psql", "prisma", "mysql", "drizzle-kit"),
    "network": ("curl", "wget", "http"),
    "runtime": ("node", "python", "python3", "ruby"),
    "fs": ("find", "ls", "du", "ps", "env", "lsof", "netstat", "cat", "head", "tail", "less", "more", "bat"),
    "data_tool": ("jq", "yq", "terraform", "tofu", "helm", "pulumi"),
    "text_proc": ("grep", "rg", "awk", "sed"),
}


def handler_of(cmd: Column) -> Column:
    """The handler that a command goes to, ``generic`` without a rule."""
    name, words = X.command_name(cmd), X.tokens(cmd)
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    out = F.when(name == "bun", F.when(has("test", "vitest", "jest", "playwright"), "test_runner").otherwise("package_mgr"))
    out = out.when(name == "cargo", F.when(has("test"), "test_runner").otherwise("package_mgr"))
    out = out.when(name == "next", F.when(X.has_any(cmd, ("build", "dev", "start")), "next_build").otherwise("generic"))
    out = out.when(name.isin("vite", "turbo"), F.when(F.contains(cmd, F.lit("build")), "build").otherwise("generic"))
    for handler, names in HANDLERS.items():
        out = out.when(name.isin(*names), handler)
    return out.otherwise("generic")


VIEWERS = ("cat", "head", "tail", "less", "more", "bat")

# Lines that the handlers drop.
GRADLE_NOISE = ("> Task :", "Executing ", "Download ")
XCODE_NOISE = (
    "ClangStatCache ", "RegisterExecutionPolicyException ", "RegisterWithLaunchServices ", "WriteAuxiliaryFile ", "MkDir ",
    "CreateBuildDirectory ", "ProcessInfoPlistFile ", "CpResource ", "CopySwiftLibs ", "PBXCp ", "SwiftEmitModule ",
    "SwiftDriverJobDiscovery ", "SwiftCompile ", "SwiftMergeGeneratedHeaders ", "CompileC ", "CompileAssetCatalog ",
    "CompileStoryboard ", "CompileXIB ", "LinkStoryboards ", "GenerateDSYMFile ", "Ld ", "CodeSign ", "Touch ", "Validate ",
    "ComputePackagePrebuildTargetDependencyGraph", "SendPIFToBuildSystem", "CreateBuildRequest", "Analyze workspace",
    "Create build description", "Build description signature:", "Build description path:", "Command line invocation:",
    "Build settings from command line:", "    cd /", "    builtin-", "    /Applications/Xcode.app/", "    /usr/bin/", "    export ",
)
XCODE_NOTES = ("note: Using new build system", "note: Using codesigning identity override", "note: Build preparation complete", "note: Planning")
NEXT_NOISE = (
    "▲ Next.js", "- Experiments (use with caution)", "Attention: Next.js now collects", "https://nextjs.org/telemetry",
    "Creating an optimized production build", "Compiled successfully", "Collecting page data", "Generating static pages",
    "Finalizing page optimization", "Collecting build traces",
)
WRANGLER_NOISE = (
    "⛅️ wrangler", "-------------------", "Total Upload:", "Worker Startup Time:", "No bindings found.",
    "Your Worker has access to the following bindings:", "Proxy server listening", "Ready on http://",
)
PLAYWRIGHT_NOISE = ("attachment #", "Slow test file:", "To open last HTML report")
HELM_NOISE = ("CHART:", "LAST DEPLOYED:", "NAMESPACE:", "STATUS:", "REVISION:", "TEST SUITE:", "---", "# Source:")
TERRAFORM_STARTS = ("+", "-", "~", "Plan:", "Apply complete!", "Destroy complete!", "Error:", "Warning:")
TERRAFORM_PARTS = ("changes to perform", "will be created", "will be destroyed", "will be updated")
ENV_NOISE = ("PATH=", "LS_COLORS=", "TERM=", "PS1=", "PROMPT=", "MANPATH=")
PRISMA_PARTS = ("generated prisma client", "error", "warning", "✔", "✓")


@dataclass(frozen=True)
class Rule:
    """What a handler does: lines it drops, whether it cleans first, and its dedup, grouping and truncation."""

    drop: object = None
    cleans: bool = True
    hits: bool = False
    dedup: int | None = None
    group: int | None = None
    limit: int = 120
    tail: bool = False
    keep: object = field(default=None)
    #: GraphQL errors, work items: texts that hold such give only these
    graphql: bool = False
    items: bool = False


def _test_passes(c: Column) -> Column:
    return X.has_any(c, ("✓", "✔", " ok")) & ~X.has_any(c, ("failed", "FAIL"))


def _playwright(c: Column) -> Column:
    t = X.trim(c)
    good = (t.startswith("✓") | t.startswith("ok ") | F.contains(t, F.lit(" ✓ "))) & ~X.has_any(t, ("failed", "Error"))
    return good | t.rlike("^[.FT]*$") | X.starts_any(t, PLAYWRIGHT_NOISE)


def _next(c: Column) -> Column:
    t = X.trim(c)
    return X.starts_any(t, NEXT_NOISE) | (t.rlike("^\\([0-9/()]*\\)$") & F.contains(t, F.lit("/")))


def _wrangler(c: Column) -> Column:
    t = X.trim(c)
    return X.starts_any(t, WRANGLER_NOISE) | X.has_any(t, (" KiB / gzip:", " MiB / gzip:"))


def _typescript(c: Column) -> Column:
    t = X.trim(c)
    spot = F.contains(c, F.lit(":")) & F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))
    return X.has_any(c, ("error TS", "warning TS")) | spot | t.startswith("Found ") | t.startswith("error:")


def _terraform(c: Column) -> Column:
    t = X.trim(c)
    skip = t.startswith("Refreshing state...") | t.startswith("Reading...") | (t.startswith("#") & F.contains(t, F.lit("is up-to-date"))) | (t == "Terraform will perform the following actions:")
    return ~skip & (X.starts_any(t, TERRAFORM_STARTS) | X.has_any(t, TERRAFORM_PARTS))


def rule_for(handler: str, cmd: str = "", dedup_min: int = 2, max_lines: int = 120, find_max: int = 50, log_max: int = 20, diff_max: int = 150, docker_max: int = 100) -> Rule:
    """The rule of a handler; git, fs, database and data tools also look at the command."""
    name = cmd.split()[0].rsplit("/", 1)[-1].lower() if cmd.split() else ""
    if handler == "git":
        if "log" in cmd or "diff" in cmd:
            return Rule(dedup=dedup_min, limit=log_max if "log" in cmd else diff_max)
        return Rule(dedup=dedup_min, group=4, limit=60)
    if handler == "fs":
        if cmd.lstrip().startswith("env") or "printenv" in cmd:
            return Rule(drop=lambda c: X.starts_any(c, ENV_NOISE), limit=80)
        logs = any(w.lower().endswith((".log", ".out", ".err")) for w in cmd.split()[1:] if not w.startswith("-"))
        tail = name == "tail" or name in ("cat", "less", "more", "bat") and logs
        return Rule(group=None if name in VIEWERS else 5, limit=find_max, tail=tail)
    if handler == "database":
        if "prisma" in cmd and "generate" in cmd:
            return Rule(keep=lambda c: X.has_any(F.lower(c), PRISMA_PARTS), limit=1 << 30)
        return Rule(drop=lambda c: c.startswith("+"), limit=find_max + 2)
    if handler == "data_tool":
        limit = max(max_lines, 20)
        if name == "terraform":
            return Rule(cleans=False, keep=_terraform, limit=limit)
        if name == "helm":
            return Rule(drop=lambda c: X.starts_any(X.trim(c), HELM_NOISE), limit=limit)
        return Rule(cleans=False, drop=lambda c: X.is_blank(c) | X.trim(c).isin("{}", "[]", "null"), limit=limit)
    xcode = name == "xcodebuild"
    return {
        "docker": Rule(dedup=dedup_min, limit=docker_max, tail=True),
        "package_mgr": Rule(dedup=2, limit=50, tail=True),
        "test_runner": Rule(drop=_test_passes, dedup=dedup_min, limit=100, tail=True),
        "playwright": Rule(drop=_playwright, dedup=dedup_min, limit=120, tail=True),
        "typescript": Rule(keep=_typescript, limit=100),
        "build": Rule(drop=lambda c: X.starts_any(c, GRADLE_NOISE) | (X.starts_any(c, XCODE_NOISE) | X.has_any(c, XCODE_NOTES) if xcode else F.lit(False)), dedup=dedup_min, limit=100, tail=True),
        "next_build": Rule(drop=_next, dedup=dedup_min, limit=140),
        "wrangler": Rule(drop=_wrangler, dedup=dedup_min, limit=80, tail=True),
        "cloud": Rule(drop=lambda c: c.startswith("---"), limit=100, items=("az boards" in cmd or "az repos" in cmd) and "az repos pr list" not in cmd),
        "network": Rule(drop=lambda c: c.startswith("< ") & ~c.startswith("< HTTP"), limit=60, graphql=True),
        "runtime": Rule(drop=lambda c: X.starts_any(X.ltrim(c), ("at internal/", "at async internal/")), limit=50),
        "text_proc": Rule(cleans=False, hits=True, dedup=dedup_min, limit=max(max_lines, 20)),
    }.get(handler, Rule(dedup=dedup_min, group=5, limit=max_lines))


def run_rule(lines: DataFrame, key: str, rule: Rule) -> DataFrame:
    """A handler's pipeline over a line table."""
    if rule.graphql:
        answers, lines = split_graphql(lines, key)
        return graphql_errors(answers, key).unionByName(run_rule(lines, key, replace(rule, graphql=False)))
    if rule.items:
        found = work_items(lines, key)
        rest = lines.join(found.select(key).distinct(), key, "left_anti")
        return found.unionByName(run_rule(rest, key, replace(rule, items=False)))
    out = clean(lines) if rule.cleans else lines
    if rule.keep is not None:
        out = out.where(rule.keep(F.col("line")))
    if rule.drop is not None:
        out = out.where(~rule.drop(F.col("line")))
    # after the filters and, but for dedup and grouping alone, the only exchange
    out = out.repartition(key)
    if rule.hits:
        out = collapse_hits(out, key)
    if rule.dedup is not None:
        out = dedup(out, key, rule.dedup)
    if rule.group is not None:
        out = group_by_dir(out, key, rule.group)
    return truncate(out, key, rule.limit, rule.tail)


def _argument(cmd: Column, test) -> Column:
    """Whether an argument that is no flag passes a test."""
    return F.exists(F.slice(X.tokens(cmd), 2, 1 << 20), lambda w: ~w.startswith("-") & test(F.lower(w)))


def variant_of(cmd: Column, handler: Column) -> Column:
    """The rule that a command's output goes through: its handler's, or one of several that its handler has."""
    name = F.regexp_extract(F.regexp_extract(X.ltrim(cmd), f"^([^{X.WS}]*)", 1), "([^/]*)$", 1)
    has = lambda word: F.contains(cmd, F.lit(word))
    logs = _argument(cmd, lambda w: w.endswith(".log") | w.endswith(".out") | w.endswith(".err"))
    git = F.when(has("log"), "git_log").when(has("diff"), "git_diff").otherwise("git")
    fs = (
        F.when(X.ltrim(cmd).startswith("env") | has("printenv"), "fs_env").when((name == "tail") | (name.isin("cat", "less", "more", "bat") & logs), "fs_tail")
        .when(name.isin(*VIEWERS), "fs_view").otherwise("fs")
    )
    return (
        F.when(handler == "git", git).when(handler == "fs", fs).when((handler == "database") & has("prisma") & has("generate"), "prisma_generate")
        .when((handler == "data_tool") & (name == "terraform"), "terraform").when((handler == "data_tool") & (name == "helm"), "helm")
        .when((handler == "build") & (name == "xcodebuild"), "xcodebuild").when((handler == "cloud") & (has("az boards") | has("az repos")) & ~has("az repos pr list"), "items").otherwise(handler)
    )


def variants() -> dict[str, Rule]:
    """The rules by variant, each made from a command that stands for it."""
    stand_for = {
        "git_log": ("git", "git log"), "git_diff": ("git", "git diff"), "fs_env": ("fs", "env"), "fs_tail": ("fs", "tail x"), "fs_view": ("fs", "cat x"), "fs": ("fs", "ls"),
        "prisma_generate": ("database", "prisma generate"), "terraform": ("data_tool", "terraform plan"), "helm": ("data_tool", "helm list"), "data_tool": ("data_tool", "jq ."),
        "xcodebuild": ("build", "xcodebuild"), "items": ("cloud", "az boards"),
    }
    plain = ("git", "docker", "package_mgr", "test_runner", "playwright", "typescript", "build", "next_build", "wrangler", "cloud", "database", "network", "runtime", "text_proc", "generic")
    return {name: rule_for(*stand_for.get(name, (name, name))) for name in (*stand_for, *plain)}


def run_mixed(lines: DataFrame, key: str, cmd: str = "cmd") -> DataFrame:
    """Lines (key, n, line, cmd) of outputs of all kinds of commands through their handlers, in one plan.

    A small table of rules, one row for each variant, is joined by the command's variant: what is cleaned, and the
    thresholds of dedup, grouping and truncation, are its columns. GraphQL errors and work items, which replace a text,
    are taken out first. Generators of one row keep the optimizer from copying variants and cleaned lines into each test.
    """
    rules = variants()
    table = lines.sparkSession.createDataFrame(
        [(name, r.cleans, r.hits, r.graphql, r.items, r.dedup, r.group, r.limit, r.tail) for name, r in rules.items()],
        "_v string, _cleans boolean, _hits boolean, _graphql boolean, _items boolean, _dedup int, _grouped int, _limit int, _tail boolean",
    )
    own = [c for c in lines.columns if c != cmd]
    named = lines.withColumn(cmd, F.coalesce(cmd, F.lit("")))
    # commands are looked at once each, not line by line
    kinds = named.select(cmd).distinct().withColumn("_h", F.explode(F.array(handler_of(F.col(cmd)))))
    kinds = kinds.withColumn("_v", F.explode(F.array(variant_of(F.col(cmd), F.col("_h"))))).join(F.broadcast(table), "_v").drop("_h")
    rows = named.join(kinds, cmd).drop(cmd)
    done = graphql_errors(rows.where("_graphql").select(own), key).unionByName(work_items(rows.where("_items").select(own), key))
    rows = rows.join(done.select(key).distinct(), key, "left_anti")
    bare = rows.withColumn("_b", F.explode(F.array(F.when(F.col("_cleans"), F.replace(X.strip_ansi(F.col("line")), F.lit("\r"), F.lit(""))).otherwise(F.col("line")))))
    clear = bare.where(~(F.col("_cleans") & X.is_noise(F.col("_b")))).drop("line")
    rows = clear.withColumn("line", F.explode(F.array(F.when(F.col("_cleans"), X.strip_timestamp(F.col("_b"))).otherwise(F.col("_b"))))).drop("_b")
    line = F.col("line")
    stays = F.lit(True)
    for name, rule in rules.items():
        tests = [*([rule.keep(line)] if rule.keep else []), *([~rule.drop(line)] if rule.drop else [])]
        if tests:
            stays = F.when(F.col("_v") == name, tests[0] if len(tests) == 1 else tests[0] & tests[1]).otherwise(stays)
    rows = rows.where(stays).repartition(key)
    rows = collapse_hits(rows, key, where=F.col("_hits"))
    rows = dedup(rows, key, F.col("_dedup"))
    rows = group_by_dir(rows, key, F.col("_grouped"))
    return truncate(rows, key, F.col("_limit"), F.col("_tail")).select(own).unionByName(done)


def _has_error(line: Column) -> Column:
    return F.contains(line, F.lit('"errors"')) & F.contains(line, F.lit('"message"'))


def split_graphql(lines: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Lines of texts that hold a GraphQL error once they are cleaned, and of the others."""
    hit = F.max(_has_error(X.strip_ansi(F.col("line"))) & ~X.is_noise(X.strip_ansi(F.col("line")))).over(Window.partitionBy(key))
    marked = lines.withColumn("_hit", hit)
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")


def graphql_errors(lines: DataFrame, key: str) -> DataFrame:
    """Messages and codes of texts that hold a GraphQL error, below a heading: (key, n, line)."""
    flagged = clean(split_graphql(lines, key)[0])
    value = lambda name: F.regexp_extract("line", f'"{name}":"*([^"]*)"', 1)
    found = flagged.select(key, "n", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.when(F.col("line").rlike('"message":"*[^"]*"'), F.concat(F.lit("Error: "), value("message"))).alias("line")),
        F.struct(F.lit(2).alias("k"), F.when(F.col("line").rlike('"code":"*[^"]*"'), F.concat(F.lit("Code: "), value("code"))).alias("line")),
    )).alias("x")).select(key, (F.col("n") * 2 + F.col("x.k") - 1).alias("n"), F.col("x.line").alias("line")).where("line is not null")
    heads = flagged.select(key).distinct().select(key, F.lit(0).cast("long").alias("n"), F.lit("[GraphQL Error]").alias("line"))
    return heads.unionByName(found)


# Work items, as JSON of one member to a line: members whose values are dropped with all in them, and what stays.
ITEM_SKIPS = ('"_links"', '"relations"', '"extensions"')
ITEM_KEEPS = ('"System.', '"id"', '"rev"', '"url"', '"state"', '"title"')
ITEM_LINES = ("{", "}", "},", '"fields": {')


def work_items(lines: DataFrame, key: str) -> DataFrame:
    """(key, n, line) of texts that begin as JSON: a heading, and the lines of work items' main fields.

    A skipped member lasts until its brackets are closed: the running depth since the last line that begins one, in
    order, returns to nothing. A member that opens nothing lasts one line. Texts without any kept line give nothing.
    """
    ordered = Window.partitionBy(key).orderBy("n")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    t = X.trim(F.col("line"))
    begins = F.first(F.when(~X.is_blank(F.col("line")), X.ltrim(F.col("line")).rlike("^[{\\[]")), ignorenulls=True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lines.withColumn("_json", begins).where("_json").withColumn("_t", t)
    depth = F.regexp_count("_t", F.lit("[{\\[]")) - F.regexp_count("_t", F.lit("[}\\]]"))
    rows = rows.withColumn("_d", depth).withColumn("_skip", X.has_any(F.col("_t"), ITEM_SKIPS)).withColumn("_block", F.count_if("_skip").over(upto))
    inside = Window.partitionBy(key, "_block").orderBy("n")
    # within a block the depth counts from the line that begins it; the block ends with the first line at nothing or below
    rows = rows.withColumn("_run", F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.coalesce(F.max((F.col("_run") <= 0).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = rows.withColumn("_ended", ended).where((F.col("_block") == 0) | F.col("_ended")).where(X.has_any(F.col("_t"), ITEM_KEEPS) | F.col("_t").isin(*ITEM_LINES)).select(key, "n", "line")
    heads = rows.select(key).distinct().select(key, F.lit(0).cast("long").alias("n"), F.lit("[work items: main fields kept; links, relations and extensions dropped]").alias("line"))
    return heads.unionByName(rows)


# How definitions begin, by language.
SIGNATURES = {
    "rust": ("pub fn ", "fn ", "async fn ", "pub async fn ", "unsafe fn ", "pub unsafe fn ", "impl ", "trait ", "struct ", "enum ", "pub mod ", "pub use ", "pub struct ", "pub enum ", "pub trait ", "pub type ", "pub const ", "pub impl "),
    "python": ("def ", "async def ", "class "),
    "ts": (
        "export function ", "export default function ", "export async function ", "function ", "async function ", "export class ", "export default class ", "class ", "export const ",
        "export let ", "export var ", "export type ", "export interface ", "export enum ", "export default ", "const ", "interface ", "type ",
    ),
    "go": ("func ", "type ", "package "),
    "java": (
        "public class ", "private class ", "protected class ", "public interface ", "private interface ", "protected interface ", "class ", "interface ", "public static ", "fun ",
        "public fun ", "private fun ", "protected fun ", "public enum ", "private enum ", "enum ",
    ),
    "ruby": ("def ", "class ", "module ", "func ", "struct ", "enum "),
}


def is_signature(line: Column, lang: str) -> Column:
    if lang == "c":
        end = F.regexp_replace(line, f"[{X.WS}]+$", "")
        return line.rlike("^[A-Za-z_]") & F.contains(line, F.lit("(")) & (end.endswith(")") | end.endswith(") {") | end.endswith("){"))
    return X.starts_any(line, SIGNATURES[{"kotlin": "java", "swift": "ruby"}.get(lang, lang)])


def signatures(lines: DataFrame, key: str, lang: str, threshold: int = 400) -> DataFrame:
    """Of texts with ``threshold`` lines or more: a marker, the first three cleaned lines, signatures, the last three.

    Columns key, section (0 to 3), n, line. Lines of two sections appear in both.
    """
    large = lines.groupBy(key).agg(F.count(F.lit(1)).alias("_raw")).where(F.col("_raw") >= threshold)
    held = clean(lines).join(large, key)
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("n"))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    anchors = F.least(F.lit(3), F.floor(F.col("_all") / 2))
    sections = F.array_compact(F.array(
        F.when(F.col("_r") <= anchors, 1), F.when(is_signature(F.col("line"), lang), 2), F.when(F.col("_r") > F.col("_all") - anchors, 3),
    ))
    body = ranked.select(key, "_raw", F.explode(sections).alias("section"), "n", "line")
    marker = body.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.first("_raw").alias("_raw")).select(key, F.lit(0).alias("section"), F.lit(0).cast("long").alias("n"), F.format_string("[%d signatures from %d lines]", "c", "_raw").alias("line"))
    return marker.unionByName(body.drop("_raw"))
