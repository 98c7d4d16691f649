"""Noisy command output made from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of lines, chosen by event_id; e is event_id, u is user_id.
_KINDS = (
    "concat(chr(27), '[31merror: request ', cast(e % 97 as string), ' failed', chr(27), '[0m')",
    "concat('⠋ building ', cast(e as string))",
    "'[====>   ] 42'",
    "concat(cast(e % 100 as string), '%')",
    "'hint: use the other command'",
    "concat('npm warn deprecated pkg', cast(e % 5 as string))",
    "'[tsconfig-paths] noise'",
    "'    at run (node_modules/x/index.js:1)'",
    "concat('[2024-01-01T00:00:00Z] INFO user ', cast(u % 7 as string), ' ok')",
    "'   '",
    "concat('modified: src/app', cast(u % 3 as string), '/file', cast(e as string), '.ts')",
    "concat('src/lib', cast(e % 4 as string), '.rs:', cast(e % 50 as string), ':match ', cast(e % 3 as string))",
    "concat('✓ test ', cast(e % 10 as string))",
    "concat('src/a.ts(', cast(e % 9 as string), ',4): error TS2345: bad')",
    "'< Content-Type: text/html'",
    "'< HTTP/1.1 200 OK'",
    "concat('Compiling part v', cast(e % 6 as string))",
    "concat('test result: ok. ', cast(e % 9 as string), ' passed; 0 failed')",
    "concat('ab12cd', cast(e % 10 as string), ' message ', cast(e % 11 as string))",
    "'> Task :compileJava UP-TO-DATE'",
    "concat('Collecting page data ', cast(e % 5 as string))",
    "'(12/240)'",
    "'Total Upload: 12 KiB / gzip: 3 KiB'",
    "'+------+'",
    "'--- NAME'",
    "'    at internal/modules/run'",
    "'PATH=/usr/bin:/bin'",
    "concat('+ resource ', cast(e % 8 as string))",
    "'Refreshing state... [id=1]'",
    "'NAMESPACE: default'",
    "'{}'",
    "'SwiftCompile normal arm64'",
    "concat('HOME=/home/u', cast(u as string))",
    "'attachment #1: trace'",
    "concat('FAILED src/x', cast(e % 4 as string), '.py::test_a')",
    "concat('warning: unused ', cast(e % 13 as string))",
)


def _columns() -> list[str]:
    kinds = " ".join(f"when {i} then {sql}" for i, sql in enumerate(_KINDS))
    # half of the lines are plain records of the event itself
    plain = "concat(event_type, ': user ', cast(user_id as string), ' value ', cast(cast(floor(value) as bigint) as string))"
    return ["cast(floor(user_id / 4) as bigint) as k", "event_id as n", f"case e % {2 * len(_KINDS)} {kinds} else {plain} end as line"]


def event_lines_sql() -> str:
    return f"select {', '.join(_columns())} from (select *, event_id as e, user_id as u from events)"


FEW = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one, of ``FEW`` pieces at most, is dealt out over the cores, since work on its text outweighs the move."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    return df.repartition(min(cores, 64)) if pieces <= FEW and 2 * pieces < cores else df


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, line): output of sessions, four users to a session."""
    made = table(spark, sf_dir, "events").selectExpr("*", "event_id as e", "user_id as u").selectExpr(*_columns())
    # a generator, so that the optimizer doesn't copy the long expression into every test of the line
    return made.select("k", "n", F.explode(F.array("line")).alias("line"))


#: A command for each conversation turn, by SQL that both engines read alike.
COMMANDS = (
    "git log --oneline", "git diff", "git status", "docker logs web", "npm install", "cargo test", "cargo build", "npx playwright test", "tsc --noEmit", "make all",
    "next build", "wrangler deploy", "kubectl get pods", "psql -c x", "curl http://x", "python3 a.py", "ls -la", "env", "tail -f a.log", "cat a.rs",
    "terraform plan", "helm list", "jq . a.json", "rg foo", "FOO=1 BAR=2 git push", "/usr/bin/grep x", "bunx vitest", "bun run test", "bun add x", "vite build", "vite", "unknown",
)


def command_sql(number: str) -> str:
    return f"case {number} % {len(COMMANDS)} " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(COMMANDS)) + " end"
