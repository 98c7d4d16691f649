"""Event logs and summaries: schema on read, bounded JSON, append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import file_system

EVENT = "type string, cmd string, tool string, in_tk bigint, out_tk bigint, tokens_est bigint, files array<string>, errors array<string>, git array<string>, test_summary string, log string, status string, ts bigint"
SUMMARY = (
    "date string, duration_min bigint, tokens_saved bigint, files_touched array<string>, files_committed array<string>, test_summary string, errors_resolved array<string>, git_events array<string>, ts bigint, "
    "valid_from bigint, valid_to bigint, investigated array<string>, learned array<string>, completed array<string>, next_steps array<string>, compression_ratio_bp bigint, tool_choice_efficiency_bp bigint, "
    "context_reuse_rate_bp bigint, budget_utilization_bp bigint, efficiency_overall_bp bigint"
)


def parsed(lines: DataFrame, column: str, schema: str, most_bytes: int = 256 << 10) -> DataFrame:
    """JSON lines as columns: missing numbers are 0, missing lists empty, missing strings ''; broken and huge lines go."""
    rows = lines.where(F.octet_length(column) <= most_bytes).select(F.from_json(column, schema).alias("e")).where("e is not null").select("e.*")
    for name, kind in rows.dtypes:
        default = F.lit(0).cast("long") if kind == "bigint" else F.array().cast(kind) if kind.startswith("array") else F.lit("")
        rows = rows.withColumn(name, F.coalesce(name, default))
    return rows


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder of JSON lines; any part of the path may hold wildcards."""
    return parsed(spark.read.text(path), "value", EVENT)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of JSON lines; such without valid_from begin at their time."""
    rows = parsed(spark.read.text(path), "value", SUMMARY)
    return rows.withColumn("valid_from", F.when(F.col("valid_from") == 0, F.col("ts")).otherwise(F.col("valid_from")))


def append_events(events: DataFrame, path: str) -> None:
    """Adds events as JSON lines. Names that lead elsewhere are refused."""
    if ".." in path.split("/"):
        raise ValueError(path)
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def append_summaries(summaries: DataFrame, path: str) -> None:
    """Adds summaries to a table partitioned by date, so that a day's are read alone."""
    summaries.write.mode("append").partitionBy("date").parquet(path)


def read_summary_table(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of a table by date; such without valid_from begin at their time."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn("date", F.col("date").cast("string"))
    return rows.withColumn("valid_from", F.when(F.coalesce("valid_from", F.lit(0)) == 0, F.col("ts")).otherwise(F.col("valid_from")))


def forget_later(spark: SparkSession, path: str) -> None:
    """Has a folder go when the driver ends."""
    at, files = file_system(spark, path)
    files.deleteOnExit(at)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def result_content(json: Column) -> Column:
    """A tool result's content: the string itself, or the texts of its parts, one line each."""
    whole = F.get_json_object(json, "$.tool_result.content")
    parts = F.from_json(json, "tool_result struct<content: array<struct<type: string, text: string>>>")["tool_result"]["content"]
    listed = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return F.when(whole.startswith("[{"), listed).otherwise(whole)
