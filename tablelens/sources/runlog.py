"""The pipeline run log: JSON lines, one object {process: [six strings]} per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts of a log line and the effects that mark special events.
START_TEXT = "Process : Starting task..."
PRINT_EFFECT = "print entirely"
DEFAULT_EFFECT = "type effect"
DEFAULT_ACTION = "Process : Task completed successfully!"
FUNCTION_EFFECT = "none"
FINAL_EFFECT = "final"

LINE_TYPE = "map<string,array<string>>"


def log_line(process: Column, response: Column, effect: Column | None = None, action: Column | None = None) -> Column:
    """One event as a JSON line."""
    effect = F.lit(DEFAULT_EFFECT) if effect is None else effect
    action = F.lit(DEFAULT_ACTION) if action is None else action
    items = F.array(F.lit(START_TEXT), F.lit(PRINT_EFFECT), response, effect, action, F.lit(PRINT_EFFECT))
    return F.to_json(F.create_map(process, items))


def log_append(events: DataFrame, folder: str) -> None:
    """Append events (process, response, effect, action) as lines.

    With `run_id`, `seq` and `ts` columns these are kept: each line is then an object
    {run_id, seq, ts, event}, where event is the plain line.
    """
    line = log_line(F.col("process"), F.col("response"), F.col("effect"), F.col("action"))
    if {"run_id", "seq", "ts"} <= set(events.columns):
        line = F.to_json(F.struct("run_id", "seq", "ts", line.alias("event")))
    events.select(line.alias("value")).write.mode("append").text(folder)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(run_id, seq, ts, process, response, effect, action, raw) from text lines.

    Works on batch and streaming tables alike. A line that is not an event keeps its text in `raw`;
    blank lines are dropped.
    """
    event = "run_id string, seq bigint, ts timestamp, event string"
    parsed = (
        lines.filter(F.col("value").rlike(r"\S"))
        .withColumn("outer", F.from_json("value", event))
        .withColumn("map", F.from_json(F.coalesce("outer.event", "value"), LINE_TYPE))
        .withColumn("process", F.get(F.map_keys("map"), F.lit(0)))
        .withColumn("items", F.get(F.map_values("map"), F.lit(0)))
    )
    known = F.col("items").isNotNull()
    return parsed.select(
        F.when(known, F.col("outer.run_id")).alias("run_id"),
        F.when(known, F.col("outer.seq")).alias("seq"),
        F.when(known, F.col("outer.ts")).alias("ts"),
        F.when(known, F.col("process")).alias("process"),
        F.get("items", F.lit(2)).alias("response"),
        F.get("items", F.lit(3)).alias("effect"),
        F.get("items", F.lit(4)).alias("action"),
        F.when(~known, F.col("value")).alias("raw"),
    )


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(spark.read.text(folder))
