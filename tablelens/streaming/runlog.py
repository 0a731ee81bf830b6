"""Following run logs, in batch or as a stream with the same functions.

The functions take the rows of `parse_lines`. Each state is an aggregate per run and entity, so one
busy run is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablelens.sources.runlog import FINAL_EFFECT, FUNCTION_EFFECT, parse_lines

# The actions on nodes and connections.
NODE_ACTIONS = ["blinkNode", "highlightNodeGreen", "stopBlinkNode", "removeGreenHighlightNode"]
EDGE_ACTIONS = ["setConnectionYellowGlow", "setConnectionGreen"]


def tail_log(spark: SparkSession, folder: str, max_files_per_step: int | None = None) -> DataFrame:
    """A streaming table of the log folder: only new files are read in each step."""
    reader = spark.readStream
    if max_files_per_step:
        reader = reader.option("maxFilesPerTrigger", max_files_per_step)
    return parse_lines(reader.text(folder))


def log_classify(events: DataFrame) -> DataFrame:
    """Add `kind`: final, function, process, or raw for a line that is no event."""
    kind = (
        F.when(F.col("raw").isNotNull(), "raw")
        .when(F.col("effect") == FINAL_EFFECT, "final")
        .when(F.col("effect") == FUNCTION_EFFECT, "function")
        .otherwise("process")
    )
    return events.withColumn("kind", kind)


def _calls(events: DataFrame) -> DataFrame:
    """Events that name an action, with its name free of parentheses."""
    name = F.trim(F.regexp_replace("action", r"\(.*\)", ""))
    return log_classify(events).filter(F.col("kind").isin("function", "final")).withColumn("call", name)


def _last_seen(rows: DataFrame, keys: list[str], actions: list[str], span: str | None) -> DataFrame:
    """Per key the last number of each action. Partial results merge by taking the maximum again.

    With `span` the numbers are kept per time window, so that a stream with a watermark on `ts` can
    forget old windows.
    """
    groups = [F.col(k) for k in keys] + ([F.window("ts", span).alias("window")] if span else [])
    last = [F.max(F.when(F.col("call") == a, F.col("seq"))).alias(a) for a in actions]
    return rows.filter(F.col("call").isin(actions)).groupBy(*groups).agg(*last)


def _number(action: str) -> Column:
    return F.coalesce(F.col(action), F.lit(-1))


def node_marks(events: DataFrame, span: str | None = None) -> DataFrame:
    calls = _calls(events).withColumn("node", F.col("process")).filter("node != ''")
    return _last_seen(calls, ["run_id", "node"], NODE_ACTIONS, span)


def node_state_of(marks: DataFrame) -> DataFrame:
    """(run_id, node, state, seq) from action marks.

    A node runs if it was started after its last stop and its last completion, and is done if it was
    completed after its last start and its last clearing.
    """
    merged = marks.groupBy("run_id", "node").agg(*[F.max(a).alias(a) for a in NODE_ACTIONS])
    start, complete, stop, clear = (_number(a) for a in NODE_ACTIONS)
    state = (
        F.when(start > F.greatest(complete, stop), "running")
        .when(complete > F.greatest(start, clear), "done")
        .otherwise("idle")
    )
    return merged.select("run_id", "node", state.alias("state"), F.greatest(start, complete, stop, clear).alias("seq"))


def node_state(events: DataFrame) -> DataFrame:
    return node_state_of(node_marks(events))


def edge_marks(events: DataFrame, span: str | None = None) -> DataFrame:
    calls = _calls(events).withColumn("from_node", F.col("process")).withColumn("to_node", F.col("response"))
    named = calls.filter("from_node != '' and to_node != ''")
    return _last_seen(named, ["run_id", "from_node", "to_node"], EDGE_ACTIONS, span)


def edge_state_of(marks: DataFrame) -> DataFrame:
    """(run_id, from_node, to_node, state, seq): the last colour of each connection."""
    keys = ["run_id", "from_node", "to_node"]
    merged = marks.groupBy(*keys).agg(*[F.max(a).alias(a) for a in EDGE_ACTIONS])
    active, done = (_number(a) for a in EDGE_ACTIONS)
    state = F.when(active > done, "active").otherwise("done")
    return merged.select(*keys, state.alias("state"), F.greatest(active, done).alias("seq"))


def edge_state(events: DataFrame) -> DataFrame:
    return edge_state_of(edge_marks(events))


def run_finished(events: DataFrame) -> DataFrame:
    """(run_id, finished): whether the final event of a run has come."""
    return (
        log_classify(events)
        .filter(F.col("kind") != "raw")
        .groupBy("run_id")
        .agg(F.max(F.col("kind") == "final").alias("finished"))
    )


def until_final(events: DataFrame) -> DataFrame:
    """The events of each run up to its first final event; whatever comes later does not change a state.

    The position of the final event is one row a run, combined before the shuffle. Runs without one keep all
    their events; so do events without a number, and lines that are no event.
    """
    ends = log_classify(events).filter("kind = 'final'").groupBy("run_id").agg(F.min("seq").alias("last"))
    ends = ends.select(F.col("run_id").alias("of"), "last")
    kept = events.join(ends, F.col("run_id").eqNullSafe(F.col("of")), "left")
    return kept.filter(F.col("last").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("last"))).drop("of", "last")


def node_state_final(events: DataFrame) -> DataFrame:
    return node_state(until_final(events))


def edge_state_final(events: DataFrame) -> DataFrame:
    return edge_state(until_final(events))


#: Nodes or connections of a run, each as its action marks.
_RUN_STATE = "last long, open array<struct<call: string, node: string, seq: long>>"


def node_marks_final(events: DataFrame, forget_after: str = "1 hour") -> DataFrame:
    """A stream of (run_id, node, state, seq, late, closed): the nodes that a step has changed, in update mode.

    The state of a run is its nodes' marks and, once it has come, the number of its final event: the marks are
    dropped then and only that number stays, to tell late events, until the stream's time is `forget_after`
    past the run's last event. `late` events do not change states; they give a row of their own. Numbers rise
    within a run from step to step, as in a log that is appended to; within a step they may come in any order.
    Events more than `forget_after` behind the stream's time are left out.
    """
    span = parse_span(forget_after)
    calls = _calls(events.withWatermark("ts", forget_after))
    calls = calls.select("run_id", F.col("process").alias("node"), "seq", "ts", "call", (F.col("kind") == "final").alias("final"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = state.get if state.exists else (None, [])
        marks = {(c, n): s for c, n, s in held}
        seen = pd.concat(batches).sort_values("seq")
        finals = seen.loc[seen["final"], "seq"]
        ended = last is not None
        if not ended and len(finals):
            last = int(finals.min())
        touched, late = set(), []
        for r in seen.itertuples():
            if last is not None and r.seq > last:
                late.append((key[0], r.node, None, int(r.seq), True, True))
            elif r.node and r.call in NODE_ACTIONS and not ended:
                marks[r.call, r.node] = max(marks.get((r.call, r.node), -1), int(r.seq))
                touched.add(r.node)
        until = int(seen["ts"].max().timestamp() * 1000)
        rows = [(key[0], node, *_state_of({c: s for (c, n), s in marks.items() if n == node}), False, last is not None) for node in sorted(touched)]
        state.update((last, [] if last is not None else [(c, n, s) for (c, n), s in marks.items()]))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + span)
        yield pd.DataFrame(rows + late, columns=["run_id", "node", "state", "seq", "late", "closed"]).astype({"state": object, "node": object})

    schema = "run_id string, node string, state string, seq long, late boolean, closed boolean"
    return calls.groupBy("run_id").applyInPandasWithState(run, schema, _RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def last_states(rows: DataFrame) -> DataFrame:
    """(run_id, node, state, seq) from all that `node_marks_final` gave: the row of the highest number of each node."""
    known = rows.filter("not late")
    return known.groupBy("run_id", "node").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def parse_span(span: str) -> int:
    """Milliseconds of a span such as '10 minutes'."""
    amount, unit = span.split()
    return int(float(amount) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def _state_of(marks: dict[str, int]) -> tuple[str, int]:
    start, complete, stop, clear = (marks.get(a, -1) for a in NODE_ACTIONS)
    state = "running" if start > max(complete, stop) else "done" if complete > max(start, clear) else "idle"
    return state, max(start, complete, stop, clear)


# Run states in order. A run that is past 'uploaded' refuses another start.
RUN_STATUSES = ["uploaded", "processing", "error", "completed"]


def run_status(changes: DataFrame) -> DataFrame:
    """(run_id, status, seq, refused_starts) from status changes (run_id, status, seq).

    The latest change counts. Every start after the first is refused.
    """
    starts = F.count(F.when(F.col("status") == "processing", F.lit(1)))
    last = F.max(F.struct("seq", "status")).alias("last")
    return (
        changes.filter(F.col("status").isin(RUN_STATUSES))
        .groupBy("run_id")
        .agg(last, F.greatest(starts - 1, F.lit(0)).cast("bigint").alias("refused_starts"))
        .select("run_id", "last.status", "last.seq", "refused_starts")
    )


def stream_to_table(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to a Parquet folder, each exactly once, until nothing is new."""
    return (
        rows.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_marks(marks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the action marks each step has changed to `folder`, one sub-folder per step.

    A repeated step overwrites its own sub-folder, so a restart writes nothing twice. Marks only
    grow, so `node_state_of` and `edge_state_of` read the current states from all steps together.
    """

    def write_step(step: DataFrame, number: int) -> None:
        step.write.mode("overwrite").parquet(f"{folder}/step={number}")

    return (
        marks.writeStream.foreachBatch(write_step)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
