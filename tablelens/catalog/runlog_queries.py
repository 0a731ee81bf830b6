"""Run-log queries (S7, S8, L1-L5) and their SQL.

Each event of the given table becomes a log event: the user is the run, the event its number, the
event type chooses the action.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.fixtures import table, union_sql
from tablelens.session import work_dir
from tablelens.sources import runlog as G
from tablelens.streaming import runlog as L


def run_events(s, d):
    """(run_id, seq, ts, process, response, effect, action)"""
    kind, value = F.col("event_type"), F.col("value")
    node = F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string"))
    following = F.concat(F.lit("n"), ((F.col("event_id") % 7) + 1).cast("string"))
    is_final, is_plain = (kind == "error") & (value >= 100), (kind == "error") & (value.between(10, 100)) & (value < 100)
    action = (
        F.when(kind == "click", "blinkNode")
        .when(kind == "view", "highlightNodeGreen")
        .when(kind == "purchase", "setConnectionYellowGlow")
        .when(kind == "signup", "setConnectionGreen")
        .when(is_final, "highlightNodeGreen")
        .when(is_plain, G.DEFAULT_ACTION)
        .when(value >= 5, "stopBlinkNode()")
        .otherwise("removeGreenHighlightNode")
    )
    return table(s, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(is_final, "").when(is_plain, "step").otherwise(node).alias("process"),
        F.when(is_final, "").when(is_plain, F.col("props")).when(kind.isin("purchase", "signup"), following).otherwise("0").alias("response"),
        F.when(is_final, G.FINAL_EFFECT).when(is_plain, G.DEFAULT_EFFECT).otherwise(G.FUNCTION_EFFECT).alias("effect"),
        action.alias("action"),
    )


def _written(s, d, with_noise=False):
    """The log folder: all events as lines and, if asked, one plain line per user."""
    folder = work_dir(s, "run-log")
    G.log_append(run_events(s, d), folder)
    if with_noise:
        noise = table(s, d, "events").select(F.concat(F.lit("user "), "user_id", F.lit(" {seen}")).alias("value")).distinct()
        noise.write.mode("append").text(folder)
    return folder


def _events(s, d):
    return run_events(s, d).withColumn("raw", F.lit(None).cast("string"))


# Longer than the log, so that no run is forgotten within it.
LOG_SPAN = "60 days"
COLUMNS = ["run_id", "seq", "process", "response", "effect", "action"]


def _append(s, d):
    return G.read_log(s, _written(s, d)).select(*COLUMNS)


def _plain_append(s, d):
    """Lines without a run: the same text as the log of a single run."""
    folder = work_dir(s, "run-log")
    G.log_append(run_events(s, d).drop("run_id", "seq", "ts"), folder)
    return s.read.text(folder).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _stream(s, d):
    folder, out = _written(s, d, with_noise=True), work_dir(s, "log-stream")
    rows = L.log_classify(L.tail_log(s, folder, max_files_per_step=2))
    L.stream_to_table(rows, out, work_dir(s, "log-stream-state")).awaitTermination()
    return s.read.parquet(out).select(*COLUMNS, "raw", "kind")


def _stream_nodes(s, d):
    out = work_dir(s, "node-marks")
    marks = L.node_marks(L.tail_log(s, _written(s, d), max_files_per_step=2))
    L.stream_marks(marks, out, work_dir(s, "node-marks-state")).awaitTermination()
    return L.node_state_of(s.read.parquet(out))


def _stream_edges(s, d):
    out = work_dir(s, "edge-marks")
    marks = L.edge_marks(L.tail_log(s, _written(s, d), max_files_per_step=2))
    L.stream_marks(marks, out, work_dir(s, "edge-marks-state")).awaitTermination()
    return L.edge_state_of(s.read.parquet(out))


def _stream_final(s, d):
    """The log in two parts, the second appended after the first has been followed to its end."""
    folder, out, state = work_dir(s, "run-log"), work_dir(s, "final-marks"), work_dir(s, "final-marks-state")
    events = run_events(s, d)
    middle = events.agg(F.avg("seq")).first()[0]
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        G.log_append(events.filter(part), folder)
        L.stream_marks(L.node_marks_final(L.tail_log(s, folder), LOG_SPAN), out, state).awaitTermination()
    return L.last_states(s.read.parquet(out))


def _status(s, d):
    status = F.create_map(
        *[F.lit(v) for pair in {"signup": "uploaded", "click": "processing", "error": "error", "purchase": "completed"}.items() for v in pair]
    )
    return L.run_status(
        table(s, d, "events").select(
            F.col("user_id").cast("string").alias("run_id"), status[F.col("event_type")].alias("status"), F.col("event_id").alias("seq")
        )
    )


QUERIES = {
    "log_append": _append,
    "log_append_plain": _plain_append,
    "log_stream": _stream,
    "log_classify": lambda s, d: L.log_classify(_events(s, d)).select("run_id", "seq", "kind"),
    "node_state": lambda s, d: L.node_state(_events(s, d)),
    "node_state_stream": _stream_nodes,
    "node_state_final": lambda s, d: L.node_state_final(_events(s, d)),
    "edge_state_final": lambda s, d: L.edge_state_final(_events(s, d)),
    "node_state_final_stream": _stream_final,
    "edge_state": lambda s, d: L.edge_state(_events(s, d)),
    "edge_state_stream": _stream_edges,
    "run_finished": lambda s, d: L.run_finished(_events(s, d)),
    "run_status": _status,
}

_RUN = """run AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type, props, value,
  event_type = 'error' AND value >= 100 AS is_final, event_type = 'error' AND value >= 10 AND value < 100 AS is_plain,
  'n' || (event_id % 7) AS node, 'n' || (event_id % 7 + 1) AS following FROM events),
log AS (SELECT run_id, seq,
  CASE WHEN is_final THEN '' WHEN is_plain THEN 'step' ELSE node END AS process,
  CASE WHEN is_final THEN '' WHEN is_plain THEN props WHEN event_type IN ('purchase', 'signup') THEN following ELSE '0' END AS response,
  CASE WHEN is_final THEN 'final' WHEN is_plain THEN 'type effect' ELSE 'none' END AS effect,
  CASE WHEN event_type = 'click' THEN 'blinkNode' WHEN event_type = 'view' THEN 'highlightNodeGreen'
       WHEN event_type = 'purchase' THEN 'setConnectionYellowGlow' WHEN event_type = 'signup' THEN 'setConnectionGreen'
       WHEN is_final THEN 'highlightNodeGreen' WHEN is_plain THEN 'Process : Task completed successfully!'
       WHEN value >= 5 THEN 'stopBlinkNode()' ELSE 'removeGreenHighlightNode' END AS action FROM run)"""
_KIND = "CASE effect WHEN 'final' THEN 'final' WHEN 'none' THEN 'function' ELSE 'process' END"

# The state after the last event that changes it, found by replaying the events in order.
_NODES = f"""WITH {_RUN}, calls AS (
  SELECT run_id, process AS node, seq, CASE action WHEN 'blinkNode' THEN 'running' WHEN 'highlightNodeGreen' THEN 'done'
    WHEN 'stopBlinkNode()' THEN 'stop' ELSE 'clear' END AS call
  FROM log WHERE effect = 'none' AND event_type_is_node),
sets AS (SELECT run_id, node, seq, call FROM calls WHERE call IN ('running', 'done')),
last_set AS (SELECT run_id, node, max(seq) AS seq, arg_max(call, seq) AS call FROM sets GROUP BY 1, 2),
ended AS (SELECT c.run_id, c.node FROM calls c JOIN last_set s ON s.run_id = c.run_id AND s.node = c.node AND c.seq > s.seq
  WHERE (s.call = 'running' AND c.call = 'stop') OR (s.call = 'done' AND c.call = 'clear') GROUP BY 1, 2),
every AS (SELECT run_id, node, max(seq) AS seq FROM calls GROUP BY 1, 2)
SELECT e.run_id, e.node, CASE WHEN s.call IS NULL OR d.node IS NOT NULL THEN 'idle' ELSE s.call END AS state, e.seq
FROM every e LEFT JOIN last_set s ON s.run_id = e.run_id AND s.node = e.node
LEFT JOIN ended d ON d.run_id = e.run_id AND d.node = e.node""".replace(
    "event_type_is_node", "action NOT LIKE 'setConnection%'"
)
_EDGES = f"""WITH {_RUN} SELECT run_id, process AS from_node, response AS to_node,
  CASE arg_max(action, seq) WHEN 'setConnectionGreen' THEN 'done' ELSE 'active' END AS state, max(seq) AS seq
FROM log WHERE action LIKE 'setConnection%' GROUP BY 1, 2, 3"""

# The same, of the events up to the first final one of the run.
_TO_FINAL = """log AS (SELECT a.* FROM all_log a LEFT JOIN (SELECT run_id, min(seq) AS last FROM all_log WHERE effect = 'final' GROUP BY 1) f
  ON a.run_id = f.run_id WHERE f.last IS NULL OR a.seq <= f.last)"""
_RUN_TO_FINAL = f"{_RUN.replace('log AS (', 'all_log AS (', 1)}, {_TO_FINAL}"

_LINE = """'{"' || process || '":["Process : Starting task...","print entirely","' || replace(response, '"', '\\"') ||
  '","' || effect || '","' || action || '","print entirely"]}'"""

SQL = {
    "log_append": f"WITH {_RUN} SELECT {', '.join(COLUMNS)} FROM log",
    "log_append_plain": f"WITH {_RUN} SELECT {_LINE} AS value, count(*) AS n FROM log GROUP BY 1",
    "log_stream": f"WITH {_RUN} "
    + union_sql(
        [
            f"SELECT {', '.join(COLUMNS)}, CAST(NULL AS VARCHAR) AS raw, {_KIND} AS kind FROM log",
            "SELECT DISTINCT NULL, NULL, NULL, NULL, NULL, NULL, 'user ' || user_id || ' {seen}', 'raw' FROM events",
        ]
    ),
    "log_classify": f"WITH {_RUN} SELECT run_id, seq, {_KIND} AS kind FROM log",
    "node_state": _NODES,
    "node_state_stream": _NODES,
    "edge_state": _EDGES,
    "edge_state_stream": _EDGES,
    "node_state_final": _NODES.replace(_RUN, _RUN_TO_FINAL),
    "edge_state_final": _EDGES.replace(_RUN, _RUN_TO_FINAL),
    "node_state_final_stream": _NODES.replace(_RUN, _RUN_TO_FINAL),
    "run_finished": f"WITH {_RUN} SELECT run_id, bool_or(effect = 'final') AS finished FROM log GROUP BY 1",
    "run_status": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'error'
    WHEN 'purchase' THEN 'completed' END AS status FROM events)
SELECT run_id, arg_max(status, seq) AS status, max(seq) AS seq,
  greatest(count(CASE WHEN status = 'processing' THEN 1 END) - 1, 0) AS refused_starts
FROM c WHERE status IS NOT NULL GROUP BY 1""",
}
