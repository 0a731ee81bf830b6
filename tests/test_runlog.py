import datetime as dt
import json

from tablelens.sources import runlog as G
from tablelens.sources import tables
from tablelens.streaming import runlog as L

STAMP = dt.datetime(2024, 1, 1)
SCHEMA = "run_id string, seq bigint, ts timestamp, process string, response string, effect string, action string, raw string"


def calls(spark, *rows):
    return spark.createDataFrame(
        [("r", i, STAMP, node, other, "none", action, None) for i, (node, other, action) in enumerate(rows)], SCHEMA
    )


def test_line_format(spark):
    row = spark.range(1).select(G.log_line(L.F.lit('a "q"'), L.F.lit("done")).alias("v")).first()["v"]
    assert json.loads(row) == {
        'a "q"': ["Process : Starting task...", "print entirely", "done", "type effect", "Process : Task completed successfully!", "print entirely"]
    }


def test_plain_lines_and_noise(spark, tmp_path):
    lines = [
        '{"1": ["s", "p", "0", "none", "blinkNode", "p"]}',
        '{"Data Cleaning :": ["s", "p", "ok", "type effect", "done", "p"]}',
        '{"": ["s", "p", "", "final", "highlightNodeGreen", "p"]}',
        "not json",
        "   ",
        '{"short": ["a"]}',
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = {(r["process"], r["raw"]): r["kind"] for r in L.log_classify(G.read_log(spark, str(tmp_path))).collect()}
    assert got == {
        ("1", None): "function",
        ("Data Cleaning :", None): "process",
        ("", None): "final",
        (None, "not json"): "raw",
        ("short", None): "process",
    }


def node_states(spark, *rows):
    return {r["node"]: r["state"] for r in L.node_state(calls(spark, *rows)).collect()}


def test_node_states(spark):
    assert node_states(spark, ("1", "0", "blinkNode")) == {"1": "running"}
    assert node_states(spark, ("1", "0", "blinkNode"), ("1", "0", "highlightNodeGreen")) == {"1": "done"}
    assert node_states(spark, ("1", "0", "highlightNodeGreen"), ("1", "0", "blinkNode()")) == {"1": "running"}
    assert node_states(spark, ("1", "0", "blinkNode"), ("1", "0", "stopBlinkNode")) == {"1": "idle"}
    # Clearing the one mark does not touch the other.
    assert node_states(spark, ("1", "0", "highlightNodeGreen"), ("1", "0", "stopBlinkNode")) == {"1": "done"}
    assert node_states(spark, ("1", "0", "blinkNode"), ("1", "0", "removeGreenHighlightNode")) == {"1": "running"}
    assert node_states(spark, ("1", "0", "highlightNodeGreen"), ("1", "0", "removeGreenHighlightNode")) == {"1": "idle"}
    assert node_states(spark, ("1", "0", "somethingElse"), ("", "0", "blinkNode")) == {}


def test_edge_states(spark):
    rows = calls(spark, ("1", "2", "setConnectionYellowGlow"), ("1", "2", "setConnectionGreen"), ("2", "3", "setConnectionYellowGlow"))
    assert {(r["from_node"], r["to_node"]): r["state"] for r in L.edge_state(rows).collect()} == {("1", "2"): "done", ("2", "3"): "active"}


def test_run_status_counts_refused_starts(spark):
    rows = [("a", "uploaded", 1), ("a", "processing", 2), ("a", "processing", 3), ("b", "uploaded", 1), ("b", "paused", 2)]
    got = {r["run_id"]: tuple(r)[1:] for r in L.run_status(spark.createDataFrame(rows, "run_id string, status string, seq bigint")).collect()}
    assert got == {"a": ("processing", 3, 1), "b": ("uploaded", 1, 0)}


def test_stream_is_incremental_and_windows_merge(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def step(*rows):
        frame = calls(spark, *rows).drop("raw")
        G.log_append(frame, log)
        marks = L.node_marks(L.tail_log(spark, log).withWatermark("ts", "1 day"), span="1 hour")
        L.stream_marks(marks, out, state).awaitTermination()
        return {r["node"]: r["state"] for r in L.node_state_of(spark.read.parquet(out)).collect()}

    assert step(("1", "0", "blinkNode"), ("2", "0", "blinkNode")) == {"1": "running", "2": "running"}
    assert step(("9", "0", "none"), ("9", "0", "none"), ("1", "0", "highlightNodeGreen")) == {"1": "done", "2": "running"}


def test_csv_round_trip_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, s string")
    folder = str(tmp_path / "t")
    tables.save_csv(df, folder, single_file=True)
    assert len(list((tmp_path / "t").glob("part-*.csv"))) == 1
    assert sorted(tables.scan_csv(spark, folder).collect()) == sorted(df.collect())
    tables.save_csv(None, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    landed = tables.land_table(df, str(tmp_path / "lake"))
    assert tables.land_table(df.limit(1), str(tmp_path / "lake")).count() == 1 and landed.columns == df.columns


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["", None, " a ", 'say "x"', "a\\", "\\", "one\ntwo\r\nthree", ",", "'", "#c", "\ttab", "null", "\\N", '"', '""', "\r"]
    df = spark.createDataFrame([(i, t, float(i), None) for i, t in enumerate(texts)], "k int, `s t` string, d double, n string")
    tables.save_csv(df.repartition(3), str(tmp_path / "t"))
    back = tables.scan_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    inferred = tables.scan_csv(spark, str(tmp_path / "t"))
    assert dict(inferred.dtypes)["k"] == "int" and inferred.count() == len(texts)


def stamped(spark, *rows):
    """Log lines of (run, seq, minute, node, action); the final event has no node."""
    made = [(r, i, STAMP + dt.timedelta(minutes=m), n or "", "0", "none" if n else "final", a) for r, i, m, n, a in rows]
    return spark.createDataFrame(made, SCHEMA.rsplit(",", 1)[0])


def test_a_final_event_stops_the_run(spark):
    events = calls(spark, ("n", "0", "blinkNode"), ("n", "0", "highlightNodeGreen"), ("n", "0", "blinkNode"))
    end = stamped(spark, ("r", 1, 0, None, "highlightNodeGreen")).withColumn("raw", L.F.lit(None).cast("string"))
    other = events.withColumn("run_id", L.F.lit("open"))
    got = {r["run_id"]: (r["state"], r["seq"]) for r in L.node_state_final(events.union(end).union(other)).collect()}
    assert got == {"r": ("done", 1), "open": ("running", 2)}


def test_the_stream_of_a_run_ends_with_its_final_event(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    steps = [
        [("a", 0, 0, "n", "blinkNode"), ("b", 0, 0, "n", "blinkNode")],
        # in one step any order is fine
        [("a", 3, 3, "n", "blinkNode"), ("a", 1, 1, "n", "highlightNodeGreen"), ("a", 2, 2, None, "highlightNodeGreen")],
        [("a", 4, 4, "n", "stopBlinkNode()"), ("b", 1, 4, "m", "highlightNodeGreen")],
        # the stream's time moves on by hours: runs are forgotten, and b begins anew
        [("c", 0, 600, "n", "blinkNode")],
        [("b", 2, 601, "m", "removeGreenHighlightNode")],
    ]
    told = []
    for rows in steps:
        G.log_append(stamped(spark, *rows), log)
        L.stream_marks(L.node_marks_final(L.tail_log(spark, log), "10 minutes"), out, state).awaitTermination()
        kept = spark.read.parquet(out).select("run_id", "node", "state", "seq", "late", "closed").distinct()
        told.append(sorted(map(tuple, kept.collect()), key=str))
    first = [("a", "n", "running", 0, False, False), ("b", "n", "running", 0, False, False)]
    assert told[0] == first
    late = ("a", "n", None, 3, True, True)
    second = [*first, ("a", "n", "done", 1, False, True), late]
    assert told[1] == sorted(second, key=str)
    third = [*second, ("a", "n", None, 4, True, True), ("b", "m", "done", 1, False, False)]
    assert told[2] == sorted(third, key=str)
    assert told[4] == sorted([*third, ("c", "n", "running", 0, False, False), ("b", "m", "idle", 2, False, False)], key=str)
    last = {(r["run_id"], r["node"]): r["state"] for r in L.last_states(spark.read.parquet(out)).collect()}
    assert last == {("a", "n"): "done", ("b", "n"): "running", ("b", "m"): "idle", ("c", "n"): "running"}
