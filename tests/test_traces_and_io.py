import json
import os

import pandas as pd

from pyspark.sql import functions as F

from millrace.operators import text, traces
from millrace.sources import exports
from millrace.streaming import attempts

MSG = "msg_id string, request_id string, pos int, role string, content string, tool_calls array<struct<function:struct<name:string,arguments:string>>>"


def call(name, **args):
    return [{"function": {"name": name, "arguments": json.dumps(args)}}]


def listing(path, body, footer):
    return f"<path>{path}</path>\n<type>file</type>\n<content>\n{body}\n\n{footer}\n</content>"


def test_replay(spark):
    rows = [
        ("1", "r", 0, "tool", listing("src/a.py", "1: x = 1\n2: y = 2", "(End of file - total 2 lines)"), None),
        ("2", "r", 1, "assistant", "", call("edit", filePath="/w/src/a.py", oldString="x = 1", newString="x = 3")),
        ("3", "r", 2, "assistant", "", call("edit", filePath="a.py", oldString="absent", newString="z")),
        ("4", "r", 3, "assistant", "", call("edit", filePath="a.py", oldString="y = 2", newString="")),
        ("5", "r", 4, "tool", listing("b.py", "1: only part", "(End of file - total 9 lines)"), None),
        ("6", "r", 5, "assistant", "", call("edit", filePath="b.py", oldString="only", newString="any")),
        ("7", "r", 6, "assistant", "", call("write", filePath="c.py", content="q = 1")),
        ("8", "r", 7, "assistant", "", call("edit", filePath="c.py", oldString="1", newString="2")),
        ("9", "r", 8, "assistant", "", [{"function": {"name": "edit", "arguments": "{bad"}}]),
        ("1", "r", 0, "tool", listing("src/a.py", "1: x = 1\n2: y = 2", "(End of file - total 2 lines)"), None),
        ("x", "none", None, None, None, None),
    ]
    out = {r.path.split("/")[-1]: r for r in traces.replay_edits(spark.createDataFrame(rows, MSG)).collect()}
    assert set(out) == {"a.py", "c.py"}
    assert (out["a.py"].pre, out["a.py"].post, out["a.py"].edits, out["a.py"].pre_origin) == ("x = 1\ny = 2\n", "x = 3\n\n", 2, "read_complete")
    assert (out["c.py"].pre, out["c.py"].post, out["c.py"].pre_origin) == ("q = 1", "q = 2", "tool_write")


def test_signals_and_rounds(spark):
    rows = [("1", "r", 0, "User ", "hi", None), ("1", "r", 0, "User ", "hi", None), ("2", "r", 1, "assistant", None, call("Bash", cmd="x")), ("3", "r", 2, "tool", "Traceback (most recent call last): ...", None)]
    r = traces.trace_signals(spark.createDataFrame(rows, MSG)).first()
    assert (r.user_turns, r.assistant_turns, r.error_signals, r.exec_ops, r.distinct_tools) == (1, 1, 1, 1, ["bash"])
    for kinds, want in [("tet", 1), ("et", 0), ("tt", 0), ("teett", 1), ("tetet", 2), ("e", 0)]:
        ev = spark.createDataFrame([("k", i, {"t": "test", "e": "edit"}[c]) for i, c in enumerate(kinds)], "key string, i int, kind string")
        assert traces.repair_rounds(ev, "key", ["i"]).first().rounds == want


def test_read_listing():
    assert traces.read_listing("3: a\n4: b\n(End of file - total 2 lines)") == ("a\nb", "complete")
    assert traces.read_listing("3: a\n5: b") == ("3: a\n5: b", "unlabelled")
    assert traces.read_listing("plain\n(File has more lines)")[1] == "partial"


def test_text(spark):
    df = spark.createDataFrame([("a", "x" * 30 + "\nshort\n" + "y" * 30), ("b", None), ("c", "")], "k string, t string")
    pool = spark.createDataFrame([("z", "  " + "x" * 30 + "\r\n")], "k string, t string")
    got = {r.k: (r.lines, r.shared, r.share) for r in text.verbatim_share(df, "k", "t", pool, "t").collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, 0.0), "c": (0, 0, 0.0)}
    d = spark.createDataFrame([("a\nb", "a\nc\nd"), (None, "")], "x string, y string").select(text.line_delta("x", "y").alias("d")).select("d.*").collect()
    assert (d[0].added, d[0].removed, d[1].added, d[1].ratio) == (2, 1, 0, 1.0)
    rot = text.rotation_compose(spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "k string"), "k", 5)
    assert sorted((r.host, r.donor, r.place) for r in rot.collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)]
    a = spark.createDataFrame([("g", 1, "x"), ("g", 2, None)], "g string, k int, v string")
    f = lambda df: text.set_fingerprint(df, "g", "k", "v").first().fingerprint
    assert f(a) == f(a.orderBy(F.desc("k"))) != f(a.where("k = 1"))


def test_sources(spark, tmp_path):
    one = {"session_id": "s1", "messages": [{"role": "user", "content": "hi"}]}
    (tmp_path / "w.json").write_text(json.dumps({"sessions": [one, {"session_id": "s2"}]}))
    (tmp_path / "l.json").write_text(json.dumps([one]))
    got = {r.session_id: len(r.messages) for r in exports.read_sessions(spark, str(tmp_path / "w.json")).collect()}
    assert got == {"s1": 1, "s2": 0} and exports.read_sessions(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "r1.jsonl").write_text('{"run_id": "r", "case_id": "a", "passed": true}\n\n{"run_id": "r", "case')
    (tmp_path / "r2.jsonl").write_text('{"run_id": "r", "case_id": "b"}\n')
    assert exports.read_results(spark, str(tmp_path / "r*.jsonl").replace("r*", "r1")).count() == 1
    assert exports.read_results(spark, str(tmp_path / "r1.jsonl"), strict=True).count() == 0
    assert exports.read_results(spark, str(tmp_path / "absent")).count() == 0
    assert exports.write_report(spark.range(3), str(tmp_path / "o.csv")) == 3 and len(pd.read_csv(tmp_path / "o.csv")) == 3


def test_streaming_emits_once(spark, tmp_path):
    src, journal, ck, out = (str(tmp_path / x) for x in ("src", "journal", "ck", "out"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    sink = lambda df, epoch: df.write.mode("append").parquet(out)
    for _ in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(src)
        attempts.emit_new(stream, ["k"], journal, sink, ck).awaitTermination(60)
        spark.createDataFrame([(2, "late copy"), (3, "c")], "k int, v string").write.mode("append").parquet(src)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3] and os.path.isdir(journal)


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = attempts.windowed_counts(attempts.first_wins_stream(stream, ["event_id"], "ts"), "ts", "event_type", delay=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and set(got.items()) <= set(want.items())
