import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import calibration, cases, drafts, gates, records, redaction, traces
from millrace.sources import exports

CALLS = "array<struct<function:struct<name:string,arguments:string>>>"
MESSAGE = f"msg_id string, request_id string, pos int, role string, content string, tool_calls {CALLS}"
CHAT = "request_id string, start_time timestamp, requests_tags string, tools string, full_history string"
SESSION = "session_id string, messages array<struct<role:string,content:string>>, artifacts array<struct<type:string,path:string,content:string,accepted:boolean>>"

_PIECES = ["token = ", "password", "api_key: ", '"', "'", "\n", "    ", "def f():\n", "return ", "None", "abc123xyz", "(", ")", "=", "os.environ['K']", "sk-abcdefghij12", '"""', "# ", "-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=12).map("".join))
def test_masking_never_breaks_a_file(text):
    out = redaction.mask_source(text, "a.py")
    assert redaction.parses(text, "a.py") is not True or redaction.parses(out, "a.py") is not False
    assert redaction.mask_source(out, "b.txt") == redaction.mask_source(redaction.mask_source(out, "b.txt"), "b.txt")


def test_one_bad_line_does_not_save_the_others():
    text = 'a = 1\nsecret = "abcdefgh"\npassword = hunter22\n'
    assert redaction.mask_source(text, "a.py") == 'a = 1\nsecret = "***"\npassword = hunter22\n'


def test_empty_tables(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    assert drafts.session_drafts(empty(SESSION)).count() == 0
    assert drafts.record_drafts(empty(CHAT), empty(MESSAGE)).count() == 0
    assert traces.suggest_tier(traces.trace_signals(empty(MESSAGE))).count() == 0 and traces.extracted_files(empty(MESSAGE)).count() == 0
    assert drafts.compact_sessions(empty(MESSAGE)).count() == 0
    assert gates.set_audit(empty("case_id string, ok boolean, fingerprint string, tier string, audited_at timestamp")).count() == 0
    files = empty("case_id string, position int, path string, content string, role string")
    assert cases.compose(files, empty("host string, donor string, place int")).count() == 0 and gates.size_difficulty(files).count() == 0


def test_nulls_and_clashing_names(spark):
    rows = [("m1", "r", None, None, None, None, "z"), ("m1", "r", None, None, None, None, "z"), (None, None, 1, "user", "x", None, "z"), ("m2", "r", 0, "tool", "<path>a</path>", [((None, None),), (("edit", "{cut"),)], "z")]
    out = traces.trace_signals(spark.createDataFrame(rows, MESSAGE + ", kind string")).where("request_id = 'r'").first()
    assert (out.tool_calls, out.edit_ops, out.files_read, out.files_touched, out.distinct_tools) == (1, 1, 1, 0, ["edit"])
    sessions = spark.createDataFrame([("s", [("user", None), ("user", "fix the bug")], None, "q"), (None, None, None, "q")], SESSION + ", prompt string")
    assert [r.prompt for r in drafts.session_drafts(sessions).collect()] == ["fix the bug"]


def test_a_name_read_under_two_paths_is_ambiguous(spark):
    listing = lambda p: f"<path>{p}</path>\n<type>file</type>\n<content>\n1: x = 1\n2: y = 2\n\n(End of file - total 2 lines)\n</content>"
    call = lambda p: [(("edit", json.dumps({"filePath": p, "oldString": "x = 1", "newString": "x = 2"})),)]
    rows = [("1", "r", 0, "tool", listing("src/a/util.py"), None), ("2", "r", 1, "tool", listing("src/b/util.py"), None), ("3", "r", 2, "assistant", "", call("src/b/util.py")), ("4", "q", 0, "tool", listing("/w/x/src/a/m.py"), None), ("5", "q", 1, "assistant", "", call("src/a/m.py"))]
    got = {r.request_id: r.pre_origin for r in traces.replay_edits(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {"r": "ambiguous_path", "q": "read_complete"}


def test_compact_sessions(spark):
    rows = [("1", "a", 0, "system", "s", None), ("2", "a", 1, "User", "u" * 5000, None), ("3", "a", 2, "tool", "t" * 900, None), ("4", "b", 0, "tool", "x</content>", None), ("5", "b", 1, "assistant", None, None)]
    got = {r.request_id: [(m.role, len(m.content)) for m in r.messages] for r in drafts.compact_sessions(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {"a": [("user", 4000), ("tool", 800)], "b": [("assistant", 0)]}


def test_log_factorial_holds_for_large_counts(spark):
    ns = [0, 1, 2, 16, 17, 18, 100, 12_345, 10**6, 2 * 10**9]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(stats.log_factorial(F.col("n"))).collect()
    for n, r in zip(ns, got):
        assert r[0] == pytest.approx(math.lgamma(n + 1), rel=1e-12, abs=1e-12)
    big = spark.createDataFrame([(20_000, 19_500)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c"))).first()[0]
    assert 0.0117 < big < 0.0121  # normal approximation: z = 2.516


def test_readers(spark, tmp_path):
    case = {"case_id": "c1", "prompt": "p", "context": {"files": [{"path": "a", "content": "x"}]}, "grader": {"mode": "gold"}, "metadata": {"tier": "T1"}}
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "c1.json").write_text(json.dumps(case, indent=1))
    (tmp_path / "set" / "_report.json").write_text("{}")
    assert [(r.case_id, r.metadata["tier"]) for r in exports.read_cases(spark, str(tmp_path / "set")).collect()] == [("c1", "T1")]
    (tmp_path / "set" / "bad.json").write_text("{cut")
    with pytest.raises(ValueError):
        exports.read_cases(spark, str(tmp_path / "set"))
    assert exports.read_cases(spark, str(tmp_path / "set"), validate=False).count() == 1
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text('{"model": "m"}')
    (run / "results.jsonl").write_text('{"case_id": "a", "passed": true}\n{"case_id": "b", "passed": false}\n')
    assert {(r.run, r.case_id, r.manifest) for r in exports.read_runs(spark, str(tmp_path / "runs")).collect()} == {("r1", "a", '{"model": "m"}'), ("r1", "b", '{"model": "m"}')}
    (run / "results.jsonl").write_text('{"case_id": "a"}\n{"case_id": "a"}\n')
    with pytest.raises(ValueError, match="twice"):
        exports.read_runs(spark, str(tmp_path / "runs"))
    assert exports.read_results(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        exports.read_results(spark, "nowhere://x/y.jsonl")
    assert exports.case_set_dir("set", str(tmp_path)) == str(tmp_path / "set")
    for bad in ("../set", "other:set"):
        with pytest.raises(ValueError):
            exports.case_set_dir(bad, str(tmp_path))


def test_jdbc_filters_and_urls(monkeypatch):
    text = exports.chat_record_filter(since="2026-01-02", until="2026-02-03T04:05:06", only_agent="o'code", require_edits=True)
    assert "start_time >= timestamp '2026-01-02 00:00:00'" in text and "start_time < timestamp '2026-02-03 04:05:06'" in text and "o''code" in text and '"name": "edit"' in text
    with pytest.raises(ValueError):
        exports.chat_record_filter(since="2026-01-01' or '1'='1")
    assert exports.jdbc_url("jdbc:x") == "jdbc:x" and exports.jdbc_url(user="a@b", password="p/w", host="h", database="d") == "jdbc:mysql://a%40b:p%2Fw@h:3306/d?characterEncoding=utf8"
    monkeypatch.setenv("DATABASE_URL", "jdbc:y")
    assert exports.jdbc_url() == "jdbc:y"
    monkeypatch.delenv("DATABASE_URL")
    with pytest.raises(ValueError):
        exports.jdbc_url()


def test_newest_records_pages(spark):
    rows = [(f"r{i}", f"2026-01-0{1 + i // 2} 00:00:00", json.dumps([1] * (3 if i else 2))) for i in range(6)]
    df = spark.createDataFrame(rows, "request_id string, t string, full_history string").withColumn("start_time", F.to_timestamp("t"))
    page = lambda o: [r.request_id for r in exports.newest_records(df, offset=o, limit=2).collect()]
    assert page(0) + page(2) + page(4) == ["r4", "r5", "r2", "r3", "r1"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None, 0.25, True), ("c", 1, float("nan"), None)], "k string, n int, x double, ok boolean")
    exports.render_report("Runs", [("All", df), ("None", df.limit(0))], str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "| a\\|b | - | 0.25 | yes |" in text and "| c | " in text and "No rows." in text and text.startswith("# Runs\n")
    for suffix in ("csv", "json", "jsonl", "md"):
        assert exports.write_report(df, str(tmp_path / f"t.{suffix}")) == 2 and (tmp_path / f"t.{suffix}").stat().st_size > 0
    with pytest.raises(ValueError):
        exports.write_report(df, str(tmp_path / "x.csv"), max_rows=1)
    assert not (tmp_path / "x.csv").exists() and not list(tmp_path.glob("tmp*"))


def test_shares():
    assert calibration.parse_shares("T2=0.3, T3 = 0.7") == {"T2": 0.3, "T3": 0.7}
    for bad in ("T2", "T2=0.5", "T2=1.2,T3=-0.2"):
        with pytest.raises(ValueError):
            calibration.parse_shares(bad)


def test_budget_rungs_equal_sorted_ranks(spark):
    import random

    from millrace.operators.outcomes import budget_rungs

    rng = random.Random(2)
    rows = [(rng.choice([None, rng.randint(0, 50)]), rng.random() < 0.2) for _ in range(301)]
    got = [(r.rung, r.budget) for r in budget_rungs(spark.createDataFrame(rows, "total_tokens long, infra_error boolean")).collect()]
    t = sorted(x or 0 for x, bad in rows if not bad)
    want = sorted({t[max(0, math.ceil(f * len(t)) - 1)] for f in (0.25, 0.5, 0.75, 0.9, 1.0)})
    assert sorted(got) == list(enumerate(want))
    assert budget_rungs(spark.createDataFrame([], "total_tokens long, infra_error boolean")).count() == 0


def test_user_texts_of_null(spark):
    df = spark.createDataFrame([(None,), ([],), ([("User", "x"), ("human", None)],)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(records.user_texts(F.col("m"))).collect()] == [None, [], [""]]
