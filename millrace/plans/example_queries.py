"""Queries over small written-out inputs, for operators that the tables do not exercise; their SQL states the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import calibration, cases, diagnosis, drafts, gates, helpers, records, redaction, text, traces
from millrace.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


_CALL = "array<struct<function:struct<name:string,arguments:string>>>"
_MESSAGE = f"msg_id string, request_id string, pos int, role string, content string, tool_calls {_CALL}"


def _call(name: str, arguments: str) -> list:
    return [((name, arguments),)]


def _trace(spark: SparkSession) -> DataFrame:
    """One trace with a whole read, a partial read, a write before any read, edits that fit and one that does not, and a test run between."""
    listing = lambda p, body, foot: f"<path>{p}</path>\n<type>file</type>\n<content>\n{body}\n\n{foot}\n</content>"
    return _rows(
        spark, _MESSAGE,
        ("m0", "r1", 0, "user", "fix the failing test", None),
        ("m1", "r1", 1, "tool", listing("src/a.py", "1: x = 1\n2: y = 2", "(End of file - total 2 lines)"), None),
        ("m2", "r1", 2, "tool", listing("src/b.py", "7: part", "(Showing lines 7-7 of 90. Use offset.)"), None),
        ("m3", "r1", 3, "assistant", "", _call("bash", '{"command": "python -m pytest -q"}')),
        ("m4", "r1", 4, "tool", "1 FAILED", None),
        ("m5", "r1", 5, "assistant", "", _call("edit", '{"filePath": "/w/src/a.py", "oldString": "x = 1", "newString": "x = 3"}')),
        ("m6", "r1", 6, "assistant", "", _call("edit", '{"filePath": "src/a.py", "oldString": "gone", "newString": "z"}')),
        ("m7", "r1", 7, "assistant", "", _call("write", '{"filePath": "c.py", "content": "q = 1\\n"}')),
        ("m8", "r1", 8, "assistant", "", _call("edit", '{"filePath": "c.py", "oldString": "1", "newString": "2"}')),
        ("m9", "r1", 9, "assistant", "", _call("edit", '{"filePath": "src/b.py", "oldString": "part", "newString": "whole"}')),
        ("ma", "r1", 10, "assistant", "", _call("bash", '{"cmd": "npm run test"}')),
        ("mb", "r2", 0, "user", "hello", None),
        ("m0", "r1", 0, "user", "fix the failing test", None),
    )


@_query(r"""SELECT * FROM (VALUES ('r1', 'w/src/a.py', 'x = 1' || chr(10) || 'y = 2' || chr(10), 'x = 3' || chr(10) || 'y = 2' || chr(10), 1, 'read_complete', 'edit', 1, 4, 2, 2),
  ('r1', 'c.py', 'q = 1' || chr(10), 'q = 2' || chr(10), 1, 'tool_write', 'edit', 1, 4, 2, 2)) t(request_id, path, pre, post, edits, pre_origin, post_origin, partial_reads, edits_seen, edits_applied, unlocatable)""")
def replay_examples(spark: SparkSession, d: str) -> DataFrame:
    return traces.replay_edits(_trace(spark))


@_query("""SELECT * FROM (VALUES ('r1', 1, 1, 2, 5, 2, 4, 1, 'bash,edit,write', 'T4'), ('r2', 1, 0, 0, 0, 0, 0, 0, '', 'T1')) t(request_id, user_turns, error_signals, exec_ops, edit_ops, files_read, files_touched, repair_rounds, tools, tier)""")
def trace_examples(spark: SparkSession, d: str) -> DataFrame:
    out = traces.suggest_tier(traces.trace_signals(_trace(spark)))
    return out.select("request_id", "user_turns", "error_signals", "exec_ops", "edit_ops", "files_read", "files_touched", "repair_rounds", F.array_join("distinct_tools", ",").alias("tools"), "tier")


@_query("""SELECT * FROM (VALUES ('r1', 'src/a.py', 'x = 1' || chr(10) || 'y = 2' || chr(10), 'read_complete'), ('r1', 'src/b.py', '7: part' || chr(10), 'read_partial')) t(request_id, path, content, origin)""")
def listing_examples(spark: SparkSession, d: str) -> DataFrame:
    return traces.extracted_files(_trace(spark)).select("request_id", "path", "content", "origin")


@_query("""SELECT * FROM (VALUES ('a', 0, 'user', 'x' || chr(10) || 'y' || chr(10) || '3'), ('a', 2, 'unknown', ''), ('a', 3, 'ai', 'é'), ('a', 4, 'tool', 'only')) t(request_id, pos, role, content)""")
def content_examples(spark: SparkSession, d: str) -> DataFrame:
    history = '[{"role": "user", "content": [{"type": "text", "text": "x"}, {"content": "y"}, 3]}, 3, {"content": null}, {"role": "ai", "content": "\\u00e9"}, {"role": "tool", "content": {"text": "only"}}]'
    df = _rows(spark, "request_id string, full_history string", ("a", history), ("b", "[{cut"), ("c", None), ("d", ""), ("e", "{}"))
    return records.normalized_messages(df).select("request_id", "pos", "role", "content")


@_query("""SELECT * FROM (VALUES (1, 'acme-cli/2.0', 'grep,read', true), (2, 'opencode', '', true), (3, NULL, '', false), (4, 'Foo/1 (x', 'bash', true), (5, NULL, '', true)) t(id, agent, tools, coding)""")
def record_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, tags string, tools string, said string",
        (1, '["x", "User-Agent: acme-cli/2.0", "y"]', '[{"function": {"name": "grep"}}, {"name": "read"}, {"function": {}}]', "an error here"), (2, '{"client": "OpenCode 1"}', None, "hello"),
        (3, None, '["read"]', "nice weather"), (4, "user-agent:  Foo/1 (x, y)", '[{"name": "bash"}]', "please compile: 编译"), (5, "[]", "[]", "写一个 script"),
    )
    agent, tools = records.user_agent(F.col("tags")), records.tool_names(F.col("tools"))
    return df.select("id", agent.alias("agent"), F.array_join(tools, ",").alias("tools"), records.is_coding_record(agent, tools, F.col("said")).alias("coding"))


@_query("""SELECT * FROM (VALUES (1, 'make it faster please'), (2, 'fix it now' || chr(10) || chr(10) || 'ok then'), (3, 'the last message is long enough'), (4, ''), (5, 'same text here')) t(id, prompt)""")
def prompt_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, texts array<string>", (1, ["<system-reminder>a\nb</system-reminder>", "text: make it faster please", "hm"]), (2, ["fix it now", "ok then"]),
        (3, ["first message", "Sender (untrusted metadata) x", "the last message is long enough"]), (4, ["a", " ", "<system-reminder>only</system-reminder>"]), (5, ["same text here", "same text here"]),
    )
    return df.select("id", records.primary_prompt(F.col("texts")).alias("prompt"))


@_query("""SELECT * FROM (VALUES (1, 'python'), (2, 'typescript'), (3, 'java'), (4, 'cangjie'), (5, 'javascript'), (6, 'python')) t(id, language)""")
def language_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, prompt string, paths array<string>, fences array<string>", (1, "run PyTest", ["a.ts"], []), (2, "do it", ["x.md", "a.ts", "b.py"], ["py"]), (3, "the Java class", [], []),
        (4, None, ["m.cj"], None), (5, "do it", [], ["sh", "js"]), (6, "do it", None, None),
    )
    return df.select("id", records.guess_language(F.col("prompt"), F.col("paths"), F.col("fences")).alias("language"))


@_query("""SELECT * FROM (VALUES (1, false, 'prompt_too_short', 0.0, 'too_short'), (2, false, 'drop_rule:heartbeat', 0.0, 'heartbeat'), (3, true, 'ok', 3.5, 'coding_intent,coding_tools,has_context,has_gold'), (4, false, 'no_workspace_context', 1.0, 'coding_intent,no_context'), (5, false, 'low_coding_signal', 0.5, 'has_gold'), (6, true, 'ok', 2.5, 'coding_intent,coding_agent'))
  t(case_id, keep, reason, score, labels)""")
def filter_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "case_id int, prompt string, files array<struct<path:string,content:string>>, has_gold boolean, product string, tools array<string>",
        (1, " fix it", [("a", "b")], True, None, []), (2, "HEARTBEAT_OK fix the bug", [], None, None, None), (3, "fix the bug in a.py", [("a.py", "x = 1")], True, "web", ["grep", "zap"]),
        (4, "implement a queue", [("a.py", "# TODO: incomplete workspace\n")], False, None, None), (5, "what is the weather", [], True, None, []), (6, "refactor this now", [], False, "OpenCode", []),
    )
    out = drafts.filter_drafts(df)
    return out.select("case_id", "keep", "reason", "score", F.array_join("labels", ",").alias("labels"))


@_query(r"""SELECT * FROM (VALUES (1, 'token = "***"' || chr(10)), (2, 'x = "token=***" in url' || chr(10)), (3, 'token: str = None' || chr(10)), (4, 'PWD=***' || chr(10) || 'n = 1048576'), (5, 'k = "sk-***"'), (6, 'a' || chr(10) || '***PRIVATE_KEY***' || chr(10) || 'b'), (7, 'password = secret1' || chr(10)), (8, NULL)) t(id, redacted)""")
def redaction_examples(spark: SparkSession, d: str) -> DataFrame:
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    df = _rows(
        spark, "id int, t string, path string", (1, 'token = "abcdef1"\n', "a.py"), (2, 'x = "token=abc" in url\n', "a.py"), (3, "token: str = None\n", "a.py"), (4, "PWD=hunter22\nn = 1048576", ".env"),
        (5, 'k = "sk-abcdefghij0"', "a.js"), (6, f"a\n{pem}\nb", "x.txt"), (7, "password = secret1\n", "a.py"), (8, None, "a.py"),
    )
    return df.select("id", redaction.redact_source("t", "path").alias("redacted"))


@_query("""SELECT * FROM (VALUES (1, 'p = "/workspace/x"'), (2, 'cd /workspace/repo'), (3, '/workspace/a'), (4, 'plain')) t(id, redacted)""")
def path_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, t string, path string", (1, 'p = "/home/ann.b/x"', "a.py"), (2, "cd /mnt/c/repo", "a.sh"), (3, "C:\\Users\\ann/a", "x.txt"), (4, "plain", "x.txt"))
    return df.select("id", redaction.redact_paths("t", "path").alias("redacted"))


@_query("""SELECT * FROM (VALUES ('d1', 'assignment', 1), ('d1', 'aws_key_id', 1), ('d1', 'database_url', 1), ('d2', 'github_token', 1)) t(doc, rule, findings)""")
def secret_scan_examples(spark: SparkSession, d: str) -> DataFrame:
    key = "AKIA" + "ABCDEFGH12345678"
    docs = _rows(
        spark, "doc string, body string", ("d1", f'{{"prompt": "use {key}", "grader": {{"key_lines": ["token = \\"sk-abcdefghijk\\""], "command": "password: hunter22"}}, "files": [{{"content": "postgres://u:pass1@h/d"}}]}}'),
        ("d2", '{"metadata": {"validity_issues": ["ghp_abcdefghijklmnopqrstuv"], "note": "ghp_abcdefghijklmnopqrstuv"}}'), ("d3", "no json"), ("d4", None),
    )
    return redaction.scan_documents(docs.select("doc", redaction.json_leaves(F.col("body")).alias("leaves")), "doc", "leaves")


_SCAN = " OR ".join(f"regexp_matches(t, '{r}')" for r in redaction.SCAN_RULES.values())


@_query(f"""WITH f AS (SELECT DISTINCT fv_id, repo, coalesce(pre, '') AS t FROM file_versions), h AS (SELECT fv_id, repo, {_SCAN} AS hit FROM f) SELECT repo, count(*) AS files, count(*) FILTER (hit) AS findings FROM h GROUP BY 1""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of edit pairs in which a rule of fixed form finds a credential."""
    f = table(spark, d, "file_versions").select("fv_id", "repo", "pre").distinct()
    fixed = F.array_except(redaction.scan_text(F.col("pre")), F.array(F.lit("assignment")))
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.size(fixed) > 0).alias("findings"))


@_query("""SELECT * FROM (VALUES (1, NULL), (2, '评测作弊失败'), (3, '沙箱基础设施失败'), (4, 'LLM服务失败'), (5, '预算耗尽失败'), (6, 'Agent协议失败'), (7, '测试未执行'), (8, '模型推理失败')) t(id, category)""")
def category_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, infra boolean, passed boolean, status string, hack boolean, collect boolean", (1, False, True, "ok", True, False), (2, True, False, "ok", True, None), (3, True, False, "ok", None, None), (4, True, False, "infra_error", False, False),
        (5, False, None, "timeout", False, True), (6, False, False, "failed", False, True), (7, False, False, "ok", False, True), (8, None, False, None, None, None),
    )
    return df.select("id", diagnosis.failure_category(*map(F.col, ("infra", "passed", "status", "hack", "collect"))).alias("category"))


@_query("""SELECT * FROM (VALUES (1, 'missing_kwarg', ''), (2, 'wrong_arity', ''), (3, 'assertion', 'a.py::t1,renders the row'), (4, 'no_detail', ''), (5, 'solver_broke_file', ''), (6, 'collection_error', ''), (7, 'other_error', ''), (8, 'infra_error', '')) t(id, mechanism, tests)""")
def mechanism_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, detail string, infra boolean, hack boolean, collect boolean", (1, "TypeError: f() got an unexpected keyword argument 'x'", False, False, False), (2, "TypeError: f() takes 1 positional argument", None, None, None),
        (3, "AssertionError\nFAILED a.py::t1 - x\n  ✖ renders the row (1.5ms)", False, False, False), (4, None, False, False, False), (5, "SyntaxError: bad", False, False, True), (6, "x", False, False, True), (7, "boom", False, False, False), (8, "AssertionError", True, True, True),
    )
    return df.select("id", diagnosis.mechanism(*map(F.col, ("detail", "infra", "hack", "collect"))).alias("mechanism"), F.array_join(diagnosis.failing_tests(F.col("detail")), ",").alias("tests"))


@_query("""SELECT * FROM (VALUES ('agent_status', 'failed', 1), ('agent_status', 'unknown', 3), ('category', 'infra', 1), ('category', 'unknown', 2), ('category', 'x', 1), ('reason', 'missing_key_lines', 1), ('reason', 'no_detail', 1), ('reason', 'parse_error', 1), ('reason', 'script_exit=1', 1)) t(kind, name, n)""")
def failure_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "passed boolean, failure_category string, infra_error boolean, agent_status string, detail string, error_message string", (True, "y", False, "ok", "z", None), (False, "x", False, "failed", "missing key_lines: a\nb", None),
        (False, None, True, None, " ", "exit=1"), (None, None, False, "", "Could not Parse", None), (False, None, None, None, None, None),
    )
    return diagnosis.failure_report(df)


@_query("""WITH r AS (SELECT l_partkey AS case_id, l_returnflag AS m, avg(CASE WHEN l_discount < 0.055 THEN 1.0 ELSE 0 END) > 0.5 AS maj FROM lineitem WHERE NOT l_tax > 0.075 GROUP BY 1, 2)
  SELECT CASE WHEN a.maj AND b.maj THEN 'both_pass' WHEN NOT a.maj AND NOT b.maj THEN 'both_fail' ELSE 'discordant' END AS "group", count(*) AS cases FROM r a JOIN r b ON a.case_id = b.case_id AND a.m = 'A' AND b.m = 'R' GROUP BY 1""")
def case_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("anchor"), (F.col("l_discount") < 0.055).alias("passed"), (F.col("l_tax") > 0.075).alias("infra_error"))
    return diagnosis.case_groups(rows, ("A", "R")).groupBy("group").agg(F.count("*").alias("cases"))


@_query("""WITH p AS (SELECT DISTINCT l_returnflag AS run_id, l_partkey FROM lineitem), n AS (SELECT count(*) AS n FROM part) SELECT run_id, n - count(*) AS missing FROM p, n GROUP BY run_id, n HAVING n > count(*)""")
def incomplete_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.col("l_partkey").alias("case_id"))
    return diagnosis.incomplete_runs(rows, table(spark, d, "part").select(F.col("p_partkey").alias("case_id")))


@_query("""WITH n AS (SELECT o_custkey AS case_id, o_orderpriority AS mechanism, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2), t AS (SELECT case_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS failures FROM n GROUP BY 1)
  SELECT n.case_id, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(mechanism) END AS mechanism, min(failures) AS failures FROM n JOIN t ON n.case_id = t.case_id AND n.n = t.most GROUP BY 1""")
def case_mechanisms(spark: SparkSession, d: str) -> DataFrame:
    return diagnosis.case_mechanism(table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("mechanism")))


@_query("""SELECT * FROM (VALUES ('m1', 3, 2, 2, 0.333333, 1.0, 0.25), ('m2', 1, 1, 0, 0.0, 0.0, 1.0)) t(model, answers, readable, hits, unreadable, hit_rate, p_value)""")
def verdict_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "model string, case_id int, truth string, answer string", ("m1", 1, "YES", "My verdict: yes."), ("m1", 2, "NO", "NO, no"), ("m1", 3, "NO", "yes or no"), ("m2", 1, "YES", "no"))
    out = diagnosis.verdict_readout(df.withColumn("verdict", diagnosis.verdict_label(F.col("answer"), ("YES", "NO"))))
    return out.select("model", "answers", "readable", "hits", *[F.round(c, 6).alias(c) for c in ("unreadable", "hit_rate", "p_value")])


@_query("""SELECT * FROM (VALUES ('a', 18, 5, 2, 1, 2, 1, 1, 1)) t(run, prompt_tokens, completion_tokens, model_calls, turns, tool_calls, tool_errors, session_errors, unfinished_calls)""")
def message_event_examples(spark: SparkSession, d: str) -> DataFrame:
    lines = [
        '{"type": "message_update", "message": {"role": "assistant", "usage": {"input": 99}}}', '{"type": "message_end", "message": {"role": "assistant", "usage": {"input": 10, "cacheRead": 3, "cacheWrite": 1, "output": 4}}}', "{cut",
        '{"type": "message_end", "message": {"role": "user", "usage": {"input": 50}}}', '{"type": "tool_execution_start", "toolCallId": "1", "toolName": "bash"}', '{"type": "tool_execution_end", "toolCallId": "1", "isError": true}',
        '{"type": "tool_execution_start", "toolCallId": "2", "toolName": "read"}', '{"type": "message_end", "message": {"role": "assistant", "stopReason": "error", "usage": {"input": 4, "output": 1}}}', '{"type": "turn_end"}',
    ]
    return diagnosis.fold_message_events(_rows(spark, "run string, seq int, event string", *[("a", i, x) for i, x in enumerate(lines)]))


@_query("""SELECT * FROM (VALUES ('a', 15, 9, 30, 2, 2, 1, 'maximum steps reached', true, 1)) t(run, prompt_tokens, completion_tokens, total_tokens, model_calls, tool_calls, tool_errors, final_text, hit_step_limit, session_errors)""")
def step_event_examples(spark: SparkSession, d: str) -> DataFrame:
    lines = [
        '{"type": "step_finish", "part": {"tokens": {"input": 5, "output": 2, "reasoning": 3, "total": 12, "cache": {"read": 2}}}}', '{"type": "step_finish", "part": {"tokens": {"input": 8, "output": 4, "total": 18}}}', "",
        '{"type": "tool_use", "part": {"tool": "bash", "state": {"status": "error"}}}', '{"type": "tool_use", "part": {"tool": "read", "state": {"status": "completed"}}}', '{"type": "text", "part": {"text": "maximum steps reached"}}', '{"type": "text", "part": {"text": " "}}', '{"type": "error", "error": {"x": 1}}',
    ]
    return diagnosis.fold_step_events(_rows(spark, "run string, seq int, event string", *[("a", i, x) for i, x in enumerate(lines)]))


@_query("""SELECT * FROM (VALUES ('g', 'contamination_gold_in_context', 'a.py'), ('g', 'contamination_keyline_in_context', 'return value + 1'), ('p', 'prompt_contains_large_code_fence', 'prompt')) t(case_id, code, what)""")
def leak_examples(spark: SparkSession, d: str) -> DataFrame:
    body = "def f(value):\n    return value + 1\n\nprint(f(1))\n"
    file = "array<struct<path:string,content:string>>"
    return gates.leaks(_rows(
        spark, f"case_id string, prompt string, mode string, files {file}, gold_files {file}, key_lines array<string>", ("g", "do it", "gold", [("x.py", "# x\n" + body)], [("a.py", body), ("b.py", "other")], ["  return value + 1 ", "short"]),
        ("s", "do it", "script", [("x.py", body)], [], ["return value + 1"]), ("p", "Implement ```" + "x" * 90 + "```", "script", None, None, None), ("n", None, None, None, None, None),
    ))


@_query(r"""SELECT * FROM (VALUES (1, true, true, 'x = 1' || chr(10) || 'y = 2'), (2, false, true, '# TODO later' || chr(10)), (3, false, false, 'debug = 1'), (4, false, false, '')) t(id, marked, with_todo, stripped)""")
def marker_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, t string", (1, "# BUG: wrong sign\nx = 1  # fixme soon\n// HACK\ny = 2"), (2, "# TODO later\n"), (3, "debug = 1"), (4, None))
    t = F.col("t")
    return df.select("id", gates.has_bug_marker(t).alias("marked"), gates.has_bug_marker(t, True).alias("with_todo"), gates.strip_bug_markers(t).alias("stripped"))


@_query("""WITH f AS (SELECT DISTINCT blob_id, case_id, path, coalesce(content, '') AS t FROM file_blobs), l AS (SELECT case_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10))) - CASE WHEN regexp_matches(t, '[\\r\\n]$') THEN 1 ELSE 0 END END AS n, CASE WHEN contains(path, 'test') THEN len(regexp_extract_all(t, '(?m)^\\s*def\\s+test_')) ELSE 0 END AS k FROM f),
  s AS (SELECT case_id, CAST(count(*) + sum(k) + sum(n) // 40 AS BIGINT) AS score FROM l GROUP BY 1) SELECT case_id, score, CASE WHEN score <= 4 THEN 'easy' WHEN score <= 12 THEN 'medium' ELSE 'hard' END AS difficulty FROM s""")
def size_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return gates.size_difficulty(table(spark, d, "file_blobs").select("blob_id", "case_id", "path", "content").distinct())


@_query("""WITH f AS (SELECT DISTINCT case_id, regexp_extract(path, '[^/\\\\]*$') AS name FROM file_blobs) SELECT case_id, count(*) AS files FROM f WHERE lower(name) IN ('conftest.py', 'pytest.ini', '.pytest.ini', 'pytest.toml', '.pytest.toml', 'setup.cfg', 'tox.ini', 'pyproject.toml', 'sitecustomize.py', 'usercustomize.py') GROUP BY 1""")
def control_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_blobs").select("case_id", records.base_name(F.col("path")).alias("name")).distinct()
    return f.where(helpers.is_collection_control(F.col("name"))).groupBy("case_id").agg(F.count("*").alias("files"))


@_query("""WITH r AS (SELECT case_id, arg_max(struct_pack(ok := ok, f := fingerprint, t := tier), audited_at) AS r FROM validity_reports GROUP BY 1), o AS (SELECT case_id, r.ok AS ok, r.f AS f, coalesce(nullif(r.t, ''), 'unset') AS tier FROM r), d AS (SELECT f FROM o WHERE f <> '' GROUP BY 1 HAVING count(*) > 1)
  SELECT tier, count(*) AS cases, count(*) FILTER (ok) AS ok, count(*) FILTER (f IN (SELECT f FROM d)) AS repeated FROM o GROUP BY 1""")
def set_audit(spark: SparkSession, d: str) -> DataFrame:
    return gates.set_audit(table(spark, d, "validity_reports"))


@_query("""WITH i AS (SELECT DISTINCT case_id, unnest(issues) AS i FROM validity_reports) SELECT i.code AS code, i.severity AS severity, count(DISTINCT case_id) AS cases FROM i GROUP BY 1, 2""")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.issue_fired(table(spark, d, "validity_reports"))


@_query("""SELECT * FROM (VALUES (1, 1, 2)) t(weak, invalid, kept)""")
def usable_case_examples(spark: SparkSession, d: str) -> DataFrame:
    return gates.usable_cases(_rows(spark, "case_id int, weak_grader boolean, validity_ok boolean", (1, True, False), (2, None, False), (3, False, None), (4, None, True)))[1]


_GATE = "id int, schema_ok boolean, generation string, allow_reverse boolean, audit_ok boolean, findings int, verbatim_share double, mode string, weak_grader boolean"


def _gated(spark: SparkSession) -> DataFrame:
    return _rows(
        spark, _GATE, (1, True, "llm", None, True, 0, 0.0, "script", False), (2, False, "llm", None, True, 0, 0.0, "gold", False), (3, True, "reverse", None, True, 0, 0.9, "script", False), (4, True, "hand", None, True, 0, 0.0, "gold", None),
        (5, True, "llm", None, False, 0, 0.0, "script", True), (6, True, "llm", None, None, 0, 0.0, "script", None), (7, True, "llm", None, True, 2, 0.0, "script", None), (8, True, "llm", None, True, 0, 0.06, "script", None), (9, True, "reverse", True, True, 0, 0.9, "script", None),
    )


@_query("""SELECT * FROM (VALUES ('accepted', 2), ('schema', 1), ('production_derived', 1), ('provenance', 1), ('audit', 1), ('audit_unverified', 1), ('secrets', 1), ('verbatim', 1)) t(outcome, cases)""")
def export_gate_examples(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_manifest(_gated(spark), gates.export_gates())


@_query("""SELECT * FROM (VALUES ('accepted', 4), ('schema', 1), ('non_script', 1), ('weak_grader', 1), ('audit', 1), ('secrets', 1)) t(outcome, cases)""")
def promote_gate_examples(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_manifest(_gated(spark), gates.promote_gates())


@_query("""WITH c AS (SELECT DISTINCT case_id, coalesce(prompt, '') AS prompt, coalesce(grader.mode, '') AS mode, coalesce(task_type, '') AS tt, coalesce(language, '') AS l FROM cases), v AS (SELECT case_id, count(DISTINCT prompt || chr(1) || tt || chr(1) || l) AS n FROM c GROUP BY 1)
  SELECT DISTINCT case_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(case_id, '^[A-Za-z0-9._-]{1,128}$') THEN 'case_id' END, CASE WHEN trim(prompt) = '' THEN 'prompt' END, CASE WHEN mode NOT IN ('script', 'gold', 'judge', 'mixed', 'composite', 'key_lines') THEN 'grader.mode' END, CASE WHEN n > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL), ',') AS violations
  FROM c JOIN v USING (case_id) WHERE violations <> ''""")
def case_violations(spark: SparkSession, d: str) -> DataFrame:
    return gates.constraint_violations(table(spark, d, "cases")).select("case_id", F.array_join("violations", ",").alias("violations"))


@_query("""SELECT * FROM (VALUES (1, 'a/b.py', 'impl'), (2, NULL, 'impl'), (3, 'x/tests/t.js', 'test'), (4, 'unnamed', 'spec'), (5, 'docs/r.md', 'spec')) t(id, path, role)""")
def role_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, path string, role string", (1, "\\a\\./b.py", " Stub "), (2, "../x.py", None), (3, "x/tests/t.js", "odd"), (4, "/", "readme"), (5, "docs/r.md", ""))
    return df.select("id", helpers.safe_relative_path(F.col("path")).alias("path"), helpers.normalize_role(F.col("role"), F.col("path")).alias("role"))


@_query("""SELECT * FROM (VALUES (1, NULL, true, 'python,-m,pytest'), (2, 'shell syntax', false, NULL), (3, 'program', false, '/bin/rm,-rf,x y'), (4, 'empty', true, NULL), (5, NULL, true, 'node,--test')) t(id, refusal, grader, words)""")
def command_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, c string", (1, "python -m pytest"), (2, "pytest -q > out"), (3, "/bin/rm -rf 'x y'"), (4, ""), (5, "node --test"))
    c = F.col("c")
    return df.select("id", helpers.command_refusal(c).alias("refusal"), helpers.is_safe_grader(c).alias("grader"), F.array_join(helpers.safe_command("c"), ",").alias("words"))


@_query("""SELECT * FROM (VALUES (1, 'a.py:x = 1', '{"files": [{"path": "a.py", "content": "x = 1"}]}'), (2, NULL, 'longer block'), (3, 'b.py:1', 'see {"files": [{"path": "b.py", "content": "1"}]} ok'), (4, NULL, '')) t(id, files, code)""")
def reply_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, t string", (1, '```json\n{"files": [{"path": "a.py", "content": "x = 1"}]}\n```'), (2, "```\nshort\n```\nthen\n```py\nlonger block\n```"), (3, 'see {"files": [{"path": "b.py", "content": "1"}]} ok'), (4, None))
    files = F.array_join(F.transform(helpers.reply_files(F.col("t")), lambda f: F.concat(f["path"], F.lit(":"), f["content"])), ",")
    return df.select("id", files.alias("files"), helpers.longest_block(F.col("t")).alias("code"))


@_query("""SELECT * FROM (VALUES (1, 3, 1, 0, 0.75, false), (2, 0, 0, 1, 0.0, true), (3, 0, 0, 0, NULL, true), (4, 5, 2, 0, 0.714286, false)) t(id, passed, failed, error, ratio, uncollectable)""")
def runner_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, code int, t string", (1, 1, "\x1b[32m3 passed\x1b[0m, 1 failed in 0.1s"), (2, 1, "1 error in 0.2s"), (3, 0, None), (4, 1, "ℹ pass 5\nℹ fail 2\n"))
    return df.select("id", helpers.test_counts(F.col("t")).alias("c"), F.round(helpers.pass_ratio(F.col("t")), 6).alias("ratio"), helpers.is_uncollectable(F.col("code"), F.col("t")).alias("uncollectable")).select("id", "c.*", "ratio", "uncollectable")


@_query("""SELECT * FROM (VALUES (1, 'solution.py', 'def f():' || chr(10) || '    return 1 + 1' || chr(10), 'def f():,return 1 + 1'), (2, NULL, NULL, ''), (3, 'solution.py', 'console.log("hello world")' || chr(10), 'console.log("hello world")')) t(id, path, content, key_lines)""")
def gold_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, texts array<string>", (1, ["```py\ndef f():\n    return 1 + 1\n\n```", "```js\nconsole.log('a longer one')\n```"]), (2, ["```py\nshort\n```"]), (3, ['```js\nconsole.log("hello world")\n```']))
    g = drafts.gold_block(F.col("texts"), "python")
    return df.select("id", g["path"].alias("path"), g["content"].alias("content"), F.array_join(drafts.gold_key_lines(g["content"]), ",").alias("key_lines"))


@_query("""SELECT * FROM (VALUES (1, 'short'), (2, 'original'), (3, 'original'), (4, 'original'), (5, 'original')) t(id, prompt)""")
def rewrite_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, r string, bad boolean, names array<string>", (1, "```\nshort\n```", False, []), (2, "The user wants me to", False, []), (3, "x" * 401, False, []), (4, "call parse_row", None, ["parse_row"]), (5, "fine", True, None))
    return df.select("id", drafts.accept_rewrite(F.lit("original"), F.col("r"), F.col("bad"), F.col("names")).alias("prompt"))


@_query("""SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false)) t(id, same)""")
def same_code_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(
        spark, "id int, a string, b string, p string", (1, 'def f():\n    "doc"\n    return 1\n', "def f():\n    # why\n    return 1\n", "a.py"), (2, "x = 1\n", "x = 2\n", "a.py"), (3, "f( 1 ) // x\n", "f( 1 )\n/* y */\n", "a.js"), (4, "a", "a b", "a.md"), (5, "s = '//a'", "s = '//b'", "a.ts"),
    )
    return df.select("id", drafts.same_code("a", "b", "p").alias("same"))


@_query("""SELECT * FROM (VALUES ('a.py', 'numpy,odd_lib'), ('b.mjs', '@org/x,left-pad')) t(path, missing)""")
def import_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "path string, content string", ("a.py", "import os, numpy as np\nfrom odd_lib.x import y\nfrom . import z\nimport yaml\n"), ("b.mjs", "import a from '@org/x/y';\nimport fs from 'node:fs';\nconst l = require('left-pad');\nimport './z.js';\n"), ("c.md", "import q"), ("d.py", None))
    return drafts.unsatisfied_imports(df, ["yaml"]).select("path", F.array_join("missing", ",").alias("missing"))


@_query("""WITH f AS (SELECT DISTINCT fv_id, path, pre, post, pre_origin FROM file_versions WHERE pre IS NOT NULL AND post IS NOT NULL AND pre <> post AND pre_origin = 'read_complete'),
  g AS (SELECT *, lower(regexp_extract(path, '[^/\\\\]*$')) AS name FROM f) SELECT count(*) AS pairs FROM g WHERE NOT regexp_matches(name, '^test_.*\\.pyi?$|_test\\.pyi?$|\\.(test|spec)\\.[mc]?[jt]sx?$') AND NOT regexp_matches(lower(path), '(^|[/\\\\])(tests?|__tests__)[/\\\\]')""")
def vouched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs read in full and no tests; those that only move comments are kept here, ``usable_pairs`` drops them."""
    f = table(spark, d, "file_versions").select("fv_id", "path", "pre", "post", "pre_origin").distinct().where("pre <> post and pre_origin = 'read_complete'")
    return f.where(~records.is_test_path(F.col("path"))).agg(F.count("*").alias("pairs"))


@_query()
def usable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edit pairs for reverse construction; whether an edit moves more than comments needs a parser."""
    f = table(spark, d, "file_versions").select("fv_id", "path", "pre", "post", "pre_origin").distinct()
    return drafts.usable_pairs(f).select("fv_id", "path", "gap")


@_query()
def session_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of all coding sessions; masking with a parse veto has no SQL."""
    out = drafts.session_drafts(table(spark, d, "sessions"))
    return out.select("case_id", "session_id", "prompt", F.size("files").alias("files"), F.size("gold_files").alias("gold_files"), "mode", "fingerprint")


@_query()
def record_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of all coding chat records, with signals and tier."""
    out = drafts.record_drafts(table(spark, d, "chat_records"), table(spark, d, "messages"))
    return out.select("request_id", "start_time", "prompt", "task_type", "language", F.size("files").alias("files"), "tool_calls", "tier", "fingerprint")


@_query("""SELECT * FROM (VALUES ('sess-s1-', 's1', 'fix the bug: token = "***"', 'a.py', 'gold'), ('sess-s3-', 's3', 'implement it', 'main.py', 'script')) t(case_id, session_id, prompt, paths, mode)""")
def session_draft_examples(spark: SparkSession, d: str) -> DataFrame:
    schema = "session_id string, messages array<struct<role:string,content:string>>, artifacts array<struct<type:string,path:string,content:string,accepted:boolean>>"
    one = [("user", "hello"), ("assistant", "x"), ("user", 'fix the bug: token = "abcdef9" ')]
    files = [("file", "a.py", "x = 1\n", None), ("gold_file", "a.py", "x = 2\n", True), ("gold_file", "b.py", "x = 2\n", False)]
    df = _rows(spark, schema, ("s1", one, files), ("s2", one, files), ("s3", [("user", "implement it")], None), ("s4", [("user", "nice day")], None), ("s5", None, None), (None, one, files))
    out = drafts.session_drafts(df)
    return out.select(F.regexp_replace("case_id", "[0-9a-f]{16}$", "").alias("case_id"), "session_id", "prompt", F.array_join(F.transform("files", lambda f: f["path"]), ",").alias("paths"), "mode")


@_query("""SELECT * FROM (VALUES ('a1', 'T3', 'A5'), ('a1', 'T4', 'A2,A5')) t(anchor, tier, missing)""")
def anchor_examples(spark: SparkSession, d: str) -> DataFrame:
    anchors = _rows(spark, "anchor string, axes array<string>", ("a1", ["A1", "A6"]), ("a2", None), ("a3", ["A1", "A2", "A5", "A6"]))
    tiers = _rows(spark, "tier string, required array<string>", ("T1", []), ("T3", ["A1", "A5", "A6"]), ("T4", ["A1", "A2", "A5", "A6"]))
    return calibration.unfit_anchors(anchors, tiers).select("anchor", "tier", F.array_join("missing", ",").alias("missing"))


def _ranked(spark: SparkSession) -> DataFrame:
    return _rows(
        spark, "case_id string, tier string, band string, spread double, point_biserial double", *[(f"c{i:02}", ["T1", "T2", "T3"][i % 3], ["hard", "mid", "easy"][i % 4 % 3], round(1 - i / 40, 3), None if i % 5 == 0 else i / 100) for i in range(24)]
    )


@_query("""SELECT * FROM (VALUES ('c00', 1), ('c01', 2), ('c02', 3), ('c03', 4), ('c06', 5), ('c09', 6)) t(case_id, rank)""")
def fill_quota_examples(spark: SparkSession, d: str) -> DataFrame:
    """Half T1 (3 of 6), a tenth T2 (1 of 6), T9 empty; the rest by rank: c00 c03 c06, c01, then c02 and c04 fill."""
    return calibration.fill_quota(_ranked(spark), "tier", {"T1": 0.7, "T2": 0.1, "T9": 0.2}, 6).select("case_id", "rank")


@_query("""SELECT * FROM (VALUES ('easy', 'T1', 1), ('hard', 'T1', 2), ('hard', 'T2', 1), ('mid', 'T1', 1), ('mid', 'T2', 1)) t(band, tier, n)""")
def nested_quota_examples(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.nested_quota(_ranked(spark), {"hard": 0.5, "mid": 0.3, "easy": 0.2}, 6, {"T1": 0.5, "T2": 0.5})
    return out.groupBy("band", "tier").agg(F.count("*").alias("n"))


@_query("""SELECT * FROM (VALUES ('a', 0.95, 'too_easy', 'easy'), ('b', 0.5, '', 'mid'), ('c', 0.5, 'incomplete_panel', 'mid'), ('d', NULL, 'incomplete_panel', 'unmeasured')) t(case_id, p_hat, reasons, band)""")
def merge_examples(spark: SparkSession, d: str) -> DataFrame:
    item = "case_id string, p_hat double, point_biserial double, measured long"
    new, old = _rows(spark, item, ("a", 0.95, 0.3, 2), ("d", None, None, 0)), _rows(spark, item, ("a", 0.5, 0.3, 2), ("b", 0.5, None, 2), ("c", 0.5, 0.3, 1))
    return calibration.merge_reused(new, old, 2).select("case_id", "p_hat", F.array_join("reasons", ",").alias("reasons"), "band")


@_query("""SELECT id, CASE WHEN id = 1 THEN substr(sha256('[[["a.py", "x = \\"1\\"\\n"], ["b.py", ""]], [["a.py", "x"]]]'), 1, 16) END AS key FROM range(1, 4) t(id)""")
def solution_key_examples(spark: SparkSession, d: str) -> DataFrame:
    """Pairs are sorted and nulls are empty; a case without gold or without implementation has no key."""
    pair = "array<struct<path:string,content:string>>"
    df = _rows(spark, f"id int, impl {pair}, gold {pair}", (1, [("b.py", None), ("a.py", 'x = "1"\n')], [("a.py", "x")]), (2, [("a", "b")], []), (3, None, [("a", "b")]))
    return df.select("id", text.solution_key(F.col("impl"), F.col("gold")).alias("key"))


@_query("""SELECT * FROM (VALUES (1, 'explicit_bug_pointer,line_number', 'error'), (2, '', 'warn'), (3, 'off_by_one,wrong_mechanism', 'error'), (4, '', NULL), (5, 'cn_replace_directive', 'error')) t(id, patterns, severity)""")
def disclosure_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, p string, said boolean", (1, "The bug is in f, at line 3.", None), (2, "f is slow", True), (3, "an off-by-one, wrong index", True), (4, None, None), (5, "把 `a` 改成 b", False))
    return df.select("id", cases.disclosures(F.col("p")).alias("x"), "said").select("id", F.array_join("x", ",").alias("patterns"), cases.disclosure_issue(F.col("x"), F.col("said"))["severity"].alias("severity"))


@_query("""WITH c AS (SELECT DISTINCT case_id, coalesce(prompt, '') AS p FROM cases) SELECT count(*) FILTER (regexp_matches(p, '(?i)\\boff[-\\s]?by[-\\s]?one\\b')) AS off_by_one, count(*) FILTER (regexp_matches(p, '(?i)\\b(?:is|are|was|were)\\s+inverted\\b|\\binverted\\s+\\w+')) AS inverted, count(*) FILTER (regexp_matches(p, '(?i)(?:仍(?:然)?使用|still\\s+use[sd]?)\\s*`?[\\w/.-]+`?')) AS still_uses_old, count(*) AS prompts FROM c""")
def disclosure_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").select("case_id", "prompt").distinct().select(cases.disclosures(F.col("prompt")).alias("x"))
    return c.agg(*[F.count_if(F.array_contains("x", n)).alias(n) for n in ("off_by_one", "inverted", "still_uses_old")], F.count("*").alias("prompts"))


@_query("""WITH k AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM file_blobs WHERE case_id IS NOT NULL)),
  d AS (SELECT h.case_id AS host, d.case_id AS donor, j AS place FROM k h, range(1, 3) r(j), k d WHERE d.i = (h.i + j) % h.n), f AS (SELECT DISTINCT blob_id, case_id, position, path, content, role FROM file_blobs WHERE case_id IS NOT NULL),
  s AS (SELECT case_id AS donor, position, regexp_extract(path, '[^/\\\\]*$') AS name FROM f WHERE coalesce(role, 'impl') = 'impl' AND NOT (regexp_matches(lower(name), '^test_.*\\.pyi?$|_test\\.pyi?$|\\.(test|spec)\\.[mc]?[jt]sx?$') OR regexp_matches(lower(path), '(^|[/\\\\])(tests?|__tests__)[/\\\\]'))
    AND lower(name) NOT IN ('conftest.py', 'pytest.ini', '.pytest.ini', 'pytest.toml', '.pytest.toml', 'setup.cfg', 'tox.ini', 'pyproject.toml', 'sitecustomize.py', 'usercustomize.py')),
  o AS (SELECT DISTINCT host AS case_id, 'vendor/' || donor || '/' || name AS path FROM d JOIN s USING (donor)), n AS (SELECT case_id, count(*) AS own FROM f GROUP BY 1)
  SELECT n.case_id, own, least(greatest(6 - own, 0), (SELECT count(*) FROM o WHERE o.case_id = n.case_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.case_id = o.case_id AND f.path = o.path))) AS planted FROM n""")
def composed_cases(spark: SparkSession, d: str) -> DataFrame:
    """How many files each case ships, and how many of two donors are planted beside them."""
    files = table(spark, d, "file_blobs").where("case_id is not null").select("blob_id", "case_id", "position", "path", "content", "role").distinct()
    donors = text.rotation_compose(files, "case_id", 2)
    return cases.compose(files, donors).groupBy("case_id").agg(F.count_if(~F.col("planted")).alias("own"), F.count_if("planted").alias("planted"))


@_query("""WITH f AS (SELECT DISTINCT case_id, path, coalesce(content, '') AS content, role FROM file_blobs WHERE case_id IS NOT NULL), m AS (SELECT *, regexp_replace(regexp_extract(path, '[^/\\\\]*$'), '\\.[^.]*$', '') AS module FROM f)
  SELECT case_id, count(DISTINCT path) AS files FROM m WHERE role = 'impl' AND NOT EXISTS (SELECT 1 FROM f o WHERE o.case_id = m.case_id AND o.role IN ('impl', 'test') AND o.path <> m.path AND contains(o.content, m.module)) GROUP BY 1""")
def unreferenced_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_blobs").where("case_id is not null").select("case_id", "path", "content", "role").distinct().withColumn("gold", F.lit(False))
    return cases.unreferenced(files).distinct().groupBy("case_id").agg(F.count("*").alias("files"))


def _files(spark: SparkSession, *rows: tuple) -> DataFrame:
    return _rows(spark, "case_id string, path string, content string, role string", *rows)


@_query("""SELECT * FROM (VALUES ('a', 'm.py', '', 'x'), ('a', 'n.py', 's', 't')) t(case_id, path, stub, gold)""")
def gold_pair_examples(spark: SparkSession, d: str) -> DataFrame:
    shipped = _files(spark, ("a", "n.py", "s", "impl"), ("a", "same.py", "q", None), ("a", "d.md", "d", "spec"))
    gold = _files(spark, ("a", "m.py", "x", None), ("a", "n.py", "t", None), ("a", "same.py", "q", None), ("a", "test_m.py", "t", None), ("a", "d.md", "e", None))
    return cases.impl_gold_pairs(shipped, gold)


@_query("""SELECT * FROM (VALUES ('a', 'gone.py', 'protected_path_deleted'), ('a', 'new.py', 'protected_path_not_in_context'), ('a', 't/x.py', 'protected_path_modified')) t(case_id, path, violation)""")
def protection_examples(spark: SparkSession, d: str) -> DataFrame:
    shipped = _files(spark, ("a", "gone.py", "1", None), ("a", "t/x.py", "1", None), ("a", "ok.py", "1", None))
    found = _files(spark, ("a", "t/x.py", "2", None), ("a", "ok.py", "1", None), ("a", "new.py", "1", None))
    return cases.protected_violations(_files(spark, *[("a", p, None, None) for p in ("gone.py", "/t/x.py", "ok.py", "new.py")]), shipped, found)


@_query("""SELECT * FROM (VALUES ('a', 'conftest.py', 'grading_interference_file_modified'), ('a', 'x/PYTEST.ini', 'grading_interference_file'), ('a', 'z.py', 'grading_interference_skip_marker')) t(case_id, path, violation)""")
def interference_examples(spark: SparkSession, d: str) -> DataFrame:
    shipped, gold = _files(spark, ("a", "conftest.py", "1", None), ("a", "setup.cfg", "1", None)), _files(spark, ("a", "setup.cfg", "2", None))
    found = _files(spark, ("a", "conftest.py", "2", None), ("a", "setup.cfg", "2", None), ("a", "x/PYTEST.ini", "", None), ("a", "z.py", "@pytest.mark.skipif(True)", None), ("a", "tox.ini", "base", None), ("a", "y.py", "ok", None))
    base = _files(spark, ("a", "tox.ini", "base", None)).select("case_id", "path", F.sha2("content", 256).alias("sha256"))
    return cases.interference(found, shipped, gold, base)


@_query("""SELECT * FROM (VALUES (1, 0.5, 2, 0.5), (2, 0.0, 0, 0.0), (3, 1.0, 1, 0.0)) t(id, ratio, changed, overlap)""")
def diff_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "id int, a string, b string, issue string", (1, "x\ny\n", "x\nparse_row(z)\n", "Parse_Row fails"), (2, "q\n", "q\n", "any thing"), (3, None, "new\n", ""))
    diff = cases.unified_diff("a", "b", F.lit("f.py"))
    out = df.withColumn("diff", diff)
    return out.select("id", cases.change_ratio("a", "b").alias("ratio"), cases.changed_lines(F.col("diff")).alias("changed"), F.round(cases.issue_overlap(F.col("issue"), F.col("diff")), 6).alias("overlap"))


@_query("""SELECT * FROM (VALUES ('a', 'n.py', 'solution_file_unchanged', 'error'), ('a', 'm.py', 'solution_rewrites_file', 'warn')) t(case_id, path, code, severity)""")
def solution_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "case_id string, path string, stub string, gold string", ("a", "n.py", "s", "s"), ("a", "m.py", "1\n2\n3", "4\n5\n6"), ("a", "ok.py", "1\n2\n3", "1\n2\n4"), ("a", "new.py", None, "x"))
    return cases.solution_issues(df)


@_query("""SELECT * FROM (VALUES (1, '/etc/passwd'), (3, '../../x'), (4, '~/secret')) t(call, outside)""")
def escape_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _rows(spark, "call int, tool string, arguments string", (1, "bash", '{"command": "cat /etc/passwd src/a.py"}'), (2, "read", '{"filePath": "/w/src/a.py"}'), (3, "edit", '{"path": "../../x"}'), (4, "bash", '{"command": "ls -la \'~/secret\'"}'), (5, "bash", "{cut"))
    return cases.escapes(df, "/w").select("call", F.array_join("outside", ",").alias("outside"))


@_query("""SELECT * FROM (VALUES (1, '[23.7%, 76.3%]'), (2, NULL)) t(id, interval_text)""")
def interval_examples(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, "id int, s int, n int", (1, 5, 10), (2, 0, 0)).select("id", cases.format_interval(F.col("s"), F.col("n")).alias("interval_text"))


@_query("""SELECT * FROM (VALUES ('b', true, true), ('c', false, false), ('d', true, false)) t(candidate, comparable, self_repeat)""")
def comparable_examples(spark: SparkSession, d: str) -> DataFrame:
    runs = _rows(spark, "run_id string, oracle boolean, differs array<string>", ("a", None, None), ("b", False, []), ("c", True, ["model"]))
    return cases.comparable_pairs(_rows(spark, "candidate string", ("b",), ("c",), ("d",)), runs, "a")


@_query("""SELECT * FROM (VALUES (true, false, false)) t(stable, moved, plain)""")
def fingerprint_examples(spark: SparkSession, d: str) -> DataFrame:
    """Blanks around the prompt and the order of protected paths do not matter; a command, or the order of files, does."""
    schema = "k string, c struct<prompt:string,task_type:string,language:string,files:array<struct<path:string,content:string>>,grader:struct<mode:string,command:string,protected_paths:array<string>>>"
    files = [("a", "1"), ("b", None)]
    case = lambda prompt, fs, command, paths: (prompt, "bugfix", "python", fs, ("script", command, paths))
    df = _rows(spark, schema, ("x", case("p", files, "c", ["s", "t"])), ("y", case(" p\n", files, "c", ["t", "s"])), ("z", case("p", files, "d", ["s", "t"])), ("v", case("p", files[::-1], "c", ["s", "t"])))
    f = df.select("k", cases.case_fingerprint("c").alias("f")).groupBy().pivot("k", ["x", "y", "z", "v"]).agg(F.first("f"))
    return f.select((F.col("x") == F.col("y")).alias("stable"), (F.col("x") == F.col("z")).alias("moved"), (F.col("x") == F.col("v")).alias("plain"))


@_query("""WITH f AS (SELECT DISTINCT fv_id, path, pre, post, pre_origin FROM file_versions WHERE pre <> post AND pre_origin = 'read_complete' AND path LIKE '%.py'), g AS (SELECT *, regexp_extract(path, '[^/\\\\]*$') AS name FROM f)
  SELECT name, count(DISTINCT md5(pre) || md5(post)) AS edits FROM g WHERE NOT regexp_matches(lower(name), '^test_.*\\.pyi?$|_test\\.pyi?$') AND NOT regexp_matches(lower(path), '(^|[/\\\\])(tests?|__tests__)[/\\\\]') GROUP BY 1""")
def human_edits(spark: SparkSession, d: str) -> DataFrame:
    return cases.human_edits(table(spark, d, "file_versions")).groupBy("name").agg(F.count("*").alias("edits"))
