"""Checks of cases: leaks, markers, tool footers, size, files that control the tests; set audits and publication order."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import traces
from millrace.operators.helpers import is_collection_control

# Words of defect and task comments.
_BUG, _TODO = r"(?:BUG|FIXME|XXX|HACK|WRONG|INCORRECT)\b", r"TODO\b"
_LINE, _END = r"(?im)^[ \t]*(?:#|//|/\*|\*)[ \t]*", r"(?im)[ \t]*(?:#|//)[ \t]*"
#: Characters from which a gold file, and a key line, found in the context counts as a leak.
GOLD_CHARS, KEY_CHARS = 40, 8


def has_bug_marker(content: Column, todo: bool = False) -> Column:
    """Whether a line is a comment that marks a defect (or, if asked, an open task)."""
    t = F.coalesce(content, F.lit(""))
    return t.rlike(_LINE + _BUG) | (t.rlike(_LINE + _TODO) if todo else F.lit(False))


def strip_bug_markers(content: Column, todo: bool = False) -> Column:
    """Lines that are only such a comment are dropped, such ends of lines cut."""
    marks = f"(?:{_BUG}|{_TODO})" if todo else _BUG
    whole = F.regexp_replace(F.coalesce(content, F.lit("")), _LINE + marks + r".*(?:\n|\z)", "")
    return F.regexp_replace(whole, _END + _BUG + ".*$", "")


def leaks(cases: DataFrame) -> DataFrame:
    """``(case_id, code, what)``: gold files and key lines that stand in the context already, and prompts with a large block.

    ``cases(case_id, prompt, mode, files, gold_files, key_lines)``; files are arrays of (path, content). The search stays
    within a row. Key lines count under mode `gold` only.
    """
    blob = F.array_join(F.transform("files", lambda f: F.concat(F.coalesce(f["path"], F.lit("")), F.lit("\n"), F.coalesce(f["content"], F.lit("")))), "\n")
    body = lambda f: F.regexp_replace(F.coalesce(f["content"], F.lit("")), r"^\s+|\s+$", "")
    rows = cases.withColumn("_b", F.coalesce(blob, F.lit("")))
    empty = F.array().cast("array<string>")
    gold = F.coalesce(F.transform(F.filter("gold_files", lambda f: (F.length(body(f)) >= GOLD_CHARS) & F.col("_b").contains(body(f))), lambda f: f["path"]), empty)
    lines = F.coalesce(F.filter(F.transform("key_lines", lambda k: F.trim(F.coalesce(k, F.lit("")))), lambda k: (F.length(k) >= KEY_CHARS) & F.col("_b").contains(k)), empty)
    fence = F.col("prompt").rlike(r"(?s)```.{80,}```") & F.lower("prompt").contains("implement")
    found = F.concat(
        F.transform(gold, lambda p: F.struct(F.lit("contamination_gold_in_context").alias("code"), p.alias("what"))),
        F.transform(F.when(F.col("mode") == "gold", lines).otherwise(empty), lambda k: F.struct(F.lit("contamination_keyline_in_context").alias("code"), F.substring(k, 1, 60).alias("what"))),
        F.when(F.coalesce(fence, F.lit(False)), F.array(F.struct(F.lit("prompt_contains_large_code_fence").alias("code"), F.lit("prompt").alias("what")))).otherwise(F.array().cast("array<struct<code:string,what:string>>")),
    )
    return rows.select("case_id", F.explode(found).alias("x")).select("case_id", "x.code", "x.what")


@F.pandas_udf(T.BooleanType())
def has_tool_footer(texts: pd.Series) -> pd.Series:
    return pd.Series([t is not None and traces.read_footer(t)[1] != "read_unlabelled" for t in texts])


def footer_issues(files: DataFrame) -> DataFrame:
    """``(case_id, path)`` of graded files (role impl, gold, hidden or protected) that end in a read tool's footer."""
    graded = files.where("role in ('impl', 'gold', 'hidden') or protected")
    return graded.where(F.col("content").rlike(r"(?m)^\s*\((End of file|Showing lines|File has more lines|Output (capped|truncated))")).where(has_tool_footer("content")).select("case_id", "path").distinct()


def control_file_issues(files: DataFrame) -> DataFrame:
    """``(case_id, path)`` of gold files whose name controls what the tests collect."""
    name = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    return files.where("role = 'gold'").where(is_collection_control(name)).select("case_id", "path").distinct()


def size_difficulty(files: DataFrame) -> DataFrame:
    """``(case_id, score, difficulty)`` by files, Python test functions in test files, and every 40 lines: up to 4 easy, 12 medium, else hard."""
    t = F.coalesce("content", F.lit(""))
    lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\r\n?", "\n"), "\n")) - F.when(t.rlike(r"[\r\n]\z"), 1).otherwise(0))
    tests = F.when(F.col("path").contains("test"), F.regexp_count(t, F.lit(r"(?m)^\s*def\s+test_"))).otherwise(0)
    rows = files.groupBy("case_id").agg((F.count("*") + F.sum(tests) + F.floor(F.sum(lines) / 40)).cast("long").alias("score"))
    return rows.withColumn("difficulty", F.when(F.col("score") <= 4, "easy").when(F.col("score") <= 12, "medium").otherwise("hard"))


def usable_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases that may be run, and counts ``(weak, invalid, kept)``: weak graders go first, then those with validity_ok false; null stays."""
    weak, bad = F.coalesce("weak_grader", F.lit(False)), F.col("validity_ok").eqNullSafe(F.lit(False))
    counts = cases.agg(F.count_if(weak).alias("weak"), F.count_if(~weak & bad).alias("invalid"), F.count_if(~weak & ~bad).alias("kept"))
    return cases.where(~weak & ~bad), counts


def first_refusal(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that refuses a row (true), null if none does; a null counts as no."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in gates])


def export_gates(max_verbatim: float = 0.05) -> list[tuple[str, Column]]:
    """The order in which a case is refused for a bundle; columns of booleans, ``generation`` and ``verbatim_share``."""
    made = F.coalesce("generation", F.lit(""))
    return [
        ("schema", ~F.col("schema_ok")), ("production_derived", (made == "reverse") & ~F.coalesce("allow_reverse", F.lit(False))), ("provenance", ~made.isin("llm", "reverse")),
        ("audit", F.col("audit_ok").eqNullSafe(F.lit(False))), ("audit_unverified", F.col("audit_ok").isNull()), ("secrets", F.col("findings") > 0),
        ("verbatim", (made != "reverse") & (F.col("verbatim_share") > max_verbatim)),
    ]


def promote_gates() -> list[tuple[str, Column]]:
    """The order in which a case is refused for publication."""
    return [("schema", ~F.col("schema_ok")), ("non_script", F.col("mode") != "script"), ("weak_grader", F.col("weak_grader")), ("secrets", F.col("findings") > 0), ("audit", ~F.coalesce("audit_ok", F.lit(False)))]


def gate_manifest(cases: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """``(outcome, cases)``: how many cases each gate refuses, and how many pass (`accepted`)."""
    return cases.groupBy(F.coalesce(first_refusal(gates), F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("cases"))


def scrubbed(metadata: Column, keys: tuple[str, ...] = ("validity_issues", "validity_checks")) -> Column:
    """A metadata map without the details of audits."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*keys))


def set_audit(reports: DataFrame) -> DataFrame:
    """``(tier, cases, ok, repeated)`` of a set: cases, those without an error, and those whose fingerprint another case has."""
    one = reports.groupBy("case_id").agg(F.max_by(F.struct("ok", "fingerprint", "tier"), "audited_at").alias("r")).select("case_id", "r.*")
    twice = one.where("fingerprint <> ''").groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint", F.lit(True).alias("twice"))
    both = one.join(twice, "fingerprint", "left")
    return both.groupBy(F.coalesce(F.nullif("tier", F.lit("")), F.lit("unset")).alias("tier")).agg(F.count("*").alias("cases"), F.count_if("ok").alias("ok"), F.count_if("twice").alias("repeated"))


def issue_fired(reports: DataFrame) -> DataFrame:
    """``(code, severity, cases)``: in how many cases' reports each issue occurs."""
    rows = reports.select("case_id", F.explode("issues").alias("i")).select("case_id", "i.code", "i.severity").distinct()
    return rows.groupBy("code", "severity").agg(F.count("*").alias("cases"))


def constraint_violations(cases: DataFrame) -> DataFrame:
    """``(case_id, violations)`` of cases: missing id, prompt or mode; unknown mode; ids used twice by different rows."""
    modes = ["script", "gold", "judge", "mixed", "composite", "key_lines"]
    h = F.xxhash64(*[c for c in ("prompt", "task_type", "language") if c in cases.columns])
    twice = cases.groupBy("case_id").agg(F.count_distinct(h).alias("versions"))
    rows = cases.select("case_id", "prompt", F.col("grader.mode").alias("mode")).distinct().join(twice, "case_id")
    mode = F.coalesce("mode", F.lit(""))
    why = F.array_compact(F.array(
        F.when(~F.coalesce("case_id", F.lit("")).rlike(r"^[A-Za-z0-9._-]{1,128}$"), "case_id"), F.when(F.trim(F.coalesce("prompt", F.lit(""))) == "", "prompt"),
        F.when(~mode.isin(modes), "grader.mode"), F.when(F.col("versions") > 1, "duplicate"),
    ))
    return rows.select("case_id", why.alias("violations")).where("size(violations) > 0").distinct()


def estimated_issues(*issues: DataFrame) -> DataFrame:
    """``(case_id, codes, ok)``: all codes of a case from several checks, and whether none is an error; checks give (case_id, code, severity)."""
    rows = reduce(DataFrame.unionByName, [i.select("case_id", "code", "severity") for i in issues]).distinct()
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), (F.count_if(F.col("severity") == "error") == 0).alias("ok"))
