"""Cases as rows of files: fingerprints, composition, distractors, protection, interference, disclosures, sizes of changes."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.stats import wilson
from millrace.operators.helpers import is_collection_control, outside_paths, safe_relative_path
from millrace.operators.records import base_name, is_test_path

# Patterns by which a prompt gives a defect away, marks of skipped tests, scheme of fingerprints, folder of planted files.
DISCLOSURES = [
    ("explicit_bug_pointer", r"(?i)\bthe\s+bug\s+is\s+(?:in|at|on)\b"),
    ("line_number", r"(?i)\b(?:on|at|in)\s+line\s+\d+\b|第\s*\d+\s*行"),
    ("cn_root_cause", r"(?i)(?:问题|错误|缺陷|bug)\s*(?:出在|在于|位于)"),
    ("uses_instead_of", r"(?i)\bus(?:es|ing|ed)\b[^.。;；]{0,80}\binstead of\b"),
    ("inverted", r"(?i)\b(?:is|are|was|were)\s+inverted\b|\binverted\s+\w+"),
    ("swapped", r"(?i)\b(?:is|are|was|were|gets?)\s+swapped\b|\bswapped\s+\w+"),
    ("off_by_one", r"(?i)\boff[-\s]?by[-\s]?one\b"),
    ("wrong_mechanism", r"(?i)\b(?:wrong|incorrect|bad)\s+(?:diagonal|offset|index|indices|sign|operator|comparison|variable|key|field|argument|parameter|delimiter|separator|version|order\s+of|direction|branch|condition|boundary|slice|axis|dimension)\b"),
    ("missing_construct", r"(?i)\bmissing\s+(?:the\s+)?(?:argument|parameter|call\s+to|return|break|await|import|guard|check\s+for)\b"),
    ("replace_directive", r"(?i)\b(?:replace|change)\s+`[^`]+`\s+(?:with|to)\b"),
    ("cn_replace_directive", r"把\s*`?[^`\s，。]+`?\s*(?:改成|换成|替换为|改为)"),
    ("cn_current_impl", r"(?:当前|现在|目前|原来)(?:的)?(?:实现|代码|逻辑|版本)?[^。；\n]{0,20}(?:用了|使用了|写成了|少了|漏了|多了|写反|搞反|颠倒)"),
    ("cn_reversed", r"(?:写反了|搞反了|顺序(?:弄|搞)?反了|正好相反)"),
    ("inline_bug_marker", r"(?i)(?:^|\s)(?:#\s*)?(?:BUG|FIXME|XXX)\s*[:：]"),
    ("still_uses_old", r"(?i)(?:仍(?:然)?使用|still\s+use[sd]?)\s*`?[\w/.-]+`?"),
]
_SKIPS = r"@(?:pytest\.mark\.(?:skip|skipif|xfail)|unittest\.skip(?:If|Unless)?)\b|\bpytest\.skip\s*\(|\bpytest\.exit\s*\(|\braise\s+unittest\.SkipTest\b"
SCHEME, PLANTED = "v3", "vendor"
#: Share of a solution's lines that may differ from the file it starts from before it counts as a rewrite.
REWRITE = 0.6


def disclosures(prompt: Column) -> Column:
    """Names of the patterns by which a prompt names the defect, in order; empty for null."""
    p = F.coalesce(prompt, F.lit(""))
    return F.array_compact(F.array(*[F.when(p.rlike(rule), name) for name, rule in DISCLOSURES]))


def disclosure_issue(patterns: Column, reviewer: Column) -> Column:
    """``(code, severity)``: an error if a pattern hit, a warning if only a reviewer says so, else null."""
    out = lambda code, level: F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))
    return F.when(F.size(patterns) > 0, out("prompt_discloses_defect", "error")).when(F.coalesce(reviewer, F.lit(False)), out("prompt_discloses_defect_llm", "warn"))


def _digests(files) -> list[list[str]]:
    return [[f["path"] or "", hashlib.sha256((f["content"] or "").encode("utf-8", "surrogatepass")).hexdigest()] for f in (files if files is not None else [])]


def fingerprint(case: dict) -> str:
    """Identity of a case by all that decides its verdict: prompt, type, language, files in order, grader, workspace."""
    g, text = case.get("grader") or {}, lambda k: str(case.get(k) or "")
    basis = {
        "version": SCHEME, "task_type": text("task_type"), "language": text("language"), "prompt": text("prompt").strip(), "files": _digests(case.get("files")), "workspace": case.get("workspace") or "",
        "grader": {
            **{k: str(g.get(k) or "") for k in ("mode", "command", "match", "judge_rubric")}, "judge_threshold": g.get("judge_threshold"), "key_lines": list(g.get("key_lines") if g.get("key_lines") is not None else []),
            "protected_paths": sorted(g.get("protected_paths") if g.get("protected_paths") is not None else []), "gold_files": _digests(g.get("gold_files")), "hidden_tests": _digests(g.get("hidden_tests")),
        },
    }
    return f"{SCHEME}:{hashlib.sha256(json.dumps(basis, sort_keys=True, ensure_ascii=False).encode('utf-8', 'surrogatepass')).hexdigest()[:16]}"


@F.pandas_udf(T.StringType())
def case_fingerprint(cases: pd.DataFrame) -> pd.Series:
    """``fingerprint`` of a struct column ``(prompt, task_type, language, files, grader)``; fields that a case lacks count as empty."""
    return pd.Series([fingerprint(r) for r in cases.to_dict("records")], dtype=object)


def donor_files(files: DataFrame) -> DataFrame:
    """Files of cases that can be planted elsewhere: role impl (also undeclared), no test by name, none that controls test runs."""
    name = base_name(F.col("path"))
    return files.where(F.coalesce("role", F.lit("impl")) == "impl").where(~is_test_path(F.col("path"))).where(~is_collection_control(name))


def compose(files: DataFrame, donors: DataFrame, target: int = 6) -> DataFrame:
    """``(case_id, path, content, planted)`` of hosts with donor files planted until each has ``target`` files.

    ``files(case_id, position, path, content, role)``, ``donors(host, donor, place)``. Donor files go to
    ``vendor/<donor>/<name>`` in order of place and position; a path that is there already is skipped.
    """
    own = files.select("case_id", "path", "content", F.lit(False).alias("planted"))
    spare = donor_files(files).select(F.col("case_id").alias("donor"), "position", base_name(F.col("path")).alias("name"), "content")
    offered = donors.join(spare, "donor").select(F.col("host").alias("case_id"), "place", "position", F.concat_ws("/", F.lit(PLANTED), "donor", "name").alias("path"), "content")
    offered = offered.groupBy("case_id", "path").agg(F.min_by(F.struct("place", "position", "content"), F.struct("place", "position")).alias("f")).select("case_id", "path", "f.*")
    offered = offered.join(own.select("case_id", "path"), ["case_id", "path"], "left_anti")
    room = own.groupBy("case_id").agg((F.lit(target) - F.count("*")).alias("room")).where("room > 0")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("place", "position", "path"))
    added = offered.join(room, "case_id").withColumn("r", rank).where("r <= room")
    return own.unionByName(added.select("case_id", "path", "content", F.lit(True).alias("planted")))


def unreferenced(files: DataFrame) -> DataFrame:
    """``(case_id, path)`` of impl files that no gold file changes and whose module no other impl or test file of the case names.

    ``files(case_id, path, content, role, gold)``; meetings are within a case.
    """
    module = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    mine = files.where("role = 'impl' and not gold").select("case_id", "path", module.alias("module"))
    others = files.where("role in ('impl', 'test')").select("case_id", F.col("path").alias("other"), F.coalesce("content", F.lit("")).alias("text"))
    hit = mine.join(others, "case_id").where("other <> path and contains(text, module)").select("case_id", "path").distinct()
    return mine.select("case_id", "path").join(hit, ["case_id", "path"], "left_anti")


def impl_gold_pairs(context: DataFrame, gold: DataFrame) -> DataFrame:
    """``(case_id, path, stub, gold)``: gold files with the file they replace ('' if new); equal pairs and tests, specs and distractors are left out."""
    c = context.select("case_id", "path", "role", F.col("content").alias("stub"))
    rows = gold.select("case_id", "path", F.coalesce("content", F.lit("")).alias("gold")).join(c, ["case_id", "path"], "left")
    rows = rows.where(F.coalesce("role", F.lit("impl")) == "impl").where(~is_test_path(F.col("path")))
    return rows.select("case_id", "path", F.coalesce("stub", F.lit("")).alias("stub"), "gold").where("stub <> gold")


def protected_violations(protected: DataFrame, shipped: DataFrame, found: DataFrame) -> DataFrame:
    """``(case_id, path, violation)``: protected paths that were not shipped, are gone, or hold other text."""
    key = lambda df, extra: df.select("case_id", safe_relative_path(F.col("path")).alias("path"), *extra)
    rows = key(protected, []).distinct().join(key(shipped, [F.col("content").alias("want"), F.lit(True).alias("s")]), ["case_id", "path"], "left").join(key(found, [F.col("content").alias("have"), F.lit(True).alias("f")]), ["case_id", "path"], "left")
    why = F.when(F.col("s").isNull(), "protected_path_not_in_context").when(F.col("f").isNull(), "protected_path_deleted").when(~F.col("want").eqNullSafe(F.col("have")), "protected_path_modified")
    return rows.select("case_id", "path", why.alias("violation")).where("violation is not null")


def interference(found: DataFrame, shipped: DataFrame, gold: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(case_id, path, violation)`` of submissions that change how tests run: control files that are new or changed, skip marks in new Python files.

    ``baseline(case_id, path, sha256)`` is the workspace before the run; what it holds unchanged is exempt, as are control files that
    the solution has to edit.
    """
    keys = ["case_id", "path"]
    rows = found.select(*keys, "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("now"))
    rows = rows.join(baseline.select(*keys, F.col("sha256").alias("was")), keys, "left").where("not (now <=> was)")
    rows = rows.join(shipped.select(*keys, F.col("content").alias("want"), F.lit(True).alias("s")), keys, "left").join(gold.select(*keys, F.lit(True).alias("g")).distinct(), keys, "left")
    control = is_collection_control(base_name(F.col("path")))
    why = (
        F.when(control & F.col("s").isNull(), "grading_interference_file").when(control & F.col("g").isNull() & ~F.col("want").eqNullSafe(F.col("content")), "grading_interference_file_modified")
        .when(~control & F.col("s").isNull() & F.col("path").endswith(".py") & F.col("content").rlike(_SKIPS), "grading_interference_skip_marker")
    )
    return rows.select(*keys, why.alias("violation")).where("violation is not null")


@F.pandas_udf(T.DoubleType())
def change_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    """Share of the lines of the second text that a line diff does not find in the first; 0 for an empty one."""
    out = []
    for a, b in zip(before, after):
        x, y = (a or "").splitlines(), (b or "").splitlines()
        same = sum(n for *_, n in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) if x and y else 0
        out.append(1 - same / len(y) if y else 0.0)
    return pd.Series(out)


def solution_issues(pairs: DataFrame) -> DataFrame:
    """``(case_id, path, code, severity)`` of gold files that equal the file they replace, or rewrite most of it; ``pairs(case_id, path, stub, gold)``."""
    rows = pairs.where("stub is not null").withColumn("r", change_ratio("stub", "gold"))
    code = F.when(F.col("r") == 0, "solution_file_unchanged").when(F.col("r") > REWRITE, "solution_rewrites_file")
    return rows.select("case_id", "path", code.alias("code"), F.when(F.col("r") == 0, "error").otherwise("warn").alias("severity")).where("code is not null")


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    """The unified diff of two texts with three lines of context; '' if they are equal."""
    one = lambda a, b, p: "".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), f"a/{p}", f"b/{p}", n=3))
    return pd.Series([one(a, b, p) for a, b, p in zip(before, after, path)], dtype=object)


def changed_lines(diff: Column) -> Column:
    """Added and removed lines of a unified diff, its two headings apart."""
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")))


def issue_overlap(issue: Column, diff: Column) -> Column:
    """Share of an issue's identifiers (three characters or more, in any case) that the added lines of a diff contain; 0 without any."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(issue, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)), F.lower))
    added = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    body = F.lower(F.array_join(F.transform(added, lambda x: F.substring(x, 2, 1 << 30)), " "))
    return F.coalesce(F.try_divide(F.size(F.filter(names, lambda n: F.contains(body, n))), F.size(names)), F.lit(0.0))


def escapes(calls: DataFrame, workspace: str) -> DataFrame:
    """Tool calls ``(run, call, tool, arguments)`` that name paths outside the workspace, with ``outside``, those paths."""

    @F.pandas_udf("array<string>")
    def outside(tools: pd.Series, arguments: pd.Series) -> pd.Series:
        def one(tool, text):
            try:
                args = json.loads(text or "{}")
            except ValueError:
                return []
            return outside_paths(tool, args, workspace) if isinstance(args, dict) else []

        return pd.Series([one(t, a) for t, a in zip(tools, arguments)], dtype=object)

    return calls.withColumn("outside", outside("tool", "arguments")).where("size(outside) > 0")


def format_interval(successes: Column, n: Column) -> Column:
    """``[lo%, hi%]`` of the Wilson interval to one decimal, null where nothing was measured."""
    low, high = wilson(successes, n)
    return F.when(n > 0, F.format_string("[%.1f%%, %.1f%%]", low * 100, high * 100))


def comparable_pairs(pairs: DataFrame, runs: DataFrame, baseline: str) -> DataFrame:
    """Pairwise rows with ``comparable`` (both runs select by oracle, or neither) and ``self_repeat`` (no axis differs); ``runs(run_id, oracle, differs)``."""
    base = runs.where(F.col("run_id") == baseline).select(F.coalesce("oracle", F.lit(False)).alias("o")).limit(1)
    rows = pairs.join(runs.select(F.col("run_id").alias("candidate"), "oracle", "differs"), "candidate", "left").join(F.broadcast(base), how="left")  # one row
    return rows.withColumn("comparable", F.coalesce("oracle", F.lit(False)) == F.coalesce("o", F.lit(False))).withColumn("self_repeat", F.coalesce(F.size("differs") == 0, F.lit(False))).drop("oracle", "differs", "o")


def human_edits(pairs: DataFrame) -> DataFrame:
    """Vouched edits of Python files that are no tests, the first by file and position for each distinct pair of texts, with the file's name."""
    rows = pairs.where("pre is not null and post is not null and pre <> post and pre_origin = 'read_complete'").where(F.col("path").endswith(".py") & ~is_test_path(F.col("path")))
    key = F.sha1(F.concat(F.col("pre"), F.lit("\0"), F.col("post")))
    best = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct("fv_id", "path", "pre", "post"), "fv_id").alias("r")).select("key", "r.*")
    return best.withColumn("name", base_name(F.col("path")))
