"""Row-wise helpers: safe paths and commands, roles, replies of models, test runners' output, comparisons of text."""

from __future__ import annotations

import posixpath
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.records import SUFFIXES, is_test_path

# Shell syntax that a command may not hold, programs a sandbox runs, commands a grader may run, files that
# decide which tests run, roles and their other names, error texts by whether a retry can help.
SHELL_SYNTAX = [";", "&", "|", ">", "<", "`", "$", "(", ")", "*", "?", "~", "\n", "\r"]
SHELL_ESCAPES = [";", "&&", "||", "|", ">", "<", "`", "$(", "${", "&", "\n"]
PROGRAMS = ["python", "python3", "pytest", "node", "ls", "cat", "head", "tail", "wc", "grep", "find", "pwd", "echo", "true"]
_GRADERS = r"(?i)^(python(\d+(\.\d+)?)?\s+-m\s+pytest\b|python(\d+(\.\d+)?)?\s+\S+\.py\b|node\s+--test(\s+\S+)?\s*$|true\b)"
CONTROL_FILES = ["conftest.py", "pytest.ini", ".pytest.ini", "pytest.toml", ".pytest.toml", "setup.cfg", "tox.ini", "pyproject.toml", "sitecustomize.py", "usercustomize.py"]
ROLES = {"impl": "impl", "test": "test", "distractor": "distractor", "spec": "spec", "stub": "impl", "source": "impl", "implementation": "impl", "code": "impl", "module": "impl", "solution": "impl", "tests": "test", "unittest": "test", "pytest": "test", "noise": "distractor", "irrelevant": "distractor", "decoy": "distractor", "doc": "spec", "docs": "spec", "readme": "spec", "specification": "spec"}
_SPEC = r"(?i)\.(md|rst|txt)$"
_NO_RETRY = ["budget has been exceeded", "budget_exceeded", "insufficient_quota", "exceeded your current quota", "invalid_api_key", "authentication"]
_RETRY = r"(?i)timeout|timed out|connection|temporarily|rate limit|429|500|502|503|504|overloaded"
_ANSI = r"\x1B\[[0-9;]*[A-Za-z]"


def safe_relative_path(path: Column) -> Column:
    """A path within its workspace, slashes forward and without a root; `unnamed` if nothing is left, null if it leads out."""
    rel = F.regexp_replace(F.translate(path, "\\", "/"), r"^/+", "")
    parts = F.filter(F.split(rel, "/+"), lambda p: (p != "") & (p != "."))
    return F.when(path.isNull() | F.array_contains(parts, ".."), None).when(F.size(parts) == 0, "unnamed").otherwise(F.array_join(parts, "/"))


def command_words(command: str | None) -> list[str] | None:
    """Words of a command that needs no shell; null if it is empty, holds shell syntax or open quotes."""
    if command is None or any(c in command for c in SHELL_SYNTAX):
        return None
    try:
        return shlex.split(command) or None
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def safe_command(commands: pd.Series) -> pd.Series:
    return commands.map(command_words)


def _holds(c: Column, marks: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(c.contains(m), F.lit(m)) for m in marks]))


def command_refusal(command: Column, programs: list[str] = PROGRAMS) -> Column:
    """Why a sandbox refuses a command: `empty`, `shell syntax` or `program`; null if it runs."""
    c = F.trim(F.coalesce(command, F.lit("")))
    program = F.element_at(F.split(F.element_at(F.split(c, r"\s+"), 1), "/"), -1)
    return F.when(c == "", "empty").when(F.size(_holds(c, SHELL_ESCAPES)) > 0, "shell syntax").when(~program.isin(programs), "program")


def is_safe_grader(command: Column) -> Column:
    """Whether a grader's command names a known test runner and nothing else; none at all is safe."""
    c = F.trim(F.coalesce(command, F.lit("")))
    return (F.coalesce(command, F.lit("")) == "") | ((F.length(c) <= 200) & (F.size(_holds(c, ["&&", ";", "|", "`"])) == 0) & c.rlike(_GRADERS))


def is_collection_control(name: Column) -> Column:
    """Whether a test runner reads the file of this name, in any case, to decide what it collects."""
    return F.lower(name).isin(CONTROL_FILES)


def infer_role(path: Column) -> Column:
    """test, spec or impl by the path."""
    return F.when(is_test_path(path), "test").when(path.rlike(_SPEC), "spec").otherwise("impl")


def normalize_role(role: Column, path: Column) -> Column:
    """The role declared, under any of its names; else the one the path tells."""
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(names[F.lower(F.trim(F.coalesce(role, F.lit(""))))], infer_role(path))


def is_retryable(error: Column) -> Column:
    """Whether an error may pass on its own; exhausted budgets and refused keys do not, whatever their status code."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return (F.size(_holds(e, _NO_RETRY)) == 0) & e.rlike(_RETRY)


def outside_paths(tool: str | None, arguments: dict, workspace: str) -> list[str]:
    """What a tool call names that lies outside the workspace, by the text of its paths."""
    texts = [arguments.get("command")] if tool == "bash" else [arguments.get(k) for k in ("filePath", "path", "pattern", "include", "glob")]
    out = []
    for word in (w.strip(",;:()") for t in texts if t for w in re.split(r"[\s'\"=]+", str(t))):
        if not word or word.startswith("-") or "/" not in word and not word.startswith((".", "~")):
            continue
        full = "/~" + word[1:] if word.startswith("~") else posixpath.normpath(posixpath.join(workspace, word))
        if full != workspace and not full.startswith(workspace.rstrip("/") + "/"):
            out.append(word)
    return out


def normalize_text(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, none at the end of the text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\s+$", "")


def soft_equal(a: Column, b: Column) -> Column:
    """Equality apart from white space and comments that begin a line."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^\s*(#|//).*$", ""), r"\s+", "")
    return bare(a) == bare(b)


def longest_block(reply: Column) -> Column:
    """The longest fenced block of a reply, the first of equals, without line ends around; the whole stripped reply without any."""
    t = F.coalesce(reply, F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```[\w.+-]*\n(.*?)```"), F.lit(1))
    best = F.aggregate(blocks, F.lit(""), lambda acc, b: F.when(F.length(b) > F.length(acc), b).otherwise(acc))
    return F.when(F.size(blocks) > 0, F.regexp_replace(best, r"^\n+|\n+$", "")).otherwise(F.regexp_replace(t, r"^\s+|\s+$", ""))


def tolerant_json(reply: Column) -> Column:
    """The JSON in a reply as VARIANT: within a fence, or from its first brace to its last; null if there is none."""
    t = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")
    inner = F.when(t.rlike(r"(?s)^```(?:json)?\s*.*\s*```$"), F.regexp_replace(t, r"(?s)^```(?:json)?\s*|\s*```$", "")).otherwise(t)
    braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(inner), F.try_parse_json(F.nullif(braces, F.lit(""))))


def reply_files(reply: Column) -> Column:
    """``[(path, content)]`` of a reply that is an object with a list `files`; null if it is not, or if an entry lacks either."""
    text = F.to_json(tolerant_json(reply))
    files = F.from_json(text, "files array<struct<path:string,content:string>>")["files"]
    return F.when(~F.exists(files, lambda f: f["path"].isNull() | f["content"].isNull()), files)


def test_counts(output: Column) -> Column:
    """``(passed, failed, error)``: the largest count of each that a runner's output names, colours taken out."""
    plain = F.regexp_replace(F.coalesce(output, F.lit("")), _ANSI, "")
    most = lambda *rules: F.coalesce(F.array_max(F.transform(F.concat(*[F.regexp_extract_all(plain, F.lit(r), F.lit(1)) for r in rules]), lambda x: x.cast("int"))), F.lit(0))
    n = r"(\d{1,9})"
    return F.struct(most(rf"{n} passed", rf"(?m)^\W*pass {n}").alias("passed"), most(rf"{n} failed", rf"(?m)^\W*fail {n}").alias("failed"), most(rf"{n} errors?\b").alias("error"))


def pass_ratio(output: Column) -> Column:
    """Share of the tests run that passed; null if none ran."""
    c = test_counts(output)
    return F.try_divide(c["passed"], c["passed"] + c["failed"] + c["error"])


def is_uncollectable(exit_code: Column, output: Column) -> Column:
    """Whether a failed suite did not run: its runner says so by its code, or no test passed or failed."""
    c = test_counts(output)
    return exit_code.isin(2, 3, 4, 5) | ((c["passed"] + c["failed"]) == 0)


def count_tests(content: Column) -> Column:
    """Tests that a file declares, in Python's way or JavaScript's, whichever are more."""
    t = F.coalesce(content, F.lit(""))
    return F.greatest(F.regexp_count(t, F.lit(r"(?m)^\s*(?:async\s+)?def\s+test\w*\s*\(")), F.regexp_count(t, F.lit(r"(?m)^\s*(?:test|it)\s*\(")))


def languages(spark: SparkSession) -> DataFrame:
    """``(language, suffixes)`` that the engine tells apart."""
    by: dict[str, list[str]] = {}
    for suffix, name in SUFFIXES.items():
        by.setdefault(name, []).append("." + suffix)
    return spark.createDataFrame(sorted(by.items()), "language string, suffixes array<string>")


def relative_to(path: Column, root: str) -> Column:
    """A path below a root without it; others as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
