"""From recorded sessions to drafts of cases: prompts, files, gold, filters, first-wins by fingerprint."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import records, traces
from millrace.operators.helpers import is_safe_grader
from millrace.operators.outcomes import first_wins
from millrace.operators.redaction import mask_source, redact_secrets
from millrace.operators.text import guess_task_type, task_fingerprint

# Patterns that drop a prompt, in order, and that speak for it; names of files and of fences by language; words of code lines.
DROP_RULES = [
    ("ops_disk_health", r"(?i)(巡检|磁盘健康|硬盘运行|disk health|smartctl)"),
    ("heartbeat", r"(?i)HEARTBEAT_OK|HEARTBEAT\.md"),
    ("judge_meta", r"(?i)(任务完成度评测|rubric-judge|<<RUBRIC>>|is_correct)"),
    ("pure_chat", r"(?i)^(今天天气|你好|在吗)[\s\S]{0,40}$"),
    ("system_only_noise", r"(?i)WITTY_INTERNAL_INITIATOR|openclaw-tui.*HEARTBEAT"),
    ("explain_only", r"(?i)(设计方案|总结一下|详细说明|是怎么定义的|默认值从何而来|虚拟大小是怎么|Automatically detect the language|superpowers|EXTREMELY_IMPORTANT)"),
    ("log_dump", r"(?i)匹配\d+次|\.log\s*（匹配"),
]
KEEP_RULES = [
    ("coding_intent", r"(?i)(实现|修复|重构|bug|fix|implement|refactor|编写|函数|接口|api|pytest|单元测试|切换到|报错|compile|class |def |import )"),
    ("code_fence", r"```[\w]*\n"),
]
_FILTER_TOOLS = ["bash", "read", "write", "edit", "grep", "glob"]
GOLD_NAMES = {"python": "solution.py", "typescript": "solution.ts", "javascript": "solution.js", "java": "Solution.java", "cangjie": "solution.cj"}
FENCES = {"python": ["python", "py", ""], "typescript": ["typescript", "ts"], "javascript": ["javascript", "js"], "java": ["java"], "cangjie": ["cangjie", "cj"]}
_GOLD_WORDS = r"def |class |function |import |return |const |let "
_KEY_WORDS = r"def |class |function |return |import |public |fn "
_META_REPLY = r"(?i)^\s*(the user wants|here is|here's|sure|okay|i need to|let me|rewritten)"
_NO_FILES = "# TODO: incomplete workspace"


def rule_filter(prompt: Column, has_context: Column, has_gold: Column, product: Column, tools: Column) -> Column:
    """``(keep, reason, score, labels)`` of a prompt: too short, first drop rule, else a score of what speaks for it."""
    text = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"^\s+|\s+$", "")
    on = lambda c: F.coalesce(c, F.lit(False))
    dropped = F.coalesce(*[F.when(text.rlike(p), name) for name, p in DROP_RULES])
    agent, tool = on(product.rlike(records.CODING_AGENTS)), on(F.arrays_overlap(tools, F.array(*map(F.lit, _FILTER_TOOLS))))
    gains = [*[(name, text.rlike(p), 1.0) for name, p in KEEP_RULES], ("coding_agent", agent, 1.5), ("coding_tools", tool, 1.0), ("has_context", on(has_context), 1.0), ("has_gold", on(has_gold), 0.5)]
    score = sum((F.when(test, w).otherwise(0.0) for _, test, w in gains), F.lit(0.0))
    labels = F.array_compact(F.array(*[F.when(test, name) for name, test, _ in gains]))
    out = lambda keep, reason, points, names: F.struct(F.lit(keep).alias("keep"), reason.alias("reason"), points.alias("score"), names.alias("labels"))
    none = F.lit(0.0)
    return (
        F.when(F.length(text) < 8, out(False, F.lit("prompt_too_short"), none, F.array(F.lit("too_short"))))
        .when(dropped.isNotNull(), out(False, F.concat(F.lit("drop_rule:"), dropped), none, F.array(dropped)))
        .when(score < 1.0, out(False, F.lit("low_coding_signal"), score, F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("no_signal")))))
        .when(~on(has_context) & (score < 2.5), out(False, F.lit("no_workspace_context"), score, F.concat(labels, F.array(F.lit("no_context")))))
        .otherwise(out(True, F.lit("ok"), score, labels))
    )


def filter_drafts(drafts: DataFrame) -> DataFrame:
    """``case_id`` and the filter's decision over drafts ``(case_id, prompt, files, has_gold, product, tools)``; placeholder files are no context."""
    real = F.exists("files", lambda f: ~F.coalesce(f["content"], F.lit("")).startswith(_NO_FILES))
    return drafts.select("case_id", rule_filter(F.col("prompt"), real, F.col("has_gold"), F.col("product"), F.col("tools")).alias("d")).select("case_id", "d.*")


def fenced(text: Column) -> Column:
    """``[(lang, content)]`` of fenced blocks with 20 characters or more, in order; tags in lower case."""
    t = F.coalesce(text, F.lit(""))
    pattern = r"(?s)```([\w.+-]*)\n(.*?)```"
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("lang"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("content"))
    long = F.filter(both, lambda b: F.length(F.regexp_replace(b["content"], r"^\s+|\s+$", "")) >= 20)
    return F.transform(long, lambda b: F.struct(F.lower(b["lang"]).alias("lang"), b["content"].alias("content")))


def gold_block(texts: Column, language: str) -> Column:
    """``(path, content)`` of the last block of an assistant's texts whose tag is of the language, else of the last block; null without any."""
    blocks = F.flatten(F.transform(texts, fenced))
    tags = FENCES.get(language, [language, ""])
    mine = F.filter(blocks, lambda b: b["lang"].isin(tags))
    chosen = F.coalesce(F.try_element_at(mine, F.lit(-1)), F.try_element_at(blocks, F.lit(-1)))
    return F.when(chosen.isNotNull(), F.struct(F.lit(GOLD_NAMES.get(language, "solution.txt")).alias("path"), F.concat(F.regexp_replace(chosen["content"], r"\s+$", ""), F.lit("\n")).alias("content")))


def _stripped_lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def gold_key_lines(content: Column, most: int = 5) -> Column:
    """Up to five stripped lines of code, 120 characters each, comments apart; else the first three lines that are not blank."""
    lines = _stripped_lines(content)
    code = F.filter(lines, lambda x: ~x.rlike("^(#|//)") & x.rlike(_GOLD_WORDS))
    return F.transform(F.when(F.size(code) > 0, F.slice(code, 1, most)).otherwise(F.slice(lines, 1, 3)), lambda x: F.substring(x, 1, 120))


def default_key_lines(content: Column, most: int = 3) -> Column:
    """Up to three stripped lines of code, 100 characters each, without drawn trees, absolute paths and lone signs."""
    useful = F.filter(_stripped_lines(content), lambda x: (F.length(x) >= 4) & ~x.rlike(r"^(├|│|└|┌|─|/Users/|C:\\|open )") & ~x.contains("python-algorithms/") & x.rlike(_KEY_WORDS))
    return F.transform(F.slice(useful, 1, most), lambda x: F.substring(x, 1, 100))


def accept_rewrite(original: Column, rewritten: Column, discloses: Column, forbidden: Column) -> Column:
    """The rewritten prompt if it is one: not empty, no talk about the task, at most twice as long (400 at least), without
    disclosure (a boolean) and without any of the forbidden names; else the original."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(rewritten, F.lit("")), r"^\s+|\s+$", ""), r"^```\w*\s*|\s*```$", "")
    named = F.exists(forbidden, lambda n: F.array_contains(F.split(text, r"\W+"), n))
    bad = (text == "") | text.rlike(_META_REPLY) | (F.length(text) > F.greatest(F.lit(400), 2 * F.length(original))) | F.coalesce(discloses, F.lit(False)) | F.coalesce(named, F.lit(False))
    return F.when(bad, original).otherwise(text)


_FILE = "array<struct<path:string,content:string>>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])))
def masked_files(files: pd.Series) -> pd.Series:
    """Files with their secrets masked, each still parsing if it did."""
    return files.map(lambda fs: None if fs is None else [{"path": f["path"], "content": mask_source(f["content"] or "", f["path"])} for f in fs])


def session_drafts(sessions: DataFrame, *, task_type: str = "feature", language: str = "python", max_cases: int | None = None) -> DataFrame:
    """Drafts of coding sessions: ``(case_id, session_id, prompt, files, gold_files, mode, fingerprint, task_type, language)``.

    The prompt is the last user turn with its secrets masked; files are artifacts of type file or context_file, gold the
    accepted ones. The first session, by id, stands for all of one fingerprint. ``max_cases`` keeps the first so many.
    """
    turns = records.user_texts(F.col("messages"))
    rows = sessions.where(F.col("session_id").isNotNull()).select("session_id", turns.alias("turns"), "messages", "artifacts").where(F.size("turns") > 0).where(records.is_coding_session(F.col("messages")))
    last = F.regexp_replace(F.element_at("turns", -1), r"^\s+|\s+$", "")
    art = lambda kinds, taken=False: F.transform(F.filter(F.coalesce("artifacts", F.array().cast("array<struct<type:string,path:string,content:string,accepted:boolean>>")), lambda a: a["type"].isin(kinds) & (a["path"] != "") & a["content"].isNotNull() & (a["accepted"] if taken else F.lit(True))), lambda a: F.struct(a["path"].alias("path"), a["content"].alias("content")))
    rows = rows.select("session_id", redact_secrets(last).alias("prompt"), masked_files(art(["file", "context_file"])).alias("files"), masked_files(art(["accepted_file", "gold_file"], True)).alias("gold_files"))
    rows = rows.withColumn("files", F.when(F.size("files") > 0, F.col("files")).otherwise(F.array(F.struct(F.lit("main.py").alias("path"), F.lit("# TODO: restore workspace snapshot\n").alias("content")))))
    mark = task_fingerprint(F.col("prompt"), F.transform("files", lambda f: f["path"]))
    rows = rows.withColumn("fingerprint", mark)
    out = first_wins(rows, ["fingerprint"], ["session_id"])
    out = out.select(F.concat(F.lit("sess-"), F.substring("session_id", 1, 12), F.lit("-"), "fingerprint").alias("case_id"), "session_id", "prompt", "files", "gold_files", F.when(F.size("gold_files") > 0, "gold").otherwise("script").alias("mode"), "fingerprint", F.lit(task_type).alias("task_type"), F.lit(language).alias("language"))
    return out if max_cases is None else out.orderBy("session_id").limit(max_cases)


def record_drafts(chats: DataFrame, messages: DataFrame, *, max_cases: int | None = None) -> DataFrame:
    """Drafts of chat records: coding records with a prompt of 8 characters, with their files, signals and tier.

    ``(request_id, start_time, prompt, task_type, language, files, signals…, tier, fingerprint)``. Messages come from the record's
    history; files, calls and signals from the rows of ``messages``. The newest record, ties by id, stands for a fingerprint.
    """
    one = first_wins(chats.select("request_id", "start_time", "requests_tags", "tools", "full_history"), ["request_id"], ["start_time", "full_history"])
    said = records.normalized_messages(one).where("role in ('user', 'human')").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]).alias("texts"))
    rows = one.select("request_id", "start_time", "requests_tags", "tools").join(said, "request_id")
    rows = rows.withColumn("prompt", records.primary_prompt(F.col("texts")))
    rows = rows.where(records.is_coding_record(records.user_agent(F.col("requests_tags")), records.tool_names(F.col("tools")), F.array_join("texts", "\n"))).where(F.length("prompt") >= 8)
    rows = rows.withColumn("prompt", redact_secrets("prompt"))
    files = traces.extracted_files(messages).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("files"))
    signals = traces.suggest_tier(traces.trace_signals(messages))
    rows = rows.join(files, "request_id", "left").join(signals, "request_id", "left").withColumn("files", F.coalesce("files", F.array().cast(_FILE)))
    paths = F.transform("files", lambda f: f["path"])
    fences = F.transform(F.flatten(F.transform("texts", fenced)), lambda b: b["lang"])
    rows = rows.withColumn("fingerprint", task_fingerprint(F.col("prompt"), paths)).withColumn("task_type", guess_task_type(F.col("prompt"))).withColumn("language", records.guess_language(F.col("prompt"), paths, fences))
    rows = rows.drop("requests_tags", "tools", "texts").withColumn("_age", -F.unix_micros("start_time"))
    out = first_wins(rows, ["fingerprint"], ["_age", "request_id"]).drop("_age")
    return out if max_cases is None else out.orderBy(F.desc("start_time"), "request_id").limit(max_cases)


def compact_sessions(messages: DataFrame, text_chars: int = 4000, tool_chars: int = 800) -> DataFrame:
    """``(request_id, messages)`` of requests as sessions: without system turns; tool turns, cut short, only if they list no file."""
    rows = messages.dropDuplicates(["msg_id"]).withColumn("role", F.lower(F.trim("role"))).where("role <> 'system'")
    listed = F.coalesce(F.col("content").contains("</content>"), F.lit(False))
    any_file = rows.groupBy("request_id").agg(F.bool_or(listed).alias("has_files"))
    kept = rows.join(any_file, "request_id").where("role <> 'tool' or not has_files")
    text = F.when(F.col("role") == "tool", F.substring("content", 1, tool_chars)).otherwise(F.substring("content", 1, text_chars))
    turn = F.struct(F.coalesce("pos", F.lit(1 << 30)).alias("pos"), "msg_id", "role", F.coalesce(text, F.lit("")).alias("content"))
    return kept.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def usable_pairs(pairs: DataFrame, require_read: bool = True) -> DataFrame:
    """Edit pairs a case can be built on: both sides there and different, no test file, first text vouched for (read in full, unless
    not required); with ``gap``, the difference of their lengths, by which callers sort."""
    vouched = F.col("pre_origin") == "read_complete" if require_read else ~F.coalesce(F.col("pre_origin") == "ambiguous_path", F.lit(False))
    rows = pairs.where("pre is not null and post is not null and pre <> post").where(vouched).where(~records.is_test_path(F.col("path")))
    return rows.where(~same_code("pre", "post", "path")).withColumn("gap", F.abs(F.length("post") - F.length("pre")))


def _bare(text: str, path: str) -> object | None:
    """What of a source text runs: Python's tree without docstrings, JavaScript without comments and blanks; null if unknown."""
    import ast
    import warnings

    suffix = (path or "").lower().rsplit(".", 1)[-1]
    if suffix in ("py", "pyi"):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        for node in ast.walk(tree):
            body = getattr(node, "body", None)
            if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
                node.body = body[1:] or [ast.Pass()]
        return ast.dump(tree)
    if suffix in ("js", "mjs", "cjs", "ts", "jsx", "tsx"):
        keep = re.sub(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", lambda m: m[1] or " ", text, flags=re.S)
        return re.sub(r"\s+", " ", keep).strip()
    return None


@F.pandas_udf(T.BooleanType())
def same_code(before: pd.Series, after: pd.Series, paths: pd.Series) -> pd.Series:
    """Whether two texts differ only in comments, docstrings and layout; false where that cannot be told."""
    out = []
    for a, b, p in zip(before, after, paths):
        x = None if a is None or b is None else _bare(a, p)
        out.append(x is not None and x == _bare(b, p))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def imported_modules(contents: pd.Series, paths: pd.Series) -> pd.Series:
    """Sorted top-level packages that a Python file imports absolutely, or packages that a JavaScript file names; null of other files."""
    def one(text, path):
        suffix = (path or "").lower().rsplit(".", 1)[-1]
        if text is None or suffix not in ("py", "pyi", "js", "mjs", "cjs", "ts"):
            return None
        if suffix in ("py", "pyi"):
            names = [n.strip().split(" ")[0].split(".")[0] for line in re.findall(r"(?m)^[ \t]*import[ \t]+([\w., \t]+)", text) for n in line.split(",")]
            names += re.findall(r"(?m)^[ \t]*from[ \t]+(\w+)[\w.]*[ \t]+import\b", text)
        else:
            found = re.findall(r"""(?:\bfrom\s*|\brequire\(\s*|\bimport\s*\(?\s*)["']([^"'.][^"']*)["']""", text)
            names = ["/".join(n.split("/")[: 2 if n[0] == "@" else 1]) for n in found]
        return sorted({n for n in names if n})

    return pd.Series([one(t, p) for t, p in zip(contents, paths)], dtype=object)


def unsatisfied_imports(files: DataFrame, declared: list[str]) -> DataFrame:
    """Files with ``missing``: packages they import that are neither built in nor declared nor a module beside them; only rows that miss some."""
    import sys

    known = sorted({*declared, *sys.stdlib_module_names, *(f"node:{m}" for m in _NODE), *_NODE})
    rows = files.withColumn("_i", imported_modules("content", "path"))
    return rows.withColumn("missing", F.array_except("_i", F.array(*map(F.lit, known)))).drop("_i").where("size(missing) > 0")


# Modules built into Node.
_NODE = "assert async_hooks buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https module net os path perf_hooks process punycode querystring readline repl stream string_decoder test timers tls tty url util v8 vm worker_threads zlib".split()


def heuristic_cases(drafts: DataFrame) -> DataFrame:
    """``(case_id, mode, key_lines, weak_grader, command_ok)`` of drafts ``(case_id, files, gold_files, command)`` made runnable without a model.

    With gold the key lines are those of its first file that the context does not hold; without any the grader is weak.
    """
    blob = F.array_join(F.transform("files", lambda f: F.coalesce(f["content"], F.lit(""))), "\n")
    first = F.try_element_at("gold_files", F.lit(1))["content"]
    rows = drafts.withColumn("_b", F.coalesce(blob, F.lit("")))
    fresh = F.filter(default_key_lines(first), lambda k: ~F.col("_b").contains(k))
    rows = rows.withColumn("key_lines", F.coalesce(fresh, F.array().cast("array<string>")))
    return rows.select("case_id", F.when(F.size("gold_files") > 0, "gold").otherwise("script").alias("mode"), "key_lines", ((F.size("gold_files") > 0) & (F.size("key_lines") == 0)).alias("weak_grader"), is_safe_grader(F.col("command")).alias("command_ok"))

