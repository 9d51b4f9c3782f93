"""Signals of recorded traces: messages, tool calls, repair rounds, and replay of edits."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

# Tool names by what they do, argument names, and patterns of test commands and of errors.
TOOL_KINDS = {
    "read": ["read", "view", "cat", "open", "file_read", "list", "ls", "glob", "readfile"],
    "search": ["grep", "search", "ripgrep", "rg", "find", "ast_grep_search", "codebase_search"],
    "edit": ["write", "edit", "multiedit", "file_write", "patch", "apply_patch", "str_replace", "str_replace_editor", "ast_grep_replace"],
    "exec": ["bash", "exec", "shell", "run", "run_command", "interactive_bash", "terminal"],
}
_PATH_KEYS = ("path", "file_path", "filePath", "filename", "file", "target_file", "notebook_path")
_COMMAND_KEYS = ("command", "cmd", "script", "input")
TEST_COMMAND = r"(?i)\b(?:pytest|py\.test|unittest|nose2|tox|jest|vitest|mocha|(?:npm|yarn|pnpm)\s+(?:run\s+)?test|go\s+test|cargo\s+test|mvn\s+test|gradle\s+test|make\s+(?:test|check))\b"
ERROR_SIGNAL = r"Traceback \(most recent call last\)|AssertionError|\bFAILED\b|\bERROR\b|SyntaxError|ImportError|ModuleNotFoundError|TypeError|\bexit(?:\s+code)?[=:\s]+[1-9]"
WRITE_TOOLS, EDIT_TOOLS = ("write", "file_write", "create"), ("edit", "multiedit", "patch", "str_replace", "str_replace_editor")


def tool_kind(name: Column) -> Column:
    """read, search, edit, exec or other."""
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(low.isin(*names), kind) for kind, names in TOOL_KINDS.items()], F.lit("other"))


def _first_argument(args: Column, keys: tuple[str, ...]) -> Column:
    """The first of the named arguments that is a non-blank text."""
    value = lambda k: F.get_json_object(args, f"$.{k}")
    return F.coalesce(*[F.when(F.trim(value(k)) != "", value(k)) for k in keys])


def tool_calls(messages: DataFrame) -> DataFrame:
    """``(request_id, msg_id, pos, call, name, kind, path, command)``, one row per named tool call; messages without calls give none."""
    calls = messages.select("request_id", "msg_id", F.coalesce("pos", F.lit(1 << 30)).alias("pos"), F.posexplode("tool_calls").alias("call", "c")).where("c.function.name <> ''")
    args, name = F.col("c.function.arguments"), F.col("c.function.name")
    return calls.select("request_id", "msg_id", "pos", "call", name.alias("name"), tool_kind(name).alias("kind"), _first_argument(args, _PATH_KEYS).alias("path"), _first_argument(args, _COMMAND_KEYS).alias("command"))


def trace_signals(messages: DataFrame) -> DataFrame:
    """Counters per request of what a session did: turns, tool calls by kind, test runs, files read and touched, repair rounds,
    tool messages with an error, and the sorted names of its tools. Repeated rows count once; roles are read in any case.
    """
    rows = messages.dropDuplicates(["msg_id"])
    role, content = F.lower(F.trim("role")), F.coalesce("content", F.lit(""))
    base = rows.groupBy("request_id").agg(
        F.count_if(role.isin("user", "human")).alias("user_turns"), F.count_if(role == "assistant").alias("assistant_turns"), F.count_if((role == "tool") & content.rlike(ERROR_SIGNAL)).alias("error_signals"),
    )
    calls = materialize(tool_calls(rows), "calls")
    test = (F.col("kind") == "exec") & F.coalesce(F.col("command").rlike(TEST_COMMAND), F.lit(False))
    counts = calls.groupBy("request_id").agg(
        F.count("*").alias("tool_calls"), *[F.count_if(F.col("kind") == k).alias(f"{k}_ops") for k in TOOL_KINDS], F.count_if(test).alias("test_runs"),
        F.count_distinct(F.when(F.col("kind") == "edit", F.col("path"))).alias("files_touched"), F.array_sort(F.collect_set(F.lower("name"))).alias("distinct_tools"),
    )
    shown = rows.where((role == "tool") & F.col("content").contains("<")).select("request_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<path>([^<]+)</path>"), F.lit(1))).alias("path"))
    read = calls.where("kind = 'read' and path is not null").select("request_id", "path").unionByName(shown.select("request_id", F.trim("path").alias("path")))
    files = read.groupBy("request_id").agg(F.count_distinct("path").alias("files_read"))
    events = calls.select("request_id", "pos", "msg_id", "call", F.when(F.col("kind") == "edit", "edit").when(test, "test").alias("kind")).where("kind is not null")
    rounds = repair_rounds(events, "request_id", ["pos", "msg_id", "call"]).withColumnRenamed("rounds", "repair_rounds")
    names = ["tool_calls", *[f"{k}_ops" for k in TOOL_KINDS], "test_runs", "files_touched", "files_read", "repair_rounds"]
    out = base.join(counts, "request_id", "left").join(files, "request_id", "left").join(rounds, "request_id", "left").na.fill(0, names)
    return out.withColumn("distinct_tools", F.coalesce("distinct_tools", F.array().cast("array<string>")))


def suggest_tier(signals: DataFrame) -> DataFrame:
    """``tier`` and ``reason`` of trace signals: the first rule from the top that the counters fulfil."""
    c = F.col
    rules = [
        ("T5", (c("repair_rounds") >= 2) & (c("files_touched") >= 3), ["repair_rounds", "files_touched"]),
        ("T4", c("files_touched") >= 3, ["files_touched"]),
        ("T4", (c("search_ops") >= 3) & (c("files_read") >= 5), ["search_ops", "files_read"]),
        ("T3", (c("test_runs") >= 1) & (c("error_signals") >= 1), ["test_runs", "error_signals"]),
        ("T3", c("repair_rounds") >= 1, ["repair_rounds"]),
        ("T2", (c("error_signals") >= 1) | (c("files_read") >= 2) | (c("search_ops") >= 1), ["error_signals", "files_read", "search_ops"]),
    ]
    say = lambda names: F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), c(n).cast("string")) for n in names])
    tier = F.coalesce(*[F.when(test, t) for t, test, _ in rules], F.lit("T1"))
    reason = F.coalesce(*[F.when(test, say(names)) for _, test, names in rules], F.lit("no retrieval, iteration or failure evidence in trace"))
    return signals.withColumn("tier", tier).withColumn("reason", reason)


def repair_rounds(events: DataFrame, key: str, order: list[str], kind: str = "kind") -> DataFrame:
    """``(key, rounds)``: tests after the first that have an edit since the test before; kinds are `edit` and `test`."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.where(F.col(kind).isin("edit", "test")).select(key, kind, F.sum((F.col(kind) == "edit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("edits"), *order)
    tests = rows.where(F.col(kind) == "test").withColumn("before", F.lag("edits").over(w))
    hits = tests.groupBy(key).agg(F.count_if(F.col("edits") > F.col("before")).alias("rounds"))
    return events.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("rounds", F.lit(0)).alias("rounds"))


# The markup of file listings in tool messages, their footers and line numbers.
_FILE = re.compile(r"<path>([^<]+)</path>\s*<type>file</type>\s*<content>(.*?)</content>", re.S | re.I)
_WHOLE = re.compile(r"\(End of file - total (\d+) lines\)")
_WINDOW = re.compile(r"\((?:Showing lines [\d-]+ of \d+\..*|File has more lines\b.*|Output capped at .*|Output truncated at .*)\)")
_GUTTER = re.compile(r"\s*(\d+):\s?")
#: Path components that are compared where a path may have been cut, and the characters kept of a listed file.
PATH_TAIL, FILE_CHARS = 3, 200_000


def read_footer(text: str) -> tuple[str, str]:
    """Text of a listing without its footer, and `read_complete`, `read_partial` or `read_unlabelled`.

    The footer is the last non-blank line; one blank line before it belongs to it. A listing is complete if the footer
    counts exactly the lines that are there.
    """
    lines = text.splitlines()
    while lines and not lines[-1].strip():
        lines.pop()
    foot = lines.pop().strip() if lines else ""
    whole = _WHOLE.fullmatch(foot)
    if not whole and not _WINDOW.fullmatch(foot):
        return text, "read_unlabelled"
    if lines and not lines[-1].strip():
        lines.pop()
    state = "read_complete" if whole and int(whole[1]) == len(lines) else "read_partial"
    return "".join(x + "\n" for x in lines), state


def without_gutter(text: str) -> str:
    """Text without line numbers, if every non-blank line has one, two at least, rising by one from 1 or more."""
    lines = text.splitlines()
    heads = [_GUTTER.match(x) for x in lines if x.strip()]
    if len(heads) < 2 or not all(heads):
        return "\n".join(lines)
    first = int(heads[0][1])
    if first < 1 or any(int(h[1]) != first + i for i, h in enumerate(heads)):
        return "\n".join(lines)
    return "\n".join(x[_GUTTER.match(x).end() :] if x.strip() else x for x in lines)


def short_path(path: str) -> str:
    """A Windows path's last component, an absolute path's last three; others as they are, with slashes."""
    parts = path.strip().replace("\\", "/").split("/")
    if re.match(r"[A-Za-z]:", parts[0]):
        return parts[-1]
    return "/".join(parts[-PATH_TAIL:]) if path.strip().startswith(("/", "\\")) else "/".join(parts)


def listed_files(text: str | None) -> list[dict[str, str]]:
    """``path, source_path, content, origin`` of every file that a tool message lists; blank files are left out."""
    out = []
    for path, body in _FILE.findall(text or ""):
        content, origin = read_footer(body.strip("\n"))
        content = without_gutter(content).strip("\n")
        if path.strip() and content.strip():
            out.append({"path": short_path(path), "source_path": path.strip(), "content": content[:FILE_CHARS] + "\n", "origin": origin})
    return out


def read_listing(text: str) -> tuple[str, str]:
    """Text of a read listing without footer and line numbers, and `complete`, `partial` or `unlabelled`."""
    body, state = read_footer(text)
    return without_gutter(body), state.removeprefix("read_")


def extracted_files(messages: DataFrame) -> DataFrame:
    """``(request_id, path, source_path, content, origin)``: of every path the last listing in a request's tool messages."""
    schema = "array<struct<path:string,source_path:string,content:string,origin:string>>"

    @F.pandas_udf(schema)
    def files(texts: pd.Series) -> pd.Series:
        return texts.map(listed_files)

    tool = messages.where("request_id is not null and lower(trim(role)) = 'tool' and content like '%</content>%'").dropDuplicates(["msg_id"])
    rows = tool.select("request_id", F.coalesce("pos", F.lit(1 << 30)).alias("pos"), "msg_id", F.posexplode(files("content")).alias("nth", "f"))
    last = rows.groupBy("request_id", F.col("f.path").alias("path")).agg(F.max_by("f", F.struct("pos", "msg_id", "nth")).alias("f"))
    return last.select("request_id", "path", "f.source_path", "f.content", "f.origin")


def _same_file(a: str, b: str) -> bool:
    """Whether two spellings of a path may name one file: they agree over the shorter, or over the tail where one was cut."""
    x, y = (re.split(r"[\\/]+", p.strip().strip("/\\")) for p in (a, b))
    n = min(len(x), len(y), PATH_TAIL if max(len(x), len(y)) > PATH_TAIL else max(len(x), len(y)))
    return x[-n:] == y[-n:]


class _Trace:
    """Replays one trace: reads set a file's text, writes and edits move it, the first edit opens a pair."""

    def __init__(self):
        self.text: dict[str, str] = {}
        self.first: dict[str, str] = {}
        self.origin: dict[str, str] = {}
        self.written: set[str] = set()
        self.names: dict[str, list[str]] = {}
        self.pairs: dict[str, dict] = {}
        self.count = {"partial_reads": 0, "edits_seen": 0, "edits_applied": 0, "unlocatable": 0}

    def key(self, path: str) -> str:
        k = re.split(r"[\\/]", path.strip())[-1]
        if path not in self.names.setdefault(k, []):
            self.names[k].append(path)
        return k

    def read(self, f: dict[str, str]) -> None:
        if f["origin"] == "read_partial":
            self.count["partial_reads"] += 1
            return
        k = self.key(f["source_path"])
        if k not in self.first:
            self.origin[k] = "tool_write" if k in self.written else f["origin"]
        self.text.setdefault(k, f["content"])
        self.first.setdefault(k, f["content"])

    def write(self, path: str, content: str) -> None:
        k = self.key(path)
        if k not in self.first:
            self.written.add(k)
        self.text[k] = content
        if k in self.pairs and self.pairs[k]["post"] != content:
            self.pairs[k].update(post=content, post_origin="tool_write")

    def edit(self, path: str, old: str, new: str) -> None:
        k = self.key(path)
        self.count["edits_seen"] += 1
        base = self.text.get(k)
        if not old or base is None or old not in base:
            self.count["unlocatable"] += 1
            return
        self.count["edits_applied"] += 1
        self.text[k] = now = base.replace(old, new, 1)
        pair = self.pairs.get(k)
        if pair is None:
            self.pairs[k] = {"path": short_path(path), "pre": self.first.get(k, base), "post": now, "edits": 1, "pre_origin": self.origin.get(k, "tool_write"), "post_origin": "edit"}
        else:
            pair.update(post=now, post_origin="edit", edits=pair["edits"] + 1)

    def result(self) -> list[dict]:
        out = []
        for k, p in self.pairs.items():
            names = self.names[k]
            if any(not _same_file(a, b) for i, a in enumerate(names) for b in names[:i]):
                p["pre_origin"] = "ambiguous_path"
            if p["pre"] != p["post"]:
                out.append({**p, **self.count})
        return out


_PAIR = "request_id string, path string, pre string, post string, edits double, pre_origin string, post_origin string, partial_reads double, edits_seen double, edits_applied double, unlocatable double"


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pos", "msg_id"])
    t = _Trace()
    first = lambda args, keys: next((args[k] for k in keys if isinstance(args.get(k), str)), None)
    for role, content, calls in zip(pdf["role"], pdf["content"], pdf["tool_calls"]):
        if (role or "").strip().lower() in ("tool", "function"):
            for f in listed_files(content):
                t.read(f)
        for call in calls if calls is not None else []:
            f = call["function"] or {}
            try:
                args = json.loads(f["arguments"] or "{}")
            except (ValueError, TypeError):
                continue
            path = first(args, _PATH_KEYS) if isinstance(args, dict) else None
            name = (f["name"] or "").strip().lower()
            if path and name in WRITE_TOOLS and isinstance(args.get("content"), str):
                t.write(path, args["content"])
            elif path and name in EDIT_TOOLS:
                t.edit(path, first(args, ("oldString", "old_string", "old_str")) or "", first(args, ("newString", "new_string", "new_str")) or "")
    rid = pdf["request_id"].iloc[0]
    rows = [{"request_id": rid, **p} for p in t.result()] or [{"request_id": rid, "edits": 0.0}]  # without a path: none; dropped by the caller
    names = [x.split()[0] for x in _PAIR.split(", ")]
    kinds = {x.split()[0]: "float64" if x.endswith("double") else object for x in _PAIR.split(", ")}
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds[c]) for c in names})


def replay_edits(messages: DataFrame) -> DataFrame:
    """``(request_id, path, pre, post, edits, pre_origin, post_origin)`` of the files each trace changed, and its counters
    ``partial_reads, edits_seen, edits_applied, unlocatable``.

    Files are told apart by name; spellings of a name that cannot be one file make the pair `ambiguous_path`. Partial reads
    are not used; an edit whose old text is missing is skipped; unchanged pairs are dropped. Only messages with calls
    or file listings are shuffled.
    """
    useful = messages.where("request_id is not null and (size(tool_calls) > 0 or content like '%</content>%')").dropDuplicates(["msg_id"])
    rows = useful.select("request_id", "msg_id", F.coalesce("pos", F.lit(1 << 30)).cast("long").alias("pos"), "role", "content", "tool_calls")
    out = rows.groupBy("request_id").applyInPandas(_replay, _PAIR).where("path is not null")
    return out.withColumns({c: F.col(c).cast("int") for c in ("edits", "partial_reads", "edits_seen", "edits_applied", "unlocatable")})
