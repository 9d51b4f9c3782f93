"""Row-wise operators over chat records, files and cases, and the joins that check them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Languages by file suffix.
SUFFIXES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "json": "json", "toml": "toml", "md": "markdown", "yaml": "yaml", "yml": "yaml"}


# User-agent marker, tools that show coding, and the words of a coding task.
_AGENT = r"(?i)User-Agent:\s*([^|,\]]+)"
CODING_TOOLS = ["bash", "read", "write", "edit", "glob", "grep", "ast_grep_search", "ast_grep_replace", "interactive_bash", "lsp_diagnostics", "file_write", "file_fetch", "exec"]
CODING_AGENTS = r"(?i)opencode|codegenie"
_WITH_TOOLS = r"(?i)(代码|实现|修复|重构|函数|bug|fix|implement|refactor|class |def |import |编译|测试|pytest|error)"
_ALONE = r"(?i)(实现|修复|重构|bug|fix|implement|refactor|写一个|编写一个|python|代码|函数|算法)"
_SESSION = r"(?i)(实现|修复|重构|bug|fix|implement|refactor|add test|写个|改一下|报错)"
#: Characters kept of a prompt.
PROMPT_CHARS = 8000


def part_text(v: str) -> str:
    """SQL: the text of one part of a message's content, a variant: its text, else its content, else its JSON."""
    kind = f"schema_of_variant({v})"
    return f"CASE WHEN {kind} LIKE 'OBJECT%' THEN coalesce(try_variant_get({v}, '$.text', 'string'), CASE WHEN try_variant_get({v}, '$.type', 'string') = 'text' OR is_variant_null(variant_get({v}, '$.text', 'variant')) THEN '' END, try_variant_get({v}, '$.content', 'string'), CASE WHEN is_variant_null(variant_get({v}, '$.content', 'variant')) THEN '' END, to_json({v})) WHEN {kind} = 'STRING' THEN CAST({v} AS STRING) ELSE to_json({v}) END"


def content_text(v: str) -> str:
    """SQL: the text of a message's content, a variant: a string, a list of parts joined by line ends, an object's text or its JSON; '' of null."""
    kind = f"schema_of_variant({v})"
    return f"""CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN '' WHEN {kind} = 'STRING' THEN CAST({v} AS STRING)
      WHEN {kind} LIKE 'ARRAY%' THEN array_join(transform(try_variant_get({v}, '$', 'array<variant>'), x -> {part_text("x")}), '\n')
      WHEN {kind} LIKE 'OBJECT%' THEN coalesce(try_variant_get({v}, '$.text', 'string'), to_json({v})) ELSE to_json({v}) END"""


def normalized_messages(records: DataFrame, history: str = "full_history") -> DataFrame:
    """``(request_id, pos, role, content, name, tool_calls)`` of every object in a JSON history, in its order.

    Histories that are null, empty, cut or no list give nothing, parts that are no objects are left out; a missing role
    is `unknown`; content is text (``content_text``); tool calls stay JSON, `[]` if there are none.
    """
    v = F.try_parse_json(F.col(history))
    rows = records.select("request_id", v.alias("v")).where("v is not null and schema_of_variant(v) like 'ARRAY%'")
    items = rows.selectExpr("request_id", "posexplode(try_variant_get(v, '$', 'array<variant>')) AS (pos, m)").where("schema_of_variant(m) like 'OBJECT%'")
    fields = items.selectExpr("request_id", "pos", "m", "try_variant_get(m, '$.content', 'variant') AS c")
    return fields.selectExpr(
        "request_id", "pos", "coalesce(nullif(try_variant_get(m, '$.role', 'string'), ''), 'unknown') AS role", f"{content_text('c')} AS content",
        "try_variant_get(m, '$.name', 'string') AS name", "coalesce(to_json(try_variant_get(m, '$.tool_calls', 'variant')), '[]') AS tool_calls",
    )


def user_agent(tags: Column) -> Column:
    """What follows `User-Agent:` in the tags, up to a bar, comma or bracket; else `opencode` if that is named anywhere; else null.

    Tags are a JSON list of strings, or any text.
    """
    each = F.from_json(tags, "array<string>")
    blob = F.coalesce(F.when(F.ltrim(tags).startswith("["), F.array_join(each, " | ")), tags, F.lit(""))
    agent = F.nullif(F.trim(F.regexp_extract(blob, _AGENT, 1)), F.lit(""))
    return F.coalesce(agent, F.when(F.lower(blob).contains("opencode"), "opencode"))


def tool_names(tools: Column) -> Column:
    """Names of the objects in a JSON list of tools: `function.name`, else `name`; empty for anything else."""
    rows = F.from_json(tools, "array<struct<name:string,function:struct<name:string>>>")
    named = F.transform(rows, lambda t: F.coalesce(F.nullif(t["function"]["name"], F.lit("")), F.nullif(t["name"], F.lit(""))))
    return F.coalesce(F.array_compact(named), F.array().cast("array<string>"))


def is_coding_record(agent: Column, tools: Column, text: Column) -> Column:
    """Whether a record is about code: by its agent, by a coding tool together with its words, or by its words alone."""
    text = F.coalesce(text, F.lit(""))
    held = F.coalesce(F.arrays_overlap(tools, F.array(*map(F.lit, CODING_TOOLS))), F.lit(False))
    return F.coalesce(agent.rlike(CODING_AGENTS), F.lit(False)) | (held & text.rlike(_WITH_TOOLS)) | text.rlike(_ALONE)


def user_texts(messages: Column) -> Column:
    """Contents of the user turns of an array of messages with role and content, in order."""
    return F.transform(F.filter(messages, lambda m: m["role"].isin("user", "human")), lambda m: F.coalesce(m["content"], F.lit("")))


def is_coding_session(messages: Column) -> Column:
    """Whether the user turns of a session name a coding task."""
    return F.coalesce(F.array_join(user_texts(messages), "\n").rlike(_SESSION), F.lit(False))


def primary_prompt(texts: Column, limit: int = PROMPT_CHARS) -> Column:
    """The task out of the user turns of a session: reminders and metadata are dropped; with several turns the last one if it
    has 20 characters, else the first and the last; '' without any."""
    def clean(t: Column) -> Column:
        t = F.regexp_replace(_strip(t), r"(?is)<system-reminder>.*?</system-reminder>", "")
        return F.when(t.startswith("text:"), _strip(F.substring(t, 6, 1 << 30))).otherwise(t)

    kept = F.filter(F.transform(texts, clean), lambda t: (F.length(t) >= 4) & ~t.startswith("Sender (untrusted metadata)"))
    first, last = F.try_element_at(kept, F.lit(1)), F.try_element_at(kept, F.lit(-1))
    chosen = F.when((first == last) | (F.length(last) >= 20), last).otherwise(F.concat(first, F.lit("\n\n"), last))
    return F.substring(F.coalesce(chosen, F.lit("")), 1, limit)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def guess_language(prompt: Column, paths: Column, fences: Column) -> Column:
    """Language named in the prompt, else that of the first file with a known suffix, else of the first known fence, else python."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    has = lambda *words: [p.contains(w) for w in words]
    either = lambda *cs: reduce(lambda a, b: a | b, cs)
    named = (
        F.when(either(*has("python", "pytest", ".py")), "python").when(either(*has("typescript", ".ts")), "typescript").when(either(*has("javascript", ".js")), "javascript")
        .when(p.contains("java"), "java").when(either(*has("cangjie", ".cj")), "cangjie")
    )
    suffix = lambda x: F.when(x.endswith(".py"), "python").when(x.endswith(".ts"), "typescript").when(x.endswith(".js"), "javascript").when(x.endswith(".cj"), "cangjie")
    tag = lambda x: F.when(x.isin("python", "py"), "python").when(x.isin("ts", "typescript"), "typescript").when(x.isin("js", "javascript"), "javascript")
    first = lambda xs, f: F.try_element_at(F.array_compact(F.transform(xs, f)), F.lit(1))
    return F.coalesce(named, first(paths, suffix), first(fences, tag), F.lit("python"))


def split_side(split: Column) -> Column:
    """`train`, `eval` or null of a split written in any case and with any blanks; unknown names are null."""
    name = F.lower(F.regexp_replace(split, r"\s", ""))
    return F.when(name == "train", "train").when(name.isin("dev", "test", "holdout"), "eval")


def base_name(path: Column) -> Column:
    """The last component of a path with slashes of either kind."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def language_of(path: Column) -> Column:
    """Language by suffix, `other` if unknown."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"\.([A-Za-z]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix], F.lit("other"))


def is_test_path(path: Column) -> Column:
    """Whether a test runner would collect the file by its name or folder."""
    name = F.lower(base_name(path))
    return name.rlike(r"^test_.*\.pyi?$|_test\.pyi?$|\.(test|spec)\.[mc]?[jt]sx?$") | F.lower(path).rlike(r"(^|[/\\])(tests?|__tests__)[/\\]")


def redacted_path(path: Column) -> Column:
    """Base name, `#` and the first 12 hex digits of the path's SHA-256."""
    return F.concat(base_name(path), F.lit("#"), F.substring(F.sha2(path, 256), 1, 12))


def is_safe_id(c: Column) -> Column:
    """1 to 128 of letters, digits, dot, underscore and dash, and not dots alone."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~c.rlike(r"^\.+$"), F.lit(False))


def runner_counts(output: Column) -> tuple[Column, Column]:
    """Passed and failed tests named in a runner's output, the largest number of each; 0 if none is named."""
    best = lambda word: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(output, F.lit(rf"(\d{{1,9}}) {word}"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))
    return best("passed"), best("failed")


def uncovered(items: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Keys of ``items`` that ``covered`` does not have."""
    return items.select(key).where(F.col(key).isNotNull()).distinct().join(covered.select(key), key, "left_anti")


def conflicting_ids(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, versions)``: ids whose rows differ, exact duplicates apart."""
    return df.select(key, F.xxhash64(*columns).alias("h")).groupBy(key).agg(F.count_distinct("h").alias("versions")).where("versions > 1")


def nearest_by_size(files: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """``(key, nearest, difference)``: the other text of the group whose length is nearest, ties by key.

    Neighbours in length order are enough: the nearest is the row before or after.
    """
    rows = files.where(F.col(text).isNotNull()).select(group, key, F.length(text).alias("n")).dropDuplicates([key])
    # The row before in length: with equal lengths the least key must win, so each length keeps its two least keys.
    rank = F.row_number().over(Window.partitionBy(group, "n").orderBy(key))
    heads = rows.withColumn("r", rank).where("r <= 2").groupBy(group, "n").agg(F.min(key).alias("k1"), F.max(key).alias("k2"), F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy("n")
    heads = heads.withColumn("nl", F.lag("n").over(w)).withColumn("kl", F.lag("k1").over(w)).withColumn("nh", F.lead("n").over(w)).withColumn("kh", F.lead("k1").over(w))
    both = rows.join(heads, [group, "n"])
    same = F.when(F.col("c") > 1, F.struct(F.lit(0).alias("difference"), F.when(F.col(key) == F.col("k1"), F.col("k2")).otherwise(F.col("k1")).alias("nearest")))
    low = F.when(F.col("nl").isNotNull(), F.struct((F.col("n") - F.col("nl")).alias("difference"), F.col("kl").alias("nearest")))
    high = F.when(F.col("nh").isNotNull(), F.struct((F.col("nh") - F.col("n")).alias("difference"), F.col("kh").alias("nearest")))
    best = F.array_min(F.array_compact(F.array(same, low, high)))
    return both.select(key, best.alias("b")).where("b is not null").select(key, "b.nearest", "b.difference")
