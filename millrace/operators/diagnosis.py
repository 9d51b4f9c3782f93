"""Why attempts fail: categories, mechanisms, failing tests, case groups over models, verdicts and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import binomial_tail, wilson
from millrace.operators.compare import majority_groups

# Labels of failure categories, patterns of mechanisms in the order they are tried, forms of failed tests.
_CATEGORIES = {"hack": "评测作弊失败", "sandbox": "沙箱基础设施失败", "service": "LLM服务失败", "budget": "预算耗尽失败", "protocol": "Agent协议失败", "not_run": "测试未执行", "reasoning": "模型推理失败"}
_MECHANISMS = [
    ("missing_kwarg", r"TypeError: .*unexpected keyword argument"), ("wrong_arity", r"TypeError: .*(takes|missing|positional argument)"), ("missing_attr", r"AttributeError: .*has no attribute"),
    ("missing_name", r"NameError: name|ImportError: cannot import name"), ("assertion", r"AssertionError|assert\.|AssertionError:|ERR_ASSERTION"),
]
_BROKE_FILE = r"SyntaxError|unterminated|Unexpected token|unexpected EOF"
_PYTEST_LINE, _NODE_LINE = r"(?m)^(?:FAILED|ERROR)\s+(\S+)", r"(?m)^\s*[✖✗]\s+(.+?)(?:\s+\(\d+(?:\.\d+)?ms\))?\s*$"


def failure_category(infra: Column, passed: Column, status: Column, reward_hack: Column, collection_error: Column) -> Column:
    """The category of a failed attempt, null of a passed one; flags that are null count as not set."""
    on = lambda c: F.coalesce(c, F.lit(False))
    k = _CATEGORIES
    return (
        F.when(on(passed), None).when(on(reward_hack), k["hack"]).when(on(infra) & status.eqNullSafe(F.lit("infra_error")), k["service"]).when(on(infra), k["sandbox"])
        .when(status == "timeout", k["budget"]).when(status == "failed", k["protocol"]).when(on(collection_error), k["not_run"]).otherwise(k["reasoning"])
    )


def mechanism(detail: Column, infra: Column, reward_hack: Column, collection_error: Column) -> Column:
    """How an attempt failed: its flags first, then the first pattern its detail matches."""
    d = F.coalesce(detail, F.lit(""))
    on = lambda c: F.coalesce(c, F.lit(False))
    flags = F.when(on(infra), "infra_error").when(on(reward_hack), "reward_hack").when(on(collection_error) & d.rlike(_BROKE_FILE), "solver_broke_file").when(on(collection_error), "collection_error")
    return F.coalesce(flags, *[F.when(d.rlike(p), name) for name, p in _MECHANISMS], F.when(d == "", "no_detail"), F.lit("other_error"))


def failing_tests(detail: Column) -> Column:
    """Sorted names of the tests that a runner's summary lists as failed, of both runners' forms."""
    d = F.coalesce(detail, F.lit(""))
    return F.array_sort(F.array_union(F.regexp_extract_all(d, F.lit(_PYTEST_LINE), F.lit(1)), F.regexp_extract_all(d, F.lit(_NODE_LINE), F.lit(1))))


def failure_reason(detail: Column, error: Column) -> Column:
    """The first line of the detail, else of the error, cut to a short name of its kind; `no_detail` without any."""
    text = F.trim(F.coalesce(F.nullif(F.trim(detail), F.lit("")), error, F.lit("")))
    line = F.substring_index(F.regexp_replace(text, r"\r\n?", "\n"), "\n", 1)
    return (
        F.when(text == "", "no_detail").when(line.startswith("missing key_lines"), "missing_key_lines").when(line.startswith("exit="), F.concat(F.lit("script_"), F.substring(line, 1, 20)))
        .when(F.lower(line).contains("parse"), "parse_error").when(line.contains("missing API") | line.contains("API key"), "missing_api_key").otherwise(F.substring(line, 1, 80))
    )


def failure_report(rows: DataFrame, top: int = 15) -> DataFrame:
    """``(kind, name, n)`` of attempts that did not pass: all categories, all statuses, and the ``top`` reasons, ties by name."""
    bad = rows.where(~F.coalesce("passed", F.lit(False))).select(
        F.coalesce("failure_category", F.when(F.coalesce("infra_error", F.lit(False)), "infra"), F.lit("unknown")).alias("category"),
        F.coalesce(F.nullif("agent_status", F.lit("")), F.lit("unknown")).alias("agent_status"), failure_reason(F.col("detail"), F.col("error_message")).alias("reason"),
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("category", "agent_status", "reason")])).alias("x")
    counts = bad.select(each).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    reasons = counts.where("kind = 'reason'").orderBy(F.desc("n"), "name").limit(top)
    return counts.where("kind <> 'reason'").unionByName(reasons)


def case_groups(results: DataFrame, models: tuple[str, str]) -> DataFrame:
    """``(case_id, group)``: `both_pass`, `both_fail` or `discordant` by the strict majorities of two models; cases both measured."""
    m = majority_groups(results)
    a, b = (m.where(F.col("model") == x).select("case_id", F.col("majority").alias(n)) for x, n in zip(models, "ab"))
    group = F.when(F.col("a") & F.col("b"), "both_pass").when(~F.col("a") & ~F.col("b"), "both_fail").otherwise("discordant")
    return a.join(b, "case_id").select("case_id", group.alias("group"))


def incomplete_runs(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``(run_id, missing)``: cases of the set that a run did not report; runs that cover all give no row."""
    n = cases.select("case_id").distinct().agg(F.count("*").alias("n"))
    got = results.join(cases.select("case_id").distinct(), "case_id", "left_semi").select("run_id", "case_id").distinct().groupBy("run_id").agg(F.count("*").alias("got"))
    runs = results.select("run_id").distinct().join(got, "run_id", "left").crossJoin(F.broadcast(n))  # one row
    return runs.select("run_id", (F.col("n") - F.coalesce("got", F.lit(0))).alias("missing")).where("missing > 0")


def case_mechanism(failures: DataFrame) -> DataFrame:
    """``(case_id, mechanism, failures)``: the most frequent mechanism of a case's failed attempts, `mixed` if two lead."""
    n = failures.groupBy("case_id", "mechanism").agg(F.count("*").alias("n"))
    top = n.groupBy("case_id").agg(F.max("n").alias("most"), F.sum("n").alias("failures"))
    lead = n.join(top, "case_id").where("n = most").groupBy("case_id").agg(F.min("mechanism").alias("m"), F.count("*").alias("k"), F.first("failures").alias("failures"))
    return lead.select("case_id", F.when(F.col("k") > 1, "mixed").otherwise(F.col("m")).alias("mechanism"), "failures")


def group_table(groups: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``(column, group, cases, share)``: how the cases of every group spread over a label; shares are within the group."""
    rows = groups.join(labels.select("case_id", column), "case_id").groupBy(column, "group").agg(F.count("*").alias("cases"))
    total = rows.groupBy("group").agg(F.sum("cases").alias("t"))
    return rows.join(total, "group").select(column, "group", "cases", (F.col("cases") / F.col("t")).alias("share"))


def verdict_label(answer: Column, labels: tuple[str, ...]) -> Column:
    """The one label that an answer names, in any case; null if it names none or several."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(rf"(?i)\b({'|'.join(labels)})\b"), F.lit(1)), F.upper))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def verdict_readout(answers: DataFrame, chance: float = 0.5) -> DataFrame:
    """Per model over ``(model, case_id, truth, verdict)``: answers, unreadable share, hits, hit rate with its interval, and the
    chance of so many hits by guessing."""
    out = answers.groupBy("model").agg(F.count("*").alias("answers"), F.count("verdict").alias("readable"), F.count_if(F.col("verdict") == F.col("truth")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("readable"))
    return out.select("*", (1 - F.col("readable") / F.col("answers")).alias("unreadable"), F.try_divide("hits", "readable").alias("hit_rate"), low.alias("ci_low"), high.alias("ci_high"), binomial_tail(F.col("hits"), F.col("readable"), chance).alias("p_value"))


def summary_by(rows: DataFrame, column: str, missing: str = "unset") -> DataFrame:
    """``(column, n)``: counts by a label, null and empty under ``missing``, most frequent first, ties by label."""
    name = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing))
    return rows.groupBy(name.alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def fold_message_events(events: DataFrame) -> DataFrame:
    """Usage and tools of runs from a log of JSON events ``(run, seq, event)`` that reports usage at each message's end.

    Tokens are those of assistant messages at `message_end`: input with what was read from and written to a cache, output as it
    is. Tool ends are attached to their starts by call id. Lines that are no JSON are left out.
    """
    g = lambda p: F.get_json_object("event", p)
    n = lambda p: F.coalesce(g(p).cast("long"), F.lit(0))
    kind, ended = g("$.type"), (g("$.type") == "message_end") & (g("$.message.role") == "assistant")
    rows = events.where(kind.isNotNull()).select(
        "run", "seq", kind.alias("kind"), ended.alias("ended"), (n("$.message.usage.input") + n("$.message.usage.cacheRead") + n("$.message.usage.cacheWrite")).alias("prompt"), n("$.message.usage.output").alias("output"),
        g("$.message.stopReason").alias("stop"), ((g("$.type") == "tool_execution_end") & g("$.isError").eqNullSafe(F.lit("true"))).alias("bad"), g("$.toolCallId").alias("call"),
    )
    return rows.groupBy("run").agg(
        F.sum(F.when(F.col("ended"), F.col("prompt")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("ended"), F.col("output")).otherwise(0)).alias("completion_tokens"),
        F.count_if("ended").alias("model_calls"), F.count_if(F.col("kind") == "turn_end").alias("turns"), F.count_if(F.col("kind") == "tool_execution_start").alias("tool_calls"), F.count_if("bad").alias("tool_errors"),
        F.count_if((F.col("kind") == "error") | (F.col("ended") & F.col("stop").isin("error", "aborted"))).alias("session_errors"),
        (F.count_if(F.col("kind") == "tool_execution_start") - F.count_distinct(F.when(F.col("kind") == "tool_execution_end", F.col("call")))).alias("unfinished_calls"),
    )


def fold_step_events(events: DataFrame) -> DataFrame:
    """The same for a log whose steps report their whole context: fields are summed over `step_finish`, reasoning counts as output."""
    g = lambda p: F.get_json_object("event", p)
    n = lambda p: F.coalesce(g(p).cast("long"), F.lit(0))
    kind, step = g("$.type"), g("$.type") == "step_finish"
    rows = events.where(kind.isNotNull()).select(
        "run", "seq", kind.alias("kind"), step.alias("step"), (n("$.part.tokens.input") + n("$.part.tokens.cache.read")).alias("prompt"), (n("$.part.tokens.output") + n("$.part.tokens.reasoning")).alias("output"), n("$.part.tokens.total").alias("total"),
        g("$.part.state.status").alias("status"), g("$.part.text").alias("text"),
    )
    s = lambda c: F.sum(F.when(F.col("step"), F.col(c)).otherwise(0))
    return rows.groupBy("run").agg(
        s("prompt").alias("prompt_tokens"), s("output").alias("completion_tokens"), s("total").alias("total_tokens"), F.count_if("step").alias("model_calls"), F.count_if(F.col("kind") == "tool_use").alias("tool_calls"),
        F.count_if((F.col("kind") == "tool_use") & (F.col("status") == "error")).alias("tool_errors"), F.max_by(F.when(F.trim("text") != "", F.col("text")), F.when((F.col("kind") == "text") & (F.trim("text") != ""), F.col("seq"))).alias("final_text"),
        F.coalesce(F.bool_or((F.col("kind") == "text") & F.lower("text").rlike("maximum (number of )?steps")), F.lit(False)).alias("hit_step_limit"), F.count_if(F.col("kind") == "error").alias("session_errors"),
    )


def first_per_text(rows: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """The first row of every distinct text within a group."""
    w = Window.partitionBy(group, F.sha2(F.coalesce(text, F.lit("")), 256)).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
