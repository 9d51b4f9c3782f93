"""Registered queries of the outcome, calibration, comparison, text and trace operators, with their SQL.

The tables hold no benchmark outcomes, so orders stand for attempts (customer = case, priority = run, status F = passed,
P = lost to infrastructure, price = tokens) and line items for calibration attempts (part = case, return flag = anchor).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import blind, calibration, compare, gates, outcomes, records, text, traces
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


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_ATT = """att AS (SELECT o_orderpriority AS run_id, CAST(o_custkey AS VARCHAR) AS case_id,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt,
  o_orderstatus = 'F' AS passed, o_orderstatus = 'P' AS infra_error, CAST(floor(o_totalprice) AS BIGINT) AS total_tokens, floor(o_totalprice) / 8 AS wall_time_s FROM orders)"""
_FOLD = _ATT + """, f AS (SELECT run_id, case_id, count(*) AS attempt_count, count(*) FILTER (NOT infra_error) AS usable_attempt_count,
  arg_min(passed, (CASE WHEN infra_error THEN 1 ELSE 0 END) * 1000000 + attempt) AS passed, avg(CASE WHEN NOT infra_error THEN CAST(passed AS DOUBLE) END) AS pass_at_1,
  coalesce(bool_or(passed) FILTER (NOT infra_error), false) AS pass_at_k, coalesce(bool_and(passed) FILTER (NOT infra_error), false) AS pass_pow_k,
  count(*) FILTER (NOT infra_error) = 0 AS infra_error, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(wall_time_s) AS wall_time_s FROM att GROUP BY run_id, case_id),
  folded AS (SELECT *, CASE WHEN pass_at_k THEN passed END AS selection_hit FROM f)"""
_WILSON = """round(greatest((s/n + 1.9208/n)/(1 + 3.8416/n) - 1.96*sqrt(s/n*(1-s/n)/n + 0.9604/(n*n))/(1 + 3.8416/n), 0), 6) AS ci_low,
  round(least((s/n + 1.9208/n)/(1 + 3.8416/n) + 1.96*sqrt(s/n*(1-s/n)/n + 0.9604/(n*n))/(1 + 3.8416/n), 1), 6) AS ci_high"""
_CAL = """cal AS (SELECT l_partkey AS case_id, l_returnflag AS anchor, l_returnflag || l_linestatus AS run_id, l_discount < 0.055 AS passed, l_tax > 0.075 AS infra_error FROM lineitem),
  ok AS (SELECT *, CAST(passed AS INT) AS won FROM cal WHERE NOT infra_error),
  ba AS (SELECT case_id, anchor, count(*) AS n, CAST(sum(won) AS BIGINT) AS s FROM ok GROUP BY 1, 2),
  pooled AS (SELECT case_id, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(s) AS BIGINT) AS passes, max(s::DOUBLE/n) - min(s::DOUBLE/n) AS spread, bool_or(s > 0 AND s < n) AS flaky, count(*) AS measured FROM ba GROUP BY 1),
  cell AS (SELECT case_id, run_id, avg(won) AS item, sum(won) AS w FROM ok GROUP BY 1, 2),
  runs AS (SELECT run_id, sum(w) AS rp, count(*) AS rm FROM cell GROUP BY 1),
  x AS (SELECT case_id, item, (rp - item) / (rm - 1) AS rest FROM cell JOIN runs USING (run_id)),
  co AS (SELECT case_id, count(*) AS k, sum(item) AS si, sum(rest) AS sr, sum(item*item) AS sii, sum(rest*rest) AS srr, sum(item*rest) AS sir FROM x GROUP BY 1),
  corr AS (SELECT case_id, CASE WHEN k >= 2 AND k*sii - si*si > 1e-9 AND k*srr - sr*sr > 1e-9 THEN (k*sir - si*sr) / sqrt((k*sii - si*si) * (k*srr - sr*sr)) END AS r FROM co),
  item AS (SELECT c.case_id, coalesce(attempts, 0) AS attempts, coalesce(passes, 0) AS passes, passes::DOUBLE / attempts AS p_hat, spread, flaky, r AS point_biserial, coalesce(measured, 0) < (SELECT count(DISTINCT anchor) FROM ba) AS incomplete
    FROM (SELECT DISTINCT case_id FROM cal) c LEFT JOIN pooled USING (case_id) LEFT JOIN corr USING (case_id)),
  judged AS (SELECT *, CASE WHEN p_hat IS NULL THEN 'unmeasured' WHEN p_hat < 0.2 THEN 'hard' WHEN p_hat > 0.8 THEN 'easy' ELSE 'mid' END AS band,
    CASE WHEN incomplete THEN 'incomplete_panel' WHEN p_hat > 0.9 THEN 'too_easy' WHEN p_hat < 0.05 THEN 'unsolved' WHEN point_biserial < 0.15 THEN 'no_discrimination' ELSE '' END AS reason FROM item)"""


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("millrace_orders")
    return spark.sql("WITH " + _ATT.replace("FROM orders", "FROM millrace_orders").replace("AS VARCHAR", "AS STRING") + " SELECT * FROM att")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.fold_attempts(_attempts(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("anchor"), F.concat("l_returnflag", "l_linestatus").alias("run_id"), (F.col("l_discount") < 0.055).alias("passed"), (F.col("l_tax") > 0.075).alias("infra_error"),
    )
    return calibration.item_statistics(rows)


@_query(f"""WITH r AS (SELECT source, lang, coalesce(n_chars, 0) >= 1000 AS passed FROM documents WHERE n_chars IS NOT NULL AND n_chars > 0),
  u AS (SELECT 'source' AS axis, coalesce(nullif(source, ''), 'unknown') AS label, passed FROM r UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), 'unknown'), passed FROM r),
  g AS (SELECT axis, label, count(*) AS n, CAST(count(*) FILTER (passed) AS BIGINT) AS successes, CAST(count(*) FILTER (passed) AS DOUBLE) AS s FROM u GROUP BY 1, 2)
  SELECT axis, label, n, successes, round(s/n, 6) AS success_rate, {_WILSON} FROM g""")
def stratified_success(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "lang", (F.coalesce("n_chars", F.lit(0)) >= 1000).alias("passed"), (F.coalesce("n_chars", F.lit(0)) == 0).alias("infra_error"))
    return _round(outcomes.stratify(rows, ["source", "lang"]), "success_rate", "ci_low", "ci_high")


@_query(f"""WITH {_FOLD} SELECT run_id, case_id, attempt_count, usable_attempt_count, passed, round(pass_at_1, 6) AS pass_at_1, pass_at_k, pass_pow_k, infra_error, total_tokens, wall_time_s, coalesce(CAST(selection_hit AS VARCHAR), 'none') AS selection_hit FROM folded""")
def attempt_fold(spark: SparkSession, d: str) -> DataFrame:
    out = _folded(spark, d).withColumn("selection_hit", F.coalesce(F.col("selection_hit").cast("string"), F.lit("none")))
    return _round(out, "pass_at_1")


@_query(f"""WITH {_FOLD}, g AS (SELECT run_id, count(*) AS case_count, CAST(count(*) FILTER (NOT infra_error) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT infra_error AND passed) AS DOUBLE) AS s, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(wall_time_s) AS wall_time_s FROM folded GROUP BY 1)
  SELECT run_id, case_count, CAST(n AS BIGINT) AS effective, CAST(s AS BIGINT) AS successes, total_tokens, wall_time_s, round(s/n, 6) AS success_rate, {_WILSON}, round((case_count - n)/case_count, 6) AS infra_error_rate, round(total_tokens/n, 3) AS tokens_per_case, round(total_tokens/s, 3) AS tokens_per_success, n < 0.8*case_count AS infra_dominated FROM g""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    out = outcomes.run_summary(_folded(spark, d))
    return _round(_round(out, "success_rate", "ci_low", "ci_high", "infra_error_rate"), "tokens_per_case", "tokens_per_success", digits=3)


@_query(f"""WITH {_FOLD} SELECT run_id, round(avg(attempt_count), 6) AS mean_attempts, round(avg(pass_at_1), 6) AS pass_at_1, round(avg(CAST(pass_at_k AS INT)), 6) AS pass_at_k, round(avg(CAST(pass_pow_k AS INT)), 6) AS pass_pow_k, round(avg(CAST(selection_hit AS INT)), 6) AS selection_hit_rate FROM folded WHERE NOT infra_error GROUP BY 1""")
def scaling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(outcomes.scaling(_folded(spark, d)), "mean_attempts", "pass_at_1", "pass_at_k", "pass_pow_k", "selection_hit_rate")


_RUNGS = """o AS (SELECT total_tokens, row_number() OVER (ORDER BY total_tokens) AS i, count(*) OVER () AS n FROM folded WHERE NOT infra_error),
  rungs AS (SELECT DISTINCT total_tokens AS budget FROM o, (VALUES (0.25::DOUBLE), (0.5), (0.75), (0.9), (1.0)) q(f) WHERE i = greatest(CAST(ceil(f*n) AS BIGINT), 1))"""


@_query(f"WITH {_FOLD}, {_RUNGS} SELECT CAST(row_number() OVER (ORDER BY budget) - 1 AS INT) AS rung, budget FROM rungs")
def budget_rungs(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.budget_rungs(_folded(spark, d))


@_query(f"""WITH {_FOLD}, {_RUNGS} SELECT run_id, budget, count(*) FILTER (passed AND total_tokens <= budget) AS solved, count(*) AS n, round(count(*) FILTER (passed AND total_tokens <= budget)::DOUBLE/count(*), 6) AS share FROM folded, rungs WHERE NOT infra_error GROUP BY 1, 2""")
def cost_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d)
    return _round(outcomes.cost_curve(rows, outcomes.budget_rungs(rows)), "share")


@_query("""SELECT coalesce(nullif(event_type, ''), 'unknown') AS category, regexp_replace(lower(split_part(coalesce(props, ''), chr(10), 1)), '[0-9]+', '#', 'g') AS line, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""")
def failure_top(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.failure_top(table(spark, d, "events").where("event_type = 'error'"), "event_type", "props")


@_query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return outcomes.cost_rollup(rows, ["l_returnflag", "l_linestatus"], {"quantity": "q"})


@_query(f"""WITH {_CAL} SELECT case_id, attempts, passes, round(p_hat, 6) AS p_hat, round(spread, 6) AS spread, flaky, round(point_biserial, 5) AS point_biserial, band, reason FROM judged""")
def item_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = _items(spark, d).select("case_id", "attempts", "passes", "p_hat", "spread", "flaky", "point_biserial", "band", F.array_join("reasons", ",").alias("reason"))
    return _round(_round(out, "p_hat", "spread"), "point_biserial", digits=5)


@_query(f"""WITH {_CAL}, ph AS (SELECT coalesce(p_hat, 0) AS p FROM judged) SELECT b.bucket, (SELECT count(*) FROM ph WHERE ph.p >= b.lo AND (ph.p < b.hi OR b.hi = 1)) AS n FROM (VALUES ('0.0-0.2', 0.0, 0.2), ('0.2-0.5', 0.2, 0.5), ('0.5-0.8', 0.5, 0.8), ('0.8-1.0', 0.8, 1)) b(bucket, lo, hi)""")
def p_buckets(spark: SparkSession, d: str) -> DataFrame:
    return calibration.p_buckets(_items(spark, d))


@_query(f"WITH {_CAL} SELECT band, reason, count(*) AS n FROM judged GROUP BY 1, 2")
def band_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy("band", F.array_join("reasons", ",").alias("reason")).agg(F.count("*").alias("n"))


@_query(f"""WITH {_CAL}, rk AS (SELECT case_id, band, row_number() OVER (PARTITION BY band ORDER BY round(coalesce(spread, 0), 9) DESC, round(coalesce(point_biserial, 0), 9) DESC, case_id) AS rank FROM judged WHERE band IN ('hard', 'mid', 'easy'))
  SELECT case_id, band, CAST(rank AS INT) AS rank FROM rk WHERE rank <= CASE band WHEN 'hard' THEN 30 WHEN 'mid' THEN 50 ELSE 20 END""")
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("spread", F.round("spread", 9)).withColumn("point_biserial", F.round("point_biserial", 9))
    return calibration.quota_select(items, "band", {"hard": 0.3, "mid": 0.5, "easy": 0.2}, 100).select("case_id", "band", "rank")


_PAIRS = f"""{_FOLD}, base AS (SELECT case_id, passed AS a FROM folded WHERE run_id = '1-URGENT' AND NOT infra_error), p AS (SELECT run_id AS candidate, count(*) FILTER (a AND passed) AS both_passed, count(*) FILTER (a AND NOT passed) AS only_baseline, count(*) FILTER (NOT a AND passed) AS only_candidate, count(*) FILTER (NOT a AND NOT passed) AS neither
  FROM folded JOIN base USING (case_id) WHERE run_id <> '1-URGENT' AND NOT infra_error GROUP BY 1), q AS (SELECT *, only_baseline + only_candidate AS discordant FROM p)"""


@_query(f"""WITH {_PAIRS} SELECT *, CASE WHEN discordant = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(discordant + 1.0) - lgamma(k + 1.0) - lgamma(discordant - k + 1.0) - discordant * ln(2.0))) FROM range(0, least(only_baseline, only_candidate) + 1) t(k))), 6) END AS p_value FROM q""")
def paired_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).withColumn("attempt", F.lit(1))
    return _round(compare.paired_outcomes(rows, "1-URGENT"), "p_value")


@_query(f"WITH {_PAIRS} SELECT CAST(sum(discordant) AS BIGINT) AS discordant, CAST(sum(both_passed + discordant + neither) AS BIGINT) AS pairs, round(sum(discordant)::DOUBLE / sum(both_passed + discordant + neither), 6) AS discordance FROM q")
def pooled_discordance(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).withColumn("attempt", F.lit(1))
    return _round(compare.pooled_discordance(compare.paired_outcomes(rows, "1-URGENT")), "discordance")


@_query("""SELECT r_regionkey, CAST(ceil(pow(1.959963985 * sqrt(psi) + 0.841621234 * sqrt(psi - delta*delta), 2) / (delta*delta)) AS BIGINT) AS pairs FROM (SELECT r_regionkey, 0.05 + r_regionkey * 0.01 AS delta, 0.2 + r_regionkey * 0.05 AS psi FROM region)""")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return r.select("r_regionkey", stats.mcnemar_sample_size(0.05 + F.col("r_regionkey") * 0.01, 0.2 + F.col("r_regionkey") * 0.05).cast("long").alias("pairs"))


@_query(f"""WITH {_FOLD}, g AS (SELECT run_id, count(*) FILTER (NOT infra_error AND passed)::DOUBLE / count(*) FILTER (NOT infra_error) AS success_rate, CAST(sum(total_tokens) AS BIGINT) AS t FROM folded GROUP BY 1), b AS (SELECT success_rate AS r0, t AS t0 FROM g WHERE run_id = '1-URGENT')
  SELECT run_id, round(success_rate, 6) AS success_rate, round(success_rate - r0, 6) AS lift, round(t::DOUBLE/t0, 6) AS token_multiple FROM g, b""")
def lift_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _round(compare.against_baseline(outcomes.run_summary(_folded(spark, d)), "1-URGENT"), "success_rate", "lift", "token_multiple")


@_query("""SELECT p_name AS name, array_to_string(list_filter([CASE WHEN p_brand IS DISTINCT FROM b0 THEN 'p_brand' END, CASE WHEN p_type IS DISTINCT FROM t0 THEN 'p_type' END, CASE WHEN p_size IS DISTINCT FROM s0 THEN 'p_size' END], lambda x: x IS NOT NULL), ',') AS differs
  FROM (SELECT 'k' || p_partkey AS p_name, p_brand, p_type, p_size FROM part) p, (SELECT p_brand AS b0, p_type AS t0, p_size AS s0 FROM part WHERE p_partkey = 1) b WHERE p_name <> 'k1'""")
def axis_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey")).alias("name"), "p_brand", "p_type", "p_size")
    return compare.axis_differences(rows, "name", ["p_brand", "p_type", "p_size"], "k1").select("name", F.array_join("differs", ",").alias("differs"))


@_query(f"""WITH {_CAL} SELECT case_id, anchor AS model, s AS passes, n, 2*s > n AS majority, s = 0 OR s = n AS unanimous, least(s, n - s) AS flips FROM ba""")
def majority_groups(spark: SparkSession, d: str) -> DataFrame:
    return compare.majority_groups(_calibration_rows(spark, d))


def _calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("anchor"), (F.col("l_discount") < 0.055).alias("passed"), (F.col("l_tax") > 0.075).alias("infra_error"))


@_query("""WITH t AS (SELECT count(*) FILTER (g AND h) AS a, count(*) FILTER (g AND NOT h) AS b, count(*) FILTER (NOT g AND h) AS c, count(*) FILTER (NOT g AND NOT h) AS d FROM (SELECT s_nationkey < 12 AS g, s_acctbal > 5000 AS h FROM supplier)),
  x AS (SELECT *, a+b AS r, a+c AS k, a+b+c+d AS n FROM t), f AS (SELECT *, lgamma(r+1.0)+lgamma(n-r+1.0)+lgamma(k+1.0)+lgamma(n-k+1.0)-lgamma(n+1.0) AS w FROM x),
  p AS (SELECT i, exp(w-lgamma(i+1.0)-lgamma(r-i+1.0)-lgamma(k-i+1.0)-lgamma(n-r-k+i+1.0)) AS q, i = a AS seen FROM f, range(0, 100000) z(i) WHERE i BETWEEN greatest(0, r+k-n) AND least(r, k))
  SELECT a, b, c, d, round(least(1.0, (SELECT sum(q) FROM p WHERE q <= (SELECT q FROM p WHERE seen) + 1e-12)), 6) AS p_value FROM t""")
def fisher_enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select((F.col("s_nationkey") < 12).alias("g"), (F.col("s_acctbal") > 5000).alias("h"))
    return _round(compare.enrichment(rows, "g", "h"), "p_value")


_EDITS = """ev AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'test' ELSE 'other' END AS kind FROM events)"""


@_query(f"""WITH {_EDITS}, e AS (SELECT user_id, kind, ts, event_id, sum(CASE WHEN kind = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS edits FROM ev WHERE kind <> 'other'),
  t AS (SELECT user_id, edits, lag(edits) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE kind = 'test')
  SELECT u.user_id, coalesce(r, 0) AS rounds FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN (SELECT user_id, count(*) FILTER (edits > before) AS r FROM t GROUP BY 1) x USING (user_id)""")
def repair_rounds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "view", "test").otherwise("other")
    return traces.repair_rounds(table(spark, d, "events").withColumn("kind", kind), "user_id", ["ts", "event_id"])


_MSG = "m AS (SELECT DISTINCT ON (msg_id) *, lower(trim(role)) AS r FROM messages)"
_KINDS = "CASE WHEN lower(trim(name)) IN ('read','view','cat','open','file_read','list','ls','glob','readfile') THEN 'read' WHEN lower(trim(name)) IN ('grep','search','ripgrep','rg','find','ast_grep_search','codebase_search') THEN 'search' WHEN lower(trim(name)) IN ('write','edit','multiedit','file_write','patch','apply_patch','str_replace','str_replace_editor','ast_grep_replace') THEN 'edit' WHEN lower(trim(name)) IN ('bash','exec','shell','run','run_command','interactive_bash','terminal') THEN 'exec' ELSE 'other' END"
_SIGNALS = f"""{_MSG}, c AS (SELECT request_id, c."function".name AS name, c."function".arguments AS args FROM (SELECT request_id, unnest(tool_calls) AS c FROM m)), k AS (SELECT request_id, lower(name) AS name, json_extract_string(args, '$.filePath') AS path, {_KINDS} AS kind FROM c WHERE name <> ''),
  b AS (SELECT request_id, count(*) FILTER (r IN ('user', 'human')) AS user_turns, count(*) FILTER (r = 'assistant') AS assistant_turns, count(*) FILTER (r = 'tool' AND regexp_matches(coalesce(content, ''), 'Traceback \\(most recent call last\\)|AssertionError|\\bFAILED\\b|\\bERROR\\b|SyntaxError|ImportError|ModuleNotFoundError|TypeError|\\bexit(?:\\s+code)?[=:\\s]+[1-9]')) AS error_signals FROM m GROUP BY 1),
  g AS (SELECT request_id, count(*) AS tool_calls, count(*) FILTER (kind = 'read') AS read_ops, count(*) FILTER (kind = 'search') AS search_ops, count(*) FILTER (kind = 'edit') AS edit_ops, count(*) FILTER (kind = 'exec') AS exec_ops, count(DISTINCT CASE WHEN kind = 'edit' THEN path END) AS files_touched,
    count(DISTINCT CASE WHEN kind = 'read' THEN path END) AS files_read, array_to_string(list_sort(list(DISTINCT name)), ',') AS tools FROM k GROUP BY 1),
  sig AS (SELECT b.request_id, user_turns, assistant_turns, error_signals, coalesce(tool_calls, 0) AS tool_calls, coalesce(read_ops, 0) AS read_ops, coalesce(search_ops, 0) AS search_ops, coalesce(edit_ops, 0) AS edit_ops, coalesce(exec_ops, 0) AS exec_ops, coalesce(files_touched, 0) AS files_touched, coalesce(files_read, 0) AS files_read, coalesce(tools, '') AS tools FROM b LEFT JOIN g USING (request_id))"""


@_query(f"WITH {_SIGNALS} SELECT * FROM sig")
def trace_signals(spark: SparkSession, d: str) -> DataFrame:
    out = traces.trace_signals(table(spark, d, "messages"))
    names = ["user_turns", "assistant_turns", "error_signals", "tool_calls", "read_ops", "search_ops", "edit_ops", "exec_ops", "files_touched", "files_read"]
    return out.select("request_id", *names, F.array_join("distinct_tools", ",").alias("tools"))


@_query(f"""WITH {_SIGNALS} SELECT CASE WHEN files_touched >= 3 THEN 'T4' WHEN search_ops >= 3 AND files_read >= 5 THEN 'T4' WHEN error_signals >= 1 OR files_read >= 2 OR search_ops >= 1 THEN 'T2' ELSE 'T1' END AS tier, count(*) AS requests FROM sig GROUP BY 1""")
def suggested_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by signals; the tables hold no test commands, so no repair rounds: ``trace_examples`` has the rest."""
    return traces.suggest_tier(traces.trace_signals(table(spark, d, "messages"))).groupBy("tier").agg(F.count("*").alias("requests"))


@_query("""WITH f AS (SELECT doc_id AS case_id, substr(sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || '|'), 1, 16) AS fingerprint, source FROM documents)
  SELECT case_id, fingerprint, fingerprint IN (SELECT fingerprint FROM f WHERE source <> 'issue') AND source <> 'issue' AS reusable FROM f""")
def reuse_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), text.task_fingerprint(F.col("text")).alias("fingerprint"), "source")
    return calibration.reuse_plan(docs.select("case_id", "fingerprint"), docs.where("source <> 'issue'"))


@_query("""WITH f AS (SELECT doc_id, source, substr(sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || '|'), 1, 16) AS fingerprint FROM documents)
  SELECT doc_id, source, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS rn FROM f) WHERE rn = 1""")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", text.task_fingerprint(F.col("text")).alias("fingerprint"))
    return outcomes.first_wins(docs, ["fingerprint"], ["doc_id"]).select("doc_id", "source", "fingerprint")


@_query("""WITH l AS (SELECT fv_id, trim(unnest(string_split(replace(coalesce(pre, ''), chr(13), ''), chr(10))), ' ') AS line FROM (SELECT DISTINCT fv_id, pre FROM file_versions)),
  p AS (SELECT DISTINCT trim(unnest(string_split(replace(coalesce(content, ''), chr(13), ''), chr(10))), ' ') AS line FROM file_blobs),
  g AS (SELECT fv_id, count(*) AS lines, count(p.line) AS shared FROM l LEFT JOIN p USING (line) WHERE length(l.line) > 25 GROUP BY 1)
  SELECT fv_id, coalesce(lines, 0) AS lines, coalesce(shared, 0) AS shared, round(coalesce(shared::DOUBLE/lines, 0), 6) AS share FROM (SELECT DISTINCT fv_id FROM file_versions) LEFT JOIN g USING (fv_id)""")
def verbatim_share(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_versions").select("fv_id", "pre").distinct()
    return _round(text.verbatim_share(files, "fv_id", "pre", table(spark, d, "file_blobs"), "content"), "share")


@_query("""SELECT split, n, substr(sha256(array_to_string(list_sort(l), chr(10))), 1, 16) AS fingerprint FROM (SELECT coalesce(split, '~') AS split, count(*) AS n, list(case_id || ':' || coalesce(prompt, '')) AS l FROM (SELECT DISTINCT case_id, split, prompt FROM cases) GROUP BY 1)""")
def set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").select("case_id", F.coalesce("split", F.lit("~")).alias("split"), "prompt").distinct()
    return text.set_fingerprint(c, "split", "case_id", "prompt")


@_query("""WITH h AS (SELECT source, sha256(CAST(doc_id AS VARCHAR) || ':' || coalesce(title, '')) AS x FROM documents), s AS (SELECT source, count(*) AS n, sum(CAST(('0x' || substr(x, 1, 12)) AS BIGINT)) AS s, sum(CAST(('0x' || substr(x, 13, 12)) AS BIGINT)) AS t FROM h GROUP BY 1)
  SELECT source, n, substr(sha256(n || ':' || s || ':' || t), 1, 16) AS digest FROM s""")
def set_digest(spark: SparkSession, d: str) -> DataFrame:
    return text.set_digest(table(spark, d, "documents"), "source", "doc_id", "title")


@_query("""WITH k AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM cases))
  SELECT h.case_id AS host, d.case_id AS donor, CAST(j AS INT) AS place FROM k h, range(1, 4) r(j), k d WHERE d.i = (h.i + j) % h.n""")
def rotation_compose(spark: SparkSession, d: str) -> DataFrame:
    return text.rotation_compose(table(spark, d, "cases"), "case_id", 3)


@_query("""WITH f AS (SELECT DISTINCT fv_id, pre, post FROM file_versions), b AS (SELECT fv_id, md5(pre) AS v FROM f WHERE pre IS NOT NULL), a AS (SELECT fv_id, md5(post) AS v FROM f WHERE post IS NOT NULL)
  SELECT fv_id, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (fv_id) WHERE b.v IS DISTINCT FROM a.v""")
def table_difference(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_versions").select("fv_id", "pre", "post").distinct()
    return compare.table_difference(f.where("pre is not null").select("fv_id", F.md5("pre").alias("v")), f.where("post is not null").select("fv_id", F.md5("post").alias("v")), "fv_id", "v")


@_query(r"""WITH c AS (SELECT DISTINCT case_id, lower(coalesce(prompt, '')) AS p FROM cases) SELECT CASE WHEN regexp_matches(p, '修复|bug|fix|报错|error|崩溃') THEN 'bugfix' WHEN regexp_matches(p, '重构|refactor|清理') THEN 'refactor'
  WHEN regexp_matches(p, '测试|test|pytest|单元测试') THEN 'test_gen' WHEN regexp_matches(p, '解释|总结|说明|设计方案') THEN 'explain_to_edit' ELSE 'feature' END AS task, count(*) AS n FROM c GROUP BY 1""")
def task_types(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").select("case_id", "prompt").distinct()
    return c.groupBy(text.guess_task_type(F.col("prompt")).alias("task")).agg(F.count("*").alias("n"))


@_query(r"""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)```[^\n]*\n(.*?)```', 1)) AS b FROM documents) SELECT doc_id, count(*) AS blocks, max(length(b)) AS longest FROM b WHERE length(trim(b, ' ')) >= 20 GROUP BY 1""")
def fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select("doc_id", F.explode(text.code_blocks(F.col("text"))).alias("b"))
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max(F.length("b")).cast("long").alias("longest"))


@_query("""SELECT case_id, coalesce(CAST(r.ok AS VARCHAR), 'none') AS ok, r.difficulty AS difficulty, r.fingerprint AS fingerprint FROM (SELECT case_id, arg_max(struct_pack(ok := ok, difficulty := difficulty, fingerprint := fingerprint), (audited_at, coalesce(fingerprint, ''))) AS r FROM validity_reports GROUP BY 1)""")
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "validity_reports").select("case_id", "ok", "difficulty", "fingerprint", "audited_at", F.coalesce("fingerprint", F.lit("")).alias("tie"))
    return outcomes.last_wins(rows, ["case_id"], ["audited_at", "tie"]).select("case_id", F.coalesce(F.col("ok").cast("string"), F.lit("none")).alias("ok"), "difficulty", "fingerprint")


@_query("""SELECT CASE lower(regexp_replace(split, '\\s', '', 'g')) WHEN 'train' THEN 'train' WHEN 'dev' THEN 'eval' WHEN 'test' THEN 'eval' WHEN 'holdout' THEN 'eval' ELSE 'none' END AS side, count(DISTINCT case_id) AS cases FROM cases GROUP BY 1""")
def split_sides(spark: SparkSession, d: str) -> DataFrame:
    side = F.coalesce(records.split_side(F.col("split")), F.lit("none"))
    return table(spark, d, "cases").groupBy(side.alias("side")).agg(F.count_distinct("case_id").alias("cases"))


@_query("""WITH s AS (SELECT DISTINCT ON (session_id) session_id, messages FROM sessions), m AS (SELECT session_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS pos FROM s),
  u AS (SELECT session_id, pos, m.content AS content FROM m WHERE lower(trim(m.role)) IN ('user', 'human') AND length(m.content) >= 4)
  SELECT session_id, count(*) AS turns, arg_min(content, pos) AS first_prompt, arg_max(content, pos) AS last_prompt FROM u GROUP BY 1""")
def session_prompts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select("session_id", "messages").dropDuplicates(["session_id"])
    m = s.select("session_id", F.posexplode("messages").alias("pos", "m")).where("lower(trim(m.role)) in ('user', 'human') and length(m.content) >= 4")
    return m.groupBy("session_id").agg(F.count("*").alias("turns"), F.min_by("m.content", "pos").alias("first_prompt"), F.max_by("m.content", "pos").alias("last_prompt"))


@_query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@_query("""SELECT n_nationkey, round(coalesce((SELECT sum(exp(lgamma(26.0) - lgamma(k + 1.0) - lgamma(25 - k + 1.0) - 25 * ln(2.0))) FROM range(n_nationkey, 26) t(k)), 0), 6) AS tail FROM nation""")
def binomial_tails(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.round(stats.binomial_tail(F.col("n_nationkey"), F.lit(25)), 6).alias("tail"))


@_query()
def edit_line_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Line differences of every edit pair; SQL has no line diff."""
    f = table(spark, d, "file_versions").select("fv_id", "pre", "post").distinct()
    return f.select("fv_id", text.line_delta("pre", "post").alias("x")).select("fv_id", "x.*")


@_query()
def replayed_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edit pairs rebuilt from the messages of every trace; an ordered state machine."""
    return traces.replay_edits(table(spark, d, "messages"))


@_query("""WITH c AS (SELECT DISTINCT ON (request_id) request_id, full_history FROM chat_records WHERE json_valid(full_history)), m AS (SELECT request_id, unnest(CAST(full_history AS JSON[])) AS m FROM c WHERE json_type(full_history) = 'ARRAY'),
  t AS (SELECT request_id, m->>'$.role' AS role, CASE json_type(m, '$.content') WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(m->'$.content' AS JSON[]), lambda x: coalesce(x->>'$.text', '')), chr(10)) WHEN 'VARCHAR' THEN m->>'$.content' ELSE '' END AS content FROM m)
  SELECT request_id, count(*) AS messages, count(*) FILTER (role IN ('user', 'human')) AS user_messages, CAST(sum(length(content)) AS BIGINT) AS chars, md5(string_agg(md5(content), ',' ORDER BY md5(content))) AS digest FROM t GROUP BY 1""")
def history_messages(spark: SparkSession, d: str) -> DataFrame:
    m = records.normalized_messages(table(spark, d, "chat_records").dropDuplicates(["request_id"]))
    digest = F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("content"))), ","))
    return m.groupBy("request_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role").isin("user", "human")).alias("user_messages"), F.sum(F.length("content")).alias("chars"), digest.alias("digest"))


@_query("""SELECT CASE WHEN contains(lower(coalesce(requests_tags, '')), 'opencode') THEN 'opencode' ELSE 'none' END AS agent, count(DISTINCT request_id) AS requests FROM chat_records GROUP BY 1""")
def user_agents(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no `User-Agent:` header; ``record_examples`` has some."""
    agent = F.coalesce(records.user_agent(F.col("requests_tags")), F.lit("none"))
    return table(spark, d, "chat_records").groupBy(agent.alias("agent")).agg(F.count_distinct("request_id").alias("requests"))


@_query("""WITH m AS (SELECT DISTINCT ON (msg_id) msg_id, tool_calls FROM messages WHERE tool_calls IS NOT NULL), t AS (SELECT msg_id, unnest(tool_calls)."function".name AS tool FROM m) SELECT tool, count(*) AS calls, count(DISTINCT msg_id) AS messages FROM t WHERE tool <> '' GROUP BY 1""")
def offered_tools(spark: SparkSession, d: str) -> DataFrame:
    """Names read from the JSON form of every message's calls."""
    t = table(spark, d, "messages").select("msg_id", F.to_json("tool_calls").alias("tools")).dropDuplicates(["msg_id"])
    t = t.select("msg_id", F.explode(records.tool_names(F.col("tools"))).alias("tool"))
    return t.groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("msg_id").alias("messages"))


@_query(r"""WITH f AS (SELECT DISTINCT blob_id, path, regexp_extract(path, '[^/\\]*$') AS name FROM file_blobs), g AS (SELECT *, lower(regexp_extract(name, '\.([A-Za-z]+)$', 1)) AS s FROM f)
  SELECT CASE WHEN s IN ('py', 'pyi') THEN 'python' WHEN s IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN s IN ('ts', 'tsx') THEN 'typescript' WHEN s IN ('json', 'toml') THEN s WHEN s = 'md' THEN 'markdown' WHEN s IN ('yaml', 'yml') THEN 'yaml' ELSE 'other' END AS language,
  regexp_matches(lower(name), '^test_.*\.pyi?$|_test\.pyi?$|\.(test|spec)\.[mc]?[jt]sx?$') OR regexp_matches(lower(path), '(^|[/\\])(tests?|__tests__)[/\\]') AS is_test, count(*) AS files FROM g GROUP BY 1, 2""")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_blobs").select("blob_id", "path").distinct()
    return f.groupBy(records.language_of(F.col("path")).alias("language"), records.is_test_path(F.col("path")).alias("is_test")).agg(F.count("*").alias("files"))


@_query(r"""SELECT DISTINCT fv_id, regexp_extract(path, '[^/\\]*$') || '#' || substr(sha256(path), 1, 12) AS path FROM file_versions""")
def redacted_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_versions").select("fv_id", records.redacted_path(F.col("path")).alias("path")).distinct()


@_query("""SELECT count(*) AS ids, count(*) FILTER (regexp_matches(case_id, '^[A-Za-z0-9._-]{1,128}$') AND NOT regexp_matches(case_id, '^\\.+$')) AS safe FROM (SELECT DISTINCT case_id FROM cases)""")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "cases").select("case_id").distinct()
    return ids.agg(F.count("*").alias("ids"), F.count_if(records.is_safe_id(F.col("case_id"))).alias("safe"))


@_query(r"""WITH m AS (SELECT DISTINCT msg_id, client, content FROM messages WHERE regexp_matches(content, '[0-9]{1,9} passed')), c AS (SELECT client, list_max(CAST(regexp_extract_all(content, '(\d{1,9}) passed', 1) AS INT[])) AS p, coalesce(list_max(CAST(regexp_extract_all(content, '(\d{1,9}) failed', 1) AS INT[])), 0) AS f FROM m)
  SELECT client, count(*) AS runs, CAST(sum(p) AS BIGINT) AS passed, CAST(sum(f) AS BIGINT) AS failed, round(sum(p)::DOUBLE / nullif(sum(p) + sum(f), 0), 6) AS ratio FROM c GROUP BY 1""")
def runner_ratios(spark: SparkSession, d: str) -> DataFrame:
    p, f = records.runner_counts(F.col("content"))
    m = table(spark, d, "messages").select("msg_id", "client", "content").where("content rlike '[0-9]{1,9} passed'").distinct().select("client", p.alias("p"), f.alias("f"))
    out = m.groupBy("client").agg(F.count("*").alias("runs"), F.sum("p").alias("passed"), F.sum("f").alias("failed"))
    return _round(out.withColumn("ratio", F.try_divide("passed", F.col("passed") + F.col("failed"))), "ratio")


@_query("SELECT DISTINCT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM validity_reports WHERE case_id IS NOT NULL)")
def unaudited_cases(spark: SparkSession, d: str) -> DataFrame:
    return records.uncovered(table(spark, d, "cases"), table(spark, d, "validity_reports"), "case_id")


@_query("SELECT case_id, count(DISTINCT coalesce(fingerprint, '') || '|' || coalesce(tier, '~') || '|' || CAST(audited_at AS VARCHAR)) AS versions FROM validity_reports GROUP BY 1 HAVING count(DISTINCT coalesce(fingerprint, '') || '|' || coalesce(tier, '~') || '|' || CAST(audited_at AS VARCHAR)) > 1")
def repeated_reports(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "validity_reports").select("case_id", F.coalesce("fingerprint", F.lit("")).alias("f"), F.coalesce("tier", F.lit("~")).alias("t"), "audited_at")
    return records.conflicting_ids(v, "case_id", ["f", "t", "audited_at"])


@_query("""WITH f AS (SELECT DISTINCT blob_id, case_id, length(content) AS n FROM file_blobs WHERE content IS NOT NULL) SELECT a.blob_id, arg_min(b.blob_id, (abs(a.n - b.n), b.blob_id)) AS nearest, CAST(min(abs(a.n - b.n)) AS INT) AS difference FROM f a JOIN f b ON a.case_id = b.case_id AND a.blob_id <> b.blob_id GROUP BY 1""")
def nearest_files(spark: SparkSession, d: str) -> DataFrame:
    return records.nearest_by_size(table(spark, d, "file_blobs"), "case_id", "blob_id", "content")


@_query("""WITH f AS (SELECT DISTINCT case_id, role, path, content FROM file_blobs WHERE role IN ('impl', 'spec')), p AS (SELECT case_id, role, list_sort(list(struct_pack(path := coalesce(path, ''), content := coalesce(content, '')))) AS l FROM f GROUP BY 1, 2),
  j AS (SELECT case_id, role, '[' || array_to_string(list_transform(l, lambda x: '[' || CAST(to_json(x.path) AS VARCHAR) || ', ' || CAST(to_json(x.content) AS VARCHAR) || ']'), ', ') || ']' AS t FROM p),
  k AS (SELECT a.case_id, substr(sha256('[' || a.t || ', ' || b.t || ']'), 1, 16) AS solution_key FROM j a JOIN j b ON a.case_id = b.case_id AND a.role = 'impl' AND b.role = 'spec')
  SELECT coalesce(solution_key, 'none') AS solution_key, count(*) AS cases, min(c.case_id) AS first_case FROM (SELECT DISTINCT case_id FROM file_blobs) c LEFT JOIN k USING (case_id) GROUP BY 1""")
def solution_keys(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no gold files; files of role spec stand for them."""
    f = table(spark, d, "file_blobs").select("case_id", "role", "path", "content").distinct()
    side = lambda role: F.filter(F.collect_list(F.struct("role", "path", "content")), lambda x: x["role"] == role)
    keys = f.groupBy("case_id").agg(side("impl").alias("impl"), side("spec").alias("gold")).select("case_id", F.coalesce(text.solution_key(F.col("impl"), F.col("gold")), F.lit("none")).alias("solution_key"))
    return keys.groupBy("solution_key").agg(F.count("*").alias("cases"), F.min("case_id").alias("first_case"))


@_query("""WITH o AS (SELECT l_returnflag AS anchor, count(*) FILTER (l_tax > 0.075) AS dropped FROM lineitem GROUP BY 1) SELECT * FROM o WHERE dropped > 0""")
def dropped_by_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _calibration_rows(spark, d).groupBy("anchor").agg(F.count_if("infra_error").alias("dropped")).where("dropped > 0")


@_query("""WITH f AS (SELECT DISTINCT fv_id, pre_origin, pre, post FROM file_versions) SELECT coalesce(pre_origin, 'none') AS origin, count(*) AS pairs, count(DISTINCT CASE WHEN pre IS NOT NULL AND post IS NOT NULL AND pre <> post THEN md5(pre) || md5(post) END) AS usable FROM f GROUP BY 1""")
def pair_pool(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_versions").select("fv_id", "pre_origin", "pre", "post").distinct()
    usable = F.when(F.col("pre") != F.col("post"), F.concat(F.md5("pre"), F.md5("post")))
    return f.groupBy(F.coalesce("pre_origin", F.lit("none")).alias("origin")).agg(F.count("*").alias("pairs"), F.count_distinct(usable).alias("usable"))


@_query("""WITH k AS (SELECT DISTINCT case_id, unnest(grader.key_lines) AS line FROM cases), f AS (SELECT DISTINCT case_id, blob_id, content FROM file_blobs WHERE role <> 'spec' AND content IS NOT NULL)
  SELECT case_id, count(DISTINCT trim(line)) AS lines, count(DISTINCT blob_id) AS files FROM k JOIN f USING (case_id) WHERE length(trim(line)) >= 8 AND contains(content, trim(line)) GROUP BY 1""")
def leaked_key_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose graded key lines stand in a file that the solver sees; files and lines meet on the case, not pairwise."""
    k = table(spark, d, "cases").select("case_id", F.explode("grader.key_lines").alias("line")).distinct().withColumn("line", F.trim("line")).where("length(line) >= 8")
    f = table(spark, d, "file_blobs").where("role <> 'spec' and content is not null").select("case_id", "blob_id", "content").distinct()
    hits = k.join(f, "case_id").where(F.col("content").contains(F.col("line")))
    return hits.groupBy("case_id").agg(F.count_distinct("line").alias("lines"), F.count_distinct("blob_id").alias("files"))


@_query(r"""WITH f AS (SELECT DISTINCT blob_id, content FROM file_blobs WHERE content IS NOT NULL), h AS (SELECT regexp_matches(content, '(?im)^[ \t]*(?:#|//|/\*|\*)[ \t]*(?:BUG|FIXME|XXX|HACK|WRONG|INCORRECT)\b') AS marked, regexp_matches(content, '(?im)^[ \t]*(?:#|//|/\*|\*)[ \t]*TODO\b') AS todo FROM f) SELECT marked, marked OR todo AS with_todo, count(*) AS files FROM h GROUP BY 1, 2""")
def bug_markers(spark: SparkSession, d: str) -> DataFrame:
    """Files with defect comments, and with open tasks too; ``marker_examples`` has files that hold some."""
    f = table(spark, d, "file_blobs").where("content is not null").select("blob_id", "content").distinct()
    return f.groupBy(gates.has_bug_marker(F.col("content")).alias("marked"), gates.has_bug_marker(F.col("content"), True).alias("with_todo")).agg(F.count("*").alias("files"))


@_query()
def blind_features(spark: SparkSession, d: str) -> DataFrame:
    """How well length and spaces tell advanced from basic samples; exact resampling has no SQL."""
    rows = table(spark, d, "level_samples").where("band in ('basic', 'advanced')")
    each = F.explode(F.array(F.struct(F.lit("chars").alias("feature"), F.length("text").alias("value")), F.struct(F.lit("words").alias("feature"), F.size(F.split("text", " ")).alias("value")))).alias("x")
    return blind.blind_features(rows.select("sample_id", "band", each).select("x.feature", F.col("sample_id").alias("pair"), "x.value", (F.col("band") == "advanced").alias("label")))
