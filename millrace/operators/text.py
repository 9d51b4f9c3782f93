"""Row-wise text operators and line-level overlap."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of up to this many characters are too common to count as overlap.
MIN_LINE = 25


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def task_fingerprint(text: Column, paths: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-256 of the stripped text, a bar and the sorted paths joined by commas; null is empty."""
    names = F.array_join(F.array_sort(paths), ",") if paths is not None else F.lit("")
    return F.substring(F.sha2(F.concat(strip(F.coalesce(text, F.lit(""))), F.lit("|"), F.coalesce(names, F.lit(""))), 256), 1, 16)


def set_fingerprint(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``(group, n, fingerprint)``: first 16 hex digits of the SHA-256 over the sorted ``key:value`` lines of a case set.

    A case set is bounded (it is run by hand); its lines are gathered. For groups of any size use ``set_digest``.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.coalesce(F.col(value).cast("string"), F.lit("")))
    rows = df.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("x"))
    return rows.select(group, "n", F.substring(F.sha2(F.array_join("x", "\n"), 256), 1, 16).alias("fingerprint"))


def set_digest(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``(group, n, digest)``: an order-free digest of a group's ``key:value`` lines for groups of any size.

    Lines are hashed where they lie and added as numbers, so no group is gathered in one place.
    """
    h = lambda a, b: F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(""))), 256), a, b), 16, 10).cast("decimal(20,0)")
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(h(1, 12)).alias("s"), F.sum(h(13, 12)).alias("t"))
    mark = F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("t").cast("string"))
    return out.select(group, "n", F.substring(F.sha2(mark, 256), 1, 16).alias("digest"))


def solution_key(impl: Column, gold: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted (path, content) pairs of both sides; null if either has none.

    ``impl`` and ``gold`` are arrays of structs with path and content; the basis is the JSON text ``[[[path, content], …], …]``
    with a blank after each comma and escapes as JSON demands.
    """
    text = lambda c: F.regexp_replace(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'^\{"v":|\}$', "")
    side = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(xs, lambda f: F.struct(F.coalesce(f["path"], F.lit("")).alias("path"), F.coalesce(f["content"], F.lit("")).alias("content")))), lambda f: F.concat(F.lit("["), text(f["path"]), F.lit(", "), text(f["content"]), F.lit("]"))), ", "), F.lit("]"))
    return F.when((F.size(impl) > 0) & (F.size(gold) > 0), F.substring(F.sha2(F.concat(F.lit("["), side(impl), F.lit(", "), side(gold), F.lit("]")), 256), 1, 16))


def code_blocks(text: Column) -> Column:
    """Fenced blocks with at least 20 characters."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    return F.filter(found, lambda b: F.length(F.trim(b)) >= 20)


# Words of a prompt by task type, looked for in this order.
TASK_WORDS = [
    ("bugfix", ["修复", "bug", "fix", "报错", "error", "崩溃"]),
    ("refactor", ["重构", "refactor", "清理"]),
    ("test_gen", ["测试", "test", "pytest", "单元测试"]),
    ("explain_to_edit", ["解释", "总结", "说明", "设计方案"]),
]


def guess_task_type(prompt: Column) -> Column:
    """The first task type of which the prompt contains a word, in any case; else feature."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    return F.coalesce(*[F.when(p.rlike("|".join(words)), name) for name, words in TASK_WORDS], F.lit("feature"))


def lines(df: DataFrame, key: str, text: str, min_line: int = MIN_LINE) -> DataFrame:
    """``(key, line)``: stripped lines longer than ``min_line``, repeats kept."""
    each = df.select(key, F.explode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n")).alias("line"))
    return each.select(key, F.trim("line").alias("line")).where(F.length("line") > min_line)


def verbatim_share(df: DataFrame, key: str, text: str, pool: DataFrame, pool_text: str) -> DataFrame:
    """``(key, lines, shared, share)``: share of a text's lines found in any text of the pool; 0 without lines."""
    known = lines(pool.withColumn("_k", F.lit(0)), "_k", pool_text).select(F.xxhash64("line").alias("h"), F.lit(1).alias("known")).distinct()
    mine = lines(df, key, text).groupBy(key, F.xxhash64("line").alias("h")).agg(F.count("*").alias("n"))
    hits = mine.join(known, "h", "left").groupBy(key).agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("shared"))
    out = df.select(key).distinct().join(hits, key, "left").na.fill(0, ["lines", "shared"])
    return out.withColumn("share", F.coalesce(F.try_divide("shared", "lines"), F.lit(0.0)))


_DELTA = T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("ratio", T.DoubleType())])


@F.pandas_udf(_DELTA)
def line_delta(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Added and removed lines of a line diff, and the share of matched lines; null counts as empty.

    Equal lines at both ends are set aside first, so that small edits of long files stay cheap.
    """
    rows = []
    for a, b in zip(before, after):
        x, y = (a or "").split("\n"), (b or "").split("\n")
        n = min(len(x), len(y))
        head = next((i for i in range(n) if x[i] != y[i]), n)
        tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
        m = difflib.SequenceMatcher(None, x[head : len(x) - tail], y[head : len(y) - tail], autojunk=False)
        same = head + tail + sum(k for *_, k in m.get_matching_blocks())
        rows.append((len(y) - same, len(x) - same, 2.0 * same / (len(x) + len(y))))
    return pd.DataFrame(rows, columns=["added", "removed", "ratio"])


def rotation_compose(items: DataFrame, key: str, donors: int) -> DataFrame:
    """``(host, donor, place)``: the ``donors`` items after each in key order, round the end, never itself.

    Places come from a range sort with per-partition offsets; the join is on equal places.
    """
    spark = items.sparkSession
    ranged = items.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    rows = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id() % (1 << 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("c")).orderBy("_p").collect()
    starts, n = [], 0
    for r in sizes:
        starts.append((r["_p"], n))
        n += r["c"]
    if n < 2:
        return spark.createDataFrame([], "host string, donor string, place int")
    base = spark.createDataFrame(starts, "_p int, _s long")
    placed = rows.join(F.broadcast(base), "_p").select(F.col(key).alias("k"), (F.col("_s") + F.col("_m")).alias("i"))
    steps = F.explode(F.array(*[F.lit(j) for j in range(1, min(donors, n - 1) + 1)])).alias("place")
    wanted = placed.select(F.col("k").alias("host"), "i", steps).withColumn("i", (F.col("i") + F.col("place")) % n)
    return wanted.join(placed, "i").select("host", F.col("k").alias("donor"), "place")
