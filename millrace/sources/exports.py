"""Readers of session exports, case sets, result logs and JDBC chat records; report writers."""

from __future__ import annotations

import os
import re
import tempfile
import urllib.parse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "session_id string, messages array<struct<role:string,content:string,timestamp:string,metadata:map<string,string>>>, created_at string, language_hints array<string>, artifacts array<struct<type:string,path:string,content:string,accepted:boolean>>, outcome map<string,string>, product string"
RESULT = "run_id string, case_id string, attempt int, anchor string, passed boolean, infra_error boolean, total_tokens long, wall_time_s double, failure_category string, detail string"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON export: one object with a list `sessions`, or rows of sessions. Missing arrays become empty."""
    wrapped = spark.read.schema(f"sessions array<struct<{_as_struct(SESSION)}>>, {SESSION}").json(path, multiLine=True)
    rows = wrapped.select(F.explode(F.when(F.col("sessions").isNotNull(), F.col("sessions")).otherwise(F.array(F.struct(*[F.col(c) for c in _names(SESSION)])))).alias("s")).select("s.*")
    for c in ("messages", "language_hints", "artifacts"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return rows.where("session_id is not null")


def _names(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names


def _as_struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON-lines results; a missing path is an empty table, bad lines are skipped, or empty their file if ``strict``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    # The file system of any URI answers; an unknown scheme is an error.
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], RESULT)
    rows = spark.read.schema(RESULT + ", _corrupt_record string").json(path).withColumn("_file", F.input_file_name())
    bad = F.col("_corrupt_record").isNotNull()
    if strict:
        # The count keeps a data column in the plan: Spark reads no file for its corrupt-record column alone.
        broken = rows.groupBy("_file").agg(F.bool_or(bad).alias("b"), F.count("case_id").alias("n")).where("b and n >= 0").select("_file")
        rows = rows.join(broken, "_file", "left_anti")
    return rows.where("_corrupt_record is null and case_id is not null").drop("_corrupt_record", "_file")


def jdbc_url(explicit: str | None = None, *, user: str | None = None, password: str | None = None, host: str = "localhost", port: int = 3306, database: str = "") -> str:
    """The URL given; else one made of its parts, quoted; else of MILLRACE_DB_URL or DATABASE_URL; else an error."""
    if explicit:
        return explicit
    if user:
        login = urllib.parse.quote(user, safe="") + (":" + urllib.parse.quote(password, safe="") if password else "")
        return f"jdbc:mysql://{login}@{host}:{port}/{urllib.parse.quote(database, safe='')}?characterEncoding=utf8"
    for name in ("MILLRACE_DB_URL", "DATABASE_URL"):
        if os.environ.get(name):
            return os.environ[name]
    raise ValueError("no database URL: give one, or set MILLRACE_DB_URL or DATABASE_URL")


def chat_record_filter(*, since: str | None = None, until: str | None = None, only_agent: str | None = None, require_edits: bool = False) -> str:
    """SQL of the predicates that the database evaluates: history there, half-open time range, agent named in the tags, edits in the history."""
    stamp = lambda s: f"timestamp '{datetime.fromisoformat(s).isoformat(sep=' ')}'"  # noqa: E731  refuses anything but a time
    quote = lambda s: s.replace("'", "''")
    parts = ["full_history is not null"]
    parts += [f"start_time >= {stamp(since)}"] * bool(since) + [f"start_time < {stamp(until)}"] * bool(until)
    parts += [f"requests_tags like '%{quote(only_agent or '')}%'"] * bool(only_agent) + ["full_history like '%\"name\": \"edit\"%'"] * require_edits
    return " and ".join(parts)


def newest_records(records: DataFrame, *, min_messages: int = 3, max_messages: int = 80, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records whose history has so many messages, newest first; ties by request_id, so that pages do not overlap."""
    rows = records.where(F.json_array_length("full_history").between(min_messages, max_messages)).orderBy(F.desc("start_time"), "request_id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def read_chat_records(spark: SparkSession, url: str, table: str, *, partitions: int = 1, bounds: tuple[str, str] | None = None, fetchsize: int = 100, min_messages: int = 3, max_messages: int = 80, offset: int = 0, limit: int | None = None, options: dict[str, str] | None = None, **where) -> DataFrame:
    """Chat records over JDBC; needs the driver's jar on the class path.

    Predicates of ``chat_record_filter`` are evaluated by the database; with ``bounds`` (two times) the read is split by
    start_time into ``partitions`` tasks. Message counts, order and paging follow in ``newest_records``.
    """
    source = f"(select * from {table} where {chat_record_filter(**where)}) t"
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, fetchsize=fetchsize, **(options or {}))
    if bounds:
        reader = reader.options(partitionColumn="start_time", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return newest_records(reader.load(), min_messages=min_messages, max_messages=max_messages, offset=offset, limit=limit)


CASE = "case_id string, schema_version string, task_type string, language string, prompt string, context struct<files:array<struct<path:string,content:string,role:string>>,notes:string>, grader struct<mode:string,command:string,match:string,key_lines:array<string>,gold_files:array<struct<path:string,content:string>>,hidden_tests:array<struct<path:string,content:string>>,protected_paths:array<string>,judge_rubric:string,judge_threshold:double>, metadata map<string,string>"


def read_cases(spark: SparkSession, directory: str, validate: bool = True) -> DataFrame:
    """The cases of a set, one JSON file each; names that begin with `_` are sidecars and are not read.

    ``file`` is the case's path. With ``validate`` a file that is no object of the schema is an error, as is an empty set.
    """
    rows = spark.read.schema(CASE + ", _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.json").json(directory).withColumn("file", F.col("_metadata.file_path"))
    if validate:
        # The count keeps a data column in the plan: Spark reads no file for its corrupt-record column alone.
        bad = rows.agg(F.min(F.when(F.col("_corrupt_record").isNotNull() | F.col("case_id").isNull(), F.col("file"))).alias("f"), F.count("case_id"), F.count("*").alias("n")).first()
        if bad["f"] is not None or not bad["n"]:
            raise ValueError(f"not a case: {bad['f']}" if bad["n"] else f"no cases in {directory}")
    return rows.where("_corrupt_record is null and case_id is not null").drop("_corrupt_record")


def read_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Result rows of every run below a directory (`<run>/results.jsonl` beside `<run>/manifest.json`), with the run's name and manifest text.

    A case that one run lists twice is an error, as is a directory without rows.
    """
    rows = spark.read.schema(RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", "results.jsonl").json(directory).withColumn("dir", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1))
    manifest = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("wholetext", True).text(directory).select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("dir"), F.col("value").alias("manifest"))
    out = rows.where("case_id is not null").join(manifest, "dir").withColumn("run", F.element_at(F.split("dir", "/"), -1)).drop("dir")
    found = out.groupBy("run", "case_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("rows"), F.min(F.when(F.col("n") > 1, F.col("case_id"))).alias("twice")).first()
    if not found["rows"]:
        raise ValueError(f"no runs in {directory}")
    if found["most"] > 1:
        raise ValueError(f"case {found['twice']} is listed twice in a run")
    return out


def case_set_dir(name: str, root: str, *, fixtures: str | None = None) -> str:
    """The directory of a case set: `fixture:` and `generated:` name its kind, else a generated set comes before a fixture.

    A generated set that hides a fixture of its name is refused where the kind is not named.
    """
    kind, _, rest = name.rpartition(":")
    if not re.fullmatch(r"[\w.-]+", rest) or kind not in ("", "fixture", "generated"):
        raise ValueError(f"not a case set's name: {name}")
    made, fixed = os.path.join(root, rest), os.path.join(fixtures, rest) if fixtures else None
    there = {"generated": os.path.isdir(made), "fixture": bool(fixed) and os.path.isdir(fixed)}
    if not kind and all(there.values()):
        raise ValueError(f"{rest} is both a generated set and a fixture: name its kind")
    kind = kind or next((k for k, v in there.items() if v), "")
    if not there.get(kind):
        raise FileNotFoundError(f"no case set {name} below {root}")
    return made if kind == "generated" else fixed


def _atomic(path: str, write) -> None:
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            write(f)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def _few(df: DataFrame, max_rows: int):
    rows = df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"a report holds at most {max_rows} rows")
    return rows


def write_report(df: DataFrame, path: str, max_rows: int = 10_000) -> int:
    """A small table as one file, put in place by renaming so that readers never see a part of it.

    The suffix tells the form: .csv, .json (a list, indented), .jsonl, .md (a table, `-` where unmeasured).
    """
    rows = _few(df, max_rows)
    kind = os.path.splitext(path)[1]
    if kind == ".json":
        _atomic(path, lambda f: f.write(rows.to_json(orient="records", force_ascii=False, indent=2)))
    elif kind == ".jsonl":
        _atomic(path, lambda f: f.write(rows.to_json(orient="records", force_ascii=False, lines=True)))
    elif kind == ".md":
        _atomic(path, lambda f: f.write(markdown(rows)))
    else:
        _atomic(path, lambda f: rows.to_csv(f, index=False))
    return len(rows)


def markdown(rows) -> str:
    """A table as Markdown; null shows as `-`, never as 0, and bars in cells are escaped."""
    cell = lambda v: "-" if v is None or v != v else ("yes" if v else "no") if isinstance(v, bool) else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [list(rows.columns), ["---"] * len(rows.columns), *([cell(v) for v in r] for r in rows.astype(object).itertuples(index=False))]
    return "".join("| " + " | ".join(r) + " |\n" for r in lines)


def render_report(title: str, sections: list[tuple[str, DataFrame]], path: str, max_rows: int = 1_000) -> None:
    """A Markdown report of small tables under headings; empty tables say so."""
    body = [f"# {title}\n"]
    for name, df in sections:
        rows = _few(df, max_rows)
        body.append(f"\n## {name}\n\n" + (markdown(rows) if len(rows) else "No rows.\n"))
    _atomic(path, lambda f: f.write("".join(body)))
