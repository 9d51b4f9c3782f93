"""Rebuilding chats from message rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

# The spellings of each speaker.
SPEAKERS = {
    "user": ["user", "human"],
    "assistant": ["assistant", "ai", "model"],
    "tool": ["tool", "function"],
    "system": ["system", "developer"],
}
#: Rows sent longer than this before the record's start belong to an earlier use of the id.
STALE_SECONDS = 3600
#: A sender's clock is moved only if its offset is this large and this many standard errors from zero.
MIN_OFFSET_SECONDS, MIN_SIGMAS = 60.0, 5.0

_CALLS = "array<struct<function:struct<name:string,arguments:string>>>"


def speaker(role: Column) -> Column:
    """One of the four speakers, or null for a null or unknown role."""
    name = F.lower(F.trim(F.regexp_replace(role, r"^\s+|\s+$", "")))
    out = None
    for who, names in SPEAKERS.items():
        hit = name.isin(*names)
        out = F.when(hit, who) if out is None else out.when(hit, who)
    return out


def _text_key(content: Column, calls: Column) -> Column:
    body = F.concat_ws("\x1f", F.coalesce(content, F.lit("")), F.coalesce(F.to_json(F.when(F.size(calls) > 0, calls)), F.lit("")))
    return F.md5(body)


def clock_offsets(rows: DataFrame, every: bool = False) -> DataFrame:
    """``(client, speaker, offset)``: seconds by which a sender's clock runs ahead, by least squares; with ``every`` also
    ``error`` (one standard error), ``pairs`` and ``sure`` of all senders, not only of those sure enough.

    Every pair of neighbouring places ``(request_id, pos)`` gives a reply-before constraint. Its gap is modelled as a
    client's usual gap plus the difference of the two senders' offsets; per client the normal equations are built from
    partial sums and solved with offsets summing to zero. Offsets too small or too uncertain to reorder turns are left out.
    """
    w = Window.partitionBy("request_id").orderBy("pos")
    t = F.col("sent_at").cast("double")
    near = rows.where("pos is not null").select(
        "client", "speaker", "pos", t.alias("t"), F.lag("pos").over(w).alias("pos0"), F.lag("speaker").over(w).alias("speaker0"), F.lag(t).over(w).alias("t0"), F.lag("client").over(w).alias("client0")
    )
    near = near.where("pos = pos0 + 1 and client <=> client0 and t is not null and t0 is not null and speaker is not null and speaker0 is not null")
    sums = near.withColumn("gap", F.col("t") - F.col("t0")).groupBy("client", "speaker0", "speaker").agg(
        F.count("*").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q")
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["speaker"], *pdf["speaker0"]})
        at = {x: i for i, x in enumerate(names)}
        k = len(names)
        design = np.zeros((len(pdf), k + 1))
        design[:, k] = 1
        for r, (a, b) in enumerate(zip(pdf["speaker0"], pdf["speaker"])):
            design[r, at[b]] += 1
            design[r, at[a]] -= 1
        n, y = pdf["n"].to_numpy(float), (pdf["s"] / pdf["n"]).to_numpy(float)
        normal = design.T @ (design * n[:, None])
        normal[:k, :k] += 1  # offsets sum to zero; a lone sender stays at zero
        inverse = np.linalg.pinv(normal)
        beta = inverse @ (design.T @ (n * y))
        rest = max(float(pdf["q"].sum() - 2 * (n * y) @ (design @ beta) + n @ (design @ beta) ** 2), 0.0)
        error = np.sqrt(np.maximum(np.diag(inverse), 0) * rest / max(n.sum() - k - 1, 1))
        sure = [bool(abs(beta[i]) >= max(MIN_OFFSET_SECONDS, MIN_SIGMAS * error[i])) for i in range(k)]
        return pd.DataFrame({"client": [pdf["client"].iloc[0]] * k, "speaker": names, "offset": beta[:k], "error": error[:k], "pairs": int(n.sum()), "sure": sure})

    found = sums.groupBy("client").applyInPandas(solve, "client string, speaker string, offset double, error double, pairs long, sure boolean")
    return found if every else found.where("sure").select("client", "speaker", "offset")


def sender_clocks(messages: DataFrame) -> DataFrame:
    """``clock_offsets`` of every sender of a table of message rows; repeated rows count once."""
    rows = messages.where("request_id is not null").select("request_id", "msg_id", F.col("pos").cast("int").alias("pos"), speaker(F.col("role")).alias("speaker"), F.coalesce("client", F.lit("")).alias("client"), "sent_at")
    return clock_offsets(materialize(rows.dropDuplicates(["request_id", "msg_id"]), "clocks"), every=True)


def _history_items(text: str | None) -> list[tuple[int, str, list]]:
    try:
        items = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    out = []
    for i, m in enumerate(items if isinstance(items, list) else []):
        if not isinstance(m, dict):
            continue
        c = m.get("content")
        if isinstance(c, list):
            c = "\n".join(p if isinstance(p, str) else str(p.get("text") or "") for p in c if isinstance(p, (str, dict)))
        calls = []
        for call in m.get("tool_calls") or []:
            f = call.get("function") if isinstance(call, dict) else None
            if isinstance(f, dict):
                args = f.get("arguments")
                calls.append({"function": {"name": f.get("name"), "arguments": args if args is None or isinstance(args, str) else json.dumps(args)}})
        out.append((i, c if isinstance(c, str) else "", calls))
    return out


def history_places(records: DataFrame) -> DataFrame:
    """``(request_id, place, key)`` of every message in a valid JSON history."""
    kind = pa.list_(pa.struct([("function", pa.struct([("name", pa.string()), ("arguments", pa.string())]))]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(r, *x) for r, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in _history_items(h)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], kind)], names=["request_id", "place", "content", "calls"]
            )

    items = records.select("request_id", "full_history").mapInArrow(run, f"request_id string, place int, content string, calls {_CALLS}")
    return items.select("request_id", "place", _text_key(F.col("content"), F.col("calls")).alias("key"))


def rebuild(messages: DataFrame, records: DataFrame) -> DataFrame:
    """``(request_id, turn_no, msg_id, speaker)`` of every whole chat.

    Rows are slimmed to keys before anything is shuffled. A chat is left out if its reply-before constraints cannot
    hold: places with a hole or repeat, an unknown speaker, a row without content and calls, no user, or a user
    message without an assistant's reply before the next. Order is by ``pos``; without it by the corrected ``sent_at``,
    then by place in the history, then by ``msg_id``; rows without pos in a chat that has some come last. Rows of null
    request_id, and chats without a record, give nothing; repeated rows count once.
    """
    start = records.where("request_id is not null").groupBy("request_id").agg(F.min("start_time").alias("start_time"))
    slim = messages.where("request_id is not null").select(
        "request_id",
        "msg_id",
        F.col("pos").cast("int").alias("pos"),
        speaker(F.col("role")).alias("speaker"),
        F.coalesce("client", F.lit("")).alias("client"),
        "sent_at",
        _text_key(F.col("content"), F.col("tool_calls")).alias("key"),
        (F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False)) | F.coalesce(F.size("tool_calls") > 0, F.lit(False))).alias("full"),
    )
    rows = slim.join(start, "request_id").where(f"sent_at is null or start_time is null or sent_at >= start_time - interval {STALE_SECONDS} seconds")
    lone = F.when(F.col("pos").isNull(), F.col("msg_id"))
    rows = rows.groupBy("request_id", "pos", "speaker", "key", lone.alias("lone")).agg(
        F.min("msg_id").alias("msg_id"), F.min_by(F.struct("client", "sent_at", "full"), "msg_id").alias("first")
    ).select("request_id", "pos", "speaker", "key", "msg_id", "first.*")
    rows = materialize(rows, "chat")
    whole = rows.groupBy("request_id").agg(
        F.count("*").alias("n"),
        F.count("pos").alias("placed"),
        F.count_distinct("pos").alias("places"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.count("speaker").alias("known"),
        F.min("full").alias("full"),
        F.count_if(F.col("speaker") == "user").alias("users"),
    )
    whole = whole.where("known = n and full and users > 0 and places = placed and (placed = 0 or (lo = 0 and hi = placed - 1))")
    rows = rows.join(whole.select("request_id", (F.col("placed") == F.col("n")).alias("by_pos")), "request_id")
    offsets = clock_offsets(rows)
    rows = rows.join(F.broadcast(offsets) if offsets.count() < 10_000 else offsets, ["client", "speaker"], "left")
    moved = (F.col("sent_at").cast("double") * 1e6 - F.coalesce("offset", F.lit(0.0)) * 1e6).cast("long")
    rows = rows.withColumn("t", F.when(F.col("offset").isNull(), F.unix_micros("sent_at")).otherwise(moved)).drop("offset")
    placed = rows.where("by_pos").select("request_id", "msg_id", "speaker", F.col("pos").alias("turn_no"))
    loose = materialize(rows.where("not by_pos"), "loose")
    tied = loose.groupBy("request_id", "t").agg(F.count("*").alias("c")).where("c > 1").select("request_id").distinct()
    known = history_places(records.join(tied, "request_id", "left_semi").dropDuplicates(["request_id"]))
    nth = F.row_number()
    known = known.withColumn("k", nth.over(Window.partitionBy("request_id", "key").orderBy("place")))
    loose = loose.withColumn("k", nth.over(Window.partitionBy("request_id", "key").orderBy(F.col("t").asc_nulls_last(), "msg_id")))
    loose = loose.join(known, ["request_id", "key", "k"], "left")
    turn = nth.over(Window.partitionBy("request_id").orderBy(F.col("pos").asc_nulls_last(), F.col("t").asc_nulls_last(), F.col("place").asc_nulls_last(), "msg_id")) - 1
    turns = placed.unionByName(loose.select("request_id", "msg_id", "speaker", turn.alias("turn_no")))
    turns = materialize(turns, "turns")
    talk = turns.where("speaker in ('user', 'assistant')")
    after = F.lead("speaker").over(Window.partitionBy("request_id").orderBy("turn_no"))
    broken = talk.select("request_id", "speaker", after.alias("next")).where("speaker = 'user' and not (next <=> 'assistant')").select("request_id").distinct()
    return turns.join(broken, "request_id", "left_anti").select("request_id", F.col("turn_no").cast("int").alias("turn_no"), "msg_id", "speaker")
