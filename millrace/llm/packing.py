"""Best-fit filling of fixed-capacity containers, by size class in bulk-synchronous steps.

Sizes are whole numbers up to the capacity, so range-sorted documents and range-sorted gaps fall into at
most ``capacity + 1`` classes each. A superstep takes the next smaller document class and sweeps it along the
gap classes: every document goes to its successor, the least gap that holds it. Several documents that
want the same gap are told apart by their rank in the class, one to a container; the gaps they leave are
put back in order and the sweep repeats until the class is placed. What finds no gap opens containers.

Only class counts (partitions x classes numbers) reach the driver, whatever the number of documents. The steps
give ranges of ranks, and every document reads its container off its own rank where it lies.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

CAPACITY = 2048


def best_fit(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``counts[s]`` documents of size s, all at most ``capacity``.

    Returns ``(size, first rank, first container, length)`` ranges and the number of containers. Documents of
    size 0 take container 0.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gap classes in use, ascending
    out: list[tuple[int, int, int, int]] = []
    used = 0

    def put(gap: int, first: int, length: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, length))

    for size in range(capacity, 0, -1):
        rank, left = 0, int(counts[size])
        while left:
            i = bisect.bisect_left(order, size)
            if i == len(order):
                # Containers filled with as many documents of this class as they hold: those gaps are all alike.
                put(capacity - size, used, left if capacity // size == 1 else -(-left // (capacity // size)))
                n = gaps[capacity - size][-1][1]
                out.append((size, rank, used, n))
                used, rank, left = used + n, rank + n, left - n
                continue
            gap = order[i]
            first, length = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                del order[i]
            take = min(left, length)
            if take < length:
                put(gap, first + take, length - take)
            out.append((size, rank, first, take))
            if gap > size:
                put(gap - size, first, take)
            rank, left = rank + take, left - take
    if counts[0]:
        out.append((0, 0, 0, -1))
        used = max(used, 1)
    return out, used


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``(id_col, piece, tokens, container)``: every document, or piece of a document over capacity.

    A document of more than ``capacity`` tokens is cut into full containers of its own and a rest that is
    placed like any document; all others stay whole. Rows with null size count as size 0; size 0 goes to
    container 0; repeated rows are placed separately. The result depends on sizes and ids only, except among
    rows equal in both.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    rows = sizes.select(F.col(id_col).alias("id"), size.alias("size"))
    full = F.floor((F.greatest("size", F.lit(1)) - 1) / capacity).cast("int")
    pieces = rows.select("id", F.explode(F.sequence(F.lit(0), full)).alias("piece"), "size")
    pieces = pieces.select("id", "piece", F.least(F.col("size") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    # Range partitioning samples its input first; sizes are kept so that no text is encoded twice for it.
    ranged = materialize(pieces, "sizes").repartitionByRange(F.col("tokens").desc(), F.col("id"), F.col("piece")).sortWithinPartitions(F.col("tokens").desc(), "id", "piece")
    placed = materialize(ranged.withColumn("part", F.spark_partition_id()), "pack")
    table = placed.groupBy("part", "tokens").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, table["tokens"].to_numpy(), table["n"].to_numpy())
    ranges, _ = best_fit(counts, capacity)
    # Ranks of a partition's rows of a class begin after the rows of that class in earlier partitions.
    table = table.sort_values(["tokens", "part"])
    table["base"] = table.groupby("tokens")["n"].cumsum() - table["n"]
    base = {(p, t): b for p, t, b in zip(table["part"].tolist(), table["tokens"].tolist(), table["base"].tolist())}
    by_size: dict[int, tuple[list[int], list[int]]] = {}
    for s, rank, container, _n in ranges:
        by_size.setdefault(s, ([], []))[0].append(rank)
        by_size[s][1].append(container)
    plan = placed.sparkSession.sparkContext.broadcast((base, {s: (np.array(a), np.array(b)) for s, (a, b) in by_size.items()}))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, where = plan.value
        seen: dict[tuple[int, int], int] = {}
        for batch in it:
            part, tokens = batch.column(3).to_numpy(), batch.column(2).to_numpy()
            key = part.astype(np.int64) * (capacity + 1) + tokens
            target = np.zeros(len(key), np.int64)
            for k in np.unique(key):
                mine = np.flatnonzero(key == k)
                p, t = int(k) // (capacity + 1), int(k) % (capacity + 1)
                at = seen.get((p, t), start[p, t])
                seen[p, t] = at + len(mine)
                if t:
                    rank = at + np.arange(len(mine))
                    heads, container = where[t]
                    i = np.searchsorted(heads, rank, side="right") - 1
                    target[mine] = container[i] + rank - heads[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(target)], names=[id_col, "piece", "tokens", "container"])

    # One file of a written partition must be read by one task in order for ranks to be unique.
    keyed = placed.repartition(F.col("part")).sortWithinPartitions("part", F.col("tokens").desc(), "id", "piece")
    return keyed.mapInArrow(assign, f"`{id_col}` {kind}, piece int, tokens int, container long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, and the unused share."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    return each.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("least_containers"),
        F.max("t").alias("fullest"),
        (1 - F.sum("t") / (F.count("*") * capacity)).alias("unused_share"),
    )
