"""Exact and banded similarity linkage over word n-gram sets.

Both operators of this module (near-duplicate groups and cross-split overlap) share one scheme:

1. Texts become sets of n-gram hashes; equal sets share a fingerprint and are one node from then on.
2. Nodes are put into buckets: bands of a DartMinHash signature, or prefix n-grams. Two nodes that are
   alike share a bucket (prefix: always; bands: with a stated probability).
3. Within a bucket every node is compared with the bucket's least node only, so a hot bucket costs as many
   comparisons as it has rows. Links found this way give components.
4. Buckets that still hold more than one component have their cross-component pairs compared too. After
   that every pair of a bucket is either connected or was compared: nothing is lost to the shortcut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import dartminhash, shingles
from millrace.llm.components import connected_components
from millrace.session import materialize, release

#: Texts with fewer words are never compared; two texts are alike from this similarity on.
MIN_WORDS, THRESHOLD = 25, 0.6
#: 24 bands of 3 coordinates: two texts of similarity s share one with probability 1 - (1 - s^3)^24.
BANDS, BAND_ROWS = 24, 3
#: Counters of the n-gram frequency sketch (1 MB); they order prefixes and never decide a link.
SKETCH = 1 << 17
#: A banded bucket with more distinct nodes than this hands its nodes to the prefix buckets.
HOT_BUCKET = 64
#: Rows of a bucket that are paired in one block.
BLOCK = 256
#: Sets handled at once inside a worker.
_SETS = 512

_NODE = "field string, id string, words int, fp long, size int, grams array<int>"


def _salt(field: str) -> int:
    return int.from_bytes(field.encode()[:7], "little")


def _node_batches(it: Iterator[pa.RecordBatch], fields: list[str], n: int, min_words: int, with_bands: bool, n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids = batch.column(0)
        for f, field in enumerate(fields):
            keep_at: list[int] = []
            keep: list[np.ndarray] = []
            count: list[int] = []

            def flush():
                sizes = np.array([len(g) for g in keep])
                flat = np.concatenate(keep)
                salt = np.uint64(_salt(field))
                fps = [shingles.set_fingerprint(g ^ shingles.mix(np.array([salt]))[0]) for g in keep]
                short = [np.unique(g.astype(np.uint32)).view(np.int32) for g in keep]
                cols = [
                    pa.array([field] * len(keep)),
                    ids.take(pa.array(keep_at)),
                    pa.array(count, pa.int32()),
                    pa.array(fps, pa.int64()),
                    pa.array([len(g) for g in short], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(g) for g in short])], pa.int32()), pa.array(np.concatenate(short))),
                ]
                names = ["field", "id", "words", "fp", "size", "grams"]
                if with_bands:
                    b = dartminhash.bands(dartminhash.signatures(flat, sizes, n_bands * rows), rows, _salt(field))
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * n_bands, pa.int32()), pa.array(b.reshape(-1))))
                    names.append("bands")
                return pa.RecordBatch.from_arrays(cols, names=names)

            for row, words, grams in shingles.ngrams(batch.column(1 + f), n):
                if words >= min_words and len(grams):
                    keep_at.append(row)
                    keep.append(grams)
                    count.append(words)
                    if len(keep) == _SETS:
                        yield flush()
                        keep_at, keep, count = [], [], []
            if keep:
                yield flush()


def nodes(df: DataFrame, id_col: str, fields: dict[str, str], *, n: int = 3, min_words: int = MIN_WORDS, with_bands: bool = False, n_bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per record and text field with enough words. ``fields`` maps the field's name to its column."""
    cols = [F.col(id_col).cast("string")] + [F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields.values())]
    names = list(fields)
    schema = _NODE + (", bands array<long>" if with_bands else "")
    return df.select(*cols).mapInArrow(lambda it: _node_batches(it, names, n, min_words, with_bands, n_bands, band_rows), schema)


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of n-grams by hash slot over all sets; summed in the workers first, ``SKETCH`` counters in all."""

    def partial(it):
        total = np.zeros(SKETCH, np.int64)
        for batch in it:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat.view(np.uint32) & np.uint32(SKETCH - 1), minlength=SKETCH)
        slots = np.flatnonzero(total)
        for i in range(0, len(slots), 1 << 16):
            s = slots[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(total[s])], names=["slot", "n"])

    rows = sets.select("grams").mapInArrow(partial, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def prefix_buckets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(bucket, fp)``: the rarest ``size - ceil(threshold size) + 1`` n-grams of every set.

    Any two sets of at least the threshold's Jaccard similarity share one. The order is by sketched
    frequency, so boilerplate n-grams come last; any fixed order is exact.
    """
    spark = sets.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(sets))

    def emit(it):
        counts = sketch.value
        for batch in it:
            fp, field_salt = batch.column(0).to_numpy(), batch.column(1)
            lists = batch.column(2)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            off = off - off[0]
            size = np.diff(off)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, counts[flat.view(np.uint32) & np.uint32(SKETCH - 1)], owner))
            nth = np.arange(len(flat)) - np.repeat(off[:-1], size)
            keep = nth < np.repeat(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, size)
            sel = order[keep]
            salt = np.array([_salt(x) for x in field_salt.to_pylist()], np.uint64)
            with np.errstate(over="ignore"):
                bucket = shingles.mix(flat[sel].view(np.uint32).astype(np.uint64) + shingles.mix(salt)[owner[sel]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fp[owner[sel]])], names=["bucket", "fp"])

    return sets.select("fp", "field", "grams").mapInArrow(emit, "bucket long, fp long")


def compare_nodes(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(u, v)`` with exact intersection, kept where the Jaccard similarity reaches the threshold."""
    a = sets.select(F.col("fp").alias("u"), F.col("grams").alias("ga"), F.col("size").alias("na"))
    b = sets.select(F.col("fp").alias("v"), F.col("grams").alias("gb"), F.col("size").alias("nb"))
    both = pairs.join(a, "u").join(b, "v").where((F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
    common = both.withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return common.where(F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9).select("u", "v", "na", "nb", "common")


def _apart(rows: DataFrame) -> DataFrame:
    """``(u, v)``: all pairs of nodes of a bucket that lie in different components; ``rows(bucket, fp, c, rows)``.

    A bucket is cut into blocks of about ``BLOCK`` rows, and every pair of blocks is a key of its own, so that no task holds
    a hot bucket.
    """
    cut = rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    each = cut.select("bucket", "fp", "c", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    each = each.select("bucket", "fp", "c", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    x, y = each.alias("x"), each.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    met = x.join(y, same).where("x.c <> y.c and x.fp < y.fp and (x.lo = x.hi or x.b <> y.b)")
    return met.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct()


def bucket_links(buckets: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and components of the nodes that share a bucket; see the module's text.

    ``buckets(bucket, fp)``, ``sets(fp, field, grams, size)`` (repeated fps allowed). Returns
    ``links(u, v, na, nb, common)`` and ``components(node, component)``.
    """
    ends = buckets.groupBy("bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    shared = materialize(buckets.join(ends.select("bucket", "lo"), "bucket").distinct(), "shared")
    star = shared.where("fp <> lo").select(F.col("lo").alias("u"), F.col("fp").alias("v")).distinct()
    need = shared.select("fp").distinct()
    arrays = materialize(sets.select("fp", "field", "size", "grams").join(need, "fp", "left_semi").dropDuplicates(["fp"]), "arrays")
    links = materialize(compare_nodes(star, arrays, threshold), "links")
    comps = connected_components(links.select("u", "v"))
    part = shared.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "fp", F.coalesce("component", "fp").alias("c"))
    mixed = part.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("rows")).where("a <> b")
    rest = materialize(part.join(mixed.select("bucket", "rows"), "bucket"), "rest")
    if rest.isEmpty():
        release(shared, arrays, rest)
        return links, comps
    small = rest if hot is None else rest.where(F.col("rows") <= hot)
    pairs = _apart(small).join(star, ["u", "v"], "left_anti")
    more = compare_nodes(pairs, arrays, threshold)
    if hot is not None:
        many = rest.where(F.col("rows") > hot).select("fp").distinct()
        if not many.isEmpty():
            left = materialize(arrays.join(many, "fp", "left_semi"), "hot")
            more = more.unionByName(bucket_links(prefix_buckets(left, threshold), left, threshold)[0])
    more = materialize(more, "more")
    release(shared, arrays, rest)
    if more.isEmpty():
        return links, comps
    links = links.unionByName(more).dropDuplicates(["u", "v"])
    return links, connected_components(links.select("u", "v"))


def alike_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``(field, id, group)`` of all records whose group holds another record."""
    rows = members.select("field", "id", "fp").distinct().join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    rows = rows.select("field", "id", F.coalesce("component", "fp").alias("group")).distinct()
    sizes = rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(sizes, "group")


def near_duplicates(texts: list[tuple[DataFrame, str, dict[str, str]]], *, threshold: float = THRESHOLD, n: int = 3, min_words: int = MIN_WORDS, n_bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Groups of near-duplicate texts by field: DartMinHash signatures, banded joins, exact comparison.

    ``texts`` lists tables with their id column and ``{field: text column}``. Returns
    ``(group, field, id, members)``, one row per record that has an alike other record in the same field.

    Null, empty and short texts are in no group; repeated rows of one id count once; equal texts are in
    one group; ties and order of rows have no influence. An empty table gives an empty result.
    """
    parts = [nodes(df, key, fields, n=n, min_words=min_words, with_bands=True, n_bands=n_bands, band_rows=band_rows) for df, key, fields in texts]
    all_nodes = parts[0]
    for p in parts[1:]:
        all_nodes = all_nodes.unionByName(p)
    sets = materialize(all_nodes, "dart")
    _, comps = bucket_links(sets.select(F.explode("bands").alias("bucket"), "fp"), sets, threshold, HOT_BUCKET)
    return alike_groups(sets, comps)


def group_pairs(groups: DataFrame) -> DataFrame:
    """``(field, id_a, id_b)``: all pairs of each group, smaller id first."""
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, F.col("a.group") == F.col("b.group")).where("a.id < b.id").select(F.col("a.field").alias("field"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
