"""Overlap of evaluation records with training records, by prompt, by file and by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.overlap import MIN_WORDS, THRESHOLD, alike_groups, bucket_links, compare_nodes, nodes, prefix_buckets
from millrace.operators.records import split_side
from millrace.session import materialize

#: Training rows of one bucket that are compared in one block.
BLOCK = 256


def _groups(df: DataFrame, key: str, field: str, column: str, threshold: float, n: int, min_words: int) -> DataFrame:
    sets = materialize(nodes(df, key, {field: column}, n=n, min_words=min_words), "ngrams")
    _, comps = bucket_links(prefix_buckets(sets, threshold), sets, threshold)
    return alike_groups(sets, comps)


def shared_evidence(cases: DataFrame, blobs: DataFrame, reports: DataFrame, *, threshold: float = THRESHOLD, n: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """``(kind, group, case_id)``: what each case shares with at least one other record.

    Word n-gram hashes of every prompt, and of every file of role impl, are partitioned by hash (the rarest
    n-grams of each record, enough for any pair at the threshold) and hits are compared exactly.
    """
    rows = _groups(cases, "case_id", "prompt", "prompt", threshold, n, min_words)
    prompts = rows.select(F.lit("prompt").alias("kind"), F.col("group").cast("string").alias("group"), F.col("id").alias("case_id"))
    impl = blobs.where("role = 'impl'")
    files = _groups(impl, "blob_id", "content", "content", threshold, n, min_words)
    owner = impl.select(F.col("blob_id").alias("id"), "case_id").distinct()
    files = files.join(owner, "id").select(F.lit("content").alias("kind"), F.col("group").cast("string").alias("group"), "case_id")
    marks = reports.where(F.col("fingerprint").startswith("v3:")).select(F.lit("fingerprint").alias("kind"), F.col("fingerprint").alias("group"), "case_id")
    return prompts.unionByName(files).unionByName(marks).where("case_id is not null").distinct()


def cross_split_pairs(cases: DataFrame, blobs: DataFrame, reports: DataFrame, **options) -> DataFrame:
    """``(case_id_a, case_id_b)``: a training and an evaluation case that share a prompt, an impl file or a
    v3 fingerprint; smaller id first, each pair once.

    Cases of no or unknown split are in no pair but may connect others; a case listed under both sides counts
    for both. Null ids, null texts and short texts give nothing; repeated rows count once; extra columns are ignored.
    """
    evidence = materialize(shared_evidence(cases, blobs, reports, **options), "evidence")
    sides = cases.select("case_id", split_side(F.col("split")).alias("side")).where("side is not null").distinct()
    rows = evidence.join(sides, "case_id")
    both = rows.groupBy("kind", "group").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo <> hi").select("kind", "group")
    rows = rows.join(both, ["kind", "group"])
    train = rows.where("side = 'train'").select("kind", "group", F.col("case_id").alias("t"))
    held = rows.where("side = 'eval'").select("kind", "group", F.col("case_id").alias("e"))
    pairs = train.join(held, ["kind", "group"]).where("t <> e")
    return pairs.select(F.least("t", "e").alias("case_id_a"), F.greatest("t", "e").alias("case_id_b")).distinct()


def overlap_counts(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cases with a cross-split partner, and pairs, per split and source (null shown as ``none``)."""
    label = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("none"))
    info = cases.select("case_id", label(F.col("split")).alias("split"), label(F.col("source")).alias("source")).dropDuplicates(["case_id"])
    ends = pairs.select(F.explode(F.array("case_id_a", "case_id_b")).alias("case_id")).groupBy("case_id").agg(F.count("*").alias("n"))
    return info.join(ends, "case_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("cases"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")
    )


def _cross_pairs(buckets: DataFrame, sides: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)``: every evaluation node and training node that differ, share a bucket and are near enough in size.

    ``sides(fp, side, size)``. The training rows of a bucket are cut into blocks of about ``BLOCK`` rows that each
    meet a copy of the bucket's evaluation rows, so no task has to hold a hot bucket.
    """
    rows = buckets.distinct().join(sides, "fp")
    count = rows.groupBy("bucket").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("e")).where("t > 0 and e > 0")
    rows = rows.join(count.select("bucket", F.ceil(F.col("t") / BLOCK).cast("int").alias("blocks")), "bucket")
    block = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = rows.where("side = 'eval'").select("bucket", F.explode(block).alias("block"), F.col("fp").alias("u"), F.col("size").alias("nu"))
    train = rows.where("side = 'train'").select("bucket", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), F.col("fp").alias("v"), F.col("size").alias("nv"))
    near = (F.col("u") != F.col("v")) & (F.least("nu", "nv") >= threshold * F.greatest("nu", "nv") - 1e-9)
    return held.join(train, ["bucket", "block"]).where(near).select("u", "v").distinct()


def _sided(cases: DataFrame, blobs: DataFrame | None, n: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``sets`` of the prompts and impl files, and ``who(field, fp, side, id, case_id, size)``: the records of each set."""
    sides = cases.select("case_id", split_side(F.col("split")).alias("side")).where("side is not null").distinct()
    texts = cases.select(F.col("case_id").alias("id"), "prompt").join(sides.select(F.col("case_id").alias("id")).distinct(), "id", "left_semi")
    found = nodes(texts, "id", {"prompt": "prompt"}, n=n, min_words=min_words)
    owner = cases.select(F.lit("prompt").alias("field"), F.col("case_id").cast("string").alias("id"), "case_id")
    if blobs is not None:
        impl = blobs.where("role = 'impl'").join(sides.select("case_id").distinct(), "case_id", "left_semi")
        found = found.unionByName(nodes(impl, "blob_id", {"content": "content"}, n=n, min_words=min_words))
        owner = owner.unionByName(impl.select(F.lit("content").alias("field"), F.col("blob_id").cast("string").alias("id"), "case_id"))
    sets = materialize(found, "ngrams")
    who = sets.select("field", "id", "fp", "size").join(owner.distinct(), ["field", "id"]).join(sides, "case_id")
    return sets, who.select("field", "fp", "side", "id", "case_id", "size").distinct()


def containment(cases: DataFrame, blobs: DataFrame | None = None, *, threshold: float = THRESHOLD, n: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """Per directly alike evaluation and training text: shared n-grams over the evaluation record's n-grams.

    ``(eval_id, train_id, containment, field)``: field is `prompt` (ids are case_id) or, with ``blobs``, `content` (ids
    are the blob_id of impl files, whose side is that of their case). One row per pair of texts that reaches the
    threshold directly; ids are the records' least ids of that text and side, whose other records
    ``containment_members`` lists. Equal texts are one node and have containment 1.
    """
    sets, who = _sided(cases, blobs, n, min_words)
    who = materialize(who.groupBy("field", "fp", "side").agg(F.min("id").alias("id"), F.first("size").alias("size")), "sides")
    pairs = materialize(_cross_pairs(prefix_buckets(sets, threshold), who.select("fp", "side", "size"), threshold), "pairs")
    need = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    arrays = materialize(sets.select("fp", "size", "grams").join(need, "fp", "left_semi").dropDuplicates(["fp"]), "arrays")
    links = compare_nodes(pairs, arrays, threshold)
    e, t = who.where("side = 'eval'"), who.where("side = 'train'")
    near = links.select("u", "v", "common").join(e.select(F.col("fp").alias("u"), F.col("id").alias("eval_id"), "size", "field"), "u").join(t.select(F.col("fp").alias("v"), F.col("id").alias("train_id")), "v")
    same = e.select("fp", F.col("id").alias("eval_id"), "size", "field").join(t.select("fp", F.col("id").alias("train_id")), "fp").withColumn("common", F.col("size"))
    cols = ["eval_id", "train_id", (F.col("common") / F.col("size")).alias("containment"), "field"]
    return near.select(*cols).unionByName(same.select(*cols))


def containment_members(cases: DataFrame, blobs: DataFrame | None = None, *, n: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """``(field, side, representative, id, case_id)``: every record of the text that ``containment`` names by its least id.

    One row per record, side and case, also of texts that are in no row of ``containment``.
    """
    _, who = _sided(cases, blobs, n, min_words)
    who = materialize(who, "members")
    least = who.groupBy("field", "fp", "side").agg(F.min("id").alias("representative"))
    return who.join(least, ["field", "fp", "side"]).select("field", "side", "representative", "id", "case_id")
