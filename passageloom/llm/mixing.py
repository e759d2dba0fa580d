"""Mixing sources to target sizes by systematic sampling, in DataFrame functions.

Sources share a budget of words by weight; no target exceeds a multiple of its
source's size, and what is cut off is shared again by weight. A source then
takes each of its documents an expected number of times, target by size. The
expected copies are summed up along the source's documents, one random offset
is added, and a document is taken once for each integer that its step crosses:
the number of copies is the expected one, rounded up or down.

Documents stand in the order of their size, so whichever of two neighbours a boundary
falls on, about as many words are taken. What is left is which of the longest are
taken once more, and that is the offset's to say: OFFSETS of them are drawn, evenly
from a random start, the words that each would take are summed up, and the one that
comes nearest to the target is added. A place in the order is found from counts by size
and of buckets of about BUCKET rows, never by a window over a whole source, which may
hold a third of all rows; those of the sources themselves from counts of ranges, so
that no task holds all sources.

Rows: a null text has no words, and a null source is a source of its own, the
last in order. A source without words has the target 0. Repeated rows count as
rows. Texts of any length are counted whole. An empty table gives an empty one. Other
columns, of whatever names, are left alone. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise, text_of

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Rows of a bucket, and offsets that are tried.
BUCKET, OFFSETS = 512, 64


def hashed(key: Column, digits: int) -> Column:
    """The first hexadecimal digits of the key's md5, as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def summed_up(df: DataFrame, order: list[Column], **totals: Column) -> DataFrame:
    """df with, under each name, the sum of a column over all rows before, in a
    total order. Rows are dealt into ranges; a sum is that of the ranges before,
    of which there are as many as shuffle partitions, plus that within the range."""
    df = materialise(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    before = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = df.groupBy("range_no").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    ranges = ranges.select(F.col("range_no").alias("of_range"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = W.partitionBy("range_no").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    df = df.join(F.broadcast(ranges), F.col("range_no") == F.col("of_range"))
    return df.withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop("range_no", "of_range", *[f"_{n}" for n in totals])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> those and target, one row a source.

    With sources in order of cap by weight, those that stop at their cap are a
    prefix; the rest share what is left in proportion to weight. The share per
    weight that is left after a prefix grows until the prefix is the right one,
    and falls from there on.
    """
    ranked = summed_up(sources, [F.col("source").asc_nulls_last()], place=F.lit(1))
    ranked = ranked.select(
        "source", "source_size", "place",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * cap).alias("most"),
    )
    ranked = summed_up(ranked.withColumn("ratio", F.col("most") / F.col("weight")), [F.col("ratio"), F.col("place")], cut=F.col("most"), cut_weight=F.col("weight"))
    ranked = materialise(ranked)
    size, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit((size or 0) * float(share)) - F.col("cut")) / (F.lit(weight or 0) - F.col("cut_weight"))
    top = ranked.agg(F.max(level)).first()[0]
    wanted = F.least(F.col("most").cast("double"), F.coalesce(F.lit(top).cast("double") * F.col("weight"), F.lit(0.0)))
    return ranked.select("source", "source_size", wanted.alias("target"))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies and
    taken, copies times size."""
    size = F.regexp_count(text_of(F.col(text_col)), F.lit(WORD)).cast("long")
    rows = materialise(
        docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
        .withColumn("key", F.coalesce(F.col("i").cast("string"), F.lit("")))
    )
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    own = W.partitionBy("source")
    sizes = sizes.withColumn("before", F.sum("n").over(own.orderBy("size")) - F.col("n"))
    sizes = materialise(sizes)
    wanted = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    wanted = wanted.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    first = hashed(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit(""))), 5) / F.lit(float(1 << 20))
    wanted = materialise(wanted.withColumn("first", first))
    crossed = lambda rank, n, offset: F.floor((rank + n) * F.col("each") + offset) - F.floor(rank * F.col("each") + offset)
    drawn = lambda k: (F.col("first") + k / OFFSETS) % 1
    known = sizes.alias("c").join(wanted.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target", "each", "first")
    words = [F.sum(F.col("size") * crossed(F.col("before"), F.col("n"), drawn(k))).alias(f"w{k}") for k in range(OFFSETS)]
    tried = known.groupBy("source").agg(F.first("target").alias("target"), F.first("first").alias("first"), *words)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), drawn(k).alias("offset")) for k in range(OFFSETS)]))
    chosen = materialise(tried.select("source", nearest["offset"].alias("offset")))
    told = known.alias("t").join(chosen.alias("o"), F.col("t.source").eqNullSafe(F.col("o.source"))).select("t.*", "offset")

    same = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size"))
    dealt = (
        rows.alias("r")
        .join(told.alias("t"), same)
        .select("r.*", "n", "before", "source_size", "target", "offset", "each")
        .withColumn("bucket", F.expr(f"shiftright({'conv(substring(md5(cast(key AS BINARY)), 1, 8), 16, 10)'} * ceil(n / {BUCKET}), 32)").cast("long"))
    )
    buckets = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("here"))
    run = W.partitionBy("source", "size").orderBy("bucket")
    buckets = buckets.withColumn("skip", F.sum("here").over(run) - F.col("here")).drop("here")
    same = (
        F.col("d.source").eqNullSafe(F.col("b.source"))
        & (F.col("d.size") == F.col("b.size"))
        & (F.col("d.bucket") == F.col("b.bucket"))
    )
    inside = W.partitionBy("source", "size", "bucket").orderBy(F.md5(F.col("key").cast("binary")), "i")
    placed = (
        dealt.alias("d")
        .join(buckets.alias("b"), same)
        .select("d.*", "skip")
        .withColumn("rank", F.col("before") + F.col("skip") + F.row_number().over(inside) - 1)
    )
    copies = crossed(F.col("rank"), F.lit(1), F.col("offset")).cast("long")
    return placed.select(F.col("i").alias(id_col), "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is
    taken. Rows that share an id (or have none) are each taken as often as the
    one of them that is taken most."""
    own, copies = free_name(docs, "mix_id"), free_name(docs, "mix_copies")
    plan = mixing_plan(docs, id_col, text_col, source_col, **options)
    plan = plan.groupBy(F.col(id_col).alias(own)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    taken = docs.join(plan.hint("merge"), docs[id_col].eqNullSafe(F.col(own)))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
