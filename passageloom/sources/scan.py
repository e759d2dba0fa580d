"""Rows numbered in the order of their files.

The number of a row depends on the files alone, not on how a scan splits them or how
many tasks read it: files in the order of their paths, rows as they stand. Numbers are
counts of the files or splits before, and the place within one. No data moves: what is
counted is a row per file or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("parquet", "json", "text")


def before(counts: DataFrame, *order: str) -> DataFrame:
    """counts with skip, the rows of what stands before; a row per file or split."""
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("skip", F.coalesce(F.sum("here").over(upto), F.lit(0)))


def numbered(spark: SparkSession, path: str | list[str], kind: str = "parquet", text_col: str = "text", schema: str | None = None, index_col: str = "row_index") -> DataFrame:
    """Rows of parquet, JSON lines or text files with index_col, their number from 0 in
    file order. A column of that name in the files is replaced.

    Parquet knows the place of a row in its file. In other files the place in a split is
    told by the order in which it is read; a scan whose splits aren't those that were
    counted, as after a change of spark.sql.files.maxPartitionBytes, raises an error.
    An empty folder gives an empty table; blank lines of a text file are rows."""
    if kind not in KINDS:
        raise ValueError(f"Unknown kind {kind!r}. Available: {', '.join(KINDS)}")
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.format(kind).load(path)
    meta = F.col("_metadata")
    own = [F.col(f"`{c}`").alias(text_col if kind == "text" and c == "value" else c) for c in rows.columns if c.lower() != index_col.lower()]
    file, block = meta["file_path"], meta["file_block_start"]
    if kind == "parquet":
        keys, place, rows = ["file_"], F.col("at_"), rows.select(*own, file.alias("file_"), meta["row_index"].alias("at_"))
        counts = before(rows.groupBy("file_").agg(F.count("*").alias("here")), "file_")
    else:
        keys, place = ["file_", "block_"], F.col("at_") - F.col("first_")
        rows = rows.select(*own, file.alias("file_"), block.alias("block_"), F.monotonically_increasing_id().alias("at_"))
        counts = before(rows.groupBy(*keys).agg(F.count("*").alias("here"), F.min("at_").alias("first_")), "file_", "block_")
    made = rows.join(counts, keys, "left")
    number = F.when(F.col("skip").isNull() | (place < 0) | (place >= F.col("here")), F.raise_error(F.lit("the scan is split otherwise than it was counted"))).otherwise(F.col("skip") + place)
    return made.select(*[c for c in made.columns if c not in (*keys, "at_", "here", "skip", "first_")], number.cast("long").alias(index_col))


def first_rows(rows: DataFrame, done: Column, most: int, index_col: str = "row_index") -> DataFrame:
    """The first `most` of the rows that aren't done, by number."""
    return rows.where(~done).orderBy(index_col).limit(most)
