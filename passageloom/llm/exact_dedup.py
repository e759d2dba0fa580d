"""Exact de-duplication by content-defined chunk recipes.

Each normalised text (A-Z lower-cased) is cut where four letters in a row
say so, about once in a few hundred characters. The least chunk is short beside
that, so texts that share a passage cut it alike soon after its start, wherever it
stands. A document then is the ordered list of its chunks' identifiers, its
recipe, and only recipes are grouped: a long text crosses the network once, as
chunks, when the identifiers are verified, and copies of a chunk collapse before
that shuffle.

Rows go back to their groups by a join on the recipe. Groups of at least a
HOT-th of all rows, HOT groups at most, are joined by broadcast, so that no task
gets them whole; the others by sort-merge.

Rows: a null text counts as empty; empty texts equal each other. Repeated rows
count as rows; of rows that share the largest doc_id of a group all are kept. A
null doc_id loses to any other, and is kept where a group has no other. Texts of any
length are taken whole. An empty table gives an empty one. Other columns, of whatever
names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, materialise

#: Characters of a chunk at least; it ends after the first BOUNDARY from there,
#: or at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 64, 8192


def letters(rest: int) -> str:
    """A pattern of the letters whose code divided by four leaves rest, and of a
    share of the ideographs."""
    some = "".join("\\x{%x}" % c for c in [*range(0x20, 0x7F), *range(0xA1, 0x100)] if c % 4 == rest)
    return f"[{some}{chr(0x4E00)}-{chr(0x5FFF)}]" if rest else f"[{some}{chr(0x6000)}-{chr(0x7FFF)}]"


#: Four letters in turn from one set and the other end a chunk.
BOUNDARY = (letters(1) + letters(0)) * 2
#: Groups of recipes that are broadcast, at most, and rows of one at least.
HOT, HOT_ROWS = 1000, 512


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text, in order; joined they are the text."""
    rule = f"(?s).{{{min_chunk},{max_chunk}}}?{BOUNDARY}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_id: Callable[[Column], Column] = F.xxhash64,
    min_chunk: int = MIN_CHUNK,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    chunk_id gives a chunk its identifier. Identifiers are verified against the
    chunks' contents: where two different chunks share one, the documents that
    hold it are compared by their whole texts as well.
    """
    norm = docs.select(F.col(id_col).alias("i"), lower_ascii(F.col(text_col)).alias("n"))
    recipes = materialise(
        norm.select(
            "i",
            F.sha2(F.encode("n", "UTF-8"), 256).alias("sha"),
            F.transform(chunks(F.col("n"), min_chunk=min_chunk), lambda c: chunk_id(c)).alias("recipe"),
        )
    )
    seen = norm.select(F.explode(chunks(F.col("n"), min_chunk=min_chunk)).alias("c"))
    clash = seen.select(chunk_id(F.col("c")).alias("h"), "c").distinct().groupBy("h").count()
    clash = clash.where("count > 1").select("h")

    keys = ["recipe"]
    if clash.limit(1).count():
        clash = materialise(clash)
        hit = recipes.select("i", "sha", F.explode("recipe").alias("h")).join(clash, "h", "left_semi")
        texts = norm.withColumn("sha", F.sha2(F.encode("n", "UTF-8"), 256))
        on = (F.col("a.i").eqNullSafe(F.col("b.i"))) & (F.col("a.sha") == F.col("b.sha"))
        whole = texts.alias("a").join(hit.select("i", "sha").distinct().alias("b"), on, "left_semi")
        on = (F.col("r.i").eqNullSafe(F.col("w.i"))) & (F.col("r.sha") == F.col("w.sha"))
        recipes = (
            recipes.alias("r")
            .join(whole.distinct().alias("w"), on, "left")
            .select("r.*", F.coalesce(F.col("w.n"), F.lit("")).alias("whole"))
        )
        keys.append("whole")

    limit = max(recipes.count() / HOT, HOT_ROWS)
    groups = materialise(recipes.groupBy(*keys).agg(F.max("i").alias("keep_id"), F.count("*").alias("group_size")))
    hot = F.broadcast(groups.where(F.col("group_size") >= limit))
    rest = recipes.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("group_size") < limit).hint("merge"), keys)
    joined = recipes.join(hot, keys).select(*rest.columns).union(rest)
    return joined.select(
        F.col("i").alias(id_col),
        "keep_id",
        "group_size",
        F.col("i").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns. Rows that
    share the largest id of a group all stay."""
    own = free_name(docs, "kept_id")
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(own))
    return docs.join(keep.distinct().hint("merge"), docs[id_col].eqNullSafe(F.col(own)), "left_semi")
