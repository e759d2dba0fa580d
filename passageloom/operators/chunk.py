"""Cutting long texts into passages, and checks on passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import barrier, let, strip

#: Characters of a single passage at most, and of a chunk.
MAX_PASSAGE, CHUNK = 3000, 2000
#: Characters of a slab at least.
SLAB = 1 << 15


def chunks(text: Column, size: int = CHUNK, overlap: int = 0) -> Column:
    """Chunks of the stripped text, size characters each, the next one starting
    size - overlap later; blank ones are dropped, the others stay as they are."""
    if size <= 0:
        raise ValueError("size must be greater than 0")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return chunks_of(strip(text), size, overlap)


def chunks_of(t: Column, size: int, overlap: int) -> Column:
    """In time linear to the text: one pass cuts it into slabs of whole steps, and a
    chunk is looked for within its slab and the head of the next."""
    step = size - overlap
    slab = step * -(-max(SLAB, size) // step)

    def within(whole: Column, k: Column, length: Column) -> Column:
        starts = F.sequence(F.lit(0), length - 1, F.lit(step))
        return F.transform(starts, lambda i: F.struct((k * slab + i).alias("start"), F.substring(whole, i + 1, F.lit(size)).alias("text")))

    def cut(slabs: Column) -> Column:
        head = lambda k: F.coalesce(F.substring(F.get(slabs, k + 1), F.lit(1), F.lit(overlap)), F.lit(""))
        return F.flatten(F.transform(slabs, lambda s, k: let(F.concat(s, head(k)), lambda whole: within(whole, k, F.length(s)))))

    made = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{slab}}}"), F.lit(0)), cut)
    return F.when(F.length(t) > 0, F.filter(made, lambda c: strip(c["text"]) != ""))


def chunk_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """id_col, chunk_no (from 0 among the kept) and text of each chunk."""
    chunks(F.col(text_col), size, overlap)  # refuses sizes that don't fit
    ready = barrier(docs.select(id_col, text_col), stripped_=strip(F.col(text_col)))
    exploded = ready.select(id_col, F.posexplode(chunks_of(F.col("stripped_"), size, overlap)).alias("chunk_no", "c"))
    return exploded.select(id_col, "chunk_no", F.col("c.text").alias("text"))


def validated(passages: DataFrame, text_col: str = "text", most: int | None = MAX_PASSAGE) -> DataFrame:
    """passages with the text stripped, and error: why a passage can't be used,
    null if it can. most is checked before stripping."""
    raw = F.col(text_col)
    error = F.when(raw.isNull() | (strip(raw) == ""), "the passage is empty")
    if most is not None:
        too_long = F.concat(F.lit("the passage has "), F.format_number(F.length(raw), 0), F.lit(f" characters, more than {most:,}; cut it into chunks first"))
        error = F.when(F.length(raw) > most, too_long).otherwise(error)
    return passages.withColumns({"error": error, text_col: strip(raw)})


def usable(passages: DataFrame, text_col: str = "text", most: int | None = MAX_PASSAGE) -> DataFrame:
    """The passages that can be used, stripped."""
    return validated(passages, text_col, most).where("error IS NULL").drop("error")
