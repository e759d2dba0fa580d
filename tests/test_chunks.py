"""Chunks and masked words, in time linear to the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from passageloom.functions import text as X
from passageloom.operators import chunk

BLANK = re.compile(r"\s*", re.U)


def cut(text, size, overlap):
    text = text.strip()
    made = [text[k : k + size] for k in range(0, len(text), size - overlap)]
    return [c for c in made if c.strip()]


@pytest.mark.parametrize("size, overlap, slab", [(7, 0, 20), (7, 3, 20), (7, 6, 20), (50, 45, 10), (1, 0, 3), (2000, 200, 1 << 15)])
def test_chunks_over_slabs(spark, monkeypatch, size, overlap, slab):
    monkeypatch.setattr(chunk, "SLAB", slab)
    rng = random.Random(size)
    texts = ["", " \n ", "a", "é" * 21, "🙂b" * 33, "x" + " " * 60 + "y"] + ["".join(rng.choice("ab🙂é \n\t") for _ in range(rng.randint(1, 6000 if size > 100 else 120))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    got = {}
    for r in chunk.chunk_text(docs, size=size, overlap=overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.chunk_no == len(got[r.doc_id]) - 1
    assert got == {k: c for k, t in enumerate(texts) if (c := cut(t, size, overlap))}


def test_time_grows_with_the_text(spark):
    def took(chars):
        docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Ein Satz über Öl. "), chars // 18).alias("text"))
        docs.write.mode("overwrite").format("noop").save()
        began = time.time()
        assert chunk.chunk_text(docs, overlap=200).agg(F.count("*")).first()[0] == -(-(chars // 18 * 18 - 1) // 1800)
        return time.time() - began

    took(500_000)
    times = {n: took(n) for n in (2_500_000, 5_000_000, 10_000_000)}
    assert times[10_000_000] < 3 * times[5_000_000] + 1 and times[5_000_000] < 3 * times[2_500_000] + 1


def test_masks_equal_one_substitution_after_another(spark):
    rng = random.Random(3)
    parts = ["garden", "Garden", "gardens", "Straße", "Öffnung", "window_frame", "window", "it's", "-", "x1garden", "...", "\n", "naïvetés", "garden's", "(window)", "a"]
    rows = [(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), rng.sample(["garden", "gardens", "window", "Straße", "naïvetés", "absent"], 3)) for _ in range(300)]

    def want(text, chosen):
        for n, w in enumerate(chosen, 1):
            text = re.sub(rf"\b{w}\b", f"[BLANK {n}]", text, count=1)
        return text

    frame = spark.createDataFrame(rows, "text string, chosen array<string>")
    got = [r.m for r in frame.select(X.mask_words(F.col("text"), F.col("chosen")).alias("m")).collect()]
    assert got == [want(*r) for r in rows]
