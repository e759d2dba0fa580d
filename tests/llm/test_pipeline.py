"""Each stage of the pipeline on what the one before it kept."""

import collections
import hashlib

import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from passageloom.llm import bpe
from passageloom.llm.common import materialise
from tests.llm.test_dedup import UPPER, brute_near


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        seen.append(docs.collect())
        if name != "byte BPE":
            assert docs.columns == columns
    raw, clean, exact, near, mixed, coded = seen
    assert set(clean) <= set(raw) and len(clean) > 0.8 * len(raw)

    last = {}
    for r in clean:
        key = (r.text or "").translate(UPPER)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    component = brute_near([(r.doc_id, r.text) for r in exact], 5, 80)
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in component.items() if i == c)

    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(near) and max(copies.values()) <= 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed) / words(near) - 1.5) < 0.15

    known = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed}
    assert collections.Counter(r.doc_id for r in coded) == copies
    for r in coded:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def tables(spark):
    from passageloom.llm import common

    at = spark._jvm.org.apache.hadoop.fs.Path(common.tables_dir(spark))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(at)} if files.exists(at) else set()


def test_run_leaves_one_table(spark, sf):
    other, before = materialise(spark.range(5)), tables(spark)
    made = corpus_pipeline.run(spark, sf)
    assert made.count() > 0 and len(corpus_pipeline.STAGES) == 5
    assert other.count() == 5 and before < tables(spark) and len(tables(spark) - before) == 1


CLASHES = ["kept_id", "mix_id", "mix_copies", "score", "toxic", "threshold", "i", "n", "t", "rep", "kept", "source_size", "recipe", "ids", "size"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_edges(spark, sf, name, stage):
    """Nulls, repeated rows and clashing columns keep their columns; an empty table stays one."""
    rows = [(1, "Some words of a text.", "en", "a", 21), (1, "Some words of a text.", "en", "a", 21), (2, None, None, None, None), (None, "Other words stand in this one.", "fr", "b", 3), (3, "", "en", "a", 0), (4, "w " * 20000, "de", "b", 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in CLASHES})
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    made = got.collect()
    assert {tuple(r) for r in made} <= {tuple(r) for r in docs.collect()} and {r.kept_id for r in made} == {"x"}
    if name != "mixing":  # nothing here is toxic or a near copy; of equal texts the largest id stays, with its repeats
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in made) == sorted((i or 0, len(t or "")) for i, t, *_ in rows if name != "exact dedup" or i != 2)
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_last_stage_edges(spark, sf):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, "a b"), (2, "a b")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "decoded_sha256")})
    got = sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "n_tokens").collect()))
    assert len(got) == 4 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_tables_are_discarded(spark, sf):
    from passageloom.llm import common

    kept, gone = common.materialise(spark.range(3)), common.materialise(spark.range(4))
    common.discard(spark, kept)
    assert kept.count() == 3
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|No such|not found"):
        gone.count()
