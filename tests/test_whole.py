"""Queries take all documents, whatever their length and words."""

import pytest
from pyspark.sql import functions as F

from passageloom.operators import augment, chunk, groups
from passageloom.plans import more_queries, queries

QUERIES = queries.QUERIES | more_queries.QUERIES


def test_passages_hold_every_document(spark, sf):
    got = queries.passages(spark, sf).groupBy(F.substring_index("doc_id", ":", 1).alias("d")).agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("most"))
    got, docs = {int(r.d): r for r in got.collect()}, queries.documents(spark, sf).where("trim(text) <> ''").collect()
    assert set(got) == {r.doc_id for r in docs} and max(len(r.text) for r in docs) > chunk.MAX_PASSAGE
    assert all(r.most <= chunk.CHUNK for r in got.values())
    for r in docs:  # blanks at the ends of a chunk are stripped, nothing else is lost
        assert 0 <= len(r.text.strip()) - got[r.doc_id].n <= 2 * (1 + len(r.text) // chunk.CHUNK)


@pytest.mark.parametrize("name", ["continuation", "title", "cloze", "query_generation", "table_runtime"])
def test_long_documents_have_rows(spark, sf, name):
    """Every long document has rows, and so has every chunk that the task's checks take."""
    made = QUERIES[name](spark, sf).collect()
    long = {r.doc_id for r in queries.documents(spark, sf).where(F.length("text") > chunk.MAX_PASSAGE).collect()}
    drawn = {d for d in long if name != "table_runtime" or d % 7}
    assert drawn and drawn <= {int(r.doc_id.split(":")[0]) for r in made}
    assert all(r.instruction and r.input and r.output for r in made)
    if name == "title":
        assert {r.doc_id for r in made} == {r.doc_id for r in queries.passages(spark, sf).collect()}


@pytest.mark.parametrize("size", [2, 3])
def test_all_groups_of_sparse_ids(spark, size):
    """Against a plain numbering: ids 5000 apart, a null source, a source of one document."""
    import random

    rng = random.Random(7)
    rows = [(rng.randrange(10**12), rng.choice("abc"), f"text {k}") for k in range(100)] + [(k * 5000, None, f"null {k}") for k in range(7)] + [(3 + k * 5000, "d", f"d {k}") for k in range(2)] + [(1, "one", "alone"), (2, "a", " ")]
    made = groups.all_groups(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), size)
    want = set()
    for source in {s for _, s, _ in rows}:
        ids = sorted(i for i, s, t in rows if s == source and t.strip())
        cut = [ids[k : k + size] for k in range(0, len(ids), size)]
        if len(cut) > 1 and len(cut[-1]) == 1:
            cut[-2:] = [cut[-2] + cut[-1]]
        want |= {tuple(x) for x in cut if len(x) > 1}
    assert {tuple(r.ids) for r in made.collect()} == want
    texts = {i: t for i, _, t in rows}
    assert all(r.group_id == r.ids[0] and list(r.passages) == [texts[i] for i in r.ids] for r in made.collect())


def test_groups_hold_every_document(spark, sf):
    docs = [r.doc_id for r in queries.documents(spark, sf).where("trim(text) <> ''").collect()]
    made = QUERIES["passage_groups"](spark, sf).collect()
    assert sorted(int(i) for r in made for i in r.ids.split(",")) == sorted(docs)
    compared = "".join(r.input for r in QUERIES["comparison"](spark, sf).collect())
    assert all(r.text.strip() in compared for r in queries.documents(spark, sf).where("trim(text) <> ''").collect())
    for name in ("retrieval_positive", "retrieval_negative"):
        assert QUERIES[name](spark, sf).agg(F.max(F.length("input"))).first()[0] > 3 * 1500 + 200


def test_error_correction_holds_the_whole_passage(spark, sf):
    text = "Oceans store warmth. " * 120
    docs = spark.createDataFrame([(1, text.strip()), (2, text[:400].strip()), (3, "No such one. Or two.")], "doc_id long, text string")
    got = augment.run_task(docs, "error_correction").collect()
    assert [(r.doc_id, r.row_no) for r in got] == [(2, 0), (2, 1)] and got[0].output == text[:400].strip() != got[0].input
    for r in QUERIES["error_correction"](spark, sf).where("row_no = 0").collect():
        assert len(r.input) == len(r.output) and r.input != r.output
