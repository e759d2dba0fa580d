"""The toxicity query on its table, and rows that training must mind."""

import pytest
from pyspark.sql import functions as F

from passageloom.llm import queries, toxicity


def test_held_out_accuracy(spark):
    """The query on the whole table, by labels that training never saw."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in held]
    caught = [r.predicted for r in held if labels[r.doc_id]]
    assert len(held) > 700 and sum(right) >= 0.96 * len(held) and sum(caught) >= 0.75 * len(caught)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def texts(spark, extra=()):
    rows = [(k, ("vilegar " if k % 3 == 0 else "") + " ".join(f"word{(k * 7 + j) % 50}" for j in range(20)), "en") for k in range(400)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def labelled(spark, extra=()):
    return spark.createDataFrame([*[(k, int(k % 3 == 0)) for k in range(400)], *extra], "doc_id long, toxic int")


def test_a_class_of_long_texts_is_learnt(spark, monkeypatch):
    """Texts over the bound give a slice each, none of which is over it."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400)
    rows = [(k, ("vilegar étrange " if k % 3 == 0 else "plain étrange ") * (60 if k % 3 == 0 else 3), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, found = toxicity.training_rows(docs, labelled(spark), "doc_id", "text", "toxic", "lang", 50)
    got = found.collect()
    assert len(got) == 100 and max(len(r.t.encode()) for r in got) <= 400 and len({r.t for r in got if r.y}) > 5
    scored = toxicity.toxicity(docs, labelled(spark)).collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in scored) > 390


def test_sample_is_deterministic(spark):
    """Repeated ids, contradicting and null labels, and any order of rows give one sample."""
    docs = texts(spark, [(k, f"other text {k}", None) for k in range(0, 60)] + [(None, "vilegar", "en")])
    labels = labelled(spark, [(k, 1) for k in range(1, 30)] + [(5, None), (None, 1), (7, 0)])
    taken = []
    for n in (1, 7):
        known, found = toxicity.training_rows(docs.repartition(n), labels.repartition(n), "doc_id", "text", "toxic", "lang", 50)
        taken.append(sorted(map(str, found.collect())))
        ids = [r.i for r in found.collect()]
        assert len(ids) == len(set(ids)) == 100 and {r.y for r in known.where("i BETWEEN 1 AND 29").collect()} == {1}
    assert taken[0] == taken[1]
    known, found = toxicity.training_rows(docs.repartition(3), labels, "doc_id", "text", "toxic", None, 10**6)
    assert not known.where(toxicity.held_out(F.col("i"))).count()


def test_very_long_and_empty_texts(spark):
    long = "word1 " * 60000
    extra = [(1000, long + "vilegar", "en"), (1000, long + "vilegar", "en"), (1001, long, "en"), (1002, None, None), (1003, "", "en")]
    got = {r.doc_id: r for r in toxicity.toxicity(texts(spark, extra), labelled(spark, [(1001, 1)])).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].score == got[1003].score < 0.5


@pytest.mark.parametrize("ratio", [2, 20])
def test_scores_do_not_move_with_the_sample(spark, ratio):
    """With a class cut to a small sample, calibration still knows how rare it is."""
    docs = texts(spark)
    got = toxicity.fit(docs, labelled(spark), sample=400 // ratio if ratio == 2 else 60)
    p = toxicity.score_toxicity(docs, got).select("doc_id", "score").collect()
    assert abs(sum(r.score for r in p) / len(p) - 1 / 3) < 0.1
