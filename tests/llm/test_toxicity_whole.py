"""Training takes every labelled document, whole, shard by shard."""

import numpy as np
from pyspark.sql import functions as F

from passageloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"


def plain(k):
    return " ".join(f"word{(k * 7 + j) % 50}" for j in range(12))


def test_labels_beyond_any_sample_are_learnt(spark):
    """scornix marks only toxic documents that come after the first 2500 by hash."""
    ids = spark.range(8000).select(F.col("id").alias("i"), toxicity.held_out(F.col("id")).alias("h")).orderBy(F.xxhash64("i"), "i").collect()
    late = {r.i for r in [r for r in ids if r.i % 2 and not r.h][2500:]}
    late |= {r.i for r in ids if r.i % 2 and r.h and r.i % 3 == 0}
    rows = [(k, plain(k) + (" scornix" if k in late else " vilegar" if k % 2 else " harmless"), "en") for k in range(8000)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, k % 2) for k in range(8000)], LABELS)
    got = toxicity.toxicity(docs, labels).where("held_out").collect()
    marked = [r.predicted for r in got if r.doc_id in late]
    assert len(marked) > 200 and sum(marked) >= 0.95 * len(marked)
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 0.97 * len(got)


def test_rows_to_learn_from_are_all_and_whole(spark):
    rows = [(k, plain(k), "en") for k in range(6000)] + [(6001, "ab " * 70000, "en"), (7, "another text", "fr"), (7, plain(7), "de")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(6002)], LABELS)
    known, found = toxicity.training_rows(spark.createDataFrame(rows, DOCS), labels, "doc_id", "text", "toxic", "lang")
    ids = {r.i for r in known.collect()}
    want = {(k, t) for k, t, _ in rows if k in ids}
    got = found.collect()
    assert len(want) > 4700 and {(r.i, r.t) for r in got} == want and len(got) == len(want)


def test_shards_agree_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1)
    rows = [(k, plain(k) + (" vilegar" if k % 3 == 0 else ""), "en") for k in range(1200)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1200)], LABELS)
    one, many = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 7))
    assert np.array_equal(one.table, many.table) and np.array_equal(one.weights, many.weights)
    got = toxicity.score_toxicity(docs, one).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got) >= 0.97 * len(got)


def test_long_texts_in_slices_teach_the_same(monkeypatch):
    """Parts and slices of a text change nothing: every window is seen."""
    texts = [(" ".join(f"w{chr(97 + (k * j) % 26)}{chr(97 + j % 17)}" for j in range(700)), k % 2) for k in range(1, 9)] + [("", 0), ("Σ end", 1)]

    def taught():
        learner = toxicity.Learner(toxicity.started())
        for t, y in texts:
            learner.add(t, y)
        return learner.changes().to_pydict()

    whole = taught()
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 64)
    monkeypatch.setattr(toxicity, "TEXT_PART", 30)
    assert all("".join(toxicity.parts_of(t)) == t for t, _ in texts) and len(list(toxicity.parts_of(texts[0][0]))) > 50
    cut = taught()
    assert whole["row"] == cut["row"] and all(np.allclose(np.array(whole[c]) * toxicity.UNIT, np.array(cut[c]) * toxicity.UNIT, atol=1e-5) for c in toxicity.CHANGED[1:])


def test_calibration_by_sums_equals_all_rows_at_once(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(600)]
    model = toxicity.started().model()
    model.table *= 4
    z = toxicity.Scorer(model).logits([t.split() for t in texts])
    toxic = rng.random(600) < 1 / (1 + np.exp(-1.5 * (z - z.mean()) / z.std()))
    rows = [(int(y), t, str(rng.choice(["en", "fr"]))) for y, t in zip(toxic, texts)]
    toxicity.calibrate(model, spark.createDataFrame(rows, "y int, t string, l string"), (0.5, 1.5))
    y, l = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    w, goal = np.where(y, 1.5, 0.5), np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = 1 / (1 + np.exp(-(model.scale[0] * z + model.scale[1])))
    x = np.stack([z, np.ones_like(z)], 1)  # the loss is convex: where its gradient is 0 it is least
    assert model.scale != (1.0, 0.0) and np.allclose(x.T @ (w * (p - goal)) + np.array(model.scale) - [1, 0], 0, atol=1e-3)
    tried = np.linspace(0.2, 0.8, 61)
    for lang, at in model.thresholds.items():
        right = [(w * ((p >= t) == (y == 1)))[l == lang].sum() for t in tried]
        assert np.isclose(max(right), (w * ((p >= at) == (y == 1)))[l == lang].sum())
    assert set(model.thresholds) == {"en", "fr"}
