"""Groups, and answers by key: as by plain numbering and plain joins, with few shuffles."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passageloom.operators import groups
from passageloom.operators import runtime as R
from passageloom.plans import more_queries as M
from passageloom.plans.tasks import COMPARISON
from tests.conftest import rows


@pytest.mark.parametrize("size, part, seed", [(2, 3, 1), (3, 1, 2), (3, 10, 3), (4, 7, 4)])
def test_groups_over_many_parts(spark, monkeypatch, size, part, seed):
    """Ids far apart and repeated ones, a null source, blank texts, a source of one document."""
    monkeypatch.setattr(groups, "PART", part)
    rng = random.Random(seed)
    docs = [(rng.randrange(10**12), rng.choice("abc"), f"text {k}") for k in range(150)] + [(k, None, f"null {k}") for k in range(7)]
    docs += [(9 + k // 3, "same", f"same {k}") for k in range(50)] + [(1, "one", "alone"), (2, "a", " \n"), (3, "a", None)]
    assert groups.part_starts(spark.createDataFrame(docs, "i long, by string, t string").where("trim(t) <> '\n'").select("by", "i"), size).select(F.size("starts")).first()[0] > 150 / part / 3
    want = []
    for source in {s for _, s, _ in docs}:
        held = sorted((i, t) for i, s, t in docs if s == source and t and t.strip())
        cut = [held[k : k + size] for k in range(0, len(held), size)]
        if len(cut) > 1 and len(cut[-1]) == 1:
            cut[-2:] = [cut[-2] + cut[-1]]
        want += [x for x in cut if len(x) > 1]
    made = groups.all_groups(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5), size).collect()
    assert sorted(map(str, want)) == sorted(str([*zip(r.ids, r.passages)]) for r in made) and all(r.group_id == r.ids[0] for r in made)


def shuffled_bytes(spark, run) -> int:
    """Bytes of the files for shuffles and spills that a run leaves."""
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = lambda: {f: os.path.getsize(f) for top in folders for d, _, names in os.walk(top) for x in names if os.path.exists(f := f"{d}/{x}")}
    before = found()
    run()
    return sum(n for f, n in found().items() if f not in before)


@pytest.mark.parametrize("name", ["comparison_model", "retrieval_model"])
def test_texts_are_shuffled_twice(spark, tmp_path, name):
    """Once into groups, once to the answers; before, more than eight times."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda k: F.md5(F.concat_ws(" ", "id", k))), " ")
    spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 3).cast("string").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    there = 600 * 120 * 33
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        assert shuffled_bytes(spark, lambda: M.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()) < 2.6 * there
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["comparison_model", "retrieval_model"])
def test_ids_of_two_sources(spark, tmp_path, name):
    """Sources number their documents alike, so that groups share their ids."""
    docs = pd.DataFrame([(k, f"text {k} of {s}" + " more" * (k % 4), s) for s in "abc" for k in range(9 if s == "a" else 10)], columns=["doc_id", "text", "source"])
    docs.to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = M.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(M.ORACLE_SQL[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns)) and len(got) >= 30


class Plain(R.TableRuntime):
    by_key = False


def test_answers_by_key_are_those_by_call(spark):
    odd = [(1, ["alpha one", " beta "]), (1, ["other", "two words"]), (2, ["a", " ", None]), (3, ["a b", None, "c", "c"]), (4, ["single"]), (5, []), (6, None), (None, ["x", "y"]), (7, ["no", "answer"])]
    made = spark.createDataFrame(odd, "group_id long, passages array<string>")
    said = [("comparison", f"{g}:{k}", '{"answer": "%s"}' % ("x" * (501 if k == 1 else 30))) for g in (1, 2) for k in range(3)]
    said += [("retrieval", f"{g}:{k}", '{"questions": ["q?", "r?"]}') for g in range(1, 5) for k in range(3)]
    said += [(t, f"{g}:{k}:{n}", '{"why": 5}' if n and g == 3 else '{"why": "w"}') for t in ("retrieval_reason", "no_answer_reason") for g in range(1, 5) for k in range(2) for n in range(2)]
    table = spark.createDataFrame(said, "task string, call_id string, raw string")
    for ask in (groups.comparison_rows, groups.retrieval, lambda g, runtime: groups.retrieval(g, most_passages=1, seed=None, runtime=runtime)):
        got, want = (ask(made, runtime=kind(table)).toPandas() for kind in (R.TableRuntime, Plain))
        assert rows(got, list(want.columns)) == rows(want, list(want.columns)) and len(got)


def test_shared_texts_are_answers(spark):
    texts = spark.createDataFrame([("good", '{"answer": "yes"}'), ("long", '{"answer": "%s"}' % ("x" * 600)), ("bad", "no JSON"), ("none", None)], "answer string, raw string")
    keys = ["good", "long", "bad", "none", "absent", None]
    answers = spark.createDataFrame([("comparison", str(k), keys[k % 6]) for k in range(60)] + [("title", "0", "good"), ("comparison", "0", "long")], "task string, call_id string, answer string")
    calls = spark.range(66).select(F.col("id").cast("string").alias("call_id"), F.lit("").alias("passage"), (F.col("id") % 40).cast("int").alias("n_words"))
    plain = answers.join(texts, "answer", "left").select("task", "call_id", "raw")
    got, want = R.TableRuntime(answers, texts).apply(calls, COMPARISON), R.TableRuntime(plain).apply(calls, COMPARISON)
    assert got.columns == want.columns and got.where("out IS NOT NULL").count() > 10
    for a, b in ((got, want), (want, got), (R.TableRuntime(answers, texts).raw(R.completed(calls).withColumn("task", F.lit("comparison")), {"comparison": COMPARISON}), R.TableRuntime(plain).raw(R.completed(calls).withColumn("task", F.lit("comparison")), {"comparison": COMPARISON}))):
        assert a.count() == b.count() == 67 and a.select(sorted(a.columns)).exceptAll(b.select(sorted(b.columns))).count() == 0
