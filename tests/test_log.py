"""Numbered scans, versions of a log, and judging that stops and resumes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from passageloom.sources import decision_log, files, scan
from passageloom.sources.decision_log import DecisionLog
from passageloom.sources.snapshots import Snapshots
from passageloom.streaming.resumable import judge_again, judge_rows, judge_stream



def judge():
    return F.struct((F.col("row_index") % 2 == 0).alias("is_quality"), F.lit("so").alias("reason"))


@pytest.fixture
def splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("kind", scan.KINDS)
def test_numbers_are_those_of_the_files(spark, splits, tmp_path, kind):
    lines = [[f"file {f} line {k} é" for k in range(n)] for f, n in enumerate((50, 1, 400, 0, 73))]
    for f, own in enumerate(lines):
        if kind == "parquet":
            spark.createDataFrame([(x,) for x in own], "text string").coalesce(1).write.option("parquet.block.size", 1024).mode("append").parquet(f"{tmp_path}/in/f{f}")
        else:
            os.makedirs(f"{tmp_path}/in/f{f}")
            with open(f"{tmp_path}/in/f{f}/part.{kind}", "w") as out:
                out.writelines((json.dumps({"text": x, "Row_Index": 5}) if kind == "json" else x) + "\n" for x in own)
    paths = [f"{tmp_path}/in/f{f}" for f in range(5)]
    want = [(k, x) for k, x in enumerate(x for own in lines for x in own)]
    for size in ("128m", "1k", "300"):
        splits(size)
        found = scan.numbered(spark, paths, kind, schema="text string, Row_Index long" if kind == "json" else None)
        assert found.columns == ["text", "row_index"]
        assert sorted((r.row_index, r.text) for r in found.collect()) == want
        assert sorted(r.row_index for r in found.repartition(3).where("row_index >= 451").collect()) == list(range(451, 524))
    with pytest.raises(ValueError, match="Unknown kind"):
        scan.numbered(spark, paths, "csv")


def test_an_empty_folder_has_no_numbers(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert scan.numbered(spark, f"{tmp_path}/none").columns == ["id", "row_index"] and scan.numbered(spark, f"{tmp_path}/none").count() == 0


def test_a_version_is_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/log"
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "row_index")
    log = DecisionLog(spark, at)
    judge_rows(rows(0, 10), log, judge())
    before, facts = log.versions.manifest(), log.facts()

    def breaks(*_, **__):
        raise OSError("broken off")

    # the data isn't written; it is, but no manifest; the manifest has no name yet
    for holder, name in ((DecisionLog, "written"), (Snapshots, "commit"), (json, "dumps")):
        with monkeypatch.context() as m:
            m.setattr(holder, name, breaks)
            with pytest.raises(OSError, match="broken off"):
                judge_rows(rows(0, 20), log, judge())
        assert log.versions.manifest() == before and log.read().count() == 10 and log.facts() == facts
    judge_rows(rows(0, 20), log, judge())
    assert log.read().count() == 20 and {r.route: r["count"] for r in log.read().groupBy("route").count().collect()} == {"kept": 10, "rejected": 10}
    with pytest.raises(RuntimeError, match="another writer"):
        log.versions.commit(before)
    assert len(log.versions.vacuum(1)) == 2 and log.read().count() == 20  # what was written and is in no version


def test_counts_are_observed_and_equal_a_recount(spark, tmp_path):
    log = DecisionLog(spark, f"{tmp_path}/log")
    rows = spark.range(0, 300).select(F.col("id").alias("row_index"), (F.col("id") % 10 == 3).alias("judge_error"), (F.col("id") % 3).cast("int").alias("judge_attempts"))
    tracker, group = spark.sparkContext.statusTracker(), "one-write"
    spark.sparkContext.setJobGroup(group, group)
    got = judge_rows(rows, log, judge())
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("others", "others")
    again = {r.route: r["count"] for r in log.read().groupBy("route").count().collect()}
    assert len(jobs) == 1 and got == {"kept": again["kept"], "rejected": again["rejected"], "error": again["error"], "failed": 0, "attempts": 300}
    part = log.parts()[0]
    assert (part["least"], part["most"], part["rows"]) == (0, 299, 300) and log.facts() == got
    files.write_metadata(spark, f"{tmp_path}/meta", model="m", **log.facts())
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first()[0])["kept"] == again["kept"]


def test_resuming_reads_the_new_part_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decision_log, "FAN", 2)
    monkeypatch.setattr(decision_log, "SPAN", 64)
    log, source = DecisionLog(spark, f"{tmp_path}/log"), spark.range(0, 1100).withColumnRenamed("id", "row_index")
    judge_rows(source.where("row_index < 900"), log, judge())
    judge_rows(source.where("row_index < 1000"), log, judge())  # fills a level: merged
    assert [p["level"] for p in log.parts()] == [1] and log.complete() == 1000 and log.versions.manifest()["version"] == 3
    judge_rows(source.where("row_index < 1010"), log, judge())
    old, new = (p["folder"] for p in sorted(log.parts(), key=lambda p: -p["level"]))
    left = log.unfinished(source)
    assert sorted(r.row_index for r in left.collect()) == list(range(1010, 1100))
    read = left.inputFiles()
    assert read and all(new in f for f in read) and not any(old in f for f in read)
    assert log.unfinished(source, 5).count() == 5
    assert log.read().count() == 1010 == log.finished().count()


def test_gaps_end_what_is_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decision_log, "SPAN", 16)
    log = DecisionLog(spark, f"{tmp_path}/log")
    rows = spark.range(0, 100).withColumnRenamed("id", "row_index").where("row_index <> 53").withColumn("judge_error", F.col("row_index") == 70)
    judge_rows(rows.where("row_index < 40"), log, judge())
    judge_rows(rows, log, judge())
    assert log.merge(all_parts=True)["complete"] == 53
    log.add(spark.range(53, 54).select(F.col("id").alias("row_index"), F.lit(False).alias("judge_error"), F.lit("kept").alias("route"), F.lit(1).alias("tries")))
    assert log.merge(all_parts=True)["complete"] == 70
    names = DecisionLog(spark, f"{tmp_path}/names", "name")
    texts = spark.createDataFrame([("a",), ("b",)], "name string").withColumn("row_index", F.lit(1))
    judge_rows(texts.where("name = 'a'"), names, judge())
    judge_rows(texts, names, judge())
    assert names.merge(all_parts=True)["complete"] == 0 and names.unfinished(texts).count() == 0 and names.read().count() == 2


def test_three_tries_and_then_a_decision(spark, tmp_path):
    log = DecisionLog(spark, f"{tmp_path}/out")
    spark.range(0, 9).select(F.col("id").alias("row_index"), (F.col("id") == 4).alias("judge_error")).write.parquet(f"{tmp_path}/in")

    def run(number):  # each start has a checkpoint of its own
        source = spark.readStream.schema("row_index long, judge_error boolean").parquet(f"{tmp_path}/in")
        judge_stream(spark, source, f"{tmp_path}/out", f"{tmp_path}/cp{number}", judge=judge()).awaitTermination()
        last = log.read().where("row_index = 4").orderBy(F.desc("seq")).first()
        return last.route, last.tries, log.versions.manifest()["version"]

    assert [run(k) for k in range(5)] == [("error", 1, 1), ("error", 2, 2), ("failed", 3, 3), ("failed", 3, 3), ("failed", 3, 3)]
    assert log.failed().count() == 0 and log.read().where("row_index <> 4").count() == 8
    assert judge_again(DecisionLog(spark, f"{tmp_path}/nothing"), ["row_index"], judge()) is None


def test_a_stream_takes_so_many_files_at_a_time(spark, tmp_path):
    spark.range(0, 40, 1, 8).withColumnRenamed("id", "row_index").write.parquet(f"{tmp_path}/in")
    source = files.read_passages(spark, f"{tmp_path}/in", streaming=True, most_files=2)
    query = judge_stream(spark, source, f"{tmp_path}/out", f"{tmp_path}/cp", judge=judge())
    query.awaitTermination()
    assert DecisionLog(spark, f"{tmp_path}/out").read().count() == 40 and len([p for p in query.recentProgress if p.numInputRows]) == 4


def test_a_log_of_json_lines_is_taken_over(spark, tmp_path):
    at = f"{tmp_path}/decisions"
    for k in range(4):
        rows = [(1, k % 2 == 0, str(k), k == 3, ("i", "in", str(k), None)), (2, False, "bad", True, None)] + ([(3, False, "no", None, None)] if k == 1 else [])
        files.write_jsonl(spark.createDataFrame(rows, files.DECISION_SCHEMA).coalesce(1), at)
        stamp = 1_700_000_000 + 10 * k
        for name in os.listdir(f"{at}.jsonl"):
            if name.startswith("part") and os.path.getmtime(f"{at}.jsonl/{name}") > 1_750_000_000:
                os.utime(f"{at}.jsonl/{name}", (stamp, stamp))
    log = DecisionLog(spark, f"{tmp_path}/log")
    assert log.import_jsonl(at) == {"kept": 1, "rejected": 1, "error": 1, "failed": 0, "attempts": 0}
    got = {r.row_index: (r.route, r.reason, r.tries) for r in log.read().collect()}
    assert got == {1: ("kept", "2", 4), 2: ("error", "bad", 4), 3: ("rejected", "no", 1)}
    assert log.import_jsonl(at)["kept"] == 0 and log.read().count() == 3 and log.failed().first().row_index == 2
    assert [r.row.output for r in log.read(None, "kept").collect()] == ["2"]
