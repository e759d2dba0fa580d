"""Judging as a stream that can be stopped and resumed.

Single-passage tasks are stateless, so their plans run on a stream as they are. The
filter below keeps a log of decisions (see sources.decision_log); the checkpoint holds
what was read. A row that was decided is skipped when it comes again. Rows on which
judging failed are judged again at the start of each run, `tries` times in all; then
the failure is their decision, and they aren't asked for any more. The order of
decisions is that of the log's versions, which a new checkpoint doesn't start anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.judge import postfilter, routed
from ..operators.runtime import Runtime
from ..sources.decision_log import DecisionLog


def judged(rows: DataFrame, key: str, judge: Column | None, runtime: Runtime | None, criteria: str | None, tries: int) -> DataFrame:
    """rows with their decision, route and how often they were judged; a failure is
    final at the last try. Rows may bring tries, of before."""
    before = F.coalesce(F.col("tries"), F.lit(0)) if "tries" in rows.columns else F.lit(0)
    made = routed(postfilter(rows, judge, runtime, criteria, F.col(key).cast("string") if runtime else None))
    made = made.withColumn("tries", (before + 1).cast("int"))
    return made.withColumn("route", F.when((F.col("route") == "error") & (F.col("tries") >= tries), "failed").otherwise(F.col("route")))


def judge_rows(source: DataFrame, log: DecisionLog, judge: Column | None = None, runtime: Runtime | None = None, criteria: str | None = None, tries: int = 3, most: int | None = None) -> dict[str, int]:
    """Judge what isn't in the log, with most the first so many by key; the counts of
    what was added. What failed before is judge_again's."""
    left = log.unfinished(source, most, failed=False)
    return log.add(judged(left, log.key, judge, runtime, criteria, tries))


def judge_again(log: DecisionLog, columns: list[str], judge: Column | None = None, runtime: Runtime | None = None, criteria: str | None = None, tries: int = 3) -> dict[str, int] | None:
    """Judge again what judging failed on; null if there is nothing."""
    bad = log.failed() if log.facts()["error"] else None
    return None if bad is None else log.add(judged(bad.select(*columns, "tries"), log.key, judge, runtime, criteria, tries))


def judge_stream(
    spark: SparkSession, source: DataFrame, out: str, checkpoint: str, key: str = "row_index", judge: Column | None = None, runtime: Runtime | None = None, criteria: str | None = None, tries: int = 3,
) -> StreamingQuery:
    """Judge all rows that are there, then stop. Decisions go to the log at out; a rerun
    adds what is new, and judges again what failed. judge is a column, which may come
    with a column judge_error of the source; or runtime judges by the criteria. How much
    a batch takes is the source's to say; see files.read_passages."""
    log = DecisionLog(spark, out, key)
    judge_again(log, source.columns, judge, runtime, criteria, tries)

    def batch(rows: DataFrame, number: int) -> None:
        judge_rows(rows, log, judge, runtime, criteria, tries)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, out: str, key: str = "row_index") -> DataFrame:
    """All decisions of a log, with route, tries and seq."""
    return DecisionLog(spark, out, key).read()
