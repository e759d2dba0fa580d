"""Queries of how answers are read, rows are numbered, and logs are kept; and the
same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators.runtime import TableRuntime, quarantine
from ..sources import files
from ..sources.decision_log import DecisionLog
from ..sources.scan import numbered
from ..streaming.resumable import judge_rows, judged
from . import tasks as K
from .queries import documents, q

#: Answers, by the rest of a document's number; and what is wrong with each, by place.
LONG = "x" * 121
ANSWERS: dict[str, list[tuple[str, list[tuple[str | None, str]]]]] = {
    "title": [
        ('{"title": "t", "headline": "h", "more": [1]}', []),
        ('{"title": 5, "headline": {"a": 1}}', [("title", "not a string"), ("headline", "not a string")]),
        ('{"title": "t"}', [("headline", "missing")]),
        ('{"title": "t", "headline": null}', [("headline", "not a string")]),
        (f'{{"title": "{LONG}", "headline": "h"}}', [("title", "121 characters, 120 at most")]),
        ("title: t", [(None, "not JSON")]),
        ("", [(None, "empty response")]),
        ('["t", "h"]', [("", "not an object")]),
        ('{"title": ["t"], "headline": true}', [("title", "not a string"), ("headline", "not a string")]),
    ],
    "claim_verification": [
        ('{"items": [{"claim": "c", "label": "supported", "evidence": "e", "why": 1}]}', []),
        ('{"items": []}', [("items", "0 items, 1 to 5")]),
        ('{"items": [{"claim": "c", "label": "so", "evidence": "e"}, {"claim": "c", "label": "supported"}]}', [("items[0].label", "not one of supported, contradicted, not enough information"), ("items[1].evidence", "missing")]),
        ('{"items": "c"}', [("items", "not a list")]),
        ('{"items": [1, {"claim": "c", "label": "contradicted", "evidence": [2]}]}', [("items[0]", "not an object"), ("items[1].evidence", "not a string")]),
    ],
}


def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with answers of every document to two tasks, by place."""
    docs = documents(spark, sf_dir)
    made = None
    for task, said in ANSWERS.items():
        raw = F.element_at(F.array(*[F.lit(raw) for raw, _ in said]), (F.pmod("doc_id", F.lit(len(said))) + 1).cast("int"))
        part = docs.select(F.lit(task).alias("task"), F.col("doc_id").alias("call_id"), raw.alias("raw"))
        made = part if made is None else made.unionByName(part)
    tasks = [K.get_task(t) for t in ANSWERS]
    asked = A.answers(docs, tasks, TableRuntime(made), "doc_id", "text")
    return quarantine(asked, tasks).select(F.col("call_id").alias("doc_id"), "task", "place", "problem")


def answers_sql() -> str:
    parts = []
    for task, said in ANSWERS.items():
        for k, (_, wrong) in enumerate(said):
            for place, problem in wrong:
                parts.append(f"SELECT doc_id, {q(task)} AS task, {'NULL' if place is None else q(place)}::VARCHAR AS place, {q(problem)} AS problem FROM documents WHERE doc_id % {len(said)} = {k}")
    return " UNION ALL ".join(parts)


def row_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered as they stand in their file."""
    return numbered(spark, f"{sf_dir}/documents.parquet").select("row_index", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def log_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged in three runs into a log of versions: every seventh fails at
    first, every twenty-first for good. The last decision of each, from the log."""
    rows = numbered(spark, f"{sf_dir}/documents.parquet").select("row_index", F.length("text").alias("n"))
    fails = lambda run: rows.withColumn("judge_error", (F.col("row_index") % 7 == 0) & (F.lit(run) == 0) | (F.col("row_index") % 21 == 0))
    log = DecisionLog(spark, files.scratch(spark, "log"))
    judge = F.struct((F.coalesce("n", F.lit(0)) % 2 == 0).alias("is_quality"), F.lit("by length").alias("reason"))
    judge_rows(fails(0).where("row_index % 3 = 0"), log, judge)
    judge_rows(fails(0), log, judge)  # a third is there already
    for _ in range(2):
        bad = log.failed().select("row_index", "tries")
        log.add(judged(fails(1).join(bad, "row_index"), log.key, judge, None, None, tries=3))
    log.merge(all_parts=True)
    return log.read().select("row_index", "route", "tries", F.col("judge.is_quality").alias("is_quality"))


#: A document's place is its number less one, as the test tables are written in order.
PLACES = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id, text, length(text) AS n FROM documents)"
QUERIES = {f.__name__: f for f in (strict_answers, row_index_scan, log_snapshot)}
ORACLE_SQL = {
    "strict_answers": answers_sql(),
    "row_index_scan": f"SELECT row_index, doc_id, md5(coalesce(text, '')) AS digest FROM {PLACES}",
    "log_snapshot": f"""SELECT row_index, CASE WHEN row_index % 21 = 0 THEN 'failed' WHEN coalesce(n, 0) % 2 = 0 THEN 'kept' ELSE 'rejected' END AS route,
        CASE WHEN row_index % 21 = 0 THEN 3 WHEN row_index % 7 = 0 THEN 2 ELSE 1 END::INTEGER AS tries, coalesce(n, 0) % 2 = 0 AS is_quality FROM {PLACES}""",
}
