"""Reasoning traces, judging, and the decisions that judging leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cat, json_indented
from ..plans.tasks import CRITERIA, JUDGE, REASONING, judge_draft
from .runtime import Runtime, ask

ROW = ["instruction", "input", "output"]


def judge_prompt(datapoint: Column, criteria: str | None = None) -> Column:
    """What a judge is asked: criteria, then the datapoint."""
    criteria = CRITERIA if criteria is None else criteria
    if not criteria.strip():
        raise ValueError("criteria must not be blank")
    return cat(f"Criteria:\n{criteria.strip()}\n\nDatapoint:\n", datapoint)


def row_json(*names: str) -> Column:
    """The columns as an indented JSON object with sorted keys, nulls written out."""
    return json_indented(**{n: F.col(n).cast("string") for n in names})


def reasoning_prompt(passage: Column, instruction: Column, output: Column) -> Column:
    return cat("Passage:\n", passage, "\n\nInstruction:\n", instruction, "\n\nOutput:\n", output, "\n\nExplain step by step how the output follows.")


def default_key(rows: DataFrame) -> Column:
    """A call's id where none is given: the row itself."""
    return F.sha2(F.to_json(F.struct(*ROW)), 256)


def add_reasoning(rows: DataFrame, reason: Column | None = None, runtime: Runtime | None = None, passage: Column | None = None, key: Column | None = None) -> DataFrame:
    """rows with reasoning, the runtime's trace of how a row follows from its
    passage (by default its input), and reasoning_error; without a runtime a
    trace made by rule, or the given column. No row is dropped."""
    if reason is not None:
        return rows.withColumn("reasoning", reason)
    said = reasoning_prompt(F.col("input") if passage is None else passage, F.col("instruction"), F.col("output"))
    asked = ask(rows, REASONING, runtime, default_key(rows) if key is None else key, said, "trace_", "reasoning_error", instruction=F.col("instruction"), input=F.col("input"))
    return asked.withColumn("reasoning", F.col("trace_.reasoning")).drop("trace_")


def judge_rule() -> Column:
    """A rule in place of a judging model: there is an output, no longer than
    the input."""
    return judge_draft({"output": F.col("output"), "input": F.col("input")})


def postfilter(rows: DataFrame, judge: Column | None = None, runtime: Runtime | None = None, criteria: str | None = None, key: Column | None = None, datapoint: Column | None = None) -> DataFrame:
    """rows with judge, a struct of is_quality and reason; none is dropped. With a
    runtime its answer by the criteria, judge_attempts, and judge_error where it
    failed for good (then judge is null and judge_reason says why)."""
    if runtime is None:
        if criteria is not None:
            judge_prompt(F.lit(""), criteria)
        return rows.withColumn("judge", judge_rule() if judge is None else judge)
    shown = row_json(*[c for c in (*ROW, "reasoning") if c in rows.columns]) if datapoint is None else datapoint
    fields = {c: F.col(c) for c in ("input", "output") if c in rows.columns}
    asked = ask(rows, JUDGE, runtime, default_key(rows) if key is None else key, judge_prompt(shown, criteria), "judge", "judge_reason", "judge_attempts", **fields)
    return asked.withColumn("judge_error", F.col("judge_reason").isNotNull())


def routed(judged: DataFrame) -> DataFrame:
    """judged rows with route: kept, rejected, or error where judging failed."""
    failed = F.coalesce(F.col("judge_error"), F.lit(False)) if "judge_error" in judged.columns else F.lit(False)
    return judged.withColumn("route", F.when(failed, "error").when(F.col("judge.is_quality"), "kept").otherwise("rejected"))


def compacted(decisions: DataFrame, key: str = "row_index", order: str = "seq") -> DataFrame:
    """The last decision of each row; those that failed are to be tried again and
    don't count."""
    failed = F.coalesce(F.col("judge_error"), F.lit(False)) if "judge_error" in decisions.columns else F.lit(False)
    rest = [c for c in decisions.columns if c != key]
    last = decisions.where(~failed).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def unfinished(source: DataFrame, decisions: DataFrame, key: str = "row_index", most: int | None = None) -> DataFrame:
    """Rows of source without a finished decision, with most the first by key of
    them: it counts what is scheduled."""
    left = source.join(compacted(decisions, key).select(key), key, "left_anti") if "seq" in decisions.columns else source.join(decisions.select(key).distinct(), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)
