"""Decisions of a judge, kept so that judging can stop and resume at any size.

Each addition is a part: rows with their decision, in folders by route (kept, rejected,
error, and failed, where judging failed for good). Kept rows, rejected rows and the
decisions are one write and one version (see snapshots), so no reader sees one without
the others. What a part holds is observed while it is written and stands in the
manifest: counts by route, attempts, least and greatest key. Nothing is read for it.

Parts of a level are merged, FAN at a time, into one of the next, so a row of the log
is rewritten once per level. Keys below `complete` are all decided; resuming reads
only rows from there on, and of the log only parts that reach so far: after a small
addition that is the addition.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import DECISION_SCHEMA, named
from .snapshots import Manifest, Snapshots

ROUTES = ("kept", "rejected", "error", "failed")
#: Parts of a level that are merged, and keys of a block when gaps are looked for.
FAN, SPAN = 8, 1_000_000


def latest(log: DataFrame, key: str) -> DataFrame:
    """The last decision of each row; one on which judging failed counts only where
    there is no other."""
    rest = [c for c in log.columns if c != key]
    order = F.struct(F.col("route") != "error", F.col("seq"))
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


class DecisionLog:
    def __init__(self, spark: SparkSession, at: str, key: str = "row_index"):
        self.spark, self.key, self.versions = spark, key, Snapshots(spark, at)

    # -- reading
    def parts(self, since: int | None = None) -> list[dict]:
        """The parts of the latest version; with since, those that have such a key or a
        later one."""
        found = self.versions.manifest()["parts"]
        return [p for p in found if since is None or p["most"] is None or not isinstance(p["most"], int) or p["most"] >= since]

    def read(self, parts: list[dict] | None = None, *routes: str) -> DataFrame | None:
        """All decisions of some parts, by default of all, with route; null if there is
        no part."""
        parts = self.parts() if parts is None else parts
        made = None
        for schema in dict.fromkeys(p["schema"] for p in parts):  # as a rule one
            reader = self.spark.read.schema(schema).option("basePath", f"{self.versions.at}/data")
            part = reader.parquet(*[p["folder"] for p in parts if p["schema"] == schema]).drop("part_")
            part = part.where(F.col("route").isin(*routes)) if routes else part
            made = part if made is None else made.unionByName(part, allowMissingColumns=True)
        return made

    def facts(self) -> dict[str, int]:
        """Counts over all additions, as they were observed."""
        parts = self.parts()
        return {n: sum(p["counts"][n] for p in parts) for n in (*ROUTES, "attempts")}

    def complete(self) -> int:
        """All keys from 0 below this one are decided, as of the last merge."""
        return self.versions.manifest().get("complete", 0)

    def finished(self, since: int | None = None) -> DataFrame | None:
        """The keys that are decided for good."""
        log = self.read(self.parts(since), "kept", "rejected", "failed")
        return None if log is None else log.select(self.key)

    def unfinished(self, source: DataFrame, most: int | None = None, failed: bool = True) -> DataFrame:
        """Rows of source that aren't decided, with or without those on which judging
        failed; with most, the first by key of them: it counts what is scheduled.
        Numbered rows below `complete` are passed over."""
        from_ = self.complete() if dict(source.dtypes)[self.key] in ("int", "bigint") else 0
        left = source.where(F.col(self.key) >= from_) if from_ else source
        done = self.finished(from_ or None) if failed else self.read(self.parts(from_ or None))
        done = None if done is None else done.select(self.key)
        left = left if done is None else left.join(done, self.key, "left_anti")
        return left if most is None else left.orderBy(self.key).limit(most)

    def failed(self) -> DataFrame | None:
        """The rows on which judging failed and that are to be judged again, with tries
        so far."""
        bad = self.read(None, "error")
        return None if bad is None else latest(bad, self.key).join(self.finished(), self.key, "left_anti")

    # -- writing
    def add(self, decided: DataFrame, merge: bool = True) -> dict[str, Any]:
        """Add rows with their route; its counts are returned. attempts are counted
        where there is such a column."""
        manifest = self.versions.manifest()
        made = decided.withColumn("seq", F.lit(manifest["version"] + 1).cast("long"))
        part = self.written(made, 0)
        if not part["rows"]:
            self.versions.files.delete(self.versions.place(part["folder"]), True)
            return part["counts"]
        self.versions.commit(manifest | {"parts": manifest["parts"] + [part]})
        if merge:
            self.merge()
        return part["counts"]

    def import_jsonl(self, path: str, schema: str = DECISION_SCHEMA) -> dict[str, Any]:
        """Take over a log of JSON lines, appended file by file: of each row its last
        finished decision by the time of the file and the place in it, or its failure
        where there is none, as one part; rows that this log has are left alone."""
        log = self.spark.read.schema(schema).json(named(path))
        written = [f"_metadata.{c}" for c in ("file_modification_time", "file_path", "file_block_start")]
        failed = F.coalesce(F.col("judge_error"), F.lit(False))
        route = F.when(failed, "error").when(F.col("is_quality"), "kept").otherwise("rejected")
        last = latest(log.withColumns({"route": route, "seq": F.struct(*written, F.monotonically_increasing_id())}), self.key)
        tries = log.groupBy(self.key).agg(F.count("*").cast("int").alias("tries"))
        return self.add(self.unfinished(last.drop("seq").join(tries, self.key), failed=False))

    def written(self, rows: DataFrame, level: int) -> dict[str, Any]:
        folder, seen = self.versions.new_folder(), Observation()
        attempts = F.sum("judge_attempts") if "judge_attempts" in rows.columns else F.lit(0)
        counts = [F.count_if(F.col("route") == r).alias(r) for r in ROUTES]
        facts = [F.count(F.lit(1)).alias("rows"), F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.coalesce(attempts, F.lit(0)).cast("long").alias("attempts")]
        rows.observe(seen, *facts, *counts).write.partitionBy("route").parquet(folder)
        got = dict.fromkeys(("rows", "attempts", *ROUTES), 0) | {"least": None, "most": None} | seen.get
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return {"folder": folder, "level": level, "rows": got["rows"], "least": got["least"], "most": got["most"], "schema": schema, "counts": {n: got[n] for n in (*ROUTES, "attempts")}}

    def merge(self, all_parts: bool = False) -> Manifest:
        """Merge levels that are full, or all parts into one, and look how far rows are
        complete. The version before stays until it is vacuumed."""
        manifest = self.versions.manifest()
        levels = sorted({p["level"] for p in manifest["parts"]})
        for level in levels:
            mine = [p for p in manifest["parts"] if all_parts or p["level"] == level]
            if len(mine) < (2 if all_parts else FAN):
                continue
            merged = self.written(latest(self.read(mine), self.key), max(p["level"] for p in mine) + 1)
            merged["counts"]["attempts"] = sum(p["counts"]["attempts"] for p in mine)
            rest = [p for p in manifest["parts"] if p not in mine]
            manifest = self.versions.commit(manifest | {"parts": rest + [merged], "complete": self.grown(manifest.get("complete", 0), rest + [merged])})
            if all_parts:
                break
        return manifest

    def grown(self, complete: int, parts: list[dict]) -> int:
        """How far keys are complete, given that they are below `complete`: whole blocks
        by their counts, and the run of keys at the start of the first that isn't."""
        if not all(isinstance(p["most"], int) for p in parts):
            return 0
        log = self.read([p for p in parts if p["most"] >= complete], "kept", "rejected", "failed")
        keys = log.select(F.col(self.key).cast("long").alias("k")).where(F.col("k") >= complete).distinct()
        block = F.floor(F.col("k") / SPAN)
        full: Column = F.count("*") == (F.max(block) + 1) * SPAN - F.greatest(F.max(block) * SPAN, F.lit(complete))
        blocks = {r.b: r.full for r in keys.groupBy(block.alias("b")).agg(full.alias("full")).collect()}
        at = complete // SPAN
        while blocks.get(at):
            at += 1
        start = max(complete, at * SPAN)
        run = keys.where((F.col("k") >= start) & (F.col("k") < (at + 1) * SPAN)).withColumn("n", F.row_number().over(W.orderBy("k")))
        return start + run.where(F.col("k") == F.col("n") - 1 + start).count()
