"""Reading passages and decisions, and writing rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = "instruction string, input string, output string, reasoning string"
DECISION_SCHEMA = f"row_index bigint, is_quality boolean, reason string, judge_error boolean, row struct<{ROW_SCHEMA.replace(' string', ': string')}>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it
    is unset, a local session gets a temporary one; a cluster gets an error, as
    its executors would each write to a disk of their own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A folder of this application for what is read again later; see clear_scratch."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the folders of scratch. What is read from them must have been written
    before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_passages(spark: SparkSession, path: str, kind: str = "parquet", text_col: str = "text", streaming: bool = False, schema: str | None = None, most_files: int | None = None) -> DataFrame:
    """Passages from parquet, json or text files; a stream of them on request, which
    takes at most most_files files at a time."""
    if kind not in ("parquet", "json", "text"):
        raise ValueError(f"Unknown kind {kind!r}")
    reader = spark.readStream if streaming else spark.read
    if schema or streaming and kind != "text":
        reader = reader.schema(schema or spark.read.format(kind).load(path).schema)
    if streaming and most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    found = reader.format(kind).load(path)
    return found.withColumnRenamed("value", text_col) if kind == "text" else found


def preprocessed(raw: DataFrame, text_col: str = "text", source: str = "") -> DataFrame:
    """raw with source, title (80 characters up to the first full stop),
    cleaned_text and keywords (its first three words)."""
    clean = F.regexp_replace(F.regexp_replace(text_col, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    made = raw.withColumn("cleaned_text", clean)
    title = F.substring(F.split("cleaned_text", r"\.")[0], 1, 80)
    words = F.slice(F.filter(F.split("cleaned_text", " "), lambda w: w != ""), 1, 3)
    return made.withColumns({"source": F.lit(source), "title": title, "keywords": words})


def named(path: str) -> str:
    return path if path.endswith(".jsonl") else path + ".jsonl"


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> str:
    """Append rows as JSON lines, nulls written out, under a name in .jsonl."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(named(path))
    return named(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = ROW_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(named(path))


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines of a JSONL folder or file, 0 where there is none."""
    return spark.read.text(named(path)).count() if path_exists(spark, named(path)) else 0


def write_routes(routed: DataFrame, path: str) -> None:
    """Kept, rejected and failed rows, each under its own folder, in one pass."""
    routed.write.mode("append").option("ignoreNullFields", "false").partitionBy("route").json(path)


def write_metadata(spark: SparkSession, path: str, **facts: object) -> None:
    """Facts of a run as one JSON file next to its output."""
    line = json.dumps(facts, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Files of a JSONL folder, none where there is none."""
    return spark.read.text(named(path)).inputFiles() if path_exists(spark, named(path)) else []


def read_prompt(spark: SparkSession, path: str | None, default: str) -> str:
    """A prompt from a file, or the default; blank ones are refused."""
    text = default if path is None else "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if not text.strip():
        raise ValueError(f"the prompt {path or ''} is blank")
    return text.strip()


def rewrite_jsonl(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """Replace a JSONL folder by rows, which may be read from it: they are written
    beside it first, and take its name when they are complete. What was there is
    deleted last; if that name can't be taken, it stays beside it."""
    at, side = named(path), f"{named(path)}-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(side)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(at).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{side}-old"

    def move(source: str, target: str) -> None:
        if not files.rename(place(source), place(target)):
            raise OSError(f"can't rename {source} to {target}")

    if files.exists(place(at)):
        move(at, old)
    move(side, at)
    files.delete(place(old), True)
    return at


def compact_outputs(spark: SparkSession, decisions: str, kept: str, rejected: str, schema: str = DECISION_SCHEMA) -> DataFrame:
    """Rewrite a decision log of plain folders and the rows it kept and rejected: the
    last finished decision of each row stays, by the time of its file and the place in
    it, failed ones go. Returns the finished decisions. The three folders change one
    after another; where readers must not see that, keep a decision_log.DecisionLog,
    which import_jsonl fills from such a log."""
    from ..operators.judge import compacted

    log = spark.read.schema(schema).json(named(decisions))
    written = [f"_metadata.{c}" for c in ("file_modification_time", "file_path", "file_block_start")]
    log = log.withColumn("seq", F.struct(*written, F.monotonically_increasing_id()))
    last = compacted(log).drop("seq").withColumn("judge_error", F.lit(False))
    rewrite_jsonl(spark, last, decisions)
    done = spark.read.schema(schema).json(named(decisions))
    rewrite_jsonl(spark, done.where("is_quality").select("row.*"), kept)
    rewrite_jsonl(spark, done.where("NOT is_quality"), rejected)
    return done
