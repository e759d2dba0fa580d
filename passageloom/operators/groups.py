"""Tasks over groups of passages: comparison and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cat, count_words, maskable, strip
from ..plans.schema import grows
from ..plans.tasks import COMPARISON, NO_ANSWER, REASON, RETRIEVAL, passage_list, retrieval_rows
from ..sources.files import scratch
from .runtime import RuleRuntime, Runtime, ask, completed, typed

#: Fixed value: passages of a group at least.
LEAST = 2
#: Documents of a part, and parts at most, roughly; see part_starts.
PART, PARTS = 500, 4096
ROW = ["instruction", "input", "output"]


def all_groups(docs: DataFrame, size: int = 3, by: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group_id, ids and passages: up to size neighbours in id order that share
    `by`, of every document: the documents of a source are numbered in id order
    whatever their ids, and a last single one joins the group before it. Only the
    single document of a source is in no group.

    Every document finds its part, see part_starts, by binary search among their
    starts, and is numbered within it, so that a text is shuffled once and no window
    holds a source. files.clear_scratch frees what was written."""
    ready = docs.select(F.col(by).alias("by"), F.col(id_col).alias("i"), strip(F.col(text_col)).alias("t")).where("t <> ''")
    starts = part_starts(ready.select("by", "i"), size)
    found = places(F.col("starts"), F.struct("by", "i"), starts.select(F.size("starts")).first()[0])
    placed = ready.crossJoin(F.broadcast(starts)).select("by", "i", "t", found.alias("part"))
    one = W.partitionBy("part", "by").orderBy("i", "t")
    placed = placed.select("*", (F.row_number().over(one) - 1).alias("rank"), F.lead(F.lit(True)).over(one).isNull().alias("last"))
    placed = placed.withColumn("g", F.floor((F.col("rank") - alone(F.col("rank"), F.col("last"), size).cast("int")) / size))
    grouped = placed.groupBy("part", "by", "g").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("x")).where(F.size("x") >= LEAST)
    ids, texts = F.transform("x", lambda v: v["i"]), F.transform("x", lambda v: v["t"])
    return grouped.select(F.element_at(ids, 1).alias("group_id"), ids.alias("ids"), texts.alias("passages"))


def alone(rank: Column, last: Column, size: int) -> Column:
    """Whether the document of this rank is the last and would be a group by itself."""
    return last & (rank % size == 0) & (rank > 0) if size > 1 else F.lit(False)


def part_starts(keys: DataFrame, size: int) -> DataFrame:
    """A row with starts, the (by, i) in order that parts of the documents begin with,
    each of them the first of a group of its source. Documents of one id are in one
    part. Parts have about PART documents, more where there would be over PARTS parts.

    Only the keys are written, range-partitioned by source and id, so that a number is
    the rank in a range plus the counts of those before."""
    spark = keys.sparkSession
    at = scratch(spark, "groups")
    keys.write.parquet(f"{at}/keys")
    keys = spark.read.parquet(f"{at}/keys")
    most = max(PART, keys.count() // PARTS)
    keys.repartitionByRange("by", "i").withColumn("range", F.spark_partition_id()).write.parquet(f"{at}/ranges")
    keys = spark.read.parquet(f"{at}/ranges")
    counts = keys.groupBy("by", "range").agg(F.count("*").alias("here"))
    every = W.partitionBy("by")
    counts = counts.select("by", "range", (F.sum("here").over(every.orderBy("range")) - F.col("here")).alias("skip"), F.sum("here").over(every).alias("n"))
    of_range, of_source = W.partitionBy("range").orderBy("by", "i"), W.partitionBy("range", "by").orderBy("i")
    ranked = keys.withColumn("place", F.row_number().over(of_range) - 1)
    ranked = ranked.withColumns({"here": F.row_number().over(of_source) - 1, "first": F.rank().over(of_source) == F.row_number().over(of_source)})
    same = F.col("r.by").eqNullSafe(F.col("c.by")) & (F.col("r.range") == F.col("c.range"))
    rank = F.col("here") + F.col("skip")
    opens = F.col("first") & (rank % size == 0) & ~alone(rank, rank == F.col("n") - 1, size)
    begun = ranked.alias("r").join(counts.alias("c"), same).where(opens).groupBy("r.range", F.floor(F.col("place") / most)).agg(F.min(F.struct("r.by", "i")).alias("start"))
    begun.agg(F.sort_array(F.collect_list("start")).alias("starts")).write.parquet(f"{at}/starts")
    return spark.read.parquet(f"{at}/starts")


def places(starts: Column, key: Column, n: int) -> Column:
    """How many of n starts, in order, are no greater than the key."""

    def step(at: Column, more: Column) -> Column:
        return F.when((at + more <= F.size(starts)) & (F.get(starts, at + more - 1) <= key), at + more).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))]), F.lit(0), step)


def neighbours(groups: DataFrame) -> DataFrame:
    """Groups of two: each passage of a group with the next; group_id is the
    first one's id."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(F.slice("ids", k, 2).alias("ids"), F.slice("passages", k, 2).alias("passages"))))
    made = groups.select(pair.alias("x")).select("x.*")
    return made.select(F.element_at("ids", 1).alias("group_id"), "ids", "passages")


def cleaned(passages: Column) -> Column:
    """Stripped passages without blank ones; null if fewer than two are left."""
    kept = F.filter(F.transform(passages, strip), lambda p: p != "")
    return F.when(F.size(kept) >= LEAST, kept)


def shuffled(passages: Column, seed: int = 0) -> Column:
    """Passages in an order that depends on their texts and the seed only."""
    keyed = F.array_sort(F.transform(passages, lambda p, i: F.struct(F.md5(cat(f"{seed}|", p)).alias("h"), i.alias("i"), p.alias("p"))))
    return F.transform(keyed, lambda x: x["p"])


def comparison_rows(pairs: DataFrame, generations: int = COMPARISON.generations, runtime: Runtime | None = None) -> DataFrame:
    """group_id, generation and the row of each pair of passages, cleaned; groups
    that aren't two passages then have none. Each generation is a call of the
    runtime; without one, a rule names a telling word of each passage. Where answers go
    by key, only keys are asked with, and the passages join what came of them."""
    ready = pairs.select("group_id", cleaned(F.col("passages")).alias("passages")).where(F.size("passages") == 2)
    each = F.explode(F.sequence(F.lit(0), F.lit(generations - 1))).alias("generation")
    n_words = count_words(F.col("passages")[0]) + count_words(F.col("passages")[1])
    key = cat(F.col("group_id").cast("string"), ":", F.col("generation").cast("string"))
    if runtime is not None and runtime.by_key:
        ready = ready.where("group_id IS NOT NULL").withColumn("n_words", F.coalesce(n_words, F.lit(0)))
        asked = ready.select("group_id", "n_words").distinct().select("*", each)
        told = ask(asked, COMPARISON, runtime, key, F.lit(""), n_words=F.col("n_words")).where("out IS NOT NULL")
        made = ready.join(told, ["group_id", "n_words"])
    else:
        word = lambda k: F.coalesce(F.get(maskable(F.col("passages")[k]), F.lit(0)), F.lit("nothing"))
        fields = {"first_word": word(0), "second_word": word(1), "n_words": n_words}
        made = ask(ready.select("*", each), COMPARISON, runtime, key, passage_list(F.col("passages")), **fields)
    r = F.explode(COMPARISON.formats["plain"](F.col("passages"), F.col("out")))
    made = made.where("out IS NOT NULL").select("group_id", "generation", r.alias("r"))
    return made.select("group_id", "generation", *[F.col(f"r.{c}").alias(c) for c in ROW])


def retrieval(
    groups: DataFrame, negatives: bool = True, most_passages: int | None = None, most_questions: int | None = None, seed: int | None = 0, runtime: Runtime | None = None,
) -> DataFrame:
    """group_id, passage_no, question_no, negative and the rows of each question:
    two with its passage among the group's, two with the others only. Questions on
    each passage and the reason of each answer are calls of the runtime. Where answers
    go by key, blanks stand in for passages until all answers are there."""
    for most in (most_passages, most_questions):
        if most is not None and most <= 0:
            raise ValueError("a limit must be greater than 0")
    source = runtime or RuleRuntime()
    ps = F.col("passages") if seed is None else shuffled(F.col("passages"), seed)
    held = groups.select("group_id", (ps if most_passages is None else F.slice(ps, 1, most_passages)).alias("ps"))
    made, tasks = held, (RETRIEVAL, REASON, NO_ANSWER)
    by_key = source.by_key and not any(grows(t.tree) for t in tasks)
    if by_key:
        n = F.size("passages") if most_passages is None else F.least(F.size("passages"), F.lit(most_passages))
        made = groups.select("group_id", n.alias("n")).where("n > 0").distinct().select("group_id", F.array_repeat(F.lit(""), F.col("n")).alias("ps"))
    made = made.select("group_id", "ps", F.posexplode("ps").alias("passage_no", "p"))
    text = lambda c: F.col(c).cast("string")
    asked = ask(made, RETRIEVAL, source, cat(text("group_id"), ":", text("passage_no")), F.col("p"))
    found = F.col("out.questions") if most_questions is None else F.slice("out.questions", 1, most_questions)
    made = asked.select("group_id", "ps", "passage_no", "p", F.posexplode(found).alias("question_no", "q"))
    others = F.filter("ps", lambda p, i: i != F.col("passage_no"))
    kinds = [F.struct(F.lit(False).alias("negative"), F.lit(REASON.name).alias("task"), F.array("p").alias("shown"))]
    if negatives:
        kinds.append(F.struct(F.lit(True).alias("negative"), F.lit(NO_ANSWER.name).alias("task"), others.alias("shown")))
    made = made.select("group_id", "ps", "passage_no", "question_no", "q", F.explode(F.array(*kinds)).alias("k")).select("*", "k.*").drop("k").where(F.size("shown") > 0)
    key = F.concat_ws(":", text("group_id"), text("passage_no"), text("question_no"))
    calls = made.select(F.struct(*made.columns).alias("own_"), "task", key.alias("call_id"), cat(passage_list(F.col("shown")), "\n\nQuestion: ", F.col("q")).alias("passage"))
    if isinstance(source, RuleRuntime):
        why = F.when(F.col("task") == REASON.name, REASON.draft({})).otherwise(NO_ANSWER.draft({}))
        told = calls.select("own_", why.alias("out"))
    else:
        raw = source.raw(completed(calls), {t.name: t for t in (REASON, NO_ANSWER)})
        told = typed(raw, [REASON, NO_ANSWER]).withColumn("out", F.coalesce("o0_", "o1_"))
    made = told.where("out IS NOT NULL").select("own_.*", F.col("out.why").alias("why"))
    if by_key:
        made = held.withColumn("n", F.size("ps")).join(made.withColumn("n", F.size("ps")).drop("ps"), ["group_id", "n"])
    given = F.when(F.col("negative"), F.filter("ps", lambda p, i: i != F.col("passage_no"))).otherwise(F.col("ps"))
    rows = retrieval_rows(given, F.when(~F.col("negative"), F.col("passage_no")), F.col("q"), F.col("why"))
    made = made.select("group_id", "passage_no", "question_no", "negative", F.posexplode(rows).alias("row_no", "r"))
    return made.select("group_id", "passage_no", "question_no", "negative", "row_no", *[F.col(f"r.{c}").alias(c) for c in ROW])
