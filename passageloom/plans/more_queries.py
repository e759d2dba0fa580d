"""Queries of the operators around the tasks: sources, checks, selection, groups,
templates, judging and sinks; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import augment as A
from ..operators import chunk, groups, judge
from ..operators.runtime import TableRuntime
from ..sources import files
from . import queries as Q
from . import tasks as K
from .queries import BASE, CHUNKS, DOC_ROW, documents, js, json_list, md5_bucket, one, q, passages, quote_in, replaced, row, sentences, strip, text, words

ROW = ["instruction", "input", "output"]
CHANCES = {"title": 0.25, "summarize": 0.5, "cloze": 1.0, "bullets": 0.0}
MENU = ["title", "summarize", "rephrase", "classification"]
TEMPLATED = "classification"


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_text(documents(spark, sf_dir), size=2000, overlap=200)


def word_count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.count_words(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id",
        n.alias("n_words"),
        X.length_bound(n, 40, 1000).alias("rephrase_most"),
        X.length_bound(n, 4, 1000).alias("summary_most"),
        X.length_bound(n, 24, 2000).alias("style_most"),
    )


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.validated(documents(spark, sf_dir)).select("doc_id", "error", F.length("text").alias("n_chars"))


def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("text"), X.sentences(F.col("text"))
    last = F.regexp_replace(F.lower(F.element_at(s, -1)), " ", "  ")
    docs = documents(spark, sf_dir).where(F.size(s) > 0)
    return docs.select("doc_id", X.quote_in(last, t).alias("respaced"), X.quote_in(F.lit(K.FABRICATED), t).alias("fabricated"), X.quote_in(F.lit(""), t).alias("empty"))


def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, w = F.col("text"), X.words(F.col("text"))
    docs = documents(spark, sf_dir).where(F.size(w) > 1)
    return docs.select("doc_id", X.replace_first(t, F.lower(w[1]), F.lit("REPLACED")).alias("changed"), X.replace_first(t, F.lit("qqqq"), F.lit("x")).alias("absent"))


def renderers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.slice(X.sentences(F.col("text")), 1, 3)
    return documents(spark, sf_dir).select("doc_id", X.list_literal(s).alias("literal"), X.json_list(s).alias("json"), X.numbered(s).alias("numbered"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


def passage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = groups.all_groups(sources(spark, sf_dir))
    return made.select("group_id", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"), F.md5(F.array_join("passages", "\n")).alias("digest"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources with a letter for each text: they make the same groups."""
    return sources(spark, sf_dir).withColumn("text", F.substring(X.strip(F.col("text")), 1, 1))


def pairs(docs: DataFrame) -> DataFrame:
    return groups.neighbours(groups.all_groups(docs, size=2))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.comparison_rows(pairs(sources(spark, sf_dir)))


def retrieval_of(negative: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return groups.retrieval(groups.all_groups(sources(spark, sf_dir))).where(F.col("negative") == negative).drop("negative")

    return query


def template_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_task(passages(spark, sf_dir), TEMPLATED, templates=True, seed=3).select(DOC_ROW)


def task_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = documents(spark, sf_dir).select("doc_id", A.sampled_tasks(CHANCES, seed=5).alias("tasks"))
    return drawn.select("doc_id", F.array_join("tasks", ",").alias("tasks"))


def mode_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.augment(passages(spark, sf_dir), {"title": 0.3, "rephrase": 0.2}, templates=False, seed=1)
    return made.select("doc_id", "task", "row_no", *ROW)


def mode_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.augment(passages(spark, sf_dir), ["title", "rephrase"], templates=False).select("doc_id", "task", "row_no", *ROW)


def mode_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.augment(passages(spark, sf_dir), ["title", "rephrase"], mode="auto", templates=False)
    return made.select("doc_id", "task", "row_no", *ROW)


def prefilter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prefilter(documents(spark, sf_dir)).select("doc_id", X.count_words(F.col("text")).alias("n_words"))


def task_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = documents(spark, sf_dir).select("doc_id", F.explode(A.selected_tasks(MENU, 0.4)).alias("task"))
    return chosen.groupBy("task").agg(F.count("*").alias("passages"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.routed(judge.postfilter(A.run_task(passages(spark, sf_dir), "title")))


def postfilter_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "row_no", F.col("judge.is_quality").alias("is_quality"), F.col("judge.reason").alias("reason"), "route")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log from labels: some rows are judged again, some fail."""
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL")
    d = d.select(F.col("doc_id").alias("row_index"), (F.col("quality") == 1).alias("is_quality"), F.explode(F.array(*map(F.lit, range(3)))).alias("seq"))
    return d.where("(row_index + seq) % 2 = 0").withColumn("judge_error", (F.col("row_index") + F.col("seq")) % 5 == 0)


def decision_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.compacted(decisions(spark, sf_dir)).select("row_index", "is_quality", "seq")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = documents(spark, sf_dir).select(F.col("doc_id").alias("row_index"))
    return judge.unfinished(source, decisions(spark, sf_dir))


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.agg(F.count("*").alias("n_decisions"), F.count_if("judge_error").alias("n_retryable"), F.count_if("is_quality").alias("n_kept"))


def add_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.add_reasoning(A.run_task(passages(spark, sf_dir), "title")).select("doc_id", "row_no", "reasoning")


def long_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.long_text_rows(documents(spark, sf_dir), "continuation").select("chunk_id", "row_no", *ROW)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = K.get_task("title").with_knobs(generations=2, variations=1)
    return A.run_task(passages(spark, sf_dir), task).select("doc_id", "generation", "variation", "row_no", *ROW)


def custom_task_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft = lambda x: K.struct(statistic=F.size(x["w"]).cast("string"), context=K.left(K.s(x, 0), 80))
    task = K.task(prompt="Find a number.", schema="statistic string, context string", output="{statistic} words: {context}", instruction="Count the words.", draft=draft)
    return A.run_task(passages(spark, sf_dir), task).select(DOC_ROW)


def table_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from JSON in a table; those of every seventh document are broken
    and give no row."""
    docs = passages(spark, sf_dir)
    raw = F.when(F.substring_index(F.col("doc_id").cast("string"), ":", 1).cast("long") % 7 == 0, '{"title": ').otherwise(F.to_json(F.struct(F.lit("T").alias("title"), F.substring("text", 1, 20).alias("headline"))))
    answers = docs.select(F.lit("title").alias("task"), F.col("doc_id").alias("call_id"), raw.alias("raw"))
    return A.run_task(docs, "title", TableRuntime(answers)).select(DOC_ROW)


def custom_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.preprocessed(documents(spark, sf_dir), source="corpus")
    return made.select("doc_id", "source", "title", "cleaned_text", F.array_join("keywords", ",").alias("keywords"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.run_task(passages(spark, sf_dir), "title").select("instruction", "input", "output", F.lit(None).cast("string").alias("reasoning"))
    return files.read_jsonl(spark, files.write_jsonl(rows, files.scratch(spark, "rows"))).select(*ROW, "reasoning")


# -- calls of a runtime that answers from a table --------------------------------
def modelled(docs: DataFrame, task: str, raw: Column, key: Column) -> DataFrame:
    return docs.select(F.lit(task).alias("task"), key.cast("string").alias("call_id"), raw.alias("raw"))


def joined_answers(*tables: DataFrame) -> TableRuntime:
    made = tables[0]
    for t in tables[1:]:
        made = made.unionByName(t)
    return TableRuntime(made)


def length_answers(docs: DataFrame) -> TableRuntime:
    """A gate that takes texts of even length; a selector that takes title, and
    for every third length rephrase too; titles that name the length."""
    n = F.length("text")
    both = F.when(n % 3 == 0, '{"selected": ["title", "rephrase"]}').otherwise('{"selected": ["title"]}')
    title = F.to_json(F.struct(n.cast("string").alias("title"), F.lit("H").alias("headline")))
    return joined_answers(
        modelled(docs, "gate", F.when(n % 2 == 0, '{"is_quality": true}').otherwise('{"is_quality": false}'), F.col("doc_id")),
        modelled(docs, "selector", F.when(n % 5 == 0, '{"selected": ["nothing such"]}').otherwise(both), F.col("doc_id")),
        modelled(docs, "title", title, F.col("doc_id")),
        modelled(docs, "rephrase", F.lit('{"rephrased": "R"}'), F.col("doc_id")),
    )


def gate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = passages(spark, sf_dir)
    return A.prefilter(docs, runtime=length_answers(docs)).select("doc_id", F.length("text").alias("n_chars"))


def selector_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = passages(spark, sf_dir)
    made = A.select_tasks(docs, ["title", "rephrase"], length_answers(docs))
    return made.select("doc_id", F.array_join("selected", ",").alias("selected"), F.col("selection_error").isNotNull().alias("failed"))


def auto_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = passages(spark, sf_dir)
    return A.augment(docs, ["title", "rephrase"], "auto", length_answers(docs), templates=False).select("doc_id", "task", "row_no", *ROW)


def judge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that keeps rows with outputs of even length and fails on every seventh."""
    rows = A.run_task(passages(spark, sf_dir), "title")
    n, key = F.length("output"), F.concat_ws(":", "doc_id", F.col("row_no").cast("string"))
    raw = F.when(n % 7 == 0, "no JSON").otherwise(F.to_json(F.struct((n % 2 == 0).alias("is_quality"), n.cast("string").alias("reason"))))
    judged = judge.routed(judge.postfilter(rows, runtime=TableRuntime(modelled(rows, "judge", raw, key)), key=key))
    return judged.select("doc_id", "row_no", "route", F.col("judge.reason").alias("reason"))


def reasoning_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.run_task(passages(spark, sf_dir), "title")
    key = F.concat_ws(":", "doc_id", F.col("row_no").cast("string"))
    raw = F.to_json(F.struct(F.concat(F.lit("As it says "), F.col("output")).alias("reasoning")))
    made = judge.add_reasoning(rows, runtime=TableRuntime(modelled(rows, "reasoning", raw, key)), key=key)
    return made.select("doc_id", "row_no", "reasoning")


def comparison_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers to each pair, of which the last is too long to be valid. The pairs
    share their texts."""
    said = F.when(F.col("answer") == 2, F.repeat(F.lit("x"), 10**6)).otherwise(F.concat(F.lit("answer "), F.col("answer").cast("string")))
    texts = spark.range(3).withColumnRenamed("id", "answer").withColumn("raw", F.to_json(F.struct(said.alias("answer"))))
    made = pairs(keys(spark, sf_dir)).select("group_id").distinct().crossJoin(F.broadcast(texts.select("answer")))
    answers = made.select(F.lit("comparison").alias("task"), F.concat_ws(":", F.col("group_id").cast("string"), F.col("answer").cast("string")).alias("call_id"), "answer")
    return groups.comparison_rows(pairs(sources(spark, sf_dir)), runtime=TableRuntime(answers, texts)).select("group_id", "generation", "output", F.md5("input").alias("digest"))


def retrieval_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question on each passage; a reason for it, and, for even groups, one why
    no other passage answers."""
    each = groups.all_groups(keys(spark, sf_dir)).select("group_id", F.posexplode("ids").alias("k", "i")).select("group_id", "k").distinct()
    key = F.concat_ws(":", F.col("group_id").cast("string"), F.col("k").cast("string"))
    answers = joined_answers(
        modelled(each, "retrieval", F.lit('{"questions": ["Which is it?"]}'), key),
        modelled(each, "retrieval_reason", F.lit('{"why": "It is."}'), F.concat(key, F.lit(":0"))),
        modelled(each.where("group_id % 2 = 0"), "no_answer_reason", F.lit('{"why": "It is not."}'), F.concat(key, F.lit(":0"))),
    )
    found = groups.retrieval(groups.all_groups(sources(spark, sf_dir)), runtime=answers)
    return found.select("group_id", "passage_no", "negative", "row_no", "output", F.md5("input").alias("digest"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log written as JSON lines, read by its schema, and compacted
    with the rows that it kept."""
    d = decisions(spark, sf_dir).orderBy("seq")
    row_ = F.struct(*[F.lit(c).alias(c) for c in (*ROW, "reasoning")])
    at = files.scratch(spark, "log")
    for n in range(3):
        part = d.where(F.col("seq") == n)
        files.write_jsonl(part.select("row_index", "is_quality", F.col("seq").cast("string").alias("reason"), "judge_error", row_.alias("row")), f"{at}/decisions")
    files.compact_outputs(spark, f"{at}/decisions", f"{at}/kept", f"{at}/rejected")
    kept, rejected = files.count_jsonl(spark, f"{at}/kept"), files.count_jsonl(spark, f"{at}/rejected")
    done = spark.read.schema(files.DECISION_SCHEMA).json(files.named(f"{at}/decisions"))
    return done.agg(F.count("*").alias("n_done"), F.count_if("is_quality").alias("n_quality"), F.lit(kept).cast("long").alias("n_kept"), F.lit(rejected).cast("long").alias("n_rejected"))


def judged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datapoints as a judge is shown them."""
    return A.run_task(passages(spark, sf_dir), "title").withColumn("reasoning", F.lit(None).cast("string")).select("doc_id", "row_no", judge.row_json(*ROW, "reasoning").alias("shown"))


# -- SQL ---------------------------------------------------------------------------
TITLE_ROWS = [row(q(K.TITLE), "t", Q.left(Q.joined("w[1:8]"), 120)), row(q(K.HEADLINE), "t", Q.left("s[1]", 200))]
REPHRASED = row(q(K.REPHRASE), "t", Q.left(Q.collapse("t"), "greatest(1000, len(w) * 40)"))


def unit_sql(key: str) -> str:
    return f"({md5_bucket(key, '4294967296')} / 4294967296.0::DOUBLE)"


def tasks_sql(chances: dict[str, tuple[float, str, bool]], rows_of: dict[str, list[str]], where: str = "true") -> str:
    parts = [f"SELECT doc_id, {q(n)} AS task, [{', '.join(rows_of[n])}] AS rows FROM e WHERE {where} AND {cond}" for n, cond in chances.items()]
    return f"""{BASE}, a AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, task, unnest(rows) AS r, (generate_subscripts(rows, 1) - 1)::INTEGER AS row_no FROM a)
SELECT doc_id, task, row_no, r.instruction AS instruction, r.input AS input, r.output AS output FROM u"""


LETTERS = r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) * 2 >= length(t)"
GATE = f"len(w) >= 10 AND {LETTERS}"
ROWS_OF = {"title": TITLE_ROWS, "rephrase": [REPHRASED]}


def groups_sql(size: int = 3) -> str:
    """Neighbours of a source in id order, size each; a last single one joins the
    group before."""
    return f"""
g0 AS (SELECT source, doc_id AS i, {strip("text")} AS t FROM documents WHERE {strip("text")} <> ''),
g1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM g0),
g1b AS (SELECT *, CASE WHEN n % {size} = 1 AND r = n - 1 AND r >= {size} THEN r // {size} - 1 ELSE r // {size} END AS g FROM g1),
g2 AS (SELECT min(i) AS group_id, list(i ORDER BY i) AS ids, list(t ORDER BY i) AS ps FROM g1b GROUP BY source, g HAVING count(*) >= 2)
"""


PAIRS = f"""{groups_sql(2)},
g3 AS (SELECT unnest(list_transform(range(1, len(ids)), lambda k: {{'group_id': ids[k], 'a': ps[k], 'b': ps[k + 1]}})) AS x FROM g2)
"""


def retrieval_sql(negative: bool) -> str:
    others = "list_filter(ps, lambda v, k: k <> pno + 1)"
    shown = others if negative else "ps"
    given = f"{Q.joined(f'list_transform({shown}, lambda v, k: {text("Passage ", "=k", ":" + chr(10), "=v")})', 'chr(10) || chr(10)')} || {text(chr(10) * 2 + 'Question: ')} || qn"
    why = "No passage mentions the word." if negative else "It mentions the word."
    place, number = ("'None'", "'null'") if negative else ("(pno + 1)::VARCHAR", "(pno + 1)::VARCHAR")
    out = f"'**Passage:** ' || {place} || chr(10) || chr(10) || '**Why:** {why}'"
    out_json = f"'{{\"passage\": ' || {number} || ', \"why\": \"{why}\"}}'"
    rows = f"[{row(q(K.FIND), given, out)}, {row(q(K.FIND_JSON), given, out_json)}]"
    return f"""WITH {groups_sql()},
g3 AS (SELECT group_id, list_transform(list_sort(list_transform(ps, lambda p, i: {{'h': md5('0|' || p), 'i': i, 'p': p}})), lambda v: v.p) AS ps FROM g2),
g4 AS (SELECT group_id, ps, unnest(ps) AS p, (generate_subscripts(ps, 1) - 1)::INTEGER AS pno FROM g3),
g5 AS (SELECT *, list_transform(({Q.maskable("p")})[1:2], lambda v: 'Which passage mentions ' || v || '?') AS qs FROM g4),
g6 AS (SELECT group_id, ps, pno, unnest(qs) AS qn, (generate_subscripts(qs, 1) - 1)::INTEGER AS qno FROM g5),
g7 AS (SELECT group_id, pno, qno, {rows} AS rows FROM g6),
u AS (SELECT group_id, pno, qno, unnest(rows) AS r, (generate_subscripts(rows, 1) - 1)::INTEGER AS row_no FROM g7)
SELECT group_id, pno AS passage_no, qno AS question_no, row_no, r.instruction AS instruction, r.input AS input, r.output AS output FROM u"""


COMPARED = text("Passage 1:\n", "=x.a", "\n\nPassage 2:\n", "=x.b")


def comparison_sql() -> str:
    word = lambda p: f"coalesce(({Q.maskable(p)})[1], 'nothing')"
    answer = text("The first passage speaks of ", "=" + word("x.a"), "; the second speaks of ", "=" + word("x.b"), ".")
    return f"""WITH {PAIRS}
SELECT x.group_id AS group_id, generation::INTEGER AS generation, {q(K.COMPARE)} AS instruction, {COMPARED} AS input, {answer} AS output
FROM g3, range(3) AS n(generation)"""


def retrieval_model_sql() -> str:
    shown = lambda list_: Q.joined(f"list_transform({list_}, lambda v, k: {text('Passage ', '=k', ':' + chr(10), '=v')})", "chr(10) || chr(10)") + f" || {text(chr(10) * 2 + 'Question: Which is it?')}"
    others = "list_filter(ps, lambda v, k: k <> pno + 1)"
    md = lambda place, why: f"'**Passage:** ' || {place} || chr(10) || chr(10) || '**Why:** {why}'"
    js_ = lambda place, why: f"'{{\"passage\": ' || {place} || ', \"why\": \"{why}\"}}'"
    n = "(pno + 1)::VARCHAR"
    rows = f"""[{{'negative': false, 'row_no': 0::INTEGER, 'output': {md(n, 'It is.')}, 'input': {shown('ps')}}}, {{'negative': false, 'row_no': 1, 'output': {js_(n, 'It is.')}, 'input': {shown('ps')}}}]"""
    no = f"""[{{'negative': true, 'row_no': 0::INTEGER, 'output': {md("'None'", 'It is not.')}, 'input': {shown(others)}}}, {{'negative': true, 'row_no': 1, 'output': {js_("'null'", 'It is not.')}, 'input': {shown(others)}}}]"""
    return f"""WITH {groups_sql()},
g3 AS (SELECT group_id, list_transform(list_sort(list_transform(ps, lambda p, i: {{'h': md5('0|' || p), 'i': i, 'p': p}})), lambda v: v.p) AS ps FROM g2),
g4 AS (SELECT group_id, ps, unnest(range(len(ps))) AS pno FROM g3),
u AS (SELECT group_id, pno, unnest({rows} || CASE WHEN group_id % 2 = 0 THEN {no} ELSE [] END) AS r FROM g4)
SELECT group_id, pno::INTEGER AS passage_no, r.negative AS negative, r.row_no AS row_no, r.output AS output, md5(r.input) AS digest FROM u"""


def shown_json() -> str:
    lines = [f"'  \"{n}\": ' || {js(n)}" for n in ("input", "instruction", "output")]
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(lines) + " || ',' || chr(10) || '  \"reasoning\": null' || chr(10) || '}'"


def templates_sql() -> str:
    pools = K.get_task(TEMPLATED).templates()
    key = "doc_id || '|classification|plain|0|0|' || row_no || '|3'"
    cases = " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}][{md5_bucket(key, str(len(v)))} + 1]" for k, v in pools.items())
    return f"SELECT * REPLACE (CASE instruction {cases} END AS instruction) FROM ({Q.TASK_SQL[TEMPLATED]})"


DECISIONS = """
d AS (SELECT doc_id AS row_index, quality = 1 AS is_quality, seq::INTEGER AS seq, (doc_id + seq) % 5 = 0 AS judge_error
      FROM labels, range(3) AS n(seq) WHERE quality IS NOT NULL AND (doc_id + seq) % 2 = 0),
f AS (SELECT row_index, is_quality, seq FROM d WHERE NOT judge_error QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY seq DESC) = 1)
"""
N = f"len({words('text')})"

QUERIES = {
    f.__name__: f
    for f in (
        chunk_text, word_count_bounds, size_guard, quote_verify, replace_first, renderers, passage_groups, comparison, template_sampling,
        task_sampling, mode_sample, mode_explicit, mode_auto, prefilter_gate, task_selection, postfilter_routing, decision_compaction,
        resume_anti_join, decision_counts, add_reasoning, long_text_rows, generations, custom_task_template, table_runtime,
        custom_preprocessing, jsonl_roundtrip, gate_model, selector_model, auto_model, judge_model, reasoning_model, comparison_model,
        retrieval_model, decision_log, judged_json,
    )
} | {"retrieval_positive": retrieval_of(False), "retrieval_negative": retrieval_of(True)}

TITLE_SQL = Q.TASK_SQL["title"]
ORACLE_SQL = {
    "chunk_text": f"WITH {CHUNKS % 1800} SELECT doc_id, chunk_no, text FROM c3",
    "word_count_bounds": f"SELECT doc_id, n::INTEGER AS n_words, greatest(1000, n * 40)::INTEGER AS rephrase_most, greatest(1000, n * 4)::INTEGER AS summary_most, greatest(2000, n * 24)::INTEGER AS style_most FROM (SELECT doc_id, {N} AS n FROM documents)",
    "size_guard": f"""SELECT doc_id, CASE WHEN length(text) > 3000 THEN 'the passage has ' || format('{{:,}}', length(text)) || ' characters, more than 3,000; cut it into chunks first'
        WHEN text IS NULL OR {strip("text")} = '' THEN 'the passage is empty' END AS error, length({strip("text")})::INTEGER AS n_chars FROM documents""",
    "quote_verify": f"SELECT doc_id, {quote_in('replace(lower(s[len(s)]), q1, q2)', 'text')} AS respaced, {quote_in(q(K.FABRICATED), 'text')} AS fabricated, true AS empty FROM (SELECT doc_id, text, {sentences('text')} AS s, ' ' AS q1, '  ' AS q2 FROM documents) WHERE len(s) > 0",
    "replace_first": f"SELECT doc_id, {replaced('text', 'lower(w[2])', q('REPLACED'))} AS changed, {replaced('text', q('qqqq'), q('x'))} AS absent FROM (SELECT doc_id, text, {words('text')} AS w FROM documents) WHERE len(w) > 1",
    "renderers": f"SELECT doc_id, {Q.python_list('s')} AS literal, {json_list('s')} AS json, {Q.numbered('s')} AS numbered FROM (SELECT doc_id, ({sentences('text')})[1:3] AS s FROM documents)",
    "passage_groups": f"WITH {groups_sql()} SELECT group_id, len(ids)::INTEGER AS n, array_to_string(ids, ',') AS ids, md5(array_to_string(ps, chr(10))) AS digest FROM g2",
    "comparison": comparison_sql(),
    "retrieval_positive": retrieval_sql(False),
    "retrieval_negative": retrieval_sql(True),
    "template_sampling": templates_sql(),
    "task_sampling": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {unit_sql(f'doc_id || {q(f"|{n}|5")}')} < {p} THEN {q(n)} END" for n, p in CHANCES.items()) + "], lambda v: v IS NOT NULL), ',') AS tasks FROM documents",
    "mode_sample": tasks_sql({n: f"{GATE} AND {unit_sql(f'doc_id || {q(f"|{n}|1")}')} < {p}" for n, p in (("title", 0.3), ("rephrase", 0.2))}, ROWS_OF),
    "mode_explicit": tasks_sql(dict.fromkeys(("title", "rephrase"), "true"), ROWS_OF),
    "mode_auto": tasks_sql({n: f"{GATE} AND {unit_sql(f'doc_id || {q(f"|{n}|0")}')} < 0.25" for n in ("title", "rephrase")}, ROWS_OF),
    "prefilter_gate": f"SELECT doc_id, n::INTEGER AS n_words FROM (SELECT doc_id, text AS t, {N} AS n FROM documents) WHERE n >= 10 AND {LETTERS}",
    "task_selection": "SELECT task, count(*) AS passages FROM (" + " UNION ALL ".join(f"SELECT {q(n)} AS task FROM documents WHERE {unit_sql(f'doc_id || {q(f"|{n}|0")}')} < 0.4" for n in MENU) + ") GROUP BY task",
    "postfilter_routing": f"""SELECT doc_id, row_no, output <> '' AND length(output) <= length(input) AS is_quality,
        CASE WHEN output = '' THEN 'the output is empty' WHEN length(output) <= length(input) THEN 'the output fits' ELSE 'the output is longer than the input' END AS reason,
        CASE WHEN output <> '' AND length(output) <= length(input) THEN 'kept' ELSE 'rejected' END AS route FROM ({TITLE_SQL})""",
    "decision_compaction": f"WITH {DECISIONS} SELECT * FROM f",
    "resume_anti_join": f"WITH {DECISIONS} SELECT doc_id AS row_index FROM documents ANTI JOIN f ON doc_id = row_index",
    "decision_counts": f"WITH {DECISIONS} SELECT count(*) AS n_decisions, count(*) FILTER (judge_error) AS n_retryable, count(*) FILTER (is_quality) AS n_kept FROM d",
    "add_reasoning": f"SELECT doc_id, row_no, 'The instruction asks: ' || instruction || ' The input has ' || length(input) || ' characters. The output follows from it.' AS reasoning FROM ({TITLE_SQL})",
    "long_text_rows": f"""WITH {CHUNKS % 2000}, e AS (SELECT doc_id || ':' || chunk_no AS chunk_id, {strip("text")} AS t, {words("text")} AS w FROM c3),
        a AS (SELECT chunk_id, {Q.continuation_sql("e")} AS rows FROM e WHERE len(w) >= 10),
        u AS (SELECT chunk_id, unnest(rows) AS r, (generate_subscripts(rows, 1) - 1)::INTEGER AS row_no FROM a)
        SELECT chunk_id, row_no, r.instruction AS instruction, r.input AS input, r.output AS output FROM u""",
    "generations": f"SELECT doc_id, g::INTEGER AS generation, v::INTEGER AS variation, row_no, instruction, input, output FROM ({TITLE_SQL}), range(2) AS a(g), range(2) AS b(v)",
    "custom_task_template": one(row("'Count the words.'", "t", text("=len(w)", " words: ", "=substr(s[1], 1, 80)"))),
    "table_runtime": f"SELECT * REPLACE (CASE row_no WHEN 0 THEN 'T' ELSE substr(input, 1, 20) END AS output) FROM ({TITLE_SQL}) WHERE split_part(doc_id, ':', 1)::BIGINT % 7 <> 0",
    "custom_preprocessing": f"SELECT doc_id, 'corpus' AS source, substr(string_split(t, '.')[1], 1, 80) AS title, t AS cleaned_text, array_to_string((list_filter(string_split(t, ' '), lambda v: v <> ''))[1:3], ',') AS keywords FROM (SELECT doc_id, {Q.collapse('text')} AS t FROM documents)",
    "gate_model": f"{BASE} SELECT doc_id, length(t)::INTEGER AS n_chars FROM e WHERE length(t) % 2 = 0",
    "selector_model": f"""{BASE} SELECT doc_id, CASE WHEN length(t) % 5 = 0 THEN '' WHEN length(t) % 3 = 0 THEN 'title,rephrase' ELSE 'title' END AS selected,
        length(t) % 5 = 0 AS failed FROM e WHERE length(t) % 2 = 0""",
    "auto_model": tasks_sql({"title": "length(t) % 2 = 0 AND length(t) % 5 <> 0", "rephrase": "length(t) % 2 = 0 AND length(t) % 5 <> 0 AND length(t) % 3 = 0"},
                            {"title": [row(q(K.TITLE), "t", "length(t)::VARCHAR"), row(q(K.HEADLINE), "t", "'H'")], "rephrase": [row(q(K.REPHRASE), "t", "'R'")]}),
    "judge_model": f"""SELECT doc_id, row_no, CASE WHEN length(output) % 7 = 0 THEN 'error' WHEN length(output) % 2 = 0 THEN 'kept' ELSE 'rejected' END AS route,
        CASE WHEN length(output) % 7 <> 0 THEN length(output)::VARCHAR END AS reason FROM ({TITLE_SQL})""",
    "reasoning_model": f"SELECT doc_id, row_no, 'As it says ' || output AS reasoning FROM ({TITLE_SQL})",
    "comparison_model": f"WITH {PAIRS} SELECT x.group_id AS group_id, generation::INTEGER AS generation, 'answer ' || generation AS output, md5({COMPARED}) AS digest FROM g3, range(2) AS n(generation)",
    "retrieval_model": retrieval_model_sql(),
    "decision_log": f"WITH {DECISIONS} SELECT count(*) AS n_done, count(*) FILTER (is_quality) AS n_quality, count(*) FILTER (is_quality) AS n_kept, count(*) FILTER (NOT is_quality) AS n_rejected FROM f",
    "judged_json": f"SELECT doc_id, row_no, {shown_json()} AS shown FROM ({TITLE_SQL})",
    "jsonl_roundtrip": f"SELECT instruction, input, output, NULL::VARCHAR AS reasoning FROM ({TITLE_SQL})",
}
