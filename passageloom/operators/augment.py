"""From passages to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import barrier, bucket, cat, count_words, flat
from ..plans.tasks import GATE, ROWS_TYPE, TASKS, Task, drawn, list_tasks, resolve_tasks, selector
from ..sources.files import files_of, write_jsonl
from .chunk import chunk_text, usable, validated
from .judge import add_reasoning
from .runtime import Parts, RuleRuntime, Runtime, ask, typed, with_parts

ROW = ["instruction", "input", "output"]
KEYS = ["task", "format", "generation", "variation", "row_no"]


def calls_of(passages: DataFrame, task: Task, id_col: str, text_col: str) -> DataFrame:
    """One row per passage, format and generation; variation 0 is the base answer
    that the others depart from."""
    spec = F.explode(F.array(*map(F.lit, task.formats))).alias("format")
    made = passages.select("*", spec).select("*", F.explode(F.sequence(F.lit(0), F.lit(task.generations - 1))).alias("generation"))
    made = made.withColumns({"call_id": F.col(id_col), "passage": F.col(text_col), "n_words": count_words(F.col(text_col))})
    return made.withColumns({"variation": F.lit(0), "previous": F.lit(None).cast("string")})


def base_calls(passages: DataFrame, id_col: str, text_col: str, selected: str | None) -> DataFrame:
    names = F.col(selected) if selected else F.lit(None).cast("array<string>")
    return passages.select(F.col(id_col).alias("call_id"), F.col(text_col).alias("passage"), names.alias("selected_"))


def wanted(name: str, selected: str | None) -> Column:
    return F.array_contains("selected_", name) if selected else F.lit(True)


def drafted(passages: DataFrame, tasks: list[Task], id_col: str, text_col: str, selected: str | None = None) -> DataFrame:
    """call_id, passage, the keys and the row of answers that rules draft, for all
    tasks in one pass: parts of a passage, drafts and rows are computed once."""
    x = Parts()
    drafts = {f"o{k}_": F.when(wanted(t.name, selected), t.draft(x).cast(t.tree.ddl())) for k, t in enumerate(tasks)}
    calls = with_parts(base_calls(passages, id_col, text_col, selected), x.taken)
    calls = barrier(calls, **drafts, **({"flat_": flat(F.col("passage"))} if any(t.quotes for t in tasks) else {}))
    sets = []
    for k, t in enumerate(tasks):
        out = F.col(f"o{k}_")
        for name, make in t.formats.items():
            made = F.when(t.valid(out, F.col("n_words")), make(F.col("passage"), out)).cast(ROWS_TYPE)
            sets.append(F.struct(F.lit(t.name).alias("task"), F.lit(name).alias("format"), F.lit(t.generations).alias("g"), F.lit(t.variations + 1).alias("v"), made.alias("rows")))
    found = calls.select("call_id", "passage", F.explode(F.array(*sets)).alias("x")).where(F.size("x.rows") > 0)
    if any(t.generations * (t.variations + 1) > 1 for t in tasks):
        found = found.select("*", F.explode(F.sequence(F.lit(0), F.col("x.g") * F.col("x.v") - 1)).alias("n"))
    else:
        found = found.withColumn("n", F.lit(0))
    keys = [F.col("x.task").alias("task"), F.col("x.format").alias("format"), F.floor(F.col("n") / F.col("x.v")).cast("int").alias("generation"), (F.col("n") % F.col("x.v")).alias("variation")]
    return found.select("call_id", "passage", *keys, F.posexplode("x.rows").alias("row_no", "r"))


def answers(passages: DataFrame, tasks: list[Task], runtime: Runtime, id_col: str, text_col: str, selected: str | None = None) -> DataFrame:
    """What a runtime answers to all tasks, in one pass: call_id, passage, n_words,
    task, format, generation, variation, raw and error. Variations are asked right
    after the answer that they depart from."""
    specs = F.array(*[F.struct(F.lit(t.name).alias("task"), F.lit(f).alias("format"), F.lit(g).alias("generation"), F.lit(t.variations).alias("variations")) for t in tasks for f in t.formats for g in range(t.generations)])
    mine = F.filter(specs, lambda s: F.array_contains("selected_", s["task"])) if selected else specs
    calls = base_calls(passages, id_col, text_col, selected).select("call_id", "passage", count_words(F.col("passage")).alias("n_words"), F.explode(mine).alias("x"))
    calls = calls.select("call_id", "passage", "n_words", "x.*", F.lit(0).alias("variation"), F.lit(None).cast("string").alias("previous"))
    return runtime.raw(calls, {t.name: t for t in tasks})


def built(asked: DataFrame, tasks: list[Task]) -> DataFrame:
    """call_id, passage, the keys and the row of valid answers."""
    asked = typed(asked, tasks, **({"flat_": flat(F.col("passage"))} if any(t.quotes for t in tasks) else {}))
    made = F.lit(None).cast(ROWS_TYPE)
    for k, t in enumerate(tasks):
        out = F.col(f"o{k}_")
        for name, make in t.formats.items():
            made = F.when(out.isNotNull() & (F.col("format") == name), make(F.col("passage"), out).cast(ROWS_TYPE)).otherwise(made)
    return asked.select("call_id", "passage", *KEYS[:4], F.posexplode(made).alias("row_no", "r"))


def rows_of(passages: DataFrame, tasks: list[Task], runtime: Runtime | None, id_col: str, text_col: str, selected: str | None = None) -> DataFrame:
    """id_col, passage_, the keys and the rows of all tasks. Tasks that need no
    model never ask the runtime; where both kinds are wanted, passages are read
    once for each kind."""
    ruled = [t for t in tasks if t.native or runtime is None or isinstance(runtime, RuleRuntime)]
    others = [t for t in tasks if t not in ruled]
    parts = [drafted(passages, ruled, id_col, text_col, selected)] if ruled else []
    parts += [built(answers(passages, others, runtime, id_col, text_col, selected), others)] if others else []
    made = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return made.select(F.col("call_id").alias(id_col), F.col("passage").alias("passage_"), *KEYS, *[F.col(f"r.{c}").alias(c) for c in ROW])


def sample_templates(rows: DataFrame, pools: dict[str, list[str]], id_col: str, seed: int = 0) -> DataFrame:
    """rows with each instruction replaced by one of its pool; an instruction
    without a pool stays."""
    if not pools:
        return rows
    pool = F.create_map(*[x for k, v in pools.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("instruction")]
    key = F.concat_ws("|", F.col(id_col).cast("string"), "task", "format", F.col("generation").cast("string"), F.col("variation").cast("string"), F.col("row_no").cast("string"), F.lit(str(seed)))
    chosen = F.get(pool, bucket(key, F.size(pool)).cast("int"))
    return rows.withColumn("instruction", F.coalesce(chosen, F.col("instruction")))


def run_task(passages: DataFrame, task: Task | str, runtime: Runtime | None = None, id_col: str = "doc_id", text_col: str = "text", templates: bool = False, seed: int = 0) -> DataFrame:
    """id_col, task, format, generation, variation, row_no, instruction, input
    and output of one task over passages that are usable already. Tasks that
    need no model never ask the runtime."""
    (task,) = resolve_tasks(task)
    rows = rows_of(passages, [task], runtime, id_col, text_col).drop("passage_")
    return sample_templates(rows, task.templates(), id_col, seed) if templates else rows


# -- which tasks a passage gets ---------------------------------------------------
def infer_mode(tasks: object) -> str:
    """auto without tasks, sample for a mapping of chances, else explicit."""
    return "auto" if tasks is None else "sample" if isinstance(tasks, dict) else "explicit"


def gated(passages: DataFrame, runtime: Runtime | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """passages with gate, a struct of is_quality, and gate_error; none is dropped."""
    return ask(passages, GATE, runtime, F.col(id_col), F.col(text_col), "gate", "gate_error")


def prefilter(passages: DataFrame, text_col: str = "text", runtime: Runtime | None = None, id_col: str = "doc_id") -> DataFrame:
    """Passages that the gate finds worth augmenting; by rule, those of ten words
    of which half of the characters are letters. What it fails on is left out."""
    return gated(passages, runtime, id_col, text_col).where(F.coalesce(F.col("gate.is_quality"), F.lit(False))).select(*passages.columns)


def checked_chances(chances: dict[str, float]) -> dict[str, float]:
    for name, p in chances.items():
        if not 0 <= p <= 1:
            raise ValueError(f"the chance of {name!r} must be between 0 and 1")
        resolve_tasks(name)
    return chances


def sampled_tasks(chances: dict[str, float], id_col: str = "doc_id", seed: int = 0) -> Column:
    """The tasks that a passage draws, each by its own chance."""
    return drawn({"id": F.col(id_col)}, checked_chances(chances), seed)


def selected_tasks(menu: list[str] | None = None, chance: float = 0.25, id_col: str = "doc_id", seed: int = 0) -> Column:
    """A rule in place of the selecting model: the menu's tasks that a hash of the
    passage falls on."""
    return sampled_tasks(dict.fromkeys(menu or list_tasks(), chance), id_col, seed)


def select_tasks(
    passages: DataFrame, tasks: list[str | Task] | None = None, runtime: Runtime | None = None, id_col: str = "doc_id", text_col: str = "text", gate: bool = True, chance: float = 0.25, seed: int = 0,
) -> DataFrame:
    """passages with selected, the tasks of the menu (by default all) that suit
    each by their hints, and selection_error. What the gate turns down selects
    nothing. The gate and the selector are calls of the runtime."""
    menu = resolve_tasks(list(tasks) if tasks else list(TASKS))
    ready = gated(passages, runtime, id_col, text_col) if gate else passages
    fit = F.coalesce(F.col("gate.is_quality"), F.lit(False)) if gate else F.lit(True)
    asked = ask(ready.where(fit), selector(menu, chance, seed), runtime, F.col(id_col), F.col(text_col), "choice", "selection_error")
    names = F.coalesce(F.col("choice.selected"), F.array().cast("array<string>"))
    return asked.select(*passages.columns, names.alias("selected"), "selection_error")


def augment(
    passages: DataFrame,
    tasks: str | Task | list[str | Task] | dict[str, float] | None = None,
    mode: str | None = None,
    runtime: Runtime | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: bool = True,
    gate: bool = True,
    seed: int = 0,
    reasoning: bool = False,
    save_to: str | None = None,
) -> DataFrame:
    """Training rows of passages.

    explicit runs the tasks on every passage, without a gate. sample draws tasks
    by chance first and gates what drew any. auto gates, then selects from the
    menu by the tasks' hints. Gate, selector, tasks and reasoning are calls of the
    runtime; without one, rules. Passages that can't be used are left out; see
    refused. With save_to, rows are appended there as JSON lines, and what
    this call wrote is returned, so that no call is repeated by reading it.
    """
    mode = mode or infer_mode(tasks)
    if mode not in ("explicit", "sample", "auto"):
        raise ValueError(f"Unknown mode {mode!r}. Available: auto, explicit, sample")
    if mode == "sample" and not isinstance(tasks, dict) or mode == "auto" and isinstance(tasks, dict) or mode == "explicit" and (tasks is None or isinstance(tasks, dict)):
        raise TypeError(f"mode {mode!r} needs {'chances' if mode == 'sample' else 'a list of tasks'}")
    ready = usable(passages.select(id_col, text_col), text_col)
    if mode == "explicit":
        chosen, menu = ready, resolve_tasks(tasks)
    elif mode == "sample":
        chosen, menu = ready.withColumn("selected", sampled_tasks(tasks, id_col, seed)).where(F.size("selected") > 0), resolve_tasks(list(tasks))
        chosen = prefilter(chosen, text_col, runtime, id_col) if gate else chosen
    else:
        menu = resolve_tasks(tasks if tasks else list(TASKS))
        chosen = select_tasks(ready, menu, runtime, id_col, text_col, gate, seed=seed)
    rows = rows_of(chosen, menu, runtime, id_col, text_col, None if mode == "explicit" else "selected")
    if templates:
        rows = sample_templates(rows, {k: v for t in menu for k, v in t.templates().items()}, id_col, seed)
    if reasoning:
        rows = add_reasoning(rows, runtime=runtime, passage=F.col("passage_"), key=row_key(id_col))
    rows = rows.drop("passage_", "reasoning_error")
    return saved(rows, save_to) if save_to else rows


def refused(passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and error of the passages that augment leaves out: empty ones, and those
    to be cut into chunks first."""
    return validated(passages.select(id_col, text_col), text_col).where("error IS NOT NULL").select(id_col, "error")


def row_key(id_col: str = "doc_id") -> Column:
    """What tells a training row: its passage and the keys."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in (id_col, *KEYS)])


def saved(rows: DataFrame, path: str) -> DataFrame:
    """Append rows to path as JSON lines, and give back what was written now."""
    spark, full = rows.sparkSession, rows if "reasoning" in rows.columns else rows.withColumn("reasoning", F.lit(None).cast("string"))
    before = {f.rsplit("/", 1)[-1] for f in files_of(spark, path)}
    at = write_jsonl(full, path)
    mine = [f for f in files_of(spark, at) if f.rsplit("/", 1)[-1] not in before]
    return spark.read.schema(full.schema).json(mine) if mine else spark.createDataFrame([], full.schema)


def long_text_rows(docs: DataFrame, task: Task | str, runtime: Runtime | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 2000, overlap: int = 0, save_to: str | None = None) -> DataFrame:
    """Training rows of every chunk of long texts; no gate, no selection. With
    save_to they are written there first, as by augment."""
    pieces = chunk_text(docs, id_col, text_col, size, overlap)
    pieces = pieces.select(cat(F.col(id_col).cast("string"), ":", F.col("chunk_no").cast("string")).alias("chunk_id"), "text")
    rows = run_task(usable(pieces, most=None), task, runtime, "chunk_id")
    return saved(rows, save_to) if save_to else rows
