"""Where structured answers come from.

A runtime takes calls, one row each with call_id, passage and what a task adds,
and returns them with out, the task's struct (null where there is no valid
answer), and error.

RuleRuntime drafts an answer from the passage by rule, in native columns. It is
no model and says nothing of one; with it every task runs at any size and can be
checked. TableRuntime looks answers up. HttpRuntime asks a chat endpoint, the
variations of an answer right after it, so that each is asked once.

What a model answers is read as VARIANT and walked by the task's schema tree; see
typed and quarantine.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import barrier, count_words, maskable, sentences, words
from ..plans.schema import Fields, from_ddl
from ..plans.tasks import Task

#: What a model offers by the first of these that its name holds;
#: a JSON object where it holds none.
MODELS = (
    ("deepseek/", "json_object"),
    ("deepseek", "json_object"),
    ("openai/", "json_schema"),
    ("gpt", "json_schema"),
    ("google/", "json_schema"),
    ("gemini", "json_schema"),
    ("anthropic/", "json_object"),
    ("claude", "json_object"),
    ("minimax/", "json_object"),
    ("glm", "json_object"),
    ("z-ai/", "json_object"),
)
MODES = ("auto", "json_schema", "json_object")


#: What a call has besides call_id and passage, where nothing else is said.
DEFAULTS = {"task": ("", "string"), "format": ("", "string"), "generation": (0, "int"), "variation": (0, "int"), "variations": (0, "int"), "previous": (None, "string")}


def completed(calls: DataFrame) -> DataFrame:
    missing = {n: F.lit(v).cast(kind) for n, (v, kind) in DEFAULTS.items() if n not in calls.columns}
    if "n_words" not in calls.columns:
        missing["n_words"] = count_words(F.col("passage"))
    return calls.withColumns(missing) if missing else calls


class Runtime(ABC):
    #: Whether an answer depends on the call's task, id and numbers only, so that the
    #: passage may be left out of it.
    by_key = False

    @abstractmethod
    def raw(self, calls: DataFrame, tasks: dict[str, Task]) -> DataFrame:
        """Calls of several tasks (task), each with as many variations as it says
        (variations), as one row per answer: with variation, raw and error."""

    def apply(self, calls: DataFrame, task: Task) -> DataFrame:
        """calls with out, error and attempts, how often it was asked for."""
        asked = self.raw(completed(calls).withColumn("task", F.lit(task.name)), {task.name: task})
        found = typed(asked, [task]).withColumn("out", F.col("o0_"))
        return found.select(*calls.columns, *[c for c in ("format", "generation", "variation") if c not in calls.columns], "out", "error", "attempts")


def checked(calls: DataFrame, task: Task, out: Column) -> DataFrame:
    """calls with out, a struct, where it is valid, and error where it isn't."""
    made = barrier(calls, out=out)
    found = F.when(~task.valid(F.col("out"), F.col("n_words")), "no answer")
    return made.withColumn("error", found).withColumn("out", F.when(F.col("error").isNull(), F.col("out")))


def typed(asked: DataFrame, tasks: list[Task], **more: Column) -> DataFrame:
    """Raw answers read strictly: asked with o0_, o1_ and so on, the struct of each
    task where the answer is one of it and valid; problems_, what is wrong by place,
    null where no answer came; and error. more are columns computed with them."""
    raw, v, n, task = (F.col(c) for c in ("raw", "v_", "n_words", "task"))
    read = barrier(asked, v_=F.try_parse_json(raw), **more)
    found = F.array(F.lit("no such task"))
    for t in tasks:
        found = F.when(task == t.name, t.tree.problems(v, F.lit(""), n)).otherwise(found)
    said = F.when(raw.isNull() | (raw == ""), F.array(F.lit("empty response"))).when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(found)
    read = barrier(read, problems_=F.when(F.col("error").isNull(), said))
    good = F.size("problems_") == 0
    read = barrier(read, **{f"o{k}_": F.when(good & (task == t.name), t.tree.value(v)) for k, t in enumerate(tasks)})
    wrong = F.when(F.size("problems_") > 0, F.array_join("problems_", "; "))
    return read.drop("v_").withColumn("error", F.coalesce("error", wrong))


def quarantine(asked: DataFrame, tasks: list[Task]) -> DataFrame:
    """What is wrong with answers, a row for each thing: call_id, task, format,
    generation, variation, place (null where no answer came), problem and raw."""
    bad = typed(asked, tasks).where("error IS NOT NULL")
    each = F.explode(F.coalesce("problems_", F.array("error"))).alias("p")
    bad = bad.select("call_id", "task", "format", "generation", "variation", each, (F.col("problems_").isNotNull()).alias("came"), "raw")
    placed = F.col("came") & F.col("p").contains(": ")
    place = F.when(placed, F.substring_index("p", ": ", 1))
    problem = F.when(placed, F.substring(F.col("p"), F.length(place) + 3, F.length("p"))).otherwise(F.col("p"))
    return bad.select("call_id", "task", "format", "generation", "variation", place.alias("place"), problem.alias("problem"), "raw")


class Parts(dict):
    """What rules look at: id, t (text), w, s and c (words, sentences, maskable
    words), and any further column of the call; notes which were taken."""

    def __init__(self):
        self.taken: set[str] = set()

    def __getitem__(self, name: str) -> Column:
        self.taken.add(name)
        return F.col({"id": "call_id", "t": "passage", "w": "w_", "s": "s_", "c": "c_"}.get(name, name))


def with_parts(calls: DataFrame, taken: set[str]) -> DataFrame:
    """calls with those parts and n_words, each computed once."""
    p = F.col("passage")
    first = {"w_": words(p)} | ({"s_": sentences(p)} if "s" in taken else {}) | ({"c_": maskable(p)} if "c" in taken else {})
    return barrier(calls, **first).withColumn("n_words", F.size("w_"))


class RuleRuntime(Runtime):
    def raw(self, calls: DataFrame, tasks: dict[str, Task]) -> DataFrame:
        """The drafts as JSON, null where a rule makes none; variations of an answer are
        the answer. Within the library drafts stay structs; see apply and
        augment.drafted."""
        x = Parts()
        drafts = {n: F.to_json(t.draft(x).cast(t.tree.ddl())) for n, t in tasks.items()}
        parts = with_parts(calls, x.taken)
        said = F.lit(None).cast("string")
        for n, draft in drafts.items():
            said = F.when(F.col("task") == n, draft).otherwise(said)
        made = parts.withColumns({"raw": said, "error": F.lit(None).cast("string"), "attempts": F.lit(0)})
        made = made.withColumn("variation", F.explode(F.sequence(F.col("variation"), F.col("variation") + F.col("variations"))))
        return made.select(*calls.columns, "raw", "error", "attempts")

    def apply(self, calls: DataFrame, task: Task) -> DataFrame:
        x = Parts()
        out = task.draft(x).cast(task.tree.ddl())
        made = checked(with_parts(calls, x.taken), task, out).withColumn("attempts", F.lit(0))
        return made.drop(*({"w_", "s_", "c_", "n_words"} - set(calls.columns)))


class TableRuntime(Runtime):
    """Answers from a table (task, call_id, raw): raw is JSON. Variations of an
    answer are the answer. Where calls share answers, the table may have `answer`, a
    number or name, instead of raw, and texts (answer, raw) holds each text once: apply
    then reads a text once for each number of words, not for each call."""

    by_key = True

    def __init__(self, answers: DataFrame, texts: DataFrame | None = None):
        self.answers, self.texts = answers, texts

    def looked_up(self, calls: DataFrame, tasks: dict[str, Task]) -> DataFrame:
        """calls, one row per answer, with what the table has for it: raw or answer."""
        found = self.answers.where(F.col("task").isin(*tasks)).select(F.col("task").alias("of_task"), F.col("call_id").cast("string").alias("answer_id"), "raw" if self.texts is None else "answer")
        joined = calls.join(found, (F.col("task") == F.col("of_task")) & (F.col("call_id").cast("string") == F.col("answer_id")), "left").drop("of_task", "answer_id")
        return joined.withColumn("variation", F.explode(F.sequence(F.col("variation"), F.col("variation") + F.col("variations"))))

    def raw(self, calls: DataFrame, tasks: dict[str, Task]) -> DataFrame:
        joined = self.looked_up(calls, tasks)
        if self.texts is not None:
            joined = joined.join(self.texts, "answer", "left").drop("answer")
        return joined.withColumns({"error": F.lit(None).cast("string"), "attempts": F.lit(1)})

    def apply(self, calls: DataFrame, task: Task) -> DataFrame:
        if self.texts is None:
            return super().apply(calls, task)
        asked = self.looked_up(completed(calls).withColumn("task", F.lit(task.name)), {task.name: task})
        tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much to read
        shared = asked.select("task", "answer", "n_words").distinct().repartition(tasks, "answer", "n_words").join(self.texts, "answer", "left")
        read = typed(shared.withColumn("error", F.lit(None).cast("string")), [task]).select(F.col("answer").alias("answer_"), F.col("n_words").alias("n_words_"), F.col("o0_").alias("out"), "error")
        found = asked.join(read, F.col("answer").eqNullSafe(F.col("answer_")) & F.col("n_words").eqNullSafe(F.col("n_words_")))
        return found.select(*calls.columns, *[c for c in ("format", "generation", "variation") if c not in calls.columns], "out", "error", F.lit(1).alias("attempts"))


def ask(rows: DataFrame, task: Task, runtime: Runtime | None, call_id: Column, passage: Column, out: str = "out", error: str = "error", attempts: str | None = None, **fields: Column) -> DataFrame:
    """rows with out and error of one call each, and attempts if it has a name;
    fields are what the task's rule looks at besides the passage. Columns of those
    names are replaced."""
    own = [c for c in rows.columns if c not in (out, error, attempts)]
    calls = rows.select(F.struct(*own).alias("own_"), call_id.alias("call_id"), passage.alias("passage"), *[v.alias(k) for k, v in fields.items()])
    made = (runtime or RuleRuntime()).apply(calls, task)
    return made.select("own_.*", F.col("out").alias(out), F.col("error").alias(error), *([F.col("attempts").alias(attempts)] if attempts else []))


def json_schema(schema: str | dict | Fields, n_words: int | None = None) -> dict:
    """The JSON schema of a tree or of a table schema, with bounds for a passage of
    n_words; one that is there already stays."""
    if isinstance(schema, dict):
        return schema
    return (from_ddl(schema) if isinstance(schema, str) else schema).json_schema(n_words)


def balanced_object(text: str) -> str | None:
    """The first JSON object in a text; a "{" that begins none is passed over."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except (json.JSONDecodeError, RecursionError):
            at = text.find("{", at + 1)
    return None


def recovered(raw: str | None) -> str | None:
    """raw where it is a JSON object, else the first object in it."""
    if not raw:
        return raw
    try:
        if isinstance(json.loads(raw.strip()), dict):
            return raw.strip()
    except (ValueError, RecursionError):
        pass
    return balanced_object(raw) or raw


def bare(raw: str | None, schema: dict) -> str | None:
    """raw as the object of a schema with one string field, where the model has
    answered with the string alone."""
    fields = schema.get("properties", {})
    if not raw or len(fields) != 1 or raw.lstrip()[:1] in ("{", "["):
        return raw
    name, kind = next(iter(fields.items()))
    if kind.get("type") == "boolean" and raw.strip().lower() in ("true", "false"):
        return json.dumps({name: raw.strip().lower() == "true"})
    return json.dumps({name: raw.strip().strip('"')}) if kind.get("type") == "string" else raw


def response_mode(model: str, mode: str = "auto") -> str:
    if mode not in MODES:
        raise ValueError(f"Unknown response format {mode!r}. Available: {', '.join(MODES)}")
    if mode != "auto":
        return mode
    return next((kind for part, kind in MODELS if part in model.lower()), "json_object")


def response_format(mode: str, schema: str | dict | Fields) -> dict:
    if mode == "json_schema":
        return {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": json_schema(schema)}}
    return {"type": "json_object"}


def messages(task: Task, passage: str, fmt: str = "", previous: str | None = None, n_words: int | None = None) -> list[dict[str, str]]:
    """The chat of a call; previous is the answer that a variation departs from."""
    extra = task.format_prompts.get(fmt, "")
    system = "\n\n".join(x for x in (task.prompt.strip(), extra.strip()) if x)
    user = passage if previous is None else f"{passage}\n\nGive another answer of the same form, unlike this one:\n{previous}"
    return with_schema([{"role": "system", "content": system}, {"role": "user", "content": user}], task.tree.json_schema(n_words))


def with_schema(chat: list[dict[str, str]], schema: str | dict | Fields) -> list[dict[str, str]]:
    """The chat with the schema in its last system message, or in a new first one."""
    note = "Answer with one JSON object of this schema:\n" + json.dumps(json_schema(schema), ensure_ascii=False)
    last = max((k for k, m in enumerate(chat) if m["role"] == "system"), default=None)
    if last is None:
        return [{"role": "system", "content": note}, *chat]
    return [{**m, "content": f"{m['content']}\n\n{note}"} if k == last else m for k, m in enumerate(chat)]


#: How hard a model may be asked to think; names of the token limit;
#: client errors that may pass.
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")
LIMITS = ("max_tokens", "max_completion_tokens")
PASSING = (408, 409, 425, 429)


def spread(calls: DataFrame, partitions: int) -> DataFrame:
    """calls dealt to partitions so that each gets as many of any length, the long
    ones first: sorted by length in ranges, each range dealt out in turn."""
    ranged = calls.repartitionByRange(F.col("n_words").desc())
    return ranged.repartition(partitions).sortWithinPartitions(F.col("n_words").desc())


class HttpRuntime(Runtime):
    """Asks an endpoint that speaks the chat-completions protocol.

    model, base_url and api_key are taken from the environment where they aren't
    given: PASSAGELOOM_MODEL, OPENAI_BASE_URL and OPENAI_API_KEY. Each task keeps
    at most `concurrent` requests open. With `cap`, calls are dealt to so few tasks,
    evenly by length, that no more than cap requests are open at once, however many
    cores there are (calls that follow one another, as of gate and tasks, don't run at
    once; jobs that do have a cap each); with `partitions`, to so many tasks. Failed requests and answers
    that the task's schema refuses are tried again, `attempts` times in all, after a
    growing pause; errors that stay, such as a wrong key, aren't. What fails for good
    becomes an error column, never an exception. Materialise what comes back before
    it is read twice, else calls are repeated.
    """

    def __init__(
        self, model: str | None = None, base_url: str | None = None, api_key: str | None = None, mode: str = "auto", concurrent: int = 8, attempts: int = 3, pause: float = 0.5,
        timeout: float = 120, partitions: int | None = None, extra: dict | None = None, effort: str | None = None, limit_name: str = "max_tokens", cap: int | None = None,
    ):
        given = {"PASSAGELOOM_MODEL": model, "OPENAI_BASE_URL": base_url, "OPENAI_API_KEY": api_key}
        found = {name: value or os.environ.get(name, "") for name, value in given.items()}
        if lacking := [name for name in ("PASSAGELOOM_MODEL", "OPENAI_BASE_URL") if not found[name]]:
            raise ValueError(f"give model and base_url, or set {' and '.join(lacking)}")
        for name, number in (("concurrent", concurrent), ("attempts", attempts), ("cap", 1 if cap is None else cap)):
            if number <= 0:
                raise ValueError(f"{name} must be greater than 0")
        if cap is not None and partitions is not None:
            raise ValueError("give cap or partitions")
        if effort is not None and effort not in EFFORTS:
            raise ValueError(f"Unknown effort {effort!r}. Available: {', '.join(EFFORTS)}")
        if limit_name not in LIMITS:
            raise ValueError(f"Unknown name of the token limit {limit_name!r}. Available: {', '.join(LIMITS)}")
        self.model, base_url, self.key = found.values()
        self.url, self.mode = base_url.rstrip("/") + "/chat/completions", response_mode(self.model, mode)
        self.concurrent, self.attempts, self.pause, self.timeout = min(concurrent, cap or concurrent), attempts, pause, timeout
        self.partitions = partitions if cap is None else cap // self.concurrent
        self.extra, self.limit_name = ({"reasoning_effort": effort} if effort else {}) | (extra or {}), limit_name

    def body(self, task: Task, chat: list[dict[str, str]], variation: bool, n_words: int | None = None) -> bytes:
        sent = {"model": self.model, "messages": chat, "temperature": task.variation_temperature if variation else task.temperature, self.limit_name: task.max_tokens}
        sent["response_format"] = response_format(self.mode, task.tree.json_schema(n_words))
        return json.dumps(sent | self.extra).encode()

    def once(self, body: bytes) -> tuple[str | None, str | None, bool]:
        """The answer's text, the error, and whether it may pass."""
        try:
            head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as got:
                text = json.load(got)["choices"][0]["message"]["content"]
            return (text, None, True) if text else (None, "empty response", True)
        except Exception as why:  # noqa: BLE001  it becomes the row's error
            stays = isinstance(why, urllib.error.HTTPError) and 400 <= why.code < 500 and why.code not in PASSING
            return None, f"{type(why).__name__}: {why}"[:500], not stays

    def ask(self, body: bytes, task: Task, n_words: int) -> tuple[str | None, str | None, int]:
        """The answer's JSON, the error and how often was asked. An answer that is
        refused to the end is returned as it is, to be refused by its column."""
        text = error = None
        for n in range(1, self.attempts + 1):
            text, error, passing = self.once(body)
            if text is not None:
                text = bare(recovered(text), json_schema(task.tree))
                try:
                    if not task.tree.problems_of(json.loads(text), n_words=n_words):
                        break
                except (ValueError, RecursionError):
                    pass
            elif not passing:
                break
            if n < self.attempts:
                time.sleep(self.pause * n)
        return text, error, n

    def raw(self, calls: DataFrame, tasks: dict[str, Task]) -> DataFrame:
        # what a worker needs of the tasks; table schemas are read here, on the driver
        plain = {n: t.with_knobs(formats={}, draft=None, shape=t.tree) for n, t in tasks.items()}

        def chain(task: str, passage: str, fmt: str, variation: int, variations: int, previous: str | None, n_words: int) -> list[tuple]:
            """variation, raw, error and attempts of an answer and its variations."""
            out, t = [], plain[task]
            for v in range(variation, variation + variations + 1):
                text, error, n = self.ask(self.body(t, messages(t, passage, fmt, previous, n_words), bool(v), n_words), t, n_words)
                out.append((v, text, error, n))
                if v == variation and text is None:
                    break  # nothing to depart from
                previous = out[0][1] if previous is None else previous
            return out

        def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.concurrent) as pool:
                for frame in frames:
                    given = [frame[c].tolist() for c in ("task", "passage", "format", "variation", "variations", "previous", "n_words")]
                    found = list(pool.map(chain, *given))
                    made = frame.loc[frame.index.repeat([len(x) for x in found])].copy()
                    made["variation"], made["raw"], made["error"], made["attempts"] = ([x[k] for f in found for x in f] for k in range(4))
                    yield made

        if self.partitions:
            calls = spread(calls, self.partitions)
        return calls.mapInPandas(answer, T.StructType([*calls.schema.fields, *T.StructType.fromDDL("raw string, error string, attempts int").fields]))
