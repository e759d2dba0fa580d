"""Calls of a runtime around the tasks: gate, selector, judge, reasoning, groups,
variations; settings of the endpoint; resuming after errors."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from passageloom.operators import augment as A
from passageloom.operators import groups, judge
from passageloom.operators import runtime as R
from passageloom.plans import tasks as K
from passageloom.sources import files
from passageloom.sources.decision_log import DecisionLog
from passageloom.streaming import resumable

seen: Counter = Counter()
asked: list = []
down = set()


class Model(BaseHTTPRequestHandler):
    """Answers by the schema that the system message names."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        system, user = (m["content"] for m in body["messages"])
        kind = next(k for k in ('"selected"', '"is_quality"', '"reasoning"', '"bullets"', '"questions"', '"why"', '"answer"', '"headline"') if k in system)
        seen[kind, "unlike this one" in user] += 1
        asked.append(body)
        if any(x in user for x in down):
            self.send_error(503)
            return
        out = {
            '"selected"': {"selected": ["bullets"] if "select it if" in system else []},
            '"is_quality"': {"is_quality": "junk" not in user, "reason": "so"},
            '"reasoning"': {"reasoning": "It follows."},
            '"bullets"': {"bullets": ["again" if "unlike this one" in user else "first"]},
            '"questions"': {"questions": ["Which?"]},
            '"why"': {"why": "None does." if "none of the passages" in system else "It does."},
            '"answer"': {"answer": "They differ."},
            '"headline"': {"title": "T", "headline": "H"},
        }[kind]
        done = json.dumps({"choices": [{"message": {"content": json.dumps(out)}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(done)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture
def model(url):
    seen.clear()
    asked.clear()
    down.clear()
    return R.HttpRuntime("gpt-x", url, pause=0.01)


TEXT = "Oceans store heat for decades. Currents carry that heat to the poles."


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_auto_asks_gate_and_selector(spark, model):
    made = A.augment(frame(spark, TEXT, "junk junk"), ["bullets", "title"], "auto", model, templates=False).collect()
    assert {r.doc_id for r in made} == {0} and {r.task for r in made} == {"bullets"} and len(made) == 8
    # two gates, one selector; of each format one base answer and one variation of it
    assert seen == {('"is_quality"', False): 2, ('"selected"', False): 1, ('"bullets"', False): 2, ('"bullets"', True): 2}
    prompt = next(b for b in asked if '"selected"' in b["messages"][0]["content"])["messages"][0]["content"]
    assert K.get_task("bullets").hint in prompt and K.get_task("title").hint in prompt
    assert {r.output for r in made if r.variation == 1 and r.format == "markdown"} == {"- again"}
    with pytest.raises(ValueError, match="hint"):
        A.augment(frame(spark, TEXT), [K.get_task("title").with_knobs(hint=" ")], "auto", model)


def test_explicit_asks_no_gate(spark, model):
    assert A.augment(frame(spark, TEXT), ["title", "cloze"], runtime=model).count() == 3
    assert seen == {('"headline"', False): 1}


def test_modes_refuse_the_wrong_tasks(spark):
    for mode, tasks in (("auto", {"title": 1.0}), ("explicit", None), ("explicit", {"title": 1.0}), ("sample", ["title"])):
        with pytest.raises(TypeError):
            A.augment(frame(spark, TEXT), tasks, mode)


def test_one_scan_for_all_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = A.augment(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert {r.task for r in A.augment(docs, gate=False).select("task").distinct().collect()} == set(K.TASKS)


def test_reasoning_and_saving(spark, model, tmp_path):
    path = f"{tmp_path}/rows"
    first = A.augment(frame(spark, TEXT), ["title"], runtime=model, reasoning=True, save_to=path)
    assert {r.reasoning for r in first.collect()} == {"It follows."} and first.count() == 2
    assert seen == {('"headline"', False): 1, ('"reasoning"', False): 2}  # reading twice asks nothing
    shown = [b["messages"][1]["content"] for b in asked if "It follows" not in str(b) and '"reasoning"' in b["messages"][0]["content"]]
    assert all(TEXT in s for s in shown)
    second = A.augment(frame(spark, TEXT), ["cloze"], save_to=path)
    assert second.count() == 1 and files.count_jsonl(spark, path) == 3
    made = files.read_jsonl(spark, path).collect()
    assert sorted(str(r.reasoning) for r in made) == ["It follows.", "It follows.", "None"]
    assert A.long_text_rows(frame(spark, "word " * 900), "continuation", save_to=f"{tmp_path}/long").count() == 9
    none = A.augment(frame(spark, ""), ["title"], save_to=f"{tmp_path}/none")
    assert none.count() == 0


def test_judge_by_a_model(spark, model):
    rows = spark.createDataFrame([("Say.", "é in", "out", None), ("Say.", "junk", "o", "r")], files.ROW_SCHEMA)
    got = {r.input: r for r in judge.routed(judge.postfilter(rows, runtime=model, criteria="Be good.")).collect()}
    assert got["é in"].route == "kept" and got["junk"].route == "rejected" and got["junk"].judge.reason == "so"
    shown = next(b for b in asked if "é in" in str(b["messages"]))["messages"][1]["content"]
    want = json.dumps({"instruction": "Say.", "input": "é in", "output": "out", "reasoning": None}, ensure_ascii=False, indent=2, sort_keys=True)
    assert shown == f"Criteria:\nBe good.\n\nDatapoint:\n{want}" and asked[0]["temperature"] == 0.0 and asked[0]["max_tokens"] == 500
    for criteria in ("", "  "):
        with pytest.raises(ValueError, match="blank"):
            judge.postfilter(rows, runtime=model, criteria=criteria)
    down.add("junk")
    bad = {r.input: r for r in judge.routed(judge.postfilter(rows, runtime=model)).collect()}
    assert bad["junk"].route == "error" and bad["junk"].judge is None and "503" in bad["junk"].judge_reason


def test_groups_by_a_model(spark, model):
    made = spark.createDataFrame([(1, ["alpha", " beta "]), (2, ["one", " ", None])], "group_id long, passages array<string>")
    got = groups.comparison_rows(made, runtime=model).collect()
    assert [r.output for r in got] == ["They differ."] * 3 and seen['"answer"', False] == 3
    found = groups.retrieval(made.where("group_id = 1"), runtime=model).collect()
    assert len(found) == 8 and seen['"questions"', False] == 2 and seen['"why"', False] == 4
    assert all(("None does." if r.negative else "It does.") in r.output for r in found)


def test_settings(monkeypatch, url):
    monkeypatch.setenv("PASSAGELOOM_MODEL", "deepseek/x")
    monkeypatch.setenv("OPENAI_BASE_URL", url + "/v1/")
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    r = R.HttpRuntime(effort="low", limit_name="max_completion_tokens")
    assert (r.model, r.key, r.mode) == ("deepseek/x", "k", "json_object") and r.url.endswith("/v1/chat/completions")
    body = json.loads(r.body(K.get_task("title"), [], False))
    assert body["reasoning_effort"] == "low" and body["max_completion_tokens"] == 5000 and "max_tokens" not in body
    assert R.HttpRuntime("gpt-y").mode == "json_schema"
    for bad in ({"effort": "huge"}, {"limit_name": "tokens"}):
        with pytest.raises(ValueError, match="Unknown"):
            R.HttpRuntime(**bad)
    monkeypatch.delenv("PASSAGELOOM_MODEL")
    monkeypatch.delenv("OPENAI_BASE_URL")
    with pytest.raises(ValueError, match="PASSAGELOOM_MODEL and OPENAI_BASE_URL"):
        R.HttpRuntime()


def test_answers_without_json():
    one = R.json_schema("label string")
    assert R.bare("supported", one) == '{"label": "supported"}' and R.bare('{"label": "x"}', one) == '{"label": "x"}'
    assert R.bare("True", R.json_schema("is_quality boolean")) == '{"is_quality": true}' and R.bare("x", R.json_schema("a string, b string")) == "x"
    assert R.balanced_object("{" * 5000) is None and R.balanced_object('a {b} {"c": {"d": "}"}} e') == '{"c": {"d": "}"}}'


def test_files_of_a_run(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in range(4)], "a long")
    at = files.write_jsonl(rows, f"{tmp_path}/x")
    files.rewrite_jsonl(spark, spark.read.json(at).where("a > 1"), at)
    assert sorted(r.a for r in spark.read.json(at).collect()) == [2, 3] and len(list(tmp_path.iterdir())) == 1
    (tmp_path / "prompt.txt").write_text("Be\nkind. ")
    (tmp_path / "blank.txt").write_text(" ")
    assert files.read_prompt(spark, f"{tmp_path}/prompt.txt", "d") == "Be\nkind." and files.read_prompt(spark, None, "d") == "d"
    with pytest.raises(ValueError, match="blank"):
        files.read_prompt(spark, f"{tmp_path}/blank.txt", "d")


def test_failed_rows_are_judged_again(spark, model, tmp_path):
    """Errors on the first run, none on the second: every row is decided, once."""
    rows = [(k, "Say.", f"row {k} of the input", "out", None) for k in range(6)] + [(2_500_000, "Say.", "junk", "out", None)]
    spark.createDataFrame(rows, "row_index long, " + files.ROW_SCHEMA).write.parquet(f"{tmp_path}/in")

    def run():
        source = files.read_passages(spark, f"{tmp_path}/in", streaming=True)
        resumable.judge_stream(spark, source, f"{tmp_path}/out", f"{tmp_path}/cp", runtime=model).awaitTermination()
        return Counter(r.route for r in resumable.read_log(spark, f"{tmp_path}/out").collect())

    down.update({"row 1 of", "row 4 of"})
    assert run() == {"kept": 4, "rejected": 1, "error": 2}
    down.remove("row 1 of")
    assert run() == {"kept": 5, "rejected": 1, "error": 3}  # row 4 fails again
    down.clear()
    assert run() == {"kept": 6, "rejected": 1, "error": 3}
    before = len(asked)
    assert run() == {"kept": 6, "rejected": 1, "error": 3} and len(asked) == before
    log = DecisionLog(spark, f"{tmp_path}/out")
    assert log.failed().count() == 0 and judge.compacted(log.read()).count() == 7
    assert log.unfinished(spark.range(8).withColumnRenamed("id", "row_index"), 1).first()[0] == 6
