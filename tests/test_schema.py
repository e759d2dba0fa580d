"""One tree of an answer: what a model is told, what is accepted, and what is said of
the rest."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from passageloom.operators import augment as A
from passageloom.operators import groups, judge
from passageloom.operators import runtime as R
from passageloom.plans import run_queries
from passageloom.plans import schema as S
from passageloom.plans import tasks as K
from passageloom.sources import files

ALL = K.SINGLE + [K.COMPARISON, K.RETRIEVAL, K.REASON, K.NO_ANSWER, K.GATE, K.JUDGE, K.REASONING, K.selector(K.SINGLE)]


def leaves(node, path=""):
    if isinstance(node, S.Fields):
        return [x for n, c in node.of for x in leaves(c, f"{path}.{n}")]
    return [(path, node)] + (leaves(node.of, path + "[]") if isinstance(node, S.Items) else [])


def told(schema, path):
    for part in path.strip(".").replace("[]", ".[]").split("."):
        schema = schema["items"] if part == "[]" else schema["properties"][part]
    return schema


@pytest.mark.parametrize("task", ALL, ids=lambda t: t.name)
def test_the_schema_that_is_told_has_every_bound(task):
    made = R.json_schema(task.tree, 1000)
    body = json.loads(R.HttpRuntime("gpt-x", "http://x").body(task, R.messages(task, "p", n_words=1000), False, 1000))
    assert body["response_format"]["json_schema"]["schema"] == made and json.dumps(made, ensure_ascii=False) in body["messages"][0]["content"]
    for path, node in leaves(task.tree):
        here = told(made, path)
        if isinstance(node, S.Text):
            assert here.get("enum", []) == list(node.choices) and here.get("maxLength") == node.bound(1000)
        if isinstance(node, S.Items):
            assert (here.get("minItems", 0), here.get("maxItems")) == (node.least, node.most)


def test_what_grows():
    length = lambda t, n: [x.bound(n) for _, x in leaves(K.get_task(t).tree) if isinstance(x, S.Text)]
    assert length("qa_pairs", 7) == [None, None] and length("qa_pairs", 8) == [320, 500] and length("qa_pairs", 100) == [4000, 4000]
    assert length("summarize", 10) == [200, 1000] and length("summarize", 1000) == [200, 4000]
    assert K.get_task("classification").tree.json_schema()["properties"]["tone"]["enum"] == list(K.TONES)
    assert K.selector([K.get_task("title"), K.get_task("cloze")]).tree.json_schema()["properties"]["selected"]["items"]["enum"] == ["title", "cloze"]


CASES = ['{"a": "x", "n": 3, "ok": "Yes", "xs": [{"b": ["p", "q"]}], "extra": {"k": 1}}', '{"a": "xxxx", "n": 3, "ok": 1, "xs": []}', '{"a": 1, "n": "x", "ok": 5, "xs": {}}', '{"a": null, "ok": null}',
         '{"a": "x", "n": 2, "ok": false, "xs": [{"b": ["p"]}, 7, {"b": ["p", 1]}, {}]}', '{"a": "é🙂x", "n": 2, "ok": true, "xs": [{"b": ["z", "q"]}]}', "[]", '"a"', "7"]


def test_columns_and_workers_say_the_same(spark):
    tree = S.fields(a=S.Text(3), n=S.Other("bigint"), ok=S.Flag(), xs=S.many(1, 4, b=S.many(2, 2, S.Text(choices=("p", "q")))))
    task = K.Task("t", "p", tree, {})
    frame = spark.createDataFrame([(k, c, None) for k, c in enumerate(CASES)], "call_id int, raw string, error string").withColumns({"task": F.lit("t"), "n_words": F.lit(5)})
    got = {r.call_id: r for r in R.typed(frame, [task]).collect()}
    for k, c in enumerate(CASES):
        want = tree.problems_of(json.loads(c), n_words=5)
        assert got[k].problems_ == want, c
        assert (got[k].o0_ is None) == bool(want) and (got[k].error is None) == (not want)
    assert got[0].o0_.asDict(True) == {"a": "x", "n": 3, "ok": True, "xs": [{"b": ["p", "q"]}]}
    assert "xs[1]: not an object" in got[4].problems_ and got[3].problems_ == ["a: not a string", "n: missing", "ok: not a boolean", "xs: missing"]


def test_strict_answers_make_rows_only_if_sound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    wrong = run_queries.strict_answers(spark, sf)
    bad = {r.doc_id for r in wrong.where("task = 'title'").collect()}
    said = [raw for raw, _ in run_queries.ANSWERS["title"]]
    table = docs.select(F.lit("title").alias("task"), F.col("doc_id").alias("call_id"), F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % len(said) + 1).cast("int")).alias("raw"))
    made = {r.doc_id for r in A.run_task(docs, "title", R.TableRuntime(table)).collect()}
    assert made.isdisjoint(bad) and made | bad == {r.doc_id for r in docs.collect()}


# -- an endpoint that counts
class Slow(BaseHTTPRequestHandler):
    lock, now, peak, seen, bodies, replies, status = threading.Lock(), 0, 0, Counter(), [], {}, {}

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        user = body["messages"][-1]["content"]
        with self.lock:
            Slow.now += 1
            Slow.peak = max(Slow.peak, Slow.now)
            self.seen[user] += 1
            self.bodies.append(body)
        time.sleep(0.02)
        reply = self.replies.get(user, ['{"title": "t", "headline": "h"}'])
        text = reply[min(self.seen[user], len(reply)) - 1]
        with self.lock:
            Slow.now -= 1
        if user in self.status:
            self.send_error(self.status[user])
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Slow.seen.clear(), Slow.bodies.clear(), Slow.replies.clear(), Slow.status.clear()
    Slow.now = Slow.peak = 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Slow)
    server.request_queue_size = 64
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def title_calls(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return A.calls_of(docs, K.get_task("title"), "doc_id", "text")


def test_refused_answers_are_asked_for_again(spark, url):
    good = '{"title": "t", "headline": "h"}'
    Slow.replies |= {"a": ['{"title": 1}', good], "b": ["no", "{}", good], "c": ['{"title": "t"}'], "d": [good]}
    Slow.status |= {"e": 401, "f": 429}
    got = {r.passage: r for r in R.HttpRuntime("m", url, pause=0.01).apply(title_calls(spark, "abcdef"), K.get_task("title")).collect()}
    assert {k: r.attempts for k, r in got.items()} == {"a": 2, "b": 3, "c": 3, "d": 1, "e": 1, "f": 3} == {k: n for k, n in Slow.seen.items()}
    assert {k for k, r in got.items() if r.out} == set("abd") and got["c"].error == "headline: missing" and "401" in got["e"].error and "429" in got["f"].error


def test_no_more_open_requests_than_the_cap(spark, url):
    made = R.HttpRuntime("m", url, concurrent=4, cap=6, pause=0.01).apply(title_calls(spark, [f"p{k}" for k in range(80)]), K.get_task("title"))
    assert made.where("out IS NOT NULL").count() == 80 and Slow.peak <= 6
    for bad in ({"cap": 0}, {"attempts": 0}, {"cap": 3, "partitions": 2}):
        with pytest.raises(ValueError):
            R.HttpRuntime("m", url, **bad)


def test_calls_are_spread_by_length(spark):
    n = F.when(F.col("id") % 50 == 0, 3000).otherwise(F.col("id") % 40 + 1)
    calls = spark.range(0, 4000, 1, 4).orderBy(F.col("id") % 50).select(n.cast("int").alias("n_words"))  # the long ones side by side
    loads = [r["sum"] for r in R.spread(calls, 8).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("n_words").alias("sum")).collect()]
    assert len(loads) == 8 and max(loads) <= 1.5 * sorted(loads)[4]


def test_attempts_of_the_judge_are_kept(spark, url):
    Slow.replies |= {}
    rows = spark.createDataFrame([("Say.", "in", "out", None)], files.ROW_SCHEMA)
    got = judge.postfilter(rows, runtime=R.HttpRuntime("m", url, pause=0.01)).first()
    assert got.judge_error and got.judge_attempts == 3 and got.judge_reason == "is_quality: missing; reason: missing"


def test_groups_read_reasons_strictly(spark):
    table = spark.createDataFrame([("retrieval", "1:0", '{"questions": ["q?"]}'), ("retrieval", "1:1", '{"questions": ["q?"]}'), ("retrieval_reason", "1:0:0", '{"why": 5}'), ("retrieval_reason", "1:1:0", '{"why": "w"}')], "task string, call_id string, raw string")
    made = spark.createDataFrame([(1, ["a b", "c d"])], "group_id long, passages array<string>")
    assert groups.retrieval(made, runtime=R.TableRuntime(table), seed=None).select("passage_no").distinct().collect() == [(1,)]


def test_rules_answer_as_json_too(spark):
    docs = spark.createDataFrame([(1, "Oceans store heat for decades. Currents carry that heat to the poles! Ice answers slowly."), (2, "too short")], "doc_id long, text string")
    tasks = [K.get_task("title"), K.get_task("bullets"), K.get_task("cloze")]
    made = A.built(A.answers(docs, tasks, R.RuleRuntime(), "doc_id", "text"), tasks)
    want = A.drafted(docs, tasks, "doc_id", "text")
    assert made.select(want.columns).exceptAll(want).count() == 0 == want.exceptAll(made.select(want.columns)).count() and want.count() > 8


def test_what_augment_leaves_out(spark):
    docs = spark.createDataFrame([(1, "x" * 3001), (2, " "), (3, "fine"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.error for r in A.refused(docs).collect()}
    assert set(got) == {1, 2, 4} and "3,001 characters" in got[1]


def test_scratch_folders_are_cleared(spark, sf):
    made = run_queries.log_snapshot(spark, sf).count()
    at = files.scratch(spark, "x").rsplit("/", 1)[0]
    assert made > 0 and files.path_exists(spark, at)
    files.clear_scratch(spark)
    assert not files.path_exists(spark, at)
