"""Endpoints, files and streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from passageloom.operators import augment as A
from passageloom.operators import runtime as R
from passageloom.plans import tasks as K
from passageloom.sources import files
from passageloom.streaming.resumable import judge_stream, read_log


class Endpoint(BaseHTTPRequestHandler):
    failed = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        passage = body["messages"][-1]["content"]
        if "never" in passage or ("once" in passage and passage not in self.failed):
            self.failed.add(passage)
            self.send_error(503)
            return
        text = "Here it is:\n```json\n" + json.dumps({"title": passage[:5], "headline": "h {x}"}) + "\n```"
        out = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_runtime(spark, url):
    docs = spark.createDataFrame([(1, "alpha"), (2, "once more"), (3, "never")], "doc_id long, text string").coalesce(1)
    runtime = R.HttpRuntime("gpt-5-x", url, pause=0.01, concurrent=2)
    calls = runtime.apply(A.calls_of(docs, K.get_task("title"), "doc_id", "text"), K.get_task("title")).collect()
    assert {r.call_id: r.error is None for r in calls} == {1: True, 2: True, 3: False}
    made = A.run_task(docs, "title", runtime).where("row_no = 0").collect()
    assert {r.output for r in made} == {"alpha", "once "}
    with pytest.raises(ValueError):
        R.HttpRuntime("m", url, concurrent=0)


def test_requests(spark):
    assert R.recovered('x {"a": "}"} y') == '{"a": "}"}' and R.recovered("none") == "none" and R.recovered(None) is None
    assert [R.response_mode(m) for m in ("openai/gpt-5-nano", "some-model")] == ["json_schema", "json_object"]
    with pytest.raises(ValueError):
        R.response_mode("m", "odd")
    chat = [{"role": "system", "content": "a"}, {"role": "user", "content": "b"}, {"role": "system", "content": "c"}]
    done = R.with_schema(chat, "x string")
    assert done[0]["content"] == "a" and done[2]["content"].startswith("c\n\n") and R.with_schema(chat[1:2], "x string")[0]["role"] == "system"
    assert "previous" in R.messages(K.get_task("title"), "p", "plain", "previous")[-1]["content"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("i", "é", "o", None)], files.ROW_SCHEMA)
    assert files.count_jsonl(spark, f"{tmp_path}/rows") == 0
    path = files.write_jsonl(rows, f"{tmp_path}/rows")
    files.write_jsonl(rows, path)
    assert path.endswith(".jsonl") and files.count_jsonl(spark, path) == 2
    assert '"reasoning":null' in spark.read.text(path).first()[0] and files.read_jsonl(spark, path).first().input == "é"
    files.write_metadata(spark, f"{tmp_path}/meta", model="m", rows=2)
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first()[0]) == {"model": "m", "rows": 2}


def test_last_decision_is_the_latest_file(spark, tmp_path):
    at = f"{tmp_path}/decisions"
    for k in range(5):
        decision = (1, k % 2 == 0, str(k), False, ("i", "in", str(k), None))
        files.write_jsonl(spark.createDataFrame([decision], files.DECISION_SCHEMA).coalesce(1), at)
    files.write_jsonl(spark.createDataFrame([(1, False, "failed", True, None)], files.DECISION_SCHEMA).coalesce(1), at)
    done = files.compact_outputs(spark, at, f"{tmp_path}/kept", f"{tmp_path}/rejected")
    assert [(r.row_index, r.reason, r.is_quality) for r in done.collect()] == [(1, "4", True)]
    assert files.read_jsonl(spark, f"{tmp_path}/kept").first().output == "4" and files.count_jsonl(spark, f"{tmp_path}/rejected") == 0


def test_stream_resumes(spark, tmp_path):
    def add(part, first, n):
        rows = [(k, "in put", "out" if k % 2 else "") for k in range(first, first + n)]
        spark.createDataFrame(rows, "row_index long, input string, output string").write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = files.read_passages(spark, f"{tmp_path}/in", streaming=True)
        judge_stream(spark, source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return read_log(spark, f"{tmp_path}/out").groupBy("route").count().collect()

    add(0, 0, 6)
    assert {r.route: r["count"] for r in run()} == {"kept": 3, "rejected": 3}
    assert {r.route: r["count"] for r in run()} == {"kept": 3, "rejected": 3}
    add(1, 4, 4)  # two rows come again
    assert {r.route: r["count"] for r in run()} == {"kept": 4, "rejected": 4}


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    query = A.run_task(stream, "continuation").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    batch = A.run_task(spark.read.parquet(f"{sf}/documents.parquet"), "continuation")
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(batch).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()
