"""How many rows each task makes of an answer, and what they hold."""

import json

import pytest

from passageloom.functions import text as X
from passageloom.operators import augment as A
from passageloom.operators import chunk, groups, judge
from passageloom.operators.runtime import TableRuntime
from passageloom.plans import tasks as K
from pyspark.sql import functions as F

P = "Oceans store heat for decades. Currents carry that heat to the poles! Does ice answer slowly? Models track it with floats and satellites."
FAKE = "Nothing of the kind is said."
ANSWERS = {
    "title": ({"title": "Seas", "headline": "Seas keep heat"}, 2),
    "summarize": ({"tldr": "Seas.", "summary": "Seas keep heat."}, 2),
    "classification": ({"topic": "seas", "tone": "technical", "audience": "students"}, 3),
    "rephrase": ({"rephrased": "Heat stays in the sea."}, 1),
    "style_transfer": ({"rewritten": "The sea is warm."}, 1),
    "backtranslation": ({"instruction": "Write on the sea."}, 1),
    "counterfactual": ({"original_claim": "a", "altered_premise": "b", "question": "c?", "consequence": "d"}, 1),
    "section_heading": ({"heading": "Heat", "rationale": "It fits."}, 2),
    "error_correction": ({"corrupted_passage": "Oceens.", "correction_notes": "Spelling."}, 2),
    "bullets": ({"bullets": ["a", "it's"]}, 8),
    "qa_pairs": ({"qa_pairs": [{"question": f"q{k}", "answer": f"a{k}"} for k in range(3)]}, 24),
    "triplets": ({"triplets": [{"subject": "a", "relation": "b", "object": "c"}]}, 4),
    "extractive_qa": ({"items": [{"question": "q", "supporting_quote": "currents  CARRY that heat"}, {"question": "q", "supporting_quote": FAKE}]}, 1),
    "entity_extraction": ({"entities": [{"name": "sea", "type": "location", "context": "c"}]}, 2),
    "definition_extraction": ({"definitions": [{"term": "t", "definition": "d", "supporting_quote": "store heat"}, {"term": "t", "definition": "d", "supporting_quote": FAKE}]}, 2),
    "method_steps": ({"process_name": "p", "steps": [{"step": "one"}, {"step": "two"}]}, 5),
    "structured_records": ({"records": [{"subject": "a", "attribute": "b", "value": "c"}]}, 5),
    "query_generation": ({"queries": ["heat"]}, 2),
    "claim_verification": ({"items": [{"claim": "c", "label": "supported", "evidence": "e"}]}, 4),
    "claim_evidence_plan": ({"claim": "c", "supporting_quote": "store heat", "unrelated_quote": "Does ice"}, 3),
    "evidence_selection": ({"items": [
        {"claim": "c", "candidate_quotes": ["store heat", "Does ice"], "supporting_quote": "store heat", "rationale": "r"},
        {"claim": "c", "candidate_quotes": ["store heat", "Does ice"], "supporting_quote": "the poles", "rationale": "r"}]}, 4),
    "sentence_equivalence_plan": ({"source_sentence": "Does ice answer slowly?", "equivalent_sentences": ["Is ice slow?"]}, 4),
    "sentence_contrast_plan": ({"source_sentence": "Does ice answer slowly?", "replacements": [{"original": "SLOWLY", "replacement": "fast", "contradiction_type": "negation"}]}, 5),
    "distractor_qa": ({"questions": [
        {"question": "q", "correct_answer": "a", "distractors": ["b", "c"], "explanation": "e", "keyword_replacements": [{"keyword": "heat", "replacement": "cold"}]},
        {"question": "q", "correct_answer": "a", "distractors": ["a", "c"], "explanation": "e", "keyword_replacements": [{"keyword": "heat", "replacement": "cold"}]}]}, 7),
}


def run(spark, name, answer, passage=P, **more):
    docs = spark.createDataFrame([(1, passage)], "doc_id long, text string")
    table = spark.createDataFrame([(name, 1, answer if isinstance(answer, str) else json.dumps(answer))], "task string, call_id long, raw string")
    task = K.get_task(name)
    return A.run_task(docs, task.with_knobs(**more) if more else task, TableRuntime(table)).orderBy("format", "variation", "row_no").collect()


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_rows_of_an_answer(spark, name):
    answer, n = ANSWERS[name]
    if name == "bullets":  # its variation asks the table again
        n = 8
    assert len(run(spark, name, answer)) == n


def test_every_task_has_a_case():
    assert set(K.TASKS) - {"continuation", "cloze"} == set(ANSWERS)
    assert len(K.TASKS) == 26 and set(K.list_multi_tasks()) == {"retrieval", "comparison"}


def test_what_rows_hold(spark):
    assert [r.output for r in run(spark, "bullets", ANSWERS["bullets"][0], variations=0)] == ["- a\n- it's"] * 2 + ["['a', \"it's\"]"] * 2
    out = [r.output for r in run(spark, "method_steps", ANSWERS["method_steps"][0])]
    assert out == ["1. one\n2. two", "p", "one", "two", "two"]
    assert {r.output for r in run(spark, "evidence_selection", ANSWERS["evidence_selection"][0])} == {"store heat", "r", "yes", "no"}
    contrast = run(spark, "sentence_contrast_plan", ANSWERS["sentence_contrast_plan"][0])
    assert [r.output for r in contrast] == ["0.25", "not_equivalent", "contradiction", "Does ice answer slowly?", "SLOWLY -> fast"]
    assert run(spark, "entity_extraction", ANSWERS["entity_extraction"][0])[0].output == '[{"name": "sea", "type": "location", "context": "c"}]'


@pytest.mark.parametrize("name, answer", [
    ("title", {"title": "x" * 121, "headline": "h"}), ("title", '{"title": '), ("title", ""), ("title", {"title": "t"}),
    ("classification", {"topic": "t", "tone": "odd", "audience": "students"}), ("bullets", {"bullets": []}), ("triplets", {"triplets": [{"subject": "a", "relation": "b", "object": "c"}] * 3}),
    ("sentence_equivalence_plan", {"source_sentence": FAKE, "equivalent_sentences": ["x"]}),
])
def test_answers_that_make_no_rows(spark, name, answer):
    assert run(spark, name, answer) == []


def test_bounds_grow_with_the_passage(spark):
    long = {"tldr": "t", "summary": "s" * 1200}
    assert run(spark, "summarize", long) == []
    assert len(run(spark, "summarize", long, P * 20)) == 2


def test_native_tasks(spark):
    docs = spark.createDataFrame([(1, P), (2, "too few words here"), (3, "word " * 12)], "doc_id long, text string")
    made = {(r.doc_id, r.row_no): r for r in A.run_task(docs, "cloze").collect()}
    assert set(made) == {(1, 0), (1, 1)}
    text = made[1, 0].input
    for line in made[1, 0].output.split("\n"):
        mark, word = line.split(": ")
        text = text.replace(mark, word)
    assert text == P
    assert made[1, 1].input.replace("[MISSING SENTENCE]", made[1, 1].output) == P
    cont = [r for r in A.run_task(docs, "continuation").collect() if r.doc_id == 1]
    assert len(cont) == 3 and f"{cont[0].input} {cont[0].output}" == P


def test_templates(spark):
    for t in K.SINGLE:
        for first, pool in t.templates().items():
            assert pool[0] == first and len(pool) == t.pool and all(first in x for x in pool)
    docs = spark.createDataFrame([(k, P) for k in range(40)], "doc_id long, text string")
    seen = {r.instruction for r in A.run_task(docs, "cloze", templates=True).where("row_no = 0").collect()}
    assert len(seen) > 2 and all("[BLANK n]: word" in s for s in seen)


def test_modes(spark):
    docs = spark.createDataFrame([(1, P), (2, "@@ ##"), (3, "x" * 3001), (4, None)], "doc_id long, text string")
    assert [A.infer_mode(x) for x in (None, {"title": 1.0}, "title")] == ["auto", "sample", "explicit"]
    assert {r.doc_id for r in A.augment(docs, {"title": 1.0, "cloze": 0.0}).collect()} == {1}
    assert {r.doc_id for r in A.augment(docs, ["title"], templates=False).collect()} <= {1, 2}
    with pytest.raises(ValueError, match="between 0 and 1"):
        A.augment(docs, {"title": 1.5})
    with pytest.raises(ValueError, match="Unknown task"):
        A.augment(docs, ["nope"])
    errors = {r.doc_id: r.error for r in chunk.validated(docs).collect()}
    assert errors[1] is None and "3,001" in errors[3] and "empty" in errors[4]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "  " + "ab " * 10), (2, "   "), (3, None)], "doc_id long, text string")
    text = ("ab " * 10).strip()
    got = chunk.chunk_text(docs, size=7, overlap=2).orderBy("chunk_no").collect()
    assert [r.text for r in got] == [text[k : k + 7] for k in range(0, len(text), 5)]
    for size, overlap in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            chunk.chunks(F.col("text"), size, overlap)


def test_text_functions(spark):
    df = spark.createDataFrame([(["it's", 'say "x"', "both ' and \"", "back\\slash\n"],)], "a array<string>")
    lit, js = df.select(X.list_literal(F.col("a")), X.json_list(F.col("a"))).first()
    values = df.first().a
    assert lit == str(values) and js == json.dumps(values, ensure_ascii=False)
    got = spark.range(1).select(
        X.replace_first(F.lit("A Cat cat"), F.lit("cat"), F.lit("dog")), X.replace_first(F.lit("a"), F.lit(""), F.lit("b")),
        X.quote_in(F.lit(" a  B "), F.lit("xx A\nb yy")), X.strip(F.lit("  x \n")),
    ).first()
    assert tuple(got) == ("A dog cat", None, True, "x")


def test_groups(spark):
    g = spark.createDataFrame([(1, ["albatross glides", "barracuda hunting"])], "group_id long, passages array<string>")
    assert groups.retrieval(g).count() == 16
    assert groups.retrieval(g, negatives=False, most_questions=1).count() == 4
    assert groups.retrieval(g, most_passages=1).count() == 4
    assert groups.comparison_rows(g).count() == 3
    with pytest.raises(ValueError):
        groups.retrieval(g, most_passages=0)
    both = spark.createDataFrame([(1, [" a ", " ", "b"]), (2, ["a", ""])], "i long, p array<string>").select(groups.cleaned(F.col("p"))).collect()
    assert [r[0] for r in both] == [["a", "b"], None]


def test_judging(spark):
    d = spark.createDataFrame([(1, True, 0, False), (1, False, 1, False), (2, True, 0, True), (3, True, 2, None)], "row_index long, is_quality boolean, seq int, judge_error boolean")
    assert {(r.row_index, r.is_quality) for r in judge.compacted(d).collect()} == {(1, False), (3, True)}
    source = spark.range(1, 6).withColumnRenamed("id", "row_index")
    assert {r.row_index for r in judge.unfinished(source, d).collect()} == {2, 4, 5}
    assert judge.unfinished(source, d, most=1).count() == 1
    with pytest.raises(ValueError):
        judge.judge_prompt(F.lit("x"), " ")


def test_custom_task(spark):
    draft = lambda x: K.struct(tldr=K.left(x["t"], 6))
    docs = spark.createDataFrame([(1, P)], "doc_id long, text string")
    t = K.task(prompt="p", schema="tldr string", instruction="Shorten.", instruction_variants=["Shorten.", "Cut."], draft=draft)
    assert A.run_task(docs, t).first().output == "Oceans" and t.templates() == {"Shorten.": ["Shorten.", "Cut."]}
    with pytest.raises(ValueError):
        K.task(prompt="p", schema="a string", rows=lambda p, o: p, output="x")
    with pytest.raises(ValueError):
        K.task(prompt="p", schema="a string, b string", instruction="i")
