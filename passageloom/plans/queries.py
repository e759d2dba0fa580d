"""Queries over the driver's tables, one per operator, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import augment as A
from ..operators import chunk
from . import tasks as K

DOC_ROW = ["doc_id", "format", "variation", "row_no", "instruction", "input", "output"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in chunks; doc_id is document:chunk. No other filter: the
    checks of a task decide what it takes."""
    pieces = chunk.usable(chunk.chunk_text(documents(spark, sf_dir)), most=None)
    return pieces.select(X.cat(F.col("doc_id").cast("string"), ":", F.col("chunk_no").cast("string")).alias("doc_id"), "text")


def of_task(task: str | K.Task):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.run_task(passages(spark, sf_dir), task).select(DOC_ROW)

    return query


# -- SQL building blocks ---------------------------------------------------------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({strip(x)}, '\s+'), lambda v: v <> '')"


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')"


def maskable(x: str) -> str:
    edge = r"[.,;:!?()\"'']"
    bare = rf"list_transform({words(x)}, lambda v: regexp_replace(v, '^{edge}+|{edge}+$', '', 'g'))"
    fit = rf"list_distinct(list_filter({bare}, lambda v: length(v) >= 6 AND regexp_full_match(v, '\p{{L}}+')))"
    return f"list_transform(list_sort(list_transform({fit}, lambda v: {{'n': -length(v), 'l': lower(v), 'w': v}})), lambda v: v.w)"


def collapse(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '\s+', ' ', 'g')"


def quote_in(quote: str, passage: str) -> str:
    return f"contains(lower({collapse(passage)}), lower({collapse(quote)}))"


def replaced(text: str, old: str, new: str) -> str:
    at = f"strpos(lower({text}), lower({old}))"
    return f"CASE WHEN {at} > 0 AND {old} <> {new} THEN substr({text}, 1, {at} - 1) || {new} || substr({text}, {at} + length({old})) END"


def joined(items: str, by: str = "' '") -> str:
    return f"array_to_string({items}, {by})"


def numbered(items: str) -> str:
    return joined(f"list_transform({items}, lambda v, i: i || '. ' || v)", "chr(10)")


def js(x: str) -> str:
    return f"to_json(({x})::VARCHAR)::VARCHAR"


def json_list(items: str) -> str:
    return f"'[' || {joined(f'list_transform({items}, lambda v: {js("v")})', q(', '))} || ']'"


def json_object(**fields: str) -> str:
    return "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || {js(v)}" for k, v in fields.items()) + " || '}'"


def text(*parts: str) -> str:
    """Concatenation; parts that begin with = are expressions."""
    return " || ".join(p[1:] if p[:1] == "=" else q(p).replace("\n", "' || chr(10) || '") for p in parts)


def row(instruction: str, input: str, output: str) -> str:
    return f"{{'instruction': {instruction}, 'input': {input}, 'output': {output}}}"


def md5_bucket(key: str, n: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


CHUNKS = f"""
c0 AS (SELECT doc_id, {strip("text")} AS t FROM documents),
c1 AS (SELECT doc_id, t, unnest(range(0, length(t), %d)) AS start FROM c0),
c2 AS (SELECT doc_id, start, substr(t, start + 1, 2000) AS text FROM c1),
c3 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_no, text FROM c2 WHERE {strip("text")} <> '')
"""
BASE = f"""
WITH {CHUNKS % 2000},
d AS (SELECT doc_id || ':' || chunk_no AS doc_id, {strip("text")} AS t FROM c3),
e AS MATERIALIZED (SELECT doc_id, t, {words("t")} AS w, {sentences("t")} AS s, {maskable("t")} AS c FROM d)
"""


def rows_sql(forms: dict[str, str], variations: int = 0, where: str = "true") -> str:
    """SQL of a task: for each format the expression of its list of rows; where
    says which passages its rule has a valid answer for."""
    parts = []
    for form, rows in forms.items():
        for v in range(variations + 1):
            parts.append(f"SELECT doc_id, {q(form)} AS format, {v} AS variation, ({rows}) AS rows FROM e WHERE {where}")
    union = " UNION ALL ".join(parts)
    return f"""{BASE}, a AS ({union}),
u AS (SELECT doc_id, format, variation, unnest(rows) AS r, (generate_subscripts(rows, 1) - 1)::INTEGER AS row_no FROM a)
SELECT doc_id, format, variation, row_no, r.instruction AS instruction, r.input AS input, r.output AS output FROM u"""


def one(*rows: str, where: str = "true") -> str:
    return rows_sql({"plain": f"[{', '.join(rows)}]"}, where=where)


def least(sentences: int = 0, terms: int = 0) -> str:
    return f"len(s) >= {sentences} AND len(c) >= {terms}"


def each(items: str, *rows: str) -> str:
    """A list of rows for each item v."""
    return f"flatten(list_transform({items}, lambda v: [{', '.join(rows)}]))"


def left(x: str, n: int | str) -> str:
    return f"substr({x}, 1, {n})"


def choice(task: str, k: int, names: tuple[str, ...]) -> str:
    return f"[{', '.join(map(q, names))}][{md5_bucket(f"doc_id || '|{task}|{k}'", str(len(names)))} + 1]"


def passage(*parts: str) -> str:
    return text("Passage:\n", "=t", "\n\n", *parts)


S = [f"s[{k}]" for k in range(1, 5)]
C = [f"c[{k}]" for k in range(1, 4)]
FAB = q(K.FABRICATED)


def qa_forms() -> dict[str, str]:
    pairs = "list_transform(s[1:3], lambda v, i: {'question': 'What is stated in sentence ' || i || '?', 'answer': v})"
    questions = f"list_transform({pairs}, lambda v: v.question)"
    single = text("**Question:** ", "=v.question", "\n\n**Answer:** ", "=v.answer")
    sections = joined(f"list_transform({pairs}, lambda v, i: {text('### Q', '=i', chr(10))} || {single})", "chr(10) || chr(10)")
    objects = f"'[' || {joined(f'list_transform({pairs}, lambda v: {json_object(question="v.question", answer="v.answer")})', q(', '))} || ']'"
    compact = f"'{{\"question\":' || {js('v.question')} || ',\"answer\":' || {js('v.answer')} || '}}'"
    answer = [
        row(q(K.QA_ANSWER), text("Passage: ", "=t", "\n\nQuestion: ", "=v.question", "\nWhat is the answer?"), "v.answer"),
        row(text("Answer the question from the passage given here. Passage: ", "=t"), "v.question", "v.answer"),
    ]
    forms = {}
    for form, everything, listed, names, shown in (
        ("markdown", sections, numbered(questions), (K.QA_ALL_MD, K.QA_QUESTIONS_MD, K.QA_PAIR_MD), single),
        ("json", objects, json_list(questions), (K.QA_ALL_JSON, K.QA_QUESTIONS_JSON, K.QA_PAIR_JSON), compact),
    ):
        first = [row(q(names[0]), "t", everything), row(q(names[1]), "t", listed), row(q(K.QA_ONE), "t", "'What is stated in sentence 1?'")]
        forms[form] = f"[{', '.join(first)}] || {each(pairs, row(q(names[2]), 't', shown), *answer)}"
    return forms


def python_list(items: str) -> str:
    raw = r"replace(replace(replace(replace(v, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"
    shown = f"CASE WHEN contains(v, '''') AND NOT contains(v, '\"') THEN '\"' || {raw} || '\"' ELSE '''' || replace({raw}, '''', '\\''') || '''' END"
    return f"'[' || {joined(f'list_transform({items}, lambda v: {shown})', q(', '))} || ']'"


def continuation_sql(source: str) -> str:
    n = "len(w)"
    ten, fifth = f"greatest(1, {n} // 10)", f"greatest(1, {n} // 5)"
    part = lambda a, b: joined(f"w[{a}:{b}]")
    rows = [
        row(q(K.CONTINUE), part("1", ten), part(f"{ten} + 1", n)),
        row(q(K.CONTINUE_20), part("1", fifth), part(f"{fifth} + 1", n)),
        row(q(K.MIDDLE), text("Beginning:\n", "=" + part("1", ten), "\n\nEnding:\n", "=" + part(f"{n} - {ten} + 1", n)), part(f"{ten} + 1", f"{n} - {ten}")),
    ]
    return f"list_filter([{', '.join(rows)}], lambda r: r.input <> '' AND r.output <> '')"


def cloze_rows() -> str:
    masked = "t"
    for k, w in enumerate(C, 1):
        hit = rf"regexp_replace({masked}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])' || {w} || '($|[^\p{{L}}\p{{N}}\p{{M}}_])', '\1[BLANK {k}]\2')"
        masked = f"CASE WHEN len(c) >= {k} THEN {hit} ELSE {masked} END"
    answers = joined("list_transform(c[1:3], lambda v, i: '[BLANK ' || i || ']: ' || v)", "chr(10)")
    middle = joined("list_transform(s, lambda v, i: CASE WHEN i = len(s) // 2 + 1 THEN '[MISSING SENTENCE]' ELSE v END)")
    word = f"CASE WHEN len(c) > 0 THEN [{row(q(K.FILL_WORDS), masked, answers)}] ELSE [] END"
    return f"{word} || CASE WHEN len(s) >= 3 THEN [{row(q(K.FILL_SENTENCE), middle, 's[len(s) // 2 + 1]')}] ELSE [] END"


def method_sql() -> str:
    steps = "list_transform(s[1:4], lambda v: substr(v, 1, 250))"
    name = left(C[0], 120)
    process = text("Process: ", "=" + name, "\n\n")
    masked = numbered(f"list_transform({steps}, lambda m, j: CASE WHEN j = i THEN '[MISSING STEP]' ELSE m END)")
    done = numbered(f"({steps})[1:i - 1]")
    missing = row(q(K.MISSING_STEP), f"{process} || {text('Steps:' + chr(10))} || {masked}", "v")
    following = row(q(K.NEXT_STEP), f"{process} || {text('Completed steps:' + chr(10))} || {done}", "v")
    more = f"flatten(list_transform({steps}, lambda v, i: CASE WHEN i > 1 THEN [{following}, {missing}] ELSE [{missing}] END))"
    return rows_sql({"plain": f"[{row(q(K.STEPS), 't', numbered(steps))}, {row(q(K.PROCESS), 't', name)}] || {more}"}, where=least(2, 1))


def records_sql() -> str:
    records = "[" + ", ".join(f"{{'a': {left(C[k], 160)}, 'b': 'sentence', 'd': {left(S[k], 240)}}}" for k in range(2)) + "]"
    objects = f"'[' || {joined(f'list_transform({records}, lambda v: {json_object(subject="v.a", attribute="v.b", value="v.d")})', q(', '))} || ']'"
    lines = joined(f"list_transform({records}, lambda v: v.a || ' - ' || v.b || ': ' || v.d)", "chr(10)")
    more = each(
        records,
        row(q(K.VALUE_OF), passage("Subject: ", "=v.a", "\nAttribute: ", "=v.b"), "v.d"),
        row(q(K.ATTRIBUTE_OF), passage("Subject: ", "=v.a", "\nValue: ", "=v.d"), "v.b"),
        row(q(K.SUBJECT_OF), passage("Attribute: ", "=v.b", "\nValue: ", "=v.d"), "v.a"),
    )
    return rows_sql({"plain": f"[{row(q(K.RECORDS_JSON), 't', objects)}, {row(q(K.RECORDS_TEXT), 't', lines)}] || {more}"}, where=least(2, 2))


def evidence_sql() -> str:
    a = left(S[0], 500)
    quotes = f"[{a}, {left(S[1], 500)}, {FAB}]"
    given = passage("Claim: ", "=" + left(S[0], 300), "\n\nCandidate quotes:\n", "=" + numbered(quotes))
    yes = f"list_transform(list_filter({quotes}, lambda v: {quote_in('v', 't')}), lambda v: {row(q(K.SUPPORTS), passage('Claim: ', '=' + left(S[0], 300), chr(10) * 2 + 'Quote: ', '=v'), f'CASE WHEN v = {a} THEN {q("yes")} ELSE {q("no")} END')})"
    first = f"[{row(q(K.SELECT), given, a)}, {row(q(K.RATIONALE), given, q('It says the same.'))}] || {yes}"
    c, b = f"[{a}, {FAB}]", left(S[2], 500)
    given = passage("Claim: ", "=" + left(S[1], 300), "\n\nCandidate quotes:\n", "=" + numbered(c))
    yes = f"list_transform(list_filter({c}, lambda v: {quote_in('v', 't')}), lambda v: {row(q(K.SUPPORTS), passage('Claim: ', '=' + left(S[1], 300), chr(10) * 2 + 'Quote: ', '=v'), f'CASE WHEN v = {b} THEN {q("yes")} ELSE {q("no")} END')})"
    second = f"CASE WHEN list_contains({c}, {b}) THEN [{row(q(K.SELECT), given, b)}, {row(q(K.RATIONALE), given, q('It is not a candidate.'))}] || {yes} ELSE [] END"
    return rows_sql({"plain": f"({first}) || ({second})"}, where=least(3))


def equivalence_sql() -> str:
    a, e = left(S[0], 500), "v"
    both = f"list_filter([{text('In other words: ', '=s[1]')}, {a}], lambda v: {strip('v')} <> {strip(a)})"
    ab = text("Sentence A: ", "=" + a, "\n\nSentence B: ", "=v")
    premise = lambda x, y: text("Premise: ", "=" + x, "\n\nHypothesis: ", "=" + y)
    return rows_sql({"plain": each(both, row(q(K.SIMILAR), ab, "'1.0'"), row(q(K.EQUIVALENT), ab, "'equivalent'"), row(q(K.NLI), premise(a, e), "'entailment'"), row(q(K.NLI), premise(e, a), "'entailment'"))})


def contrast_sql() -> str:
    a, old = left(S[0], 500), left(f"({words(S[0])})[1]", 120)
    b = replaced(a, old, "'never'")
    both = text("Reference sentence: ", "=" + a, "\n\nCandidate sentence: ", "=v")
    ab = text("Sentence A: ", "=" + a, "\n\nSentence B: ", "=v")
    nli = text("Premise: ", "=" + a, "\n\nHypothesis: ", "=v")
    items = f"list_filter([{b}], lambda v: v IS NOT NULL AND v <> {a})"
    return rows_sql({"plain": each(items, row(q(K.SIMILAR), ab, "'0.25'"), row(q(K.EQUIVALENT), ab, "'not_equivalent'"), row(q(K.NLI), nli, "'contradiction'"), row(q(K.CORRECT_SENTENCE), both, a), row(q(K.NAME_CHANGE), both, f"{old} || ' -> never'"))})


def claim_evidence_sql() -> str:
    claim, good, other = left(S[0], 300), left(S[0], 500), left("s[len(s)]", 500)
    ev = lambda x: text("Claim: ", "=" + claim, "\n\nEvidence: ", "=" + x)
    cands = text("Claim: ", "=" + claim, "\n\nCandidate quotes:\n", "=" + numbered(f"[{good}, {other}]"))
    rows = f"[{row(q(K.VERIFY), ev(good), q('supported'))}, {row(q(K.VERIFY), ev(other), q('not enough information'))}, {row(q(K.CHOOSE), cands, good)}]"
    return rows_sql({"plain": f"CASE WHEN {good} <> {other} THEN {rows} ELSE [] END"})


def distractor_sql() -> str:
    a = left(C[0], 200)
    given = passage("Question: ", "Which word stands in the passage?", "\n\nChoices: ", "=" + json_list(f"[{a}, 'none', 'other']"))
    bad = replaced("t", left(C[0], 80), "'nothing'")
    both = text("Reference passage:\n", "=t", "\n\nCandidate passage:\n", "=" + bad)
    rows = [
        row(q(K.CHOICE), given, text("Answer: ", "=" + a, "\nExplanation: It stands there.")),
        row(q(K.CHOICE_ONLY), given, a),
        row(q(K.CHOICE_WHY), text("=" + given, "\n\nSelected answer: ", "=" + a), "'It stands there.'"),
        row(q(K.CHOICE_WRONG), given, "'[\"none\", \"other\"]'"),
        row(q(K.VALID), both, "'invalid'"),
        row(q(K.CORRECT_PASSAGE), both, "t"),
        row(q(K.NAME_WORD), both, f"{left(C[0], 80)} || ' -> nothing'"),
    ]
    return one(*rows, where=least(0, 2))


def triplets_forms() -> dict[str, str]:
    t = f"list_transform(list_filter(s, lambda v: len({words('v')}) >= 3)[1:2], lambda v: {{'a': substr(({words('v')})[1], 1, 120), 'b': substr(({words('v')})[2], 1, 120), 'd': substr({joined(f'({words("v")})[3:]')}, 1, 160)}})"
    md = joined(f"list_transform({t}, lambda v: '- (' || v.a || ', ' || v.b || ', ' || v.d || ')')", "chr(10)")
    objects = f"'[' || {joined(f'list_transform({t}, lambda v: {json_object(subject="v.a", relation="v.b", object="v.d")})', q(', '))} || ']'"
    two = lambda names, x: f"CASE WHEN len({t}) > 0 THEN [{', '.join(row(q(n), 't', x) for n in names)}] ELSE [] END"
    return {"markdown": two(K.TRIPLES_MD, md), "json": two(K.TRIPLES_JSON, objects)}


def entity_sql() -> str:
    make = lambda k: f"{{'name': {left(C[k], 120)}, 'type': {choice('entity_extraction', k, K.ENTITY_TYPES)}, 'context': {left(S[0], 300)}}}"
    items = f"CASE WHEN len(c) >= 3 THEN [{make(0)}, {make(1)}, {make(2)}] ELSE [{make(0)}, {make(1)}] END"
    objects = f"'[' || {joined(f'list_transform({items}, lambda v: {json_object(name="v.name", type="v.type", context="v.context")})', q(', '))} || ']'"
    return rows_sql({"plain": f"[{row(q(K.ENTITIES), 't', objects)}] || {each(items, row(q(K.ENTITY_TYPE), passage('Entity: ', '=v.name'), 'v.type'))}"}, where=least(0, 2))


def extractive_sql() -> str:
    quotes = f"list_transform(s[1:4], lambda v: substr(v, 1, 500)) || [{FAB}]"
    items = f"list_filter(list_transform({quotes}, lambda v, i: {{'question': 'Which words make statement ' || i || '?', 'quote': v}}), lambda v: {quote_in('v.quote', 't')})"
    return rows_sql({"plain": each(items, row(q(K.EXTRACT), passage("Question: ", "=v.question"), "v.quote"))})


def claims_sql() -> str:
    items = "[" + ", ".join(f"{{'claim': {left(S[k], 300)}, 'label': {q(K.CLAIM_LABELS[k])}, 'evidence': {left(S[k], 600)}}}" for k in range(3)) + "]"
    given = passage("Claim: ", "=v.claim")
    return rows_sql({"plain": each(items, row(q(K.LABEL_EVIDENCE), given, text("Label: ", "=v.label", "\nEvidence: ", "=v.evidence")), row(q(K.LABEL_ONLY), given, "v.label"),
                                   row(q(K.EVIDENCE_ONLY), text("=" + given, "\n\nLabel: ", "=v.label"), "v.evidence"), row(q(K.LABEL_JSON), given, json_object(label="v.label", evidence="v.evidence")))}, where=least(3))


BAD = replaced("t", C[0], f"reverse({C[0]})")
HEAD = left(f"{C[0]} || ' ' || {C[1]}", 100)
QUERIES_OF = f"list_filter([{C[0]}, {C[1]}, {C[0]} || ' ' || {C[1]}], lambda x: x IS NOT NULL)"
STYLE = K.get_task("style_transfer").instructions[0]

TASK_SQL = {
    "bullets": rows_sql({
        "markdown": "[" + ", ".join(row(q(i), "t", joined("list_transform(s[1:6], lambda v: '- ' || v)", "chr(10)")) for i in K.BULLETS_MD) + "]",
        "python_list": "[" + ", ".join(row(q(i), "t", python_list("s[1:6]")) for i in K.BULLETS_PY) + "]",
    }, variations=1),
    "qa_pairs": rows_sql(qa_forms()),
    "rephrase": one(row(q(K.REPHRASE), "t", left(collapse("t"), "greatest(1000, len(w) * 40)"))),
    "continuation": rows_sql({"plain": continuation_sql("e")}, where="len(w) >= 10"),
    "triplets": rows_sql(triplets_forms()),
    "summarize": one(row(q(K.TLDR), "t", left(S[0], 200)), row(q(K.SUMMARY), "t", left(joined("s[1:3]"), "greatest(1000, len(w) * 4)"))),
    "title": one(row(q(K.TITLE), "t", left(joined("w[1:8]"), 120)), row(q(K.HEADLINE), "t", left(S[0], 200))),
    "cloze": rows_sql({"plain": cloze_rows()}, where="len(w) >= 10"),
    "extractive_qa": extractive_sql(),
    "classification": one(row(q(K.TOPIC), "t", left(C[0], 80)), row(q(K.TONE), "t", choice("classification", 0, K.TONES)), row(q(K.AUDIENCE), "t", choice("classification", 1, K.AUDIENCES)), where=least(0, 1)),
    "style_transfer": one(row(q(STYLE), "t", left("lower(t)", "greatest(2000, len(w) * 24)"))),
    "backtranslation": one(row(text("Write a passage about ", "=" + left(C[0], 300), "."), "''", "t"), where=least(0, 1)),
    "counterfactual": one(row(text("Counterfactual premise: Suppose this were not so: ", "=" + left(S[0], 200), "\n\nWhat would follow?"), "t", left(S[1], 1000)), where=least(2)),
    "claim_evidence_plan": claim_evidence_sql(),
    "evidence_selection": evidence_sql(),
    "claim_verification": claims_sql(),
    "entity_extraction": entity_sql(),
    "definition_extraction": one(row(q(K.DEFINE), passage("Term: ", "=" + left(C[0], 120)), left(S[0], 500)), row(q(K.DEFINE_QUOTE), passage("Term: ", "=" + left(C[0], 120)), left(S[0], 500)), where=least(2, 2)),
    "method_steps": method_sql(),
    "structured_records": records_sql(),
    "section_heading": one(row(q(K.HEADING), "t", HEAD), row(q(K.HEADING_WHY), passage("Heading: ", "=" + HEAD), "'It names the main words.'"), where=least(0, 2)),
    "sentence_equivalence_plan": equivalence_sql(),
    "sentence_contrast_plan": contrast_sql(),
    "query_generation": rows_sql({"plain": f"[{row(q(K.QUERIES), 't', joined(QUERIES_OF, 'chr(10)'))}] || {each(QUERIES_OF, row(q(K.QUERY_PASSAGE), 'v', 't'))}"}, where=least(0, 1)),
    "distractor_qa": distractor_sql(),
    "error_correction": one(row(q(K.FIX), BAD, "t"), row(q(K.FIX_NOTES), BAD, "'A word is spelled backwards.'"), where=f"({BAD}) IS NOT NULL"),
}

QUERIES = {name: of_task(name) for name in K.TASKS}
ORACLE_SQL = dict(TASK_SQL)
