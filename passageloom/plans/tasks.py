"""The catalogue of tasks.

A task says what a model is asked for (prompt, schema, bounds) and how one
structured answer becomes instruction, input and output rows. Rows are array
columns over the passage and the answer, so a task runs as one projection and an
inline, without Python per row. `draft` is a rule that makes an answer from the
passage itself; it stands in for a model where none can be reached.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    BLANKS,
    LEAST_WORDS,
    bucket,
    cat,
    collapse,
    dashed,
    flat,
    joined,
    json_list,
    json_object,
    json_objects,
    json_string,
    length_bound,
    list_literal,
    mask_words,
    numbered,
    part_of,
    replace_first,
    strip,
    template,
    words,
)
from .schema import Fields, Flag, Text, fields, from_ddl, many

#: Closed sets of the schemas.
TONES = ("formal", "informal", "technical", "persuasive", "narrative", "instructional")
AUDIENCES = ("general public", "domain experts", "students", "professionals", "children")
CLAIM_LABELS = ("supported", "contradicted", "not enough information")
ENTITY_TYPES = ("person", "organization", "location", "method", "task", "dataset", "metric", "event", "concept", "other")
CONTRADICTIONS = ("entity", "number", "date", "attribute", "negation", "relation")

#: Ways to word an instruction; the first is the instruction itself, and each
#: holds it whole, so that what it says of the format stays.
FRAMES = (
    "{}",
    "Your task: {}",
    "{} Rely on what is given only.",
    "Please do the following. {}",
    "{} Reply with the result alone.",
    "Read the input with care. {}",
    "{} Keep to the requested form.",
    "As a careful annotator: {}",
)

Passage = dict[str, Column]
Rows = Callable[[Column, Column], Column]


def row(instruction: Column | str, input: Column | str, output: Column | str) -> Column:
    parts = {"instruction": instruction, "input": input, "output": output}
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])


def each(items: Column, make: Callable[[Column], list[Column]]) -> Column:
    """Rows of every item, in order."""
    return F.flatten(F.transform(items, lambda x: F.array(*make(x))))


ROWS_TYPE = "array<struct<instruction: string, input: string, output: string>>"


def quoted(quote: Column) -> Column:
    """Whether the passage of the call holds a quote; flat_ is its text, once."""
    return F.contains(F.col("flat_"), flat(quote))


def only_if(condition: Column, rows: Column) -> Column:
    return F.when(condition, rows).otherwise(F.array().cast(ROWS_TYPE))


@dataclass(frozen=True)
class Task:
    name: str
    prompt: str
    shape: Fields | str
    formats: dict[str, Rows]
    draft: Callable[[Passage], Column] | None = None
    hint: str = ""
    native: bool = False  # needs no model
    temperature: float = 0.2
    max_tokens: int = 5000
    variation_temperature: float = 0.5
    generations: int = 1
    variations: int = 0
    passages: int = 1  # how many a call takes: one, or a group of at least two
    pool: int = 5  # wordings of an instruction
    instructions: tuple[str, ...] = ()  # those that have other wordings
    format_prompts: dict[str, str] = field(default_factory=dict)
    quotes: bool = False  # its rows look for quotes in the passage

    def with_knobs(self, **knobs: object) -> Task:
        return replace(self, **knobs)

    @property
    def tree(self) -> Fields:
        """What an answer may look like, with its bounds."""
        return from_ddl(self.shape) if isinstance(self.shape, str) else self.shape

    @property
    def schema(self) -> str:
        return self.tree.table

    def valid(self, out: Column, n_words: Column) -> Column:
        """Whether an answer is there, with all its fields, and within its bounds."""
        return self.tree.fits(out, n_words)

    def templates(self) -> dict[str, list[str]]:
        return {i: [f.format(i) if "{" not in i else f.replace("{}", i) for f in FRAMES[: self.pool]] for i in self.instructions}


def left(text: Column, n: int | Column) -> Column:
    return F.substring(text, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def struct(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def pick(x: Passage, task: str, k: int, choices: tuple[str, ...]) -> Column:
    at = bucket(cat(x["id"].cast("string"), f"|{task}|{k}"), len(choices)) + 1
    return F.element_at(F.array(*map(F.lit, choices)), at.cast("int"))


FABRICATED = "This sentence is not in the passage."


# -- tasks without a model -------------------------------------------------
CONTINUE = "Here is how a passage begins. Write all of the text that comes after it, without repeating it."
CONTINUE_20 = "Here is the first fifth of a passage. Write the rest, without repeating what is given."
MIDDLE = "Here are the beginning and the end of a passage. Write only the middle part that joins them."


def continuation_draft(x: Passage) -> Column:
    w, a, b, n = x["w"], part_of(x["w"], 10), part_of(x["w"], 5), F.size(x["w"])
    cut = lambda start, size: joined(F.slice(w, start, size))
    made = struct(
        prefix_10=cut(F.lit(1), a),
        rest_after_prefix_10=cut(a + 1, n),
        prefix_20=cut(F.lit(1), b),
        rest_after_prefix_20=cut(b + 1, n),
        prefix_10_suffix_10=cat("Beginning:\n", cut(F.lit(1), a), "\n\nEnding:\n", cut(n - a + 1, a)),
        middle_without_10_edges=cut(a + 1, n - 2 * a),
    )
    return F.when(n >= LEAST_WORDS, made)


def filled(rows: Column) -> Column:
    """Rows that have an input and an output."""
    return F.filter(rows, lambda r: (r["input"] != "") & (r["output"] != ""))


def continuation_rows(p: Column, o: Column) -> Column:
    return filled(
        F.array(
            row(CONTINUE, o["prefix_10"], o["rest_after_prefix_10"]),
            row(CONTINUE_20, o["prefix_20"], o["rest_after_prefix_20"]),
            row(MIDDLE, o["prefix_10_suffix_10"], o["middle_without_10_edges"]),
        )
    )


FILL_WORDS = "Fill in the blanks of this passage, marked [BLANK n]. Give the missing words in order, one a line, as '[BLANK n]: word'."
FILL_SENTENCE = "A sentence of this passage is replaced by [MISSING SENTENCE]. Write the sentence that belongs there."


def cloze_draft(x: Passage) -> Column:
    s, chosen = x["s"], F.slice(x["c"], 1, BLANKS)
    middle = F.floor(F.size(s) / 2).cast("int")
    enough = F.size(s) >= 3
    made = struct(
        word_masked_passage=F.when(F.size(chosen) > 0, mask_words(x["t"], chosen)).otherwise(""),
        word_answers=F.array_join(F.transform(chosen, lambda w, i: cat("[BLANK ", (i + 1).cast("string"), "]: ", w)), "\n"),
        sentence_masked_passage=F.when(enough, joined(F.transform(s, lambda v, i: F.when(i == middle, "[MISSING SENTENCE]").otherwise(v)))).otherwise(""),
        sentence_answer=F.when(enough, F.get(s, middle)).otherwise(""),
    )
    return F.when(F.size(x["w"]) >= LEAST_WORDS, made)


def cloze_rows(p: Column, o: Column) -> Column:
    return filled(F.array(row(FILL_WORDS, o["word_masked_passage"], o["word_answers"]), row(FILL_SENTENCE, o["sentence_masked_passage"], o["sentence_answer"])))


# -- lists -------------------------------------------------------------------
BULLETS_MD = ("List the important points of this passage as markdown bullet points.", "Sum up this passage as markdown bullet points.")
BULLETS_PY = ("List the important points of this passage as a Python list of strings.", "Give the key points of this passage as a Python list.")
QA_ALL_MD = "Write the important questions on this passage with their answers, in markdown."
QA_ALL_JSON = "Write the important questions on this passage with their answers, as a JSON list of objects with the keys question and answer."
QA_QUESTIONS_MD = "Write a set of questions on this passage in markdown."
QA_QUESTIONS_JSON = "Write a list of questions on this passage as a JSON array of strings."
QA_ONE = "Write one question on this passage."
QA_PAIR_MD = "Write one question on this passage and its answer in markdown."
QA_PAIR_JSON = "Write one question on this passage and its answer as a JSON object."
QA_ANSWER = "Answer the question from the passage."
TRIPLES_MD = ("List the knowledge-graph triplets of this passage in markdown.", "Give subject, relation and object triplets of this passage as markdown bullet points.")
TRIPLES_JSON = ("List the knowledge-graph triplets of this passage as JSON.", "Give a JSON array of subject, relation and object triplets that this passage supports.")


def two(instructions: tuple[str, str], p: Column, output: Column) -> Column:
    return F.array(*[row(i, p, output) for i in instructions])


def qa_rows(kind: str) -> Rows:
    md = kind == "markdown"

    def single(q: Column) -> Column:
        return cat("**Question:** ", q["question"], "\n\n**Answer:** ", q["answer"])

    def rows(p: Column, o: Column) -> Column:
        pairs = o["qa_pairs"]
        questions = F.transform(pairs, lambda q: q["question"])
        if md:
            heads = F.transform(pairs, lambda q, i: cat("### Q", (i + 1).cast("string"), "\n", single(q)))
            everything, listed = F.array_join(heads, "\n\n"), numbered(questions)
        else:
            everything, listed = json_objects(pairs, "question", "answer"), json_list(questions)
        first = [
            row(QA_ALL_MD if md else QA_ALL_JSON, p, everything),
            row(QA_QUESTIONS_MD if md else QA_QUESTIONS_JSON, p, listed),
            row(QA_ONE, p, pairs[0]["question"]),
        ]
        more = each(
            pairs,
            lambda q: [
                row(QA_PAIR_MD if md else QA_PAIR_JSON, p, single(q) if md else F.to_json(F.struct(q["question"].alias("question"), q["answer"].alias("answer")))),
                row(QA_ANSWER, cat("Passage: ", p, "\n\nQuestion: ", q["question"], "\nWhat is the answer?"), q["answer"]),
                row(cat("Answer the question from the passage given here. Passage: ", p), q["question"], q["answer"]),
            ],
        )
        return F.concat(F.array(*first), more)

    return rows


# -- rows of several tasks -----------------------------------------------------
EXTRACT = "Answer the question with an exact quote from the passage."
TITLE, HEADLINE = "Write a title for this passage.", "Write a news headline for this passage."
TLDR, SUMMARY = "Sum up this passage in one sentence.", "Write a short summary of this passage."
REPHRASE = "Rephrase this passage without changing what it says."
TOPIC, TONE, AUDIENCE = "Name the main topic of this passage.", "Name the tone of this passage.", "Name the audience this passage is written for."
SIMILAR = "Rate from 0.0 to 1.0 how alike the two sentences are in meaning."
EQUIVALENT = "Say whether the two sentences are equivalent or not_equivalent."
NLI = "Say whether the premise and the hypothesis stand in entailment, contradiction or neutral relation."
CORRECT_SENTENCE = "Correct the candidate sentence so that it agrees with the reference sentence."
NAME_CHANGE = "Name the change that made the candidate sentence differ, as 'original -> replacement'."
VERIFY = "Say whether the evidence makes the claim supported, contradicted or not enough information."
CHOOSE = "Choose the candidate quote that supports the claim."
SELECT = "Choose the quote from the passage that supports the claim."
RATIONALE = "Say why the right candidate quote supports the claim."
SUPPORTS = "Does the quote support the claim? Answer yes or no."
LABEL_EVIDENCE = "Label the claim by the passage and give the evidence."
LABEL_ONLY = "Label the claim by the passage; give the label only."
EVIDENCE_ONLY = "Give the evidence in the passage for the label of the claim."
LABEL_JSON = "Label the claim by the passage; answer as a JSON object with label and evidence."
ENTITIES, ENTITY_TYPE = "List the entities of this passage as JSON.", "Name the type of the entity in the passage."
DEFINE, DEFINE_QUOTE = "Define the term as the passage does.", "Quote the passage where it defines the term."
STEPS, PROCESS = "List the steps of the process in this passage in order.", "Name the process that this passage describes."
NEXT_STEP, MISSING_STEP = "Give the next step of the process.", "Give the step that [MISSING STEP] stands for."
RECORDS_JSON, RECORDS_TEXT = "List the facts of this passage as JSON records.", "List the facts of this passage as lines of text."
VALUE_OF, ATTRIBUTE_OF, SUBJECT_OF = (
    "Give the value of the attribute of the subject.",
    "Name the attribute of the subject that has the value.",
    "Name the subject whose attribute has the value.",
)
HEADING, HEADING_WHY = "Write a section heading for this passage.", "Say why the heading fits the passage."
QUERIES, QUERY_PASSAGE = "Write search queries, one a line, that this passage answers.", "Write a passage that answers the search query."
CHOICE, CHOICE_ONLY = "Answer the multiple-choice question and explain the answer.", "Answer the multiple-choice question with the choice only."
CHOICE_WHY, CHOICE_WRONG = "Explain why the selected answer is right.", "List the wrong choices of the question as a JSON array."
VALID = "Does the candidate passage agree with the reference passage? Answer valid or invalid."
CORRECT_PASSAGE, NAME_WORD = "Correct the candidate passage by the reference passage.", "Name the keyword that was replaced, as 'keyword -> replacement'."
FIX, FIX_NOTES = "Correct the errors in this passage.", "Say what is wrong in this passage."
COMPARE = "Compare the two passages: say what they share and where they differ."
FIND = "Say which passage answers the question, and why. Answer None if none does."
FIND_JSON = "Say which passage answers the question, and why, as a JSON object with passage and why; passage is null if none does."
STYLES = {
    "eli5": "simple words that a young child understands",
    "formal": "a formal, professional register",
    "casual": "a casual, conversational tone",
}


def pair(a: Column, b: Column) -> Column:
    return cat("Sentence A: ", a, "\n\nSentence B: ", b)


def nli(a: Column, b: Column) -> Column:
    return cat("Premise: ", a, "\n\nHypothesis: ", b)


def in_passage(p: Column, *parts: Column | str) -> Column:
    return cat("Passage:\n", p, "\n\n", *parts)


def equivalence_rows(p: Column, o: Column) -> Column:
    a = o["source_sentence"]
    other = F.filter(o["equivalent_sentences"], lambda e: (strip(e) != "") & (strip(e) != strip(a)))
    make = lambda e: [row(SIMILAR, pair(a, e), "1.0"), row(EQUIVALENT, pair(a, e), "equivalent"), row(NLI, nli(a, e), "entailment"), row(NLI, nli(e, a), "entailment")]
    return only_if(quoted(a), each(other, make))


def contrast_rows(p: Column, o: Column) -> Column:
    a = o["source_sentence"]
    made = F.transform(o["replacements"], lambda r: F.struct(r["original"].alias("old"), r["replacement"].alias("new"), replace_first(a, r["original"], r["replacement"]).alias("b")))
    made = F.filter(made, lambda m: m["b"].isNotNull() & (m["b"] != a))

    def make(m: Column) -> list[Column]:
        both = cat("Reference sentence: ", a, "\n\nCandidate sentence: ", m["b"])
        return [
            row(SIMILAR, pair(a, m["b"]), "0.25"),
            row(EQUIVALENT, pair(a, m["b"]), "not_equivalent"),
            row(NLI, nli(a, m["b"]), "contradiction"),
            row(CORRECT_SENTENCE, both, a),
            row(NAME_CHANGE, both, cat(m["old"], " -> ", m["new"])),
        ]

    return only_if(quoted(a), each(made, make))


def claim_evidence_rows(p: Column, o: Column) -> Column:
    c, good, other = o["claim"], o["supporting_quote"], o["unrelated_quote"]
    evidence = lambda q: cat("Claim: ", c, "\n\nEvidence: ", q)
    candidates = cat("Claim: ", c, "\n\nCandidate quotes:\n", numbered(F.array(good, other)))
    rows = F.array(row(VERIFY, evidence(good), "supported"), row(VERIFY, evidence(other), "not enough information"), row(CHOOSE, candidates, good))
    return only_if(quoted(good) & quoted(other) & (good != other), rows)


def evidence_selection_rows(p: Column, o: Column) -> Column:
    right = F.filter(o["items"], lambda x: F.array_contains(x["candidate_quotes"], x["supporting_quote"]) & quoted(x["supporting_quote"]))

    def rows(x: Column) -> Column:
        given = in_passage(p, "Claim: ", x["claim"], "\n\nCandidate quotes:\n", numbered(x["candidate_quotes"]))
        verified = F.filter(x["candidate_quotes"], lambda q: quoted(q))
        answer = lambda q: row(SUPPORTS, in_passage(p, "Claim: ", x["claim"], "\n\nQuote: ", q), F.when(q == x["supporting_quote"], "yes").otherwise("no"))
        return F.concat(F.array(row(SELECT, given, x["supporting_quote"]), row(RATIONALE, given, x["rationale"])), F.transform(verified, answer))

    return F.flatten(F.transform(right, rows))


def claim_verification_rows(p: Column, o: Column) -> Column:
    def make(x: Column) -> list[Column]:
        given = in_passage(p, "Claim: ", x["claim"])
        return [
            row(LABEL_EVIDENCE, given, cat("Label: ", x["label"], "\nEvidence: ", x["evidence"])),
            row(LABEL_ONLY, given, x["label"]),
            row(EVIDENCE_ONLY, cat(given, "\n\nLabel: ", x["label"]), x["evidence"]),
            row(LABEL_JSON, given, json_object(label=x["label"], evidence=x["evidence"])),
        ]

    return each(o["items"], make)


def entity_rows(p: Column, o: Column) -> Column:
    types = F.transform(o["entities"], lambda e: row(ENTITY_TYPE, in_passage(p, "Entity: ", e["name"]), e["type"]))
    return F.concat(F.array(row(ENTITIES, p, json_objects(o["entities"], "name", "type", "context"))), types)


def definition_rows(p: Column, o: Column) -> Column:
    right = F.filter(o["definitions"], lambda d: quoted(d["supporting_quote"]))
    term = lambda d: in_passage(p, "Term: ", d["term"])
    return each(right, lambda d: [row(DEFINE, term(d), d["definition"]), row(DEFINE_QUOTE, term(d), d["supporting_quote"])])


def method_rows(p: Column, o: Column) -> Column:
    steps = F.transform(o["steps"], lambda s: s["step"])
    process = cat("Process: ", o["process_name"], "\n\n")

    def of(step: Column, i: Column) -> Column:
        masked = F.transform(steps, lambda s, j: F.when(j == i, "[MISSING STEP]").otherwise(s))
        missing = row(MISSING_STEP, cat(process, "Steps:\n", numbered(masked)), step)
        following = row(NEXT_STEP, cat(process, "Completed steps:\n", numbered(F.slice(steps, F.lit(1), i))), step)
        return F.when(i > 0, F.array(following, missing)).otherwise(F.array(missing))

    return F.concat(F.array(row(STEPS, p, numbered(steps)), row(PROCESS, p, o["process_name"])), F.flatten(F.transform(steps, of)))


def record_rows(p: Column, o: Column) -> Column:
    records = o["records"]
    line = lambda r: cat(r["subject"], " - ", r["attribute"], ": ", r["value"])
    look = lambda a, x, b, y: in_passage(p, f"{a}: ", x, f"\n{b}: ", y)
    first = F.array(row(RECORDS_JSON, p, json_objects(records, "subject", "attribute", "value")), row(RECORDS_TEXT, p, F.array_join(F.transform(records, line), "\n")))
    more = each(
        records,
        lambda r: [
            row(VALUE_OF, look("Subject", r["subject"], "Attribute", r["attribute"]), r["value"]),
            row(ATTRIBUTE_OF, look("Subject", r["subject"], "Value", r["value"]), r["attribute"]),
            row(SUBJECT_OF, look("Attribute", r["attribute"], "Value", r["value"]), r["subject"]),
        ],
    )
    return F.concat(first, more)


def distractor_rows(p: Column, o: Column) -> Column:
    choices = lambda q: F.concat(F.array(q["correct_answer"]), q["distractors"])
    sound = F.filter(o["questions"], lambda q: F.size(F.array_distinct(choices(q))) == F.size(choices(q)))

    def rows(q: Column) -> Column:
        given = in_passage(p, "Question: ", q["question"], "\n\nChoices: ", json_list(choices(q)))
        first = F.array(
            row(CHOICE, given, cat("Answer: ", q["correct_answer"], "\nExplanation: ", q["explanation"])),
            row(CHOICE_ONLY, given, q["correct_answer"]),
            row(CHOICE_WHY, cat(given, "\n\nSelected answer: ", q["correct_answer"]), q["explanation"]),
            row(CHOICE_WRONG, given, json_list(q["distractors"])),
        )
        made = F.transform(q["keyword_replacements"], lambda r: F.struct(cat(r["keyword"], " -> ", r["replacement"]).alias("change"), replace_first(p, r["keyword"], r["replacement"]).alias("b")))
        made = F.filter(made, lambda m: m["b"].isNotNull())
        both = lambda m: cat("Reference passage:\n", p, "\n\nCandidate passage:\n", m["b"])
        more = each(made, lambda m: [row(VALID, both(m), "invalid"), row(CORRECT_PASSAGE, both(m), p), row(NAME_WORD, both(m), m["change"])])
        return F.concat(first, more)

    return F.flatten(F.transform(sound, rows))


def passage_list(passages: Column) -> Column:
    return F.array_join(F.transform(passages, lambda p, i: cat("Passage ", (i + 1).cast("string"), ":\n", p)), "\n\n")


def retrieval_rows(passages: Column, answer: Column, question: Column, why: Column) -> Column:
    """Two rows: the passage that answers (its place from 0, or null), and why."""
    given = cat(passage_list(passages), "\n\nQuestion: ", question)
    place = F.coalesce((answer + 1).cast("string"), F.lit("None"))
    as_json = cat('{"passage": ', F.coalesce((answer + 1).cast("string"), F.lit("null")), ', "why": ', json_string(why), "}")
    return F.array(row(FIND, given, cat("**Passage:** ", place, "\n\n**Why:** ", why)), row(FIND_JSON, given, as_json))


def style_task(style: str = "eli5", description: str | None = None) -> Task:
    if description is None:
        if style not in STYLES:
            raise ValueError(f"Unknown style {style!r}. Available: {', '.join(sorted(STYLES))}")
        description = STYLES[style]
    instruction = f"Rewrite this passage in {description}."
    return Task(
        "style_transfer",
        f"Rewrite the passage in {description}. Keep all that it says.",
        fields(rewritten=Text(grows=(24, 2000))),
        {"plain": lambda p, o: F.array(row(instruction, p, o["rewritten"]))},
        lambda x: struct(rewritten=left(F.lower(x["t"]), length_bound(F.size(x["w"]), 24, 2000))),
        "the passage can be told in another style.",
        temperature=0.5,
        pool=8,
        instructions=(instruction,),
    )


def simple(name: str, prompt: str, shape: Fields, rows: Rows, **more: object) -> Task:
    return Task(name, prompt, shape, {"plain": rows}, **more)


def s(x: Passage, k: int) -> Column:
    return F.get(x["s"], F.lit(k))


def c(x: Passage, k: int) -> Column:
    return F.get(x["c"], F.lit(k))


def entity(x: Passage, k: int) -> Column:
    return struct(name=left(c(x, k), 120), type=pick(x, "entity_extraction", k, ENTITY_TYPES), context=left(s(x, 0), 300))


SINGLE = [
    Task(
        "bullets", "List the important points of the passage, each short and grounded in it.", fields(bullets=many(1, 6, Text())),
        {"markdown": lambda p, o: two(BULLETS_MD, p, dashed(o["bullets"])), "python_list": lambda p, o: two(BULLETS_PY, p, list_literal(o["bullets"]))},
        lambda x: struct(bullets=F.slice(x["s"], 1, 6)), "the passage makes several separate points.",
        variations=1, pool=7, instructions=BULLETS_MD + BULLETS_PY, format_prompts={"markdown": "Points become markdown bullets.", "python_list": "Points become a Python list."},
    ),
    Task(
        "qa_pairs", "Write important questions on the passage with their answers.", fields(qa_pairs=many(1, 3, question=Text(grows=(40, 300), beyond=300), answer=Text(grows=(40, 500), beyond=300))),
        {"markdown": qa_rows("markdown"), "json": qa_rows("json")},
        lambda x: struct(qa_pairs=F.transform(F.slice(x["s"], 1, 3), lambda v, i: struct(question=cat("What is stated in sentence ", (i + 1).cast("string"), "?"), answer=v))),
        "the passage states facts that can be asked for.", pool=6,
        instructions=(QA_ALL_MD, QA_ALL_JSON, QA_QUESTIONS_MD, QA_QUESTIONS_JSON, QA_ONE, QA_PAIR_MD, QA_PAIR_JSON),
    ),
    simple("rephrase", "Rephrase the passage without changing what it says.", fields(rephrased=Text(grows=(40, 1000))), lambda p, o: F.array(row(REPHRASE, p, o["rephrased"])),
           draft=lambda x: struct(rephrased=left(collapse(x["t"]), length_bound(F.size(x["w"]), 40, 1000))),
           hint="the passage is prose that can be worded otherwise.", temperature=0.5, pool=8, instructions=(REPHRASE,)),
    simple("continuation", "Cut the passage into beginnings and the text that follows.",
           fields(prefix_10=Text(), rest_after_prefix_10=Text(), prefix_20=Text(), rest_after_prefix_20=Text(), prefix_10_suffix_10=Text(), middle_without_10_edges=Text()),
           continuation_rows, draft=continuation_draft, native=True, hint="the passage is some sentences long, so that its parts mean something.", pool=7, instructions=(CONTINUE, CONTINUE_20, MIDDLE)),
    Task(
        "triplets", "List subject, relation and object triplets that the passage supports.", fields(triplets=many(1, 2, subject=Text(120), relation=Text(120), object=Text(160))),
        {"markdown": lambda p, o: two(TRIPLES_MD, p, dashed(F.transform(o["triplets"], lambda t: cat("(", t["subject"], ", ", t["relation"], ", ", t["object"], ")")))),
         "json": lambda p, o: two(TRIPLES_JSON, p, json_objects(o["triplets"], "subject", "relation", "object"))},
        lambda x: struct(triplets=F.transform(F.slice(F.filter(x["s"], lambda v: F.size(words(v)) >= 3), 1, 2), lambda v: struct(
            subject=left(words(v)[0], 120), relation=left(words(v)[1], 120), object=left(joined(F.slice(words(v), F.lit(3), F.size(words(v)))), 160)))),
        "the passage relates named things.", pool=7, instructions=TRIPLES_MD + TRIPLES_JSON,
    ),
    simple("summarize", "Sum up the passage in one sentence and in a short paragraph.", fields(tldr=Text(200), summary=Text(grows=(4, 1000))),
           lambda p, o: F.array(row(TLDR, p, o["tldr"]), row(SUMMARY, p, o["summary"])),
           draft=lambda x: struct(tldr=left(s(x, 0), 200), summary=left(joined(F.slice(x["s"], 1, 3)), length_bound(F.size(x["w"]), 4, 1000))),
           hint="the passage is long enough to be shortened.", temperature=0.3, pool=7, instructions=(TLDR, SUMMARY)),
    simple("title", "Write a title and a headline for the passage.", fields(title=Text(120), headline=Text(200)), lambda p, o: F.array(row(TITLE, p, o["title"]), row(HEADLINE, p, o["headline"])),
           draft=lambda x: struct(title=left(joined(F.slice(x["w"], 1, 8)), 120), headline=left(s(x, 0), 200)),
           hint="the passage has one theme.", temperature=0.4, pool=7, instructions=(TITLE, HEADLINE)),
    simple("cloze", "Cut words and a sentence out of the passage.", fields(word_masked_passage=Text(), word_answers=Text(), sentence_masked_passage=Text(), sentence_answer=Text()),
           cloze_rows, draft=cloze_draft, native=True, hint="the passage has several sentences with telling words.", pool=7, instructions=(FILL_WORDS, FILL_SENTENCE)),
    simple("extractive_qa", "Write questions that an exact quote from the passage answers.", fields(items=many(1, 5, question=Text(300), supporting_quote=Text(500))),
           lambda p, o: each(F.filter(o["items"], lambda i: quoted(i["supporting_quote"])), lambda i: [row(EXTRACT, in_passage(p, "Question: ", i["question"]), i["supporting_quote"])]),
           quotes=True,
           draft=lambda x: struct(items=F.transform(F.concat(F.transform(F.slice(x["s"], 1, 4), lambda v: left(v, 500)), F.array(F.lit(FABRICATED))),
                                                    lambda v, i: struct(question=cat("Which words make statement ", (i + 1).cast("string"), "?"), supporting_quote=v))),
           hint="the passage holds answers word for word.", temperature=0.3, pool=8, instructions=(EXTRACT,)),
    simple("classification", "Name topic, tone and audience of the passage.", fields(topic=Text(80), tone=Text(choices=TONES), audience=Text(choices=AUDIENCES)),
           lambda p, o: F.array(row(TOPIC, p, o["topic"]), row(TONE, p, o["tone"]), row(AUDIENCE, p, o["audience"])),
           draft=lambda x: struct(topic=left(c(x, 0), 80), tone=pick(x, "classification", 0, TONES), audience=pick(x, "classification", 1, AUDIENCES)),
           hint="the passage has a clear topic and tone.", temperature=0.1, max_tokens=1024, pool=7, instructions=(TOPIC, TONE, AUDIENCE)),
    style_task(),
    simple("backtranslation", "Write the instruction that the passage would be an answer to.", fields(instruction=Text(400)), lambda p, o: F.array(row(o["instruction"], "", p)),
           draft=lambda x: struct(instruction=cat("Write a passage about ", left(c(x, 0), 300), ".")),
           hint="the passage reads like an answer.", temperature=0.5, max_tokens=1024),
    simple("counterfactual", "Change a premise of the passage and say what would follow.", fields(original_claim=Text(300), altered_premise=Text(300), question=Text(300), consequence=Text(1000)),
           lambda p, o: F.array(row(cat("Counterfactual premise: ", o["altered_premise"], "\n\n", o["question"]), p, o["consequence"])),
           draft=lambda x: struct(original_claim=left(s(x, 0), 200), altered_premise=cat("Suppose this were not so: ", left(s(x, 0), 200)), question="What would follow?", consequence=left(s(x, 1), 1000)),
           hint="the passage argues from a premise.", temperature=0.7),
    simple("claim_evidence_plan", "Give a claim with a quote that supports it and one that does not.", fields(claim=Text(300), supporting_quote=Text(500), unrelated_quote=Text(500)), claim_evidence_rows, quotes=True,
           draft=lambda x: struct(claim=left(s(x, 0), 300), supporting_quote=left(s(x, 0), 500), unrelated_quote=left(F.element_at(x["s"], -1), 500)),
           hint="the passage makes claims and gives evidence.", temperature=0.3, pool=4, instructions=(VERIFY, CHOOSE)),
    simple("evidence_selection", "Give claims with candidate quotes of which one supports the claim.",
           fields(items=many(1, 4, claim=Text(300), candidate_quotes=many(2, 5, Text()), supporting_quote=Text(500), rationale=Text(400))), evidence_selection_rows, quotes=True,
           draft=lambda x: struct(items=F.array(
               struct(claim=left(s(x, 0), 300), candidate_quotes=F.array(left(s(x, 0), 500), left(s(x, 1), 500), F.lit(FABRICATED)), supporting_quote=left(s(x, 0), 500), rationale="It says the same."),
               struct(claim=left(s(x, 1), 300), candidate_quotes=F.array(left(s(x, 0), 500), F.lit(FABRICATED)), supporting_quote=left(s(x, 2), 500), rationale="It is not a candidate."))),
           hint="the passage has several statements to choose from.", temperature=0.3, pool=5, instructions=(SELECT, RATIONALE, SUPPORTS)),
    simple("claim_verification", "Give claims, label each by the passage, and give the evidence.", fields(items=many(1, 5, claim=Text(300), label=Text(choices=CLAIM_LABELS), evidence=Text(600))), claim_verification_rows,
           draft=lambda x: struct(items=F.array(*[struct(claim=left(s(x, k), 300), label=CLAIM_LABELS[k], evidence=left(s(x, k), 600)) for k in range(3)])),
           hint="the passage makes claims that can be checked.", temperature=0.4, pool=5, instructions=(LABEL_EVIDENCE, LABEL_ONLY, EVIDENCE_ONLY, LABEL_JSON)),
    simple("entity_extraction", "List the entities of the passage with type and context.", fields(entities=many(1, 12, name=Text(120), type=Text(choices=ENTITY_TYPES), context=Text(300))), entity_rows,
           draft=lambda x: struct(entities=F.when(F.size(x["c"]) >= 3, F.array(entity(x, 0), entity(x, 1), entity(x, 2))).otherwise(F.array(entity(x, 0), entity(x, 1)))),
           hint="the passage names things.", pool=5, instructions=(ENTITIES, ENTITY_TYPE)),
    simple("definition_extraction", "List the terms that the passage defines, with a quote.", fields(definitions=many(1, 6, term=Text(120), definition=Text(500), supporting_quote=Text(500))), definition_rows, quotes=True,
           draft=lambda x: struct(definitions=F.array(struct(term=left(c(x, 0), 120), definition=left(s(x, 0), 500), supporting_quote=left(s(x, 0), 500)),
                                                      struct(term=left(c(x, 1), 120), definition=left(s(x, 1), 500), supporting_quote=FABRICATED))),
           hint="the passage defines terms.", pool=5, instructions=(DEFINE, DEFINE_QUOTE)),
    simple("method_steps", "Name the process of the passage and list its steps.", fields(process_name=Text(120), steps=many(2, 8, step=Text(250))), method_rows,
           draft=lambda x: struct(process_name=left(c(x, 0), 120), steps=F.transform(F.slice(x["s"], 1, 4), lambda v: struct(step=left(v, 250)))),
           hint="the passage describes a procedure.", temperature=0.3, pool=5, instructions=(STEPS, PROCESS, NEXT_STEP, MISSING_STEP)),
    simple("structured_records", "List the facts of the passage as subject, attribute and value.", fields(records=many(1, 10, subject=Text(160), attribute=Text(160), value=Text(240))), record_rows,
           draft=lambda x: struct(records=F.array(*[struct(subject=left(c(x, k), 160), attribute="sentence", value=left(s(x, k), 240)) for k in range(2)])),
           hint="the passage holds facts about things.", pool=5, instructions=(RECORDS_JSON, RECORDS_TEXT, VALUE_OF, ATTRIBUTE_OF, SUBJECT_OF)),
    simple("section_heading", "Write a section heading for the passage and say why it fits.", fields(heading=Text(100), rationale=Text(300)),
           lambda p, o: F.array(row(HEADING, p, o["heading"]), row(HEADING_WHY, in_passage(p, "Heading: ", o["heading"]), o["rationale"])),
           draft=lambda x: struct(heading=left(cat(c(x, 0), " ", c(x, 1)), 100), rationale="It names the main words."),
           hint="the passage could stand under a heading.", temperature=0.3, pool=5, instructions=(HEADING, HEADING_WHY)),
    simple("sentence_equivalence_plan", "Quote a sentence of the passage and reword it without changing its meaning.", fields(source_sentence=Text(500), equivalent_sentences=many(1, 4, Text())), equivalence_rows, quotes=True,
           draft=lambda x: struct(source_sentence=left(s(x, 0), 500), equivalent_sentences=F.array(cat("In other words: ", s(x, 0)), left(s(x, 0), 500))),
           hint="the passage has sentences that can be worded otherwise.", temperature=0.4, pool=4, instructions=(SIMILAR, EQUIVALENT, NLI)),
    simple("sentence_contrast_plan", "Quote a sentence of the passage and contradict it by small replacements.",
           fields(source_sentence=Text(500), replacements=many(1, 4, original=Text(120), replacement=Text(120), contradiction_type=Text(choices=CONTRADICTIONS))), contrast_rows, quotes=True,
           draft=lambda x: struct(source_sentence=left(s(x, 0), 500), replacements=F.array(
               struct(original=left(words(s(x, 0))[0], 120), replacement="never", contradiction_type="negation"), struct(original="qqqq", replacement="x", contradiction_type="attribute"))),
           hint="the passage has sentences that a word can contradict.", temperature=0.4, pool=4, instructions=(SIMILAR, EQUIVALENT, NLI, CORRECT_SENTENCE, NAME_CHANGE)),
    simple("query_generation", "Write search queries that the passage answers.", fields(queries=many(1, 6, Text())),
           lambda p, o: F.concat(F.array(row(QUERIES, p, F.array_join(o["queries"], "\n"))), F.transform(o["queries"], lambda q: row(QUERY_PASSAGE, q, p))),
           draft=lambda x: struct(queries=F.array_compact(F.array(c(x, 0), c(x, 1), cat(c(x, 0), " ", c(x, 1))))),
           hint="the passage answers something people look for.", temperature=0.5, pool=5, instructions=(QUERIES, QUERY_PASSAGE)),
    simple("distractor_qa", "Write multiple-choice questions on the passage, with keywords that can be replaced.",
           fields(questions=many(1, 4, question=Text(300), correct_answer=Text(200), distractors=many(2, 4, Text()), explanation=Text(500), keyword_replacements=many(1, 4, keyword=Text(80), replacement=Text(80)))), distractor_rows,
           draft=lambda x: struct(questions=F.array(
               struct(question="Which word stands in the passage?", correct_answer=left(c(x, 0), 200), distractors=F.array(F.lit("none"), F.lit("other")), explanation="It stands there.",
                      keyword_replacements=F.array(struct(keyword=left(c(x, 0), 80), replacement="nothing"), struct(keyword="qqqq", replacement="x"))),
               struct(question="Which one is it?", correct_answer=left(c(x, 1), 200), distractors=F.array(left(c(x, 1), 200), F.lit("other")), explanation="Two choices are equal.",
                      keyword_replacements=F.array(struct(keyword=left(c(x, 1), 80), replacement="nothing"))))),
           hint="the passage holds facts that can be asked with choices.", temperature=0.5, pool=5, instructions=(CHOICE, CHOICE_ONLY, CHOICE_WHY, CHOICE_WRONG, VALID, CORRECT_PASSAGE, NAME_WORD)),
    simple("error_correction", "Put errors into the passage and note them.", fields(corrupted_passage=Text(2000), correction_notes=Text(500)),
           lambda p, o: F.array(row(FIX, o["corrupted_passage"], p), row(FIX_NOTES, o["corrupted_passage"], o["correction_notes"])),
           draft=lambda x: struct(corrupted_passage=replace_first(x["t"], c(x, 0), F.reverse(c(x, 0))), correction_notes="A word is spelled backwards."),
           hint="the passage is clean prose.", temperature=0.6, pool=5, instructions=(FIX, FIX_NOTES)),
]

COMPARISON = Task(
    "comparison", COMPARE, fields(answer=Text(grows=(24, 500))),
    {"plain": lambda ps, o: F.array(row(COMPARE, passage_list(ps), o["answer"]))},
    lambda x: struct(answer=cat("The first passage speaks of ", x["first_word"], "; the second speaks of ", x["second_word"], ".")),
    temperature=0.5, passages=2, generations=3,
)
RETRIEVAL = Task(
    "retrieval", "Write questions that one passage answers and no other does.", fields(questions=many(1, 4, Text())), {},
    lambda x: struct(questions=F.transform(F.slice(x["c"], 1, 2), lambda w: cat("Which passage mentions ", w, "?"))), passages=2,
)
REASON = Task(
    "retrieval_reason", "Say in a sentence why the passage answers the question.", fields(why=Text(300)), {},
    lambda x: struct(why="It mentions the word."),
)
NO_ANSWER = Task(
    "no_answer_reason", "Say in a sentence why none of the passages answers the question.", fields(why=Text(300)), {},
    lambda x: struct(why="No passage mentions the word."),
)

# -- calls around the tasks ------------------------------------------------------
GATE = Task(
    "gate", "Decide whether a passage is worth making training data of: it holds prose of ten words or more that means something, and is no markup, code, heading or boilerplate.",
    fields(is_quality=Flag()), {},
    lambda x: struct(is_quality=(F.size(x["w"]) >= LEAST_WORDS) & (F.length(F.regexp_replace(x["t"], r"[^\p{L}]", "")) * 2 >= F.length(x["t"]))),
    temperature=0.1, max_tokens=20,
)
CRITERIA = "The output answers the instruction correctly from the input, and is complete and well formed."


def judge_draft(x: Passage) -> Column:
    """There is an output, no longer than the input."""
    good = (x["output"] != "") & (F.length(x["output"]) <= F.length(x["input"]))
    why = F.when(x["output"] == "", "the output is empty").when(good, "the output fits").otherwise("the output is longer than the input")
    return F.struct(F.coalesce(good, F.lit(False)).alias("is_quality"), F.coalesce(why, F.lit("the output is empty")).alias("reason"))


JUDGE = Task(
    "judge", "Judge a training datapoint by the criteria given, and by nothing else. Say in few words why it is kept or rejected.",
    fields(is_quality=Flag(), reason=Text()), {}, judge_draft, temperature=0.0, max_tokens=500,
)
REASONING = Task(
    "reasoning", "Set out, step by step and in impersonal words, how the response follows from what the passage says. Don't speak of the task, of the form of the response or of yourself.",
    fields(reasoning=Text()), {},
    lambda x: struct(reasoning=cat("The instruction asks: ", x["instruction"], " The input has ", F.length(x["input"]).cast("string"), " characters. The output follows from it.")),
    max_tokens=1000,
)


def drawn(x: Passage, chances: dict[str, float], seed: int) -> Column:
    """The names that a hash of the call's id falls on, each by its chance."""
    key = x["id"].cast("string")
    unit = lambda name: bucket(cat(key, f"|{name}|{seed}"), 1 << 32) / F.lit(float(1 << 32))
    found = [F.when(unit(n) < p, F.lit(n)) for n, p in chances.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def selector(menu: list[Task], chance: float = 0.25, seed: int = 0) -> Task:
    """The call that picks from a menu what suits a passage, by the tasks' hints.
    Its rule draws each by chance."""
    for t in menu:
        if not t.hint.strip():
            raise ValueError(f"{t.name!r} has no hint that tells when to select it")
    names = tuple(t.name for t in menu)
    options = "\n".join(f"- {t.name}: select it if {t.hint}" for t in menu)
    return Task(
        "selector", f"Select from this list the tasks that suit the passage: none, one or several.\n{options}", fields(selected=many(0, None, Text(choices=names))), {},
        lambda x: struct(selected=drawn(x, dict.fromkeys(names, chance), seed)), temperature=0.1, max_tokens=1024,
    )


TASKS = {t.name: t for t in SINGLE}
MULTI_TASKS = {t.name: t for t in (RETRIEVAL, COMPARISON)}


def list_tasks() -> dict[str, str]:
    """Names of the tasks that take one passage, with their hints."""
    return {name: t.hint for name, t in TASKS.items()}


def list_multi_tasks() -> dict[str, str]:
    return {name: t.hint for name, t in MULTI_TASKS.items()}


def get_task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"Unknown task {name!r}. Available: {', '.join(sorted(TASKS))}")
    return TASKS[name]


def get_multi_task(name: str) -> Task:
    if name not in MULTI_TASKS:
        raise ValueError(f"Unknown task {name!r}. Available: {', '.join(sorted(MULTI_TASKS))}")
    return MULTI_TASKS[name]


def resolve_tasks(tasks: str | Task | list[str | Task]) -> list[Task]:
    given = tasks if isinstance(tasks, (list, tuple)) else [tasks]
    return [t if isinstance(t, Task) else get_task(t) for t in given]


def task(
    *,
    prompt: str,
    schema: str,
    output: str | Callable[[Column, Column], Column] | None = None,
    instruction: str | None = None,
    instruction_variants: tuple[str, ...] | list[str] | None = None,
    rows: Rows | None = None,
    hint: str = "",
    name: str = "custom",
    **knobs: object,
) -> Task:
    """A task of one's own: either rows, or an instruction with an output, which
    is a template over the answer's fields, a function of passage and answer, or
    by default the answer's only field."""
    if rows is not None:
        if output is not None or instruction_variants is not None:
            raise ValueError("rows excludes output and instruction_variants")
        return Task(name, prompt, schema, {"plain": rows}, hint=hint, **knobs)
    if not (instruction or instruction_variants):
        raise ValueError("an instruction is needed unless rows is given")
    names = [n for n, _ in from_ddl(schema).of]
    if output is None and len(names) != 1:
        raise ValueError("output is needed where the schema has several fields")
    base = instruction or instruction_variants[0]

    def made(p: Column, o: Column) -> Column:
        if output is None:
            value = o[names[0]].cast("string")
        elif callable(output):
            value = output(p, o)
        else:
            value = template(output, {n: o[n] for n in names})
        return F.array(row(base, p, value))

    built = Task(name, prompt, schema, {"plain": made}, hint=hint, **knobs)
    if instruction_variants:
        pool = list(dict.fromkeys([base, *instruction_variants]))
        object.__setattr__(built, "templates", lambda: {base: pool})
    return built
