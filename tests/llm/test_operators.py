"""Search, tokens, mixing, conversations, pages and toxicity."""

import collections
import hashlib
import math
import random
import re
import time

import duckdb
import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import functions as F

from passageloom.llm import bpe, html_text, mixing, queries, quotes, token_counts, toxicity
from passageloom.llm.topk import topk

ODD = "ab  \n\t\r\x1c\x85\xa0　é²½①٣文😀'sSt'Ré​_-!0 1"
RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


# -- exact top-k
def test_topk_query(same):
    same(queries.op1_exact_topk, queries.OP1_SQL)


def brute_topk(rows, asks, k):
    held = lambda x: max(min(x, 2**63 - 1), -(2**63))
    sound = [(i, [float(held(math.floor(1024 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in sound:
        if asks(i):
            scored = sorted((-held(sum(int(x) * int(y) for x, y in zip(a, b))), j) for j, b in sound if j != i and len(b) == len(a))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, block", [(1.0, 7), (1e4, 1000), (1e9, 16), (1e18, 16)])
def test_topk_edges(spark, scale, block):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 0, 0.5, rng.gauss(0, 1)]) * scale for _ in range(6)]) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [math.nan] * 6), (103, [math.inf] * 6), (None, [1.0] * 6), (104, [1.0, 2.0]), (110, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "dims", "rank", "score")})
    got = topk(df, F.col("vec_id") % 10 == 0, block=block)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, lambda i: i % 10 == 0, 10)
    assert topk(df.limit(0), F.lit(True)).count() == 0


# -- tokens
def test_bpe_equals_tiktoken(spark):
    rng = random.Random(1)
    texts = ["", None, "hello world", "x" * 5000, "don't  stop\n\n"] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    known = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coded = bpe.bpe_encode(df, RANKS, vocabularies.PATTERN)
    for r in bpe.bpe_decode(coded, RANKS).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == known.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    got = {r.doc_id: r for r in bpe.bpe_digest(df, RANKS, vocabularies.PATTERN).collect()}
    ids = known.encode_ordinary(texts[2])
    assert got[2].n_tokens == len(ids) and got[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[0].ids_sha256 == got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and bpe.bpe_digest(df.limit(0), RANKS, vocabularies.PATTERN).count() == 0


def test_bpe_documents(spark, sf):
    known = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, sf).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_perfect_hash():
    ranks = {str(k).encode(): k for k in range(3000)}
    h = bpe.PerfectHash(ranks)
    assert h.ranks(list(ranks)).tolist() == list(ranks.values()) and len(h.at) == 3000
    assert h.ranks([b"x", b"", b"3000"]).tolist() == [-1] * 3


def greedy(word, vocabulary, most=16):
    """Longest match first; no piece is longer than most."""
    k = n = 0
    while k < len(word):
        end = next((e for e in range(min(len(word), k + most), k, -1) if word[k:e] in vocabulary), None)
        if end is None:
            return 0
        k, n = end, n + 1
    return n


def test_automaton():
    rng = random.Random(2)
    for _ in range(1500):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        auto = token_counts.Automaton(vocabulary)
        for _ in range(4):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert auto.count(word) == greedy(word, vocabulary)


def test_token_counts(spark, sf):
    path = vocabularies.path("piece_bpe_32k.model")
    pieces = set(token_counts.sentencepiece_vocabulary(path))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(-1, None), (-2, ""), (-3, "文字\x00 ok " * 3), (-4, "y" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    texts = dict(rows)
    assert max(map(len, pieces)) <= 16
    for r in token_counts.document_token_counts(df, path).collect():
        words = [w for w in (texts[r.doc_id] or "").split(" ") for w in w.split() if w]
        counts = [greedy("▁" + w, pieces) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(counts) + counts.count(0), counts.count(0))


def test_token_counts_query(spark):
    """The query over its whole table and whole texts, and repeated rows."""
    sf = "/root/testdata/sf0.01"
    pieces = set(token_counts.sentencepiece_vocabulary(vocabularies.path("piece_bpe_32k.model")))
    known = {}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        counts = [known[w] if w in known else known.setdefault(w, greedy("▁" + w, pieces)) for w in words]
        want.append((r.doc_id, len(words), sum(counts) + counts.count(0), counts.count(0)))
    got = queries.op3_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"] and sorted(map(tuple, got.collect())) == sorted(want)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    counted = token_counts.document_token_counts(twice, vocabularies.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_words for r in counted) == [0, 2, 2] and token_counts.document_token_counts(twice.limit(0), vocabularies.path("piece_bpe_32k.model")).count() == 0


# -- mixing
def test_mixing_query(same):
    same(queries.op4_mixing, queries.OP4_SQL)


def reshared(sizes, weights, budget, cap):
    """Shares by weight; what is above a cap is shared again until none is."""
    target, free, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}, budget
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else level * weights[s]
            left -= target[s] if over else 0
        free = free - over if over else set()
    return target


def test_mixing_against_resharing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    rng = random.Random(6)
    names = ["a", "b", "c", "d", "é", None, "empty"]
    rows = [(k, "w " * rng.choice([0, 3, 3, 3, rng.randint(1, 60)]), "a" if k % 3 == 0 else rng.choice(names[:6])) for k in range(900)]
    rows += [(1000 + k, None, "empty") for k in range(3)] + [(2000, "w " * 500, "big"), (None, "w w", "b"), (5, "w " * 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("size", "i", "class", "bucket")})
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    plan = mixing.mixing_plan(df).collect()
    assert len(plan) == len(rows) and sorted(plan, key=str) == sorted(mixing.mixing_plan(df.repartition(5)).collect(), key=str)
    taken = collections.Counter()
    for (size_target), n in collections.Counter((r.source_size, round(r.target, 6)) for r in plan).items():
        assert any(sizes[s] == size_target[0] and abs(target[s] - size_target[1]) < 1e-4 for s in sizes)
    for r in plan:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    source = {i: s for i, _, s in rows}
    for r in plan:
        if r.doc_id is not None and r.doc_id != 5:
            taken[source[r.doc_id]] += r.taken
    for s in ("a", "b", "c", "d", "é", None):
        assert abs(taken[s] - target[s]) < 0.06 * target[s] + 60
    single = df.where("doc_id <> 5")
    made, plan = mixing.mix(single), mixing.mixing_plan(single).collect()
    assert made.columns == df.columns and made.count() == sum(r.copies for r in plan)
    assert mixing.mixing_plan(df.limit(0)).count() == 0


# -- conversations
CHAT = [
    (1, 0, "user", "Where is the Key?\nI lost it."),
    (1, 1, "assistant", "> where is  the key?\nUnder the mat."),
    (1, 2, "user", "I asked two things.\nWhat about rain?"),
    (1, 3, "assistant", "> > Where is the key?\n> Under the mat.\nNo, in the bag."),
    (1, 4, "user", ">What about rain?\n> ---\nAnd snow?"),
    (1, 5, "user", "> nobody said this\nalone"),
    (2, 0, "user", "Where is the key?"),
    (2, 1, None, None),
    (2, 1, "user", "> Where is the key?\nrepeated turn"),
    (None, 3, "user", "> x\ny"),
    (3, None, "user", "z"),
    (4, 0, "user", "On the way home\nI saw it."),
    (4, 1, "user", "On Mon, 3 May, Ann <a@b.org> wrote:\n> I saw it.\nMe too."),
    (4, 2, "user", "On Tue, 4 May,\nBob Hill wrote:\n\n> Me too.\nFine.\nShe wrote:\nAll.\nAnn wrote:\r\n> I saw it."),
    (4, 3, "user", "I left.\nwrote:\n> Fine."),
    (4, 4, "user", "On Monday I left.\nAnn wrote:\n> Fine."),
]


def chat_frame(spark, rows=CHAT):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_query(same):
    same(queries.op9_quote_linking, queries.OP9_SQL)


def test_quotes_fixture(spark):
    got = {(r.conv_id, r.turn, r.role): r for r in quotes.reply_ordered(chat_frame(spark).withColumns({c: F.lit(1) for c in ("conv", "line", "h")})).collect()}
    link = {k: (v.parent_turn, v.thread_turn, v.n_linked) for k, v in got.items()}
    assert link[1, 1, "assistant"] == (0, 0, 1) and link[1, 3, "assistant"] == (1, 0, 1) and link[1, 4, "user"] == (2, 2, 1)
    assert link[1, 5, "user"] == (None, 5, 0) and link[2, 1, "user"] == (0, 0, 1) and link[None, 3, "user"] == (None, 3, 0)
    assert got[1, 3, "assistant"].text == "No, in the bag." and got[1, 3, "assistant"].n_quoted == 2
    assert got[1, 0, "user"].chat == "<|user|>\nWhere is the Key?\nI lost it."
    said = [got[4, k, "user"].text for k in range(5)]
    assert said == ["On the way home\nI saw it.", "Me too.", "\nFine.\nShe wrote:\nAll.", "I left.", "On Monday I left."]
    assert quotes.reply_ordered(chat_frame(spark, [])).count() == 0


def test_conversations_in_reply_order(spark):
    got = [(r.conv_id, r.turn) for r in quotes.conversations(chat_frame(spark).repartition(3)).collect() if r.conv_id == 1]
    assert got == [(1, 0), (1, 1), (1, 3), (1, 2), (1, 4), (1, 5)]


def test_quotes_of_very_long_texts(spark):
    long = "\n".join(f"line {k} of many, wrote: no" for k in range(40_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "Ann wrote:\n> " + long.replace("\n", "\n> ") + "\nYes."), (1, 2, "user", "x" * 500_000), (1, 3, "user", "> " + "x" * 500_000)]
    got = {r.turn: r for r in quotes.reply_ordered(chat_frame(spark, rows)).collect()}
    assert (got[1].parent_turn, got[1].n_linked, got[1].text) == (0, 40_000, "Yes.") and got[3].parent_turn == 2


def test_quotes_of_passages(spark):
    long = "The engine runs hot after an hour. Is that, as such, a fault of the pump? I checked the oil twice."
    rows = [
        (1, 0, "user", f"Hello there.\n{long}"),
        (1, 1, "user", "The engine is old, and so is the pump that I bought."),
        (1, 2, "assistant", "> The engine runs hot after\n> an hour. Is that, as such, a\n> fault of the pump? I checked the\n> oil twice.\nIt may be."),
        (1, 3, "assistant", "> is that, as such, a fault of the pump?\nYes."),
        (1, 4, "user", "> > Is that, as such, a fault\n> > of the pump?\n> It may be.\nThanks."),
        (1, 5, "user", "> I never said so before. I checked the oil\n> twice. And then left.\nOdd."),
        (1, 6, "user", "> Nobody wrote any of this\n> in two lines.\nNo."),
        (2, 1, "user", "> The engine runs hot after\n> an hour."),
    ]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_linked) for r in quotes.reply_ordered(chat_frame(spark, rows)).collect()}
    assert got[1, 2] == (0, 0, 4) and got[1, 3] == (0, 0, 1) and got[1, 4] == (2, 0, 1) and got[1, 5] == (0, 0, 1)
    assert got[1, 6] == (None, 6, 0) and got[2, 1] == (None, 1, 0) and got[1, 1] == (None, 1, 0)


def test_quotes_of_short_sentences(spark):
    rows = [(1, 0, "user", "Well. All good! I left\nearly. No"), (1, 1, "user", "Good news came in."), (1, 2, "user", "> All\n> good!\nFine."), (1, 3, "user", "> Good\n> news\nFine."), (1, 4, "user", "> no.\nSo.")]
    got = {r.turn: (r.parent_turn, r.n_linked) for r in quotes.reply_ordered(chat_frame(spark, rows)).collect()}
    assert got == {0: (None, 0), 1: (None, 0), 2: (0, 2), 3: (None, 0), 4: (0, 1)}


def test_quotes_with_one_opening(spark):
    """n messages that begin alike and n wrapped replies: each finds its own, and four
    times as many take at most five times as long."""

    def took(n):
        said = lambda k: f"Dear customer thank you for your message of today about order {k} which has left us."
        rows = [(1, k, "user", said(k)) for k in range(n)] + [(1, n + k, "user", "> Dear customer thank you for your\n> message of today about order " + f"{k}\n> which has left us.\nNoted.") for k in range(n)]
        frame = chat_frame(spark, rows).repartition(4)
        began = time.time()
        got = quotes.reply_ordered(frame).where((F.col("turn") >= n) & (F.col("parent_turn") == F.col("turn") - n))
        assert got.count() == n
        return time.time() - began

    took(50)
    assert took(4000) < 5 * took(1000)


def test_quotes_fixture_equals_sql(spark):
    con = duckdb.connect()
    rows = [r for r in CHAT if r[:2] != (2, 1)]
    frame = chat_frame(spark, rows).toPandas()  # noqa: F841  DuckDB reads it by name
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame")
    sql = con.execute(f"SELECT conv_id, thread_turn, turn, role, parent_turn, n_quoted, n_linked, text, chat FROM ({queries.OP9_SQL})").fetchall()
    got = [tuple(r) for r in quotes.reply_ordered(chat_frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, sql))


# -- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Home</a></ul></nav><div id="cookie-notice">We use cookies, really, we do.</div>
<div class="layout"><div class="post-content"><h1>Head &amp; line</h1><p>One,  two,\n three &lt;b&gt; and some more words here.
<p>Second <b>bold <a href=x>link</a> text, with commas, and so on<br>next line</p><script>var x="</p>";</script>
<div class="ad">Buy, buy, buy</div><ul><li>item one, of text</li><li>item two</li></ul>
<section id="comments"><p>First, I, think, that, this, is, long, very long comment text indeed.</p></section></div>
<aside><p>Side, bar, text, of, many, commas</p></aside></div><form>Name <input></form><footer>&copy; site</footer></body></html>"""


def test_page_fixture():
    assert html_text.main_text(PAGE) == "Head & line\nOne, two, three <b> and some more words here.\nSecond bold link text, with commas, and so on next line\nitem one, of text\nitem two"
    for source in (None, "", "<html></html>", "<script>x", "<a href=x>only a link</a>", "<div>" * 50, "<p><di"):
        assert html_text.main_text(source) == ""
    assert html_text.main_text("plain words, no markup") == "plain words, no markup"
    assert html_text.main_text("<div>" * 3000 + "<p>deep, text</p>") == "deep, text"


@pytest.mark.parametrize("part", ["<svg/>", "<svg class=icon/>", "<math/>", "<iframe src='x'/>", "<video/>", "<svg><path d='x'/><g>", "<svg><path/></svg>", "<object data=x><p>no</p></object>", "<p><video src=x></p>", "<video src=x>", "<object data=x>", "<script src='x'/></script>"])
def test_page_keeps_what_follows(part):
    body = "<p>First, of them, and more words.</p><p>Second, of them, and more words.</p>"
    want = "First, of them, and more words.\nSecond, of them, and more words."
    assert html_text.main_text(f"<body><div class=content>{part}{body}</div></body>") == want
    assert html_text.main_text(f"<body><div>{part}</div><div class=content>{body}</div></body>") == want


@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("outer", ["article", "main", "div class=post"])
@pytest.mark.parametrize("head", ["<h1>Head</h1>", "<header><h1>Head</h1></header>"])
def test_page_around_the_body(n, outer, head):
    """The heading outside of the body's div and short last sections stay, at any length; what is beside goes."""
    body = "".join(f"<p>Paragraph {k}, of them, and more words, for points.</p>" for k in range(n))
    page = f"""<html><body><nav><a href=/>Home</a></nav><div class=sidebar><p>Side text, of some words.</p></div><div class=wrap><{outer}>{head}
<div class=entry-content>{body}</div><p>By one.</p><div><h2>Note</h2><p>Short end.</p></div><ul><li><a href=1>More</a><li><a href=2>and more</a></ul></{outer.split()[0]}><aside>Aside</aside></div></body></html>"""
    assert html_text.main_text(page).split("\n") == ["Head", *[f"Paragraph {k}, of them, and more words, for points." for k in range(n)], "By one.", "Note", "Short end."]


def test_page_in_a_form():
    body = "<div class=content><p>First, of them, and more words.</p><p>Second, of them, and more words.</p></div>"
    want = "First, of them, and more words.\nSecond, of them, and more words."
    for page in (f"<form role=form>{body}<input><button>Go</button></form>", f"{body}<form>Your name, please <input></form>", f"<form>{body}<fieldset>Your name</fieldset></form>"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == want


def test_pages(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, sf).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<b>|</b>|<br>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    df = spark.createDataFrame([(1, "u", None, "c"), (2, None, PAGE, "c"), (2, None, PAGE, "c")], "page_id long, url string, html string, text string")
    assert [r.n_chars > 0 for r in html_text.page_text(df).orderBy("page_id").collect()] == [False, True, True]
    assert html_text.page_text(df.limit(0)).count() == 0


# -- toxicity
def test_toxicity_learns(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ko", "mi", "ra", "lu", "ne"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(900):
        toxic, ws = k % 5 == 0, [word() for _ in range(rng.randint(0, 60))]
        if toxic:
            ws.insert(rng.randint(0, len(ws)), rng.choice(["vilegar", "scornix", "hatebor"]))
        rows.append((k, " ".join(ws) if ws else None, rng.choice(["en", "fr", None])))
        labels.append((k, 1 if toxic else 0 if k % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("score", "toxic", "y")})
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known, sample=300).collect()
    truth = {k: int(k % 5 == 0) for k in range(900)}
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and 120 < len(held) < 240 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    other = {r.doc_id: r.score for r in toxicity.toxicity(docs.withColumn("lang", F.lit("zz")).repartition(7), known, sample=300).collect()}
    assert sum(abs(other[r.doc_id] - r.score) < 0.2 for r in got) > 850  # the language is not an input
    assert all(r.score == 0 for r in toxicity.toxicity(docs, known.where("toxic = 0")).collect())
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_held_out_rows(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


BODY = "<p>First, of them, and more words.</p><p>Second, of them, and more words.</p>"
READ = "First, of them, and more words.\nSecond, of them, and more words."


@pytest.mark.parametrize("name", ["article-comments", "post-comments", "entry-comments", "main-menu", "article-footer", "story-related", "commentsList", "commentList-2", "post_sidebar", "comment-body", "related-articles", "sponsored-content", "sidebar", "cookie-notice"])
@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div>{}</div>"])
def test_page_beside_by_any_name(name, outer):
    """Comments and menus whose class also names the article, inside and after it."""
    other = f'<div class="{name}"><p>I, for one, liked it, and this is long, too, with many commas, and more, of it.</p></div>'
    for tag in ("class", "id"):
        part = other.replace("class", tag)
        assert html_text.main_text(f"<html><body>{outer.format(BODY + part)}</body></html>") == READ
        assert html_text.main_text(f"<html><body><div>{outer.format(BODY)}{part}</div></body></html>") == READ


@pytest.mark.parametrize("name", ["post-12 post hentry category-nav tag-footer", "content has-sidebar", "content-sidebar-wrap", "elementor-widget-theme-post-content", "entry-header", "main-content", "no-sidebar", "story"])
def test_page_names_that_hold(name):
    assert html_text.main_text(f'<body><nav>x</nav><div class="{name}">{BODY}</div></body>') == READ


def test_page_split_containers():
    """An article in two containers, the second short, with an advert between."""
    page = f"<body><nav>Home</nav><div class=content>{BODY * 5}</div><div class=ad>Buy now, or never.</div><div class=content><p>The end.</p></div><div class=footer>Imprint</div></body>"
    assert html_text.main_text(page) == "\n".join([READ] * 5 + ["The end."])
    deep = "<b>" * 40 + "bold"
    assert html_text.main_text(f"<article><p>One {deep}<p>Two, of them</article>") == "One bold\nTwo, of them"
    assert html_text.main_text(f"<body><article class=comment>{BODY}</article><article>{BODY}<p>More.</article></body>") == READ + "\nMore."


@pytest.mark.parametrize("page", [
    "<div>a" * 100_000, '<a "' * 100_000, "<a " * 100_000, "<![CDATA[" * 100_000, "<!" * 100_000, "<script/>" * 50_000 + "</script>", "</script" * 100_000,
    "<p><b>" * 50_000 + "<div></div>" * 50_000, "<blockquote>" * 50_000 + "<li>x" * 50_000, "<ul><li>a" * 50_000, "<form>x" * 50_000, "<svg>" * 50_000 + "<div>x" * 50_000, "<header>x" * 50_000, "<a class=" * 50_000, "<i class='a " * 50_000 + ">x",
])
def test_page_in_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 6


def test_page_rows(spark):
    rows = [(1, "u", "<div>" * 20000 + BODY), (1, "u", BODY), (None, None, BODY), (2, None, ""), (3, "u", "<p>" + "word, " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "title")})
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_text.page_text(df).collect()))
    assert got == [(0, len(READ)), (1, len(READ)), (1, len(READ)), (2, 0), (3, 6 * 200_000 - 1)]
