"""Repair of conversations, piece encoding and alignment of tokenizers."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passageloom.llm import align, pieces, queries, repair

PIECES = vocabularies.path("piece_bpe_32k.model")
BYTES = vocabularies.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "▁x▁▁y", "ﬁ①Å ｆｕｌｌ", "\n\t x\r\n", "<s>a</s> <unk> <0x41><|endoftext|>", "\x00a\x85\xa0　b ", "日本語と한국어 नमस्ते", "😀👩‍🚀 é", "a" * 3000, " " * 2001, "x" + "▁" * 7, "''s 'LL don't 1234567 ½²٣", "​﻿­"]


# -- conversations
def test_repair_query(same):
    same(queries.op11_conversation_repair, queries.OP11_SQL)


def brute_repair(rows):
    """rows: role, text in order. Every sequence of edits is tried."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = [None]

    def walk(k, last, cost, audit, out, ins):
        if k == len(rows) and last in ("", "a") and (best[0] is None or (cost, audit) < best[0][:2]):
            best[0] = (cost, audit, out)
        if ins < 2:
            to = "a" if last == "u" else "u"
            walk(k, to, cost + 2, audit + "I", out + [f"{'user' if to == 'u' else 'assistant'}:"], ins + 1)
        if k == len(rows):
            return
        role, text = rows[k]
        walk(k + 1, last, cost + 3, audit + "D", out, 0)
        if faults[k] in ("blank", "duplicate"):
            return
        more, i = faults[k] == "truncated", role[:1]
        fits = lambda to: to == "s" and not last or to == "u" and last != "u" or to == "a" and last == "u"
        if i in "sua" and i and fits(i):
            walk(k + 1, i, cost + more, audit + "K", out + [f"{role}:{text}"], 0)
        for to, name in (("u", "user"), ("a", "assistant")):
            if fits(to):
                walk(k + 1, to, cost + 2 + more, audit + "R", out + [f"{name}:{text}"], 0)

    walk(0, "", 0, "", [], 0)
    n, initials = Counter(faults), [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return n["blank"], n["duplicate"], n["truncated"], illegal, best[0][0], best[0][1], hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest()


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


@pytest.mark.parametrize("block, fan", [(256, 64), (2, 2)])
def test_repair_against_all_edits(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", "umpire", None], ["Yes.", "No", " \t", "", "Why?", "Go! \n", "x ", None]
    rows = [(c if c else None, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for c in range(40) for _ in range(rng.randint(1, 5))]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit("x"), "pos": F.lit(1), "BLOCK": F.lit(2)})
    got = {r.conv_id: r for r in repair.repair_report(given).collect()}
    of = defaultdict(list)
    for c, turn, role, text in rows:
        of[c].append((c, turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(of) and len(got) == 40
    for c, mine in of.items():
        mine.sort(key=order)
        r, turns = got[c], {t for _, t, _, _ in mine if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute_repair([x[2:] for x in mine])


def test_repair_of_a_long_conversation_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Ok.", "", f"{k}.", f"{k}"])) for k in range(400)] + [(2, k, "user", "same.") for k in range(50)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(tuple, repair.repair_report(given).collect()))
    turns = sorted(map(tuple, repair.repaired_turns(given).collect()))
    monkeypatch.setattr(repair, "BLOCK", 8)
    monkeypatch.setattr(repair, "FAN", 3)
    assert sorted(map(tuple, repair.repair_report(given).collect())) == want
    again = sorted(map(tuple, repair.repaired_turns(given).collect()))
    assert [t[3:] for t in again] == [t[3:] for t in turns]
    said = "\n".join(f"{t[3]}:{t[4]}" for t in turns if t[0] == 1)
    assert hashlib.sha256(said.encode()).hexdigest() == want[0][-1]


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "assistant", "A b. C!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(map(tuple, repair.damaged(given).collect()))
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.replace(".", "").replace("!", "") if kind == 2 else text, kind > 0)
        want[row] += 2 if kind == 3 else 1
    assert got == want
    assert repair.repair_report(given.where("false")).count() == 0
    dropped = repair.repair_report(spark.createDataFrame([(7, 1, "user", "x", False)], "conv_id long, turn long, role string, text string, alive boolean")).collect()
    assert [tuple(r) for r in dropped] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# -- pieces
def odd_documents(spark):
    rows = [(k, t) for k, t in enumerate(ODD + [None, ODD[2]])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("Decoded", F.lit(1))


def test_pieces_equal_the_library_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = pieces.piece_decode(pieces.piece_encode(docs, PIECES), PIECES)
    assert both.count() == docs.count() and pieces.checked(both, PIECES).count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in queries.op12_piece_bpe(spark, sf).collect()}
    for r in docs.collect():
        ids = model.encode(r.text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_pieces_of_odd_texts(spark):
    coded = pieces.piece_encode(odd_documents(spark), PIECES).withColumnRenamed("Decoded", "other")
    both = pieces.piece_decode(coded, PIECES)
    assert both.columns == ["doc_id", "text", "other", "ids", "decoded"]
    assert pieces.checked(both, PIECES).count() == 0 and both.count() == len(ODD) + 2
    spoilt = both.withColumn("ids", F.when(F.col("doc_id") == 2, F.array(F.lit(5))).otherwise(F.col("ids")))
    assert [r.doc_id for r in pieces.checked(spoilt, PIECES).collect()] == [2]
    assert pieces.piece_digest(odd_documents(spark).where("false"), PIECES).count() == 0


def test_decoding_any_ids(spark):
    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    rows = [([rng.choice([1, 2, 28705, 264, 259, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 6))],) for _ in range(300)]
    got = pieces.piece_decode(spark.createDataFrame(rows, "ids array<int>"), PIECES).collect()
    assert [r.decoded for r in got] == [model.decode(r.ids) for r in got]
    with pytest.raises(Exception, match="not in the vocabulary"):
        pieces.piece_decode(spark.createDataFrame([([32000],)], "ids array<int>"), PIECES).collect()


@pytest.mark.parametrize("short", [0, 6, 48, 10**6])
def test_an_agenda_of_many_letters(monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    coder, model, rng = pieces.PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    for text in ODD:
        assert coder.encode([text])[0].tolist() == model.encode(text)
    for _ in range(300):
        text = "".join(rng.choice("aàetihn ▁'.1\n") for _ in range(rng.randint(1, 60)))
        ids, ends = coder.encode([text, "", text])
        assert ids[: ends[0]].tolist() == model.encode(text) and ends[1] == ends[0]


# -- alignment
def brute_alignment(texts):
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    letters, docs = align.byte_alphabet(), []
    spell_b = lambda k: bytes([int(b_of.id_to_piece(k)[1:-1], 16)]) if b_of.is_byte(k) else b_of.id_to_piece(k).replace("▁", " ").encode()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(k, bytes(letters[c] for c in a_of.id_to_token(k))) for k in a_of.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(k, spell_b(k)) for k in b_of.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(([], [], []))
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        cuts, groups = sorted(ends[0] & ends[1]), []
        for side in (a, b):
            at, k, out = 0, 0, [[] for _ in cuts]
            for token, x in side:
                at += len(x)
                while at > cuts[k]:
                    k += 1
                out[k].append(token)
            groups.append(out)
        docs.append((a, b, list(zip(*groups))))
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in docs]
    count = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (a, b, g), found in zip(docs, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (len(a), len(b), len(g), sum(found.values()), sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()), hashlib.sha256(said.encode()).hexdigest() if said else "")


def test_alignment_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, want in zip(docs, brute_alignment([r.text for r in docs])):
        assert got[r.doc_id] == want


@pytest.mark.parametrize("limit, listed", [(align.LIMIT, 4096), (0, 4096), (align.LIMIT, 1)])
def test_alignment_of_odd_texts_either_way(spark, monkeypatch, limit, listed):
    docs = odd_documents(spark).withColumn("keys", F.lit("x"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute_alignment(list(texts.values()))))
    monkeypatch.setattr(align, "LISTED", listed)
    both = align.Aligner(BYTES, vocabularies.PATTERN, PIECES)
    assert both.rows(list(texts.values()))[3] == [want[k][3] for k in texts]
    keys, times = both.rows(list(texts.values()))[5:]
    assert [int(align.counts_of(k, t)[1].sum()) for k, t in zip(keys, times)] == [want[k][3] for k in texts]
    got = align.alignment_report(docs, BYTES, vocabularies.PATTERN, PIECES, limit=limit).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert align.alignment_report(docs.where("false"), BYTES, vocabularies.PATTERN, PIECES, limit=limit).count() == 0
