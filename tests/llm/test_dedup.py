"""Exact, near and substring duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageloom.llm import near_dup, queries, suffix_dedup
from passageloom.llm.exact_dedup import chunks, exact_dedup, keep_distinct

UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None, "a"), (2, "", "a"), (3, "Ab É", None), (4, "aB É", "b"), (5, "ab é", "b"), (5, "x", "c"), (None, "ab É", "c"), (None, "alone", "c"), (7, "w " * 30000, "c"), (7, "w " * 30000, "c")]


def edge(spark, rows=EDGE):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("i", "kept", "h", "n", "rep", "block")})


def test_exact_query(same):
    same(queries.op7_exact_dedup, queries.OP7_SQL)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_edges(spark, weak):
    chunk_id = (lambda c: F.length(c) % 2) if weak else F.xxhash64
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(edge(spark), chunk_id=chunk_id, min_chunk=8).collect()), key=str)
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 1, True), (5, 5, 1, True), (None, 4, 3, False), (None, None, 1, True), (7, 7, 2, True), (7, 7, 2, True)]
    assert got == sorted(want, key=str)


def test_exact_empty_and_columns(spark):
    assert exact_dedup(edge(spark, [])).count() == 0
    kept = keep_distinct(edge(spark))
    assert kept.columns == edge(spark).columns and {r.doc_id for r in kept.collect()} == {2, 4, 5, 7, None}


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab hns\né") for _ in range(40000))
    got = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t"))).first()[0]
    assert "".join(got) == text and len(got) > 5 and max(map(len, got)) <= 8192 + 2


def brute_near(rows, words, percent):
    def shingles(text):
        ws = WORDS.findall((text or "").translate(UPPER))
        if not ws:
            return frozenset()
        return frozenset(tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)) if len(ws) >= words else frozenset([tuple(ws)])

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held, pairs = collections.defaultdict(list), collections.Counter()
    for i in sorted(sets):
        for s in sets[i]:
            for j in held[s]:
                pairs[j, i] += 1
            held[s].append(i)
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_documents(spark, sf, words, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], words, percent)
    got = near_dup.near_duplicates(docs, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_large_groups(spark, monkeypatch):
    """Drifting copies in groups of several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng, base, rows = random.Random(5), [f"w{k}" for k in range(150)], []
    for i in range(120):
        ws = list(base)
        for _ in range(rng.randint(0, 14)):
            ws[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(ws), "s"))
    want = brute_near([r[:2] for r in rows], 3, 85)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(edge(spark, rows), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in want.items()} and 1 < len(set(got.values())) < 120


def test_near_edges(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(edge(spark), words=3, percent=85).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(edge(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in up.items() if any(x in p and p[0] != p[1] for p in pairs)}


def brute_spans(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows):
        n, g = len(t), np.zeros(len(t) + 1, int)
        for p in range(n - length + 1):
            if first.setdefault(t[p : p + length], i) < i:
                g[p], g[p + length] = g[p] + 1, g[p + length] - 1
        gone = np.cumsum(g[:n]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0
        out[i] = (n, int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    return out


def digests(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


def test_suffix_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert digests(queries.op2_suffix_dedup(spark, sf)) == brute_spans([(r.doc_id, (r.text or "").encode()) for r in rows], 50)


def test_suffix_blocks(spark, monkeypatch):
    """Many small blocks and buckets, few letters, periodic texts."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rng = random.Random(2)
    shared = ["".join(rng.choice("abé") for _ in range(rng.randint(49, 130))) for _ in range(5)] + ["a" * 200, "ab" * 120]
    rows = [(k, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60)))]) for _ in range(4)), "s") for k in range(40)]
    assert digests(suffix_dedup.suffix_dedup(edge(spark, rows))) == brute_spans([(i, t.encode()) for i, t, _ in rows], 50)


@pytest.mark.parametrize("per_team", [0, 2, 1 << 30])
def test_suffix_teams(spark, monkeypatch, per_team):
    """Passages in most blocks, with neighbours that differ, meet in teams first;
    with every minimizer in a team, or none, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "PER_TEAM", per_team)
    rng = random.Random(4)
    common = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rare = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(20)]
    rows = []
    for k in rng.sample(range(1000), 60):
        a = rng.randint(0, 80)
        rows.append((k, rng.choice("xyz") + common[a : a + rng.randint(45, 150)] + rng.choice("xyz") + rng.choice(rare) + common[:60], "s"))
    want = brute_spans([(i, t.encode()) for i, t, _ in rows], 50)
    assert digests(suffix_dedup.suffix_dedup(edge(spark, rows))) == want

def test_shared_minimizers():
    held = [np.arange(9, dtype=np.uint32), np.arange(5, 9, dtype=np.uint32), np.array([0, 7], np.uint32)]
    several = np.arange(9) == 4
    rows = [(h.tobytes(), np.packbits(several[: len(h)] if len(h) == 9 else np.zeros(len(h), bool)).tobytes()) for h in held]
    got = suffix_dedup.shared_of(rows, 2)
    assert [x.tolist() for x in got[0]] == [[k in (0, 4, 5, 6, 7, 8) for k in range(9)], [k == 7 for k in range(9)]]
    assert [x.tolist() for x in got[2]] == [[True, True], [False, True]]


def test_suffix_edges(spark):
    long = "0123456789" * 6
    rows = [(1, None, "a"), (2, "", "a"), (3, long, "a"), (3, long, "a"), (4, "x" + long, "a"), (None, long, "a"), (5, "y" * 49, "a"), (6, "y" * 49, "a")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(edge(spark, rows)).collect()), key=str)
    want = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 60, 0, 0), (3, 60, 0, 0), (4, 61, 60, 1), (None, 60, 0, 0), (5, 49, 0, 0), (6, 49, 0, 0)]
    assert got == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(edge(spark, [])).count() == 0


@pytest.mark.parametrize("length", [3, 8, 12])
def test_least_ids(length):
    rng = random.Random(length)
    for _ in range(150):
        ps = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 9))) for _ in range(rng.randint(1, 8))})
        ids = np.array([rng.randint(0, 99) for _ in ps])
        got, _ = suffix_dedup.least_ids(ps, ids, length)
        assert got.tolist() == [min(int(ids[q]) for q, t in enumerate(ps) if p[o : o + length] in t) for p in ps for o in range(len(p) - length + 1)]


def long_texts(n):
    """A text of n words, one that shares half of it, and one of a single word."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    half = words[: n // 2] + [f"x{rng.randrange(10**6)}" for _ in range(n // 2)]
    near = [w if k % 200 else "other" for k, w in enumerate(words)]
    return [(1, " ".join(words)), (2, " ".join(half)), (3, "z" * (6 * n)), (4, " ".join(near)), (5, "z" * (6 * n) + "!")]


def test_suffixes_of_very_long_texts(spark):
    rows = long_texts(40_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("i", "kept", "source")})
    assert digests(suffix_dedup.suffix_dedup(df)) == brute_spans([(i, t.encode()) for i, t in rows], 50)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_near_very_long_texts(spark):
    rows = long_texts(60_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "kept", "component_id")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=5, percent=80).collect()}
    assert got == brute_near(rows, 5, 80) and got[4][1] == 1 and got[2][1] == 2
    assert near_dup.near_duplicates(df.limit(0), words=5, percent=80).count() == 0
