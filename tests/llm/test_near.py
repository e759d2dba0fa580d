"""Merged postings against all pairs, and hot groups."""

import random

import numpy as np
import pandas as pd
import pytest

from passageloom.llm import near_dup
from tests.llm.test_dedup import brute_near, edge


def drifting(rng, n, words=150, edits=14, apart=0):
    base, rows = [f"w{k}" for k in range(words)], []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits) if i >= apart else words // 3):
            ws[rng.randrange(words)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(ws)))
    return rows


def roots(pairs):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return find


@pytest.mark.parametrize("cut", [None, 40])
def test_merging_equals_all_pairs(cut):
    rng = random.Random(3)
    shingles = near_dup.Shingles(3)
    rows = drifting(rng, 90) + [(100 + i, t) for i, t in drifting(random.Random(4), 40, 80)]
    sets = [shingles(t) for _, t in rows]
    frame = pd.DataFrame({"rep": [i for i, _ in rows], "sig": [near_dup.signature(s).tolist() for s in sets], "set": sets})
    linker = near_dup.Linker(85, near_dup.matches_of(85), 256)
    made = linker.between(frame) if cut is None else linker.between(frame.iloc[:cut], frame.iloc[cut:])
    sig = np.array(frame["sig"].tolist())
    pairs = range(len(rows))
    want = [(rows[a][0], rows[b][0]) for a in pairs for b in pairs if a < b and (cut is None or a < cut <= b) and (sig[a] == sig[b]).sum() >= linker.matches and linker.alike(sets[a], sets[b])]
    got, full = roots(zip(made["a"], made["b"])), roots(want)
    assert [got(i) for i, _ in rows] == [full(i) for i, _ in rows] and len(want) > len(made) > 10


def test_hot_group_in_rings(spark, monkeypatch):
    """Groups of many blocks with documents near the threshold and far from the bulk."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = [(i, t, "s") for i, t in drifting(random.Random(7), 160, 150, 10, apart=30)]
    want = brute_near([r[:2] for r in rows], 3, 85)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(edge(spark, rows), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in want.items()} and 1 < len(set(got.values())) < 160
