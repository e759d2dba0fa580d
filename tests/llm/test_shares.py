"""Chunks that meet again after a shift, hot groups, and distances to targets."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from passageloom.llm import exact_dedup, mixing, queries
from passageloom.llm.common import lower_ascii


def test_chunks_meet_again(spark):
    """The 20 longest texts share most chunks with themselves behind 20 to 200 words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    front = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20) + F.col("doc_id") % 180), lambda k: F.concat(F.lit("word"), k.cast("string"))), " ")
    cut = lambda t: exact_dedup.chunks(lower_ascii(t))
    got = docs.select(cut(F.col("text")).alias("a"), cut(F.concat(front, F.lit(" "), F.col("text"))).alias("b")).collect()
    for r in got:
        assert "".join(r.b).endswith("".join(r.a)) and len(r.a) > 10
        assert sum(c in set(r.b) for c in r.a) > 0.8 * len(r.a)


@pytest.mark.parametrize("hot_rows", [1, 10, 10**6])
def test_hot_groups(spark, monkeypatch, hot_rows):
    """Groups joined by broadcast and by sort-merge give one result."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    rows = [(k, "Same text" if k % 3 == 0 else None if k % 3 == 1 else f"text {k % 40}") for k in range(300)]
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[(t or "").lower()].append(k)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {k: (t or "").lower() for k, t in rows}
    assert len(got) == 300 and all((r.keep_id, r.group_size) == (max(groups[texts[r.doc_id]]), len(groups[texts[r.doc_id]])) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    """Within 1 %, or half a document of the longest ones' size."""
    sf = f"/root/testdata/{sf}"
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, sizes = collections.Counter(), {}, collections.defaultdict(list)
    for r in queries.op4_mixing(spark, sf).collect():
        s = source[r.doc_id]
        taken[s], target[s] = taken[s] + r.taken, r.target
        sizes[s].append(r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(0.01 * target[s], max(sizes[s]) / 2), (s, n, target[s])


def test_small_sources_are_sampled_too(spark):
    """One to forty documents a source: words that no other offset would bring nearer
    by more than the steps between the offsets."""
    rng = random.Random(8)
    rows = [(s * 100 + k, "w " * rng.choice([1, 5, 40, rng.randint(1, 300)]), f"s{s:02d}") for s in range(12) for k in range(1 + 3 * s)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of = collections.defaultdict(list)
    for r in plan:
        of[r.doc_id // 100].append(r)
    for s, mine in of.items():
        mine.sort(key=lambda r: (r.size, r.copies))
        words = sum(r.size for r in mine)
        each = mine[0].target / words
        assert all(r.copies in (math.floor(each), math.ceil(each)) for r in mine)
        done = sum(r.taken for r in mine)
        assert abs(done - mine[0].target) <= max(r.size for r in mine) / 2 + 0.02 * words


def test_many_sources_in_ranges(spark):
    """Places and sums of sources that lie in several ranges."""
    df = spark.createDataFrame([(f"s{k:04d}" if k else None, k % 7) for k in range(500)], "source string, size long").repartition(5)
    got = {r.source: (r.place, r.cut) for r in mixing.summed_up(df, [F.col("source").asc_nulls_last()], place=F.lit(1), cut=F.col("size")).collect()}
    order, cut = [f"s{k:04d}" for k in range(1, 500)] + [None], 0
    for place, s in enumerate(order):
        assert got[s] == (place, cut)
        cut += int(s[1:]) % 7 if s else 0


def test_mix_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", "s"), (None, None, None), (2, "d " * 50, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("mix_id", "MIX_COPIES", "size")})
    got = mixing.mix(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}
    assert mixing.mix(df.limit(0)).count() == 0
