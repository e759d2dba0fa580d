"""Top-k search: what the cutoff rules out, and scores beyond 2 ** 53."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageloom.llm import topk as T
from tests.llm.test_operators import brute_topk


def test_cutoff_beyond_doubles(spark):
    """The cutoff, 2 ** 53 + 3, is no double; the row that sets it stays."""
    rows = [(0, [1 / 1024, 1 / 1024])] + [(k, [2.0**43, (k - 3) / 1024]) for k in range(1, 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.topk(df, F.col("vec_id") == 0).collect()))
    assert got == brute_topk(rows, lambda i: i == 0, 10) and len(got) == 10 and got[-1][3] == 2**53 + 3


def clusters(n, dims=16, centres=8, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((centres, dims)) * 3
    return np.floor(1024 * (at[np.arange(n) % centres] + 0.05 * rng.standard_normal((n, dims))))


def test_cutoff_saves_products():
    """Lists and blocks that can't reach the cutoff aren't multiplied; the result is exact."""
    x = clusters(800)
    ids, own = np.arange(800), np.arange(800) % 8
    asks = np.arange(0, 800, 10)
    cut = np.concatenate([T.local_cutoffs(np.searchsorted(ids[own == c], asks[own[asks] == c]), T.Block(ids[own == c], x[own == c]), 10) for c in range(8)])
    order = np.concatenate([asks[own[asks] == c] for c in range(8)])
    found, work = [], 0
    for c in range(8):
        table, w = T.scan(order, x[order], cut, T.Block(ids[own == c], x[own == c]), 10)
        found, work = found + table.to_pylist(), work + w
    assert work < 0.5 * len(asks) * 800 * T.SLICES
    for q in order.tolist():
        s = (x @ x[q]).astype(int)
        want = sorted((-s[k], k) for k in range(800) if k != q)[:10]
        assert sorted((-r["score"], r["vec_id"]) for r in found if r["query_id"] == q)[:10] == want


def test_blocks_that_get_no_query(spark):
    x = clusters(900)
    df = spark.createDataFrame([(k, (v / 1024).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows, blocks, groups = T.dealt(T.placed(df, F.col("vec_id") % 10 == 0, "vec_id", "embedding", 60), 60, 40)
    _, sent = T.sufficient(rows, blocks, groups, 10, T.SLICES)
    assert blocks > 10 and groups > 1 and sum(int.from_bytes(r.members).bit_count() for r in sent.collect()) < 0.6 * 90 * blocks
    got = sorted(map(tuple, T.topk(df, F.col("vec_id") % 10 == 0, block=60, group=40).collect()))
    assert got == brute_topk([(k, (v / 1024).tolist()) for k, v in enumerate(x)], lambda i: i % 10 == 0, 10)


@pytest.mark.parametrize("block", [8, 64])
def test_common_vector_and_repeated_ids(spark, block):
    """A third of the rows are one vector; some ids come twice."""
    rng = random.Random(1)
    rows = [(k, [1.0, 0.5, 0.25] if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for k in range(150)]
    rows += [(7, [2.0, 2.0, 2.0]), (7, [2.0, 2.0, 2.0]), (9, None), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.topk(df, F.col("vec_id") % 20 == 0, block=block, group=3).collect()))
    assert got == brute_topk(rows, lambda i: i % 20 == 0, 10)


def written(spark, n, tmp_path, monkeypatch):
    """Bytes of the tables that a search over n spread vectors writes."""
    rng, sizes = np.random.default_rng(4), []
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, 48)))], "vec_id long, embedding array<double>").repartition(4)
    keep = T.materialise

    def weighed(made):
        made = keep(made)
        sizes.append(sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in made.inputFiles()))
        return made

    monkeypatch.setattr(T, "materialise", weighed)
    assert T.topk(df, F.col("vec_id") % 20 == 0, block=50, group=25).count() == len(range(0, n, 20)) * 10
    monkeypatch.setattr(T, "materialise", keep)
    return sum(sizes), len(sizes)


def test_what_is_written_grows_with_the_vectors(spark, tmp_path, monkeypatch):
    """On spread vectors, where no block is ruled out, twice as many write about twice."""
    small, tables = written(spark, 1500, tmp_path, monkeypatch)
    large, _ = written(spark, 3000, tmp_path, monkeypatch)
    assert tables == 3 and large < 2.4 * small
