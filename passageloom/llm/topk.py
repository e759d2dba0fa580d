"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's dimensions are cut into SLICES; a slice's partial inner products are
one local score list of a query. Vectors are dealt into blocks of vectors that
lie near one of a few pivots, PIVOTS rows at most that are taken by a hash; every
row is in a block. Queries are dealt into groups.

1. Each block gathers, for each query that stands in it, the entries at the top
   of each local list and resolves them: the k-th best score is a cutoff that no
   entry of the result is below. The block also tells the centre and the radius
   of each of its slices.
2. The cutoffs go to all blocks. By centre and radius, a block can rule out that
   any entry reaches a query's cutoff; only blocks that can't get the query. What is
   written of that is a bit for each query and block, a row for a block and a group
   of queries. Vectors travel once for each group and SUPER blocks that meet, as
   integers of 16 or 32 bits where they fit. There, a list whose bound is under an m-th of the cutoff, for m lists, isn't computed;
   the entries that reach an m-th in some list are sufficient.
3. Of these, entries whose known partial scores leave the cutoff in reach are
   resolved exactly, and a block's k best for each query are ranked with those of
   the other blocks.

Components are floor(1024 * x) as integers. Bounds are taken in double precision
with room for its errors; scores are exact, in Python integers where sums may
reach 2 ** 53. Components and scores beyond the range of long are held at its
end, where scores then tie.

Rows: vectors that are null, or hold a null or non-finite component, take no
part, as do rows without an id. Only vectors of the query's length are compared
with it; a query whose block holds fewer than k others has no cutoff and meets
all of them. Of repeated ids every row counts; a row of the query's own id
doesn't. Vectors may be of any length. An empty table gives an empty one. Other
columns, of whatever names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release

SCALE, K, SLICES = 1024, 10, 4
#: Rows of a block of vectors and of a group of queries, about; pivots at most.
BLOCK, GROUP, PIVOTS = 2048, 4096, 256
#: Queries worked at a time, pairs resolved at a time, blocks whose bounds are one task's.
TILE, PAIRS, STATS = 128, 1 << 15, 1024
#: Blocks that a group of queries meets at a time.
SUPER = 16
LEAST, MOST = -(2**63), 2**63 - 1
#: Room for rounding in bounds, as a share of the lengths that are multiplied.
SLACK = 1e-9
GATHERED = "ib int, dims int, qg int, key long, id long, cutoff long, stats array<double>, ids binary, x binary"
MEMBERS = "ib int, dims int, qg int, members binary"
FOUND = "query_id long, vec_id long, score long"


def matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table (v), one a row."""
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold all of them; the first tells how many."""
    for size, kind in ((2, np.int16), (4, np.int32)):
        if np.abs(x).max(initial=0) <= np.iinfo(kind).max:
            return bytes([size]) + x.astype(kind).tobytes()
    return bytes([8]) + x.astype(np.float64).tobytes()


def unpacked(raw: bytes, n: int, dims: int) -> np.ndarray:
    """n vectors of packed, one a row, as doubles."""
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.float64}[raw[0]], offset=1).astype(np.float64).reshape(n, dims)


def unpacked_rows(table: pa.Table, name: str) -> np.ndarray:
    """The vectors of packed rows."""
    dims = table.column("dims")[0].as_py()
    return np.concatenate([unpacked(v.as_py(), 1, dims) for v in table.column(name)])


def ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def need_of(cutoff: np.ndarray) -> np.ndarray:
    """Cutoffs as doubles that don't exceed them; none where every score will do."""
    return np.where(cutoff == LEAST, -math.inf, np.nextafter(cutoff.astype(np.float64), -math.inf))


class Block:
    """Vectors with the bounds of their slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: int = SLICES):
        self.ids, self.x = ids, vectors
        dims = vectors.shape[1]
        self.cuts = np.array_split(np.arange(dims), max(1, min(slices, dims)))
        self.most = float(np.abs(vectors).max(initial=0))
        self.length = float(np.sqrt((vectors**2).sum(1)).max(initial=0))
        self.centre = vectors.mean(0) if len(vectors) else np.zeros(dims)
        apart = vectors - self.centre
        self.radius = np.array([np.sqrt((apart[:, c] ** 2).sum(1)).max(initial=0) for c in self.cuts])


def bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray, length: float, slices: int) -> np.ndarray:
    """For each query and slice, what no partial score of the block exceeds; the
    room for rounding is in it."""
    cuts = np.array_split(np.arange(queries.shape[1]), len(radius) if slices is None else max(1, min(slices, queries.shape[1])))
    norm = np.sqrt((queries**2).sum(1))
    return np.stack([queries[:, c] @ centre[c] + np.sqrt((queries[:, c] ** 2).sum(1)) * r + SLACK * norm * length for c, r in zip(cuts, radius)], 1)


def resolved(queries: np.ndarray, block: Block, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, held in the range of long."""
    exact = float(np.abs(queries).max(initial=0)) * block.most * max(1, queries.shape[1]) < 2.0**53
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), PAIRS):
        a, b = queries[row[at : at + PAIRS]], block.x[col[at : at + PAIRS]]
        if exact:
            out[at : at + PAIRS] = np.einsum("ij,ij->i", a, b).astype(np.int64)
        else:
            whole = [sum(int(p) * int(q) for p, q in zip(x, y)) for x, y in zip(a, b)]
            out[at : at + PAIRS] = [min(max(s, LEAST), MOST) for s in whole]
    return out


def best_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best entries, ties to the smaller id."""
    order = np.lexsort((ids, ~score, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < k]


def local_cutoffs(asks: np.ndarray, block: Block, k: int) -> np.ndarray:
    """Phase 1 for the rows of a block that ask: the k-th best score of the tops
    of the local lists, LEAST where there are fewer entries."""
    out = np.full(len(asks), LEAST, np.int64)
    own = min(len(block.ids), k + int(np.unique(block.ids, return_counts=True)[1].max(initial=1)))
    for at in range(0, len(asks), TILE):
        mine = asks[at : at + TILE]
        tops = []
        for c in block.cuts:
            p = block.x[mine][:, c] @ block.x[:, c].T
            tops.append(np.argpartition(-p, own - 1, axis=1)[:, :own])
        found = np.concatenate(tops, 1)
        found.sort(axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        row, place = np.nonzero(fresh & (block.ids[found] != block.ids[mine][:, None]))
        col = found[row, place]
        score = resolved(block.x[mine], block, row, col)
        order = np.lexsort((~score, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        out[at + row[order][nth == k - 1]] = score[order][nth == k - 1]
    return out


def scan(ids: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, block: Block, k: int) -> tuple[pa.Table, int]:
    """Phases 2 and 3 of queries at a block: each query's k best entries that
    reach its cutoff, and how many partial products were computed."""
    parts, work = [], 0
    every = bounds(queries, block.centre, block.radius, block.length, len(block.cuts))
    need = need_of(cutoff)
    todo = np.flatnonzero(every.sum(1) >= need)
    for at in range(0, len(todo), TILE):
        mine = todo[at : at + TILE]
        q, bar, most = queries[mine], need[mine], every[mine]
        share = bar / len(block.cuts)
        enough, reach = np.zeros((len(mine), len(block.ids)), bool), np.zeros((len(mine), len(block.ids)))
        for j, c in enumerate(block.cuts):
            rows = np.flatnonzero(most[:, j] >= share)  # the lists that can hold a sufficient entry
            reach += np.where(np.isin(np.arange(len(mine)), rows), 0.0, share)[:, None]
            if len(rows):
                p = q[rows][:, c] @ block.x[:, c].T + (SLACK * block.length * np.sqrt((q[rows] ** 2).sum(1)))[:, None]
                work += p.size
                known = p >= share[rows][:, None]
                enough[rows] |= known
                reach[rows] += np.where(known, p, share[rows][:, None])
        row, col = np.nonzero(enough & (reach >= bar[:, None]) & (ids[mine][:, None] != block.ids[None, :]))
        score = resolved(q, block, row, col)
        good = np.flatnonzero(score >= cutoff[mine][row])
        good = good[best_of(row[good], score[good], block.ids[col[good]], k)]
        parts.append((ids[mine][row[good]], block.ids[col[good]], score[good]))
    joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    return pa.table(joined, names=["query_id", "vec_id", "score"]), work


def placed(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, block: int) -> DataFrame:
    """id, v, dims, asks, salt and cell, the nearest pivot of a sound vector."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    rows = vectors.where(sound).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("v"),
        F.size(x).alias("dims"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        F.monotonically_increasing_id().alias("key"),
    )
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, math.ceil(n / block)))).select("v").collect()
    pivots: dict[int, list] = {}
    for v in dict.fromkeys(tuple(r.v) for r in some):
        pivots.setdefault(len(v), []).append(v)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: np.array(p) for d, p in pivots.items() if d}
        first = dict(zip(pivots, np.cumsum([0, *[len(p) for p in pivots.values()]]).tolist()))
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in known:
                    p, v = known[d], matrix(pa.table([batch.column(1).take(pa.array(at))], names=["v"]))
                    near = ((p**2).sum(1)[None, :] - 2 * (v @ p.T)).argmin(1)
                    cell[at] = first[d] + near
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])
        release()

    return materialise(rows.mapInArrow(assign, "id long, v array<double>, dims int, asks boolean, salt long, key long, cell int"))


def dealt(rows: DataFrame, block: int, group: int) -> tuple[DataFrame, int, int]:
    """rows with ib, their block, and qg, their group as a query; and how many
    there are of each. There are PIVOTS cells at most."""
    sizes = {r.cell: (r.n, r.q) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    parts, before, starts, asked = [], [], [], []
    for cell in range(max(sizes, default=0) + 1):
        n, q = sizes.get(cell, (0, 0))
        before.append(sum(parts))
        parts.append(max(1, math.ceil(n / block)))
        starts.append(sum(asked))
        asked.append(q)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    unit = F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ib = of(before) + F.pmod(F.col("salt"), of(parts)).cast("int")
    qg = F.floor((of(starts) + unit * of(asked)) / group).cast("int")
    return rows.withColumns({"ib": ib.cast("int"), "qg": qg}), sum(parts), max(1, math.ceil(sum(asked) / group))


def sufficient(rows: DataFrame, blocks: int, groups: int, k: int, slices: int) -> tuple[DataFrame, DataFrame]:
    """Phase 1, and the cutoffs' way to the blocks: the queries with their cutoffs and
    the blocks, packed (GATHERED, where qg is -1 for a block); and a row for each block
    and group with members, a bit for each of the group's queries by key, set where the
    block may hold an entry that reaches its cutoff (MEMBERS)."""

    def gather(table: pa.Table) -> pa.Table:
        ids, x = ints(table, "id"), matrix(table)
        block, asks = Block(ids, x, slices), np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        cut = local_cutoffs(asks, block, k)
        n, ib, dims = len(asks), table.column("ib")[0].as_py(), table.column("dims")[0].as_py()
        stats = block.centre.tolist() + block.radius.tolist() + [block.length]
        return pa.table({
            "ib": pa.array([ib] * (n + 1), pa.int32()), "dims": pa.array([dims] * (n + 1), pa.int32()), "qg": pa.array(np.append(ints(table, "qg")[asks], -1), pa.int32()),
            "key": np.append(ints(table, "key")[asks], 0), "id": np.append(ids[asks], 0), "cutoff": np.append(cut, LEAST), "stats": pa.array([None] * n + [stats], pa.list_(pa.float64())),
            "ids": pa.array([None] * n + [ids.tobytes()], pa.binary()), "x": pa.array([packed(v) for v in x[asks]] + [packed(x)], pa.binary()),
        })

    gathered = materialise(rows.groupBy("ib", "dims").applyInArrow(gather, GATHERED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = gathered.where("qg < 0").select("ib", "dims", "stats", F.floor(F.col("ib") / STATS).cast("int").alias("sg")).select("*", every(groups).alias("qg"))
    asked = gathered.where("qg >= 0").select("key", "dims", "cutoff", "x", "qg").select("*", every(math.ceil(blocks / STATS)).alias("sg"))

    def send(asked: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and told.num_rows:
            asked = asked.sort_by("key")
            q, need, dims, group = unpacked_rows(asked, "x"), need_of(ints(asked, "cutoff")), asked.column("dims")[0].as_py(), asked.column("qg")[0].as_py()
            for ib, v in zip(told.column("ib").to_pylist(), told.column("stats").to_pylist()):
                v = np.array(v)
                may = bounds(q, v[:dims], v[dims:-1], v[-1], len(v) - dims - 1).sum(1) >= need
                if may.any():
                    out.append((ib, dims, group, np.packbits(may).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["ib", "dims", "qg", "members"])

    unit = ["qg", "sg", "dims"]
    return gathered, materialise(asked.groupBy(*unit).cogroup(told.groupBy(*unit)).applyInArrow(send, MEMBERS))


def topk(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    slices: int = SLICES,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best, all if
    fewer; ties go to the smaller vec_id."""
    rows, blocks, groups = dealt(placed(vectors, is_query, id_col, vec_col, block), block, group)
    gathered, sent = sufficient(rows, blocks, groups, k, slices)
    sent = sent.withColumn("sb", F.floor(F.col("ib") / SUPER).cast("int"))
    own = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  both sides come of one table
    units = own(sent, "sb", "qg", "dims").distinct()
    asked = own(gathered.where("qg >= 0"), "qg", "dims", "key", "id", "cutoff", "x").join(units.hint("merge"), ["qg", "dims"])
    held = sent.join(own(gathered.where("qg < 0"), "ib", "dims", "ids", "x").hint("merge"), ["ib", "dims"])

    def resolve(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = []
        if asked.num_rows and held.num_rows:
            asked = asked.sort_by("key")
            dims, n = asked.column("dims")[0].as_py(), asked.num_rows
            ids, cutoff, q = ints(asked, "id"), ints(asked, "cutoff"), unpacked_rows(asked, "x")
            for members, own, x in zip(*(held.column(c) for c in ("members", "ids", "x"))):
                mine = np.flatnonzero(np.unpackbits(np.frombuffer(members.as_py(), np.uint8), count=n))
                known = np.frombuffer(own.as_py(), np.int64)
                block = Block(known, unpacked(x.as_py(), len(known), dims), slices)
                parts.append(scan(ids[mine], q[mine], cutoff[mine], block, k)[0])
        if not parts:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        found = pa.concat_tables(parts)
        best = best_of(*(ints(found, c) for c in ("query_id", "score", "vec_id")), k=k)
        return found.take(pa.array(best))

    unit = ["sb", "qg", "dims"]
    entries = asked.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(resolve, FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
