"""Near-duplicate documents by an inverted join of MinHash signatures.

A document is the set of its word shingles, as 64-bit hashes. Documents with
equal sets are one class from the start. A class is posted under the pairs of
coordinate and value of its signature. Two sets as alike as asked for agree in
at least `matches` coordinates but for about one pair in a million, so they
share one of the size - matches + 1 rarest pairs of each: only these prefixes
are posted, which keeps values that many documents share out of the join.

All documents that share a posted pair with its smallest document form a group
around that pivot. Groups are dealt into blocks of BLOCK documents, and a block
is worked through in one task: the posted pairs of the block are merged, rarest
first; only documents met in a short list are looked up in the long ones, pairs
below the match threshold are skipped, so are pairs that are connected already,
the others are confirmed on their full sets, and only links that connect something
new are returned. So no pairs are listed, and no block grows with its group.

A group of several blocks has its pivot in each, and each document's distance from
it is measured. Documents outside the group's largest component are then asked, in
blocks, of the group's documents whose distance differs by no more than a link
may: as the Jaccard distance is a metric, no other can be alike. What is far from
the bulk of a group thus never meets it.

Rows: a null or empty text, or one of white space, has no shingles and is linked
with nothing. Rows without an id aren't linked; their component is null and they
are kept. Rows that share an id count as one document where they are linked. Texts of any
length are taken whole. An empty table gives an empty one. Other columns, of whatever
names, are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise, release, text_of

#: Coordinates of a signature, documents of a block, words remembered by a worker.
SIZE, BLOCK, MEMO = 48, 256, 400_000
#: A link, or with d the distance of a from b, the pivot of its group.
LINKS = "a long, b long, d double"


def matches_of(percent: int, size: int = SIZE) -> int:
    """Coordinates that agree at least, 4.7 deviations below the mean."""
    p = percent / 100
    return max(1, math.floor(size * p - 4.7 * math.sqrt(size * p * (1 - p))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


class Shingles:
    """Hashes of the distinct shingles of a text, sorted."""

    split = re.compile(WORD)
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})

    def __init__(self, words: int):
        self.words, self.weights, self.memo = words, odd_numbers(words, 3), {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        found = self.split.findall(text.lower() if text.isascii() else text.translate(self.lower))
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        n = len(h) - self.words + 1
        if n < 1:
            return mixed(mixed((h * self.weights[: len(h)]).sum(keepdims=True, dtype=np.uint64)) + np.uint64(len(h)))
        s = h[:n] * self.weights[0]
        for k in range(1, self.words):
            s = s + h[k : n + k] * self.weights[k]
        return np.unique(mixed(s))


def signature(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    factors = odd_numbers(size, 11)
    return ((hashes[None, :] * factors[:, None]) >> np.uint64(33)).min(axis=1).astype(np.int32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """i, t -> i, n (shingles), d1 and d2 (digest of the set), sig."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            n, d, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                d.append((s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + np.uint64(1))) if len(s) else np.uint64(0)))
                sig.append(signature(s) if len(s) else np.zeros(SIZE, np.int32))
            d = np.array(d, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * SIZE, pa.array(np.concatenate(sig or [np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], names=["i", "n", "d1", "d2", "sig"])
        shingles = None
        release()

    return docs.mapInArrow(sketch, "i long, n long, d1 long, d2 long, sig array<int>")


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """token, rep: the rarest tokens of each signature that others share."""
    tokens = reps.select("rep", F.posexplode("sig")).select("rep", (F.col("pos").cast("long") * (1 << 32) + F.col("col")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # tokens that nobody shares are the rarest: they fill the prefix first
    prefix = (
        tokens.join(shared, "token")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
        .withColumn("left", F.size("found") + (SIZE - matches + 1) - SIZE)
        .where("left > 0")
    )
    return prefix.select("rep", F.explode(F.slice("found", F.lit(1), F.col("left"))).alias("f")).select("f.token", "rep")


def with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, sig and set, the signature and shingles of the document's whole text,
    of each id in wanted (rep)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                sig = [signature(s) if len(s) else np.zeros(SIZE, np.int32) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)))
                sigs = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SIZE, pa.array(np.concatenate(sig)))
                yield pa.RecordBatch.from_arrays([part.column(0), sigs, lists], names=["rep", "sig", "set"])

    # by sort-merge at every size, so that the plan a small input shows is the one a large input runs
    texts = docs.join(wanted.hint("merge"), docs["i"] == wanted["rep"]).select("rep", "t")
    return texts.mapInArrow(fill, "rep long, sig array<int>, set array<long>")


class Merged:
    """The shingles of a block's sets as lists of the sets that hold each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.value, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def common(self, one: np.ndarray) -> np.ndarray:
        """How many shingles each set shares with one."""
        at = np.minimum(np.searchsorted(self.value, one), len(self.value) - 1)
        at = at[self.value[at] == one]
        n = self.end[at] - self.start[at]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        return np.bincount(self.owner[place], minlength=len(self.sizes))


#: Pairs of one document from which on their full sets are merged at once.
MERGED = 6


class Linker:
    """Links within a block that connect what isn't connected yet."""

    def __init__(self, percent: int, matches: int, block: int):
        self.percent, self.matches, self.block = percent, matches, block
        #: Distances of documents that are alike differ by less than this.
        self.width = 1 - percent / 100 + 1e-6

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        return len(np.intersect1d(a, b, assume_unique=True))

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = min(len(a), len(b)), max(len(a), len(b))
        if 100 * small < self.percent * large:
            return False
        common = self.common(a, b)
        return 100 * common >= self.percent * (len(a) + len(b) - common)

    def between(self, left: pd.DataFrame, right: pd.DataFrame | None = None) -> pd.DataFrame:
        """Links from rows of left to rows of right, or among those of left. A
        column label, if any, tells what is connected from the start."""
        rows = left if right is None else pd.concat([left, right])
        n, first = len(left), 0 if right is None else len(left)
        ids, sets = rows["rep"].to_numpy(), rows["set"].tolist()
        sig = np.array(rows["sig"].tolist(), np.int32).reshape(len(rows), SIZE)
        comp = np.unique(rows["label" if "label" in rows else "rep"].to_numpy(), return_inverse=True)[1]
        # coordinate-value pairs, each row's rarest first; those of one row only join nothing
        token, held = np.unique(sig.astype(np.int64) + (np.arange(SIZE, dtype=np.int64) << 32), return_inverse=True)
        held = held.reshape(sig.shape)
        count = np.bincount(held.ravel(), minlength=len(token))
        prefix = np.sort(count[held] * len(token) + held, axis=1)[:, : SIZE - self.matches + 1] % max(1, len(token))
        posted = prefix[first:].ravel()
        order = np.argsort(posted, kind="stable")
        member, start = order // prefix.shape[1] + first, np.searchsorted(posted[order], np.arange(len(token) + 1))
        out, merged = [], None
        for k in range(n):
            lists = [member[start[t] : start[t + 1]] for t in prefix[k] if count[t] > 1]
            found = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
            found = found[(found > k) & (comp[found] != comp[k])]
            agree = (sig[found] == sig[k]).sum(axis=1)
            found = found[np.argsort(-agree, kind="stable")][: int((agree >= self.matches).sum())]
            # the likeliest first, so that few pairs are left to confirm; many are confirmed at once
            for place, j in enumerate(found.tolist()):
                if place == MERGED and (rest := found[place:][comp[found[place:]] != comp[k]]).size > MERGED:
                    merged = merged or Merged(sets[first:])
                    both = merged.common(sets[k])[rest - first]
                    good = 100 * both >= self.percent * (len(sets[k]) + merged.sizes[rest - first] - both)
                    for j in rest[good].tolist():
                        if comp[j] != comp[k]:
                            comp[comp == comp[j]] = comp[k]
                            out.append((int(ids[k]), int(ids[j]), None))
                    break
                if comp[j] != comp[k] and self.alike(sets[k], sets[j]):
                    comp[comp == comp[j]] = comp[k]
                    out.append((int(ids[k]), int(ids[j]), None))
        return pd.DataFrame(out, columns=["a", "b", "d"]).astype({"a": np.int64, "b": np.int64, "d": np.float64})

    def within(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of a block; in groups of several, its documents' distances from
        the pivot too."""
        rows = rows.drop_duplicates("rep")
        made = self.between(rows)
        if rows["size"].iloc[0] <= self.block:
            return made
        pivot = rows["pivot"].iloc[0]
        (base,) = rows.loc[rows["rep"] == pivot, "set"]
        shared = [self.common(base, x) for x in rows["set"]]
        far = [1 - c / (len(base) + len(x) - c) for c, x in zip(shared, rows["set"])]
        return pd.concat([made, pd.DataFrame({"a": rows["rep"], "b": pivot, "d": far})])


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node is connected with.

    Each round sends a node to its smallest neighbour, follows that once more,
    and contracts the graph to what is left; the rounds are few, as stars and
    chains shrink at least by half."""
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).withColumn("up", F.least("up", "node"))
        up = materialise(up)
        two = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = materialise(up.join(two, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        if label is None:
            label = up.withColumnRenamed("up", "label")
        else:
            moved = up.select(F.col("node").alias("label"), "up")
            label = label.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        label = materialise(label)
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = materialise(edges.distinct())
    return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0) if label is None else label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable over links of
    percent / 100 similarity or more) and kept (it is the smallest) per row."""
    matches = matches_of(percent)
    linker = Linker(percent, matches, BLOCK)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), text_of(F.col(text_col)).alias("t"))
    rows = materialise(sketches(texts, words))
    reps = rows.where("n > 0 AND i IS NOT NULL").groupBy("n", "d1", "d2", "sig").agg(F.min("i").alias("rep"))
    reps = materialise(reps)
    posted = materialise(postings(reps.select("rep", "sig"), matches))
    pivots = posted.groupBy("token").agg(F.min("rep").alias("pivot"))
    members = posted.join(pivots, "token").select("pivot", "rep").distinct()
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(
        members.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    )

    # texts are read once more, for members of groups only
    sets = materialise(with_sets(texts, members.select("rep").distinct(), words))

    def dealt(rows: DataFrame, *fields: str) -> DataFrame:
        """rep, sig and set of each row, with the fields."""
        return sets.join(rows.select("rep", *fields).hint("merge"), "rep")

    blocks = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(size / BLOCK).cast("int") - 1))
    everywhere = (F.col("rep") == F.col("pivot")) & (F.col("size") > BLOCK)
    spread = members.where(~everywhere).select("rep", "pivot", "size", "block").unionByName(members.where(everywhere).select("rep", "pivot", "size", blocks(F.col("size")).alias("block")))
    found = materialise(dealt(spread, "pivot", "size", "block").groupBy("pivot", "block").applyInPandas(lambda d: linker.within(d), LINKS))
    links = found.where("d IS NULL").select("a", "b")
    label = components(links)

    large = members.where(F.col("size") > BLOCK)
    if large.limit(1).count():
        ring = F.floor(F.col("d") / linker.width).cast("int")
        rings = found.where("d IS NOT NULL").select(F.col("a").alias("rep"), F.col("b").alias("pivot"), ring.alias("ring")).distinct()
        known = large.join(rings, ["pivot", "rep"]).join(label.withColumnRenamed("node", "rep"), "rep", "left")
        known = materialise(known.select("rep", "pivot", "size", "block", "ring", F.coalesce("label", "rep").alias("label")))
        shares = known.groupBy("pivot", "label").agg(F.count("*").alias("share"), F.max("size").alias("size"))
        most = shares.groupBy("pivot").agg(F.max(F.struct("share", -F.col("label"))).alias("most"), F.count("*").alias("labels"), F.max("size").alias("size"))
        parts = F.ceil((F.col("size") - F.col("most.share")) / BLOCK).cast("int")
        most = most.where("labels > 1").select(F.col("pivot").alias("p"), (-F.col("most.col2")).alias("main"), parts.alias("parts"), blocks(F.col("size")).alias("b"))
        # by block as well, so that no task gets a group whole
        known = materialise(known.join(most, (F.col("pivot") == F.col("p")) & (F.col("block") == F.col("b"))).drop("p", "b"))
        ask = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
        apart = known.where("label <> main").select("rep", "pivot", "size", "label", ask.alias("ask"), F.explode(F.sequence(F.col("ring") - 1, F.col("ring") + 1)).alias("ring"))
        asks = apart.select("*", blocks(F.col("size")).alias("block"))
        heard = apart.groupBy("pivot", "ring", "size").agg(F.collect_set("ask").alias("parts")).select("*", blocks(F.col("size")).alias("block"))
        told = known.select("rep", "pivot", "block", "ring", "label").join(heard.drop("size"), ["pivot", "ring", "block"])
        told = told.select("rep", "pivot", "block", "ring", "label", F.explode("parts").alias("ask"))
        fields = ["pivot", "ring", "block", "ask", "label", "asks"]
        both = asks.withColumn("asks", F.lit(True)).select("rep", *fields).unionByName(told.withColumn("asks", F.lit(False)).select("rep", *fields))

        def across(d: pd.DataFrame) -> pd.DataFrame:
            return linker.between(d[d["asks"]], d[~d["asks"]])

        more = dealt(both, *fields).groupBy("pivot", "ring", "block", "ask").applyInPandas(lambda d: across(d), LINKS)
        label = components(links.union(more.select("a", "b")))

    label = label.select(F.col("node").alias("rep"), "label")
    classes = reps.select("n", "d1", "d2", "rep").join(label, "rep", "left").select("n", "d1", "d2", F.coalesce("label", "rep").alias("label"))
    found = rows.select("i", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    component = F.when(F.col("i").isNull(), None).otherwise(F.coalesce("label", "i"))
    return found.select(
        F.col("i").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("i").isNull() | (F.col("i") == component)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns."""
    own = free_name(docs, "kept_id")
    keep = near_duplicates(docs, id_col, text_col, words, percent).where("kept").select(F.col(id_col).alias(own))
    return docs.join(keep.distinct().hint("merge"), docs[id_col].cast("long").eqNullSafe(F.col(own)), "left_semi")
