"""Toxicity of documents by a convolutional text classifier, trained by Spark in numpy.

A word's embedding joins four hashed rows: two hashes of the whole word, so that
one chance collision does not look like another word, and its first four and
first five letters. Filters of several widths slide over a document's words,
each keeps its largest value (max pooling), and a logistic layer weighs these.
The probability is calibrated on one labelled document in five that training left
out; there too, each language gets the threshold that separates best.

Training reads the whole text of every labelled document. Spark deals them to
shards, anew in each pass; a shard's task steps through its documents from the
model of the pass before, and the shards' models are averaged: a row of the
embedding table over the shards that moved it, everything else over all. Sums are of
integers, so that reruns agree. What a pass sends to the driver is at most the
model, whatever the number of documents. Calibration and thresholds are sums
over the documents left out. Only a caller who gives `sample` has a bounded sample
learnt from instead. Scoring covers every whole text.

Rows: a null or empty text is scored as a text without words. Labels that
contradict each other count as toxic, null labels not at all. Of rows that share
a labelled id each different text is learnt from, once. Without labels of both
classes every score is 0. Repeated rows are scored alike. An empty table gives an empty
one. A column named like a new one is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, release, temporary, text_of

#: Bytes of a document in a sample that a caller asked for, at most; the slice of a
#: longer one has a fourth as many letters. Without a sample texts are whole.
SAMPLE_BYTES = 1 << 16
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 4, 8, (1, 2, 3)
BATCH, RATE, TABLE_RATE = 64, 0.01, 0.1
#: Passes over all documents: as many as bring VISITS, within these bounds.
PASSES, VISITS = (3, 6), 24_000
#: Documents and bytes of a shard; long documents make it fewer and more.
SHARD_ROWS, SHARD_BYTES, SHARD_MOST = 4096, 1 << 23, 1 << 26
#: Letters of a text that are split at a time, and words of a batch in training.
TEXT_PART, BATCH_WORDS = 1 << 20, 1_000_000
#: Sums over shards are of integers of this unit; no part of one is above LARGEST.
UNIT, LARGEST = 2.0**-40, 2.0**7
#: Words scored at a time, and distinct words remembered, by a worker.
SLICE_WORDS, MEMO = 150_000, 150_000
LETTERS, SPACE = re.compile(r"[^\W\d_]+"), re.compile(r"\s")


def buckets(word: str) -> tuple[int, int, int, int]:
    """The rows of a word in the four parts of the embedding table."""
    raw = word.encode("utf-8", "surrogatepass")
    h, g = zlib.crc32(raw), zlib.crc32(raw, 0x5BD1E995)
    four, five = word[:4].encode("utf-8", "surrogatepass"), word[:5].encode("utf-8", "surrogatepass")
    m = BUCKETS - 1
    return h & m, BUCKETS + (g & m), 2 * BUCKETS + (zlib.crc32(four, 4) & m), 3 * BUCKETS + (zlib.crc32(five, 5) & m)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def parts_of(text: str) -> Iterator[str]:
    """The text in parts that white space ends, so that no word is cut."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + TEXT_PART)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


@dataclass
class Model:
    table: np.ndarray  # 4 * BUCKETS x WIDTH
    filters: dict[int, np.ndarray]  # span -> span x 4 * WIDTH x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # of the calibration
    thresholds: dict[str, float] = field(default_factory=dict)


def shapes() -> list[tuple[int, ...]]:
    """Of the filters by span, the bias, the weights and the offset."""
    n = FILTERS * len(SPANS)
    return [*((s, 4 * WIDTH, FILTERS) for s in SPANS), (n,), (n,), (1,)]


@dataclass
class State:
    """A model in training. dense holds all but the table in one row, its mean
    gradient and mean square in the others; met is the table's squared gradients."""

    table: np.ndarray
    met: np.ndarray
    dense: np.ndarray
    steps: float = 0.0

    def views(self, row: int = 0) -> list[np.ndarray]:
        found, at = [], 0
        for shape in shapes():
            n = int(np.prod(shape))
            found.append(self.dense[row, at : at + n].reshape(shape))
            at += n
        return found

    def model(self) -> Model:
        *filters, bias, weights, offset = self.views()
        return Model(self.table, dict(zip(SPANS, filters)), bias, weights, float(offset[0]))


def started(seed: int = 7) -> State:
    """A random start."""
    rng = np.random.default_rng(seed)
    state = State(
        (0.05 * rng.standard_normal((4 * BUCKETS, WIDTH))).astype(np.float32),
        np.zeros(4 * BUCKETS, np.float32),
        np.zeros((3, sum(int(np.prod(x)) for x in shapes())), np.float32),
    )
    *filters, _, weights, offset = state.views()
    for w in filters:
        w[:] = 0.1 * rng.standard_normal(w.shape)
    weights[:], offset[:] = 0.3, -1.0
    return state


class Scorer:
    """Scores texts by a model; remembers what the filters see in a word."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.memo, self.seen = {}, [np.zeros((0, FILTERS), np.float32) for s in SPANS for _ in range(s)]

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        pad = [""] * (max(SPANS) - 1)
        flat = [w for t in texts for part in (t or [""], pad) for w in part]
        if len(self.memo) > MEMO:
            self.forget()
        if new := sorted(set(flat).difference(self.memo)):
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            x = self.model.table[np.array([buckets(w) for w in new], np.int64)].reshape(len(new), -1)
            if new[0] == "":
                x[0] = 0
            views = [x @ w[k] for w in self.model.filters.values() for k in range(len(w))]
            self.seen = [np.concatenate(both) for both in zip(self.seen, views)]
        word = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([max(1, len(t)) for t in texts], np.int64)
        starts = np.cumsum(sizes + len(pad)) - sizes - len(pad)
        cuts, top, views = np.stack([starts, starts + sizes], 1).ravel(), [], iter(self.seen)
        for s in SPANS:
            n = len(word) - s + 1
            v = np.full((len(word) + 1, FILTERS), -np.inf, np.float32)
            v[:n] = next(views)[word[:n]]
            for k in range(1, s):
                v[:n] += next(views)[word[k : n + k]]
            top.append(np.maximum.reduceat(v, cuts)[::2])
        held = np.maximum(np.concatenate(top, 1) + self.model.bias, 0)
        return (held @ self.model.weights + self.model.offset).astype(np.float64)

    def probability(self, texts: list[list[str]]) -> np.ndarray:
        z = self.model.scale[0] * self.logits(texts) + self.model.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Learner:
    """Steps of one shard, from a state that all shards begin with."""

    def __init__(self, start: State):
        self.start = start
        self.state = State(start.table.copy(), start.met.copy(), start.dense.copy(), start.steps)
        self.touched = np.zeros(len(start.table), bool)
        self.rows: dict[str, tuple] = {}
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.docs: list[np.ndarray] = []
        self.y: list[int] = []
        self.words = 0

    def add(self, text: str, y: int) -> None:
        """Take one document; a full batch is a step."""
        number = self.number
        ids = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in parts_of(text)]
        self.docs.append(np.concatenate(ids) if sum(map(len, ids)) else np.zeros(1, np.int32))
        self.y.append(y)
        self.words += len(self.docs[-1])
        if len(self.docs) >= BATCH or self.words >= BATCH_WORDS:
            self.step()

    def slices(self) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
        """Word numbers with max(SPANS) - 1 more, or blanks, after each piece of a
        document, and the pieces: document, begin and end in the slice."""
        more, held, pieces, n = max(SPANS) - 1, [], [], 0
        for d, ids in enumerate(self.docs):
            at = 0
            while at < len(ids):
                end = min(len(ids), at + SLICE_WORDS - n)
                tail = ids[end : end + more]
                held += [ids[at:end], tail, np.zeros(more - len(tail), np.int32)]
                pieces.append((d, n, n + end - at))
                n += end - at + more
                at = end
                if n >= SLICE_WORDS:
                    yield np.concatenate(held), pieces
                    held, pieces, n = [], [], 0
        if held:
            yield np.concatenate(held), pieces

    def step(self) -> None:
        if not self.docs:
            return
        state = self.state
        *filters, bias, weights, offset = state.views()
        if len(self.rows) > MEMO:
            self.rows.clear()
        known = self.rows
        rows = np.array([known.get(w) or known.setdefault(w, buckets(w)) for w in self.number], np.int64)
        x = state.table[rows].reshape(len(rows), -1)
        x[0] = 0
        # what each filter sees in a word: filters first, so that the maxima run along words
        seen = [[np.ascontiguousarray((x @ w[k]).T) for k in range(len(w))] for w in filters]
        n = len(self.docs)
        top = np.full((n, len(bias)), -np.inf, np.float32)
        best = np.zeros((n, len(bias), max(SPANS)), np.int64)  # words of the windows with the largest values
        lane = np.arange(FILTERS)
        for flat, pieces in self.slices():
            for place, views in enumerate(seen):
                span, cols = len(views), slice(place * FILTERS, (place + 1) * FILTERS)
                m = len(flat) - span + 1
                v = views[0].take(flat[:m], 1)
                for k in range(1, span):
                    v += views[k].take(flat[k : m + k], 1)
                for d, a, b in pieces:
                    at = v[:, a:b].argmax(1) + a
                    value = v[lane, at]
                    if (more := value > top[d, cols]).any():
                        top[d, cols] = np.where(more, value, top[d, cols])
                        for k in range(span):
                            best[d, cols, k] = np.where(more, flat[at + k], best[d, cols, k])
        y = np.array(self.y, np.float32)
        top += bias
        held = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(held @ weights + offset[0], -30, 30)))
        dz = ((p - y) / n).astype(np.float32)
        dtop = (dz[:, None] * weights) * (top > 0)
        dx, grads = np.zeros_like(x), []
        for place, w in enumerate(filters):
            g, dw = dtop[:, place * FILTERS : (place + 1) * FILTERS], np.zeros_like(w)
            for k in range(len(w)):
                word = best[:, place * FILTERS : (place + 1) * FILTERS, k]
                dw[k] = np.einsum("dfe,df->ef", x[word], g)
                np.add.at(dx, word, g[:, :, None] * w[k].T[None])
            grads.append(dw.ravel())
        grad = np.concatenate([*grads, dtop.sum(0), held.T @ dz + 1e-4 * weights, dz.sum(keepdims=True)])
        state.steps += 1
        value, mean, square = state.dense
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        value -= RATE * (mean / (1 - 0.9**state.steps)) / (np.sqrt(np.maximum(square, 0) / (1 - 0.99**state.steps)) + 1e-6)
        dx[0] = 0
        moved = np.flatnonzero(np.abs(dx).sum(1))
        at, place = np.unique(rows[moved].ravel(), return_inverse=True)
        grad = np.zeros((len(at), WIDTH), np.float32)
        np.add.at(grad, place, dx[moved].reshape(-1, WIDTH))
        state.met[at] += (grad**2).sum(1)
        state.table[at] -= TABLE_RATE * grad / (np.sqrt(state.met[at])[:, None] + 1e-6)
        self.touched[at] = True
        self.empty()

    def changes(self) -> pa.RecordBatch | None:
        """What the shard adds to the state, in UNITs, by row: those of the table
        that it moved, then dense ones with their means and the steps."""
        self.step()
        if self.state.steps == self.start.steps:
            return None
        at, extra = np.flatnonzero(self.touched), np.arange(self.state.dense.shape[1])
        table = np.column_stack([self.state.table[at] - self.start.table[at], self.state.met[at] - self.start.met[at]])
        dense = np.zeros((len(extra), WIDTH + 1))
        dense[:, :3] = (self.state.dense.astype(np.float64) - self.start.dense).T
        dense[:, WIDTH] = (self.state.steps - self.start.steps) / STEPS
        both = np.rint(np.clip(np.concatenate([table, dense]).astype(np.float64), -LARGEST, LARGEST) / UNIT).astype(np.int64)
        row = np.concatenate([at, len(self.touched) + extra])
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), *map(pa.array, both.T.copy())], names=CHANGED)


#: Columns of a shard's changes; a row of them has room for a row of the table and its met.
CHANGED = ["row", *(f"c{k}" for k in range(WIDTH + 1))]
#: Steps are counted in these, so that they stay below LARGEST.
STEPS = 1 << 20


def one_pass(rows: DataFrame, state: State, turn: int, shards: int) -> State:
    """The state after each shard has stepped through its documents. rows: k (a hash),
    y and t. Shards and order are by k and the turn, so that reruns agree."""
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(sent.value)
        for batch in batches:
            for y, t in zip(batch.column(0), batch.column(1)):
                learner.add(t.as_py(), y.as_py())
        if (found := learner.changes()) is not None:
            yield found
        learner = None
        release()

    order = F.xxhash64("k", F.lit(turn))
    dealt = (
        rows.select("k", "y", "t", order.alias("o"), F.pmod(F.xxhash64("k", F.lit(-1 - turn)), F.lit(shards)).cast("int").alias("shard"))
        .repartitionById(shards, "shard")
        .sortWithinPartitions("o", "k")
        .select("y", "t")
    )
    changed = dealt.mapInArrow(learn, ", ".join(f"{c} long" for c in CHANGED))
    summed = changed.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in CHANGED[1:])).toArrow().sort_by("row")
    sent.destroy()
    row, n = summed.column("row").to_numpy(), summed.column("n").to_numpy()
    mean = np.column_stack([summed.column(c).to_numpy() for c in CHANGED[1:]]) * UNIT / n[:, None]
    inside = row < len(state.table)
    table, met, dense = state.table.copy(), state.met.copy(), state.dense.copy()
    table[row[inside]] += mean[inside, :WIDTH]
    met[row[inside]] += mean[inside, WIDTH]
    dense += mean[~inside, :3].T
    return State(table, met, dense, state.steps + STEPS * float(mean[~inside, WIDTH].mean()))


def calibrate(model: Model, out: DataFrame, weight: tuple[float, float]) -> None:
    """Fit the logistic scale of the probability to the documents left out (y, t,
    l), then a threshold by language; a document weighs what its class does."""
    sent = out.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            z = [scorer.logits(x) for x in slices_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(z or [np.zeros(0)]))], names=["y", "l", "z"])
        scorer = None
        release()

    known = materialise(out.select("y", "l", "t").mapInArrow(logits, "y int, l string, z double"))
    many = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(many) < 2:
        return
    z, one = F.col("z"), F.col("y") == 1
    goal = F.when(one, (many[1] + 1) / (many[1] + 2)).otherwise(1 / (many[0] + 2))
    w = F.when(one, weight[1]).otherwise(weight[0])

    def sums(*terms: Column) -> list[float]:
        # decimals add up to the same in any order
        return [float(x) for x in known.agg(*(F.sum(t.cast("decimal(38,18)")).alias(f"s{k}") for k, t in enumerate(terms))).first()]

    def loss(v: np.ndarray) -> Column:
        m = F.lit(float(v[0])) * z + F.lit(float(v[1]))
        return w * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - goal * m)

    ab, at = np.array([1.0, 0.0]), None
    for _ in range(30):  # Newton's method; a step is halved until it helps
        m = F.lit(float(ab[0])) * z + F.lit(float(ab[1]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(m, F.lit(30.0)), F.lit(-30.0))))
        e, h = w * (p - goal), w * p * (1 - p)
        s = sums(e * z, e, h * z * z, h * z, h)
        grad = np.array(s[:2]) + (ab - [1, 0])
        move = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + np.eye(2), grad)
        if np.abs(move).max() < 1e-7:
            break
        tried = [ab] + [ab - 0.5**k * move for k in range(14)]
        found = np.array(sums(*map(loss, tried))) + [0.5 * ((v - [1, 0]) ** 2).sum() for v in tried]
        better = np.flatnonzero(found[1:] <= found[0])
        if not len(better):
            break
        ab = tried[1 + better[0]]
    if ab[0] > 0:
        model.scale = (float(ab[0]), float(ab[1]))
    tried = np.linspace(0.2, 0.8, 61)
    m = F.lit(model.scale[0]) * z + F.lit(model.scale[1])
    p = 1 / (1 + F.exp(-F.greatest(F.least(m, F.lit(30.0)), F.lit(-30.0))))
    reached = sum((F.when(p >= float(t), 1).otherwise(0) for t in tried), F.lit(0))
    spoken = known.where(F.col("l").isNotNull()).groupBy("l")
    enough = spoken.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 10 AND b >= 10").select("l")
    counts: dict[str, np.ndarray] = {}
    for r in known.join(enough, "l").groupBy("l", "y", reached.alias("r")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.l, np.zeros((2, len(tried) + 1)))[r.y, r.r] += r.n
    for lang, (clean, toxic) in counts.items():
        # a text that reaches r thresholds is called toxic by the first r of them
        right = weight[1] * (toxic.sum() - toxic.cumsum())[:-1] + weight[0] * clean.cumsum()[:-1]
        best = tried[right == right.max()]
        model.thresholds[lang] = float(best[np.argmin(np.abs(best - 0.5))])


def held_out(id_col: Column) -> Column:
    """The rows whose labels training never sees: one in five by crc32 of the id."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All labels that may be learnt from (i, y), and the documents to learn from: i,
    y, t and l. These are all labelled ones, whole, a row for each text of an id; with
    a sample, that many ids of each class at most, one row an id, long texts cut."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("i"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
    )
    lang = F.col(lang_col) if lang_col else F.lit(None)
    texts = docs.select(F.col(id_col).alias("i"), text_of(F.col(text_col)).alias("t"), lang.cast("string").alias("l"))
    if sample is None:
        texts = texts.where(F.col("i").isNotNull() & ~held_out(F.col("i")))
        return known, texts.join(known.where("y IN (0, 1)"), "i").groupBy("i", "y", "t").agg(F.min("l").alias("l"))
    order = [F.xxhash64("i"), F.col("i")]
    picked = known.where("y = 1").orderBy(*order).limit(sample).union(known.where("y = 0").orderBy(*order).limit(sample))
    # 2 * sample ids at most: small enough to send to every task
    texts = texts.join(F.broadcast(picked), "i")
    part = SAMPLE_BYTES // 4
    start = F.pmod(F.xxhash64("i"), F.greatest(F.length("t") - part, F.lit(1))).cast("int") + 1
    texts = texts.withColumn("t", F.when(F.octet_length("t") > SAMPLE_BYTES, F.substring("t", start, F.lit(part))).otherwise(F.col("t")))
    found = texts.groupBy("i", "y").agg(F.min(F.struct("t", "l")).alias("x"))
    return known, found.select("i", "y", "x.t", "x.l")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", sample: int | None = None) -> Model | None:
    """The classifier, learnt from all labelled rows that are not held out, or from
    a sample if one is asked for; None without labelled rows of both classes."""
    spark, lang_col = docs.sparkSession, lang_col if lang_col in docs.columns else None
    known, chosen = training_rows(docs, labels, id_col, text_col, label_col, lang_col, sample)
    with temporary(spark):
        k = F.xxhash64("i", "t")
        rows = materialise(chosen.select(k.alias("k"), (F.pmod(F.xxhash64(k), F.lit(5)) == 4).alias("out"), "y", F.octet_length("t").alias("size"), "t", "l"))
        counts = rows.groupBy("out", "y").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        many = {y: sum(r.n for r in counts if r.y == y) for y in {r.y for r in counts}}
        if len(many) < 2:
            return None
        n, size = sum(r.n for r in counts if not r.out), sum(r.size for r in counts if not r.out)
        shards = max(1, min(n // SHARD_ROWS, size // SHARD_BYTES), -(-size // SHARD_MOST))
        state, learnt = started(), rows.where("NOT out")
        for turn in range(max(PASSES[0], min(PASSES[1], -(-VISITS // max(1, n))))):
            if n:
                state = one_pass(learnt, state, turn, shards)
        model, weight = state.model(), (1.0, 1.0)
        if sample is not None:  # a class weighs all its labels over those in the sample
            totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
            share = [totals[y] / many[y] for y in (0, 1)]
            weight = (2 * share[0] / sum(share), 2 * share[1] / sum(share))
        calibrate(model, rows.where("out"), weight)
    return model


def slices_of(texts: pa.Array) -> Iterator[list[list[str]]]:
    """The words of the texts, of some SLICE_WORDS words together."""
    held, n = [], 0
    for t in texts:
        held.append(words_of(t.as_py()))
        n += len(held[-1]) + 2
        if n >= SLICE_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str | None = "lang", names: tuple[str, str, str] = ("score", "threshold", "toxic")) -> DataFrame:
    """docs with score (double), threshold (double, by language) and toxic
    (boolean: score reaches the threshold), under the given names. Columns of
    these names are replaced. Neither the language nor anything but the text
    enters a score."""
    added = list(zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType())))
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + [T.StructField(*x) for x in added])
    place = docs.columns.index(text_col)
    spoken = docs.columns.index(lang_col) if lang_col in docs.columns else None
    kept = [k for k, c in enumerate(docs.columns) if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        scorer = known and Scorer(known)
        for batch in batches:
            n = batch.num_rows
            if known is None:
                p = np.zeros(n)
                limit = np.full(n, 0.5)
            else:
                p = np.concatenate([scorer.probability(x) for x in slices_of(batch.column(place))] or [np.zeros(0)])
                langs = batch.column(spoken).to_pylist() if spoken is not None else [None] * n
                limit = np.array([known.thresholds.get(x, 0.5) for x in langs])
            new = [pa.array(p), pa.array(limit), pa.array(p >= limit)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + new, names=schema.names)
        scorer = None
        release()

    return docs.mapInArrow(score, schema)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The documents whose score stays under their language's threshold, with all
    their columns."""
    names = tuple(free_name(docs, n) for n in ("score", "threshold", "toxic"))
    return score_toxicity(docs, model, text_col, lang_col, names).where(~F.col(names[2])).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """id_col, held_out, score, predicted (1 from a score of 0.5), threshold and
    toxic of each document; the model learns from the labels of rows that are
    not held out."""
    lang = ["lang"] if "lang" in docs.columns else []
    model = fit(docs, labels, id_col, text_col, sample=sample)
    scored = score_toxicity(docs.select(id_col, text_col, *lang), model, text_col)
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )
