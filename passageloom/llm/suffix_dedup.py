"""Removal of long byte strings that repeat across documents.

A byte goes if a string of LENGTH bytes covers it that also starts in a document
with a smaller id. Such strings are found by a suffix array with its common
prefixes, built where they can matter only:

1. Every string of LENGTH bytes has a minimizer, the least hash of its GRAM-byte
   parts. Blocks of documents send the minimizers they hold, each once, to
   buckets that tell which ones several documents share.
2. Blocks send the passages around shared minimizers, each distinct one once
   with the smallest id that holds it, to buckets by minimizer: equal strings
   meet in one bucket. Those of minimizers that many blocks hold first meet
   within teams of blocks, each of which sends them on once.
3. A bucket builds the Burrows-Wheeler transform of its passages. Breadth-first
   backward extension of intervals sets the common prefixes of neighbouring
   suffixes in increasing order and stops at LENGTH: neighbours without a value
   by then share a string of LENGTH bytes, whose smallest id is thus known.
4. What was found goes back to the blocks, by their teams where they have one,
   and they mark and cut their documents.

What crosses the network grows with the text of the corpus, not with the square
of a group: a string comes to its bucket once from each block, however many
documents hold it, and at most about twice the square root of the blocks' number
of times in all. The documents themselves are dealt to blocks once; the three
steps that need them read the same exchange.

Rows: a null text is empty and loses nothing. Rows without an id lose nothing
and count nowhere. Rows that share an id don't take from each other. Texts of any
length are taken whole. An empty table gives an empty one. Other columns, of whatever
names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .near_dup import mixed

LENGTH, GRAM = 50, 24
#: Bytes of text in a block and behind a bucket; strings of one passage; bytes
#: hashed at a time.
BLOCK_BYTES, BUCKET_BYTES, RUN, SLICE = 4 << 20, 1 << 20, 64, 1 << 20
#: Blocks for each team, beyond which those that hold a minimizer meet in teams.
PER_TEAM = 2
EXCHANGED = "block int, kind int, bucket int, team int, a binary, b binary, c binary"
NAMES = ["block", "kind", "bucket", "team", "a", "b", "c"]


def packed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=NAMES)


def column_bytes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column on end, and where each begins."""
    data, sizes = [], [np.zeros(1, np.int64)]
    for part in texts.chunks:
        if len(part):
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            raw = part.buffers()[2]
            data.append(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8))
            sizes.append(np.diff(offsets).astype(np.int64))
    return np.concatenate(data or [np.zeros(0, np.uint8)]), np.cumsum(np.concatenate(sizes))


def words_of_eight(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, zeros beyond the end, as one number."""
    n, padded = len(x), np.concatenate([x, np.zeros(16, np.uint8)])
    eight = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        m = len(range(r, n, 8))
        eight[r::8] = padded[r : r + 8 * m].view("<u8")
    return eight


def minimizers(x: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The least hash of the gram-byte parts of the string at each place."""
    n, eight = len(x), words_of_eight(x)
    h = eight[: n - gram + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in zip(range(8, gram, 8), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(29))) + eight[k : k + n - gram + 1] * np.uint64(factor)
    h = mixed(h)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


class Runs:
    """Runs of strings with one minimizer: start, count, document, minimizer."""

    def __init__(self, x: np.ndarray, begins: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.length, parts, d = length, [], 0
        while d < len(begins) - 1:  # some documents at a time
            e = max(d + 1, int(np.searchsorted(begins, begins[d] + SLICE, "right")) - 1)
            parts.append(self.of(x[begins[d] : begins[e]], begins[d : e + 1] - begins[d], gram, d, int(begins[d])))
            d = e
        joined = [np.concatenate(y) for y in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        self.start, self.count, self.doc, self.hash = joined

    def of(self, x: np.ndarray, begins: np.ndarray, gram: int, first: int, at: int) -> tuple[np.ndarray, ...]:
        if len(x) < self.length:
            return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
        least = minimizers(x, self.length, gram)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        stops = np.concatenate([begins[:-1], begins[1:] - self.length + 1])
        new[stops[(stops >= 0) & (stops < len(least))]] = True
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(least)))
        doc = np.searchsorted(begins, start, "right") - 1
        inside = start + self.length <= begins[doc + 1]
        start, count, doc = start[inside], count[inside], doc[inside]
        pieces = -(-count // RUN)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, count, doc = np.repeat(start, pieces) + nth * RUN, np.repeat(count, pieces) - nth * RUN, np.repeat(doc, pieces)
        return start + at, np.minimum(count, RUN), doc + first, least[start]

    def distinct(self, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers by bucket: 32 bits that tell them apart there, but
        for a few that then count as shared, whether several documents have them,
        their buckets, and each run's place among them."""
        order = np.argsort(self.hash, kind="stable")
        h, i = self.hash[order], ids[self.doc[order]]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(head)
        several = np.minimum.reduceat(i, at) < np.maximum.reduceat(i, at) if len(at) else np.zeros(0, bool)
        spread = mixed(h[at] + np.uint64(1))
        bucket = (spread % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(at), np.int64)
        place[by] = np.arange(len(at))
        runs = np.empty(len(h), np.int64)
        runs[order] = place[np.cumsum(head) - 1]
        return (spread >> np.uint64(32)).astype(np.uint32)[by], several[by], bucket[by], runs, order


def cut_by(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """The stretches of a sorted array of buckets."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at[1:], len(bucket))
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(at, ends)]


def shared_of(rows: list[tuple[bytes, bytes]], many: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block's minimizers and several flags: which ones documents share,
    and which ones more than many blocks hold."""
    hashes = [np.frombuffer(a, np.uint32) for a, _ in rows]
    several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)).astype(bool) for (_, b), h in zip(rows, hashes)]
    h, s = np.concatenate(hashes), np.concatenate(several)
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_s = h[order], s[order]
    head = np.ones(len(h), bool)
    head[1:] = sorted_h[1:] != sorted_h[:-1]
    at = np.flatnonzero(head)
    held = np.diff(np.append(at, len(h)))
    out = np.empty((2, len(h)), bool)
    out[:, order] = np.stack([(held > 1) | np.logical_or.reduceat(sorted_s, at), held > many])[:, np.cumsum(head) - 1]
    return list(zip(*(np.split(x, np.cumsum([len(x) for x in hashes])[:-1]) for x in out)))


class Passages:
    """The distinct passages of a block around shared minimizers, by bucket: first
    the out buckets, then hot ones for minimizers that many blocks hold."""

    def __init__(self, table: pa.Table, masks: list[tuple[int, bytes, bytes]], buckets: int, out: int, hot: int):
        self.x, self.begins = column_bytes(table.column("t"))
        self.ids = table.column("i").to_numpy()
        self.runs = runs = Runs(self.x, self.begins)
        hashes, _, bucket, place, _ = runs.distinct(self.ids, buckets)
        told, where = np.zeros((2, len(hashes)), bool), dict(cut_by(bucket))
        for b, *bits in masks:
            s = where[b]
            for row, x in zip(told, bits):
                row[s] = np.unpackbits(np.frombuffer(x, np.uint8), count=s.stop - s.start).astype(bool)
        self.kept = np.flatnonzero(told[0][place])
        raw, spread = self.x.tobytes(), mixed(runs.hash[self.kept] + np.uint64(2))
        spread = np.where(told[1][place[self.kept]], spread % np.uint64(hot) + np.uint64(out), spread % np.uint64(out))
        a = runs.start[self.kept]
        b = a + runs.count[self.kept] + runs.length - 1
        texts = [raw[p:q] for p, q in zip(a.tolist(), b.tolist())]
        ids = self.ids[runs.doc[self.kept]]
        self.passages = sorted(set(zip(spread.tolist(), texts)))
        number = {p: k for k, p in enumerate(self.passages)}
        self.number = np.fromiter(map(number.__getitem__, zip(spread.tolist(), texts)), np.int64, len(texts))
        self.least = np.full(len(self.passages), np.iinfo(np.int64).max)
        self.most = np.full(len(self.passages), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.number, ids)
        np.maximum.at(self.most, self.number, ids)
        self.cuts = cut_by(np.array([p[0] for p in self.passages], np.int64)) if self.passages else []


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of the suffixes of t, which ends with its only 0, in order."""
    n, step = len(t), 7
    key = np.zeros(n, np.int64)
    for k in range(step):  # seven symbols of nine bits
        key <<= 9
        key[: max(0, n - k)] |= t[k:]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        key = rank << 32
        key[: max(0, n - step)] |= rank[step:] + 1
        step *= 2


def same_prefix(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of t and, for each suffix in order, whether its first
    length symbols differ from those of the suffix before; strings that run over
    a separator (1) aren't told apart."""
    n, sa = len(t), suffix_array(t)
    bwt = t[sa - 1]
    by = np.argsort(bwt, kind="stable").astype(np.int32)
    forward = np.empty(n, np.int32)  # where a suffix stands once its letter is put before it
    forward[by] = np.arange(n, dtype=np.int32)
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # the same letter's neighbours
    alike = bwt[by[1:]] == bwt[by[:-1]]
    before[by[1:][alike]], after[by[:-1][alike]] = by[:-1][alike], by[1:][alike]
    letter = bwt > 1
    common = np.full(n + 1, -1, np.int8)
    common[0] = common[n] = 0
    first = t[sa]
    lb = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    rb = np.append(lb[1:], n) - 1
    common[rb + 1] = 0
    lb, rb = lb[first[lb] > 0], rb[first[lb] > 0]
    for value in range(1, length):
        if not len(lb):
            break
        size = rb - lb + 1
        which = np.repeat(np.arange(len(lb)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lb[which]
        good = letter[at]
        at, which = at[good], which[good]
        new_lb = forward[at[before[at] < lb[which]]]
        new_rb = forward[at[after[at] > rb[which]]]
        new_lb.sort()
        new_rb.sort()  # children don't overlap, so both sort alike
        fresh = common[new_rb + 1] < 0
        lb, rb = new_lb[fresh].astype(np.int64), new_rb[fresh].astype(np.int64)
        common[rb + 1] = value
    return sa, common[:n] >= 0


def string_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length bytes from each place; length is 8 at least."""
    n, h = len(x) - length + 1, None
    eight = words_of_eight(x)
    for k in [*range(0, length - 8, 8), length - 8]:
        part = eight[k : k + n]
        h = part if h is None else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
    return mixed(h)


def may_share(joined: np.ndarray, at: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """Which passages hold a string that may stand elsewhere too, by hashes:
    equal strings have equal ones, so none is missed."""
    h = string_hashes(joined, length)[at]
    order = np.argsort(h, kind="stable")
    alike = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][alike]] = twice[order[:-1][alike]] = True
    return np.logical_or.reduceat(twice, np.cumsum(strings) - strings)


def least_ids(passages: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each string of length bytes of the passages, on end, the least id of
    a passage that holds it; and where each passage's strings begin. Passages are
    distinct; those without a string that may stand in another keep their id, the
    transform is built of the rest."""
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    raw = np.frombuffer(b"\0".join(passages) + b"\0\0", np.uint8)
    strings = sizes - length + 1
    begins = np.concatenate([[0], np.cumsum(strings)])

    def places(sizes: np.ndarray) -> np.ndarray:
        n, first = sizes - length + 1, np.cumsum(sizes + 1) - 1 - sizes
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)

    out = np.repeat(ids, strings)
    chosen = np.flatnonzero(may_share(raw, places(sizes), strings, length)) if length >= 8 else np.arange(len(passages))
    if not len(chosen):
        return out, begins
    some = sizes[chosen]
    joined = np.frombuffer(b"\0".join([passages[k] for k in chosen]) + b"\0\0", np.uint8).astype(np.int64) + 2
    joined[np.cumsum(some + 1) - 1], joined[-1] = 1, 0
    sa, new = same_prefix(joined, length)
    group = np.empty(len(joined), np.int64)
    group[sa] = np.cumsum(new) - 1
    at = places(some)
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[at], np.repeat(ids[chosen], some - length + 1))
    mine = np.zeros(len(passages), bool)
    mine[chosen] = True
    out[np.repeat(mine, strings)] = least[group[at]]
    return out, begins


def pieces(blob: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class Gathered:
    """The distinct passages that several rows send, with their smallest ids."""

    def __init__(self, rows: dict[str, list]):
        number: dict[bytes, int] = {}
        self.rows, self.places = rows, []
        for blob, sizes in zip(rows["a"], rows["b"]):
            mine = pieces(blob, sizes)
            self.places.append(np.fromiter((number.setdefault(x, len(number)) for x in mine), np.int32, len(mine)))
        self.passages = list(number)
        self.known = [np.frombuffer(c, np.int64).reshape(2, -1) for c in rows["c"]]
        self.least = np.full(len(number), np.iinfo(np.int64).max)
        self.most = np.full(len(number), np.iinfo(np.int64).min)
        for at, k in zip(self.places, self.known):
            np.minimum.at(self.least, at, k[0])
            np.maximum.at(self.most, at, k[1])

    def extended(self) -> list[tuple[bytes, bytes, bytes]]:
        """For each row, the entries, offsets and least ids of its strings that a
        smaller id holds."""
        least, begins = least_ids(self.passages, self.least)
        # strings of one passage in a row with one least id go back as one
        head = np.ones(len(least), bool)
        head[1:] = least[1:] != least[:-1]
        head[begins[:-1]] = True
        heads = np.flatnonzero(head)
        lowest = np.minimum.reduceat(least, begins[:-1])
        out = []
        for at, k in zip(self.places, self.known):
            tell = np.flatnonzero(lowest[at] < k[1])
            first, last = np.searchsorted(heads, begins[at[tell]]), np.searchsorted(heads, begins[at[tell] + 1])
            nth, place = stretches(first, last)
            entry, place = tell[nth], heads[place]
            offset = place - begins[at[entry]]
            out.append((entry.astype(np.int32).tobytes(), offset.astype(np.uint8).tobytes(), least[place].tobytes()))
        return out


def stretches(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each first up to its last, and whose they are."""
    n = last - first
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def told_of(rows: dict[str, list], kind: int) -> tuple[list[int], list[np.ndarray]]:
    """The rows of a kind; their entries, offsets and least ids."""
    mine = [k for k, x in enumerate(rows["kind"]) if x == kind]
    return mine, [np.concatenate([np.frombuffer(rows[c][k], t) for k in mine] or [np.zeros(0, t)]) for c, t in (("a", np.int32), ("b", np.uint8), ("c", np.int64))]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, spans (array of start and size, in bytes, maximal) and kept (binary)
    of each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), text_of(F.col(text_col)).cast("binary").alias("t"))
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, buckets = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    hash_buckets = max(1, math.ceil(buckets / 8))
    # minimizers that many blocks hold have buckets of their own
    teams, hot_buckets = math.isqrt(blocks - 1) + 1, hash_buckets
    many = PER_TEAM * teams
    dealt = texts.where("i IS NOT NULL").select(F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("block"), "i", "t")

    def offer(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        runs = Runs(*column_bytes(table.column("t")))
        hashes, several, bucket, _, _ = runs.distinct(table.column("i").to_numpy(), hash_buckets)
        return packed([(block, 0, b, 0, hashes[s].tobytes(), np.packbits(several[s]).tobytes(), None) for b, s in cut_by(bucket)])

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        masks = shared_of(list(zip(rows["a"], rows["b"])), many)
        return packed([(k, 1, b, 0, *(np.packbits(m).tobytes() for m in both), None) for k, b, both in zip(rows["block"], rows["bucket"], masks)])

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return packed([])
        rows, block = told.to_pydict(), table.column("block")[0].as_py()
        p = Passages(table, list(zip(rows["bucket"], rows["a"], rows["b"])), hash_buckets, buckets, hot_buckets)
        out = []
        for b, s in p.cuts:
            mine = [x for _, x in p.passages[s]]
            sizes = np.fromiter(map(len, mine), np.int32, len(mine))
            out.append((block, 2, b, -1 if b < buckets else block % teams, b"".join(mine), sizes.tobytes(), np.concatenate([p.least[s], p.most[s]]).tobytes()))
        return packed(out)

    def meet(table: pa.Table) -> pa.Table:
        """A bucket's answers to its blocks; in a team, its passages and where
        each of its blocks has them."""
        rows = table.to_pydict()
        both, bucket, team = Gathered(rows), rows["bucket"][0], rows["team"][0]
        if team < 0:
            return packed([(k, 3, bucket, team, *found) for k, found in zip(rows["block"], both.extended())])
        out = [(k, 4, bucket, team, at.tobytes(), None, None) for k, at in zip(rows["block"], both.places)]
        sizes = np.fromiter(map(len, both.passages), np.int32, len(both.passages))
        return packed([*out, (team, 5, bucket, -1, b"".join(both.passages), sizes.tobytes(), np.concatenate([both.least, both.most]).tobytes())])

    def settle(table: pa.Table) -> pa.Table:
        """A hot bucket's answers to its teams."""
        if table.column("kind")[0].as_py() != 5:
            return table
        rows = table.to_pydict()
        return packed([(-1, 6, rows["bucket"][0], team, *found) for team, found in zip(rows["block"], Gathered(rows).extended())])

    def pass_on(table: pa.Table) -> pa.Table:
        """A team's answers to its blocks."""
        if table.column("team")[0].as_py() < 0:
            return table
        rows = table.to_pydict()
        _, (entry, offset, least) = told_of(rows, 6)
        out = []
        for k, block in enumerate(rows["block"]):
            if rows["kind"][k] == 4:
                at = np.frombuffer(rows["a"][k], np.int32)
                mine, place = stretches(np.searchsorted(entry, at), np.searchsorted(entry, at, "right"))
                out.append((block, 3, rows["bucket"][k], -1, mine.astype(np.int32).tobytes(), offset[place].tobytes(), least[place].tobytes()))
        return packed(out)

    kept_type = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = table.column("i"), table.column("t")
        x, begins = column_bytes(texts)
        gone = np.zeros(len(x) + 1, np.int32)
        rows = told.to_pydict()
        found, (entry, offset, least) = told_of(rows, 3)
        if table.num_rows and found:
            masks = [x for *x, kind in zip(rows["bucket"], rows["a"], rows["b"], rows["kind"]) if kind == 1]
            p = Passages(table, masks, hash_buckets, buckets, hot_buckets)
            where, strings = dict(p.cuts), np.array([len(t) for _, t in p.passages], np.int64) - LENGTH + 1
            entry = entry + np.repeat([where[rows["bucket"][k]].start for k in found], [len(rows["b"][k]) for k in found])
            offset = offset.astype(np.int64)
            order = np.lexsort((offset, entry))
            entry, offset, least = entry[order], offset[order], least[order]
            end = np.where(np.append(entry[1:] == entry[:-1], False), np.append(offset[1:], 0), strings[entry]) if len(entry) else offset
            first, last = np.searchsorted(entry, p.number), np.searchsorted(entry, p.number, "right")
            run, k = stretches(first, last)  # told of each passage, wherever it stands
            mine = least[k] < p.ids[p.runs.doc[p.kept[run]]]
            run, k = run[mine], k[mine]
            start = p.runs.start[p.kept[run]]
            np.add.at(gone, start + offset[k], 1)
            np.add.at(gone, start + end[k] - 1 + LENGTH, -1)
        gone = np.cumsum(gone[:-1]) > 0
        edge = np.zeros(len(x) + 1, np.int8)
        edge[:-1] += gone
        edge[1:] -= gone
        begin_here = gone.copy()
        begin_here[1:] &= ~gone[:-1]
        docs_at = begins[:-1][begins[:-1] < len(x)]
        begin_here[docs_at] = gone[docs_at]
        starts = np.flatnonzero(begin_here)
        stop_here = gone.copy()
        stop_here[:-1] &= ~gone[1:]
        last = begins[1:][begins[1:] > 0] - 1
        stop_here[last] = gone[last]
        sizes = np.flatnonzero(stop_here) + 1 - starts
        owner = np.searchsorted(begins, starts, "right") - 1
        ends = np.searchsorted(owner, np.arange(len(ids)), "right")
        spans = pa.StructArray.from_arrays([pa.array((starts - begins[owner]).astype(np.int32)), pa.array(sizes.astype(np.int32))], ["start", "size"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), spans)
        left = np.concatenate([[0], np.cumsum(~gone)])[begins]
        data = x[~gone].tobytes()
        kept = pa.array([data[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())], pa.binary())
        return pa.table([ids, lists.cast(kept_type), kept], names=["i", "spans", "kept"])

    # one plan: the three readers of the documents share their exchange
    offered = dealt.groupBy("block").applyInArrow(offer, EXCHANGED)
    masks = offered.groupBy("bucket").applyInArrow(compare, EXCHANGED)
    sent = dealt.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(send, EXCHANGED)
    found = sent.groupBy("bucket", "team").applyInArrow(meet, EXCHANGED)
    for step in (settle, pass_on):
        found = found.groupBy("bucket", "team").applyInArrow(step, EXCHANGED)
    told = masks.union(found)
    shape = "i long, spans array<struct<start: int, size: int>>, kept binary"
    done = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut, shape)
    none = F.array().cast("array<struct<start: int, size: int>>")
    return done.union(texts.where("i IS NULL").select("i", none.alias("spans"), F.col("t").alias("kept")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["size"])
    return repeated_spans(docs, id_col, text_col).select(
        F.col("i").alias(id_col),
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
