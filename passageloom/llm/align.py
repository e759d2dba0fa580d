"""Alignment of two tokenizers' tokens over the same texts.

A is a byte-level vocabulary, given the text with a space in front; B is a piece
vocabulary that puts the space there itself. Both token sequences are cut at their
ends, byte offsets: the union of the two end arrays makes elementary intervals, each
owned by one token of A and one of B (searchsorted), so each interval is one overlap.
An end that both share closes a group; the links of a group are all its pairs of an A
and a B token. How many documents hold a pair linked is counted over the corpus, and
a link is a best one where no pair of its A id is held by more.

A text is tokenized once. What is kept of it is its distinct pairs, four bytes each,
and how often they occur; tasks count pairs before they are shuffled. The counts,
whose number depends on the two vocabularies and not on the documents, are sent to
the tasks while they are at most `limit` pairs, and joined to the documents' pairs
beyond that, with the same results.

Rows: a null or empty text, and one whose tokens don't spell it (B reads its own
mark as a space), has no tokens: zeros, and '' for its groups. Repeated rows are
documents like any other, and a null id is kept. Texts of any length are taken
whole; links of a large group are counted by distinct ids, never listed. An empty
table gives an empty one. Other columns, of whatever names, are left alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, merged, slices
from .common import materialise, release, text_of
from .joins import Joins
from .pieces import SHORT
from .pieces import encoder as piece_encoder
from .pieces import spelling

#: Pairs whose counts are sent to the tasks at most: 16 bytes each.
LIMIT = 4_000_000
#: Pairs that a task holds counts of at a time, and links of a group that are
#: listed one by one.
HELD, LISTED = 4_000_000, 4096
#: Characters of texts that are aligned at a time: what fits a processor's cache.
SLICE = 250_000
#: What may stand after an id: one of the same side, the other side, the next
#: group, the end.
AFTER = (b",", b"|", b";", b"")
IDS = 1 << 16
ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes as: those that print
    stand for themselves, the others for letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """The ids of a byte-level BPE vocabulary file, without special tokens. Merges
    must be in the order of the ids that they make, as ranks are."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters, vocabulary = byte_alphabet(), said["model"]["vocab"]
    special = {t["content"] for t in said.get("added_tokens", [])}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in said["model"]["merges"]]
    if said.get("normalizer") or made != sorted(made):
        raise ValueError(f"{path} normalises its texts, or ranks its merges otherwise than its ids")
    return {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy's union1d of two sorted arrays: the stable sort merges two runs."""
    every = np.sort(np.concatenate([a, b]), kind="stable")
    return every[np.append(True, every[1:] != every[:-1])[: len(every)]]


class ByteEncoder(Encoder):
    """Words that are no token join in arrays, many a step; long ones in a heap."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.joins = Joins(ranks, ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def learn(self, tokens: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        whole = [self.known.get(b) for b in raw]
        kind = [0 if k is not None else 1 if len(b) <= SHORT else 2 for k, b in zip(whole, raw)]
        of = [[k for k, x in enumerate(kind) if x == n] for n in range(3)]
        short = [raw[k] for k in of[1]]
        letters = np.frombuffer(b"".join(short), np.uint8)
        ids, _, counts = self.joins.joined(self.byte[letters], np.fromiter(map(len, short), np.int64, len(short)), letters)
        long = [merged(raw[k], self.known) for k in of[2]]
        first = len(self.memo)
        self.memo.update(zip((tokens[k] for n in of for k in n), range(first, first + len(tokens))))
        length = np.concatenate([np.ones(len(of[0]), np.int64), counts, np.fromiter(map(len, long), np.int64, len(long))])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        flat = [np.fromiter((whole[k] for k in of[0]), np.int32, len(of[0])), ids, np.fromiter((x for w in long for x in w), np.int32, sum(map(len, long)))]
        self.flat = np.concatenate([self.flat, *flat])


class Aligner:
    def __init__(self, byte_path: str, pattern: str, piece_path: str):
        ranks = read_byte_level(byte_path)
        self.a, self.b = ByteEncoder(ranks, pattern), piece_encoder(piece_path)
        by_id = {k: t for t, k in ranks.items()}
        spelt = [by_id.get(k, b"") for k in range(max(by_id, default=-1) + 1)]
        length = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.spelt = (np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(length) - length, length), spelling(piece_path)
        if max(len(spelt), len(self.spelt[1][2])) > IDS:
            raise ValueError("an id takes more than 16 bits")
        self.written = [b"%d%s" % (k, s) for s in AFTER for k in range(IDS)]

    def forget(self) -> None:
        self.a.forget()
        self.b.forget()

    def sound(self, texts: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which texts have tokens that spell a space and the text, on both sides."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        want, ok = np.frombuffer(b"".join(raw), np.uint8), size > 0
        for (flat, start, length), (ids, last) in zip(self.spelt, sides):
            n = length[ids]
            ends = np.concatenate([[0], np.cumsum(n)])[last]
            mine = np.diff(ends, prepend=0)
            at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            got, here = flat[at], mine == size
            if here.all() and np.array_equal(got, want):
                continue
            stop = np.cumsum(size)
            for k in np.flatnonzero(ok).tolist():  # few texts, or none
                ok[k] = here[k] and np.array_equal(got[ends[k] - mine[k] : ends[k]], want[stop[k] - size[k] : stop[k]])
        return ok

    def rows(self, texts: list[str]) -> tuple[list, ...]:
        """The columns of ROW, a value per text."""
        sides = [self.a.encode([" " + t if t else "" for t in texts]), self.b.encode(texts)]
        ok = self.sound(texts, sides)
        ids, ends, counts = [], [], []
        for (all_ids, last), (_, _, length) in zip(sides, self.spelt):
            n = np.diff(last, prepend=0)
            mine = all_ids if ok.all() else all_ids[np.repeat(ok, n)]
            ids.append(mine.astype(np.int64))
            ends.append(np.cumsum(length[mine]))
            counts.append(np.where(ok, n, 0))
        (a, b), (a_end, b_end), (n_a, n_b) = ids, ends, counts
        cuts = union1d(a_end, b_end)  # the ends of the elementary intervals
        owner_a, owner_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        is_a, is_b = (end[owner] == cuts if len(cuts) else np.zeros(0, bool) for end, owner in ((a_end, owner_a), (b_end, owner_b)))
        closed = is_a & is_b
        group = np.cumsum(closed) - closed
        ga, gb = group[is_a], group[is_b]  # of each token, by the interval that it ends with
        groups = int(closed.sum())
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_a[from_a] if groups else np.zeros(0, np.int64)  # of each group
        n_groups = np.bincount(doc, minlength=len(texts))
        links = in_a * in_b
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, links)
        keys, times = self.pairs(a, b, ga, in_a, in_b, from_a, from_b, doc, links, len(texts))
        return n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), self.digests(a, b, ga, gb, in_a, in_b, from_a, from_b, doc, n_a, n_b), keys, times

    def digests(self, a, b, ga, gb, in_a, in_b, from_a, from_b, doc, n_a, n_b) -> list[str]:
        """The hash of each text's groups as they are written."""
        last_of_a = np.append(ga[1:] != ga[:-1], True)[: len(a)]
        last_of_b = np.append(gb[1:] != gb[:-1], True)[: len(b)]
        final = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        code = np.zeros(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + from_b[ga]] = a + IDS * last_of_a
        code[np.arange(len(b)) + (from_a + in_a)[gb]] = b + IDS * np.where(last_of_b, np.where(final[gb], 3, 2), 0)
        parts = list(map(self.written.__getitem__, code.tolist()))
        out, at = [], 0
        for n in (n_a + n_b).tolist():
            out.append(hashlib.sha256(b"".join(parts[at : at + n])).hexdigest() if n else "")
            at += n
        return out

    @staticmethod
    def pairs(a, b, ga, in_a, in_b, from_a, from_b, doc, links, n: int) -> tuple[list[bytes], list[bytes]]:
        """Each text's distinct pairs, a * IDS + b, in order, and how many links
        each has."""
        large = np.flatnonzero(links > LISTED)
        few = links[ga] <= LISTED
        mine, g = np.flatnonzero(few), ga[few]
        each = in_b[g]
        first = np.repeat(from_b[g] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        key = (np.repeat(doc[g], each) << 32) + np.repeat(a[mine] * IDS, each) + b[first]
        found = [np.unique(key, return_counts=True)]
        for k in large.tolist():
            ids_a, n_a = np.unique(a[from_a[k] : from_a[k] + in_a[k]], return_counts=True)
            ids_b, n_b = np.unique(b[from_b[k] : from_b[k] + in_b[k]], return_counts=True)
            found.append((((doc[k] << 32) + ids_a[:, None] * IDS + ids_b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel()))
        key, times = found[0]
        if large.size:
            key, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, where, np.concatenate([t for _, t in found]))
        stop = np.searchsorted(key >> 32, np.arange(n), side="right").tolist()
        short, at, keys, counts = (key & 0xFFFFFFFF).astype(np.uint32), 0, [], []
        for e in stop:
            t = times[at:e]
            keys.append(short[at:e].tobytes())
            # a byte each where that is enough, which the length tells
            counts.append(t.astype(np.uint8 if not len(t) or t.max() < 256 else np.int64).tobytes())
            at = e
        return keys, counts


_aligners: dict[tuple[str, str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def counts_of(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, np.uint32)
    return k, np.frombuffer(times, np.uint8 if len(times) == len(k) else np.int64).astype(np.int64)


def token_alignment(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the columns of ROW: what the two vocabularies make of each text,
    keys and times as of Aligner.pairs (see counts_of)."""
    given = docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text"))
    schema = T.StructType([given.schema.fields[0], *T.StructType.fromDDL(ROW).fields])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, pattern, piece_path)
        for batch in batches:
            done = 0
            for part in slices(batch.column(1), SLICE):
                columns = [pa.array(c, kind) for c, kind in zip(both.rows(part), (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *columns], names=schema.names)
                done += len(part)
        both.forget()  # a worker lives on after its task
        release()

    return given.mapInArrow(made, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key and n: how many documents hold a pair. Tasks count what they read before
    it is shuffled, HELD pairs at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, new, held = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([key, *new])
            of = np.concatenate([n, np.ones(len(every) - len(n), np.int64)])
            order = np.argsort(every, kind="stable")
            every, of = every[order], of[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            return every[starts], np.add.reduceat(of, starts) if len(starts) else of[:0]

        out = lambda: pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])
        for batch in batches:
            for keys in batch.column(0):
                new.append(np.frombuffer(keys.as_py(), np.uint32))
                held += len(new[-1])
                if held > HELD:
                    key, n = merged()
                    new, held = [], 0
                    if len(key) > HELD:
                        yield out()
                        key, n = key[:0], n[:0]
        key, n = merged()
        yield out()

    return aligned.select("keys").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def scored_here(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with n_best and count_sum; counts go to every task."""
    table = counts.orderBy("key").toArrow()
    key, n = (np.asarray(table.column(c)) for c in ("key", "n"))
    starts = np.flatnonzero(np.append(True, key[1:] // IDS != key[:-1] // IDS)[: len(key)])
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(key)))) if len(key) else n
    sent = aligned.sparkSession.sparkContext.broadcast((key.astype(np.uint32), n, n == best))
    kept = [k for k, c in enumerate(aligned.columns) if c not in ("keys", "times")]
    fields = [aligned.schema.fields[k] for k in kept]
    schema = T.StructType([*fields, *T.StructType.fromDDL("n_best long, count_sum long").fields])
    at = [aligned.columns.index(c) for c in ("keys", "times")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, number, is_best = sent.value
        for batch in batches:
            best, total = [], []
            for keys, times in zip(*(batch.column(k) for k in at)):
                mine, t = counts_of(keys.as_py(), times.as_py())
                where = np.searchsorted(every, mine)
                best.append(int(t[is_best[where]].sum()))
                total.append(int((t * number[where]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=schema.names)

    return aligned.mapInArrow(scored, schema)


def scored_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join, for counts of any number."""
    numbered = materialise(aligned.withColumn("row_", F.monotonically_increasing_id()))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, keys, times in zip(*batch.columns):
                key, t = counts_of(keys.as_py(), times.as_py())
                for k in range(0, len(key), HELD):
                    part = [np.full(len(key[k : k + HELD]), row.as_py()), key[k : k + HELD].astype(np.int64), t[k : k + HELD]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["row_", "key", "t"])

    pairs = numbered.select("row_", "keys", "times").mapInArrow(listed, "row_ long, key long, t long")
    a = F.shiftright("key", 16)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("best"))
    known = counts.withColumn("a", a).join(best, "a").select("key", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    sums = pairs.join(known, "key").groupBy("row_").agg(F.sum(F.col("t") * F.col("is_best")).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    found = numbered.drop("keys", "times").join(sums, "row_", "left").drop("row_")
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def alignment_report(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256, of the groups as a1,a2|b1;a3|b2."""
    aligned = materialise(token_alignment(docs, byte_path, pattern, piece_path, id_col, text_col))
    counts = materialise(pair_counts(aligned))
    scored = scored_here if counts.count() <= limit else scored_by_join
    return scored(aligned, counts).select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
