"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary as a whole is resolved by a minimal
perfect hash over the vocabulary; the others are merged by a heap of pairs over
doubly linked bytes. Spark partitions the texts; inside a task texts are taken
a few hundred at a time, distinct pre-tokens once.

Rows: a null text counts as empty, and an empty text has no ids. Repeated rows
are encoded alike. Texts of any length are taken whole. An empty table gives an empty
one. A column named like a new one is replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, text_of

#: Members of the classes that a pattern may name. White space is as the Unicode
#: property has it; LATIN holds for texts of ASCII and the Latin-1 letters alone.
LATIN = {r"\s": r"\x09-\x0d\x20", r"\p{L}": "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9"}
FULL = {r"\s": r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
NOT_LATIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
#: Characters of texts encoded at a time, and pre-tokens remembered by a worker.
SLICE_CHARS, MEMO = 1_000_000, 150_000
#: Displacements tried at once when the perfect hash is built.
TRIES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def spelt_out(pattern: str, members: dict[str, str]) -> str:
    """The pattern with named classes written as their members."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        named = members.get(part)
        if part == r"\S" and not inside and r"\s" in members:
            out.append(f"[^{members[r'\s']}]")
        elif named is None:
            inside = part == "[" or inside and part != "]"
            out.append(part)
        else:
            out.append(named if inside else f"[{named}]")
    return "".join(out)


class Splitter:
    """Pre-tokens of a text by a pattern. Texts of Latin letters alone, most of
    them, go through the standard matcher, which is the faster."""

    def __init__(self, pattern: str):
        self.latin = re.compile(spelt_out(pattern, LATIN))
        self.full = regex.compile(spelt_out(pattern, FULL))

    def findall(self, text: str) -> list[str]:
        return (self.full if NOT_LATIN.search(text) else self.latin).findall(text)


class PerfectHash:
    """Minimal perfect hash from the vocabulary's tokens to their ranks.

    Keys fall into buckets; each bucket has a displacement that sends its keys
    to free slots. A bucket of one key names its slot outright, as -slot - 1.
    Slots hold the key, so a token from outside is told apart.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.keys = list(ranks)
        n = self.n = max(1, len(self.keys))
        hashes = self.hashed(self.keys)
        self.buckets = n // 4 + 1
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.shift = np.zeros(self.buckets, np.int64)
        owner = np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[starts[b] : starts[b + 1]]
            if len(mine) < 2:
                break
            d = 0
            while True:  # a run of displacements at a time
                tried = np.arange(d, d + TRIES)
                at = np.sort(self.slots(hashes[mine][:, None], tried[None, :]), axis=0)
                fits = (owner[at] < 0).all(axis=0) & (at[1:] != at[:-1]).all(axis=0)
                if fits.any():
                    break
                d += TRIES
            d = int(tried[np.argmax(fits)])
            at = self.slots(hashes[mine], np.int64(d))
            owner[at], self.shift[b] = mine, d
        free = iter(np.flatnonzero(owner < 0).tolist())
        for b in np.flatnonzero(sizes == 1):
            k = next(free)
            owner[k], self.shift[b] = order[starts[b]], -k - 1
        self.at = [self.keys[k] if k >= 0 else None for k in owner]
        self.rank = np.array([ranks[k] if k is not None else -1 for k in self.at], np.int64)

    @staticmethod
    def hashed(tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))

    def slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = hashes ^ (np.asarray(shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def ranks(self, tokens: list[bytes]) -> np.ndarray:
        """The rank of each token, -1 for those that aren't in the vocabulary."""
        hashes = self.hashed(tokens)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(shift < 0, -shift - 1, self.slots(hashes, np.maximum(shift, 0)))
        same = np.fromiter((self.at[k] == t for k, t in zip(at.tolist(), tokens)), bool, len(tokens))
        return np.where(same, self.rank[at], -1)


def merged(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of least rank, the leftmost first, until none is left.

    Parts are linked by their first bytes' places; a heap holds the pairs that
    may merge, and an entry counts only while both its parts are as it saw them.
    """
    n = len(token)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
            if (r := ranks.get(token[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(token[h:k])) is not None:
            heapq.heappush(heap, (r, h, i, k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.known, self.hash, self.split = ranks, PerfectHash(ranks), Splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, tokens: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        pieces = [[r] if r >= 0 else merged(b, self.known) for b, r in zip(raw, self.hash.ranks(raw).tolist())]
        first = len(self.memo)
        self.memo.update(zip(tokens, range(first, first + len(tokens))))
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        flat = np.fromiter((x for p in pieces for x in p), np.int32, int(length.sum()))
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's ids end."""
        found = [self.split.findall(t) for t in texts]
        flat = [t for tokens in found for t in tokens]
        if len(self.memo) > MEMO:
            self.forget()
        if new := list(set(flat).difference(self.memo)):
            self.learn(new)
        piece = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        length = self.length[piece]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[piece] - (ends - length), length) + np.arange(total)
        last = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return self.flat[at], np.concatenate([[0], ends])[last]


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; it reads the vocabulary once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens on end by rank, their starts and lengths."""
    if path not in _decoders:
        ranks = read_ranks(path)
        by_rank = {r: t for t, r in ranks.items()}
        tokens = [by_rank.get(r, b"") for r in range(max(by_rank, default=-1) + 1)]
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        _decoders[path] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length
    return _decoders[path]


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts, some at a time, null as empty."""
    held, chars = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        chars += len(held[-1])
        if chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def bpe_encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """df with ids_col, array<int>: the ids of each whole text. path is a rank
    file that every executor has. An ids_col of df's own is replaced."""
    schema = T.StructType([f for f in df.schema.fields if f.name != ids_col] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    place = df.columns.index(text_col)
    kept = [k for k, c in enumerate(df.columns) if c != ids_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            done = 0
            for part in slices(batch.column(place)):
                ids, ends = coder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(done, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in kept] + [lists], names=schema.names)
                done += len(part)
        coder.forget()  # a worker lives on after its task
        release()

    return df.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col, binary: the bytes that the ids stand for; null ids
    give no bytes, and an id outside the vocabulary raises IndexError."""
    schema = T.StructType([f for f in df.schema.fields if f.name != bytes_col] + [T.StructField(bytes_col, T.BinaryType())])
    place = df.columns.index(ids_col)
    kept = [k for k, c in enumerate(df.columns) if c != bytes_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, length = decoder(path)
        for batch in batches:
            lists = batch.column(place)
            counts = np.asarray(lists.value_lengths().fill_null(0))
            values = np.asarray(lists.flatten())
            if len(values) and (values.min() < 0 or values.max() >= len(length)):
                raise IndexError("an id is not in the vocabulary")
            last, out = 0, []
            for n in counts.tolist():
                ids = values[last : last + n]
                last += n
                size = length[ids]
                at = np.repeat(start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out.append(flat[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(decode, schema)


def bpe_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = bpe_encode(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), path, pattern)
    ids = coded.select(
        id_col,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
    )
    return bpe_decode(ids, path).select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
