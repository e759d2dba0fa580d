"""Encoding and decoding by a merge-type piece vocabulary, as the sentencepiece
library does it.

A text gets a space in front, spaces become a mark, and its letters are the first
symbols. An agenda holds the adjacent symbols whose join is a piece, best score
first and the leftmost first among equals; each join that is still there when it
comes up is made, and its new neighbours enter the agenda. Symbols that are no
piece at the end are written as bytes.

No piece of such a vocabulary has the mark after another letter, so symbols never
join over the start of a word: texts are cut there, and a worker puts each distinct
word through the agenda once, remembering a bounded number. Short words have theirs in
arrays, many words a step (see joins), long ones in a heap. A vocabulary with other
pieces is taken text by text. Spark deals out the texts in Arrow batches; checked()
holds them against the library's own result.

Rows: a null text counts as empty, and an empty text has no ids. Repeated rows are
encoded alike. Texts of any length are taken whole; a single word of n letters costs
n log n. An empty table gives an empty one. A column named like a new one is
replaced by it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import release, text_of
from .joins import Joins

MARK = "▁"
#: Words remembered by a worker, and letters of a word that joins with others.
MEMO, SHORT = 150_000, 48


class Vocabulary:
    """Pieces of a model file that needs no normalising but the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        self.bytes = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if model.is_byte(k)}
        odd = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
        self.ids = {p: k for k, p in enumerate(self.pieces) if not odd(k)}
        self.score = {p: model.get_score(k) for p, k in self.ids.items()}
        if len(self.bytes) != 256 or any(model.is_unused(k) for k in range(n)):
            raise ValueError(f"{path} has no bytes to fall back on, or pieces that are not in use")
        odd_ones = " x  ﬁ①Ａé́　\t\n"
        if model.normalize(odd_ones) != MARK + odd_ones.replace(" ", MARK):
            raise ValueError(f"{path} normalises its texts")
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        spelt = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, k in self.bytes.items():
            spelt[k] = bytes([b])
        for k in range(n):
            if model.is_control(k) or model.is_unknown(k):
                spelt[k] = model.decode([k]).encode()
        self.spelt = spelt
        atoms = {c: n + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - set(self.ids)))}
        ranked = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.joins = Joins(self.ids, {p: ranked[s] for p, s in self.score.items()}, atoms)
        self.letter = np.full(0x110000, self.joins.none, np.int32)  # the symbol of each
        for c, k in (atoms | self.ids).items():
            if len(c) == 1:
                self.letter[ord(c)] = k


def joined(word: str, ids: dict[str, int], score: dict[str, float]) -> list[str]:
    """The symbols that are left of a word's letters when the agenda is empty."""
    n = len(word)
    if n < 2 or word in ids and n == 2:
        return [word] if n else []
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := score.get(word[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, j, k = heapq.heappop(agenda)
        if end[i] != j or j >= n or end[j] != k:
            continue  # one of the two has joined another since
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
            if (s := score.get(word[i : end[k]])) is not None:
                heapq.heappush(agenda, (-s, i, k, end[k]))
        if (h := before[i]) >= 0 and (s := score.get(word[h:k])) is not None:
            heapq.heappush(agenda, (-s, h, i, k))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


class PieceEncoder:
    def __init__(self, path: str):
        self.of = Vocabulary(path)
        # a word begins with all the marks before it; the last may be marks alone
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.of.by_word else re.compile("(?s).+")
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def long_word(self, word: str) -> list[int]:
        out, v = [], self.of
        for symbol in joined(word, v.ids, v.score):
            k = v.ids.get(symbol)
            out.extend([k] if k is not None else [v.bytes[b] for b in symbol.encode()])
        return out

    def short_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words on end, and how many each has."""
        v = self.of
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        ids, began, counts = v.joins.joined(v.letter[letters], np.fromiter(map(len, words), np.int64, len(words)), letters)
        if not (odd := ids >= len(v.pieces)).any():
            return ids, counts
        # letters that are no piece are written as their bytes
        c = began[odd].astype(np.int64)
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        wide = np.ones(len(ids), np.int64)
        wide[odd] = size
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - 1 - place  # bytes after this one
        bits = np.repeat(c, size) >> (6 * left)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[np.repeat(size, size)]
        raw = np.where(place == 0, np.where(np.repeat(size, size) == 1, bits, lead | bits), 0x80 | bits & 0x3F)
        out = np.repeat(ids, wide)
        out[np.repeat(odd, wide)] = np.array([v.bytes[b] for b in range(256)], np.int32)[raw]
        ends = np.cumsum(wide)[np.cumsum(counts) - 1]
        return out, np.diff(ends, prepend=0)

    def learn(self, words: list[str]) -> None:
        long = [w for w in words if len(w) > SHORT]
        short = [w for w in words if len(w) <= SHORT] if long else words
        first = len(self.memo)
        self.memo.update(zip(short + long, range(first, first + len(words))))
        ids, counts = self.short_words(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        made = list(map(self.long_word, long))
        length = np.concatenate([counts, np.fromiter(map(len, made), np.int64, len(made))])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids, np.fromiter((x for w in made for x in w), np.int32, sum(map(len, made)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's ids end."""
        find = self.words.findall
        found = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = [w for words in found for w in words]
        if len(self.memo) > MEMO:
            self.forget()
        if new := list(set(flat).difference(self.memo)):
            self.learn(new)
        word = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        length = self.length[word]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[word] - (ends - length), length) + np.arange(total)
        last = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return self.flat[at], np.concatenate([[0], ends])[last]


_encoders: dict[str, PieceEncoder] = {}
_spelt: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; it reads the vocabulary once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces on end by id, their starts and lengths."""
    if path not in _spelt:
        spelt = encoder(path).of.spelt
        length = np.fromiter(map(len, spelt), np.int64, len(spelt))
        _spelt[path] = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(length) - length, length
    return _spelt[path]


def with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[int]]:
    """df's schema with a column of that name at its end, and which columns stay."""
    kept = [k for k, c in enumerate(df.columns) if c != name]
    return T.StructType([df.schema.fields[k] for k in kept] + [T.StructField(name, kind)]), kept


def piece_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col, array<int>: the ids of each whole text, without begin or end.
    path is a model file that every executor has."""
    schema, kept = with_column(df, ids_col, T.ArrayType(T.IntegerType()))
    place = df.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
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


def piece_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text that the ids stand for, without the space in
    front. Null ids give an empty text, bytes that are no UTF-8 the replacement
    character each, and an id outside the vocabulary raises IndexError."""
    schema, kept = with_column(df, text_col, T.StringType())
    place = df.columns.index(ids_col)

    def text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="surrogateescape").translate({c: 0xFFFD for c in range(0xDC80, 0xDD00)})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, start, length = spelling(path)
        in_front = np.array([p.startswith(MARK) for p in encoder(path).of.pieces])
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
                ids = ids[length[ids] > 0]
                size = length[ids]
                at = np.repeat(start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out.append(text(flat[at][int(len(ids) > 0 and in_front[ids[0]]) :].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(decode, schema)


def checked(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", text_back: str = "decoded") -> DataFrame:
    """The rows whose ids or decoded text aren't the library's, with library_ids:
    none, if all is well."""
    schema, kept = with_column(df, "library_ids", T.ArrayType(T.IntegerType()))
    at = [df.columns.index(c) for c in (text_col, ids_col, text_back)]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).of.library
        for batch in batches:
            texts, ids, back = (batch.column(k).to_pylist() for k in at)
            want = library.encode([t or "" for t in texts], num_threads=1)
            wrong = [k for k, w in enumerate(want) if w != (ids[k] or []) or library.decode(w) != back[k]]
            rows = batch.take(pa.array(wrong, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(k) for k in kept] + [pa.array([want[k] for k in wrong], pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(held, schema)


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    coded = piece_encode(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), path)
    ids = coded.select(
        id_col,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
    )
    return piece_decode(ids, path).select(id_col, "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
