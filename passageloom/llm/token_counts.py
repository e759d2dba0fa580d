"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link, to the node of what
is left once the longest pieces in front are popped, and the number of pieces
popped on the way. A word's greedy longest-match length is then read in one
pass over its letters, without building a piece. Distinct words are counted
once by a worker, which remembers a bounded number of them.

A word is a run of anything but ASCII white space; the start mark is put before
it. A word that greedy matching can't cover is one unknown token.

Rows: a null or empty text has no words. Repeated rows are counted alike. Texts of any
length are taken whole. An empty table gives an empty one. Other columns, of whatever
names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, text_of

#: Words remembered by a worker.
MEMO = 500_000
MARK = "▁"
DEAD = -1


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The pieces of a model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not special(k)]


class Automaton:
    def __init__(self, vocabulary: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        piece = [False]
        for token in vocabulary:
            node = 0
            for c in token:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    piece.append(False)
                node = self.children[node][c]
            piece[node] = bool(token)
        self.link, self.popped = [DEAD] * len(piece), [0] * len(piece)
        layer = [0]
        while layer:  # breadth first: a node's links come from shorter strings
            below = []
            for parent in layer:
                for c, node in self.children[parent].items():
                    below.append(node)
                    if piece[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, n = self.link[parent], self.popped[parent]
                    while at != DEAD and c not in self.children[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at != DEAD:
                        self.link[node], self.popped[node] = self.children[at][c], n
            layer = below

    def count(self, word: str) -> int:
        """The number of pieces of greedy longest match, 0 if it can't be covered."""
        node, n = 0, 0
        for c in word:
            while c not in self.children[node]:
                n += self.popped[node]
                node = self.link[node]
                if node == DEAD:
                    return 0
            node = self.children[node][c]
        while node:
            n += self.popped[node]
            node = self.link[node]
            if node == DEAD:
                return 0
        return n


_automata: dict[str, Automaton] = {}


def token_counts(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    load: Callable[[str], Iterable[str]] = sentencepiece_vocabulary,
    mark: str = MARK,
) -> DataFrame:
    """df with n_words, n_tokens and n_unknown (long) of each whole text;
    columns of these names are replaced. load gives the vocabulary of the file
    at path, which every executor has."""
    names = ["n_words", "n_tokens", "n_unknown"]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T.LongType()) for n in names])
    place = df.columns.index(text_col)
    kept = [k for k, c in enumerate(df.columns) if c not in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _automata:
            _automata[path] = Automaton(load(path))
        auto, words, memo = _automata[path], re.compile(WORD), {}
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch.column(place).to_pylist()):
                split = words.findall(text or "")
                if not split:
                    continue
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(split).difference(memo):
                    memo[w] = auto.count(mark + w)
                pieces = np.fromiter(map(memo.__getitem__, split), np.int64, len(split))
                unknown = int((pieces == 0).sum())
                found[k] = len(split), int(pieces.sum()) + unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(x) for x in found.T], names=schema.names)

    return df.mapInArrow(count, schema)


def document_token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_tokens and n_unknown of each document."""
    counted = token_counts(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), path)
    return counted.select(id_col, "n_words", "n_tokens", "n_unknown")
