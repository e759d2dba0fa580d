"""Joining the symbols of many words at once, best pair first.

Each word has an agenda, the places of its adjacent pairs that join to a token, with
their order: a row of numbers. In a step every word with a pair left makes its best
join, the leftmost among equals, and the two pairs beside it are ordered anew. Words
take their steps together, in arrays, so that a step costs no Python per word. What a
word of n symbols costs grows with n squared; long words are for a heap.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

NEVER = np.iinfo(np.int32).max


class Joins:
    """tokens: the number of each token; order: the order in which they are made, the
    least first. atoms are symbols that are no token but may become part of one."""

    def __init__(self, tokens: Mapping, order: Mapping, atoms: Mapping | None = None):
        symbols = dict(atoms or {}) | dict(tokens)
        self.width = max(symbols.values(), default=0) + 2  # the last is no symbol
        self.none = self.width - 1
        found = {}
        for token, made in tokens.items():
            for k in range(1, len(token)):
                left, right = symbols.get(token[:k]), symbols.get(token[k:])
                if left is not None and right is not None:
                    found[left * self.width + right] = (order[token], made)
        self.keys = np.array(sorted(found), np.int64)
        self.first, self.made = (np.array([found[k][x] for k in self.keys.tolist()], np.int32) for x in (0, 1))

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of pairs, NEVER where they don't join, and what they make."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.first[at], NEVER), self.made[at]

    def joined(self, symbols: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of words on end, after all joins, with the letter that each
        began with, and how many each word has. counts are at least one."""
        word = np.repeat(np.arange(len(counts)), counts)
        symbols, letters = symbols.astype(np.int32), letters.astype(np.int32)
        order, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        order[inside], made[inside] = self.looked_up(symbols[inside], symbols[inside + 1])
        done = []
        while len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(order, starts)
            size = np.diff(np.append(starts, len(word)))
            if (best == NEVER).any():
                over = np.repeat(best == NEVER, size)
                done.append((word[over], symbols[over], letters[over]))
                word, symbols, letters, order, made = (x[~over] for x in (word, symbols, letters, order, made))
                best, size = best[best != NEVER], size[best != NEVER]
                if not len(word):
                    break
            hit = np.flatnonzero(order == np.repeat(best, size))
            at = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            symbols[at] = made[at]
            keep = np.ones(len(word), bool)
            keep[at + 1] = False
            word, symbols, letters, order, made = (x[keep] for x in (word, symbols, letters, order, made))
            at = at - np.arange(len(at))
            order[at] = NEVER
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near + 1 < len(word)]
            near = near[word[near] == word[near + 1]]
            order[near], made[near] = self.looked_up(symbols[near], symbols[near + 1])
        if not done:
            return symbols, letters, counts
        word, symbols, letters = (np.concatenate(x) for x in zip(*done))
        place = np.argsort(word, kind="stable")
        return symbols[place], letters[place], np.bincount(word, minlength=len(counts))
