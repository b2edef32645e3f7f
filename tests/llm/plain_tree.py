"""The suffix tree in one place, which the distributed one is held against."""

import math

import numpy as np

from tarnwick.llm.suffixtree import DISCOUNT, NEXT_COST, STATE_COST


def words_of(text):
    return (text or "").encode("utf-8", "replace").lower().split()


class Tree:
    """The model in one place, which tests hold the tables against: states 1.. over the ids of words; 0 is the root.  Id 0 is the end, -1 any other word."""

    def __init__(self, ids: dict[bytes, int], root: np.ndarray):
        self.ids, self.root, self.span = ids, root, len(ids) + 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # by depth: keys of contexts, their states
        self.back, self.parent = np.zeros(1), np.zeros(1, np.int64)  # by state: log10 of the mass left to the suffix; the suffix
        self.keys, self.logs = np.zeros(0, np.int64), np.zeros(0)  # state * span + word: log10 probability

    def sequence(self, texts) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all tokens with an end after each text, the positions where texts end, and the words."""
        get, words = self.ids.get, [words_of(t) for t in texts]
        seq = np.array([i for ws in words for i in [*[get(w, -1) for w in ws], 0]], dtype=np.int64)
        return seq, np.cumsum([len(w) + 1 for w in words]), words

    def contexts(self, seq: np.ndarray, depth: int) -> np.ndarray:
        """For each token the key of the depth words before it in its text; -1 where there are not as many frequent ones."""
        key, ok, power = np.zeros(len(seq), np.int64), np.ones(len(seq), bool), 1
        for back in range(1, depth + 1):
            prev = np.full(len(seq), -1, np.int64)
            prev[back:] = seq[:-back]
            ok &= prev > 0  # neither another word nor an end, which would belong to the text before
            key += prev * power
            power *= self.span
        return np.where(ok, key, -1)

    def states(self, seq: np.ndarray) -> np.ndarray:
        """The state of the longest kept suffix before each token."""
        state = np.zeros(len(seq), np.int64)
        for depth, (keys, states) in enumerate(self.levels, 1):
            if len(keys):
                have = self.contexts(seq, depth)
                at = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
                state = np.where(keys[at] == have, states[at], state)
        return state

    def log10(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | state); for a word that is not frequent only the factors above its root probability."""
        out, state, open_ = np.zeros(len(word)), state.copy(), np.ones(len(word), bool)
        for _ in range(len(self.levels) + 1):
            if len(self.keys):
                key = np.where(open_ & (word >= 0) & (state > 0), state * self.span + word, -1)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                out += np.where(hit, self.logs[at], 0.0)
                open_ &= ~hit
            down = open_ & (state > 0)
            if not down.any():
                break
            out += np.where(down, self.back[state], 0.0)
            state = np.where(down, self.parent[state], state)
        return out + np.where(open_ & (word >= 0), self.root[word], 0.0)

    def grow(self, context: np.ndarray, count: np.ndarray, owner: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        """Add a level: context keys (sorted) with their counts; next words by index into context."""
        depth = len(self.levels) + 1
        inner = context % self.span ** (depth - 1) if depth > 1 else np.zeros_like(context)
        parent = np.zeros(len(context), np.int64)
        for d in range(1, depth):
            keys, states = self.levels[d - 1]
            if len(keys):
                have = inner % self.span**d
                at = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
                parent = np.where(keys[at] == have, states[at], parent)
        below = self.log10(parent[owner], word)
        p = (n - DISCOUNT) / count[owner]
        size = len(context)
        kept = np.bincount(owner, weights=p, minlength=size)
        kept_below = np.bincount(owner, weights=10.0**below, minlength=size)
        seen = np.bincount(owner, weights=n / count[owner], minlength=size)
        back = np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - kept_below, 1e-12))
        gain = np.bincount(owner, weights=n * (np.log10(p) - below), minlength=size) + count * np.maximum(1 - seen, 0) * back
        good = gain * math.log(10) > STATE_COST + NEXT_COST * np.bincount(owner, minlength=size)
        states = np.where(good, len(self.back) - 1 + np.cumsum(good), 0)
        self.levels.append((context[good], states[good]))
        self.back, self.parent = np.concatenate([self.back, back[good]]), np.concatenate([self.parent, parent[good]])
        use = good[owner]
        keys = np.concatenate([self.keys, states[owner][use] * self.span + word[use]])
        logs, order = np.concatenate([self.logs, np.log10(p)[use]]), np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]
