"""Vantage-point trees over 64-bit fingerprints under Hamming distance (numpy only; no Spark here).

An inner node holds a vantage fingerprint and a radius: those within the radius go to its left child, the
others to its right.  By the triangle inequality a pair at distance r or less that is parted by a node has
its inner member in the shell (radius - r, radius]; such members go to both children.  Hence any two
fingerprints at distance r or less meet in some leaf.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(fps: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that buy most balance for the fewest boundary members; None if none parts the set."""
    best, found = math.inf, None
    look = fps if len(fps) <= 4096 else fps[rng.integers(0, len(fps), 4096)]
    for v in look[rng.integers(0, len(look), 6)]:
        inside = np.bincount(distance(look, v), minlength=65).cumsum() / len(look)
        for t in range(1, 64):
            q, shell = inside[t], inside[t] - (inside[t - radius] if t >= radius else 0.0)
            if 0.05 <= q <= 0.95 and shell < 0.85 - q + q * 0.5:
                bits = -(q * math.log2(q) + (1 - q) * math.log2(1 - q))
                cost = math.log2(1 + shell) / bits
                if cost < best and max(q, 1 - q + shell) < 0.95:
                    best, found = cost, (v, t)
    return found


class Tree:
    """The upper part of the tree, grown on a sample; its leaves are the shards."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 11):
        self.radius, self.nodes, rng = radius, [None], np.random.default_rng(seed)  # None: a leaf
        self.leaves, todo = 1, [(-len(sample), 0, sample)]
        while todo and self.leaves < leaves:
            size, at, members = heapq.heappop(todo)  # the largest; numbers of nodes differ, so members are never compared
            if -size < 8 or (cut := _split(members, radius, rng)) is None:
                continue
            d = distance(members, cut[0])
            left, right = members[d <= cut[1]], members[d > cut[1] - radius]
            low, high = len(self.nodes), len(self.nodes) + 1
            self.nodes[at] = (cut[0], cut[1], low, high)
            self.nodes += [None, None]
            heapq.heappush(todo, (-len(left), low, left))
            heapq.heappush(todo, (-len(right), high, right))
            self.leaves += 1

    def route(self, fps: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, its members): each member's own leaf and those that it visits across a boundary."""
        out, todo = [], [(0, fps)]
        while todo:
            at, members = todo.pop()
            if not len(members):
                continue
            if self.nodes[at] is None:
                out.append((at, members))
                continue
            v, t, low, high = self.nodes[at]
            d = distance(members, v)
            todo += [(low, members[d <= t]), (high, members[d > t - self.radius])]
        return out


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over whole arrays: labels point to smaller positions and stay flat."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (flat := labels[labels]).tobytes() != labels.tobytes():
            labels = flat


def links(fps: np.ndarray, radius: int, small: int = 96, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints: pairs (member, its class's first member) spanning all links within radius."""
    fps = np.sort(fps)
    labels, rng = np.arange(len(fps)), np.random.default_rng(seed)
    todo, pi, pj, held = [np.arange(len(fps))], [], [], 0
    while todo:
        idx = todo.pop()
        cut = _split(fps[idx], radius, rng) if len(idx) > small else None
        if cut is not None:
            d = distance(fps[idx], cut[0])
            todo += [idx[d <= cut[1]], idx[d > cut[1] - radius]]
            continue
        for at in range(0, len(idx), 256):  # a set that cannot be parted is compared in blocks of bounded size
            rows = idx[at : at + 256]
            i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[idx[at:]][None, :]) <= radius)
            keep = j > i
            if keep.any():
                pi.append(rows[i[keep]])
                pj.append(idx[at:][j[keep]])
                held += int(keep.sum())
            if held > 500_000:
                labels, pi, pj, held = _merge(labels, np.concatenate(pi), np.concatenate(pj)), [], [], 0
    if held:
        labels = _merge(labels, np.concatenate(pi), np.concatenate(pj))
    moved = np.nonzero(labels != np.arange(len(fps)))[0]
    return fps[moved], fps[labels[moved]]
