"""A whole automaton in plain Python, to hold the batches' walks against."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Automaton:
    """States are contexts of up to two words; state 0 is the empty one.

    `arcs`: state * size + word -> (log10 probability, next state). Where a state has no arc, its
    failure arc adds `fail_cost` and leads to `fail`; at state 0 any word has its own probability.
    """

    words: dict[int, int]  # key -> number
    size: int
    arcs: dict[int, tuple[float, int]]
    fail: list[int]
    fail_cost: list[float]
    start: list[int]  # by word: the state after it
    tokens: int
    types: int
    discount: float

    def single(self, count: int) -> float:
        """log10 probability of a token without context, with absolute discounting."""
        if not self.tokens:
            return -math.log10(self.types + 1)
        return math.log10((max(count - self.discount, 0) + min(self.discount * self.types, self.tokens) / (self.types + 1)) / self.tokens)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def walk(self, numbers: list[int], singles: list[float]) -> float:
        """One pass over a text's tokens from left to right, carrying the state."""
        total, state, arcs, size, fail, cost, start = 0.0, 0, self.arcs, self.size, self.fail, self.fail_cost, self.start
        for number, single in zip(numbers, singles, strict=True):
            if number < 0:
                while state:
                    total += cost[state]
                    state = fail[state]
                total += single
                continue
            while state:
                arc = arcs.get(state * size + number)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += cost[state]
                state = fail[state]
            else:
                total += single
                state = start[number]
        return total


def build_automaton(keys: dict[int, int], pairs: dict[tuple[int, int], int], triples: dict[tuple[int, int, int], int], total: int, types: int, discount: float, cut: float = 0.75) -> Automaton:
    """Interpolated absolute discounting; `keys`: word key -> count, n-grams by the words' numbers."""
    numbers = {k: i for i, k in enumerate(sorted(keys))}
    count = [keys[k] for k in sorted(keys)]
    size = max(1, len(numbers))
    a = Automaton(numbers, size, {}, [0], [0.0], [0] * size, total, types, discount)
    single = [10 ** a.single(c) for c in count]
    after: dict[int, list[tuple[int, int]]] = {}
    for (u, v), n in pairs.items():
        after.setdefault(u, []).append((v, n))
    share: dict[tuple[int, int], float] = {}
    rest: dict[int, float] = {}
    for u, seen in sorted(after.items()):
        a.start[u] = len(a.fail)
        a.fail.append(0)
        rest[u] = 1 - sum(max(n - cut, 0) for _, n in seen) / count[u]
        a.fail_cost.append(math.log10(max(rest[u], 1e-9)))
        for v, n in seen:
            share[u, v] = max(n - cut, 0) / count[u] + rest[u] * single[v]
    state_of: dict[tuple[int, int], int] = {}
    later: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (u, v, w), n in triples.items():
        if (u, v) in share:
            later.setdefault((u, v), []).append((w, n))
    for (u, v), seen in sorted(later.items()):
        state_of[u, v] = len(a.fail)
        a.fail.append(a.start[v])
        left = 1 - sum(max(n - cut, 0) for _, n in seen) / pairs[u, v]
        a.fail_cost.append(math.log10(max(left, 1e-9)))
    for (u, v), p in share.items():
        a.arcs[a.start[u] * size + v] = (math.log10(p), state_of.get((u, v), a.start[v]))
    for (u, v), seen in later.items():
        left = 10 ** a.fail_cost[state_of[u, v]]
        for w, n in seen:
            lower = share.get((v, w), rest.get(v, 1.0) * single[w])
            a.arcs[state_of[u, v] * size + w] = (math.log10(max(n - cut, 0) / pairs[u, v] + left * lower), state_of.get((v, w), a.start[w]))
    return a
