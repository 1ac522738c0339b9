"""Cutting-stock patterns by column generation, over a histogram of piece lengths.

The linear program covers every length class with patterns (several classes that
together fit one sequence, cost 1) or by cutting (cost: the share of a sequence
that the piece fills, plus a small price for the cut).  A knapsack dynamic program
over the current dual prices finds new patterns; the program ends when its bound
is within ``gap``.  Sizes depend on the sequence length alone, never on how many
documents there are, so it runs on the driver.
"""

from __future__ import annotations

import numpy as np


def class_size(length: np.ndarray, exact_below: int = 256) -> np.ndarray:
    """The room that a piece of ``length`` takes in a pattern.

    Exact up to ``exact_below``; above it lengths are rounded up to a multiple of
    2, 4, 8, ... so that a class is never more than 1/128 wider than its piece.
    """
    length = np.asarray(length, np.int64)
    bits = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    width = np.left_shift(1, np.maximum(0, bits - int(np.log2(exact_below))))
    return -(-length // width) * width


class _Master:
    """Revised simplex on equality rows; the cutting columns are the first basis."""

    def __init__(self, demand: np.ndarray, cut_cost: np.ndarray) -> None:
        self.rows = len(demand)
        self.demand = demand.astype(float)
        self.columns = [{i: 1} for i in range(self.rows)]  # of the basis, by row
        self.cost = cut_cost.copy()
        self.is_cut = np.ones(self.rows, bool)
        self.inverse = np.eye(self.rows)
        self.x = self.demand.copy()

    def duals(self) -> np.ndarray:
        return self.cost @ self.inverse

    def enter(self, column: dict[int, int], cost: float, cut: bool = False) -> bool:
        rows = np.fromiter(column, np.int64)
        amounts = np.fromiter(column.values(), float)
        direction = self.inverse[:, rows] @ amounts
        ok = direction > 1e-9
        if not ok.any():
            return False
        ratio = np.full(self.rows, np.inf)
        ratio[ok] = self.x[ok] / direction[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        self.x -= step * direction
        self.x[out] = step
        np.maximum(self.x, 0, out=self.x)
        pivot = self.inverse[out] / direction[out]
        self.inverse -= np.outer(direction, pivot)
        self.inverse[out] = pivot
        self.columns[out], self.cost[out], self.is_cut[out] = column, cost, cut
        return True


def knapsack(sizes: np.ndarray, prices: np.ndarray, limit: np.ndarray, capacity: int,
             ) -> tuple[dict[int, int], float]:
    """The dearest pattern that fits, and its price; class i is taken ``limit[i]`` times at most.

    Each class becomes bundles of 1, 2, 4, ... pieces, so that every step is one pass
    over all rooms at once.
    """
    bundles = []
    for i in np.flatnonzero((prices > 1e-12) & (limit > 0)).tolist():
        left, n = min(int(limit[i]), capacity // int(sizes[i])), 1
        while left > 0:
            take = min(n, left)
            bundles.append((i, take))
            left, n = left - take, n * 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), bool)
    for k, (i, n) in enumerate(bundles):
        room = int(sizes[i]) * n
        gain = best[:-room] + prices[i] * n
        better = gain > best[room:] + 1e-12
        taken[k, room:] = better
        best[room:][better] = gain[better]
    pattern: dict[int, int] = {}
    room = capacity
    for k in range(len(bundles) - 1, -1, -1):
        if taken[k, room]:
            i, n = bundles[k]
            pattern[i] = pattern.get(i, 0) + n
            room -= int(sizes[i]) * n
    return pattern, float(best[capacity])


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Fill sequences as full as possible from what is left, each pattern until a class runs out.

    Long pieces, which are harder to place, are worth slightly more than their length.
    """
    left = demand.copy()
    prices = (sizes / capacity) * (1 + 0.02 * sizes / capacity)
    found = []
    while left.any():
        pattern, _ = knapsack(sizes, prices, left, capacity)
        if not pattern:
            break
        times = min(int(left[i]) // n for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= n * times
        found.append(pattern)
    return found


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, cut_tokens: int = 8,
                  gap: float = 1e-3, rounds: int = 80,
                  pivots: int = 2_000) -> list[tuple[dict[int, int], int]]:
    """Whole-numbered patterns ``(class -> pieces, sequences)`` that never exceed ``demand``.

    ``cut_tokens`` is the padding that avoiding one cut is worth.  What the patterns
    leave over is for the caller to cut.  The search ends at the bound, or after
    ``rounds`` knapsacks or ``pivots`` exchanges; any basis is a whole plan.
    """
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    if not len(sizes):
        return []
    cut_cost = (sizes + cut_tokens) / capacity
    master = _Master(demand, cut_cost)
    for pattern in _first_patterns(sizes, demand, capacity):
        prices = master.duals()
        if sum(prices[i] * n for i, n in pattern.items()) > 1 + 1e-9:
            master.enter(pattern, 1.0)
    searches = 0
    for _ in range(pivots):
        duals = master.duals()
        worst = int((duals - cut_cost).argmax())
        if duals[worst] > cut_cost[worst] + 1e-7:
            if not master.enter({worst: 1}, float(cut_cost[worst]), cut=True):
                break
            continue
        prices = np.minimum(duals, cut_cost)
        pattern, price = knapsack(sizes, prices, demand, capacity)
        value = float(master.cost @ master.x)
        bound = float(prices @ demand) / max(price, 1.0)
        searches += 1
        if (price <= 1 + 1e-7 or value - bound <= gap * value or searches >= rounds
                or not master.enter(pattern, 1.0)):
            break
    return _rounded(master, demand)


def _rounded(master: _Master, demand: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Round down, then apply patterns once more, largest remainder first, while they fit."""
    chosen = [(float(x), c) for x, c, cut in zip(master.x, master.columns, master.is_cut) if not cut and x > 1e-9]
    left = demand.copy()
    plan: dict[int, int] = {}

    def apply(k: int, times: int) -> None:
        column = chosen[k][1]
        times = min([times, *(int(left[i]) // n for i, n in column.items())])
        if times > 0:
            plan[k] = plan.get(k, 0) + times
            for i, n in column.items():
                left[i] -= n * times

    for k, (x, _) in enumerate(chosen):
        apply(k, int(x + 1e-6))
    for k in sorted(range(len(chosen)), key=lambda k: (int(chosen[k][0]) - chosen[k][0], k)):
        apply(k, 1)
    return [(chosen[k][1], n) for k, n in sorted(plan.items())]
