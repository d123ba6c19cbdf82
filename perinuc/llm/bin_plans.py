"""Plans for filling bins of whole-numbered size, from counts of lengths alone.

Everything here works on tables whose size is bounded by the bin size, however many pieces there are: counts by length,
groups of large lengths, configurations of a bin, and counts by free room.  A plan is a list of rules; a rule sends a
stretch of ranks (pieces in falling length) to a stretch of bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

# simplex steps stop when the bins of the plan are this close to the proven bound
CLOSE = 1e-4
# steps after which the inverse of the basis is computed anew
FRESH = 50
HAIR = 1e-9


@dataclass(frozen=True)
class Rule:
    """Pieces of ranks ``first`` to ``stop`` go to bins from ``bin`` on, ``each`` to a bin."""

    first: int
    stop: int
    bin: int
    each: int


def groups(lengths: Sequence[int], counts: Sequence[int], wanted: int) -> tuple[list[int], list[int]]:
    """Linear grouping: lengths in falling order are cut into ``wanted`` groups of equal cardinality.

    Each group is rounded up to its largest length; groups of the same largest length are one.  Returns the rounded
    lengths and how many pieces each has.
    """
    total = sum(counts)
    step = max(1, -(-total // wanted))
    upto = np.cumsum(counts)
    heads = [int(lengths[i]) for i in np.searchsorted(upto, np.arange(0, total, step), side="right")]
    sizes = sorted(set(heads), reverse=True)
    demand = [step * heads.count(s) for s in sizes]
    if demand:
        demand[-1] -= step * len(heads) - total
    return sizes, demand


class Knapsack:
    """Copies of each size that fit into a bin and are worth most together, one more piece per round."""

    def __init__(self, sizes: np.ndarray, room: int):
        self.sizes, self.room, self.rounds = sizes, room, room // int(sizes.min())
        left = np.arange(room + 1)[:, None] - sizes[None, :]
        # a size that does not fit looks at one place more, where nothing is worth anything
        self.left = np.where(left >= 0, left, room + 1)

    def best(self, worth: np.ndarray) -> tuple[np.ndarray, float]:
        rooms = np.arange(self.room + 1)
        best, picks = np.append(np.zeros(self.room + 1), -np.inf), []
        for _ in range(self.rounds):
            value = best[self.left]
            value += worth
            pick = value.argmax(axis=1)
            more = value[rooms, pick]
            better = more > best[:-1] + HAIR
            if not better.any():
                break
            picks.append(np.where(better, pick, -1))
            best[:-1] = np.where(better, more, best[:-1])
        copies, at = np.zeros(len(self.sizes)), self.room
        for pick in reversed(picks):
            if pick[at] >= 0:
                copies[pick[at]] += 1
                at -= int(self.sizes[pick[at]])
        return copies, float(best[self.room])


def configurations(sizes: Sequence[int], demand: Sequence[int], room: int) -> list[tuple[np.ndarray, int]]:
    """Bins that meet the demand: a few configurations, each with the number of bins filled so.

    Column generation on the relaxed problem, a knapsack per step; the whole parts of its solution are kept, and the few
    pieces beyond them go where they fit best, in falling size.
    """
    size, need = np.array(sizes, np.int64), np.array(demand, float)
    if not len(size):
        return []
    basis = np.diag((room // size).astype(float))
    inverse, step, knapsack = np.diag(1 / np.diag(basis)), 0, Knapsack(size, room)
    while True:
        x, worth = inverse @ need, inverse.sum(axis=0)
        column, value = knapsack.best(np.maximum(worth, 0.0))
        # worth / value prices no bin above one, so it bounds the bins that any plan needs
        if value <= 1 + HAIR or x.sum() * (1 - CLOSE) <= worth @ need / value:
            break
        along = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > HAIR, np.maximum(x, 0.0) / along, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        step += 1
        if step % FRESH == 0:
            inverse = np.linalg.inv(basis)
    x = np.linalg.solve(basis, need)
    whole = np.floor(np.maximum(x, 0.0) + 1e-7).astype(np.int64)
    found: dict[tuple[int, ...], int] = {}
    left = np.array(demand, np.int64)
    for j in np.flatnonzero(whole):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        times = min(int(whole[j]), int((left[used] // pattern[used]).min()))
        if times:
            found[tuple(pattern)] = found.get(tuple(pattern), 0) + times
            left -= pattern * times
    # what the whole parts leave: at most about one bin for each of the few sizes
    bins: list[tuple[int, np.ndarray]] = []
    for i in range(len(size)):
        for _ in range(int(left[i])):
            near = [b for b, (free, _) in enumerate(bins) if free >= size[i]]
            at = min(near, key=lambda b: bins[b][0], default=len(bins))
            if at == len(bins):
                bins.append((room, np.zeros(len(size), np.int64)))
            free, pattern = bins[at]
            pattern[i] += 1
            bins[at] = (free - int(size[i]), pattern)
    for _, pattern in bins:
        found[tuple(pattern)] = found.get(tuple(pattern), 0) + 1
    return [(np.array(p), n) for p, n in found.items()]


def large_rules(demand: Sequence[int], plan: list[tuple[np.ndarray, int]]) -> tuple[list[Rule], int]:
    """Rules for the ranks of the large pieces, group by group, and the number of bins."""
    starts = np.concatenate([[0], np.cumsum(demand)]).astype(int)
    at, bins, rules = starts[:-1].tolist(), 0, []
    for pattern, times in plan:
        for g in np.flatnonzero(pattern):
            each = int(pattern[g])
            rules.append(Rule(at[g], at[g] + each * times, bins, each))
            at[g] += each * times
        bins += times
    return sorted(rules, key=lambda r: r.first), bins


def best_fit(lengths: Sequence[int], counts: Sequence[int], room: dict[int, int], size: int) -> tuple[list[tuple[Rule, int]], int]:
    """Best fit of small pieces in falling length, all bins with equal free room at once.

    ``room`` counts the bins by free room.  Rules name bins by their place among those that had the same room at first
    (the second item, 0 for new bins).  Also returns the number of new bins.
    """
    # stretches of bins by their free room now: (room at first, from, to)
    now: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in room.items() if r and n}
    rank, new, rules = 0, 0, []
    for length, count in zip(lengths, counts):
        while count:
            free = min((r for r in now if r >= length), default=0)
            if not free:
                # new bins for as many as fit; the last of them may stay open
                made = -(-count // (size // length))
                now.setdefault(size, []).append((0, new, new + made))
                new += made
                continue
            first, a, b = now[free].pop()
            took = min(count, b - a)
            if took < b - a:
                now[free].append((first, a + took, b))
            if not now[free]:
                del now[free]
            rules.append((Rule(rank, rank + took, a, 1), first))
            rank, count = rank + took, count - took
            if free > length:
                now.setdefault(free - length, []).append((first, a, a + took))
    return rules, new
