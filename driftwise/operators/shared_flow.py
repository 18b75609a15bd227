"""Flows between rows that share values, of the greatest agreement, without a table of all pairs."""

from __future__ import annotations

import numpy as np


def patterns(values: np.ndarray, is_left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of values that some row of each side has, each with all that its rows agree in: how many values it has beyond
    those that all rows agree in, how many rows have it, and these rows, one set after the other.

    Any two rows of different sides that agree in something have a set of just the values that they agree in. Closed sets are
    extended by a later field at a time and left where the closure takes an earlier one, so each is found once."""
    whole = (values == values[0]).all(axis=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def extend(rows: np.ndarray, group: np.ndarray, fixed: np.ndarray, after: int) -> None:
        for f in range(after, values.shape[1]):
            free = ~fixed[:, f]
            if not free.any():
                continue
            at, of, was = rows[free], group[free], fixed[free]
            order = np.lexsort((at, values[at, f], of))
            at, of, was = at[order], of[order], was[order]
            mine = values[at]
            start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (mine[1:, f] != mine[:-1, f])])
            size = np.diff(np.r_[start, len(at)])
            lefts = np.add.reduceat(is_left[at].astype(np.int64), start)
            alike = np.minimum.reduceat(mine, start) == np.maximum.reduceat(mine, start)
            kept = (lefts > 0) & (lefts < size) & ~(alike & ~was[start])[:, :f].any(axis=1)
            if not kept.any():
                continue
            at, size, alike = at[np.repeat(kept, size)], size[kept], alike[kept]
            found.append((alike.sum(axis=1) - whole.sum(), size, at))
            of = np.repeat(np.arange(len(size)), size)
            extend(at, of, alike[of], f + 1)

    n = len(values)
    extend(np.arange(n), np.zeros(n, dtype=np.int64), np.tile(whole, (n, 1)), 0)
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate([x[i] for x in found]).astype(np.int64) for i in range(3))


def shared_flow(values: np.ndarray, is_left: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How much goes from which row of the left to which of the right (positions in ``values``), at the greatest agreement
    that there can be in all. Rows agree in fields whose values, a column each, are equal; ``amount`` is what a row has or takes.
    What agrees in nothing but what all rows agree in doesn't flow; whatever is left may be paired in any way.

    Flow goes through the sets of values that rows share, so memory grows with the rows and their sets, not with pairs. A unit
    gains an integer, at most the number of fields, and gains never rise along cheapest ways, so there is one stage for each
    gain, from the greatest down: all that can flow at that gain (Dinic's method on the arcs whose potentials allow no more),
    going back over flows that it redirects, then potentials move by one. After the stage of gain 1 no way gains anything."""
    weight, size, member = patterns(values, is_left)
    n, pattern = len(values), np.repeat(np.arange(len(weight)), size)
    node, out = n + pattern, is_left[member]
    potential = np.r_[np.zeros(n, dtype=np.int64), -weight]
    np.minimum.at(potential, member[~out], -weight[pattern[~out]])
    end = min(-weight, default=0)
    flow, rest = np.zeros(len(member), dtype=np.int64), amount.astype(np.int64)
    # arcs run from left rows to sets and from sets to right rows
    tail, head, gain = np.where(out, member, node), np.where(out, node, member), np.where(out, weight[pattern], 0)
    while end < 0 and rest[is_left].any() and rest[~is_left].any():
        tight = np.flatnonzero(potential[tail] - gain == potential[head])
        tails, heads = np.r_[tail[tight], head[tight]], np.r_[head[tight], tail[tight]]
        order = np.argsort(tails, kind="stable")
        first = np.searchsorted(tails[order], np.arange(len(potential) + 1))
        to, arc, forth = heads[order], np.r_[tight, tight][order], order < len(tight)
        ending = np.zeros(len(potential), dtype=bool)
        while True:
            ending[:n] = ~is_left & (rest > 0) & (potential[:n] == end)
            level, reached = _levels(np.flatnonzero(is_left & (rest > 0)), ending, first, to, arc, forth, flow)
            if not reached:
                break
            # views give Python's integers and take no more memory
            _blocking(*map(memoryview, (np.flatnonzero(is_left & (rest > 0)), ending, level, first[:-1].copy(), first, to, arc, forth, flow, rest)))
        potential[level < 0] += 1
        end += 1
    return _pairs(member, out, pattern, flow, n)


def _levels(starts, ending, first, to, arc, forth, flow) -> tuple[np.ndarray, bool]:
    """How many arcs each node is from a start (-1: no way, or farther than the nearest end), and whether there is an end."""
    level, at, depth = np.full(len(first) - 1, -1), starts, 0
    level[at] = 0
    while len(at):
        if ending[at].any():
            return level, True
        depth += 1
        count = first[at + 1] - first[at]
        arcs = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        near = to[arcs[forth[arcs] | (flow[arc[arcs]] > 0)]]
        at = np.unique(near[level[near] < 0])
        level[at] = depth
    return level, False


def _blocking(starts, ending, level, look, first, to, arc, forth, flow, rest) -> None:
    """Adds flow along ways that get one level farther with each arc, until every such way is blocked; ``look`` says from which
    arc of a node on."""
    for start in starts:
        while rest[start]:
            way, u = [], start
            while not (ending[u] and rest[u]):
                p, last, wanted = look[u], first[u + 1], level[u] + 1
                while p < last and not (level[to[p]] == wanted and (forth[p] or flow[arc[p]])):
                    p += 1
                look[u] = p
                if p < last:
                    way.append((u, p))
                    u = to[p]
                    continue
                level[u] = -1
                if not way:
                    break
                u, p = way.pop()
                look[u] = p + 1
            if not way:
                break
            most = min([rest[start], rest[u], *(flow[arc[p]] for _, p in way if not forth[p])])
            for _, p in way:
                flow[arc[p]] += most if forth[p] else -most
            rest[start] -= most
            rest[u] -= most


def _pairs(member, out, pattern, flow, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flows into and out of sets as flows between rows: sets take in and give out as much, so both run along one line."""
    ends = []
    for side in (out, ~out):
        mine = np.flatnonzero(side & (flow > 0))
        mine = mine[np.argsort(pattern[mine], kind="stable")]
        ends.append((member[mine], np.cumsum(flow[mine])))
    (left, a), (right, b) = ends
    marks = np.union1d(a, b)
    amount = np.diff(np.r_[0, marks])
    pair, where = np.unique(left[np.searchsorted(a, marks)] * n + right[np.searchsorted(b, marks)], return_inverse=True)
    total = np.zeros(len(pair), dtype=np.int64)
    np.add.at(total, where, amount)
    return pair // n, pair % n, total
