"""Minimum cuts of many small banded graphs at once, in numpy.

The nodes of all graphs lie in one row; a node may have edges to its next and next but one
neighbour.  Node costs have been cancelled against each other, so a node has either an excess (from
the source) or a residual capacity (to the sink).  Flow is pushed along shortest residual paths:
distances to the sink are recomputed for all nodes, then every node with an excess pushes to
neighbours one step nearer.  Nodes from which the sink can no longer be reached are the source's
side of a minimum cut.  Capacities are integers, so the result is exact.

Graphs of over ``LONG`` nodes, and those still at work after ``ROUNDS`` rounds, are solved alone with a
queue of active nodes (push and relabel, farthest first), so that no graph holds up the others: both ways give the same cut.
"""

from __future__ import annotations

from collections import deque

import numpy as np

LONG, ROUNDS = 256, 12

_FAR = np.int32(1 << 20)


def source_side(excess: np.ndarray, edge1: np.ndarray, edge2: np.ndarray) -> np.ndarray:
    """True for nodes on the source's side.

    excess: what a node would pay for the sink's side minus what it would pay for the source's.
    edge1[i], edge2[i]: capacity, in both directions, between i and i + 1 or i + 2 (0 where there is no edge).
    """
    n = len(excess)
    if not n:
        return np.zeros(0, bool)
    edge1, edge2 = np.asarray(edge1), np.asarray(edge2)
    graph = _graphs(edge1[: n - 1] > 0, edge2[: max(n - 2, 0)] > 0, n)
    size = np.bincount(graph)[graph]
    if (size > LONG).any():
        out = np.zeros(n, bool)
        short = size <= LONG
        out[short] = source_side(excess[short], edge1[short], edge2[short])
        first = np.flatnonzero(np.r_[True, graph[1:] != graph[:-1]] & ~short)
        for a in first:
            b = a + size[a]
            e = excess[a:b]
            out[a:b] = alone(np.maximum(e, 0), np.maximum(-e, 0), edge1[a : b - 1], edge1[a : b - 1], edge2[a : b - 2], edge2[a : b - 2])
        return out
    have = np.maximum(excess, 0).astype(np.int64)
    sink = np.maximum(-excess, 0).astype(np.int64)
    out = np.zeros(n, bool)
    cap = {1: edge1[: n - 1].astype(np.int64), -1: edge1[: n - 1].astype(np.int64), 2: edge2[: max(n - 2, 0)].astype(np.int64), -2: edge2[: max(n - 2, 0)].astype(np.int64)}
    where = np.arange(n)
    for turn in range(1 << 60):
        m = len(where)
        dist = _distances(sink, cap, m)
        stuck = dist == _FAR
        live = (have > 0) & ~stuck
        if not live.any():
            out[where] = stuck
            return out
        if turn == ROUNDS:
            graph = _graphs(cap[1] + cap[-1] > 0, cap[2] + cap[-2] > 0, m)
            out[where] = stuck
            for g in np.unique(graph[live]):
                a, b = np.searchsorted(graph, [g, g + 1])
                out[where[a:b]] = alone(have[a:b], sink[a:b], cap[1][a : b - 1], cap[-1][a : b - 1], cap[2][a : max(b - 2, a)], cap[-2][a : max(b - 2, a)])
            return out
        for _ in range(4):
            give = np.where(dist == 1, np.minimum(have, sink), 0)
            have -= give
            sink -= give
            for d in (1, -1, 2, -2):
                k = abs(d)
                if m <= k:
                    continue
                a, b = (slice(0, m - k), slice(k, m)) if d > 0 else (slice(k, m), slice(0, m - k))
                flow = np.where((dist[a] == dist[b] + 1) & (dist[b] < _FAR), np.minimum(have[a], cap[d]), 0)
                have[a] -= flow
                have[b] += flow
                cap[d] -= flow
                cap[-d] += flow
        # graphs in which nothing moves any more leave the row
        done = _idle(have, dist, edge_breaks=(cap[1] + cap[-1] == 0), m=m, cap2=cap[2] + cap[-2])
        if done.sum() * 2 > m:
            out[where[done]] = (_distances(sink, cap, m) == _FAR)[done]
            keep = ~done
            where, have, sink = where[keep], have[keep], sink[keep]
            pos = np.flatnonzero(keep)
            new = {}
            for d in (1, -1, 2, -2):
                k = abs(d)
                full = np.zeros(m, np.int64)
                full[: max(m - k, 0)] = cap[d]
                got = full[pos]
                ok = np.zeros(len(pos), bool)
                if len(pos) > k:
                    ok[: len(pos) - k] = pos[k:] - pos[: len(pos) - k] == k
                new[d] = np.where(ok, got, 0)[: max(len(pos) - k, 0)]
            cap = new
            if not len(where):
                return out


def _distances(sink: np.ndarray, cap: dict[int, np.ndarray], m: int) -> np.ndarray:
    """Residual distance to the sink, _FAR where there is no way."""
    dist = np.where(sink > 0, np.int32(1), _FAR)
    while True:
        before = dist.copy()
        for d in (1, -1, 2, -2):
            k = abs(d)
            if m <= k:
                continue
            a, b = (slice(0, m - k), slice(k, m)) if d > 0 else (slice(k, m), slice(0, m - k))
            np.minimum(dist[a], np.where(cap[d] > 0, dist[b] + 1, _FAR), out=dist[a])
        if (dist == before).all():
            return dist


def _graphs(one: np.ndarray, two: np.ndarray, m: int) -> np.ndarray:
    """The number of each node's graph; one, two: whether there are edges to the next node and the next but one."""
    joined = np.zeros(m, bool)
    joined[1:] = one
    joined[1 : m - 1] |= two
    joined[2:] |= two
    return np.cumsum(~joined) - 1 + joined[0]


def _idle(have, dist, edge_breaks, m, cap2):
    """Nodes of graphs (maximal runs joined by edges) without any excess that can still move."""
    graph = _graphs(~edge_breaks, cap2 > 0, m)
    busy = np.bincount(graph, weights=((have > 0) & (dist < _FAR)).astype(float), minlength=graph[-1] + 1) > 0
    return ~busy[graph]


def alone(have, sink, next1, back1, next2, back2) -> np.ndarray:
    """The source's side of one graph from excesses, capacities to the sink, and residual capacities to the next node and the next but one and back."""
    n = len(have)
    have, sink = [int(x) for x in have], [int(x) for x in sink]
    # to[k][i]: capacity from i to i + STEP[k]
    to = [[int(x) for x in next1] + [0], [0] + [int(x) for x in back1], [int(x) for x in next2] + [0, 0], [0, 0] + [int(x) for x in back2]]
    to = [t[:n] for t in to]
    step, other = (1, -1, 2, -2), (1, 0, 3, 2)
    far = n + 2

    def distances() -> tuple[list[int], list[set[int]]]:
        """Distances to the sink, and the nodes at each; those that cannot reach it are at none."""
        dist, at = [far] * n, [set() for _ in range(far + 1)]
        todo = deque(i for i in range(n) if sink[i])
        for i in todo:
            dist[i] = 1
        while todo:
            j = todo.popleft()
            at[dist[j]].add(j)
            for k in range(4):
                i = j - step[k]
                if 0 <= i < n and dist[i] == far and to[k][i]:
                    dist[i] = dist[j] + 1
                    todo.append(i)
        return dist, at

    def buckets() -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(far + 1)]
        for i in range(n):
            if have[i] and dist[i] < far:
                out[dist[i]].append(i)
        return out

    dist, at = distances()
    active, level, top, raised = buckets(), n + 1, n + 1, 0  # the farthest first, so that excess gathers on its way
    while level > 0:
        if not active[level]:
            level -= 1
            continue
        i = active[level].pop()
        if dist[i] != level or not have[i]:
            continue
        low = far
        if sink[i]:
            f = min(have[i], sink[i])
            sink[i] -= f
            have[i] -= f
            low = 1 if sink[i] else far
        for k in range(4):
            j = i + step[k]
            if not (0 <= j < n and to[k][i]):
                continue
            if have[i] and dist[j] == level - 1:
                f = min(have[i], to[k][i])
                to[k][i] -= f
                to[other[k]][j] += f
                have[i] -= f
                if not have[j]:
                    active[level - 1].append(j)
                have[j] += f
            if to[k][i]:
                low = min(low, dist[j] + 1)
        if not have[i]:
            continue
        at[level].discard(i)
        dist[i] = max(low, level + 1) if low < far else far
        if dist[i] < far:
            at[dist[i]].add(i)
            top = max(top, dist[i])
        raised += 1
        if not at[level]:  # nothing is left at this distance: what lies beyond cannot reach the sink
            for d in range(level + 1, top + 1):
                for j in at[d]:
                    dist[j] = far
                at[d].clear()
            top = level
        if raised > n:
            raised = 0
            dist, at = distances()
            active, level, top = buckets(), n + 1, n + 1
        elif dist[i] < far:
            active[dist[i]].append(i)
            level = dist[i]
    return np.array(distances()[0]) == far
