"""Minimum cut of a binary labelling with terminal capacities and symmetric smoothness edges."""

from __future__ import annotations

from collections import deque


def min_cut_labels(score: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Labels x that minimise  sum(|score| where x disagrees with its sign) + sum(capacity where x differs).

    A positive score is a capacity from the source (true), a negative one a capacity to the sink.  A node whose
    score outweighs all its edges has its sign in some minimum cut: it is fixed first, and its edges become scores
    of its neighbours.  Augmenting paths settle the rest.  Ties go to false (the sink side is the larger one).
    """
    n = len(score)
    score = list(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        weight = sum(near[i].values())
        if abs(score[i]) > weight or not weight:
            label[i] = score[i] > 0
            for j, c in near[i].items():
                score[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, x in zip(rest, _augment(rest, score, near), strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _augment(nodes: list[int], score: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Shortest augmenting paths; true: still reached from the source when no path is left."""
    supply = {i: max(0, score[i]) for i in nodes}
    drain = {i: max(0, -score[i]) for i in nodes}
    left = {i: dict(near[i]) for i in nodes}
    while True:
        came: dict[int, int | None] = {i: None for i in nodes if supply[i] > 0}
        queue = deque(came)
        end = None
        while queue:
            i = queue.popleft()
            if drain[i] > 0:
                end = i
                break
            for j, c in left[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end is None:
            return [i in came for i in nodes]
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        flow = min(supply[path[-1]], drain[end], *(left[b][a] for a, b in zip(path, path[1:], strict=False)))
        supply[path[-1]] -= flow
        drain[end] -= flow
        for a, b in zip(path, path[1:], strict=False):
            left[b][a] -= flow
            left[a][b] += flow
