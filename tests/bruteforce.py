"""Density clustering on a full distance matrix, one threshold after the other."""

from __future__ import annotations

import numpy as np


def reach_matrix(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, len(x) - 1)]
    return np.maximum(np.maximum(d, core[:, None]), core[None]), core


def components(rows: np.ndarray, linked: np.ndarray) -> list[np.ndarray]:
    left, out = set(rows.tolist()), []
    while left:
        group, stack = set(), [left.pop()]
        while stack:
            i = stack.pop()
            group.add(i)
            near = [j for j in left if linked[i, j]]
            left.difference_update(near)
            stack += near
        out.append(np.array(sorted(group)))
    return out


def cluster(x, m, k=None, method="eom", epsilon=0.0, single=False):
    n = len(x)
    reach, _ = reach_matrix(x, k or m)
    np.fill_diagonal(reach, np.inf)
    positive = reach[(reach > 0) & np.isfinite(reach)]
    reach = np.maximum(reach, positive.min() if len(positive) else 1.0)
    nodes = {0: dict(parent=None, birth=0.0, born_w=np.inf, rows=[])}
    active = {0: np.arange(n)}
    if n < m:
        return np.full(n, -1), np.zeros(n)
    for w in np.unique(reach[np.isfinite(reach)])[::-1]:
        for c, rows in list(active.items()):
            parts = components(rows, reach < w)
            if len(parts) == 1:
                continue
            big = [p for p in parts if len(p) >= m]
            for p in parts:
                if len(p) < m:
                    nodes[c]["rows"] += [(int(i), 1 / w, 1) for i in p]
            del active[c]
            if len(big) == 1:
                active[c] = big[0]
            elif len(big) > 1:
                for p in big:
                    new = len(nodes)
                    nodes[new] = dict(parent=c, birth=1 / w, born_w=w, rows=[])
                    nodes[c]["rows"].append((None, 1 / w, len(p)))
                    active[new] = p
    children = {c: [j for j in nodes if nodes[j]["parent"] == c] for c in nodes}
    stability = {c: sum(s * (lam - v["birth"]) for _, lam, s in v["rows"]) for c, v in nodes.items()}
    best, flag = {}, set()
    for c in sorted(nodes, reverse=True):
        below = sum(best[j] for j in children[c])
        wins = stability[c] >= below - 1e-9 if method == "eom" else not children[c]
        best[c] = max(stability[c], below)
        if wins and (single or c != 0):
            flag.add(c)

    def up(c):
        while c is not None:
            yield c
            c = nodes[c]["parent"]

    chosen = {c for c in flag if not any(a in flag for a in list(up(c))[1:])}
    if epsilon:
        moved = set()
        for c in chosen:
            if nodes[c]["born_w"] < epsilon:
                while nodes[c]["born_w"] <= epsilon and (single or nodes[c]["parent"] != 0):
                    c = nodes[c]["parent"]
            moved.add(c)
        chosen = {c for c in moved if not any(a in moved for a in list(up(c))[1:])}
    label, prob = np.full(n, -1), np.zeros(n)
    for c, v in nodes.items():
        home = next((a for a in up(c) if a in chosen), None)
        if home is None:
            continue
        death = max(lam for _, lam, _ in nodes[home]["rows"])
        for i, lam, _ in v["rows"]:
            if i is not None:
                label[i], prob[i] = home, min(lam, death) / death
    groups = sorted({int(l) for l in label} - {-1}, key=lambda l: (-(label == l).sum(), np.flatnonzero(label == l)[0]))
    names = {l: i for i, l in enumerate(groups)} | {-1: -1}
    return np.array([names[int(l)] for l in label]), prob
