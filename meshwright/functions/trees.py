"""Sampled cliques: stars of eliminated vertices as arrays, all stars at a time."""

from __future__ import annotations

import numpy as np


def draws(seed: int, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One number in [0, 1) for each leaf u of a star v, that only seed, v and u decide."""
    with np.errstate(over="ignore"):
        x = v.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + u.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed * 0xE7037ED1A0B428DB & (1 << 64) - 1)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) * 2.0**-53


def sampled(v: np.ndarray, u: np.ndarray, w: np.ndarray, total: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves u with weights w > 0 of stars v (total is the star's, on each row) -> edges (a, b, weight) whose expectation is each
    star's clique over total. Leaves of a star lie side by side on a line of length one, light ones first; each leaf but the last
    shoots at the part of the line behind itself, is joined to the leaf that it hits, and the edge carries what lies behind."""
    order = np.lexsort((u, w, v))
    v, u, w, total = v[order], u[order], w[order], total[order]
    if not len(v):
        return v, u, w
    new = np.concatenate([[True], v[1:] != v[:-1]])
    star = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(v)]]) - 1
    run = np.cumsum(w)
    upto = run - np.concatenate([[0.0], run])[first][star]
    whole = np.add.reduceat(w, first)[star]
    here = np.minimum(upto / whole, 1.0)
    behind = np.maximum(whole - upto, 0.0)
    hit = np.searchsorted(star + here, star + here + draws(seed, v, u) * (1 - here), "right")
    leaf = np.flatnonzero(np.arange(len(v)) < last[star])
    to = np.clip(hit[leaf], leaf + 1, last[star[leaf]])
    x = w[leaf] * behind[leaf] / total[leaf]
    good = x > 0
    a, b = u[leaf][good], u[to][good]
    return np.minimum(a, b), np.maximum(a, b), x[good]


def cliques(v: np.ndarray, u: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of leaves of every star, w1 w2 / total. For small stars."""
    order = np.lexsort((u, v))
    v, u, w, total = v[order], u[order], w[order], total[order]
    parts, step = [], 1
    at = np.arange(len(v))
    while len(at):
        at = at[at < len(v) - step]
        at = at[v[at] == v[at + step]]
        parts.append((u[at], u[at + step], w[at] * w[at + step] / total[at]))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (u[:0], u[:0], w[:0])


def by_rule(rule, v: np.ndarray, u: np.ndarray, w: np.ndarray, total: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A caller's rule(w, u, total, draws) -> [(a, b, weight)], star by star."""
    order = np.lexsort((u, v))
    v, u, w, total = v[order], u[order], w[order], total[order]
    cuts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]]) if len(v) else [0]
    got = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in rule(w[a:b], u[a:b], float(total[a]), draws(seed, v[a:b], u[a:b]))]
    a, b, x = (np.array(c, t) for c, t in zip(zip(*got, strict=True) if got else ((), (), ()), (np.int64, np.int64, float), strict=True))
    return np.minimum(a, b), np.maximum(a, b), x
