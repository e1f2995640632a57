"""NumPy twins and plan helpers."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import numpy as np


def plan_of(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def psi(reference, current, bins=10, eps=1e-6):
    reference, current = (np.asarray([v for v in s if v is not None and not np.isnan(v)], float) for s in (reference, current))
    if not len(reference) or not len(current):
        return None
    edges = np.quantile(reference, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    edges = np.unique(edges)
    if len(edges) <= 2:
        return 0.0
    p = np.histogram(reference, edges)[0]
    q = np.histogram(current, edges)[0]
    p, q = p / (p.sum() + eps), q / (q.sum() + eps)
    return float(((p - q) * np.log((p + eps) / (q + eps))).sum())


def ks(a, b):
    a, b = np.sort(a), np.sort(b)
    points = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)).max())


def curve(scores, labels):
    scores, labels = np.asarray(scores, float), np.asarray(labels)
    out = []
    for t in np.unique(scores):
        hit = scores >= t
        out.append((float(t), float(labels[hit].mean()), float(labels[hit].sum() / labels.sum())))
    return out


def average_precision(scores, labels):
    ap, previous = 0.0, 0.0
    for _, precision, recall in sorted(curve(scores, labels), reverse=True):
        ap += (recall - previous) * precision
        previous = recall
    return ap


def auc(scores, labels):
    scores, labels = np.asarray(scores, float), np.asarray(labels)
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return float(wins / (len(pos) * len(neg)))
