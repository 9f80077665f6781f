"""Statistics of texts that the classifiers use: what a text looks like, never its id, source, language tag or label."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import words
from .words import Words


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "upper": _class(range(0x41, 0x5B)),
    "lower": _class(range(0x61, 0x7B)),
    "digit": _class(range(0x30, 0x3A)),
    "line": _class(b"\n"),
    "space": _class(b" \t"),
    "pipe": _class(b"|"),
    "shout": _class(b"!?"),
    "stop": _class(b".,;:"),
    "symbol": _class(b"#$%&*@^~<>=+_\\/{}[]"),
    "beyond": _class(range(0x80, 0x100)),
}
_NOT_LINE = ~CLASSES["line"]
NAMES = ["bytes", "words", *CLASSES, "length", "short", "long", "odd_end", "distinct", "top", "distinct_runs", "lines", "distinct_lines", "line_length"]


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the commonest) by owner; owners ascend."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    top = np.zeros(n)
    np.maximum.at(top, owner[fresh], np.diff(np.append(fresh, len(h))))
    return np.bincount(owner[fresh], minlength=n).astype(float), top


def statistics(w: Words) -> np.ndarray:
    """A row of NAMES for each text; `w` holds texts as they are, not in lower case. Empty texts are all zeros."""
    n, size = len(w.at) - 1, np.diff(w.at).astype(float)
    some, count = np.maximum(size, 1), w.per_text.astype(float)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[w.data])])[w.at]) / some
    length = (w.end - w.start).astype(float)
    by_text = lambda x: np.bincount(w.text, weights=x, minlength=n) / np.maximum(count, 1)
    h = words.mix(w.hashes())
    distinct, top = _distinct(h, w.text, n)
    runs = words.runs(h, 3)
    inside = w.text[: len(runs)] == w.text[2:] if len(runs) else np.zeros(0, bool)
    of_runs = w.text[: len(runs)][inside]
    distinct_runs, _ = _distinct(runs[inside], of_runs, n)
    lines = words.split(w.data, w.at, _NOT_LINE, lower=False)
    distinct_lines, _ = _distinct(lines.hashes(), lines.text, n)
    n_lines = np.maximum(lines.per_text, 1)
    odd = CLASSES["symbol"] | CLASSES["shout"]
    out = [np.log1p(size), np.log1p(count), *(share(m) for m in CLASSES.values())]
    out += [by_text(length), by_text(length <= 3), by_text(length >= 12), by_text(odd[w.data[w.end - 1]] if len(w.end) else length)]
    out += [distinct / np.maximum(count, 1), top / np.maximum(count, 1), distinct_runs / np.maximum(np.bincount(of_runs, minlength=n), 1)]
    out += [np.log1p(n_lines), distinct_lines / n_lines, np.log1p(size / n_lines)]
    return np.stack(out, axis=1)


def expanded(f: np.ndarray) -> np.ndarray:
    """Statistics with curved and stepped versions, so that a linear score can tell none, some and much."""
    return np.concatenate([f, np.sqrt(np.abs(f)), f * f, f > 0.02, f > 0.1, f > 0.3], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression on soft labels in [0, 1], by damped Newton steps; no intercept is added."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    loss = np.inf
    for _ in range(rounds):
        z = x @ w
        now = float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)
        if loss - now < 1e-6 * max(1.0, abs(now)):
            break
        loss = now
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        for _ in range(20):
            z2 = x @ (w - size * step)
            w2 = w - size * step
            if float((weight * (np.logaddexp(0, z2) - y * z2)).sum() + ridge * (w2 @ w2) / 2) <= now:
                break
            size /= 2
        w = w - size * step
    return w


def newton(at: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], size: int, ridge: float, rounds: int = 30) -> np.ndarray:
    """`size` coefficients where a convex loss is least, by damped Newton steps. at(w): loss, slope and curve without the ridge, a pass over the data each time."""

    def ridged(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = at(w)
        return loss + ridge * float(w @ w) / 2, slope + ridge * w, curve + ridge * np.eye(size)

    w = np.zeros(size)
    loss, slope, curve = ridged(w)
    for _ in range(rounds):
        step = np.linalg.solve(curve, slope)
        for part in 0.5 ** np.arange(20):
            made = ridged(w - part * step)
            if made[0] <= loss:
                break
        else:
            break
        w, gain = w - part * step, loss - made[0]
        loss, slope, curve = made
        if gain < 1e-6 * max(1.0, abs(loss)):
            break
    return w
