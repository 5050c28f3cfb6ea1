"""Hashed sparse features and a logistic scorer, trained in one task on a bounded sample."""

from __future__ import annotations

import numpy as np

from trigrail.llm import text as tx


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts end to end, offsets)."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), "<u4"), offs


def character_ngrams(texts: list[str], orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Of each text the distinct hashed character n-grams of the orders."""
    points, offs = characters(texts)
    h = tx.mix(points.astype(np.uint64) + np.uint64(1))
    grams = [(n, (tx.window_hashes(h, n, seed=n) >> np.uint64(64 - bits)).astype(np.int64)) for n in orders]
    last, out = np.zeros(1 << bits, np.int32), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        idx = np.concatenate([g[a : max(a, b - n + 1)] for n, g in grams])
        place = np.arange(len(idx), dtype=np.int32)
        last[idx] = place
        out.append(idx[last[idx] == place])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray, size: int, *, epochs: int = 20, rate: float = 0.5, decay: float = 1e-5, batch: int = 128, steps: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model with AdaGrad steps over shuffled batches, the same on every run.

    rows: (feature indices, values) of each example; target in 0 to 1; weight: of each example. There are
    more epochs where these have fewer than steps batches.
    """
    w, bias = np.zeros(size), 0.0
    seen, seen_bias = np.full(size, 1e-6), 1e-6
    rng = np.random.default_rng(7)
    batches = max(1, -(-len(rows) // batch))
    for _ in range(max(epochs, -(-steps // batches))):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            idx = np.concatenate([rows[k][0] for k in some])
            val = np.concatenate([rows[k][1] for k in some])
            of = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            score = np.bincount(of, w[idx] * val, minlength=len(some)) + bias
            slope = (sigmoid(score) - target[some]) * weight[some] / len(some)
            step = np.bincount(idx, slope[of] * val, minlength=size) + decay * w
            seen += step**2
            w -= rate * step / np.sqrt(seen)
            g = slope.sum()
            seen_bias += g**2
            bias -= rate * g / np.sqrt(seen_bias)
    return w, bias
