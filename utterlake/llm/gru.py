"""A bidirectional gated recurrent network with attention pooling, forward and backward in NumPy.

A window is a row of word numbers (-1 is padding). Each word has a vector of its own if it is known and
the mean of vectors of its character 3-grams; both go through one projection to the gates of either
direction. States of both directions are pooled by learned attention into one logit for the window.
"""

from __future__ import annotations

import numpy as np

CHAR_BUCKETS = 4096
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 8, 8


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def new_parameters(words: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; word 0 stands for all unknown words and is not learned."""
    rng = np.random.default_rng(seed)

    def weights(*shape, scale=0.1):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    size, p = WORD_SIZE + CHAR_SIZE, {}
    p["word"] = weights(words, WORD_SIZE)
    p["word"][0] = 0
    p["char"] = weights(CHAR_BUCKETS, CHAR_SIZE)
    for side in "fb":
        p[f"w{side}"] = weights(size, 3 * HIDDEN, scale=0.3)
        p[f"u{side}"] = weights(HIDDEN, 3 * HIDDEN, scale=0.3)
        p[f"b{side}"] = np.zeros(3 * HIDDEN, np.float32)
    p["attend"] = weights(2 * HIDDEN, scale=0.3)
    p["out"] = weights(2 * HIDDEN, scale=0.3)
    p["bias"] = np.zeros(1, np.float32)
    return p


def inputs(p: dict, known: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input vector of each distinct word: ``known`` is its number, ``grams[at[i]:at[i + 1]]`` its character buckets."""
    sums = np.add.reduceat(p["char"][grams], at[:-1]) if len(grams) else np.zeros((len(known), CHAR_SIZE), np.float32)
    return np.concatenate([p["word"][known], sums / np.diff(at)[:, None]], 1).astype(np.float32)


def _steps(p, side, gates, windows, keep):
    """States of one direction, and what the backward pass needs. ``gates`` are projected inputs, one row for each word."""
    n, length = windows.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, cache = np.zeros((length, n, HIDDEN), np.float32), []
    order = range(length) if side == "f" else range(length - 1, -1, -1)
    u = p[f"u{side}"]
    for t in order:
        here = windows[:, t]
        x = gates[here]
        rec = h @ u[:, : 2 * HIDDEN]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + rec)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        c = np.tanh(x[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        live = (here >= 0)[:, None]
        new = np.where(live, h + z * (c - h), h)
        if keep:
            cache.append((t, h, z, r, c, rh, live))
        h = new
        states[t] = h
    return states, cache


def logits(p: dict, x: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logit of each window; ``windows`` holds rows of ``x``, -1 for padding. With ``keep``, also the cache."""
    sides, states = {}, []
    for side in "fb":
        gates = np.concatenate([x @ p[f"w{side}"] + p[f"b{side}"], np.zeros((1, 3 * HIDDEN), np.float32)])
        s, cache = _steps(p, side, gates, windows, keep)
        states.append(s)
        sides[side] = cache
    both = np.concatenate(states, 2)
    weight = both @ p["attend"]
    weight = np.where(windows.T >= 0, weight, np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (both * weight[:, :, None]).sum(0)
    out = pooled @ p["out"] + p["bias"]
    return (out, (sides, both, weight, pooled)) if keep else out


def gradients(p: dict, x: np.ndarray, windows: np.ndarray, d_out: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of all weights but the embeddings, and of the input vectors, for the logits' gradient ``d_out``."""
    sides, both, weight, pooled = kept
    g = {"out": pooled.T @ d_out, "bias": d_out.sum(keepdims=True)}
    d_pooled = d_out[:, None] * p["out"]
    d_both = weight[:, :, None] * d_pooled
    d_score = weight * ((both * d_pooled).sum(2) - (pooled * d_pooled).sum(1))
    d_both = d_both + d_score[:, :, None] * p["attend"]
    g["attend"] = np.einsum("tnh,tn->h", both, d_score)
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        u = p[f"u{side}"]
        d_states = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        g_u = np.zeros_like(u)
        d_h = np.zeros((windows.shape[0], HIDDEN), np.float32)
        for t, h, z, r, c, rh, live in reversed(sides[side]):
            d_new = d_h + d_states[t]
            d_live = np.where(live, d_new, 0)
            d_c = d_live * z * (1 - c * c)
            d_z = d_live * (c - h) * z * (1 - z)
            d_rh = d_c @ u[:, 2 * HIDDEN :].T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            g_u[:, 2 * HIDDEN :] += rh.T @ d_c
            g_u[:, : 2 * HIDDEN] += h.T @ d_zr
            np.add.at(d_gates, windows[:, t], np.concatenate([d_zr, d_c], 1))
            d_h = np.where(live, d_live * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T, d_new)
        d_gates = d_gates[:-1]
        g[f"w{side}"], g[f"b{side}"], g[f"u{side}"] = x.T @ d_gates, d_gates.sum(0), g_u
        d_x += d_gates @ p[f"w{side}"].T
    return g, d_x


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict) -> None:
        self.n += 1
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)


def train(p: dict, known, grams, at, windows, y, weight, epochs: int, rate: float, batch: int = 128, decay: float = 1e-4, seed: int = 3) -> None:
    """Fits the weights in place to window labels ``y`` with row ``weight``, by mini-batches."""
    rng = np.random.default_rng(seed)
    adam = Adam(p, rate)
    size = np.diff(at)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, -(-len(y) // batch))):
            used, place = np.unique(windows[rows], return_inverse=True)
            place = place.reshape(windows[rows].shape)
            if used[0] < 0:
                used, place = used[1:], place - 1
            if not len(used):
                continue
            count = size[used]
            chars = grams[np.repeat(at[used], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
            x = inputs(p, known[used], chars, np.concatenate([[0], np.cumsum(count)]))
            out, kept = logits(p, x, place, keep=True)
            d_out = ((_sigmoid(out) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g, d_x = gradients(p, x, place, d_out, kept)
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], known[used], d_x[:, :WORD_SIZE])
            g["word"][0] = 0
            g["char"] = np.zeros_like(p["char"])
            np.add.at(g["char"], chars, np.repeat(d_x[:, WORD_SIZE:] / count[:, None], count, 0))
            for k in g:
                g[k] = g[k] + decay * p[k]
            adam.step(p, g)
