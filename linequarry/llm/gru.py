"""A gated recurrent language model with a class-factored softmax, in numpy (float32).

Symbols 0 .. V-1 are words (0 ends a text), V .. V+B-1 are rare words seen
through one of B spelling buckets.  A step reads the last symbol's row of the
gate table; the output first predicts a class (words of like frequency share
one; all rare words are one class of their own) and then the word inside it:

    P(word | past) = P(class | state) P(word | class, state)

The rare class stops at the class; what a rare word costs inside it is up to
the caller.  Training is truncated back-propagation: parallel streams of whole
texts, the state carried from window to window, gradients cut at a window's
start.  Scoring carries the state over a whole text of any length.
"""

from __future__ import annotations

import numpy as np

SIZE = 32  # words in a class


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_softmax(x):
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def new_model(counts, rare_count: float, buckets: int, hidden: int = 24, seed: int = 9) -> dict:
    """Start at the unigram distribution; counts: of the V words, most frequent words side by side."""
    rng = np.random.default_rng(seed)
    v = len(counts)
    classes = -(-v // SIZE)
    full = np.zeros(classes * SIZE)
    full[:v] = np.maximum(counts, 0.5)
    full = full.reshape(classes, SIZE)
    word_bias = np.where(full > 0, np.log(np.maximum(full, 1e-9)), -60.0)
    mass = np.append(full.sum(axis=1), max(rare_count, 0.5))
    f = np.float32
    return {
        "gate": (rng.standard_normal((v + buckets, 3 * hidden)) * 0.1).astype(f),
        "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
        "bias": np.concatenate([np.full(hidden, 0.5), np.zeros(2 * hidden)]).astype(f),
        "wc": np.zeros((hidden, classes + 1), f),
        "bc": np.log(mass / mass.sum()).astype(f),
        "ww": np.zeros((classes, hidden, SIZE), f),
        "bw": word_bias.astype(f),
    }


def step(m, h, symbols):
    """Next states of a batch (and what back-propagation needs)."""
    k = h.shape[1]
    x = m["gate"][symbols] + m["bias"]
    hu = h @ m["u"]
    zr = _sig(x[:, : 2 * k] + hu[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
    return n + z * (h - n), (z, r, n, hu[:, 2 * k :])


def output_log(m, states, targets, v):
    """Natural log probability of each target given the state before it; rare targets stop at their class."""
    rare = targets >= v
    classes = m["bc"].shape[0] - 1
    c = np.where(rare, classes, np.minimum(targets, v - 1) // SIZE)
    out = _log_softmax(states @ m["wc"] + m["bc"])[np.arange(len(c)), c]
    order = np.argsort(c, kind="stable")
    at = np.searchsorted(c[order], np.arange(classes + 1))
    for k in range(classes):
        i = order[at[k] : at[k + 1]]
        if len(i):
            out[i] += _log_softmax(states[i] @ m["ww"][k] + m["bw"][k])[np.arange(len(i)), targets[i] % SIZE]
    return out


def new_moments(m: dict) -> dict:
    return {"t": 0} | {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in m.items()}


def flat(m: dict):
    """All weights side by side; ``unflat`` undoes it."""
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def unflat(data, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = data[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


def train(m: dict, texts: list, v: int, streams: int = 64, window: int = 24, epochs: int = 2, rate: float = 4e-3, seed: int = 13, moments: dict | None = None, decay: float = 0.9) -> dict:
    """Fits ``m`` in place on symbol arrays that end with 0.

    ``moments`` (see ``new_moments``) keeps Adam's means between calls; the
    rate falls by the share ``decay`` over a call.
    """
    rng = np.random.default_rng(seed)
    hidden, classes = m["u"].shape[0], m["bc"].shape[0] - 1
    moments = new_moments(m) if moments is None else moments
    for epoch in range(epochs):
        line = np.concatenate([texts[i] for i in rng.permutation(len(texts))]).astype(np.int64)
        b = max(1, min(streams, len(line) // (2 * window)))
        length = len(line) // b
        if length < 1:
            break
        line = line[: b * length].reshape(b, length).T
        h = np.zeros((b, hidden), np.float32)
        before = np.zeros(b, np.int64)  # the end symbol stands for a text's start
        for a in range(0, length, window):
            target = line[a : a + window]
            states, inner, inputs, resets, seen = [], [], [], [], []
            for row in target:
                fresh = before == 0
                h = np.where(fresh[:, None], np.float32(0), h)
                states.append(h)
                h, extra = step(m, h, before)
                seen.append(h)
                inner.append(extra)
                inputs.append(before)
                resets.append(fresh)
                before = row
            tn = len(target)
            hs = np.concatenate(seen)
            goal = target.ravel()
            n = len(goal)
            c = np.where(goal >= v, classes, np.minimum(goal, v - 1) // SIZE)
            g = {k: np.zeros_like(x) for k, x in m.items()}
            p = np.exp(_log_softmax(hs @ m["wc"] + m["bc"]))
            p[np.arange(n), c] -= 1
            p /= n
            g["wc"], g["bc"] = hs.T @ p, p.sum(axis=0)
            dh_out = p @ m["wc"].T
            order = np.argsort(c, kind="stable")
            at = np.searchsorted(c[order], np.arange(classes + 1))
            for k in range(classes):
                i = order[at[k] : at[k + 1]]
                if len(i):
                    q = np.exp(_log_softmax(hs[i] @ m["ww"][k] + m["bw"][k]))
                    q[np.arange(len(i)), goal[i] % SIZE] -= 1
                    q /= n
                    g["ww"][k], g["bw"][k] = hs[i].T @ q, q.sum(axis=0)
                    dh_out[i] += q @ m["ww"][k].T
            dh = np.zeros((b, hidden), np.float32)
            dx = np.empty((tn, b, 3 * hidden), np.float32)
            for s in range(tn - 1, -1, -1):
                dh = dh + dh_out[s * b : (s + 1) * b]
                z, r, cand, hu = inner[s]
                prev = states[s]
                da = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (prev - cand) * z * (1 - z)
                dr = da * hu * r * (1 - r)
                dx[s, :, :hidden], dx[s, :, hidden : 2 * hidden], dx[s, :, 2 * hidden :] = dz, dr, da
                du = np.concatenate([dz, dr, da * r], axis=1)
                g["u"] += prev.T @ du
                dh = dh * z + du @ m["u"].T
                dh[resets[s]] = 0
            flat, sym = dx.reshape(-1, 3 * hidden), np.concatenate(inputs)
            g["bias"] = flat.sum(axis=0)
            order = np.argsort(sym, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(sym[order]) > 0))
            g["gate"][sym[order][first]] = np.add.reduceat(flat[order], first, axis=0)
            norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            moments["t"] = t = moments["t"] + 1
            lr = rate * (1 - decay * (epoch + a / length) / epochs)
            for k, x in m.items():
                d = g[k] * np.float32(scale)
                m1, m2 = moments[k]
                m1 += np.float32(0.1) * (d - m1)
                m2 += np.float32(0.01) * (d * d - m2)
                x -= np.float32(lr / (1 - 0.9**t)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    return m


def score(m: dict, symbols, first, v: int, block: int = 1 << 16):
    """log10 probability of each text; symbols of all texts side by side, offsets ``first``; every text ends with 0.

    Texts are stepped together, longest first, so the live ones are always a
    prefix; states of a block of steps go through the output layer at once.
    """
    n = len(first) - 1
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[:-1][order]
    total = np.zeros(n)
    h = np.zeros((n, m["u"].shape[0]), np.float32)
    last = np.zeros(n, np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if n else 0), "left")  # texts longer than t
    held_h, held_t, held_n = [], [], 0

    def flush():
        log = output_log(m, np.concatenate(held_h), np.concatenate(held_t), v)
        at = 0
        for x in held_t:
            total[: len(x)] += log[at : at + len(x)]
            at += len(x)

    for t, k in enumerate(live):
        h, _ = step(m, h[:k], last[:k])
        last = symbols[start[:k] + t]
        held_h.append(h)
        held_t.append(last)
        held_n += k
        if held_n >= block:
            flush()
            held_h, held_t, held_n = [], [], 0
    if held_t:
        flush()
    out = np.empty(n)
    out[order] = total / np.log(10)
    return out
