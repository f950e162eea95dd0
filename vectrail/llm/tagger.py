"""A character-level bidirectional LSTM with a CRF on top, in numpy: training by gradient descent, and decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: Tags: 0 outside, 1 + 2 k the first character of kind k, 2 + 2 k a further one.
TAGS = 1 + 2 * len(KINDS)
CHARS = 98
EMBED, HIDDEN = 12, 24


def encode(text: str) -> np.ndarray:
    """Ids of characters: printable ASCII each its own, other blanks one, all others one; 0 is padding."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((x >= 32) & (x < 127), x - 30, np.where((x >= 9) & (x <= 13), 2, 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, p, d):
    """States of one direction over x (time, batch, features), with what the backward pass needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((2, batch, HIDDEN), np.float32)
    states, cache = np.empty((steps, batch, HIDDEN), np.float32), []
    pre = x @ p[d + "x"] + p[d + "b"]
    for t in range(steps):
        g = pre[t] + h @ p[d + "h"]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        cache.append((h, before, i, f, o, u, tc))
        h = o * tc
        states[t] = h
    return states, cache


def _lstm_back(x, p, d, cache, ds, grads):
    dx = np.empty_like(x)
    dh, dc = np.zeros((2, *ds.shape[1:]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, u, tc = cache[t]
        dh = dh + ds[t]
        dc = dc + dh * o * (1 - tc**2)
        g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
        grads[d + "x"] += x[t].T @ g
        grads[d + "h"] += h.T @ g
        grads[d + "b"] += g.sum(axis=0)
        dx[t], dh, dc = g @ p[d + "x"].T, g @ p[d + "h"].T, dc * f
    return dx


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"emb": n(CHARS, EMBED) * 3, "out": n(2 * HIDDEN, TAGS), "outb": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
    for d in "fr":
        p |= {d + "x": n(EMBED, 4 * HIDDEN), d + "h": n(HIDDEN, 4 * HIDDEN), d + "b": np.zeros(4 * HIDDEN, np.float32)}
        p[d + "b"][HIDDEN : 2 * HIDDEN] = 1
    return p


def emissions(p: dict[str, np.ndarray], chars: np.ndarray) -> np.ndarray:
    """Scores (batch, time, tag) of windows of characters (batch, time)."""
    x = p["emb"][chars.T]
    f, r = _lstm(x, p, "f")[0], _lstm(x[::-1], p, "r")[0][::-1]
    return (np.concatenate([f, r], axis=2) @ p["out"] + p["outb"]).transpose(1, 0, 2)


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p, chars, tags):
    """Mean negative log-likelihood of the CRF, and its gradients."""
    x = p["emb"][chars.T]
    f, cf = _lstm(x, p, "f")
    r, cr = _lstm(x[::-1], p, "r")
    both = np.concatenate([f, r[::-1]], axis=2)
    e, y = both @ p["out"] + p["outb"], tags.T
    steps, batch, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = p["start"] + e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + p["trans"], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(p["trans"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    rows = np.arange(batch)
    score = p["start"][y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(p["trans"][y[t - 1], y[t]] for t in range(1, steps))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    de = np.exp(alpha + beta - z[None, :, None])
    g["start"] += de[0].sum(axis=0)
    np.add.at(g["start"], y[0], -1)
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + p["trans"] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
        g["trans"] += pair.sum(axis=0)
        np.add.at(g["trans"], (y[t - 1], y[t]), -1)
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
    g["out"] += np.tensordot(both, de, ([0, 1], [0, 1]))
    g["outb"] += de.sum(axis=(0, 1))
    ds = de @ p["out"].T
    dx = _lstm_back(x, p, "f", cf, ds[:, :, :HIDDEN], g) + _lstm_back(x[::-1], p, "r", cr, ds[::-1, :, HIDDEN:], g)[::-1]
    np.add.at(g["emb"], chars.T, dx)
    return float((z - score).mean()), {k: v / batch for k, v in g.items()}


def train(chars: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of labelled windows; the rate falls linearly to a tenth."""
    p, r = new_parameters(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    total, step = epochs * -(-len(chars) // batch), 0
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(chars)), -(-len(chars) // batch)):
            _, g = loss_and_gradients(p, chars[part], tags[part])
            step += 1
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            for k in p:
                d = g[k] * min(1, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d**2
                p[k] -= rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return p


def viterbi(p: dict[str, np.ndarray], e: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Best tags of each sequence of scores e (batch, time, tag) of the given sizes."""
    batch, steps, _ = e.shape
    score = p["start"] + e[:, 0]
    back = np.zeros((steps, batch, TAGS), np.int8)
    final = score.copy()
    for t in range(1, steps):
        ways = score[:, :, None] + p["trans"]
        back[t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + e[:, t]
        final = np.where((t < sizes)[:, None], score, final)
    out = []
    for b in range(batch):
        n = int(sizes[b])
        tags = np.empty(n, np.int8)
        tags[-1] = final[b].argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, b, tags[t]]
        out.append(tags)
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the tagged spans."""
    out, at, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if at >= 0 and t != 2 + 2 * kind:
            out.append((kind, at, i))
            at = -1
        if t % 2 == 1:
            at, kind = i, (t - 1) // 2
    return out
