"""A character-level bidirectional LSTM with CRF transitions, in numpy.

``fit`` learns from labelled windows; ``tags`` decodes whole regions: each overlapping window gives
per-character log-marginals, these are averaged with more weight in a window's middle, and one
Viterbi pass over the region reconciles them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Character classes; digits, letters, lookups of single signs, everything else.
SIGNS = "@.+-() ,:;/_%#'\"=\n"
CLASSES = len(SIGNS) + 4
PAD = CLASSES - 1
_TABLE = np.full(128, len(SIGNS) + 2, np.int8)
for _i, _c in enumerate(SIGNS):
    _TABLE[ord(_c)] = _i
_TABLE[ord("0") : ord("9") + 1] = len(SIGNS)
_TABLE[[*range(65, 91), *range(97, 123)]] = len(SIGNS) + 1


def classes(text: str) -> np.ndarray:
    """Character classes, one per code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], len(SIGNS) + 1).astype(np.int8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(p, x, keep=False):
    """Hidden states (time, batch, units) of class ids (time, batch), and with ``keep`` what the way back needs."""
    steps, batch = x.shape
    units = p["wh"].shape[0]
    h, c, kept = np.zeros((batch, units)), np.zeros((batch, units)), []
    out = np.empty((steps, batch, units))
    for t in range(steps):
        z = p["wx"][x[t]] + h @ p["wh"] + p["b"]
        gates = _sigmoid(z[:, : 3 * units])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        g = np.tanh(z[:, 3 * units :])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        out[t] = h
    return out, kept


def _lstm_back(p, x, kept, d_out):
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    dh = np.zeros(d_out.shape[1:])
    dc = np.zeros_like(dh)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, squashed = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1
        )
        np.add.at(grad["wx"], x[t], dz)
        grad["wh"] += h.T @ dz
        grad["b"] += dz.sum(0)
        dh, dc = dz @ p["wh"].T, dc * f
    return grad


def _log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(emit, move):
    """Log-marginals (time, batch, tags), log of the sum over paths, and both partial sums."""
    steps = len(emit)
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = emit[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + move, 1) + emit[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(move + (emit[t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    return ahead + back - total[None, :, None], total, ahead, back


@dataclass
class Tagger:
    forward: dict
    backward: dict
    out: dict  # w: (2 units, tags), b: (tags,), move: (tags, tags)
    size: int = 64

    def emissions(self, x, keep=False):
        a, kept_a = _lstm(self.forward, x, keep)
        b, kept_b = _lstm(self.backward, x[::-1], keep)
        states = np.concatenate([a, b[::-1]], 2)
        return states @ self.out["w"] + self.out["b"], states, kept_a, kept_b

    def window_marginals(self, x):
        emit = self.emissions(x)[0]
        return _marginals(emit, self.out["move"])[0]

    def tags(self, regions: list[np.ndarray], batch: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tag and its probability for every character of each region (class ids)."""
        size, half = self.size, self.size // 2
        tags = len(self.out["b"])
        windows = []
        for r, region in enumerate(regions):
            starts = range(0, max(1, len(region) - half), half)
            windows += [(r, at) for at in starts]
        weight = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(float)
        sums = [np.zeros((len(region), tags)) for region in regions]
        mass = [np.zeros(len(region)) for region in regions]
        for first in range(0, len(windows), batch):
            part = windows[first : first + batch]
            x = np.full((size, len(part)), PAD, np.int64)
            for k, (r, at) in enumerate(part):
                piece = regions[r][at : at + size]
                x[: len(piece), k] = piece
            found = self.window_marginals(x)
            for k, (r, at) in enumerate(part):
                n = min(size, len(regions[r]) - at)
                sums[r][at : at + n] += found[:n, k] * weight[:n, None]
                mass[r][at : at + n] += weight[:n]
        return [self._reconcile(s / m[:, None]) for s, m in zip(sums, mass, strict=True)]

    def _reconcile(self, scores):
        move = self.out["move"]
        best, came = scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(scores)):
            paths = best[:, None] + move
            came[t] = paths.argmax(0)
            best = paths.max(0) + scores[t]
        tag = np.empty(len(scores), np.int64)
        tag[-1] = best.argmax()
        for t in range(len(scores) - 1, 0, -1):
            tag[t - 1] = came[t, tag[t]]
        chance = np.exp(scores - _log_sum(scores, 1)[:, None])
        return tag, chance[np.arange(len(tag)), tag]


def fit(x: np.ndarray, y: np.ndarray, tags: int, units: int = 16, steps: int = 350, batch: int = 48, rate: float = 0.015) -> Tagger:
    """Learn from class ids and tags, both (windows, size), by Adam on the CRF's log-likelihood."""
    rng = np.random.default_rng(11)

    def cell():
        return {
            "wx": rng.normal(0, 0.3, (CLASSES, 4 * units)),
            "wh": rng.normal(0, 0.2, (units, 4 * units)),
            "b": np.repeat([0.0, 1.0, 0.0, 0.0], units),
        }

    out = {"w": rng.normal(0, 0.2, (2 * units, tags)), "b": np.zeros(tags), "move": np.zeros((tags, tags))}
    model = Tagger(cell(), cell(), out, x.shape[1])
    parts = (model.forward, model.backward, model.out)
    first = [{k: np.zeros_like(v) for k, v in p.items()} for p in parts]
    second = [{k: np.zeros_like(v) for k, v in p.items()} for p in parts]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        xs, ys = x[rows].T.astype(np.int64), y[rows].T.astype(np.int64)
        emit, states, kept_a, kept_b = model.emissions(xs, keep=True)
        move = model.out["move"]
        marginal, total, ahead, back = _marginals(emit, move)
        d_emit = np.exp(marginal)
        np.put_along_axis(d_emit, ys[:, :, None], np.take_along_axis(d_emit, ys[:, :, None], 2) - 1, 2)
        pairs = ahead[:-1, :, :, None] + move + (emit[1:] + back[1:])[:, :, None, :] - total[None, :, None, None]
        d_move = np.exp(pairs).sum((0, 1))
        np.subtract.at(d_move, (ys[:-1], ys[1:]), 1)
        d_emit, d_move = d_emit / batch, d_move / batch
        d_states = d_emit @ model.out["w"].T
        units_ = states.shape[2] // 2
        grads = (
            _lstm_back(model.forward, xs, kept_a, d_states[:, :, :units_]),
            _lstm_back(model.backward, xs[::-1], kept_b, d_states[::-1, :, units_:]),
            {"w": np.einsum("tbh,tbk->hk", states, d_emit), "b": d_emit.sum((0, 1)), "move": d_move},
        )
        speed = rate * min(1.0, 2.0 - 2.0 * step / steps)
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model
