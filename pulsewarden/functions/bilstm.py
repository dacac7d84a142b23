"""Bidirectional LSTM autoencoder of short sequences in NumPy: reconstruction, loss and gradient of a batch.

Encoder layers of the given widths, the last of which gives its final states only, a linear bottleneck that is repeated
for each day, the widths again in reverse, and a linear output a day. Each recurrent layer is followed by batch
normalisation and dropout. Parameters are one flat vector, so sums of gradients are sums of vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

EPSILON = 1e-3


class Shape(NamedTuple):
    days: int = 14
    widths: tuple[int, ...] = (128, 64, 32)
    bottleneck: int = 4
    dropout: tuple[float, ...] = (0.2, 0.2, 0.3)

    @property
    def layers(self) -> list[tuple[int, int, float]]:
        """(inputs, width, dropout) of each recurrent layer; those of the decoder all drop as the first does."""
        out, inputs = [], 1
        for width, drop in zip(self.widths, self.dropout):
            out.append((inputs, width, drop))
            inputs = 2 * width
        inputs = self.bottleneck
        for width in reversed(self.widths):
            out.append((inputs, width, self.dropout[0]))
            inputs = 2 * width
        return out

    @property
    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        found = []
        for k, (inputs, width, _) in enumerate(self.layers):
            for side in "fb":
                found += [(f"w{k}{side}", (inputs + width, 4 * width)), (f"b{k}{side}", (4 * width,))]
            found += [(f"g{k}", (2 * width,)), (f"s{k}", (2 * width,))]
        last = 2 * self.widths[0]
        return [*found, ("zw", (2 * self.widths[-1], self.bottleneck)), ("zb", (self.bottleneck,)), ("ow", (last, 1)), ("ob", (1,))]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts)

    @property
    def moments(self) -> int:
        """Numbers that hold the mean and variance of each normalised column."""
        return sum(4 * width for _, width, _ in self.layers)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts:
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: list[int], level: float = 0.0) -> np.ndarray:
        """First parameters: scaled uniform weights, forget gates open, the output at `level`."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for name, part in self.views(flat).items():
            if name[-1] in "fb" and name[0] == "b":
                part[len(part) // 4 : len(part) // 2] = 1.0
            elif name[0] == "g":
                part[:] = 1.0
            elif part.ndim == 2:
                bound = np.sqrt(6.0 / sum(part.shape))
                part[:] = rng.uniform(-bound, bound, part.shape)
        self.views(flat)["ob"][:] = level
        return flat

    def first_moments(self) -> np.ndarray:
        return np.concatenate([np.repeat([0.0, 1.0], 2 * width) for _, width, _ in self.layers])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _run(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction over x (rows, days, inputs), and what its gradient needs."""
    rows, days, _ = x.shape
    width = len(b) // 4
    h, c = np.zeros((rows, width), x.dtype), np.zeros((rows, width), x.dtype)
    out, kept = np.empty((rows, days, width), x.dtype), []
    for t in range(days):
        joined = np.concatenate([x[:, t], h], axis=1)
        z = joined @ w + b
        i, f, o = _sigmoid(z[:, :width]), _sigmoid(z[:, width : 2 * width]), _sigmoid(z[:, 3 * width :])
        g = np.tanh(z[:, 2 * width : 3 * width])
        before = c
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[:, t] = h
        kept.append((joined, i, f, g, o, before, squashed))
    return out, kept


def _run_back(d_out: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients for x, w and b of one direction."""
    rows, days, width = d_out.shape
    inputs = len(w) - width
    d_x, d_w, d_b = np.empty((rows, days, inputs), d_out.dtype), np.zeros_like(w), np.zeros(4 * width, d_out.dtype)
    d_h, d_c = np.zeros((rows, width), d_out.dtype), np.zeros((rows, width), d_out.dtype)
    for t in reversed(range(days)):
        joined, i, f, g, o, before, squashed = kept[t]
        d_h = d_h + d_out[:, t]
        d_c = d_c + d_h * o * (1 - squashed**2)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_c * i * (1 - g**2), d_h * squashed * o * (1 - o)], axis=1)
        d_w += joined.T @ d_z
        d_b += d_z.sum(axis=0)
        back = d_z @ w.T
        d_x[:, t], d_h = back[:, :inputs], back[:, inputs:]
        d_c = d_c * f
    return d_x, d_w, d_b


class Pass(NamedTuple):
    rebuilt: np.ndarray
    loss: float  # summed over rows
    gradient: np.ndarray | None  # of the summed loss
    moments: np.ndarray | None  # of the batch


def run(shape: Shape, flat: np.ndarray, x: np.ndarray, moments: np.ndarray, rng: np.random.Generator | None = None) -> Pass:
    """Rebuild x (rows by days). With rng as in training: the batch's own moments, dropout, and the gradient."""
    p, train, layers, half = shape.views(flat), rng is not None, shape.layers, len(shape.widths)
    a, kept, own, at = x[:, :, None], [], [], 0
    for k, (_, width, drop) in enumerate(layers):
        if k == half:
            ended, a = a, None
            z = ended @ p["zw"] + p["zb"]
            a = np.repeat(z[:, None, :], shape.days, axis=1)
        ahead, kept_f = _run(a, p[f"w{k}f"], p[f"b{k}f"])
        behind, kept_b = _run(a[:, ::-1], p[f"w{k}b"], p[f"b{k}b"])
        joined = np.concatenate([ahead[:, -1], behind[:, -1]], axis=1) if k == half - 1 else np.concatenate([ahead, behind[:, ::-1]], axis=2)
        axes = tuple(range(joined.ndim - 1))
        mean, var = (joined.mean(axis=axes), joined.var(axis=axes)) if train else (moments[at : at + 2 * width], moments[at + 2 * width : at + 4 * width])
        own += [mean, var]
        at += 4 * width
        scale = 1 / np.sqrt(var + EPSILON)
        normal = ((joined - mean) * scale).astype(x.dtype)
        a = normal * p[f"g{k}"] + p[f"s{k}"]
        mask = None
        if train and drop:
            mask = (rng.random(a.shape) >= drop).astype(x.dtype) / (1 - drop)
            a = a * mask
        kept.append((kept_f, kept_b, normal, scale, mask))
    rebuilt = (a @ p["ow"] + p["ob"])[:, :, 0]
    off = rebuilt - x
    size = np.abs(off)
    loss = float(np.where(size <= 1, 0.5 * off**2, size - 0.5).mean(axis=1).sum())
    if not train:
        return Pass(rebuilt, loss, None, None)
    gradient = np.zeros_like(flat)
    g = shape.views(gradient)
    d = (np.clip(off, -1, 1) / shape.days)[:, :, None]
    g["ow"][:] = np.tensordot(a, d, ((0, 1), (0, 1)))
    g["ob"][:] = d.sum()
    d = d @ p["ow"].T
    for k in reversed(range(len(layers))):
        kept_f, kept_b, normal, scale, mask = kept[k]
        width = layers[k][1]
        d = d if mask is None else d * mask
        axes = tuple(range(d.ndim - 1))
        g[f"g{k}"][:], g[f"s{k}"][:] = (d * normal).sum(axis=axes), d.sum(axis=axes)
        d = d * p[f"g{k}"]
        d = (scale * (d - d.mean(axis=axes) - normal * (d * normal).mean(axis=axes))).astype(x.dtype)
        if k == half - 1:
            ahead, behind = (np.zeros((len(x), shape.days, width), x.dtype) for _ in range(2))
            ahead[:, -1], behind[:, -1] = d[:, :width], d[:, width:]
        else:
            ahead, behind = d[:, :, :width], d[:, ::-1, width:]
        from_f, g[f"w{k}f"][:], g[f"b{k}f"][:] = _run_back(ahead, kept_f, p[f"w{k}f"])
        from_b, g[f"w{k}b"][:], g[f"b{k}b"][:] = _run_back(behind, kept_b, p[f"w{k}b"])
        d = from_f + from_b[:, ::-1]
        if k == half:
            d = d.sum(axis=1)
            g["zw"][:], g["zb"][:] = ended.T @ d, d.sum(axis=0)
            d = d @ p["zw"].T
    return Pass(rebuilt, loss, gradient, np.concatenate(own))
