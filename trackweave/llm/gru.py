"""Gated recurrent layers in numpy: many lanes a step, gradients through a window of steps."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; through tanh, which doesn't overflow."""
    x *= F32(0.5)
    np.tanh(x, out=x)
    x += F32(1)
    x *= F32(0.5)
    return x


def by_exponent(x: np.ndarray) -> np.ndarray:
    """As sigmoid(), in place; exp takes a third of the time of tanh."""
    np.negative(x, out=x)
    np.minimum(x, F32(60), out=x)  # exp stays finite
    np.exp(x, out=x)
    x += F32(1)
    return np.reciprocal(x, out=x)


def tanh_by_exponent(x: np.ndarray) -> np.ndarray:
    """tanh as 2 sigmoid(2 x) - 1, in place."""
    x += x
    by_exponent(x)
    x += x
    x -= F32(1)
    return x


def in_place_tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


def forward(inputs, h: np.ndarray, u: np.ndarray, keep: bool = False, alive: np.ndarray | None = None, gate=sigmoid, squash=in_place_tanh):
    """States (steps, lanes, H) of z, r, n gates over inputs(steps, lanes, 3H), from state h.

    inputs holds the projected inputs with biases. alive(steps, lanes) marks steps that count;
    elsewhere the state stays. keep also returns what backward() needs. gate and squash work in place.
    """
    steps, lanes, size = len(inputs), len(h), len(u)
    out = np.empty((steps, lanes, size), F32)
    cache = []
    for t in range(steps):
        x = inputs[t]
        a = h @ u
        g = gate(x[:, : 2 * size] + a[:, : 2 * size])
        z, r = g[:, :size], g[:, size:]
        n = a[:, 2 * size :] * r
        n += x[:, 2 * size :]
        squash(n)
        new = h - n
        new *= z
        new += n
        if alive is not None:
            new = np.where(alive[t][:, None], new, h)
        if keep:
            cache.append((h, z, r, n, a[:, 2 * size :]))
        out[t] = h = new
    return (out, cache) if keep else out


def backward(d_out: np.ndarray, cache: list, u: np.ndarray, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of u, given those of the states."""
    if alive is None:
        return _backward_all(d_out, cache, u)
    steps, lanes, size = d_out.shape
    d_in, d_u, d_h = np.empty((steps, lanes, 3 * size), F32), np.zeros_like(u), np.zeros((lanes, size), F32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, an = cache[t]
        d = d_h + d_out[t]
        held = None
        if alive is not None:
            held = np.where(alive[t][:, None], F32(0), d)
            d = np.where(alive[t][:, None], d, F32(0))
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        da = np.concatenate((dz, dr, dn * r), 1)
        d_in[t] = np.concatenate((dz, dr, dn), 1)
        d_u += h.T @ da
        d_h = d * z + da @ u.T
        if held is not None:
            d_h += held
    return d_in, d_u


def _backward_all(d_out: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """backward() where all steps count: what doesn't need later steps is worked out for all of them at once."""
    steps, lanes, size = d_out.shape
    h, z, r, n, an = (np.stack(x) for x in zip(*cache, strict=True))
    by_n = (1 - z) * (1 - n * n)
    by = np.concatenate(((h - n) * z * (1 - z), by_n * an * r * (1 - r), by_n * r), 2).reshape(steps, lanes, 3, size)
    da, d_h, back = np.empty((steps, lanes, 3, size), F32), np.zeros((lanes, size), F32), np.ascontiguousarray(u.T)
    d_n = np.empty((steps, lanes, size), F32)
    for t in range(steps - 1, -1, -1):
        d = np.add(d_h, d_out[t], out=d_n[t])
        np.multiply(by[t], d[:, None], out=da[t])
        d_h = da[t].reshape(lanes, 3 * size) @ back
        d_h += d * z[t]
    da = da.reshape(steps, lanes, 3 * size)
    d_u = h.reshape(-1, size).T @ da.reshape(-1, 3 * size)
    d_in = da.copy()
    np.multiply(d_n, by_n, out=d_in[:, :, 2 * size :])
    return d_in, d_u


class Adam:
    """Adam steps over a dictionary of arrays, with the gradients' norm held to a bound."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, norm: float = 5.0):
        self.params, self.rate, self.norm, self.t = params, rate, norm, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        total = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = F32(min(1.0, self.norm / (total + 1e-9)))
        rate = F32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            self.params[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def pack(params: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **params)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}
