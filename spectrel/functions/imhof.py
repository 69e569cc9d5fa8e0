"""Distribution of weighted sums of chi-square variables, by numerical inversion to a given accuracy."""

from __future__ import annotations

import numpy as np

NODES, SHARES = np.polynomial.legendre.leggauss(16)
#: Points that are evaluated at once, and halvings of the panels at most.
CHUNK, HALVINGS = 1 << 16, 8


class _Integrand:
    """sin(theta(u)) / (u rho(u)) with its bounds. Weights, quantile and normal part are over the largest weight."""

    def __init__(self, q: float, w: np.ndarray, h: np.ndarray, c: np.ndarray, normal: float):
        self.q, self.w, self.h, self.c, self.normal = q, w, h, c, normal
        by = np.argsort(-np.abs(w))
        self.halves = np.cumsum(h[by]) / 2
        self.logs = np.cumsum(h[by] / 2 * np.log(np.abs(w[by])))

    def log_rho(self, u: np.ndarray) -> np.ndarray:
        out = 0.5 * (self.normal * u) ** 2
        for v, n, m in zip(self.w, self.h, self.c, strict=True):
            x = (v * u) ** 2
            out = out + 0.25 * n * np.log1p(x) + 0.5 * m * x / (1 + x)
        return out

    def __call__(self, u: np.ndarray) -> np.ndarray:
        theta = -0.5 * self.q * u
        for v, n, m in zip(self.w, self.h, self.c, strict=True):
            theta = theta + 0.5 * (n * np.arctan(v * u) + m * v * u / (1 + (v * u) ** 2))
        return np.sin(theta) / u * np.exp(-self.log_rho(u))

    def bend(self, u: float) -> float:
        """At least |theta' + q / 2| from u on, and the total variation of theta' there."""
        return float((0.5 * np.abs(self.w) * (self.h + 2.5 * self.c) / (1 + (self.w * u) ** 2)).sum())

    def tail(self, u: float) -> float:
        """A bound on the integral from u on: by the amplitude, whose powers of u integrate for any of the largest weights, or by the
        oscillation, integrating by parts where the phase runs steadily."""
        far = 0.5 * (self.normal * u) ** 2
        logs = [-far - np.log(self.halves) - self.halves * np.log(u) - self.logs] if len(self.w) else []
        if self.normal:
            logs.append(np.array([-far - 2 * np.log(abs(self.normal) * u)]))
        out = float(np.exp(min(x.min() for x in logs)))
        b = self.bend(u)
        steady = abs(self.q) / 2 - b
        if steady > 0:
            out = min(out, float(np.exp(-self.log_rho(np.array(u)))) / u / steady * (2 + b / steady))
        return out

    def edges(self, end: float) -> np.ndarray:
        """Panels with at most half a turn of the phase each, narrow at the start where the amplitude changes."""
        out, u = [0.0], 0.0
        while u < end:
            u += min(0.25 + 0.5 * u, np.pi / (abs(self.q) / 2 + self.bend(u) + 1e-300))
            out.append(min(u, end))
        return np.array(out)

    def sum(self, edges: np.ndarray) -> float:
        total, step = 0.0, CHUNK // len(NODES)
        for i in range(0, len(edges) - 1, step):
            a, b = edges[i : i + step + 1][:-1], edges[i + 1 : i + step + 1]
            half = (b - a) / 2
            total += float((self(a[:, None] + half[:, None] * (1 + NODES)) @ SHARES) @ half)
        return total


def imhof_cdf(q: float, weights, dfs=None, ncs=None, sigma: float = 0.0, acc: float = 1e-6) -> float:
    """P(sum w_i chi2(dfs_i, ncs_i) + normal part <= q), with an error of ``acc`` at most, clipped to [0, 1].

    The integral ends where a bound on what remains is a quarter of what ``acc`` allows; its panels follow the phase and are halved until halving
    changes the sum by no more than another quarter. If it can't be reached that way, ArithmeticError.

    Degrees of freedom are 1 and non-centralities 0 unless given. The normal part enters the integrand as exp(-sigma^2 u^2 / 2), as in
    the formula to match; in Imhof's variable that is a standard deviation of 2 sigma.
    """
    w = np.asarray(weights, float)
    h, c = np.ones(len(w)) if dfs is None else np.asarray(dfs, float), np.zeros(len(w)) if ncs is None else np.asarray(ncs, float)
    if not len(w) == len(h) == len(c):
        raise ValueError("weights, dfs and ncs differ in number")
    w, h, c = w[w != 0], h[w != 0], c[w != 0]
    scale = max(np.abs(w).max(initial=0.0), abs(sigma))
    if not scale:
        return float(q >= 0)
    f = _Integrand(q / scale, w / scale, h, c, sigma / scale)
    allowed, end = acc * np.pi / 4, 1.0
    while f.tail(end) > allowed:
        end *= 1.5
        if end > 1e9:
            raise ArithmeticError(f"an accuracy of {acc} can't be reached at {q}")
    edges = f.edges(end)
    last = f.sum(edges)
    for _ in range(HALVINGS):
        edges = np.sort(np.concatenate([edges, (edges[1:] + edges[:-1]) / 2]))
        now = f.sum(edges)
        if abs(now - last) <= allowed:
            return float(np.clip(0.5 - now / np.pi, 0, 1))
        last = now
    raise ArithmeticError(f"an accuracy of {acc} can't be reached at {q}")
