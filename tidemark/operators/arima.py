"""ARMA models of a differenced series: exact Gaussian likelihood and forecasts in numpy.

This is the small numeric core that grouped-map functions call for one series.
"""

from __future__ import annotations

import math

import numpy as np


def _stable(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from unbounded numbers, by partial autocorrelations."""
    out = np.zeros(0, raw.dtype)
    for r in np.tanh(raw):
        out = np.append(out - r * out[::-1], r)
    return out


def _start(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, impulse and stationary covariance (for unit variance) of the state."""
    r = max(len(phi), len(theta) + 1)
    t, impulse = np.zeros((r, r)), np.zeros(r)
    t[: len(phi), 0] = phi
    t[:-1, 1:] += np.eye(r - 1)
    impulse[0], impulse[1 : len(theta) + 1] = 1, theta
    q = np.outer(impulse, impulse)
    p = np.linalg.solve(np.eye(r * r) - np.kron(t, t), q.ravel()).reshape(r, r)
    return t, impulse, p


def errors(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and their variances for unit innovations; once these settle, plain recursion goes on."""
    t, impulse, p = _start(phi, theta)
    q, a, n = np.outer(impulse, impulse), np.zeros(len(impulse)), len(y)
    e, f = np.empty(n), np.ones(n)
    i = 0
    while i < n:
        f[i] = max(p[0, 0], 1e-12)
        e[i] = y[i] - a[0]
        gain = p[:, 0] / f[i]
        a = t @ (a + gain * e[i])
        p = t @ (p - np.outer(gain, p[0])) @ t.T + q
        i += 1
        if i > 8 and abs(f[i - 1] - 1) < 1e-9:
            break
    (a1, a2), (b1, b2) = ((*c.tolist(), 0.0, 0.0)[:2] for c in (phi, theta))  # orders up to two
    out, past = e[:i].tolist(), y.tolist()
    if i < n:
        y2, y1, e2, e1 = past[i - 2], past[i - 1], out[i - 2], out[i - 1]
        for now in past[i:]:
            e2, e1 = e1, now - a1 * y1 - a2 * y2 - b1 * e1 - b2 * e2
            y2, y1 = y1, now
            out.append(e1)
    return np.array(out), f


def log_likelihood(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[float, float]:
    """(likelihood, innovation variance) with the variance at its best value."""
    e, f = errors(y, phi, theta)
    variance = max(float(np.mean(e * e / f)), 1e-300)
    return -0.5 * (len(y) * (math.log(2 * math.pi * variance) + 1) + float(np.log(f).sum())), variance


def _response(theta: np.ndarray, n: int) -> np.ndarray:
    """The first n coefficients of 1 / (1 + theta_1 B + theta_2 B^2), doubled from the first ones on."""
    t1, t2 = (*theta, 0.0, 0.0)[:2]
    h = np.ones(1)
    while len(h) < n:
        before = h[-2] if len(h) > 1 else 0.0
        follow = -t1 * h[-1] - t2 * before
        h = np.concatenate((h, h * follow - t2 * np.concatenate(([0.0], h[:-1])) * h[-1]))
    return h[:n]


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((np.zeros(k), x[:-k]))


class _Likelihood:
    """Exact log likelihood of a zero-mean ARMA(p, q), p and q up to 2, with the variance at its best value, and its gradient.

    Errors from a zero state are a filter of the series.  The true ones differ by a linear
    function of the unknown first state, whose covariance the coefficients give, so the exact
    determinant and sum of squares come from matrices of the state's size.  Filters are products of
    Fourier transforms; no step loops over time.
    """

    def __init__(self, y: np.ndarray, p: int, q: int):
        self.y, self.p, self.q, self.n = y, p, q, len(y)
        self.size = 1 << (2 * self.n - 1).bit_length()
        self.lags = np.array([_shift(y, i + 1) for i in range(p)]).reshape(p, self.n)

    def at(self, phi: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, float]:
        """(log likelihood, its gradient by phi and theta, variance)."""
        n, p, q = self.n, self.p, self.q
        h = _response(theta, n)
        spectrum = np.fft.rfft(h, self.size)
        filtered = lambda x: np.fft.irfft(np.fft.rfft(x, self.size) * spectrum, self.size)[..., :n]
        backward = lambda x: filtered(x[..., ::-1])[..., ::-1]
        e = self.y - phi @ self.lags
        e = filtered(e) if q else e
        ones, zero = np.zeros(2), np.zeros((2, 2))
        ar, ma = ones.copy(), ones.copy()
        ar[:p], ma[:q] = phi, theta
        f, g = np.array([[ar[0], 1.0], [ar[1], 0.0]]), ar + ma  # the state before each value: what lies behind it of the next two
        solve = np.linalg.inv(np.eye(4) - np.kron(f, f))
        cov = (solve @ np.outer(g, g).ravel()).reshape(2, 2)
        a = -np.array([h, _shift(h, 1)])
        s, ae = a @ a.T, a @ e
        m = np.eye(2) + cov @ s
        z = -np.linalg.solve(m.T, ae)  # the first state in units of its covariance
        best = e + (cov @ z) @ a
        total = max(float(e @ e + ae @ (cov @ z)), 1e-300)
        variance = total / n
        value = -0.5 * (n * (math.log(2 * math.pi * variance) + 1) + float(np.linalg.slogdet(m)[1]))
        minv = np.linalg.inv(m)
        back, back_a = (backward(best), backward(a)) if q else (best, a)
        slope = np.empty(p + q)
        for k in range(p + q):
            i = k if k < p else k - p
            df, dg, ds = zero.copy(), ones.copy(), zero
            dg[i] = 1.0
            if k < p:
                df[i, 0] = 1.0
                dq = -2 * (back @ self.lags[i])
            else:
                dq = -2 * (back[i + 1 :] @ best[: n - i - 1])
                w = back_a[:, i + 1 :] @ a[:, : n - i - 1].T
                ds = -(w + w.T)
            right = df @ cov @ f.T
            outer = np.outer(dg, g)
            dcov = (solve @ (right + right.T + outer + outer.T).ravel()).reshape(2, 2)
            dq -= z @ dcov @ z
            slope[k] = -0.5 * (dq / variance + np.trace(minv @ (dcov @ s + cov @ ds)))
        return value, slope, variance


def _minimum(f, x: np.ndarray, steps: int = 200, tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """BFGS with halved steps; f gives a value and its gradient."""
    value, slope = f(x)
    inverse = np.eye(len(x))
    small = 0
    for _ in range(steps):
        move = -inverse @ slope
        if move @ slope >= 0 or not np.isfinite(move).all():
            inverse = np.eye(len(x))
            move = -slope
        move *= min(1.0, 2.0 / max(1e-300, float(np.abs(move).max())))
        rate = 1.0
        while True:
            new, new_slope = f(x + rate * move)
            if new <= value + 1e-4 * rate * (move @ slope) or rate < 1e-8:
                break
            rate *= 0.5
        if not new < value:
            break
        dx, dg = rate * move, new_slope - slope
        small = small + 1 if value - new < tol else 0
        x, value, slope = x + dx, new, new_slope
        if small >= 2:
            break
        if (c := float(dx @ dg)) > 1e-12:
            v = np.eye(len(x)) - np.outer(dx, dg) / c
            inverse = v @ inverse @ v.T + np.outer(dx, dx) / c
    return value, x


def _partial(coefficients: np.ndarray) -> np.ndarray | None:
    """Unbounded numbers that `_stable` turns into the coefficients; None if they are not stationary."""
    out, c = [], np.asarray(coefficients, float)
    while len(c):
        r = c[-1]
        if not abs(r) < 0.999:
            return None
        out.append(math.atanh(r))
        c = (c[:-1] + r * c[-2::-1]) / (1 - r * r) if len(c) > 1 else c[:0]
    return np.array(out[::-1])


def _regression(y: np.ndarray, p: int, q: int) -> np.ndarray | None:
    """Starting values by two regressions: errors from a long autoregression, then the series on its own and the errors' lags."""
    n, long_ = len(y), min(len(y) // 4, 4 + int(10 * math.log10(len(y))))
    if long_ < 1 or n - long_ - max(p, q) < 2 * (p + q) + 2:
        return None
    lagged = lambda x, k: np.column_stack([_shift(x, i + 1) for i in range(k)])
    a = lagged(y, long_)[long_:]
    e = np.concatenate((np.zeros(long_), y[long_:] - a @ np.linalg.lstsq(a, y[long_:], rcond=None)[0]))
    from_ = long_ + max(p, q)
    b = np.column_stack([x for x, k in ((lagged(y, p) if p else None, p), (lagged(e, q) if q else None, q)) if k])[from_:]
    c = np.linalg.lstsq(b, y[from_:], rcond=None)[0]
    parts = [_partial(c[:p]), _partial(-c[p:])]
    return None if any(x is None for x in parts) else np.concatenate(parts)


def _jacobian(raw: np.ndarray) -> np.ndarray:
    """Of `_stable`, by a step along the imaginary axis, which rounds nothing."""
    steps = np.eye(len(raw)) * 1e-30j
    return np.array([_stable(raw + s).imag / 1e-30 for s in steps]).reshape(len(raw), len(raw)).T


def fit(y: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(phi, theta, innovation variance, AIC) of a zero-mean ARMA(p, q), p and q up to 2.

    The better of the searches from the regressions' values and from a neutral start; with three or
    four coefficients the likelihood may have a higher peak elsewhere.
    """
    if len(y) < p + q + 2 or not np.isfinite(y).all():
        raise ValueError("too few values")

    def split(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _stable(raw[:p]), -_stable(raw[p:])

    raw = np.zeros(p + q)
    if p + q:
        likelihood = _Likelihood(y / (float(np.std(y)) or 1.0), p, q)

        def cost(raw: np.ndarray) -> tuple[float, np.ndarray]:
            inside = np.clip(raw, -6, 6)
            value, slope, _ = likelihood.at(*split(inside))
            own = np.concatenate((_jacobian(inside[:p]).T @ slope[:p], -_jacobian(inside[p:]).T @ slope[p:]))
            return -value, np.where(inside == raw, -own, 0.0)

        starts = [s for s in (_regression(y, p, q), raw + 0.1) if s is not None]
        _, raw = min((_minimum(cost, s) for s in starts), key=lambda found: found[0])
    phi, theta = split(np.clip(raw, -6, 6))
    value, _, variance = _Likelihood(y, p, q).at(phi, theta)
    return phi, theta, variance, -2 * value + 2 * (p + q + 1)


def one_step(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The prediction of each value from those before it."""
    return y - errors(y, phi, theta)[0]


def project(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, variance: float, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the summed series (relative to its last value) over the horizon."""
    e = errors(y, phi, theta)[0]
    past, shocks = list(y), list(e)
    for _ in range(horizon):
        v = sum(c * past[-1 - k] for k, c in enumerate(phi) if k < len(past)) + sum(c * shocks[-1 - k] for k, c in enumerate(theta) if k < len(shocks))
        past.append(v)
        shocks.append(0.0)
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = 1.0 if j == 0 else (theta[j - 1] if j - 1 < len(theta) else 0.0) + sum(phi[k] * psi[j - 1 - k] for k in range(min(len(phi), j)))
    return np.cumsum(past[len(y) :]), variance * np.cumsum(np.cumsum(psi) ** 2)
