"""The exact Gaussian likelihood of an ARMA series that is cut into blocks.

For AR terms ``phi`` and MA terms ``theta`` the residuals ``a_t = x_t - phi.x - theta.a`` are linear in the p values and q
residuals before the first row: ``a = a0 + G u``, with a0 the residuals if those were zero. With ``u ~ N(0, s2 Omega)`` the
likelihood needs only the cross products of a0 and G (:func:`profile`). The recursion is linear in the q residuals before a
block as well, so a block is summed up without knowing them (:func:`summary`), and blocks are put together in order
(:func:`combined`): nothing needs a whole series. A mean is one more column, the residuals of a series of ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STEP = 64  # rows that the recursion advances by one matrix product


def coefficients(u: np.ndarray) -> np.ndarray:
    """Stationary AR coefficients from unbounded numbers: their tanh are the partial autocorrelations."""
    phi = np.zeros(0)
    for r in np.tanh(u):
        phi = np.append(phi - r * phi[::-1], r)
    return phi


def unbounded(phi: np.ndarray) -> np.ndarray:
    """The inverse of :func:`coefficients`; what lies outside its range is drawn in."""
    phi, out = np.asarray(phi, float), []
    while len(phi):
        r = float(np.clip(phi[-1], -0.95, 0.95))
        out.append(np.arctanh(r))
        phi = (phi[:-1] + r * phi[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def split(u: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA terms of a parameter vector; the MA part is invertible as the AR part is stationary."""
    return coefficients(u[:p]), -coefficients(u[p:])


def before_cov(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Covariance, for unit innovations, of (x_-1 .. x_-p, a_-1 .. a_-q)."""
    p, q = len(phi), len(theta)
    psi = np.zeros(max(p, q) + 1)
    ma = np.append(1.0, theta)
    for k in range(len(psi)):
        psi[k] = (ma[k] if k <= q else 0.0) + sum(phi[i] * psi[k - 1 - i] for i in range(min(p, k)))
    lhs, rhs = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
    for k in range(p + 1):  # gamma_k - phi.gamma = sum of ma_j psi_{j-k}
        lhs[k, k] += 1
        for i in range(p):
            lhs[k, abs(k - 1 - i)] -= phi[i]
        rhs[k] = sum(ma[j] * psi[j - k] for j in range(k, q + 1))
    gamma = np.linalg.solve(lhs, rhs)
    out = np.eye(p + q)
    for i in range(p):
        for j in range(p):
            out[i, j] = gamma[abs(i - j)]
        for j in range(q):
            out[i, p + j] = out[p + j, i] = psi[j - i] if j >= i else 0.0
    return out


def recursion(b: np.ndarray, theta: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """``y_t = b_t - theta.y`` by columns; ``carry``: the q rows before, the latest first."""
    q, (n, c) = len(theta), b.shape
    if not q or not n:
        return b
    step = max(STEP, q)
    unit = np.vstack([np.eye(q)[::-1], np.zeros((step, q))])  # responses to each carried row
    hit = np.append(1.0, np.zeros(step - 1))  # response to one input
    for t in range(step):
        unit[q + t] = -sum(theta[j] * unit[q + t - 1 - j] for j in range(q))
        if t:
            hit[t] = -sum(theta[j] * hit[t - 1 - j] for j in range(min(q, t)))
    rows = np.arange(step)
    lag = rows[:, None] - rows
    toeplitz = np.where(lag >= 0, hit[np.maximum(lag, 0)], 0.0)
    wide = np.zeros((-(-n // step) * step, c))
    wide[:n] = b
    y = toeplitz @ wide.reshape(-1, step, c)
    for i in range(len(y)):
        y[i] += unit[q:] @ carry
        carry = y[i, :-q - 1:-1]
    return y.reshape(-1, c)[:n]


def inputs(x: np.ndarray, before: np.ndarray | None, phi: np.ndarray, theta: np.ndarray, mean: bool) -> np.ndarray:
    """The recursion's inputs for a block: x, ones (if ``mean``) and the columns of G. ``before``: the p values before the
    block, the latest last; None for the first block."""
    p, q, n = len(phi), len(theta), len(x)
    first = before is None
    series = [np.concatenate([np.zeros(p) if first else before, x])]
    if mean:
        series.append(np.concatenate([np.zeros(p) if first else np.ones(p), np.ones(n)]))
    out = np.zeros((n, len(series) + p + q))
    for k, s in enumerate(series):
        out[:, k] = s[p:]
        for i in range(p):
            out[:, k] -= phi[i] * s[p - 1 - i:p - 1 - i + n]
    if first:
        for coef, at in ((phi, len(series)), (theta, len(series) + p)):
            for i in range(len(coef)):
                m = min(n, len(coef) - i)
                out[:m, at + i] -= coef[i:i + m]
    return out


def summary(x: np.ndarray, before: np.ndarray | None, phi: np.ndarray, theta: np.ndarray, mean: bool) -> tuple[np.ndarray, ...]:
    """What :func:`combined` needs of a block: cross products of its residuals and of the responses to the carried rows, and
    both at its end."""
    q = len(theta)
    b = inputs(x, before, phi, theta, mean)
    y = recursion(b, theta, np.zeros((q, b.shape[1])))
    r = recursion(np.zeros((len(x), q)), theta, np.eye(q))
    return y.T @ y, y.T @ r, r.T @ r, _end(y, q, np.zeros((q, b.shape[1]))), _end(r, q, np.eye(q))


def _end(y: np.ndarray, q: int, before: np.ndarray) -> np.ndarray:
    """The last q rows, the latest first; of a shorter block, with the rows before it."""
    return np.vstack([y[::-1], before])[:q] if len(y) < q else y[:-q - 1:-1] if q else before


def combined(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cross products over all blocks, in order, and the carried rows before each."""
    total, carry, carries = 0.0, None, []
    for yy, yr, rr, y_end, r_end in blocks:
        carry = np.zeros_like(y_end) if carry is None else carry
        carries.append(carry)
        total = total + yy + yr @ carry + (yr @ carry).T + carry.T @ rr @ carry
        carry = y_end + r_end @ carry
    return total, carries


def profile(m: np.ndarray, n: int, phi: np.ndarray, theta: np.ndarray, mean: bool) -> tuple[float, float, float]:
    """(-2 log likelihood / n without constants, mean, innovation variance) at the best mean and variance."""
    g = 2 if mean else 1
    if not n:
        return np.inf, 0.0, np.nan
    omega = before_cov(phi, theta)
    size = np.eye(len(omega)) + omega @ m[g:, g:]
    inner = np.linalg.solve(size, omega)
    v = m[:g, :g] - m[:g, g:] @ inner @ m[g:, :g]
    mu = v[0, 1] / v[1, 1] if mean and v[1, 1] > 0 else 0.0
    s = max(v[0, 0] - (mu * v[0, 1] if mean else 0.0), 0.0)
    return np.log(max(s / n, 1e-300)) + np.linalg.slogdet(size)[1] / n, mu, s / n


def innovations(x: np.ndarray, before: np.ndarray | None, carry: np.ndarray, phi: np.ndarray, theta: np.ndarray, mu: float,
                mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """One-step prediction errors of a block, and its last q residuals (latest first). In the first block each row is
    predicted from the rows before it alone: the values before the series are estimated as they become known."""
    y = recursion(inputs(x, before, phi, theta, mean), theta, carry)
    g = 2 if mean else 1
    v = y[:, 0] - (mu * y[:, 1] if mean else 0.0)
    if before is None and len(phi) + len(theta):
        at, cov = np.zeros(len(phi) + len(theta)), before_cov(phi, theta)
        for t in range(len(v)):
            w = y[t, g:]
            if t > len(at) and np.abs(w).max() < 1e-10:
                break
            v[t] += w @ at
            gain = cov @ w / (1 + w @ cov @ w)
            at = at - gain * v[t]
            cov = cov - np.outer(gain, w @ cov)
    return v, _end(v[:, None], len(theta), np.zeros((len(theta), 1)))[:, 0]


def start(x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Hannan-Rissanen: a long autoregression's residuals stand in for the innovations in a second regression."""
    def lagged(s: np.ndarray, k: int, m: int) -> np.ndarray:
        return np.column_stack([s[m - i:len(s) - i] for i in range(1, k + 1)]) if k else np.zeros((len(s) - m, 0))
    x = x - x.mean() if len(x) else x
    m = max(2 * (p + q), 4) if q else p
    if len(x) < 3 * (m + p + q + 1):
        return np.zeros(p + q)
    e = np.zeros(0)
    if q:
        long = lagged(x, m, m)
        e = np.concatenate([np.zeros(m), x[m:] - long @ np.linalg.lstsq(long, x[m:], rcond=None)[0]])
    k = m + max(p, q) if q else p
    design = np.column_stack([lagged(x, p, k), lagged(e, q, k)]) if q else lagged(x, p, k)
    beta = np.linalg.lstsq(design, x[k:], rcond=None)[0] if design.shape[1] else np.zeros(0)
    return np.concatenate([unbounded(beta[:p]), unbounded(-beta[p:])])


def minimise(u: np.ndarray, steps: int = 60) -> Iterator:
    """A quasi-Newton search as a generator: yields lists of points, is sent their values, and returns the best point. A
    turn asks for a gradient and then for several step lengths at once, so a caller may evaluate a list in one pass."""
    k, h = len(u), 1e-5
    values = yield [u] + [u + d for d in h * np.eye(k)] + [u - d for d in h * np.eye(k)]
    f, grad, inverse = values[0], (np.array(values[1:k + 1]) - np.array(values[k + 1:])) / (2 * h), np.eye(k)
    for _ in range(steps if k else 0):
        way = -inverse @ grad
        if way @ grad > -1e-300:
            inverse, way = np.eye(k), -grad
        way = way / max(1.0, np.abs(way).max() / 2)
        lengths = [1.0, 0.5, 0.2, 0.05, 0.01, 1e-3, 2.0]
        tried = yield [u + s * way for s in lengths]
        best = int(np.nanargmin(np.where(np.isfinite(tried), tried, np.inf)))
        if not tried[best] < f - 1e-12:
            break
        new = u + lengths[best] * way
        values = yield [new + d for d in h * np.eye(k)] + [new - d for d in h * np.eye(k)]
        fresh = (np.array(values[:k]) - np.array(values[k:])) / (2 * h)
        s, y, gain = new - u, fresh - grad, f - tried[best]
        if s @ y > 1e-14:
            left = np.eye(k) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        u, f, grad = new, tried[best], fresh
        if gain < 1e-11 or np.abs(grad).max() < 1e-8:
            break
    return u
