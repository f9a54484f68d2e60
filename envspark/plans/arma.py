"""Gaussian likelihood of ARMA(2, 2) without a constant (J4), batched over parameter vectors.

The state-space form has three states; the Kalman filter starts from the stationary distribution, so the
likelihood is exact.  The search runs in partial autocorrelations, which keep both polynomials inside the
unit circle, with the variance concentrated out; standard errors come from the outer product of the
numeric scores.  One pass of the filter takes a whole batch of parameter vectors, so a gradient or a line
search is one pass.  A station gives at most 24 x training-days values.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Partial autocorrelations tried for each of the four coefficients before the search.
START_LEVELS = (-0.6, 0.0, 0.6)
#: Searches started, from the best of those points.
STARTS = 2
MAX_STEPS = 80
_STEP_LENGTHS = 2.0 ** np.arange(1, -12, -1)
_BOUND = 40.0  # of the search variable: a partial autocorrelation of 0.9997


def _coefficients(u: np.ndarray) -> np.ndarray:
    """(B, 4) unbounded values -> (B, 4) AR and MA coefficients inside the stationary, invertible region."""
    r = u / np.sqrt(1 + u * u)
    ar = np.stack([r[:, 0] * (1 - r[:, 1]), r[:, 1]], 1)
    ma = -np.stack([r[:, 2] * (1 - r[:, 3]), r[:, 3]], 1)
    return np.concatenate([ar, ma], 1)


def _system(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, state noise and stationary state covariance for unit variance."""
    size = len(c)
    move = np.zeros((size, 3, 3))
    move[:, 0, 0], move[:, 1, 0], move[:, 0, 1], move[:, 1, 2] = c[:, 0], c[:, 1], 1.0, 1.0
    load = np.stack([np.ones(size), c[:, 2], c[:, 3]], 1)
    noise = load[:, :, None] * load[:, None, :]
    twice = np.einsum("bij,bkl->bikjl", move, move).reshape(size, 9, 9)
    start = np.linalg.solve(np.eye(9) - twice, noise.reshape(size, 9, 1)).reshape(size, 3, 3)
    return move, noise, start


def innovations(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prediction errors (B, n), their relative variances (B, n), the state after the last value and the transition."""
    move, noise, cov = _system(c)
    state = np.zeros((len(c), 3))
    errors, scales = np.empty((len(c), len(x))), np.empty((len(c), len(x)))
    for t, value in enumerate(x):
        scale = np.maximum(cov[:, 0, 0], 1e-12)
        error = value - state[:, 0]
        errors[:, t], scales[:, t] = error, scale
        gain = cov[:, :, 0] / scale[:, None]
        state = np.einsum("bij,bj->bi", move, state + gain * error[:, None])
        cov = move @ (cov - gain[:, :, None] * cov[:, 0, None, :]) @ move.transpose(0, 2, 1) + noise
    return errors, scales, state, move


def _cost(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Negative log likelihood with the variance at its best value, up to a constant."""
    errors, scales, _, _ = innovations(_coefficients(u), x)
    variance = (errors * errors / scales).mean(1)
    cost = 0.5 * len(x) * np.log(np.maximum(variance, 1e-300)) + 0.5 * np.log(scales).sum(1)
    return np.where(np.isfinite(cost), cost, np.inf)


def _gradient(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    step = 1e-5 * np.maximum(1.0, np.abs(u))
    cost = _cost(np.concatenate([u + np.diag(step), u - np.diag(step)]), x)
    return (cost[:4] - cost[4:]) / (2 * step)


def _descend(u: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Quasi-Newton steps (inverse Hessian update) with a line search over fixed step lengths."""
    cost, slope, inverse = _cost(u[None], x)[0], _gradient(u, x), np.eye(4) / max(len(x), 1)
    for _ in range(MAX_STEPS):
        direction = -inverse @ slope
        if direction @ slope >= 0:
            inverse, direction = np.eye(4) / len(x), -slope / len(x)
        tried = np.clip(u + _STEP_LENGTHS[:, None] * direction, -_BOUND, _BOUND)
        costs = _cost(tried, x)
        best = int(np.argmin(costs))
        gained = cost - costs[best]
        if not gained > 1e-9 * max(1.0, abs(cost)):
            break
        moved, new_slope = tried[best] - u, _gradient(tried[best], x)
        bend = new_slope - slope
        u, slope, cost = tried[best], new_slope, costs[best]
        curvature = moved @ bend
        if curvature > 1e-12:
            left = np.eye(4) - np.outer(moved, bend) / curvature
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curvature
    return float(cost), u


def log_likelihoods(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(B, n) log density of each value given those before it; ``p`` holds AR 1-2, MA 1-2 and the variance."""
    errors, scales, _, _ = innovations(p[:, :4], x)
    spread = scales * p[:, 4:]
    return -0.5 * (np.log(2 * np.pi * spread) + errors * errors / spread)


def standard_errors(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    step = 1e-5 * np.maximum(np.abs(p), 1e-2)
    dense = log_likelihoods(np.concatenate([p + np.diag(step), p - np.diag(step)]), x)
    scores = (dense[:5] - dense[5:]) / (2 * step[:, None])
    return np.sqrt(np.clip(np.diag(np.linalg.pinv(scores @ scores.T)), 0, None))


def fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(AR 1-2, MA 1-2, variance) of greatest likelihood, and their standard errors."""
    if len(x) < 8:
        raise ValueError("series too short for ARMA(2,2)")
    if not np.any(x):
        return np.zeros(5), np.zeros(5)
    levels = np.array(list(itertools.product(START_LEVELS, repeat=4)))
    starts = levels / np.sqrt(1 - levels * levels)
    order = np.argsort(_cost(starts, x), kind="stable")[:STARTS]
    _, u = min((_descend(starts[k], x) for k in order), key=lambda found: found[0])
    c = _coefficients(u[None])
    errors, scales, _, _ = innovations(c, x)
    p = np.append(c[0], (errors * errors / scales).mean())
    return p, standard_errors(p, x)


def forecast(p: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """The next ``steps`` values expected after ``x``."""
    _, _, state, move = innovations(p[None, :4], x)
    out = np.empty(steps)
    for k in range(steps):
        out[k] = state[0, 0]
        state = np.einsum("bij,bj->bi", move, state)
    return out
