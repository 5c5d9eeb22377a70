"""Logistic regression on the driver, for bounded training sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimize(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 200, keep: int = 10, settled: float = 1e-6) -> np.ndarray:
    """L-BFGS with a halving line search. loss: the value and the gradient at w."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append(a := (s @ step) / (s @ y))
            step -= a * y
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            step += s * (a - (y @ step) / (s @ y))
        rate, slope = 1.0, float(grad @ step)
        while True:
            new_value, new_grad = loss(w - rate * step)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = -rate * step, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-keep:]
        done = value - new_value < settled * max(1.0, abs(value))
        w, value, grad = w + s, new_value, new_grad
        if done:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, l2: float, pairs: np.ndarray | None = None, agree: float = 0.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of the mean log loss, plus l2 |w|^2 / 2, plus agree times the mean squared score change over pairs.

    pairs: a row of feature differences for each pair whose scores should agree.
    """
    x = np.asarray(x, dtype=np.float32)
    weight = (np.ones(len(y)) if weight is None else weight) / (len(y) if weight is None else weight.sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[1:].astype(np.float32) + w[0]
        p = sigmoid(z)
        value = float(weight @ np.logaddexp(0, np.where(y > 0, -z, z))) + l2 / 2 * float(w[1:] @ w[1:])
        g = weight * (p - y)
        grad = np.r_[g.sum(), x.T @ g.astype(np.float32) + l2 * w[1:]]
        if pairs is not None and len(pairs):
            change = pairs @ w[1:].astype(np.float32)
            value += agree * float(np.mean(change**2))
            grad[1:] += 2 * agree / len(pairs) * (pairs.T @ change)
        return value, grad

    w = minimize(loss, np.zeros(x.shape[1] + 1))
    return w[1:], float(w[0])
