"""Small numpy solvers behind the classifiers: what Spark's library lacks or solves differently."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def linear_svc(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Squared-hinge support vector weights (the intercept last, penalised alike) for labels +1 and -1, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    # in the span of the rows, so that many features cost no more than documents
    gram = a @ a.T
    alpha = np.zeros(len(a))
    for _ in range(rounds):
        out = gram @ alpha
        active = y * out < 1
        n = int(active.sum())
        if not n:
            break
        new = np.zeros(len(a))
        new[active] = np.linalg.solve(gram[np.ix_(active, active)] + np.eye(n) / (2 * c), y[active])
        if np.allclose(new, alpha, atol=1e-10):
            alpha = new
            break
        alpha = new
    w = a.T @ alpha
    return w


def folds_of(y: np.ndarray, k: int) -> np.ndarray:
    """Stratified folds without shuffling: each class is dealt out in order."""
    fold = np.zeros(len(y), int)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        fold[at] = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(at, k))])
    return fold


def unmask(x: np.ndarray, y: np.ndarray, eliminate: int, rounds: int, folds: int) -> float:
    """Accuracy lost while the strongest features are taken away round by round; y is 0 and 1."""
    folds = int(min(folds, (y == 1).sum(), (y == 0).sum()))
    if folds < 2:
        return 0.0
    sign, fold, active, acc = 2.0 * y - 1, folds_of(y, folds), np.arange(x.shape[1]), []
    for _ in range(rounds):
        if len(active) < eliminate + 1:
            break
        xs, hits = x[:, active], []
        for f in range(folds):
            t = fold == f
            w = linear_svc(xs[~t], sign[~t])
            hits.append(((xs[t] @ w[:-1] + w[-1] > 0) == (sign[t] > 0)).mean())
        acc.append(float(np.mean(hits)))
        w = np.abs(linear_svc(xs, sign)[:-1])
        active = np.delete(active, np.argsort(w, kind="stable")[-eliminate:])
    return acc[0] - acc[-1] if len(acc) > 1 else 0.0


def kernel(a: np.ndarray, b: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    if kind == "linear":
        return a @ b.T
    if kind == "poly":
        return (gamma * (a @ b.T)) ** 3
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class KernelSvm:
    """One-against-rest support vectors (squared hinge) with a logistic curve fitted to the training margins (Platt)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: str):
        self.x, self.kind = x, kind
        self.classes = np.unique(y)
        var = x.var()
        self.gamma = 1 / (x.shape[1] * var) if var > 0 else 1.0
        self.plain = kind == "linear" and x.shape[1] < len(x)
        if self.plain:  # weights of features instead of documents: the same steps and no matrix of documents by documents
            self.x, self.parts = x[:0], []
            for c in self.classes:
                s = np.where(y == c, 1.0, -1.0)
                w, bias = self._solve_plain(x, s)
                self.parts.append((w, bias, *self._platt(x @ w + bias, s)))
            return
        k = kernel(x, x, kind, self.gamma)
        self.parts = []
        for c in self.classes:
            s = np.where(y == c, 1.0, -1.0)
            alpha, bias = self._solve(k, s)
            self.parts.append((alpha, bias, *self._platt(k @ alpha + bias, s)))

    @staticmethod
    def _solve(k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
        alpha, bias = np.zeros(len(s)), 0.0
        for _ in range(60):
            active = s * (k @ alpha + bias) < 1
            n = int(active.sum())
            if not n:
                break
            m = np.ones((n + 1, n + 1))
            m[:n, :n] = k[np.ix_(active, active)] + np.eye(n) / 2
            m[n, n] = 0
            sol = np.linalg.lstsq(m, np.append(s[active], 0), rcond=None)[0]
            new = np.zeros(len(s))
            new[active] = sol[:n]
            done = np.allclose(new, alpha, atol=1e-10)
            alpha, bias = new, float(sol[n])
            if done:
                break
        return alpha, bias

    @staticmethod
    def _solve_plain(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, float]:
        """As ``_solve`` with a linear kernel, where alpha = 2 * (s - x w - bias) on the active documents and w = sum of alpha x."""
        w, bias, last = np.zeros(x.shape[1]), 0.0, None
        for _ in range(60):
            active = s * (x @ w + bias) < 1
            if not active.any() or last is not None and (active == last).all():
                break
            a = np.hstack([x[active], np.ones((int(active.sum()), 1))])
            m = 2 * a.T @ a
            m[np.arange(len(w)), np.arange(len(w))] += 1
            sol = np.linalg.lstsq(m, 2 * a.T @ s[active], rcond=None)[0]
            w, bias, last = sol[:-1], float(sol[-1]), active
        return w, bias

    @staticmethod
    def _platt(f: np.ndarray, s: np.ndarray) -> tuple[float, float]:
        up, down = (s > 0).sum(), (s < 0).sum()
        t = np.where(s > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * f).sum(), (p - t).sum()])
            h = np.array([[(w * f * f).sum() + 1e-6, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        return a, b

    def probability(self, x: np.ndarray) -> np.ndarray:
        k = x if self.plain else kernel(x, self.x, self.kind, self.gamma)
        p = np.stack([1 / (1 + np.exp(-np.clip(a * (k @ alpha + bias) + b, -30, 30))) for alpha, bias, a, b in self.parts], axis=1)
        return p / p.sum(axis=1, keepdims=True)


class Discriminant:
    """Linear discriminant analysis by singular values, for more features than documents too."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = np.unique(y)
        means = np.stack([x[y == c].mean(axis=0) for c in self.classes])
        prior = np.array([(y == c).mean() for c in self.classes])
        centred = x - means[np.searchsorted(self.classes, y)]
        std = centred.std(axis=0)
        std[std == 0] = 1
        _, s, v = np.linalg.svd(centred / std / np.sqrt(max(len(x) - len(self.classes), 1)), full_matrices=False)
        rank = int((s > 1e-4).sum())
        scale = (v[:rank] / std).T / s[:rank] if rank else np.zeros((x.shape[1], 0))
        self.mid = prior @ means
        _, s2, v2 = np.linalg.svd(((means - self.mid) * np.sqrt(len(x) * prior / max(len(self.classes) - 1, 1))[:, None]) @ scale, full_matrices=False)
        r2 = int((s2 > 1e-4 * max(s2[0], 1e-300)).sum()) if len(s2) else 0
        self.proj = scale @ v2[:r2].T
        self.centres = (means - self.mid) @ self.proj
        self.bias = -0.5 * (self.centres**2).sum(axis=1) + np.log(prior)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return softmax((x - self.mid) @ self.proj @ self.centres.T + self.bias)


class Perceptron:
    """One hidden ReLU layer, softmax, Adam; with R-Drop, two dropout passes and their symmetric divergence (Liang et al., 2021)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int, rounds: int, rate: float, r_drop: bool, alpha: float, dropout: float, seed: int = 0):
        self.classes = np.unique(y)
        t = np.eye(len(self.classes))[np.searchsorted(self.classes, y)]
        rng = np.random.default_rng(seed)
        d, c = x.shape[1], t.shape[1]
        w = [rng.uniform(-1, 1, (d, hidden)) * np.sqrt(6 / (d + hidden)), np.zeros(hidden), rng.uniform(-1, 1, (hidden, c)) * np.sqrt(6 / (hidden + c)), np.zeros(c)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, rounds + 1):
            passes = []
            for _ in range(2 if r_drop else 1):
                mask = (rng.random((len(x), hidden)) >= dropout) / (1 - dropout) if r_drop else 1.0
                z = x @ w[0] + w[1]
                h = np.maximum(z, 0) * mask
                passes.append((z, h, mask, softmax(h @ w[2] + w[3])))
            grads = [np.zeros_like(p) for p in w]
            for k, (z, h, mask, p) in enumerate(passes):
                g = (p - t) / len(passes)
                if r_drop:  # d/dz of alpha/2 * (KL(p, q) + KL(q, p)) / 2 for this pass's logits
                    q = passes[1 - k][3]
                    ratio = np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12))
                    g = g + alpha / 4 * (p * (ratio - (p * ratio).sum(axis=1, keepdims=True)) + p - q)
                g /= len(x)
                back = g @ w[2].T * mask * (z > 0)
                for i, d_ in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    grads[i] += d_
            grads[0] += 1e-4 * w[0] / len(x)
            grads[2] += 1e-4 * w[2] / len(x)
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * grads[i]
                v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def learn_projection(x: np.ndarray, labels: np.ndarray, dim: int, rounds: int, rate: float, seed: int) -> np.ndarray:
    """A linear map learned from random pairs: same author together, others apart up to a margin of one."""
    rng = np.random.default_rng(seed or None)
    w = rng.standard_normal((x.shape[1], dim)).astype(np.float32) * 0.01
    for _ in range(rounds if len(x) > 1 else 0):
        a, b = rng.integers(0, len(x)), rng.integers(0, len(x))
        delta = x[a] - x[b]
        d = delta @ w
        if labels[a] == labels[b]:
            w = w - rate * 2 * np.outer(delta, d)
        elif a != b and float(d @ d) < 1:
            w = w + rate * 2 * np.outer(delta, d)
    return w
