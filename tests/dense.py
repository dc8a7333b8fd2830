"""Dense in-memory Cox regression, written loop by loop, to check the Spark one."""

import numpy as np


def _sets(start, stop, event):
    for t in np.unique(stop[event == 1]):
        yield t, np.flatnonzero((start < t) & (stop >= t)), np.flatnonzero((stop == t) & (event == 1))


def derivatives(beta, x, start, stop, event, w):
    p = x.shape[1]
    ll, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    r = w * np.exp(x @ beta)
    for _, risk, dead in _sets(start, stop, event):
        d = len(dead)
        mean_w = w[dead].sum() / d
        ll += (w[dead] * (x[dead] @ beta)).sum()
        grad += (w[dead, None] * x[dead]).sum(axis=0)
        for k in range(d):
            share = r.copy()
            share[dead] *= 1 - k / d
            s0 = share[risk].sum()
            s1 = (share[risk, None] * x[risk]).sum(axis=0)
            s2 = (share[risk, None, None] * x[risk, :, None] * x[risk, None, :]).sum(axis=0)
            ll -= mean_w * np.log(s0)
            grad -= mean_w * s1 / s0
            info += mean_w * (s2 / s0 - np.outer(s1, s1) / s0**2)
    return ll, grad, info


def fit(x, start, stop, event, w=None):
    w = np.ones(len(x)) if w is None else w
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        _, grad, info = derivatives(beta, x, start, stop, event, w)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def jumps(beta, x, start, stop, event, w):
    out = {}
    r = w * np.exp(x @ beta)
    for t, risk, dead in _sets(start, stop, event):
        d = len(dead)
        mean_w = w[dead].sum() / d
        total, dying = r[risk].sum(), r[dead].sum()
        out[int(t)] = sum(mean_w / (total - k / d * dying) for k in range(d))
    return out


def robust_se(beta, x, start, stop, event, w, id):
    _, _, info = derivatives(beta, x, start, stop, event, w)
    r = np.exp(x @ beta)
    score = np.zeros_like(x)
    for _, risk, dead in _sets(start, stop, event):
        d = len(dead)
        mean_w = w[dead].sum() / d
        for k in range(d):
            keep = np.ones(len(x))
            keep[dead] = 1 - k / d
            share = w * r * keep
            s0 = share[risk].sum()
            mean = (share[risk, None] * x[risk]).sum(axis=0) / s0
            score[dead] += (x[dead] - mean) / d
            score[risk] -= (r[risk] * keep[risk] * mean_w / s0)[:, None] * (x[risk] - mean)
    by_id = np.array([(w[:, None] * score)[id == i].sum(axis=0) for i in np.unique(id)])
    bread = np.linalg.inv(info)
    return np.sqrt(np.diag(bread @ by_id.T @ by_id @ bread))


def ipw(id, start, stop, exposed, top, bottom):
    """Stabilised weights; rows are sorted by id and time."""
    first = np.ones(len(id), dtype=bool)
    for i in range(1, len(id)):
        if id[i] == id[i - 1]:
            first[i] = first[i - 1] and not exposed[i - 1]
    ones = np.ones(len(id))
    parts = []
    for x in (top, bottom):
        xs = x[first]
        args = (xs, start[first], stop[first], exposed[first])
        beta = fit(*args) if x.shape[1] else np.zeros(0)
        jump = jumps(beta, *args, ones[first])
        h = np.array([jump.get(int(t), 0.0) for t in stop]) * np.exp(x @ beta)
        p = np.where(first, np.where(exposed == 1, 1 - np.exp(-h), np.exp(-h)), 1.0)
        parts.append(p)
    out = parts[0] / parts[1]
    for i in range(1, len(id)):
        if id[i] == id[i - 1]:
            out[i] *= out[i - 1]
    return out
