"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and batched use.

Gates and states use piecewise linear activations, so a step is a table lookup (the input's share of all gates, by character class), one small
matrix product and a few vector operations over thousands of windows at once.
"""

from __future__ import annotations

import numpy as np

#: Character classes: letters by themselves (case is a second input), all digits alike, frequent marks by themselves, the rest by kind.
LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяёabcdefghijklmnopqrstuvwxyz"
MARKS = ".,:;!?-—–_/\\()[]{}<>@#№+*&%$€₽'\"«»|~=•"
PAD, SPACE, NEWLINE, DIGIT, OTHER = 0, 1, 2, 3, 4
N_CLASSES = 5 + len(MARKS) + len(LETTERS)
N_INPUTS = 2 * N_CLASSES


def _table() -> np.ndarray:
    t = np.full(0x3000, OTHER, np.int16)
    for cp in range(0x3000):
        c = chr(cp)
        if c in "\n\r":
            t[cp] = NEWLINE
        elif c.isspace():
            t[cp] = SPACE
        elif c.isdigit():
            t[cp] = DIGIT
        elif c in MARKS:
            t[cp] = 5 + MARKS.index(c)
        elif c.lower() in LETTERS and len(c.lower()) == 1:
            t[cp] = 5 + len(MARKS) + LETTERS.index(c.lower()) + (N_CLASSES if c != c.lower() else 0)
    t[0] = PAD
    return t


TABLE = _table()


def classes(text: str) -> np.ndarray:
    """The input class of every character."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(cp < 0x3000, TABLE[np.minimum(cp, 0x2FFF)], OTHER).astype(np.int16)


def _run(wx: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool = False):
    """One direction over (steps, windows) of input classes: states (steps, windows, h)."""
    steps, n = x.shape
    h = u.shape[0]
    out = np.zeros((steps, n, h), np.float32)
    c, state, mem = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
    g = np.empty((n, 4 * h), np.float32)
    for t in range(steps):
        np.take(wx, x[t], axis=0, out=g)
        g += state @ u
        pre = g.copy() if keep else None
        s = g[:, : 3 * h]
        s *= 0.25
        s += 0.5
        np.clip(s, 0, 1, out=s)
        cand = np.clip(g[:, 3 * h :], -1, 1)
        prev = c
        c = g[:, :h] * c + g[:, h : 2 * h] * cand
        hard = np.clip(c, -1, 1)
        state = g[:, 2 * h : 3 * h] * hard
        out[t] = state
        if keep:
            mem.append((pre, g.copy(), cand, prev, c, hard))
    return (out, mem) if keep else out


def folded(m: dict) -> dict:
    """The model with the gates' slope and offset folded into its weights, for use only."""
    out = dict(m)
    for d in "fb":
        w, u = m[f"w{d}"].copy(), m[f"u{d}"].copy()
        h = u.shape[0]
        w[:, : 3 * h] = w[:, : 3 * h] * 0.25 + 0.5
        u[:, : 3 * h] *= 0.25
        out[f"w{d}"], out[f"u{d}"] = np.ascontiguousarray(w, np.float32), np.ascontiguousarray(u, np.float32)
    return out


def _use(wx: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States as of ``_run``, from folded weights, without allocations within the steps; each gate lies in one piece."""
    steps, n = x.shape
    h = u.shape[0]
    wx = np.ascontiguousarray(wx.reshape(len(wx), 4, h).transpose(1, 0, 2))
    u = np.ascontiguousarray(u.reshape(h, 4, h).transpose(1, 0, 2))
    out = np.empty((steps, n, h), np.float32)
    state, c, hard, add = (np.zeros((n, h), np.float32) for _ in range(4))
    g, more = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32)
    zero, one = np.float32(0), np.float32(1)
    gates, (forget, enter, leave, cand) = g[:3], g
    for t in range(steps):
        for k in range(4):
            np.take(wx[k], x[t], axis=0, out=g[k], mode="clip")
            np.matmul(state, u[k], out=more[k])
        np.add(g, more, out=g)
        np.clip(gates, zero, one, out=gates)
        np.clip(cand, -one, one, out=cand)
        np.multiply(c, forget, out=c)
        np.multiply(enter, cand, out=add)
        np.add(c, add, out=c)
        np.clip(c, -one, one, out=hard)
        state = out[t]
        np.multiply(leave, hard, out=state)
    return out


def emissions(m: dict, x: np.ndarray) -> np.ndarray:
    """Scores (steps, windows, tags) by a folded model."""
    f = _use(m["wf"], m["uf"], x)
    b = _use(m["wb"], m["ub"], x[::-1])[::-1]
    return f @ m["of"] + b @ m["ob"] + m["bias"]


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (steps, n) of emissions (steps, n, tags); padding has emissions that favour tag 0."""
    steps, n, k = e.shape
    e = np.ascontiguousarray(e.transpose(0, 2, 1))
    back = np.zeros((steps, k, n), np.int8)
    s, best, other, more = e[0].copy(), np.empty((k, n), e.dtype), np.empty((k, n), e.dtype), np.empty((k, n), bool)
    for t in range(1, steps):
        np.add(s[0], trans[0][:, None], out=best)
        for j in range(1, k):  # few tags: passes over all windows beat reductions over a tiny axis
            np.add(s[j], trans[j][:, None], out=other)
            np.greater(other, best, out=more)
            np.copyto(back[t], j, where=more)
            np.maximum(best, other, out=best)
        np.add(best, e[t], out=s)
    out = np.empty((steps, n), np.int8)
    out[-1] = s.argmax(axis=0)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][out[t], rows]
    return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood and its gradients by emissions and transitions, by forward-backward."""
    steps, n, k = e.shape
    al, be = np.empty_like(e), np.zeros_like(e)
    al[0] = e[0]
    for t in range(1, steps):
        al[t] = e[t] + _lse(al[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        be[t] = _lse(trans[None] + (e[t + 1] + be[t + 1])[:, None, :], 2)
    z = _lse(al[-1], 1)
    ge = np.exp(al + be - z[None, :, None])
    gt = np.zeros_like(trans)
    for t in range(1, steps):
        gt += np.exp(al[t - 1][:, :, None] + trans[None] + (e[t] + be[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(n)
    gold = sum(e[t, rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
    for t in range(steps):
        ge[t, rows, y[t]] -= 1
    np.subtract.at(gt, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float((z - gold).mean()), ge / n, gt / n


def _back(u: np.ndarray, x: np.ndarray, out: np.ndarray, mem: list, go: np.ndarray, n_in: int):
    steps, n = x.shape
    h = u.shape[0]
    gw, gu = np.zeros((n_in, 4 * h), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        pre, g, cand, prev, c, hard = mem[t]
        d = go[t] + dh
        d_o = d * hard
        dcc = dc + d * g[:, 2 * h : 3 * h] * (np.abs(c) < 1)
        grad = np.concatenate([dcc * prev, dcc * cand, d_o, dcc * g[:, h : 2 * h]], axis=1)
        grad[:, : 3 * h] *= 0.25 * (np.abs(pre[:, : 3 * h]) < 2)
        grad[:, 3 * h :] *= np.abs(pre[:, 3 * h :]) < 1
        np.add.at(gw, x[t], grad)
        if t:
            gu += out[t - 1].T @ grad
        dh = grad @ u.T
        dc = dcc * g[:, :h]
    return gw, gu


def gradient(m: dict, x: np.ndarray, y: np.ndarray):
    """Loss and gradients of a batch (steps, windows)."""
    f, mf = _run(m["wf"], m["uf"], x, True)
    b, mb = _run(m["wb"], m["ub"], x[::-1], True)
    e = f @ m["of"] + b[::-1] @ m["ob"] + m["bias"]
    loss, ge, gt = crf_gradient(e.astype(np.float64), m["trans"].astype(np.float64), y)
    ge = ge.astype(np.float32)
    k = ge.shape[2]
    flat = ge.reshape(-1, k)
    g = {"of": f.reshape(-1, f.shape[2]).T @ flat, "ob": b[::-1].reshape(-1, b.shape[2]).T @ flat, "bias": flat.sum(axis=0), "trans": gt.astype(np.float32)}
    g["wf"], g["uf"] = _back(m["uf"], x, f, mf, ge @ m["of"].T, len(m["wf"]))
    g["wb"], g["ub"] = _back(m["ub"], x[::-1], b, mb, (ge @ m["ob"].T)[::-1], len(m["wb"]))
    return loss, g


def new_model(hidden: int, tags: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    m = {}
    for d in "fb":
        m[f"w{d}"] = (rng.standard_normal((N_INPUTS, 4 * hidden)) * 0.3).astype(np.float32)
        m[f"w{d}"][:, :hidden] += 1.0  # remember at first
        m[f"u{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden) * 0.7).astype(np.float32)
        m[f"o{d}"] = (rng.standard_normal((hidden, tags)) * 0.3).astype(np.float32)
    m["bias"] = np.zeros(tags, np.float32)
    m["trans"] = np.zeros((tags, tags), np.float32)
    return m


def train(m: dict, batches, rate: float = 0.01, report=None) -> dict:
    """Adam over an iterable of (x, y); the rate falls linearly over the number of batches given by ``len``."""
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    total = len(batches)
    for i, (x, y) in enumerate(batches, 1):
        loss, g = gradient(m, x, y)
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        scale = min(1.0, 20.0 / max(norm, 1e-9))
        lr = rate * (1 - (i - 1) / total)
        for k, v in g.items():
            a, b = mom[k]
            v = v * scale
            a += 0.1 * (v - a)
            b += 0.001 * (v * v - b)
            m[k] -= lr * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.999**i)) + 1e-8)
        if report:
            report(i, loss)
    return m
