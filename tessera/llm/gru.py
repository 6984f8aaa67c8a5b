"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Token ids fall into classes of equal size: class ``id // width``, member ``id % width``. The probability of a
token is that of its class times that of the member within the class. Documents lie one after another in lanes;
the state is carried from window to window and starts anew at each document, so a document's log-likelihood is
complete whatever its length.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

UNKNOWN, END = 0, 1
#: Logits are held within this bound, far beyond those of a trained network, so no row needs its largest first.
MOST = 60.0
Params = dict[str, np.ndarray]


def initial(classes: int, width: int, hidden: int, embed: int, counts: np.ndarray, seed: int = 5) -> Params:
    """Small random weights; output biases start at the logarithms of the counts."""
    rng = np.random.default_rng(seed)
    size = classes * width
    by = (counts.astype(np.float64) + 0.5).reshape(classes, width)
    share = by.sum(1)
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "E": draw(size, embed), "Wx": draw(embed, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "U": draw(hidden, 3 * hidden),
        "Wc": draw(hidden, classes), "bc": np.log(share / share.sum()).astype(np.float32),
        "Wm": draw(classes, hidden, width), "bm": np.log(by / share[:, None]).astype(np.float32),
    }


def dump(params: Params) -> bytes:
    out = io.BytesIO()
    np.savez(out, **params)
    return out.getvalue()


def load(data: bytes) -> Params:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def mean(parts: list[tuple[Params, float]]) -> Params:
    total = sum(w for _, w in parts)
    return {k: sum(p[k] * np.float32(w / total) for p, w in parts) for k in parts[0][0]}


class Lanes:
    """Documents laid end to end in at most ``most`` lanes of similar length, the longest lane first."""

    def __init__(self, docs: list[np.ndarray], most: int) -> None:
        heap = [(0, k) for k in range(max(1, min(most, len(docs))))]
        members: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, k = heapq.heappop(heap)
            members[k].append(d)
            heapq.heappush(heap, (n + len(docs[d]), k))
        length = [sum(len(docs[d]) for d in m) for m in members]
        order = sorted(range(len(members)), key=lambda k: -length[k])
        flat = [d for k in order for d in members[k]]
        sizes = np.array([len(docs[d]) for d in flat], np.int64)
        self.length = np.array([length[k] for k in order], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.target = np.concatenate([docs[d] for d in flat]) if flat else np.zeros(0, np.uint16)
        self.owner = np.repeat(np.array(flat, np.int32), sizes)
        first = np.zeros(len(self.target), bool)
        first[np.cumsum(sizes) - sizes] = True
        self.first = first
        self.input = np.roll(self.target, 1)
        self.input[first] = END

    def windows(self, steps: int):
        """(places, valid) of each window: indexes into the flat arrays, steps x active lanes."""
        for t in range(0, int(self.length[0]) if len(self.length) else 0, steps):
            active = int((self.length > t).sum())
            at = t + np.arange(min(steps, int(self.length[0]) - t))[:, None]
            valid = at < self.length[:active]
            yield self.start[:active] + np.minimum(at, self.length[:active] - 1), valid


class _Room:
    """Arrays that windows use again: to get and return some megabytes for each window costs more than to fill them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _forward(p: Params, ids: np.ndarray, keep: np.ndarray, h: np.ndarray, room: _Room, cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states of a window (steps x lanes x hidden) and the last state (lanes x hidden).

    Within a window features come first and lanes last, so each gate is one contiguous block.
    """
    (steps, lanes), hidden = ids.shape, h.shape[1]
    # A sigmoid is a tangent of half its argument; the halves go into the weights.
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), hidden)
    u = np.ascontiguousarray((p["U"] * half).T)
    inputs = room("inputs", steps, lanes, p["E"].shape[1])
    np.take(p["E"], ids, axis=0, out=inputs, mode="clip")
    gates = np.matmul(np.ascontiguousarray((p["Wx"] * half).T), inputs.transpose(0, 2, 1), out=room("gates", steps, 3 * hidden, lanes))
    gates += (p["b"] * half)[:, None]
    out, zr, n = room("out", steps, hidden, lanes), room("zr", steps, 2 * hidden, lanes), room("n", steps, hidden, lanes)
    befores, inner = (room("befores", *out.shape), room("inner", *out.shape)) if cache is not None else (None, None)
    h, a, whole = np.ascontiguousarray(h.T), room("a", 3 * hidden, lanes), keep.all(1)
    for t in range(steps):
        if not whole[t]:
            h = h * keep[t]
        np.matmul(u, h, out=a)
        s, c = zr[t], n[t]
        np.add(gates[t, : 2 * hidden], a[: 2 * hidden], out=s)
        np.tanh(s, out=s)
        s *= 0.5
        s += 0.5
        np.multiply(s[hidden:], a[2 * hidden :], out=c)
        c += gates[t, 2 * hidden :]
        np.tanh(c, out=c)
        if cache is not None:
            befores[t], inner[t] = h, a[2 * hidden :]
        h = np.subtract(h, c, out=out[t])
        h *= s[:hidden]
        h += c
    if cache is not None:
        cache.update(inputs=inputs, befores=befores, z=zr[:, :hidden], r=zr[:, hidden:], n=n, inner=inner)
    states = room("states", steps, lanes, hidden)
    states[:] = out.transpose(0, 2, 1)
    return states, h.T.copy()


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, whose values lie within one, can bring a logit beyond ``MOST``."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max()) < MOST


def _flat(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The valid places of a window, step by step; without a copy where all are."""
    return x.reshape(-1, *x.shape[2:]) if valid.all() else x[valid]


def _powers(x: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The powers of logits, held within ``MOST`` in place, and their sum in each row (a product, faster than a sum of short rows)."""
    e = np.exp(x if bounded else np.clip(x, -MOST, MOST, out=x))
    return e, e @ np.ones(x.shape[1], x.dtype)


def _outputs(p: Params, states: np.ndarray, target: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of the targets; with ``grads``, gradients are added and those of states returned.

    Tokens are sorted by class once, so every class works on a slice.
    """
    classes, width = p["bm"].shape
    order = np.argsort((target // width).astype(np.int16), kind="stable")
    s, target = states[order], target[order]
    cls, member = target // width, target % width
    rows = np.arange(len(target))
    x = s @ p["Wc"]
    x += p["bc"]
    d, norm = _powers(x, _bounded(p["Wc"], p["bc"]))
    found = x[rows, cls] - np.log(norm)
    back = None
    if grads is not None:
        d /= norm[:, None]
        d[rows, cls] -= 1
        grads["Wc"] += s.T @ d
        grads["bc"] += d.sum(0)
        back = d @ p["Wc"].T
    edges = np.searchsorted(cls, np.arange(classes + 1))
    own = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]
    x = np.empty((len(target), width), s.dtype)
    for c, at in own:
        part = np.matmul(s[at], p["Wm"][c], out=x[at])
        part += p["bm"][c]
    d, norm = _powers(x, _bounded(p["Wm"], p["bm"]))
    found += x[rows, member] - np.log(norm)
    if grads is not None:
        d /= norm[:, None]
        d[rows, member] -= 1
        for c, at in own:
            part = d[at]
            grads["Wm"][c] += s[at].T @ part
            grads["bm"][c] += part.sum(0)
            back[at] += part @ p["Wm"][c].T
    logp = np.empty(len(target))
    logp[order] = found
    if back is not None:
        unsorted = np.empty_like(back)
        unsorted[order] = back
        back = unsorted
    return logp, back


def log_likelihoods(p: Params, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
    """The natural log-likelihood of each document (arrays of token ids)."""
    laid = Lanes(docs, lanes)
    total = np.zeros(len(docs))
    h, room = np.zeros((len(laid.length), p["U"].shape[0]), np.float32), _Room()
    for at, valid in laid.windows(steps):
        states, h = _forward(p, laid.input[at], ~laid.first[at], h[: at.shape[1]], room)
        flat = _flat(at, valid)
        logp, _ = _outputs(p, _flat(states, valid), laid.target[flat])
        total += np.bincount(laid.owner[flat], logp, len(docs))
    return total


def window_gradients(p: Params, ids: np.ndarray, keep: np.ndarray, target: np.ndarray, valid: np.ndarray, h: np.ndarray, room: _Room | None = None) -> tuple[Params, float, np.ndarray]:
    """Gradients of the mean loss of one window, the loss, and the state to carry on."""
    hidden, grads = h.shape[1], {k: np.zeros_like(v) for k, v in p.items()}
    cache, room = {}, room or _Room()
    states, last = _forward(p, ids, keep, h, room, cache)
    logp, back = _outputs(p, _flat(states, valid), _flat(target, valid), grads)
    count = max(1, int(valid.sum()))
    if valid.all():
        states.reshape(back.shape)[:] = back
    else:
        states[:] = 0
        states[valid] = back
    befores, z, r, n, inner = (cache[k] for k in ("befores", "z", "r", "n", "inner"))
    d_states, by_n, by_z = room("d_states", *n.shape), room("by_n", *n.shape), room("by_z", *n.shape)
    d_gates, d_inner = room("d_gates", len(ids), 3 * hidden, ids.shape[1]), room("d_inner", len(ids), 3 * hidden, ids.shape[1])
    d_states[:] = states.transpose(0, 2, 1)
    # What each gate's gradient is multiplied by does not depend on later steps.
    np.subtract(befores, n, out=by_z)
    by_z *= z
    np.multiply(n, n, out=by_n)
    np.subtract(1, by_n, out=by_n)
    closed = np.subtract(1, z, out=n)
    by_z *= closed
    by_n *= closed
    by_r = np.subtract(1, r, out=closed)
    by_r *= r
    by_r *= inner
    u, dh, whole = np.ascontiguousarray(p["U"]), np.zeros((hidden, ids.shape[1]), np.float32), keep.all(1)
    for t in range(len(ids) - 1, -1, -1):
        g, da = d_gates[t], d_inner[t]
        dh += d_states[t]
        np.multiply(dh, by_z[t], out=g[:hidden])
        dn = np.multiply(dh, by_n[t], out=g[2 * hidden :])
        np.multiply(dn, by_r[t], out=g[hidden : 2 * hidden])
        da[: 2 * hidden] = g[: 2 * hidden]
        np.multiply(dn, r[t], out=da[2 * hidden :])
        dh *= z[t]
        dh += u @ da
        if not whole[t]:
            dh *= keep[t]
    grads["U"] += np.matmul(befores, d_inner.transpose(0, 2, 1)).sum(0)
    grads["b"] += d_gates.sum((0, 2))
    grads["Wx"] += np.matmul(d_gates, cache["inputs"]).sum(0).T
    x = ids.reshape(-1)
    order = np.argsort(x, kind="stable")
    x, flat = x[order], np.matmul(d_gates.transpose(0, 2, 1), p["Wx"].T, out=cache["inputs"]).reshape(len(order), -1)[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    grads["E"][x[first]] += np.add.reduceat(flat, first, axis=0)
    return {k: g / np.float32(count) for k, g in grads.items()}, float(-logp.sum() / count), last


def train(p: Params, docs: list[np.ndarray], epochs: int = 1, lanes: int = 512, steps: int = 20, rate: float = 0.01) -> Params:
    """Truncated backpropagation with Adam over the documents laid in lanes.

    The longest document sets the number of windows, so few tokens beside a long one make narrow, costly windows.
    """
    p = {k: v.astype(np.float32).copy() for k, v in p.items()}
    m, v, k = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0
    laid = Lanes(docs, lanes)
    planned = max(1, epochs * -(-int(laid.length.max(initial=0)) // steps))
    room = _Room()
    for _ in range(epochs):
        h = np.zeros((len(laid.length), p["U"].shape[0]), np.float32)
        for at, valid in laid.windows(steps):
            grads, _, h = window_gradients(p, laid.input[at], ~laid.first[at], laid.target[at], valid, h[: at.shape[1]], room)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            k += 1
            now = rate * (1.0 - 0.9 * k / planned)
            for n, g in grads.items():
                g = g * np.float32(scale)
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.99 * v[n] + 0.01 * g * g
                p[n] -= (now * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return p
