"""A small causal self-attention model over token classes, in numpy.

One layer: embedding and position, masked attention of ``HEAD`` channels, a hidden
layer, and a class softmax in two steps (group, then member of the group), so a token
costs two short softmaxes instead of one over all classes. The last class may hold more
symbols, numbered from ``BEGIN + 1`` on: each has its own input, and two more steps (part
of the class, then member of the part) give its share of the class.

Texts are scored in windows that overlap: each has ``HALF`` targets and the ``HALF``
inputs before them as context, so each token is scored once and sees at least as many
inputs as there are, or HALF.
"""

from __future__ import annotations

import numpy as np

GROUPS = 64
CLASSES = GROUPS * GROUPS
BEGIN = CLASSES  # the input before the first token; symbols of the last class follow
LAST = CLASSES - 1
NONE = -1e4  # log share of a place that no symbol has
HEAD, HIDDEN, HALF = 16, 32, 16


def new_model(log_p: np.ndarray, seed: int = 1, log_share: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights that start as the unigram distribution ``log_p`` of the classes, and
    ``log_share`` of the symbols within the last class."""
    rng = np.random.default_rng(seed)

    def rand(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    rows = log_p.reshape(GROUPS, GROUPS)
    group = np.log(np.exp(rows).sum(1))
    log_share = np.zeros(1) if log_share is None or not len(log_share) else log_share
    side = int(np.ceil(np.sqrt(len(log_share))))
    shares = np.full(side * side, NONE)
    shares[np.arange(len(log_share)) % side * side + np.arange(len(log_share)) // side] = log_share  # dealt over the parts
    shares = shares.reshape(side, side)
    part = np.log(np.exp(shares).sum(1))
    return {
        "emb": rand(CLASSES + 1 + len(log_share), HEAD), "pos": rand(2 * HALF, HEAD),
        "q": rand(HEAD, HEAD), "k": rand(HEAD, HEAD), "v": rand(HEAD, HEAD), "o": rand(HEAD, HEAD),
        "w1": rand(HEAD, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": rand(HIDDEN, HEAD),
        "gw": rand(HEAD, GROUPS) * 0.1, "gb": group.astype(np.float32),
        "mw": rand(GROUPS, HEAD, GROUPS) * 0.1, "mb": (rows - group[:, None]).astype(np.float32),
        "pw": rand(HEAD, side) * 0.1, "pb": part.astype(np.float32),
        "sw": rand(side, HEAD, side) * 0.1, "sb": np.maximum(shares - part[:, None], NONE).astype(np.float32),
    }


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def windows(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end: (inputs, their validity, target places).

    A window has 2 * HALF inputs; targets of its second half stand at the returned
    places, or -1 past the end of the text.
    """
    n = -(-counts // HALF)
    start = np.repeat(np.cumsum(counts) - counts, n)
    size = np.repeat(counts, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (k * HALF - HALF)[:, None] + np.arange(2 * HALF)  # place of the target in the text
    valid = (at >= 0) & (at < size[:, None])
    place = np.where(valid, start[:, None] + at, 0)
    inputs = np.where(at == 0, BEGIN, classes[np.maximum(place - 1, 0)] if len(classes) else 0)
    return np.where(valid, inputs, BEGIN), valid, np.where(valid, place, -1)[:, HALF:]


_SEEN = (np.arange(2 * HALF)[None, :] <= np.arange(HALF, 2 * HALF)[:, None])[None]


def _exp(z: np.ndarray) -> np.ndarray:
    """In place; logits are far below the bound, which only keeps sums finite."""
    return np.exp(np.minimum(z, 60, out=z), out=z)


def _sums(z: np.ndarray) -> np.ndarray:
    """Of rows; a product with ones is faster than ``sum`` over short rows."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(*z.shape[:-1], 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = _exp(z)
    z /= _sums(z)
    return z


def _log_softmax_at(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    own = np.minimum(z[np.arange(len(column)), column], 60)
    return own - np.log(_sums(_exp(z))[:, 0])


def _flat(z: np.ndarray) -> np.ndarray:
    return z.reshape(-1, z.shape[-1])


def _forward(m, inputs, valid):
    n, w = inputs.shape
    x = m["emb"][inputs]
    x += m["pos"]
    late = np.ascontiguousarray(x[:, HALF:])
    # one product for all windows, not one for each
    q = (_flat(late) @ (m["q"] * np.float32(HEAD**-0.5))).reshape(n, w - HALF, HEAD)
    k, v = (_flat(x) @ m["k"]).reshape(n, w, HEAD), (_flat(x) @ m["v"]).reshape(n, w, HEAD)
    a = q @ k.transpose(0, 2, 1)
    _exp(a)
    a *= _SEEN
    gaps = np.flatnonzero(~valid.all(1))  # windows at the ends of texts
    a[gaps] *= valid[gaps, None, :]
    sums = _sums(a)
    a /= np.where(sums > 0, sums, 1)  # places past the end of a text may see nothing
    c = a @ v
    h = late + (_flat(c) @ m["o"]).reshape(late.shape)
    r = np.maximum(_flat(h) @ m["w1"] + m["b1"], 0)
    return x, late, q, k, v, a, c, h, r, h + (r @ m["w2"]).reshape(h.shape)


def _ordered(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their group, and the groups' edges in that order."""
    order = np.argsort(group.astype(np.min_scalar_type(n)), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(group, minlength=n)))


def _members(h: np.ndarray, edge: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Logits of the members of each row's group, and the rows of the groups that have any;
    rows stand in order of their groups."""
    z = np.empty((len(h), w.shape[2]), np.result_type(h, w))
    parts = [(int(g), slice(int(edge[g]), int(edge[g + 1]))) for g in np.flatnonzero(np.diff(edge))]
    for g, own in parts:
        np.matmul(h[own], w[g], out=z[own])
        z[own] += b[g]
    return z, parts


def _last(m, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the symbols of the last class, their part, their place in the part)."""
    at = np.flatnonzero(symbols > BEGIN)
    member, part = np.divmod(symbols[at] - BEGIN - 1, len(m["pb"]))
    return at, part, member


def log_probs(m, classes: np.ndarray, counts: np.ndarray, batch: int = 256) -> np.ndarray:
    """Natural log probability of each class given those before it in its text.

    Windows go through the model ``batch`` at a time, so that they stay in the cache.
    """
    out = np.zeros(len(classes))
    inputs, valid, place = windows(classes, counts)
    for low in range(0, len(inputs), batch):
        to = place[low : low + batch].ravel()
        h = _forward(m, inputs[low : low + batch], valid[low : low + batch])[-1].reshape(-1, HEAD)
        if to.min() < 0:
            h, to = h[to >= 0], to[to >= 0]
        y = classes[to]
        for first, kinds, (w, b), (mw, mb) in (
            (y > BEGIN, _last(m, y), (m["pw"], m["pb"]), (m["sw"], m["sb"])),
            (None, (None, *np.divmod(np.minimum(y, LAST), GROUPS)), (m["gw"], m["gb"]), (m["mw"], m["mb"])),
        ):
            own, group, member = kinds
            if first is not None and not len(own):
                continue
            order, edge = _ordered(group, len(b))
            rows = order if own is None else own[order]
            hs, group, member = h[rows], group[order], member[order]
            lp = _log_softmax_at(hs @ w + b, group)
            lp += _log_softmax_at(_members(hs, edge, mw, mb)[0], member)
            out[to[rows]] += lp
    return out


def gradients(m, inputs, valid, y) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradients; ``y``: target classes, -1 for none."""
    loss, d = _gradients(m, inputs, valid, y)
    for k in SPARSE:
        rows, g = d[k]
        d[k] = np.zeros_like(m[k])
        d[k][rows] = g
    return loss, d


SPARSE = ("emb", "mw", "mb", "sw", "sb")  # a batch meets few of their rows


def _head_gradients(d, m, h, y, n, names, group, member):
    """Adds the gradients of a softmax in two steps to ``d``; returns its loss, the gradient
    of ``h``, and (groups met, gradients of their weights, of their biases)."""
    w, b, mw, mb = (m[k] for k in names)
    order, edge = _ordered(group, len(b))
    hs, group, member, at = h[order], group[order], member[order], np.arange(len(order))
    p = _softmax(hs @ w + b)
    loss = -np.log(p[at, group] + 1e-30).sum()
    p[at, group] -= 1
    p /= n
    d[names[0]], d[names[1]] = hs.T @ p, np.ones(len(p), p.dtype) @ p
    dh = p @ w.T
    s, parts = _members(hs, edge, mw, mb)
    s = _softmax(s)
    loss -= np.log(s[at, member] + 1e-30).sum()
    s[at, member] -= 1
    s /= n
    dw = np.zeros((len(parts), *mw.shape[1:]), s.dtype)
    for i, (g, own) in enumerate(parts):
        np.matmul(hs[own].T, s[own], out=dw[i])
        dh[own] += s[own] @ mw[g].T
    db = np.add.reduceat(s, [own.start for _, own in parts], axis=0) if parts else np.zeros((0, mb.shape[1]), s.dtype)
    out = np.empty_like(dh)
    out[order] = dh
    return loss, out, (np.array([g for g, _ in parts], np.int64), dw, db)


def _gradients(m, inputs, valid, y) -> tuple[float, dict]:
    """As ``gradients``; those of ``SPARSE`` are (rows, values)."""
    x, late, q, k, v, a, c, h, r, top = _forward(m, inputs, valid)
    flat = top.reshape(-1, HEAD)
    own = np.flatnonzero(y.ravel() >= 0)
    n, hs, t = max(len(own), 1), flat[own], y.ravel()[own]
    last, part, member = _last(m, t)
    d = {}
    loss, dh, (met, dw, db) = _head_gradients(d, m, hs, t, n, ("gw", "gb", "mw", "mb"), *np.divmod(np.minimum(t, LAST), GROUPS))
    d["mw"], d["mb"] = (met, dw), (met, db)
    more, dl, (met, dw, db) = _head_gradients(d, m, hs[last], t[last], n, ("pw", "pb", "sw", "sb"), part, member)
    d["sw"], d["sb"] = (met, dw), (met, db)
    loss += more
    dh[last] += dl
    dtop = np.zeros_like(flat)
    dtop[own] = dh
    dr = (dtop @ m["w2"].T) * (r > 0)
    d["w2"], d["w1"], d["b1"] = r.T @ dtop, _flat(h).T @ dr, dr.sum(0)
    dh = dtop + dr @ m["w1"].T
    d["o"] = _flat(c).T @ dh
    dc = (dh @ m["o"].T).reshape(c.shape)
    dz = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    dz -= _sums(dz * a)
    dz *= a
    dq, dk = dz @ k, _flat(dz.transpose(0, 2, 1) @ q)
    dq, dv = _flat(dq) * np.float32(HEAD**-0.5), _flat(dv)
    d["q"], d["k"], d["v"] = _flat(late).T @ dq, _flat(x).T @ dk, _flat(x).T @ dv
    dx = (dk @ m["k"].T + dv @ m["v"].T).reshape(x.shape)
    dx[:, HALF:] += (dh + dq @ m["q"].T).reshape(late.shape)
    d["pos"] = dx.sum(0)
    order = np.argsort(inputs.ravel().astype(np.min_scalar_type(len(m["emb"]))), kind="stable")
    met = inputs.ravel()[order]
    first = np.flatnonzero(np.diff(met, prepend=-1))
    d["emb"] = met[first], np.add.reduceat(_flat(dx)[order], first, axis=0)
    return loss / n, d


def _adam(m, first, second, g, rate: float, step: int) -> None:
    """One step of Adam in place; ``g`` is used up."""
    first *= 0.9
    second *= 0.99
    second += 0.01 * g * g
    g *= 0.1
    first += g
    np.divide(second, 1 - 0.99**step, out=g)
    np.sqrt(g, out=g)
    g += 1e-6
    np.divide(first, g, out=g)
    g *= rate / (1 - 0.9**step)
    m -= g


def train(m, inputs, valid, targets, rate: float, seed: int, batch: int = 256) -> dict[str, np.ndarray]:
    """One pass in random order with Adam; rows that a batch does not meet stay."""
    m = {k: x.copy() for k, x in m.items()}
    first, second = ({k: np.zeros_like(x) for k, x in m.items()} for _ in range(2))
    order = np.random.default_rng(seed).permutation(len(inputs))
    for step, low in enumerate(range(0, len(order), batch), 1):
        own = order[low : low + batch]
        _, d = _gradients(m, inputs[own], valid[own], targets[own])
        for k, g in d.items():
            rows, g = g if k in SPARSE else (None, g)
            if k == "sw":  # long rows, each by itself in the cache
                for i, x in zip(rows, g):
                    _adam(m[k][i], first[k][i], second[k][i], x, rate, step)
            elif rows is None:
                _adam(m[k], first[k], second[k], g, rate, step)
            else:
                own = m[k][rows], first[k][rows], second[k][rows]
                _adam(*own, g, rate, step)
                m[k][rows], first[k][rows], second[k][rows] = own
    return m
