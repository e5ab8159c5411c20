"""A causal self-attention model in numpy: one head, one layer, over classes of subword ids.

The model predicts the class of the next id in two steps, a group of classes and a class of it, so that the classes can be many at
the cost of few; an id's share of its class comes from counts over the whole training corpus. Frequent ids have classes of
their own, the others share classes of about equal mass, those that begin a word apart from those that go on."""

from __future__ import annotations

import numpy as np

D, GROUPS, MEMBERS, WINDOW, CONTEXT = 16, 32, 32, 64, 32
CLASSES = GROUPS * MEMBERS
SHARED = 64  # classes that several ids share
BLOCK = 32  # rows of a group that are multiplied together; only a matter of speed
SHAPES = {
    "E": (CLASSES + 1, D), "P": (WINDOW, D), "Q": (D, D), "K": (D, D), "V": (D, D), "O": (D, D),
    "G": (D, GROUPS), "g": (GROUPS,), "U": (GROUPS, D, MEMBERS), "b": (GROUPS, MEMBERS),
}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
BOS = CLASSES
_TRIL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(D**-0.5)


def classes_of(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each id, log of each id's share in its class, log of each class's share) from counts plus one."""
    n = counts.astype(np.float64) + 1
    order = np.lexsort((np.arange(len(n)), -n))
    of = np.zeros(len(n), np.int64)
    own = CLASSES - SHARED
    of[order[:own]] = np.arange(own)
    for kind, base in ((True, own), (False, own + SHARED // 2)):
        rest = order[own:][begins[order[own:]] == kind]
        mass = np.cumsum(n[rest])
        of[rest] = base + np.minimum((mass - n[rest]) / max(mass[-1] if len(mass) else 1, 1) * (SHARED // 2), SHARED // 2 - 1).astype(np.int64)
    total = np.bincount(of, n, CLASSES)
    return of, np.log(n / total[of]), np.log(np.maximum(total, 1e-9) / total.sum())


def initial(class_logs: np.ndarray, seed: int = 5) -> np.ndarray:
    """All parameters in one flat array; the biases give each class its share."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1 if k in "EPGU" else D**-0.5, s).astype(np.float32) for k, s in SHAPES.items()}
    share = np.exp(np.maximum(class_logs, -20)).reshape(GROUPS, MEMBERS)
    p["g"] = np.log(share.sum(1)).astype(np.float32)
    p["b"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + SIZES[k]].reshape(s)
        at += SIZES[k]
    return out


def cut(classes: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, which targets count) of one text's windows: each target counts once, after `context` inputs at least but in the first window."""
    step, n = WINDOW - context, len(classes)
    starts = np.arange(0, max(1, n - context), step)
    at = starts[:, None] + np.arange(WINDOW)
    padded = np.concatenate([[BOS], classes, np.zeros(WINDOW, np.int64)])
    counts = (at < n) & ((np.arange(WINDOW) >= context) | (starts[:, None] == 0))
    at = np.minimum(at, n + WINDOW - 1)
    return padded[at], padded[at + 1], counts


def _table(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each class and each place adds to a row of (input, query, value, one); and what queries and values take from an input, side by
    side. With one head, keys can be the inputs themselves and values what goes to the output."""
    joint = np.concatenate([p["Q"] @ p["K"].T * _SCALE, p["V"] @ p["O"]], 1)
    return *(np.concatenate([m, m @ joint, np.full((len(m), 1), one, m.dtype)], 1) for m, one in ((p["E"], 0), (p["P"], 1))), joint


def _spans(since: int) -> list[tuple[int, int]]:
    """Queries of a window from `since` on, in two halves if all: those of the first see no key of the second."""
    return [(0, WINDOW // 2), (WINDOW // 2, WINDOW)] if since == 0 else [(since, WINDOW)]


def _weighed(table: tuple, x: np.ndarray, since: int = 0) -> tuple:
    """(rows of the table, exponentials of each span, y, 1 / the exponentials' sums, h and a one) of windows of classes; queries are of the
    places from `since` on only, h has a row for each."""
    rows = np.take(table[0], x, axis=0)
    rows += table[1]
    X, q, v = rows[..., :D], rows[..., D : 2 * D], rows[..., 2 * D :]
    y, each = np.empty((len(x), WINDOW - since, D + 1), rows.dtype), []
    for lo, hi in _spans(since):
        a = np.matmul(q[:, lo:hi], X[:, :hi].transpose(0, 2, 1))
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= _TRIL[lo:hi, :hi]
        np.matmul(a, v[:, :hi], out=y[:, lo - since : hi - since])
        each.append(a)
    r, h = 1 / y[..., D:], np.empty_like(y)
    y = y[..., :D] * r
    np.add(X[:, since:], y, out=h[..., :D])
    h[..., D] = 1
    return rows, each, y, r, h.reshape(-1, D + 1)


def _attended(p: dict[str, np.ndarray], x: np.ndarray, since: int = 0) -> tuple:
    """What _weighed() gives, with h alone last."""
    *rest, h = _weighed(_table(p), x, since)
    return *rest, h[:, :D]


def _heads(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the groups and of the classes of each group, biases as a last row."""
    return np.concatenate([p["G"], p["g"][None]]), np.concatenate([p["U"], p["b"][:, None]], 1)


def _blocks(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in blocks of BLOCK whose targets are of one group: (each block's group, rows of the blocks in order, where each row is
    among those). Blocks that are not full have row 0 besides."""
    group = (t // MEMBERS).astype(np.uint8)
    order, sizes = np.argsort(group, kind="stable"), np.bincount(group, minlength=GROUPS)
    n = -(-sizes // BLOCK)
    to = np.arange(len(t)) + np.repeat(BLOCK * (np.cumsum(n) - n) - (np.cumsum(sizes) - sizes), sizes)
    rows, at = np.zeros(int(n.sum()) * BLOCK, np.int64), np.empty(len(t), np.int64)
    rows[to], at[order] = order, to
    return np.repeat(np.arange(GROUPS), n), rows, at


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of rows of logits, their sums, what was taken from the logits first): nothing, or each row's largest if a sum would be too large or small."""
    ones = np.ones(z.shape[1], z.dtype)
    with np.errstate(over="ignore"):
        out = np.exp(z)
        total = out @ ones
    if not len(z) or 1e-20 < total.min() <= total.max() < 1e20:
        return out, total, 0
    most = z.max(1, keepdims=True)
    np.exp(z - most, out=out)
    return out, out @ ones, most[:, 0]


def class_logs(p: dict[str, np.ndarray], h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Natural log of each row's target class's probability."""
    return _class_logs(_heads(p), np.append(h, np.ones((len(h), 1), h.dtype), 1), t)


def _class_logs(heads: tuple[np.ndarray, np.ndarray], h: np.ndarray, t: np.ndarray) -> np.ndarray:
    of, rows, at = _blocks(t)
    z = h @ heads[0]
    own = np.matmul(np.take(h, rows, axis=0).reshape(-1, BLOCK, D + 1), np.take(heads[1], of, axis=0)).reshape(-1, MEMBERS)
    return _log_share(z, np.arange(len(t)), t // MEMBERS) + _log_share(own, at, t % MEMBERS)


def _log_share(z: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log of the softmax of rows of logits at given places."""
    _, total, less = _exp(z)
    return np.take(z, row * z.shape[1] + place) - np.take(np.log(total) + less, row)


def target_logs(p: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, since: int = 0, chunk: int = 128) -> np.ndarray:
    """The same for windows of classes, from place `since` on; a few windows at a time, so that they stay in the cache."""
    keep_memory()
    table, heads, out = _table(p), _heads(p), np.empty((len(x), WINDOW - since), np.float32)
    for j in range(0, len(x), chunk):
        end = min(len(x), j + chunk)
        out[j:end] = _class_logs(heads, _weighed(table, x[j:end], since)[-1], t[j:end, since:].ravel()).reshape(-1, WINDOW - since)
    return out


def _losses(z: np.ndarray, place: np.ndarray, w: np.ndarray, all_w: np.ndarray) -> np.ndarray:
    """Gradient of the weighted loss by rows of logits; place and w: of the targets, all_w: weights of all rows."""
    z, total, _ = _exp(z)
    z *= (all_w / total)[:, None]
    z.ravel()[place] -= w
    return z


def gradient(p: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of the mean loss over the targets that count, by all parameters."""
    b, n = x.shape
    t, table, heads = t.ravel(), _table(p), _heads(p)
    inputs, each, y, r, h = _weighed(table, x)
    w, g = (counts.ravel() / max(1, counts.sum())).astype(h.dtype), {}
    z = _losses(h @ heads[0], np.arange(len(t)) * GROUPS + t // MEMBERS, w, w)
    of_groups, dh = h.T @ z, z @ p["G"].T
    of, rows, at = _blocks(t)
    own, all_w = np.take(h, rows, axis=0).reshape(-1, BLOCK, D + 1), np.zeros(len(rows), h.dtype)
    all_w[at] = w
    z = _losses(np.matmul(own, np.take(heads[1], of, axis=0)).reshape(-1, MEMBERS), at * MEMBERS + t % MEMBERS, w, all_w).reshape(-1, BLOCK, MEMBERS)
    of_blocks = np.matmul(own.transpose(0, 2, 1), z).reshape(len(of), -1)
    of_classes = ((of == np.arange(GROUPS)[:, None]).astype(h.dtype) @ of_blocks).reshape(heads[1].shape)
    back = np.take(np.ascontiguousarray(p["U"].transpose(0, 2, 1)), of, axis=0)
    dh += np.take(np.matmul(z, back).reshape(-1, D), at, axis=0)
    g["G"], g["g"], g["U"], g["b"] = of_groups[:D], of_groups[D], of_classes[:, :D], of_classes[:, D]
    # a weight is an exponential times r, and the sum of weights times their gradients is dh times y
    dh, X, q, v = dh.reshape(b, n, D), inputs[..., :D], inputs[..., D : 2 * D], inputs[..., 2 * D :]
    down = np.empty((b, n, D + 1), h.dtype)
    np.multiply(dh, r, out=down[..., :D])
    down[..., D] = -np.einsum("bnd,bnd->bn", down[..., :D], y)
    dx, both = dh, np.empty((b, n, 2 * D), h.dtype)  # both: gradients by queries and values
    for (lo, hi), a in reversed([*zip(_spans(0), each, strict=True)]):
        dv = np.matmul(a.transpose(0, 2, 1), down[:, lo:hi, :D])
        a *= np.matmul(down[:, lo:hi], v[:, :hi].transpose(0, 2, 1))
        both[:, lo:hi, :D] = np.matmul(a, X[:, :hi])
        dx[:, :hi] += np.matmul(a.transpose(0, 2, 1), q[:, lo:hi])
        if hi == n:
            both[..., D:] = dv
        else:
            both[:, :hi, D:] += dv
    both, dx, joint = both.reshape(-1, 2 * D), dx.reshape(-1, D), table[2]
    dx += both @ joint.T
    of_joint = X.reshape(-1, D).T @ both
    of_qk, of_vo = of_joint[:, :D] * _SCALE, of_joint[:, D:]
    g["Q"], g["K"], g["V"], g["O"] = of_qk @ p["K"], of_qk.T @ p["Q"], of_vo @ p["O"].T, p["V"].T @ of_vo
    g["P"], g["E"] = dx.reshape(b, n * D).sum(0), np.zeros_like(p["E"])
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    classes = x.ravel()[order]
    first = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    g["E"][classes[first]] = np.add.reduceat(np.take(dx, order, axis=0), first)
    return np.concatenate([g[name].ravel() for name in SHAPES])


def keep_memory() -> None:
    """Memory of up to this size that is freed stays with the process: after the first large array is freed, the C library maps no smaller one by itself.
    Otherwise each batch's arrays would be mapped, and their pages cleared, anew."""
    np.empty(30 << 20, np.uint8)


class Learner:
    """Adam over batches of windows, from given parameters."""

    def __init__(self, flat: np.ndarray, rate: float = 0.01, batch: int = 32):
        keep_memory()
        self.flat, self.rate, self.size = flat.astype(np.float32).copy(), rate, batch
        self.m, self.s, self.n, self.seen = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.held.append(windows)
        self.waiting += len(windows[0])
        if self.waiting >= self.size:
            self.flush(self.waiting % self.size)

    def flush(self, left: int = 0) -> None:
        """Learns from what waits, but for the last `left` windows, which wait on."""
        if not self.held:
            return
        x, t, c = (np.concatenate(z) for z in zip(*self.held, strict=True))
        n = len(x) - left
        self.held, self.waiting = [(x[n:], t[n:], c[n:])] if left else [], left
        for i in range(0, n, self.size):
            b = slice(i, min(i + self.size, n))
            g = gradient(unpacked(self.flat), x[b], t[b], c[b])
            self.n += 1
            self.seen += int(c[b].sum())
            self.m *= 0.9
            self.m += 0.1 * g
            g *= g
            g *= 0.01
            self.s *= 0.99
            self.s += g
            np.divide(self.s, 1 - 0.99**self.n, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(self.m, g, out=g)
            g *= self.rate / (1 - 0.9**self.n)
            self.flat -= g
