"""A causal self-attention language model in numpy.

One block: token and place embeddings, masked attention, a two-layer perceptron, both with a path around
them. The next id is spelled as a walk down a binary tree of all ids (a Huffman tree of their training
counts), a logistic choice at each node, so probabilities sum to one at a cost of some ten dot products.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

from .packed import ranges

#: Places of a window, and how many of them the next window does not share.
CONTEXT, STRIDE = 32, 24
DIM, HIDDEN = 16, 32
#: Windows whose states are worked out, or that are learned from, together.
BATCH, LEARN = 96, 48
#: Ids that are scored together.
SCORED = 1 << 18
#: The heaviest nodes of the tree, which most paths share, are worked out for all ids by matrix products.
TOP = 63
RATE = 0.15
#: Squared gradients that every parameter begins with.
PAST = 1e-2


class Tree:
    """Paths of all ids in a Huffman tree; node k of the id's path is turned at by its sign."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        weight = counts.astype(np.float64) + 1
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        parent = np.zeros(2 * n - 1, np.int64)
        side = np.zeros(2 * n - 1, np.int8)
        total = np.concatenate([weight, np.zeros(n - 1)])
        for k in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = k
            side[i], side[j] = 1, -1
            total[k] = a + b
            heapq.heappush(heap, (a + b, k))
        #: Log odds of the first child: with no other knowledge the model is the training unigram.
        self.odds = np.zeros(n - 1, np.float32)
        first = np.flatnonzero(side == 1)
        p = total[first] / total[parent[first]]
        self.odds[parent[first] - n] = np.log(p / (1 - p))
        nodes, signs, own, lengths = [], [], [], np.zeros(n, np.int64)
        at, leaf = np.arange(n), np.arange(n)
        while True:
            up = at < 2 * n - 2
            at, leaf = at[up], leaf[up]
            if not len(at):
                break
            nodes.append(parent[at] - n)
            signs.append(side[at])
            own.append(leaf)
            lengths[leaf] += 1
            at = parent[at]
        order = np.argsort(np.concatenate(own), kind="stable") if own else np.zeros(0, np.int64)
        self.node = np.concatenate(nodes)[order].astype(np.int64) if own else np.zeros(0, np.int64)
        self.sign = np.concatenate(signs)[order].astype(np.float32) if own else np.zeros(0, np.float32)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])

    @cached_property
    def top(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The first of the heaviest nodes (Huffman's come last); for each id which of them are on its path, with
        numbers from 0 and ``TOP`` or so many as there are where the path is shorter, and the signs of its turns there
        (then 0); how many others are on its path (nodes rise along a path, so they come before)."""
        n, first = len(self.begin) - 1, max(0, len(self.odds) - TOP)
        high = self.node >= first
        own = np.repeat(np.arange(n), np.diff(self.begin))
        low = np.bincount(own[~high], minlength=n)
        place = (np.arange(len(own)) - (self.begin[:-1] + low)[own])[high]
        at = np.full((n, int(place.max(initial=-1)) + 1), len(self.odds) - first, np.int64)
        turn = np.zeros(at.shape, np.float32)
        at[own[high], place] = self.node[high] - first
        turn[own[high], place] = self.sign[high]
        return first, at, turn, low.astype(np.uint8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "top"}


def shapes(n_ids: int) -> dict[str, tuple[int, ...]]:
    d, h = DIM, HIDDEN
    return {"E": (n_ids, d), "P": (CONTEXT, d), "Wq": (d, d), "Wk": (d, d), "Wv": (d, d), "Wo": (d, d), "W1": (d, h), "b1": (h,), "W2": (h, d), "N": (n_ids - 1, d), "b": (n_ids - 1,)}


def start(tree: Tree, n_ids: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(s) / np.sqrt(s[0] if k[0] == "W" else 4)).astype(np.float32) for k, s in shapes(n_ids).items()}
    out["P"] *= 0.5
    out["b1"][:] = 0
    out["N"][:] = 0
    out["b"][:] = tree.odds
    return out


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in model.values()])


def unflat(values: np.ndarray, n_ids: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(n_ids).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).copy()
        at += n
    return out


#: What the product of a place with each before it may be at most; with those after it: nothing.
_MOST = np.where(np.tri(CONTEXT, dtype=bool), np.float32(60), np.float32(-1e9))


def _attend(Q: np.ndarray, K: np.ndarray, V1: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of places (not divided by their sums), the means of values by them, and one over the sums. ``V1``: values
    and a column of ones, which makes the sums."""
    S = Q @ K.transpose(0, 2, 1)
    np.minimum(S, most, out=S)
    np.exp(S, out=S)
    C = (S @ V1).reshape(-1, V1.shape[2])
    over = np.reciprocal(C[:, -1:])
    return S, C[:, :-1] * over, over


def _perceive(m: dict[str, np.ndarray], H: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    R = H @ m["W1"]
    R += m["b1"]
    np.maximum(R, R.dtype.type(0), out=R)
    out = R @ m["W2"]
    out += H
    return out, R


def hidden(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States after each place of the windows ``x``, from that place and those before it."""
    X = m["E"].take(x.reshape(-1), axis=0)
    X.reshape(*x.shape, DIM)[:] += m["P"][: x.shape[1]]
    W = np.concatenate([m["Wq"] * X.dtype.type(DIM**-0.5), m["Wk"], m["Wv"]], axis=1)
    T = np.ones((len(X), 3 * DIM + 1), X.dtype)
    np.matmul(X, W, out=T[:, :-1])
    T = T.reshape(*x.shape, -1)
    S, C, over = _attend(T[..., :DIM], T[..., DIM : 2 * DIM], T[..., 2 * DIM :], _MOST[: x.shape[1], : x.shape[1]])
    H = C @ m["Wo"]
    H += X
    out, R = _perceive(m, H)
    return out, (X, W, T, S, C, over, H, R)


def log_probability(m: dict[str, np.ndarray], tree: Tree, g: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each id ``y`` after the state ``g``. Rows of one id share a path, so
    they are brought together, ids with paths of one length side by side."""
    out = np.zeros(len(y))
    if not len(y) or not len(tree.node):
        return out
    present = np.zeros(len(tree.begin) - 1, bool)
    present[y] = True
    ids = np.flatnonzero(present)
    ids = ids[np.argsort(tree.begin[ids + 1] - tree.begin[ids], kind="stable")]
    rank = np.zeros(len(present), np.uint16 if len(ids) <= 1 << 16 else np.int64)
    rank[ids] = np.arange(len(ids))
    own = rank.take(y)
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(ids)))
    state = np.ones((len(y), DIM + 1), g.dtype)
    state[:, :DIM] = g.take(order, axis=0)
    _, at = ranges(tree.begin[ids], tree.begin[ids + 1])
    path = np.concatenate([m["N"].take(tree.node[at], axis=0), m["b"].take(tree.node[at])[:, None]], axis=1)
    path *= tree.sign[at][:, None]
    length = tree.begin[ids + 1] - tree.begin[ids]
    edges = np.append(_starts(length), len(ids)).tolist()
    row, first = 0, 0
    for a, b in zip(edges, edges[1:]):
        n, last = int(length[a]), int(ends[b - 1])
        z = np.empty((n, last - first), g.dtype)
        i = first
        for j in ends[a:b].tolist():
            np.matmul(path[row : row + n], state[i:j].T, out=z[:, i - first : j - first])
            i, row = j, row + n
        # log(1 + exp(-z)) is log(1 + exp(-|z|)) - min(z, 0); factors of 1 to 2 can be multiplied before the logarithm
        log = np.minimum(z, z.dtype.type(0)).sum(axis=0)
        np.abs(z, out=z)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        out[order[first:last]] = log - np.log(np.multiply.reduce(z, axis=0))
        first = last
    return out


def _slopes(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The derivative of log(1 + exp(-sign * z)) by the log odds z: (tanh(z / 2) - sign) / 2. Overwrites z."""
    z *= 0.5
    np.tanh(z, out=z)
    z -= sign
    z *= 0.5
    return z


def _choices(m: dict[str, np.ndarray], past: dict[str, np.ndarray], tree: Tree, out: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Learns the nodes on the paths of ids ``y`` after the states ``out`` at ``place``; the gradients of all states."""
    first, at, turn, low = tree.top
    size = low.take(y)
    order = np.argsort(~size, kind="stable")  # longest first: those with a node of some rank are a prefix
    place, y, size = place.take(order), y.take(order), size.take(order)
    g = np.zeros((len(y), DIM + 2), out.dtype)  # a one for the odds; an even width for _sums
    g[:, :DIM] = out.take(place, axis=0)
    g[:, DIM] = 1
    n_top = len(m["b"]) - first
    heavy = np.zeros((n_top + 1, DIM + 2), out.dtype)  # the last: no node
    heavy[:-1, :DIM] = m["N"][first:]
    heavy[:-1, DIM] = m["b"][first:]
    top = g @ heavy.T
    where = at.take(y, axis=0)
    where += (np.arange(len(y)) * (n_top + 1))[:, None]
    slope = _slopes(top.take(where), turn.take(y, axis=0))
    top.fill(0)
    top.reshape(-1)[where] = slope
    dg = top @ heavy[:, :DIM]
    d = (top.T @ g)[:-1]
    reach = len(y) - np.cumsum(np.bincount(size))[:-1]
    edges = np.concatenate([[0], np.cumsum(reach)]).tolist()
    if edges[-1]:
        begin, index = tree.begin.take(y), np.empty(edges[-1], np.int64)
        spans = [(k, n, slice(a, b)) for k, (n, a, b) in enumerate(zip(reach.tolist(), edges, edges[1:]))]
        for k, n, some in spans:
            np.add(begin[:n], k, out=index[some])
        node = tree.node.take(index)
        rows = m["N"].take(node, axis=0)
        z = m["b"].take(node)
        for _, n, some in spans:
            z[some] += np.einsum("ij,ij->i", g[:n, :DIM], rows[some])
        slope = _slopes(z, tree.sign.take(index))[:, None]
        rows *= slope
        pulled = np.empty((len(node), DIM + 2), out.dtype)
        for _, n, some in spans:
            dg[:n] += rows[some]
            np.multiply(g[:n], slope[some], out=pulled[some])
        order, row, begin = _groups(node, len(m["b"]))
        pulled = _sums(pulled.take(order, axis=0), begin)
        _rows(m, past, "N", row, pulled[:, :DIM])
        _rows(m, past, "b", row, pulled[:, DIM])
    _adagrad(m["N"][first:], past["N"][first:], d[:, :DIM])
    _adagrad(m["b"][first:], past["b"][first:], d[:, DIM])
    dG = np.zeros_like(out)
    dG[place] = dg
    return dG


def step(m: dict[str, np.ndarray], past: dict[str, np.ndarray], tree: Tree, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> None:
    """One step of Adagrad on windows ``x`` with next ids ``y`` where ``scored``."""
    out, (X, W, T, S, C, over, H, R) = hidden(m, x)
    place = np.flatnonzero(scored)
    dG = _choices(m, past, tree, out, place, y.reshape(-1).take(place))
    grad = {"W2": R.T @ dG}
    dU = dG @ m["W2"].T
    dU *= R > 0
    grad["W1"], grad["b1"] = H.T @ dU, np.ones(len(dU), dU.dtype) @ dU
    dX = dU @ m["W1"].T
    dX += dG
    grad["Wo"] = C.T @ dX
    dC = np.empty((len(dX), DIM + 1), dX.dtype)  # and what the sum of weights takes back
    np.matmul(dX, m["Wo"].T, out=dC[:, :-1])
    dC[:, :-1] *= over
    np.negative(np.einsum("ij,ij->i", dC[:, :-1], C), out=dC[:, -1])
    dC = dC.reshape(*x.shape, -1)
    dS = dC @ T[..., 2 * DIM :].transpose(0, 2, 1)
    dS *= S
    dT = np.empty((*x.shape, 3 * DIM), dX.dtype)
    np.matmul(dS, T[..., DIM : 2 * DIM], out=dT[..., :DIM])
    np.matmul(dS.transpose(0, 2, 1), T[..., :DIM], out=dT[..., DIM : 2 * DIM])
    np.matmul(S.transpose(0, 2, 1), dC[..., :-1], out=dT[..., 2 * DIM :])
    dT = dT.reshape(len(dX), -1)
    dW = X.T @ dT
    grad["Wq"], grad["Wk"], grad["Wv"] = dW[:, :DIM] * dW.dtype.type(DIM**-0.5), dW[:, DIM : 2 * DIM], dW[:, 2 * DIM :]
    dX += dT @ W.T
    grad["P"] = dX.reshape(len(x), -1).sum(axis=0).reshape(-1, DIM)
    order, row, begin = _groups(x.reshape(-1), len(m["E"]))
    _rows(m, past, "E", row, _sums(dX.take(order, axis=0), begin))
    for k, d in grad.items():
        _adagrad(m[k], past[k], d)


def _sums(d: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; pairs of columns are added as complex numbers, which takes half the time."""
    if d.ndim == 1:
        return np.add.reduceat(d, begin)
    return np.add.reduceat(d.view(np.result_type(d.dtype, np.complex64)), begin).view(d.dtype)


def _adagrad(values: np.ndarray, past: np.ndarray, d: np.ndarray) -> None:
    past += d * d
    values -= np.float32(RATE) * d / np.sqrt(past)


def _starts(row: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(row), bool)
    np.not_equal(row[1:], row[:-1], out=new[1:])
    return np.flatnonzero(new)


def _groups(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, the rows, and where each begins."""
    order = np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")  # by digits, if in 16 bits
    row = row.take(order)
    begin = _starts(row)
    return order, row[begin], begin


def _rows(m: dict[str, np.ndarray], past: dict[str, np.ndarray], name: str, row: np.ndarray, d: np.ndarray) -> None:
    """Adagrad on the rows of a table that a step has touched."""
    p = past[name].take(row, axis=0)
    p += d * d
    past[name][row] = p
    m[name][row] -= np.float32(RATE) * d / np.sqrt(p)


def window_places(at: np.ndarray, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each window over texts that begin ``at``."""
    length, stride = np.diff(at), stride or STRIDE
    return ranges(np.zeros(len(length), np.int64), np.where(length <= CONTEXT, 1, 1 + -(-(length - CONTEXT) // stride)))


def sides(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Before each id of the texts the id that it follows, and the ids; after all of them: ``end``."""
    x, y = np.full(len(ids) + 1, end, np.int64), np.full(len(ids) + 1, end, np.int64)
    y[:-1] = ids
    x[1:] = ids
    x[at] = end
    return x, y


def fill_windows(both: tuple[np.ndarray, np.ndarray], at: np.ndarray, text: np.ndarray, k: np.ndarray, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, next ids, and which of those are scored, for windows ``k`` of ``text``; ``both``: of ``sides``."""
    stride = stride or STRIDE
    place = np.arange(CONTEXT)
    index = (at.take(text) + k * stride)[:, None] + place
    there = index < at.take(text + 1)[:, None]
    index[~there] = len(both[0]) - 1
    scored = there & ((k[:, None] == 0) | (place >= CONTEXT - stride)) if stride < CONTEXT else there
    return both[0].take(index), both[1].take(index), scored


def cut_windows(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of ``ids`` that begin ``at``; each text ends with ``end`` and is read as if
    after one. Returns inputs, next ids, which of those the window scores (each id of a text once in all its
    windows), and the text of each window."""
    text, k = window_places(at)
    return *fill_windows(sides(ids, at, end), at, text, k), text


def _table(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each id and of each place what it adds to the query, the key, the value as ``Wo`` has it and a one, and the
    state: all of them are linear in the embeddings."""
    W = np.concatenate([m["Wq"] * m["Wq"].dtype.type(DIM**-0.5), m["Wk"], m["Wv"] @ m["Wo"], np.zeros((DIM, 1), m["E"].dtype), np.eye(DIM, dtype=m["E"].dtype)], axis=1)
    of_place = m["P"] @ W
    of_place[:, 3 * DIM] = 1
    return m["E"] @ W, of_place


def _states(m: dict[str, np.ndarray], table: tuple[np.ndarray, np.ndarray], x: np.ndarray, first: int) -> np.ndarray:
    """As ``hidden``, for the places from ``first`` of each window."""
    T = table[0].take(x, axis=0)
    T += table[1]
    _, C, _ = _attend(T[:, first:, :DIM], T[..., DIM : 2 * DIM], T[..., 2 * DIM : 3 * DIM + 1], _MOST[first:])
    C += T[:, first:, 3 * DIM + 1 :].reshape(-1, DIM)
    return _perceive(m, C)[0]


def score(m: dict[str, np.ndarray], tree: Tree, ids: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Natural logarithm of the probability of each text."""
    out = np.zeros(len(at) - 1)
    table = _table(m)
    step_texts = 0
    while step_texts < len(at) - 1:  # texts of some hundred thousand ids at a time
        last = max(step_texts + 1, int(np.searchsorted(at, at[step_texts] + SCORED, "right")) - 1)
        own = at[step_texts : last + 1]
        own, both = own - own[0], sides(ids[own[0] : own[-1]], own - own[0], end)
        text, k = window_places(own)
        for first, some in ((0, np.flatnonzero(k == 0)), (CONTEXT - STRIDE, np.flatnonzero(k))):
            for i in range(0, len(some), SCORED // CONTEXT):
                out[step_texts:last] += _score_windows(m, table, tree, both, own, text[some[i : i + SCORED // CONTEXT]], k[some[i : i + SCORED // CONTEXT]], first)
        step_texts = last
    return out


def _score_windows(m: dict, table: tuple, tree: Tree, both: tuple, at: np.ndarray, text: np.ndarray, k: np.ndarray, first: int) -> np.ndarray:
    """What windows ``k`` of ``text``, which score the places from ``first``, add to the scores of all texts."""
    states, follow, counts = [], [], []
    for i in range(0, len(text), BATCH):
        x, y, scored = fill_windows(both, at, text[i : i + BATCH], k[i : i + BATCH])
        keep = np.flatnonzero(scored[:, first:])
        states.append(_states(m, table, x, first).take(keep, axis=0))
        follow.append(y[:, first:].reshape(-1).take(keep))
        counts.append(scored.sum(axis=1))
    p = log_probability(m, tree, np.concatenate(states), np.concatenate(follow)) if states else np.zeros(0)
    return np.bincount(np.repeat(text, np.concatenate(counts)), p, len(at) - 1)


def training_blocks(ids: np.ndarray, at: np.ndarray, end: int, learned: np.ndarray):
    """Windows to learn from, side by side, so that each id of the texts ``learned`` is learned once."""
    text, k = window_places(at, CONTEXT)
    own, both = np.flatnonzero(learned[text]), sides(ids, at, end)
    for i in range(0, len(own), LEARN):
        some = own[i : i + LEARN]
        yield fill_windows(both, at, text[some], k[some], CONTEXT)


def train(m: dict[str, np.ndarray], past: dict[str, np.ndarray], tree: Tree, blocks) -> int:
    """Adagrad over blocks of (x, y, scored), in place; ``past``: sums of squared gradients. The number of ids
    learned from."""
    n = 0
    for x, y, scored in blocks:
        step(m, past, tree, x, y, scored)
        n += int(scored.sum())
    return n
