"""A gated recurrent language model in numpy: class-factored output softmax, truncated backpropagation through time.

Words of the model are ranks: 0 is any word outside the shortlist, 1 the end of a text (also what comes before its first word), then words by
frequency. Rank 0 is a class of its own; the others are cut into classes of neighbouring ranks, small ones of frequent words and large ones of rare
words, so that a word costs about CLASSES plus 180 exponentials on average. The probability of a word is that of its class times that within the
class. A window touches few of the words: its gradient has rows of input vectors and of words, which Adagrad moves by one rate for each row; the
dense parameters are moved by Adam.
"""

from __future__ import annotations

from heapq import heapreplace
from math import prod

import numpy as np

HIDDEN = 16
CLASSES = 128
SHORTLIST = 1 << 16
OTHER, END = 0, 1
SHAPES = {
    "inputs": (SHORTLIST, 3 * HIDDEN),
    "state": (HIDDEN, 3 * HIDDEN),
    "to_class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "to_word": (SHORTLIST, HIDDEN),
    "word_bias": (SHORTLIST,),
}
DENSE = ("state", "to_class", "class_bias")
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
WINDOW = 16
LANES = 1024
RATE, ROW_RATE = 0.004, 0.1
CLIP = 5.0
#: Rows of class logits made at once, and words that are scored at once.
BLOCK, ROWS = 2048, 1 << 16
#: A largest logit up to here (either way) needs no shift; rows with a smaller sum of exponentials than this are done again by themselves.
SAFE, LEAST = 40.0, 1e-20
#: Rows of a parameter that are moved at once, and places of a word in a window that are added one by one.
CHUNK, FEW = 4096, 16


def class_bounds(counts: np.ndarray | None = None) -> np.ndarray:
    """Class c has the ranks bounds[c]:bounds[c+1]: OTHER, then classes of equal sums of the square roots of counts."""
    weight = np.ones(SHORTLIST - 1) if counts is None else np.sqrt(counts[1:] + 1.0)
    upto = np.cumsum(weight)
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, CLASSES - 1) / (CLASSES - 1)) + 1
    cuts = np.maximum.accumulate(np.maximum(cuts, np.arange(1, CLASSES - 1)))
    cuts = np.minimum(cuts, SHORTLIST - 1 - np.arange(CLASSES - 2, 0, -1))
    return np.concatenate([[0, 1], 1 + cuts, [SHORTLIST]]).astype(np.int64)


EQUAL = class_bounds()


def views(flat: np.ndarray, bounds: np.ndarray = EQUAL) -> dict[str, np.ndarray]:
    """The parameters, as views of one vector, and the bounds and the class of each rank."""
    out, at = {"bounds": bounds, "kinds": np.repeat(np.arange(CLASSES, dtype=np.int16), np.diff(bounds))}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh(seed: int = 7, counts: np.ndarray | None = None, bounds: np.ndarray = EQUAL) -> np.ndarray:
    """Parameters before training; with counts by rank, the biases are those of a model of words alone."""
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    p = views(flat, bounds)
    for name in ("class_bias", "word_bias"):
        p[name][:] = 0
    if counts is not None:
        p["word_bias"][:] = np.log(counts + 1.0)
        p["class_bias"][:] = np.log(np.add.reduceat(counts, bounds[:-1]) + 1.0)
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def run(p: dict[str, np.ndarray], words: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(states of all steps, last state, what backpropagation needs, if it is kept). words: (steps, lanes); a text's first input, END, resets the state."""
    steps, lanes = words.shape
    first = words == END
    some = first.any(axis=1)
    out = np.empty((steps, lanes, HIDDEN), dtype=np.float32)
    kept = []
    to_z, to_r, to_n = (np.ascontiguousarray(x) for x in np.split(p["state"], 3, axis=1))
    for t in range(steps):
        if some[t]:
            h = np.where(first[t][:, None], np.float32(0), h)
        gates = p["inputs"].take(words[t], axis=0)
        z, r, u = h @ to_z, h @ to_r, h @ to_n
        z += gates[:, :HIDDEN]
        r += gates[:, HIDDEN : 2 * HIDDEN]
        n = _sigmoid(r) * u
        n += gates[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if keep:
            kept.append((h, _sigmoid(z), r, n, u))
            h = h - n
        else:
            h = np.subtract(h, n, out=u)
            _sigmoid(z)
        h *= z
        h += n
        out[t] = h
    return out, h, kept


#: Memory that is taken again, by use and type: fresh pages cost more than the products that go into them.
_ROOM: dict[tuple[str, np.dtype], np.ndarray] = {}


def _room(use: str, kind: np.dtype, *shape: int) -> np.ndarray:
    size = prod(shape)
    have = _ROOM.get((use, kind))
    if have is None or have.size < size:
        have = _ROOM[use, kind] = np.empty(size, dtype=kind)
    return have[:size].reshape(shape)


#: Ones and positions, more of which are made where they are needed.
_ONES, _AT = np.ones(BLOCK, dtype=np.float32), np.arange(BLOCK)


def _exponentials(states: np.ndarray, weights: np.ndarray, bias: np.ndarray | None, goal: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unnormalised probabilities, the logits of goal, where these are in the first as a vector, sums) of the logits states @ weights + bias; the first until the next call."""
    n, width = states.shape[0], weights.shape[1]
    x = _room("logits", np.result_type(states, weights), n, width)
    at, flat = (_AT[:n] if n <= BLOCK else np.arange(n)) * width + goal, x.reshape(-1)
    for own in (False, True):
        np.matmul(states, weights, out=x)
        if bias is not None:
            x += bias
        top = x.max(axis=1, keepdims=True) if own else x.max(initial=-np.inf)
        if own or abs(top) > SAFE:
            x -= top
        goals = flat.take(at)
        np.exp(x, out=x)
        total = x @ (_ONES[:width] if width <= BLOCK else np.ones(width, dtype=np.float32))
        if total.min(initial=1) > LEAST:
            break  # else a row lies so far below the others that it needs its own largest logit
    return x, goals, at, total


def _logs(states: np.ndarray, weights: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of goal; states have a one for the bias, which is the last of the weights."""
    _, goals, _, total = _exponentials(states, weights, None, goal)
    return goals - np.log(total)


def _by_class(p: dict[str, np.ndarray], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(order of positions by class, classes and members in that order, (first rank, end, first position, end) of each class); classes of one member aren't listed."""
    bounds, kind = p["bounds"], p["kinds"][ranks]
    order = np.argsort(kind, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=CLASSES))])
    kind = kind[order]
    member = ranks[order] - bounds[kind]
    spans = [(a, b, i, j) for a, b, i, j in zip(bounds.tolist(), bounds[1:].tolist(), ends.tolist(), ends[1:].tolist(), strict=False) if j > i and b > a + 1]
    return order, kind, member, spans


def with_bias(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of words with their bias beside them, so that scoring adds it within the product."""
    return np.concatenate([p["to_class"], p["class_bias"][None]]), np.concatenate([p["to_word"], p["word_bias"][:, None]], axis=1)


def word_logs(p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of targets (a rank for each state)."""
    order, kind, member, spans = _by_class(p, targets)
    to_class, to_word = p["with_bias"] if "with_bias" in p else with_bias(p)
    sorted_states, states = states, np.ones((order.size, HIDDEN + 1), dtype=states.dtype)
    sorted_states.take(order, axis=0, out=states[:, :HIDDEN])
    logs = np.concatenate([_logs(states[k : k + BLOCK], to_class, kind[k : k + BLOCK]) for k in range(0, max(1, kind.size), BLOCK)])
    for a, b, i, j in spans:
        for k in range(i, j, BLOCK):
            s = slice(k, min(j, k + BLOCK))
            logs[s] += _logs(states[s], to_word[a:b].T, member[s])
    out = np.empty_like(logs)
    out[order] = logs
    return out


#: All rows of a parameter.
EVERY = slice(None)
Rows = dict[str, list[tuple[slice | np.ndarray, np.ndarray]]]


def gradient(p: dict[str, np.ndarray], words: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient of the mean loss of a window, the state behind it, the loss), with the zeros of what the window doesn't touch."""
    flat = np.zeros(SIZE, dtype=np.float32)
    g, last, loss = gradient_rows(p, words, targets, mask, h)
    for name, parts in g.items():
        for rows, values in parts:
            views(flat)[name][rows] = values
    return flat, last, loss


def _sums_by(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ranks, sums of the rows of x that have them)."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # SHORTLIST is 1 << 16: a radix sort
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, at.size))
    falling = np.argsort(-np.minimum(count, FEW + 1).astype(np.int16), kind="stable")
    first, count = first[falling], count[falling]
    many = int(np.count_nonzero(count > FEW))
    sums = x.take(order[first], axis=0)
    for k in range(many):
        sums[k] = np.ones(count[k], dtype=x.dtype) @ x.take(order[first[k] : first[k] + count[k]], axis=0)
    for k in range(1, FEW):
        some = slice(many, int(np.count_nonzero(count > k)))
        sums[some] += x.take(order[first[some] + k], axis=0)
    return at[first], sums


def gradient_rows(p: dict[str, np.ndarray], words: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[Rows, np.ndarray, float]:
    """(rows that a window touches and their gradient, by parameter, the state behind it, the loss); the gradient's arrays are taken again by the next call.
    Backpropagation ends at the window's start."""
    g: Rows = {"to_word": [], "word_bias": []}
    out, last, kept = run(p, words, h)
    steps, lanes = words.shape
    states, goal, weight = out.reshape(-1, HIDDEN), targets.ravel(), mask.ravel().astype(np.float32)
    weight = weight / max(1.0, float(weight.sum()))
    order, kind, member, spans = _by_class(p, goal)
    states, weight = states.take(order, axis=0), weight[order]
    goals, totals, factors = (np.zeros(order.size, dtype=np.result_type(p["to_word"], states)) for _ in range(3))

    def output(s: slice, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of logits but for a factor by row, the factors): the products with it have few columns, which take the factors instead."""
        x, goals[s], place, total = _exponentials(states[s], weights, bias, at[s])
        x.reshape(-1)[place] -= total
        totals[s] = total
        return x, np.divide(weight[s], total, out=factors[s])

    ds, inner = np.empty(states.shape, dtype=goals.dtype), np.zeros(states.shape, dtype=goals.dtype)
    to_class, class_bias = np.zeros(SHAPES["to_class"], dtype=np.float32), np.zeros(CLASSES, dtype=np.float32)
    back = np.ascontiguousarray(p["to_class"].T)
    for k in range(0, kind.size, BLOCK):
        s = slice(k, min(k + BLOCK, kind.size))
        d, factor = output(s, p["to_class"], p["class_bias"], kind)
        to_class += (states[s] * factor[:, None]).T @ d
        class_bias += factor @ d
        np.matmul(d, back, out=ds[s])
    g["to_class"], g["class_bias"] = [(EVERY, to_class)], [(EVERY, class_bias)]
    ds *= factors[:, None]
    loss = float((np.log(totals) - goals) @ weight)
    goals[:], totals[:], factors[:] = 0, 1, 0
    to_word, word_bias = (_room(name, goals.dtype, *SHAPES[name]) for name in ("to_word", "word_bias"))
    touched: list[list[int]] = []
    for a, b, i, j in spans:
        s = slice(i, j)
        d, factor = output(s, p["to_word"][a:b].T, p["word_bias"][a:b], member)
        np.matmul(d.T, states[s] * factor[:, None], out=to_word[a:b])
        np.matmul(factor, d, out=word_bias[a:b])
        np.matmul(d, p["to_word"][a:b], out=inner[s])
        if touched and touched[-1][1] == a:
            touched[-1][1] = b
        else:
            touched.append([a, b])
    for rows in (slice(k, min(k + CHUNK, b)) for a, b in touched for k in range(a, b, CHUNK)):
        g["to_word"].append((rows, to_word[rows]))
        g["word_bias"].append((rows, word_bias[rows]))
    loss += float((np.log(totals) - goals) @ weight)
    inner *= factors[:, None]
    inner += ds
    ds = np.empty(states.shape, dtype=np.float32)
    ds[order] = inner
    ds = ds.reshape(steps, lanes, HIDDEN)
    first = words == END
    some, back, back_n = first.any(axis=1), *(np.ascontiguousarray(x.T) for x in np.split(p["state"], [2 * HIDDEN], axis=1))
    gates, late = _room("gates", states.dtype, steps, lanes, 3 * HIDDEN), _room("late", states.dtype, steps, lanes, HIDDEN)
    dh = np.zeros((lanes, HIDDEN), dtype=np.float32)
    for t in reversed(range(steps)):
        before, z, r, n, un = kept[t]
        dh += ds[t]
        free = 1 - z
        dn = dh * free
        dn *= 1 - n * n
        dz = before - n
        for x in (dh, z, free):
            dz *= x
        dr = dn * un
        dr *= r
        dr *= 1 - r
        own = gates[t]
        own[:, :HIDDEN], own[:, HIDDEN : 2 * HIDDEN], own[:, 2 * HIDDEN :] = dz, dr, dn
        np.multiply(dn, r, out=late[t], casting="same_kind")
        dh = dh * z
        dh += own[:, : 2 * HIDDEN] @ back
        dh += late[t] @ back_n
        if some[t]:
            dh = np.where(first[t][:, None], np.float32(0), dh)
    flow, before = gates.reshape(-1, 3 * HIDDEN), np.concatenate([k[0] for k in kept]).T
    g["state"] = [(EVERY, np.concatenate([before @ flow[:, : 2 * HIDDEN], before @ late.reshape(-1, HIDDEN)], axis=1))]
    g["inputs"] = [_sums_by(words.ravel(), flow)]
    return g, last, loss


class Trainer:
    """Moves parameters by windows of lanes; a lane carries its state from window to window."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray = EQUAL):
        self.flat = flat.copy()
        self.values = views(self.flat, bounds)
        self.mean, self.square = ({name: np.zeros(SHAPES[name], dtype=np.float32) for name in DENSE} for _ in range(2))
        self.seen = {name: np.zeros(shape[0], dtype=np.float32) for name, shape in SHAPES.items() if name not in DENSE}
        self.steps, self.words = 0, 0

    def learn(self, stream: np.ndarray) -> None:
        """stream: ranks of texts one after another, an END behind each; lanes are equal parts of it."""
        lanes = max(1, min(LANES, stream.size // (32 * WINDOW)))  # a short stream still makes some steps
        length = -(-stream.size // lanes)
        goal = np.full(lanes * length, END, dtype=np.int64)
        goal[: stream.size] = stream
        real = (np.arange(lanes * length) < stream.size).reshape(lanes, length).T
        given = np.concatenate([[END], goal[:-1]]).reshape(lanes, length).T
        goal = goal.reshape(lanes, length).T
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in range(0, length, WINDOW):
            g, h, _ = gradient_rows(self.values, given[t : t + WINDOW], goal[t : t + WINDOW], real[t : t + WINDOW], h)
            self._step(g)
        self.words += stream.size

    def _step(self, g: Rows) -> None:
        self.steps += 1
        scale = np.float32(RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        for name, parts in g.items():
            for rows, x in parts:
                if name in DENSE:
                    norm = float(np.linalg.norm(x))
                    if norm > CLIP:
                        x *= CLIP / norm
                    mean, square = self.mean[name], self.square[name]
                    mean += 0.1 * (x - mean)
                    square += 0.001 * (x * x - square)
                    self.values[name] -= scale * mean / (np.sqrt(square) + np.float32(1e-8))
                    continue
                seen = self.seen[name]
                square = np.multiply(x, x, out=_room("square", x.dtype, *x.shape))
                seen[rows] += square if x.ndim == 1 else square @ np.full(x.shape[1], 1 / x.shape[1], dtype=x.dtype)
                rate = np.float32(ROW_RATE) / (np.sqrt(seen[rows]) + np.float32(1e-8))
                x *= rate if x.ndim == 1 else rate[:, None]
                self.values[name][rows] -= x


def text_logs(flat: np.ndarray, ranks: np.ndarray, first: np.ndarray, window: int | None = None, most_lanes: int = 512, bounds: np.ndarray = EQUAL) -> np.ndarray:
    """Natural log-probabilities of whole texts: ranks[first[i]:first[i+1]], each with its END.

    Texts are laid into lanes, the longest first, and the state goes through all windows of a lane (of about ROWS words in all lanes); a text's first input resets it.
    """
    p, n = views(flat, bounds), first.size - 1
    length = np.diff(first)
    total = np.zeros(n)
    if not ranks.size:
        return total
    lanes = int(max(1, min(most_lanes, ranks.size // max(int(length.max()), 64))))
    order = np.argsort(-length, kind="stable")
    load = [(0, k) for k in range(lanes)]
    lane_of, start = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in order.tolist():
        at, k = load[0]
        lane_of[i], start[i] = k, at
        heapreplace(load, (at + int(length[i]), k))
    steps = max(at for at, _ in load)
    window = window or max(64, ROWS // lanes)
    place = np.repeat((start - first[:-1]) * lanes + lane_of, length) + np.arange(ranks.size) * lanes
    given = np.concatenate([[END], ranks[:-1]])
    given[first[:-1][length > 0]] = END
    words, goals, owner = (np.full((steps, lanes), x, dtype=np.int32) for x in (END, END, -1))
    for into, x in ((words, given), (goals, ranks), (owner, np.repeat(np.arange(n), length))):
        into.ravel()[place] = x
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    p["with_bias"] = with_bias(p)
    for t in range(0, steps, window):
        out, h, _ = run(p, words[t : t + window], h, keep=False)
        real = owner[t : t + window].ravel() >= 0
        logs = word_logs(p, out.reshape(-1, HIDDEN)[real], goals[t : t + window].ravel()[real])
        total += np.bincount(owner[t : t + window].ravel()[real], weights=logs, minlength=n)
    return total
