"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each word of a window enters as two halves: a vector of the word and the mean of the
vectors of its character trigrams.  Two gated layers read the window in both directions;
attention weighs their joined states into one context, whose score is the window's logit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WORD_BUCKETS = 1 << 16
CHAR_BUCKETS = 1 << 13
HALF = 8     # values of a word vector, and of a trigram vector
HIDDEN = 16  # states of one direction
SHUT = 30.0  # an update gate this far open keeps its state, which is how padding is skipped
CHUNK = 2048

Weights = dict[str, np.ndarray]


@dataclass
class Windows:
    """Windows of equal width as positions in a list of words; -1 is padding."""

    at: np.ndarray                                   # windows x width
    words: np.ndarray                                # bucket of each word
    chars: np.ndarray                                # trigram buckets of all words, one after the other
    sizes: np.ndarray                                # number of trigrams of each word
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _add_rows(target: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to ``target`` at its index; indices may repeat."""
    if not len(index):
        return
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(ordered) != 0)))
    target[ordered[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def new_weights(seed: int, prior: np.ndarray) -> Weights:
    """Small random weights; the first value of a word vector starts as its ``prior``."""
    rng = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    weights = {"word": some(WORD_BUCKETS, HALF, scale=0.1), "char": some(CHAR_BUCKETS, HALF, scale=0.3),
               "pool": some(2 * HIDDEN, scale=0.3), "out": some(2 * HIDDEN, scale=0.3),
               "bias": np.zeros(1, np.float32)}
    weights["word"][:, 0] = prior
    for side in "fb":
        weights["in_" + side] = some(2 * HALF, 3 * HIDDEN, scale=0.25)
        weights["in_bias_" + side] = np.zeros(3 * HIDDEN, np.float32)
        weights["state_" + side] = some(HIDDEN, 3 * HIDDEN, scale=0.25)
        weights["state_bias_" + side] = np.zeros(3 * HIDDEN, np.float32)
    return weights


def inputs(weights: Weights, words: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The input of each word: its own vector beside the mean of its trigrams'."""
    out = np.zeros((len(words), 2 * HALF), np.float32)
    out[:, :HALF] = weights["word"][words]
    if len(words):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out[:, HALF:] = np.add.reduceat(weights["char"][chars], starts, axis=0) / sizes[:, None]
    return out


def _read(gates_in: np.ndarray, state: np.ndarray, bias: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States after each step; ``gates_in`` is steps x windows x (update, reset, new)."""
    steps, size = gates_in.shape[:2]
    h = np.zeros((size, HIDDEN), np.float32)
    out = np.empty((steps, size, HIDDEN), np.float32)
    for t in range(steps):
        own = h @ state
        own += bias
        gates = _sigmoid(gates_in[t, :, :2 * HIDDEN] + own[:, :2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(gates_in[t, :, 2 * HIDDEN:] + reset * own[:, 2 * HIDDEN:])
        if tape is not None:
            tape.append((h, update, reset, new, own[:, 2 * HIDDEN:]))
        h = new + update * (h - new)
        out[t] = h
    return out


def _pool(weights: Weights, states: np.ndarray, padding: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention over the steps, the context, and the logit of each window."""
    level = np.where(padding, np.float32(-1e9), states @ weights["pool"])
    level -= level.max(axis=0)
    share = np.exp(level)
    share /= share.sum(axis=0)
    context = np.einsum("tb,tbh->bh", share, states, optimize=True)
    return share, context, context @ weights["out"] + weights["bias"]


def projected(weights: Weights, entered: np.ndarray) -> dict[str, np.ndarray]:
    """What every word sends to the gates of both directions, and padding as the last row."""
    out = {}
    for side in "fb":
        gates = np.zeros((len(entered) + 1, 3 * HIDDEN), np.float32)
        gates[:-1] = entered @ weights["in_" + side] + weights["in_bias_" + side]
        gates[-1, :HIDDEN] = SHUT
        out[side] = gates
    return out


def logits(weights: Weights, table: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The logit of every window; ``at`` points into ``table``, -1 at its last row."""
    out = np.empty(len(at), np.float32)
    for low in range(0, len(at), CHUNK):
        steps = np.ascontiguousarray(at[low:low + CHUNK].T)
        ahead = _read(table["f"][steps], weights["state_f"], weights["state_bias_f"])
        back = _read(table["b"][steps[::-1]], weights["state_b"], weights["state_bias_b"])[::-1]
        out[low:low + CHUNK] = _pool(weights, np.concatenate((ahead, back), axis=2), steps < 0)[2]
    return out


def gradients(weights: Weights, windows: Windows, rows: np.ndarray, weight: np.ndarray,
              keep: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, Weights]:
    """Weighted log loss of some windows and its gradient; ``keep`` masks word and trigram halves."""
    at = windows.at[rows]
    used, place = np.unique(at, return_inverse=True)
    place = place.reshape(at.shape).T
    padded = len(used) > 0 and used[0] < 0
    real = used[1:] if padded else used
    place = place - 1 if padded else place
    starts = np.concatenate(([0], np.cumsum(windows.sizes)))
    sizes = windows.sizes[real]
    chars = windows.chars[np.repeat(starts[real] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
                          + np.arange(sizes.sum())]
    entered = inputs(weights, windows.words[real], chars, sizes)
    if keep is not None:
        entered[:, :HALF] *= keep[0][:len(real), None]
        entered[:, HALF:] *= keep[1][:len(real), None]
    table = projected(weights, entered)
    tapes: dict[str, list] = {"f": [], "b": []}
    ahead = _read(table["f"][place], weights["state_f"], weights["state_bias_f"], tapes["f"])
    back = _read(table["b"][place[::-1]], weights["state_b"], weights["state_bias_b"], tapes["b"])[::-1]
    states = np.concatenate((ahead, back), axis=2)
    share, context, logit = _pool(weights, states, place < 0)
    labels = windows.labels[rows]
    loss = float(np.sum(weight * (np.logaddexp(0, logit) - labels * logit)))

    d_logit = (weight * (_sigmoid(logit) - labels)).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in weights.items()}
    grad["out"] = context.T @ d_logit
    grad["bias"][0] = d_logit.sum()
    d_context = d_logit[:, None] * weights["out"]
    d_share = np.einsum("bh,tbh->tb", d_context, states, optimize=True)
    d_level = share * (d_share - (share * d_share).sum(axis=0))
    grad["pool"] = np.einsum("tb,tbh->h", d_level, states, optimize=True)
    d_states = share[:, :, None] * d_context + d_level[:, :, None] * weights["pool"]
    d_entered = np.zeros_like(entered)
    for side, d_out, steps in (("f", d_states[..., :HIDDEN], place), ("b", d_states[::-1, :, HIDDEN:], place[::-1])):
        d_table = np.zeros_like(table[side])
        state = weights["state_" + side]
        d_h = np.zeros_like(d_out[0])
        d_in = np.empty((len(steps), len(rows), 3 * HIDDEN), np.float32)
        for t in reversed(range(len(steps))):
            h, update, reset, new, own = tapes[side][t]
            d_h = d_h + d_out[t]
            d_new = d_h * (1 - update) * (1 - new * new)
            d_update = d_h * (h - new) * update * (1 - update)
            d_reset = d_new * own * reset * (1 - reset)
            d_in[t] = np.concatenate((d_update, d_reset, d_new), axis=1)
            d_own = np.concatenate((d_update, d_reset, d_new * reset), axis=1)
            grad["state_" + side] += h.T @ d_own
            grad["state_bias_" + side] += d_own.sum(axis=0)
            d_h = d_h * update + d_own @ state.T
        _add_rows(d_table, steps.ravel(), d_in.reshape(-1, 3 * HIDDEN))
        d_table = d_table[:-1]  # padding learns nothing
        grad["in_" + side] = entered.T @ d_table
        grad["in_bias_" + side] = d_table.sum(axis=0)
        d_entered += d_table @ weights["in_" + side].T
    if keep is not None:
        d_entered[:, :HALF] *= keep[0][:len(real), None]
        d_entered[:, HALF:] *= keep[1][:len(real), None]
    _add_rows(grad["word"], windows.words[real], d_entered[:, :HALF])
    _add_rows(grad["char"], chars, np.repeat(d_entered[:, HALF:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
    return loss, grad


def train(weights: Weights, windows: Windows, *, seed: int, epochs: int, batch: int = 128, rate: float = 0.004,
          hide: float = 0.15) -> Weights:
    """Adam over shuffled batches; both classes weigh the same, and some word or trigram halves are hidden."""
    rng = np.random.default_rng(seed)
    weights = {k: v.copy() for k, v in weights.items()}
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    positive = max(windows.labels.mean(), 1e-6) if len(windows.labels) else 0.5
    each = np.where(windows.labels > 0, 0.5 / positive, 0.5 / max(1 - positive, 1e-6))
    step, total = 0, epochs * -(-len(windows.at) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows.at))
        for low in range(0, len(order), batch):
            rows = order[low:low + batch]
            most = rows.size * windows.at.shape[1]
            hidden = rng.random(most)
            keep = ((hidden > hide).astype(np.float32), (hidden < 1 - hide).astype(np.float32))
            _, grad = gradients(weights, windows, rows, (each[rows] / len(rows)).astype(np.float32), keep)
            step += 1
            size = rate * (1 - step / (total + 1)) + rate / 20
            for k, g in grad.items():
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.01) * (g * g - square[k])
                weights[k] -= (size * (mean[k] / (1 - 0.9 ** step))
                               / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return weights
