"""A linear-chain conditional random field in numpy: training by gradient steps, Viterbi decoding in batches.

A token is described by its own string; what stands around it enters through the same descriptions at the
offsets -3 to 3, and through the coarse shape classes of the token and both its neighbours taken together. So the
score of a label at a position is a sum of rows from one table per offset and one table of class triples, and a
batch is scored by table look-ups over its distinct tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


@dataclass
class Model:
    labels: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray  # offset x feature x label
    triples: np.ndarray  # class of the token before, of the token, of the one after, as one number x label
    classes: int
    transition: np.ndarray
    start: np.ndarray


def _vocabulary(sequences: Sequence[Sequence[str]]) -> tuple[dict[str, int], list[np.ndarray]]:
    ids: dict[str, int] = {}
    return ids, [np.fromiter((ids.setdefault(t, len(ids)) for t in s), dtype=np.int64, count=len(s)) for s in sequences]


def _matrix(ids: dict[str, int], describe: Callable[[str], list[str]], features: dict[str, int], grow: bool) -> list[np.ndarray]:
    out = []
    for token in ids:
        known = [features.setdefault(f, len(features)) if grow else features.get(f, -1) for f in describe(token)]
        out.append(np.array([f for f in known if f >= 0], dtype=np.int64))
    return out


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids with -1 beyond each end, and the lengths."""
    longest = max(len(s) for s in sequences)
    ids = np.full((len(sequences), longest), -1, dtype=np.int64)
    for i, s in enumerate(sequences):
        ids[i, : len(s)] = s
    return ids, np.array([len(s) for s in sequences])


def _shifted(ids: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(ids, -1)
    if by == 0:
        return ids
    if abs(by) < ids.shape[1]:
        if by > 0:
            out[:, :-by] = ids[:, by:]
        else:
            out[:, -by:] = ids[:, :by]
    return out


def _triples(kinds: np.ndarray, classes: int, ids: np.ndarray) -> np.ndarray:
    """kinds: the class of each token, the last entry the class of places outside the text."""
    before, after = kinds[_shifted(ids, -1)], kinds[_shifted(ids, 1)]
    return (before * classes + kinds[ids]) * classes + after


def _emissions(tables: np.ndarray, triples: np.ndarray, ids: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """tables: offset x (token + 1) x label; the last row stands for places outside the text."""
    total = triples[triple].astype(np.float32)
    for k, offset in enumerate(OFFSETS):
        total += tables[k][_shifted(ids, offset)]
    return total


def _kinds(vocabulary: dict[str, int], classify: Callable[[str], int]) -> np.ndarray:
    return np.array([*map(classify, vocabulary), 0], dtype=np.int64)


def _tables(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """weights' last feature is the one for places outside the text."""
    out = np.zeros((len(OFFSETS), len(rows) + 1, weights.shape[2]), dtype=np.float32)
    sizes = np.array([len(r) for r in rows])
    if len(rows) and sizes.sum():
        flat = np.concatenate(rows)
        ends = np.cumsum(sizes)
        for k in range(len(OFFSETS)):
            sums = np.concatenate([np.zeros((1, weights.shape[2]), np.float64), np.cumsum(weights[k][flat], axis=0, dtype=np.float64)])
            out[k, :-1] = sums[ends] - sums[ends - sizes]
    out[:, -1] = weights[:, -1]
    return out


def train(sequences: Sequence[Sequence[str]], tags: Sequence[Sequence[str]], describe: Callable[[str], list[str]], classify: Callable[[str], int], classes: int, epochs: int = 6, batch: int = 96, rate: float = 0.15, decay: float = 0.15, seed: int = 7) -> Model:
    """classify gives a token's class, from 1 to classes - 1; 0 is the class of places outside the text.

    Maximises the conditional likelihood by AdaGrad steps with L2 decay; the model is the mean of the second half of the
    epochs, which varies less with the order of the batches. The same input gives the same model.
    """
    labels = tuple(sorted({t for s in tags for t in s}))
    number = {x: i for i, x in enumerate(labels)}
    vocabulary, coded = _vocabulary(sequences)
    features: dict[str, int] = {}
    rows = _matrix(vocabulary, describe, features, grow=True)
    kinds = _kinds(vocabulary, classify)
    n = len(labels)
    triples = np.zeros((classes**3, n))
    # endings say something about a token and its direct neighbours only
    useful = np.ones((len(OFFSETS), len(features) + 1, 1))
    endings = [i for f, i in features.items() if f.startswith("s") and f[1:2].isdigit()]
    for k, offset in enumerate(OFFSETS):
        if abs(offset) > 1:
            useful[k, endings] = 0
    weights = np.zeros((len(OFFSETS), len(features) + 1, n))
    transition, start = np.zeros((n, n)), np.zeros(n)
    squares = [np.ones(x.shape) for x in (weights, transition, start, triples)]
    gold = [np.array([number[t] for t in s]) for s in tags]
    order = np.argsort([len(s) for s in coded], kind="stable")
    groups = []
    for i in range(0, len(order), batch):
        # each batch knows its own tokens and their features, so that no step touches the whole vocabulary
        ids, lengths = _padded([coded[j] for j in order[i : i + batch]])
        own = np.unique(ids[ids >= 0])
        local = np.where(ids < 0, -1, np.searchsorted(own, ids))
        flat = np.concatenate([rows[j] for j in own])
        by_feature = np.argsort(flat, kind="stable")
        present, first = np.unique(flat[by_feature], return_index=True)
        source = np.repeat(np.arange(len(own)), [len(rows[j]) for j in own])[by_feature]
        y = np.zeros_like(ids)
        for j, k in enumerate(order[i : i + batch]):
            y[j, : lengths[j]] = gold[k]
        triple = _triples(kinds, classes, ids)
        used, inverse = np.unique(triple.ravel(), return_inverse=True)
        groups.append((local, lengths, [rows[j] for j in own], present, first, source, y, triple, used, inverse))
    random = np.random.default_rng(seed)
    parts = (weights, transition, start, triples)
    means, kept = [np.zeros_like(x) for x in parts], 0
    for epoch in range(epochs):
        for g in random.permutation(len(groups)):
            ids, lengths, own_rows, present, first, source, y, triple, used, inverse = groups[g]
            scores = _emissions(_tables(weights, own_rows), triples, ids, triple).astype(np.float64)
            b, t = ids.shape
            inside = np.arange(t)[None, :] < lengths[:, None]
            # scaled forward and backward passes; beyond a text's end its values stand still
            emitted, moved = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transition)
            alpha, beta, scale = np.zeros((b, t, n)), np.ones((b, t, n)), np.ones((b, t, 1))
            for k in range(t):
                step = (alpha[:, k - 1] @ moved if k else np.exp(start)[None]) * emitted[:, k]
                norm = step.sum(1, keepdims=True)
                alpha[:, k] = np.where(inside[:, k, None], step / norm, alpha[:, k - 1])
                scale[:, k] = np.where(inside[:, k, None], norm, 1)
            for k in range(t - 2, -1, -1):
                step = (emitted[:, k + 1] * beta[:, k + 1]) @ moved.T / scale[:, k + 1]
                beta[:, k] = np.where(inside[:, k + 1, None], step, beta[:, k])
            marginal = alpha * beta * inside[:, :, None]
            target = np.zeros_like(marginal)
            np.put_along_axis(target, y[:, :, None], inside[:, :, None].astype(float), 2)
            delta = target - marginal
            later = (emitted * beta / scale * inside[:, :, None])[:, 1:]
            g_transition = -moved * (alpha[:, :-1].reshape(-1, n).T @ later.reshape(-1, n))
            np.add.at(g_transition, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1.0)
            g_weights = np.zeros_like(weights)
            for k, offset in enumerate(OFFSETS):
                at = _shifted(ids, offset).ravel()
                d = delta.reshape(-1, n)
                per_token = np.stack([np.bincount(np.where(at < 0, len(own_rows), at), d[:, c], len(own_rows) + 1) for c in range(n)], 1)
                g_weights[k, present] = np.add.reduceat(per_token[source], first, axis=0)
                g_weights[k, -1] = per_token[-1]
            g_triples = np.stack([np.bincount(inverse, delta.reshape(-1, n)[:, c], len(used)) for c in range(n)], 1)
            squares[3][used] += g_triples * g_triples
            triples[used] += rate * (g_triples - decay * triples[used]) / np.sqrt(squares[3][used])
            steps = [(weights, g_weights * useful - decay * weights, squares[0]), (transition, g_transition - decay * transition, squares[1]), (start, delta[:, 0].sum(0), squares[2])]
            for x, gradient, past in steps:
                past += gradient * gradient
                x += rate * gradient / np.sqrt(past)
        if epoch >= epochs // 2:
            kept += 1
            for mean, x in zip(means, parts):
                mean += (x - mean) / kept
    weights, transition, start, triples = (x.astype(np.float32) for x in means)
    return Model(labels, features, weights, triples, classes, transition, start)


def viterbi(model: Model, sequences: Sequence[Sequence[str]], describe: Callable[[str], list[str]], classify: Callable[[str], int], budget: int = 200_000, plain: str = "O") -> list[np.ndarray | None]:
    """The best label numbers of each sequence; sequences of like length are decoded together, ``budget`` places at a time.

    None stands for a sequence whose best labels are all ``plain``. Most are recognised without a Viterbi pass: where
    at every place the best other label, with twice the most a transition can gain over plain to plain, scores
    less than plain, no path through another label can win.
    """
    out: list[np.ndarray | None] = [None] * len(sequences)
    o = model.labels.index(plain)
    others = [i for i in range(len(model.labels)) if i != o]
    gain = 2 * max(0.0, float(max(model.transition.max(), (model.transition + model.start[:, None]).max()) - model.transition[o, o])) + 1e-3
    turned = np.ascontiguousarray(model.transition.T)
    filled = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    if not filled:
        return out
    vocabulary, coded = _vocabulary([sequences[i] for i in filled])
    tables = _tables(model.weights, _matrix(vocabulary, describe, model.features, grow=False))
    kinds = _kinds(vocabulary, classify)
    at = 0
    while at < len(filled):
        end = at + 1
        while end < len(filled) and (end + 1 - at) * len(coded[end]) <= budget:
            end += 1
        ids, lengths = _padded(coded[at:end])
        scores = _emissions(tables, model.triples, ids, _triples(kinds, model.classes, ids))
        inside = np.arange(ids.shape[1])[None, :] < lengths[:, None]
        open_ = (((scores[:, :, others].max(2) + gain) >= scores[:, :, o]) & inside).any(1)
        which = at + np.flatnonzero(open_)
        at = end
        if not len(which):
            continue
        scores, lengths = scores[open_], lengths[open_]
        b, t, n = scores.shape
        best = scores[:, 0] + model.start
        back = np.zeros((b, t, n), dtype=np.int8)
        rows = np.arange(b)
        for k in range(1, t):
            step = best[:, None, :] + turned[None]
            came = step.argmax(2)
            back[:, k] = came
            new = np.take_along_axis(step, came[:, :, None], 2)[:, :, 0] + scores[:, k]
            best = np.where((k < lengths)[:, None], new, best)
        path = np.zeros((b, t), dtype=np.int64)
        now = best.argmax(1)
        for k in range(t - 1, -1, -1):
            path[:, k] = now
            now = np.where(k < lengths, back[rows, k, now], now) if k else now
        for j in range(b):
            labels = path[j, : lengths[j]]
            if (labels != o).any():
                out[filled[which[j]]] = labels
    return out
