"""What a clause does in an answer - refuse, be polite, or say something - as a small softmax model over its words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import xxhash

from weftline.llm.language import SAMPLES
from weftline.llm.refusal_labels import CLASSES, labelled_clauses

WIDTH = 1 << 16
REFUSAL, COURTESY, OTHER = map(CLASSES.index, ("refusal", "courtesy", "other"))


def features(clause: str) -> np.ndarray:
    """Hashed words, pairs and triples of words, and letter groups within words."""
    words = ["<", *clause.replace("’", "'").split(" "), ">"]
    found = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    found |= {f"#{p[i : i + 4]}" for w in words[1:-1] for p in (f" {w} ",) for i in range(max(len(p) - 3, 1))}
    # pairs with one word between them: "kann ich ... nicht"
    found |= {f"{words[i]} * {words[i + 2]}" for i in range(len(words) - 2)}
    return np.fromiter({xxhash.xxh32_intdigest(f) % WIDTH for f in found}, dtype=np.int64)


def train(examples: Iterable[tuple[str, int]], epochs: int = 6, rate: float = 0.3, decay: float = 2e-4, seed: int = 3) -> np.ndarray:
    """feature x class weights by AdaGrad steps; the last row is the bias. Classes weigh the same however many examples they have.

    The same examples give the same weights.
    """
    data = [(np.append(features(c), WIDTH), y) for c, y in examples]
    counts = np.bincount([y for _, y in data], minlength=len(CLASSES))
    share = len(data) / (len(CLASSES) * np.maximum(counts, 1))
    weights, squares = np.zeros((WIDTH + 1, len(CLASSES))), np.full((WIDTH + 1, len(CLASSES)), 1e-2)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            at, y = data[i]
            z = weights[at].sum(0) / np.sqrt(len(at))
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            gradient = share[y] * p[None, :] / np.sqrt(len(at)) + decay * weights[at]
            squares[at] += gradient * gradient
            weights[at] -= rate * gradient / np.sqrt(squares[at])
    return weights.astype(np.float32)


def labelled() -> list[tuple[str, int]]:
    """The labelled table, and the everyday prose of the language samples as clauses that neither refuse nor are polite."""
    prose = [" ".join(w.lower() for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", s)) for text in SAMPLES.values() for s in re.split(r"[.?!;:,]\s+", text)]
    return [(c, CLASSES.index(k)) for c, k in labelled_clauses()] + [(c, OTHER) for c in prose if " " in c]


@lru_cache(maxsize=1)
def general() -> np.ndarray:
    """The model of the labelled table alone."""
    return train(labelled())


def probabilities(weights: np.ndarray, clauses: Sequence[str]) -> np.ndarray:
    """clause x class probabilities."""
    out = np.zeros((len(clauses), len(CLASSES)))
    for i, c in enumerate(clauses):
        at = np.append(features(c), WIDTH)
        z = weights[at].sum(0) / np.sqrt(len(at))
        e = np.exp(z - z.max())
        out[i] = e / e.sum()
    return out
