"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are runs of four character classes (letters by case, digits, white space, each ASCII sign by itself),
hashed byte trigrams, and marks for words that repeat one of the last few words or stand in a line seen before.
Term counts, damped by the logarithm and weighted by inverse document frequency, are projected on the first singular
vectors of the labelled sample.  The sample's vectors are broadcast (their number is a parameter); every document is
compared with all of them by blocked cosine products, and the nearest ones vote with weights that grow with
their similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .common import row_map
from .sampling import both_classes, fitted, sample_table

CUT = 0.7
CLASS_TERMS, GRAM_TERMS, REPEAT_TERMS = 4096, 4096, 16
TERMS = CLASS_TERMS + GRAM_TERMS + REPEAT_TERMS
_MULTIPLIER = np.uint32(2654435761)


def _classes() -> np.ndarray:
    """Character class by byte: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 non-ASCII, then signs."""
    out = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 6
        elif c.isalnum():
            out[b] = 3 if c.isdigit() else 1 if c.islower() else 2
        elif c in " \t":
            out[b] = 4
        elif c in "\r\n":
            out[b] = 5
        elif 0x20 < b < 0x7F:
            out[b] = b
    return out


CLASSES = _classes()


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    return (codes * _MULTIPLIER) >> np.uint32(32 - n.bit_length() + 1)


def repeats(data: bytes) -> list[float]:
    """Shares of words equal to the last one, and to one of the four before that, of lines seen before, and of words seen before."""
    words = data.split()
    same = sum(map(bytes.__eq__, words, words[1:]))
    near = sum(sum(map(bytes.__eq__, words, words[k:])) for k in range(2, 6))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    return [same / n_words, near / n_words, (len(lines) - len(set(lines))) / n_lines, (len(words) - len(set(words))) / n_words]


def terms(text: str | None) -> np.ndarray:
    """Damped term counts of a whole text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    out = np.zeros(TERMS, dtype=np.float32)
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) >= 4:
        c = CLASSES[raw]
        runs = c[np.concatenate([[True], (c[1:] != c[:-1])])]  # one of each run
        if len(runs) >= 4:
            out[:CLASS_TERMS] = np.bincount(hashed(runs[:-3] | (runs[1:-2] << 7) | (runs[2:-1] << 14) | (runs[3:] << 21), CLASS_TERMS), minlength=CLASS_TERMS)
        x = raw.astype(np.uint32)
        out[CLASS_TERMS : CLASS_TERMS + GRAM_TERMS] = np.bincount(hashed(x[:-2] | (x[1:-1] << 8) | (x[2:] << 16), GRAM_TERMS), minlength=GRAM_TERMS)
    out = np.log1p(out)
    size = np.linalg.norm(out) or 1.0
    for k, share in enumerate(repeats(data)):
        out[CLASS_TERMS + GRAM_TERMS + k] = share * size
    return out


class Space:
    """Inverse document frequencies, singular vectors, and the sample's projected vectors with their labels."""

    def __init__(self, sample: list[tuple[str, int]], counts: dict[int, int], dims: int, neighbours: int, seed: int = 3):
        matrix = np.stack([terms(t) for t, _ in sample]) if sample else np.zeros((0, TERMS), np.float32)
        self.labels = np.array([label for _, label in sample], dtype=np.float32)
        self.neighbours = neighbours
        n = len(sample)
        self.idf = np.log((n + 1) / ((matrix > 0).sum(0) + 1)).astype(np.float32) + 1
        self.idf[CLASS_TERMS + GRAM_TERMS :] = 4.0
        matrix *= self.idf
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        dims = min(dims, n)
        random = np.random.default_rng(seed)
        if dims:  # randomised singular value decomposition with two power rounds
            q = np.linalg.qr(matrix @ random.normal(size=(TERMS, dims + 8)).astype(np.float32))[0]
            for _ in range(2):
                q = np.linalg.qr(matrix @ (matrix.T @ q))[0]
            self.axes = np.linalg.svd(q.T @ matrix, full_matrices=False)[2][:dims].T.astype(np.float32).copy()
        else:
            self.axes = np.zeros((TERMS, 0), np.float32)
        self.vectors = self.unit(matrix @ self.axes)
        share = [counts.get(k, 0) / max(1, (self.labels == k).sum()) for k in (0, 1)]
        self.weights = np.where(self.labels == 1, share[1], share[0]).astype(np.float32)  # a sampled row stands for so many

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list, block: int = 512) -> list[float]:
        out: list[float] = []
        if not len(self.labels):
            return [1.0] * len(texts)
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(texts), block):
            own = np.stack([terms(t) for t in texts[i : i + block]])
            similar = self.unit((own * self.idf) @ self.axes) @ self.vectors.T
            near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
            vote = np.exp(20 * (np.take_along_axis(similar, near, 1) - 1)) * self.weights[near]
            out += ((vote * self.labels[near]).sum(1) / np.maximum(vote.sum(1), 1e-30)).clip(0, 1).tolist()
        return [float(x) for x in out]


def space_for(docs: DataFrame, labels: DataFrame, allowed: Column, *, per_class: int = 2000, most_chars: int = 60_000_000, dims: int = 48, neighbours: int = 15) -> Space:
    """From at most per_class labelled documents a class, in one task; labels has doc_id and label.  The driver gets the vectors only."""
    sample, counts = sample_table(docs, labels, allowed, per_class, most_chars)

    def fit(pairs):
        both_classes(pairs, counts)
        return Space(pairs, counts, dims, neighbours)

    return fitted(sample, fit)


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """All columns of docs, then score and predicted (1 if score is at least CUT).

    The score depends on the text alone and is the labelled neighbours' weighted share of label 1, classes weighted as
    often as they are among all labelled rows.  Null and empty texts have the zero vector, to which all neighbours are
    equally near.  Ties among equally near neighbours are broken by the sample's fixed order, so equal texts get equal
    scores.  Without labelled rows every score is 1.  An empty table gives an empty result, and the two new columns
    replace columns of the same name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def score(texts):
        found = sent.value.scores(texts)
        return [found, [int(x >= CUT) for x in found]]

    return row_map(docs, {"score": "double", "predicted": "int"}, score, "text")
