"""Toxicity by a convolutional text classifier, trained in numpy.

Words are embedded by two hashed tables side by side, so that two words are mistaken for each other only if both hashes
agree.  Filters of several widths slide over the words; each filter's maximum over the text goes to a logistic layer.
The first embedding dimension starts as the smoothed log-odds of its bucket, the rest at random; then all parts are
trained together by Adam.  On a part of the sample that training has not seen, a threshold per language (guessed from
the words of the text alone) is chosen, and scores are shifted so that 0.7 is that threshold.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_map
from .sampling import both_classes, fitted, sample_table

#: Letters a-z, digits and all non-ASCII bytes are parts of words; A-Z counts as a-z.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Frequent words that tell languages apart.
MARKERS = {
    "en": b"the of and to in is that for with was it".split(),
    "de": "der die und das von den ist nicht mit ein".encode().split(),
    "fr": "le les et des du une pour dans qui sur".encode().split(),
    "es": "el los las que y del por con para una".encode().split(),
}
LANGUAGES = (*MARKERS, "other")
HASH_BITS, DIM, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
CUT, SHRINK = 0.7, 30
_LANGUAGE = {w: k for k, ws in enumerate(MARKERS.values()) for w in ws}
_PAD = len(WIDTHS)


def word_hashes(text: str | None) -> tuple[np.ndarray, int]:
    """(64-bit hashes of a text's words, the language whose markers are most frequent)."""
    found = text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    votes = [0] * (len(LANGUAGES) - 1)
    for w in filter(_LANGUAGE.__contains__, found):
        votes[_LANGUAGE[w]] += 1
    best = max(votes, default=0)
    return hashes, votes.index(best) if best else len(LANGUAGES) - 1


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the two tables; row 0 is padding."""
    mask = np.uint64((1 << HASH_BITS) - 1)
    return ((hashes & mask) + np.uint64(1)).astype(np.int64), (((hashes >> np.uint64(32)) & mask) + np.uint64(1)).astype(np.int64)


class Network:
    """Two embedding tables, a filter bank a width, biases and a logistic layer."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        rows = (1 << HASH_BITS) + 1
        self.tables = [random.normal(0, 0.05, (rows, DIM)).astype(np.float32) for _ in range(2)]
        for t in self.tables:
            t[0] = 0
            t[1:, 0] = 0
        self.filters = [random.normal(0, 0.1, (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] += 0.6 / len(f)
            f[:, DIM, :] += 0.6 / len(f)
        self.bias = np.full(len(WIDTHS) * FILTERS, -1.0, dtype=np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, dtype=np.float32)
        self.offset = np.float32(-2.0)
        self.thresholds = np.zeros(len(LANGUAGES))

    def embedded(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[0][a], self.tables[1][b]], axis=1)

    def pooled(self, texts: list[np.ndarray], train: bool = False):
        """Each filter's maximum over each text, and with train the place of it and the embedded words."""
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + _PAD
        ends = np.cumsum(lengths)
        starts = ends - lengths
        a, b = np.zeros(ends[-1] + _PAD, dtype=np.int64), np.zeros(ends[-1] + _PAD, dtype=np.int64)
        for t, s in zip(texts, starts, strict=True):
            a[s : s + len(t)], b[s : s + len(t)] = buckets(t)
        e = self.embedded(a, b)
        top, place = [], []
        for f in self.filters:
            w = len(f)
            y = sum(e[k : len(e) - w + 1 + k] @ f[k] for k in range(w))
            for k in range(1, w):  # windows that would reach into the next text
                y[ends - k] = -np.inf
            if train:
                place.append([s + y[s:t].argmax(0) for s, t in zip(starts, ends, strict=True)])
                top.append(np.array([y[p, range(FILTERS)] for p in place[-1]]))
            else:
                top.append(np.maximum.reduceat(y, starts, axis=0))
        z = np.concatenate(top, axis=1) + self.bias
        return (z, place, e, a, b) if train else z

    def logits(self, texts: list[np.ndarray], most_words: int = 100_000) -> np.ndarray:
        """One number a text; texts are embedded in portions of about most_words."""
        out, part, size = [], [], 0
        for k, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size > most_words or k == len(texts) - 1:
                out.append(np.maximum(self.pooled(part), 0) @ self.out + self.offset)
                part, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def step(self, texts: list[np.ndarray], y: np.ndarray, rate: float, state: dict) -> None:
        """One step of Adam on the logistic loss of a batch; embeddings get plain steps where a maximum lies."""
        z, place, e, a, b = self.pooled(texts, train=True)
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ self.out + self.offset)))
        d = ((p - y) / len(y)).astype(np.float32)
        dz = np.outer(d, self.out) * (z > 0)
        grads = {"out": h.T @ d, "bias": dz.sum(0), "offset": d.sum()}
        for k, f in enumerate(self.filters):
            dy = dz[:, k * FILTERS : (k + 1) * FILTERS]
            at = np.array(place[k])
            g = np.zeros_like(f)
            for w in range(len(f)):
                g[w] = np.einsum("tfd,tf->df", e[at + w], dy)
                back = dy[:, :, None] * f[w].T[None]
                for table, rows, part in ((self.tables[0], a, back[..., :DIM]), (self.tables[1], b, back[..., DIM:])):
                    hit = rows[at + w]
                    np.subtract.at(table, hit.ravel(), 4 * rate * part.reshape(-1, DIM))
                    table[0] = 0
            grads[f"filter{k}"] = g
        state["t"] = state.get("t", 0) + 1
        for name, g in grads.items():
            m, v = state.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = (m, v)
            change = rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)
            if name.startswith("filter"):
                self.filters[int(name[6:])] -= change.astype(np.float32)
            else:
                setattr(self, name, (getattr(self, name) - change).astype(np.float32))

    def start_from_odds(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """First dimension: log-odds of the bucket's presence in a text, shrunk for rare buckets."""
        for which, table in enumerate(self.tables):
            counts = np.zeros((2, len(table)))
            for t, label in zip(texts, y, strict=True):
                counts[int(label), np.unique(buckets(t)[which])] += 1
            rate = (counts + 0.5) / (np.array([[max(1, (y == 0).sum())], [max(1, (y == 1).sum())]]) + 1)
            weight = counts.sum(0) / (counts.sum(0) + 4)
            table[:, 0] = (np.log(rate[1] / rate[0]) * weight).clip(-4, 4)
            table[0] = 0


def trained(sample: list[tuple[str, int]], counts: dict[int, int], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network | None:
    """A network from (text, label) pairs; None if a class is missing.

    A language's threshold is shrunk towards the common one by the rows of its rarer class: with SHRINK of them, half.
    """
    if not both_classes(sample, counts):
        return None
    found = [word_hashes(text) for text, _ in sample]
    texts, languages = [h for h, _ in found], np.array([k for _, k in found])
    y = np.array([label for _, label in sample])
    random = np.random.default_rng(seed)
    fold = np.arange(len(y)) % 4 == 3  # for the thresholds
    learn = np.flatnonzero(~fold)
    network, state = Network(seed), {}
    half = random.permutation(learn)  # the odds come from one part of the texts, so that training sees honest ones
    network.start_from_odds([texts[i] for i in half[: 2 * len(half) // 3]], y[half[: 2 * len(half) // 3]])
    for epoch in range(epochs):
        order = random.permutation(learn)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            network.step([texts[k] for k in own], y[own], rate * 0.7**epoch, state)
    held = np.flatnonzero(fold)
    z = network.logits([texts[k] for k in held])
    common = threshold(z, y[held], counts)
    for k in range(len(LANGUAGES)):
        own = languages[held] == k
        n = min((y[held][own] == 1).sum(), (y[held][own] == 0).sum())
        network.thresholds[k] = (n * threshold(z[own], y[held][own], counts) + SHRINK * common) / (n + SHRINK)
    return network


def threshold(z: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> float:
    """The logit between the classes with the least weighted errors; a false alarm weighs as often as class 0 is."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    weight = np.where(y == 1, counts.get(1, 1) / max(1, (y == 1).sum()), counts.get(0, 1) / max(1, (y == 0).sum()))
    missed = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))])
    false = np.concatenate([[0], np.cumsum(np.where(y == 0, weight, 0))])
    cost = missed + false[-1] - false
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = best[len(best) // 2]
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]]) if len(z) else np.zeros(2)
    return float((edges[at] + edges[at + 1]) / 2)


def text_scores(network: Network | None, texts: list) -> list[float]:
    if network is None or not texts:
        return [0.0] * len(texts)
    shift = np.log(CUT / (1 - CUT))
    found = [word_hashes(t) for t in texts]
    z = network.logits([h for h, _ in found]) - network.thresholds[[k for _, k in found]]
    return (1 / (1 + np.exp(-np.clip(z + shift, -30, 30)))).tolist()


def network_for(docs: DataFrame, labels: DataFrame, allowed: Column, *, per_class: int = 4000, most_chars: int = 60_000_000) -> Network | None:
    """Trained in one task, on at most per_class documents a class; labels has doc_id and label."""
    sample, counts = sample_table(docs, labels, allowed, per_class, most_chars)
    return fitted(sample, lambda pairs: trained(pairs, counts))


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of docs, then score and predicted (1 if score is at least CUT).

    The score depends on the text alone.  Null and empty texts have no word and get the score of that; without a
    network (no labels of both classes) every score is 0.  Repeated rows get equal scores, an empty table gives an
    empty result, and the two new columns replace columns of the same name.  The network's size is fixed: two tables
    of 2^18 rows of 8 numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def score(texts):
        found = text_scores(sent.value, texts)
        return [found, [int(x >= CUT) for x in found]]

    return row_map(docs, {"score": "double", "predicted": "int"}, score, "text")


def without_toxic(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows and columns of docs that are not predicted toxic."""
    return scored(docs, network).where(F.col("predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
