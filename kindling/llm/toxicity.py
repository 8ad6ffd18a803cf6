"""Toxicity: a linear-chain conditional random field tags toxic words; forward-backward marginals
give a document's score and the offending offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import HashTable, blocks, in_fold, labelled_sample, mixed, span_hashes, word_spans

#: Labelled documents of each class that the model is fitted on at most, and their characters; chosen by a hash of the id.
TRAIN_DOCS, TRAIN_CHARS = 1000, 5_000_000
#: Score from which a document is rejected; marginal from which a word is part of a span.
THRESHOLD, SPAN_MARGINAL = 0.3, 0.5
#: A feature is a cue if its occurrences (so many of a document count at most) lean to toxic documents by this log-likelihood
#: ratio and this lift, and so many toxic documents hold it; cues kept at most.
BURST, MIN_RATIO, MIN_LIFT, MIN_HOLDERS, MAX_CUES = 3, 18.0, 5.0, 3, 4096
#: Or if the documents in which it is at least this share of the words lean to toxic, by a ratio that grows with the logarithm of the sample.
DENSE = 0.01
#: Words that the fit takes through the chain at once; its arrays are a few hundred bytes a word.
RUN_WORDS = 20_000
#: Characters of word prefixes that are features besides the word.
PREFIXES = (4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = np.random.default_rng(1).integers(1, 1 << 63, len(PREFIXES) + 1, dtype=np.uint64)


def token_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features: a hash per word and kind, bytes, starts, ends, first word per text, first byte per text)."""
    data, starts, ends, first, begin = word_spans([t.encode("utf-8", "surrogatepass") for t in texts])
    low = _LOWER[data]
    # Capital Latin letters with marks (U+00C0 to U+00DE) are two bytes, of which the second differs by a bit.
    marked = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[marked] |= 0x20
    kinds = [span_hashes(low, starts, ends)] + [span_hashes(low, starts, np.minimum(starts + n, ends)) for n in PREFIXES]
    return np.stack([mixed(h ^ s) for h, s in zip(kinds, _SALTS)]), data, starts, ends, first, begin


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices along the last axis, each brought to sum 1: only ratios matter."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.sum(axis=0)


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Running products of the 2x2 matrices ``m`` (4, n): rows of about sqrt(n) at once, then the rows' totals."""
    n = m.shape[1]
    if n <= 1:
        return m
    width = int(np.ceil(np.sqrt(n)))
    height = -(-n // width)
    grid = np.empty((4, height * width))
    grid[:, :n] = m
    grid[:, n:] = np.array([0.5, 0.0, 0.0, 0.5])[:, None]
    grid = np.ascontiguousarray(grid.reshape(4, height, width).transpose(2, 0, 1))
    for j in range(1, width):
        grid[j] = _times(grid[j - 1], grid[j])
    if height > 1:
        totals = prefix_products(grid[-1].copy())
        flat = grid[:, :, 1:].transpose(1, 0, 2).reshape(4, -1)
        left = np.broadcast_to(totals[:, None, :-1], (4, width, height - 1)).reshape(4, -1)
        grid[:, :, 1:] = _times(left, flat).reshape(4, width, height - 1).transpose(1, 0, 2)
    return grid.transpose(1, 2, 0).reshape(4, -1)[:, :n]


def forward_backward(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of a two-state chain over texts laid end to end.

    ``score``: log potential of state 1 against state 0 per word; ``transition``: log potentials (2, 2);
    ``first``: first word of each text. Returns (P(state 1) per word, P(pair of states) between
    a word and the one before as (4, n), zero at first words). A text's first step forgets what is before it.
    """
    n = len(score)
    if n == 0:
        return np.zeros(0), np.zeros((4, 0))
    one = np.exp(np.clip(score, -30, 30))
    t = np.exp(transition)
    step = np.stack([np.full(n, t[0, 0]), t[0, 1] * one, np.full(n, t[1, 0]), t[1, 1] * one])
    heads = np.unique(first[:-1][first[:-1] < first[1:]])
    step[:, heads] = np.stack([np.ones(len(heads)), one[heads]] * 2)
    alpha = prefix_products(step / step.sum(axis=0))[:2]
    alpha = alpha / alpha.sum(axis=0)
    # Messages from the right: suffix products, as prefix products of the transposes in reverse.
    ahead = np.empty_like(step)
    ahead[:, :-1] = step[:, 1:]
    ends = np.append(heads[1:], n) - 1
    ahead[:, ends] = 1.0
    back = prefix_products((ahead[[0, 2, 1, 3]] / ahead.sum(axis=0))[:, ::-1])[:, ::-1]
    beta = np.stack([back[0] + back[2], back[1] + back[3]])
    both = alpha * beta
    gamma = both[1] / both.sum(axis=0)
    pair = np.zeros((4, n))
    if n > 1:
        x = np.stack([alpha[i, :-1] * step[2 * i + j, 1:] * beta[j, 1:] for i in (0, 1) for j in (0, 1)])
        pair[:, 1:] = x / x.sum(axis=0)
        pair[:, heads] = 0.0
    return gamma, pair


def _chain(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`forward_backward` a run of texts at a time: (marginals, expected pairs of states in all)."""
    gamma, pairs = np.empty(len(score)), np.zeros(4)
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + RUN_WORDS, side="right")) - 1)
        a, b = first[lo], first[hi]
        gamma[a:b], pair = forward_backward(score[a:b], first[lo : hi + 1] - a, transition)
        pairs += pair.sum(axis=1)
        lo = hi
    return gamma, pairs


@dataclass
class Model:
    """Cues (feature hashes and weights), bias, transitions, and the logistic over a document's marginals."""

    cues: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    document: np.ndarray
    prior: float

    def words(self, texts: list[str]):
        """(marginal of each word, token features' arrays)."""
        features, *at = token_features(texts)
        score = np.full(features.shape[1], self.bias)
        if not hasattr(self, "_table"):
            self._table = HashTable(self.cues)
        for kind in features:
            place, number = self._table.find(kind)
            np.add.at(score, place, self.weights[number])
        return forward_backward(score, at[3], self.transition)[0], at

    def measures(self, gamma: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text: 1, log of the expected toxic words, largest marginal, log of their share."""
        sums = np.concatenate([[0.0], np.cumsum(np.where(gamma < 0.01, 0.0, gamma))])
        n = np.diff(first)
        total = sums[first[1:]] - sums[first[:-1]]
        most = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            most[full] = np.maximum.reduceat(gamma, first[:-1][full])
        return np.stack([np.ones(len(n)), np.log1p(total), most, np.log1p(1000 * total / np.maximum(n, 1))], axis=1)

    def score(self, texts: list[str], spans: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score, toxic spans in code points) of each text; a text without words has the score of no toxic word."""
        gamma, (data, starts, ends, first, begin) = self.words(texts)
        score = 1 / (1 + np.exp(-np.clip(self.measures(gamma, first) @ self.document, -30, 30)))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        hot = np.flatnonzero(gamma >= SPAN_MARGINAL)
        if spans and len(hot):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            owner = np.searchsorted(first, hot, side="right") - 1
            s, e = points[starts[hot]] - points[begin[owner]], points[ends[hot]] - points[begin[owner]]
            last = -2
            for i, (d, a, b) in enumerate(zip(owner.tolist(), s.tolist(), e.tolist())):
                if hot[i] == last + 1 and out[d]:
                    out[d][-1] = (out[d][-1][0], b)
                else:
                    out[d].append((a, b))
                last = hot[i]
        return score, out


def _distinct(texts: list[str], labels: np.ndarray) -> list[int]:
    """Texts of which no earlier one of the class is a near copy: those that share none of their four least word-triple hashes."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        h = token_features([text])[0][0]
        least = np.sort(mixed(h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7)))[:4] if len(h) > 2 else h[:1]
        marks = {(int(labels[i]), int(x)) for x in least}
        if not marks & seen:
            keep.append(i)
        seen |= marks
    return keep


def fit(texts: list[str], labels: np.ndarray, shares: tuple[float, float] | None = None, rounds: int = 30) -> Model:
    """Fit on whole texts with 0/1 labels. ``shares``: how common the classes are where these were drawn from.

    Words of toxic documents with a cue are labelled toxic, all others not; the chain's weights
    are then fitted on these labelled words by gradient steps on its log-likelihood.
    """
    keep = _distinct(texts, labels)
    texts, labels = [texts[i] for i in keep], labels[keep]
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    prior = shares[1] if shares else (n1 / len(labels) if len(labels) else 0.0)
    empty = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -6.0, np.zeros((2, 2)), np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6)), 0, 0, 0]), prior)
    if not n1 or not n0:
        return empty
    features, first = [], [0]
    for start in range(0, len(texts), 200):
        f, *_, at, _ = token_features(texts[start : start + 200])
        features.append(f)
        first.extend((at[1:] + first[-1]).tolist())
    features, first = np.concatenate(features, axis=1), np.array(first)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    # How often toxic and clean documents hold each feature, a document at most BURST times; and how many have it often for their length.
    found, n_words = [], np.diff(first)
    for kind in features:
        h, number = np.unique(kind, return_inverse=True)
        pairs, times = np.unique(number.astype(np.int64) * len(texts) + owner, return_counts=True)
        number, held_by = pairs // len(texts), pairs % len(texts)
        toxic, dense = labels[held_by], (times >= BURST) & (times >= DENSE * n_words[held_by])
        times = np.minimum(times, BURST)
        found.append((h, *(np.bincount(number, x, len(h)) for x in (toxic * times, (1 - toxic) * times, toxic, toxic * dense, (1 - toxic) * dense))))
    h, *counts = (np.concatenate(x) for x in zip(*found))
    p = n1 / (n1 + n0)

    def leaning(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood ratio of a and b against the classes' shares, whether that and the lift are large enough)."""
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda x, q: np.where(x > 0, x * np.log(x / ((a + b) * q)), 0.0)
            ratio = 2 * (part(a, p) + part(b, 1 - p))
        return ratio, (ratio >= least) & ((a / n1) / ((b + 0.5) / n0) >= MIN_LIFT)

    ratio, often = leaning(counts[0], counts[1], MIN_RATIO)
    dense_ratio, thick = leaning(counts[3], counts[4], 1 + 2 * np.log(n1))
    good = np.flatnonzero((often & (counts[2] >= MIN_HOLDERS)) | (thick & (counts[3] >= 2)))
    good = good[np.argsort(-np.maximum(ratio, dense_ratio)[good], kind="stable")][:MAX_CUES]
    if not len(good):
        return empty
    cues = h[good]
    table = HashTable(cues)
    hits = [table.find(kind) for kind in features]
    target = np.zeros(len(owner), dtype=bool)
    for place, _ in hits:
        target[place] = True
    target &= labels[owner] == 1
    place = np.concatenate([x for x, _ in hits])
    number = np.concatenate([x for _, x in hits])
    weights, bias, transition = np.zeros(len(cues)), -4.0, np.zeros((2, 2))
    model = Model(cues, weights, bias, transition, np.zeros(4), prior)
    heads = first[:-1]
    y = target.astype(float)
    seen = np.stack([(1 - y[:-1]) * (1 - y[1:]), (1 - y[:-1]) * y[1:], y[:-1] * (1 - y[1:]), y[:-1] * y[1:]])
    inside = np.ones(len(y), dtype=bool)
    inside[heads[heads < len(y)]] = False
    seen_pairs = (seen * inside[1:]).sum(axis=1)
    pull, squares = 1e-3, np.full(len(cues) + 5, 1e-8)
    for _ in range(rounds):
        score = np.full(len(y), model.bias)
        np.add.at(score, place, model.weights[number])
        gamma, pairs = _chain(score, first, model.transition)
        error = y - gamma
        gradient = np.concatenate([np.bincount(number, error[place], len(cues)), [error.sum()], seen_pairs - pairs])
        now = np.concatenate([model.weights, [model.bias], model.transition.ravel()])
        gradient = gradient / np.sqrt(len(texts)) - pull * now
        squares += gradient**2
        now = now + 1.0 * gradient / np.sqrt(squares)
        model.weights, model.bias, model.transition = now[: len(cues)], float(now[len(cues)]), now[len(cues) + 1 :].reshape(2, 2)
    # Logistic over the marginals' measures, documents weighted to the classes' true shares.
    score = np.full(len(y), model.bias)
    np.add.at(score, place, model.weights[number])
    x = model.measures(_chain(score, first, model.transition)[0], first)
    w = np.where(labels == 1, prior / n1, (1 - prior) / n0) * len(labels)
    theta = np.zeros(4)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (w * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05, 0.05]) * len(labels) ** 0.5
        theta = theta + np.linalg.solve(hessian, x.T @ (w * (labels - q)) - np.array([1e-3, 0.05, 0.05, 0.05]) * len(labels) ** 0.5 * theta)
    model.document = theta
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents of each class, drawn by a hash of the id, from
    those not held out, and TRAIN_CHARS characters (documents that do not fit are passed over, never cut). Several labels of one id: the largest;
    null labels and ids are left out. Without both classes the model scores every text alike, with the share of toxic labels.
    """
    texts, ys, shares = labelled_sample(docs, labels, ~in_fold("id", 4, 2), key, text, label, train_docs, TRAIN_CHARS)
    return fit(texts, ys, shares)


RESULT = "struct<score:double,spans:array<struct<start:long,end:long>>>"


def _scorer(sent: Broadcast):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for array in arrays:
            scores, spans = [], []
            for _, texts in blocks(array):
                s, x = model.score(texts)
                scores.extend(s.tolist())
                spans.extend([{"start": a, "end": b} for a, b in y] for y in x)
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["score", "spans"])

    return run


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column``: struct of score (0 to 1) and spans (start, end in code points, end exclusive).

    Whole texts are read. Null and empty texts get the score of a text without toxic words and no spans.
    Repeated rows score alike; an empty table gives no rows; a column named as ``column`` is replaced. Documents do not move
    between tasks; the model that tasks are sent has at most MAX_CUES weights.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(column, F.arrow_udf(_scorer(sent), RESULT).asNondeterministic()(F.col(text).cast("string")))
