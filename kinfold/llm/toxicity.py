"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of
hashed features of its words (the word and its first 3 to 7 bytes); the document's is
the noisy-or of its sentences. Only document labels are needed: the gradient of the
noisy-or puts the blame on the sentences that explain a positive label, and those are
what :func:`score` points at afterwards.

Edge cases: a null or empty text has no sentence and scores 0; a text is scored whole
however long; columns of the input beyond the id and text are ignored, so clashing names
do no harm; repeated rows are scored alike; an empty table gives an empty result; with no
positive training label every score is the model's prior, near 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import shared
from .textbytes import ALPHANUMERIC, Spans, mix, pack, slices, words

#: Bytes that end a sentence.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of training."""

    sample_rows: int = 4000  #: labelled documents used for fitting
    bits: int = 18  #: log2 of the weight table's length
    epochs: int = 80
    rate: float = 0.15
    min_docs: int = 10  #: a feature must occur in so many training documents
    min_z: float = 3.5  #: and in so many standard deviations more toxic ones than chance has
    decay: float = 2e-5
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: float32, 2**bits
    bias: float
    settings: Settings


def featurise(texts, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots (words x features), each word's sentence, each sentence's text and byte range."""
    buf, starts = pack(texts)
    ws, we, wd = words(buf, starts, ALPHANUMERIC)
    before = np.cumsum(_ENDS[buf])
    raw = before[ws]  # a sentence is known by how many ends stand before it; every text ends with one
    new = np.diff(raw, prepend=-1) != 0
    sentence = np.cumsum(new) - 1
    spans = Spans(buf)
    slots = np.empty((len(ws), 1 + len(s.prefixes)), np.int32)
    shift = np.uint64(64 - s.bits)
    slots[:, 0] = spans.hash(ws, we) >> shift
    for j, n in enumerate(s.prefixes, 1):
        slots[:, j] = mix(spans.hash(ws, np.minimum(we, ws + n)) + np.uint64(n)) >> shift
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ws)) - 1
    span = np.stack([ws[first] - starts[wd[first]], we[last] - starts[wd[first]]], 1) if len(first) else np.zeros((0, 2), np.int64)
    return slots, sentence, wd[first], span, starts


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Weights that maximise the likelihood of the documents' labels under the noisy-or."""
    size = 1 << s.bits
    if not texts:
        return Model(np.zeros(size, np.float32), -8.0, s)
    y, n_docs = np.asarray(labels, float), len(texts)
    parts, owners, base = [], [], 0
    often, toxic = np.zeros(size, np.int64), np.zeros(size)
    for lo, hi in slices(texts, 1 << 19):  # small slices: the driver's memory is the limit
        slots, sentence, owner, _, _ = featurise(texts[lo:hi], s)
        # A feature's document count, from its distinct (document, slot) pairs; texts are whole in a slice.
        pairs = np.unique((owner[sentence].astype(np.int64)[:, None] * size + slots).ravel())
        often += np.bincount(pairs % size, minlength=size)
        toxic += np.bincount(pairs % size, weights=y[lo + pairs // size], minlength=size)
        parts.append((slots, (sentence + base).astype(np.int32)))
        owners.append(owner + lo)
        base += len(owner)
    p = y.mean()
    z = (toxic - often * p) / np.sqrt(np.maximum(often * p * (1 - p), 1e-9))
    kept = np.flatnonzero((often >= s.min_docs) & (z >= s.min_z))
    to = np.full(size, -1, np.int32)
    to[kept] = np.arange(len(kept))
    f, who = [], []
    while parts:
        slots, sentence = parts.pop()
        own = to[slots]
        word, column = np.nonzero(own >= 0)
        f.append(own[word, column])
        who.append(sentence[word])
    f, who, owner = np.concatenate(f), np.concatenate(who), np.concatenate(owners)
    n_sent = len(owner)
    w, b = np.zeros(len(kept)), -6.0
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, s.epochs + 1):
        z = b + np.bincount(who, weights=w[f], minlength=n_sent)
        a = np.bincount(owner, weights=_softplus(z), minlength=n_docs)  # -log(1 - P)
        none = np.exp(-a)
        da = np.where(y > 0, -none / np.maximum(1 - none, 1e-6), 1.0) / n_docs
        dz = da[owner] * _sigmoid(z)
        g, gb = np.bincount(f, weights=dz[who], minlength=len(kept)) + s.decay * w, dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= s.rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= s.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    out = np.zeros(size, np.float32)
    out[kept] = w
    return Model(out, float(b), s)


def probabilities(texts, model: Model) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each text's probability, and the probability and byte range of its sentences."""
    n, doc, per, span = len(texts), np.zeros(len(texts)), [], []
    for lo, hi in slices(texts):
        slots, sentence, owner, ranges, _ = featurise(texts[lo:hi], model.settings)
        word = model.weights[slots].sum(1)
        z = model.bias + np.bincount(sentence, weights=word, minlength=len(owner))
        a = np.bincount(owner, weights=_softplus(z), minlength=hi - lo)
        doc[lo:hi] = 1 - np.exp(-a)
        cuts = np.searchsorted(owner, np.arange(1, hi - lo))
        per += np.split(_sigmoid(z), cuts)
        span += np.split(ranges, cuts)
    assert len(per) == n or not n
    return doc, per, span


def score(docs: DataFrame, model: Model, sentence_at: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and offending: the sentences whose own probability reaches ``sentence_at``.

    ``offending`` holds structs (start, end, score); start and end are byte offsets in the
    lower-cased UTF-8 text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes

    def make(texts):
        import pyarrow as pa

        p, per, span = probabilities(texts, held.value)
        bad = [[{"start": int(r[i, 0]), "end": int(r[i, 1]), "score": float(q[i])} for i in np.flatnonzero(q >= sentence_at)] for q, r in zip(per, span)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return [pa.array(p), pa.array([len(q) for q in per], pa.int32()), pa.array(bad, kind)]

    return shared.map_texts(docs, make, "score double; n_sentences int; offending array<struct<start:int,end:int,score:double>>")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of ``labels.toxic`` from a bounded sample outside the held-out fold (crc32 mod 4 = 2)."""
    return fit(*shared.labelled_sample(docs, labels, "toxic", settings.sample_rows, 4, 2), settings)


def reject(docs: DataFrame, labels: DataFrame, at_least: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The documents whose score stays below ``at_least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))

    return shared.keep_texts(docs, lambda texts: probabilities(texts, held.value)[0] < at_least)
