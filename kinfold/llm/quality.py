"""Document quality by a small convolutional network over bytes, in numpy.

Every text is cut into overlapping chunks of bytes (width 16, step 8, the last chunks
padded with zero bytes, so all bytes are covered). A learned embedding maps each byte to
a few numbers, learned filters respond to each chunk, the strongest response of each
filter over the whole document is kept, and a logistic layer combines them into one
probability. Gradients flow through the chunk that gave each maximum.

Edge cases: a null or empty text has no quality and scores 0, with any network; long texts are covered whole; extra columns are ignored; repeated rows get
equal scores; an empty table gives an empty result; without labels the score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import shared
from .textbytes import slices


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 2500  #: labelled documents used for fitting
    width: int = 16
    step: int = 8
    dims: int = 6  #: numbers per byte
    filters: int = 20
    epochs: int = 8
    batch: int = 32
    rate: float = 4e-3
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Network:
    embed: np.ndarray  #: 256 x dims
    conv: np.ndarray  #: width * dims x filters
    shift: np.ndarray  #: filters
    head: np.ndarray  #: filters
    bias: float
    settings: Settings


def chunked(texts, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts as rows of bytes, and the first chunk of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    made = np.maximum(1, -(-np.maximum(lens - s.width, 0) // s.step) + 1)
    room = (made - 1) * s.step + s.width
    buf = np.frombuffer(b"".join(x + bytes(int(r) - len(x)) for x, r in zip(raw, room)), np.uint8)
    first = np.cumsum(made) - made
    start = np.arange(made.sum()) * s.step + np.repeat((np.cumsum(room) - room) - first * s.step, made)
    return np.lib.stride_tricks.sliding_window_view(buf, s.width)[start], first


def _responses(chunks: np.ndarray, net: Network) -> np.ndarray:
    return net.embed[chunks].reshape(len(chunks), -1) @ net.conv + net.shift


def _pooled(chunks: np.ndarray, first: np.ndarray, net: Network, block: int = 1 << 16) -> np.ndarray:
    """The largest response of each filter in each text; chunks are taken in blocks to bound memory."""
    if len(chunks) <= block:
        return np.maximum.reduceat(_responses(chunks, net), first, axis=0)
    out = np.full((len(first), net.conv.shape[1]), -np.inf, np.float32)
    for lo in range(0, len(chunks), block):
        hi = min(len(chunks), lo + block)
        a = np.searchsorted(first, lo, side="right") - 1
        b = np.searchsorted(first, hi, side="left")
        part = np.maximum.reduceat(_responses(chunks[lo:hi], net), np.maximum(first[a:b], lo) - lo, axis=0)
        np.maximum(out[a:b], part, out=out[a:b])
    return out


def probabilities(texts, net: Network) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi in slices(texts, 1 << 20):
        pooled = np.tanh(_pooled(*chunked(texts[lo:hi], net.settings), net))
        out[lo:hi] = 1 / (1 + np.exp(-(pooled @ net.head + net.bias).astype(float)))
    out[[not t for t in texts]] = 0.0
    return out


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Network:
    """Adam on the log loss; each text is used whole."""
    rng = np.random.default_rng(s.seed)
    embed = rng.normal(0, 0.3, (256, s.dims))
    for j, group in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 13, 32), range(128, 256))):
        embed[list(group), j % s.dims] += 1.0
    params = [embed, rng.normal(0, (s.width * s.dims) ** -0.5, (s.width * s.dims, s.filters)), np.zeros(s.filters), np.zeros(s.filters), np.zeros(1)]
    params[3] = rng.normal(0, 0.3, s.filters)
    params = [p.astype(np.float32) for p in params]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y, order, step = np.asarray(labels, np.float32), np.argsort([len(t) for t in texts], kind="stable"), 0
    batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]  # of like length, dealt in random order
    for _ in range(s.epochs):
        for k in rng.permutation(len(batches)):
            own = batches[k]
            net = Network(*params[:4], params[4][0], s)
            chunks, first = chunked([texts[i] for i in own], s)
            r = _responses(chunks, net)
            top = np.maximum.reduceat(r, first, axis=0)
            doc = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(chunks))))
            where = np.empty(top.shape, np.int64)
            for j in range(s.filters):
                hit = np.flatnonzero(r[:, j] == top[doc, j])
                where[doc[hit[::-1]], j] = hit[::-1]  # the first chunk among ties
            act = np.tanh(top)
            p = 1 / (1 + np.exp(-(act @ params[3] + params[4])))
            d = (p - y[own]) / len(own)
            d_top = d[:, None] * params[3] * (1 - act * act)
            used = chunks[where]  # texts x filters x width
            e = params[0][used].reshape(len(own), s.filters, -1)
            g_conv = np.einsum("tf,tfd->df", d_top, e)
            back = (d_top[:, :, None] * params[1].T[None]).reshape(-1, s.dims)
            g_embed = np.stack([np.bincount(used.ravel(), weights=back[:, j], minlength=256) for j in range(s.dims)], 1)
            grads = [g_embed, g_conv, d_top.sum(0), act.T @ d, d.sum(keepdims=True)]
            step += 1
            for q, g, m, v in zip(params, grads, first_moment, second_moment):
                g = g + s.decay * q
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Network(*params[:4], float(params[4][0]), s)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """A network for ``labels.quality`` from a bounded sample outside the held-out fold (crc32 mod 4 = 2)."""
    texts, y = shared.labelled_sample(docs, labels, "quality", settings.sample_rows, 4, 2)
    if not texts:
        zero = Network(np.zeros((256, settings.dims), np.float32), np.zeros((settings.width * settings.dims, settings.filters), np.float32), np.zeros(settings.filters, np.float32), np.zeros(settings.filters, np.float32), 0.0, settings)
        return zero
    return fit(texts, y, settings)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every text."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few kilobytes

    def make(texts):
        import pyarrow as pa

        return [pa.array(probabilities(texts, held.value))]

    return shared.map_texts(docs, make, "score double")
