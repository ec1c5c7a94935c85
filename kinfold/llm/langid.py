"""Language identification with language-bitmask n-gram filters.

One table of 2**bits masks stands for one Bloom filter per language, bit-sliced: bit l of
a mask belongs to language l. An n-gram is hashed to ``probes`` places; the AND of their
masks is the set of languages that contain it. A document counts, for each language, the
n-grams whose set has that bit. A filter whose share f of places is set answers yes by
mistake at the rate f ** probes, so the count c of n grams is corrected to
(c - n * rate) / (1 - rate); the largest corrected share wins, ties to the smaller name.

An n-gram enters a language's filter when its frequency there is at least ``share`` of
its frequency in the language that has it most, so shared n-grams keep all their
languages and stray foreign passages do not.

Edge cases: text that is null or has no letter is ``und`` with score 0; rows without lang
or text teach nothing; with nothing learned everything is ``und``; extra columns are
ignored; any number of languages works (masks take as many 64-bit words as needed).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbytes import mix, pack, slices

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(97, 123)) + list(range(128, 256))] = True


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 1200  #: training documents of each language
    bits: int = 20
    probes: int = 2
    share: float = 0.25
    at_least: int = 3  #: occurrences in training


@dataclass(frozen=True)
class Filters:
    names: tuple[str, ...]
    masks: np.ndarray  #: uint64, 2**bits x words
    rates: np.ndarray  #: false-positive rate of each language
    settings: Settings


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """All windows of four bytes over letters and single blanks, packed in 32 bits, with their text.

    Text is lower-cased; each run of other characters counts as one blank; a window has a
    blank only at its ends, so it is a piece of one word with its borders.
    """
    buf, starts = pack([" " + (t or "") for t in texts])
    letter = _LETTERS[buf]
    keep = letter.copy()
    keep[starts] = True
    keep[1:] |= letter[:-1]  # the first byte after a run of letters stands for the blank
    at = np.flatnonzero(keep)
    b = np.where(letter[at], buf[at], 32).astype(np.uint32)
    doc = np.searchsorted(starts, at, side="right") - 1
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    fine = (doc[:-3] == doc[3:]) & (b[1:-2] != 32) & (b[2:-1] != 32)
    return g[fine], doc[:-3][fine]


def _places(g: np.ndarray, s: Settings) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(1))
    return [(mix(h + np.uint64(977 * j)) >> np.uint64(64 - s.bits)).astype(np.int64) for j in range(s.probes)]


def fit(texts: list[str], langs: list[str], s: Settings = Settings()) -> Filters:
    names = tuple(sorted(set(langs)))
    words = max(1, -(-len(names) // 64))
    masks = np.zeros((1 << s.bits, words), np.uint64)
    seen = []
    for name in names:
        own = [t for t, x in zip(texts, langs) if x == name]
        parts = [np.unique(grams(own[lo:hi])[0], return_counts=True) for lo, hi in slices(own)]
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys))
        seen.append((keys, count, max(1.0, count.sum())))
    every = np.unique(np.concatenate([k for k, _, _ in seen])) if seen else np.zeros(0, np.uint32)
    best = np.zeros(len(every))
    for keys, count, total in seen:
        at = np.searchsorted(every, keys)
        best[at] = np.maximum(best[at], count / total)
    filled = []
    for l, (keys, count, total) in enumerate(seen):
        good = keys[(count >= s.at_least) & (count / total >= s.share * best[np.searchsorted(every, keys)])]
        bit = np.uint64(1 << (l % 64))
        for place in _places(good, s):
            masks[place, l // 64] |= bit
        filled.append(float(((masks[:, l // 64] & bit) != 0).mean()))
    return Filters(names, masks, np.asarray(filled) ** s.probes, s)


def predict(texts, f: Filters) -> tuple[list[str], np.ndarray]:
    out, score = [], np.zeros(len(texts))
    for lo, hi in slices(texts):
        g, doc = grams(texts[lo:hi])
        n = np.bincount(doc, minlength=hi - lo).astype(float)
        first, *more = _places(g, f.settings)
        hit = f.masks[first]
        for place in more:
            hit &= f.masks[place]
        counts = np.zeros((hi - lo, len(f.names)))
        for l in range(len(f.names)):
            yes = ((hit[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)).astype(np.float64)
            counts[:, l] = np.bincount(doc, weights=yes, minlength=hi - lo)
        real = np.clip((counts - n[:, None] * f.rates) / np.maximum(1 - f.rates, 1e-9), 0, None)
        for i in range(hi - lo):
            t = texts[lo + i]
            if t is None or not f.names or not _LETTER.search(t):
                out.append("und")
                continue
            best = int(np.argmax(real[i]))
            out.append(f.names[best])
            score[lo + i] = min(1.0, real[i, best] / n[i]) if n[i] else 0.0
    return out, score


def train(docs: DataFrame, settings: Settings = Settings(), parts: int = 3, part: int = 1) -> Filters:
    """Filters from about ``rows_per_language`` documents of each language outside the held-out fold.

    The rate of each language is set from its row count, so the sample is bounded by the
    number of languages and rare languages are used whole, but for texts beyond
    ``shared.SAMPLE_TEXT_BYTES``.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & shared.learnable(F.col("text")) & ~shared.held_out(F.col("doc_id"), parts, part))
    counts = {r["lang"]: r["count"] for r in known.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return fit([], [], settings)
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, settings.rows_per_language / n))])
    rows = known.where(shared.unit(F.col("doc_id"), F.lit("lang")) < rates[F.col("lang")]).select("doc_id", "text", "lang").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "text"], kind="stable")
    return fit(rows["text"].tolist(), rows["lang"].tolist(), settings)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 8 * 2**bits bytes for up to 64 languages

    def make(texts):
        import pyarrow as pa

        names, p = predict(texts, held.value)
        return [pa.array(names, pa.string()), pa.array(p)]

    return shared.map_texts(docs, make, "lang_pred string; score double")
