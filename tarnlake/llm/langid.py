"""Language of a text by a byte convolutional network: filters of several widths, max pooling and softmax.

Texts are cut into windows of a fixed number of bytes that cover all of them; the windows' log-probabilities, weighted
by length, make the document's. Training is numpy on a bounded sample. For use, embedding and filters are folded into
tables over byte pairs, so a window costs two look-ups for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import LOWER, flat, pieces, tidy
from tarnlake.llm.store import fresh

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
UNKNOWN = "und"
#: Windows that go through the network at once.
_AT_ONCE = 128


def windows(data: np.ndarray, edges: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in lower case as rows (short texts filled up with 0; the last window of a longer text ends where the text ends),
    the text each belongs to, and the number of bytes that no window before it has covered."""
    length = np.diff(edges)
    per = -(-length // size)
    row = np.repeat(np.arange(len(length)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * size, np.maximum(length[row] - size, 0))
    own = np.minimum(length[row] - k * size, size)
    at = edges[row][:, None] + start[:, None] + np.arange(size)
    out = np.zeros((len(row), size), np.uint8)
    inside = start[:, None] + np.arange(size) < length[row][:, None]
    out[inside] = LOWER[data[at[inside]]]
    far = (out[:, :-1] == 0xC3) & (out[:, 1:] >= 0x80) & (out[:, 1:] <= 0x9E)
    out[:, 1:][far] += 0x20  # capitals of Latin-1
    return out, row, own


@dataclass
class LangModel:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * EMBED, FILTERS) each
    offsets: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        n = FILTERS
        one = [[self.embed @ f[i * EMBED : (i + 1) * EMBED] for i in range(len(f) // EMBED)] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, n)
        none = np.zeros((256, n))
        w2, w3, w4 = one
        self.here = np.concatenate([pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(w4[0], w4[1])], 1).astype(np.float32)
        self.there = np.concatenate([pair(w3[2], none), pair(w4[2], w4[3])], 1).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("here", "there")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each window, by the folded tables."""
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(x), _AT_ONCE):
            part = x[a : a + _AT_ONCE].astype(np.int64)
            pairs = part[:, :-1] << 8 | part[:, 1:]
            v = self.here[pairs]
            v[:, :-1, FILTERS:] += self.there[np.concatenate([pairs[:, 2:], part[:, -1:] << 8], 1)]
            for k in range(len(WIDTHS)):  # a wider filter has fewer places
                on = slice(k * FILTERS, (k + 1) * FILTERS)
                out[a : a + _AT_ONCE, on] = v[:, : v.shape[1] - k, on].max(1)
        return np.maximum(out + self.offsets, 0)

    def predict(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest label of each text, and its probability."""
        x, row, own = windows(data, edges)
        z = self.pooled(x) @ self.dense + self.bias
        z = z - z.max(1, keepdims=True)
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        total = np.maximum(np.bincount(row, own, len(edges) - 1), 1)
        mean = np.stack([np.bincount(row, own * z[:, c], len(edges) - 1) / total for c in range(z.shape[1])], 1)
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit_languages(texts: list[str | None], langs: list[str], most: int = 12_000, rounds: int = 5, seed: int = 7) -> LangModel | None:
    """Trains on at most `most` windows, the same number of each text before any text gives another. None without labels."""
    labels = sorted(set(langs))
    if not labels:
        return None
    data, edges = flat(pa.array(texts, pa.string()))
    x, row, _ = windows(data, edges)
    order = np.lexsort((row, np.arange(len(row)) - np.searchsorted(row, row)))[:most]
    x, y = x[order], np.array([labels.index(v) for v in langs], np.int64)[row[order]]
    rng = np.random.default_rng(seed)
    n, c = len(WIDTHS) * FILTERS, len(labels)
    w = [rng.normal(0, 0.5, (256, EMBED)), *(rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)) for k in WIDTHS), np.zeros(n), rng.normal(0, n**-0.5, (n, c)), np.zeros(c)]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(rounds):
        mix = rng.permutation(len(x))
        for a in range(0, len(mix), 64):
            on = mix[a : a + 64]
            b, t = x[on], y[on]
            m = len(on)
            e = w[0][b]
            pool, where, taken = [], [], []
            for k, f in zip(WIDTHS, w[1:4], strict=True):
                cols = np.concatenate([e[:, i : WINDOW - k + 1 + i] for i in range(k)], 2)
                v = cols @ f
                best = v.argmax(1)
                where.append(best)
                pool.append(np.take_along_axis(v, best[:, None], 1)[:, 0])
                taken.append(cols[np.arange(m)[:, None], best])  # (m, FILTERS, k * EMBED)
            raw = np.concatenate(pool, 1) + w[4]
            h = np.maximum(raw, 0)
            z = h @ w[5] + w[6]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(m), t] -= 1
            p /= m
            dh = (p @ w[5].T) * (raw > 0)
            grads = [np.zeros_like(w[0])]
            for j, (k, f) in enumerate(zip(WIDTHS, w[1:4], strict=True)):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                grads.append(np.einsum("mf,mfk->kf", d, taken[j]))
                back = (d[:, :, None] * f.T[None]).reshape(m, FILTERS, k, EMBED)
                seen = b[np.arange(m)[:, None, None], where[j][:, :, None] + np.arange(k)]
                np.add.at(grads[0], seen.ravel(), back.reshape(-1, EMBED))
            grads += [dh.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - 0.01 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return LangModel(labels, w[0], list(w[1:4]), w[4].astype(np.float32), w[5], w[6])


def language_sample(docs: DataFrame, allowed: Column, most: int, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list, list]:
    """Texts and languages of at most `most` rows that `allowed` lets through; rows without text, id or language don't count."""
    named = docs.where(allowed & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    few = named.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(most).distinct()  # ids first: texts of the sample only come to the driver
    rows = named.join(F.broadcast(few), "_key").orderBy(F.xxhash64("_key"), "_key", F.xxhash64("_text"), "_lang").limit(most).collect()
    return [r["_text"] for r in rows], [r["_lang"] for r in rows]


def predict_languages(docs: DataFrame, model: LangModel | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the likeliest language and its probability to every row.

    Texts that are null or have no letter are `und` with score 0, and so is every text where nothing could be learned.
    Repeated rows get equal values, an empty table gives an empty one, and columns named like the new ones are replaced.
    """
    (work,) = fresh(docs, "tl_text")
    out = docs.drop(lang, score).withColumn(work, F.col(text))
    schema = out.drop(work).schema.add(lang, "string").add(score, "double")
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for piece in pieces(batch, work):
                data, edges = flat(piece.column(at))
                some = np.concatenate([[0], np.cumsum(letters[data])])[edges]
                has = np.diff(some) > 0
                for k in np.flatnonzero(~has & (np.diff(edges) > 0)):
                    has[k] = any(map(str.isalpha, str(data[edges[k] : edges[k + 1]], "utf-8")))
                best, p = model.predict(data, edges) if model else (np.zeros(len(has), int), np.zeros(len(has)))
                names = np.array([*model.labels, UNKNOWN] if model else [UNKNOWN], object)
                columns = [c for i, c in enumerate(piece.columns) if i != at]
                columns += [pa.array(names[np.where(has, best, len(names) - 1)], pa.string()), pa.array(np.where(has, p, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return out.mapInArrow(tidy(run), schema)
