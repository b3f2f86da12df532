"""Toxicity: a linear-chain CRF tags toxic words; forward-backward marginals make offsets and document scores.

Labels come by document, so words are labelled first: in toxic documents, a word is taken as toxic if it, or how it
begins, is far more frequent in toxic documents than in clean ones. The CRF learns from these labelled words. It sees the
tell-tale words and beginnings themselves, the word's shape, whether its neighbours hold such features, and how many
words around it do; so a single word that clean documents use, too, needs others near it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import LOWER, Hasher, flat, flat_pieces, mixed, pieces, runs, tidy
from tarnlake.llm.chain import Chain
from tarnlake.llm.quality import logistic
from tarnlake.llm.store import fresh, kind

#: Lengths in bytes of the word beginnings that are features.
BEGINS = (4, 5, 6, 7)
#: Words to either side that count as around a word.
AROUND = 40
#: A feature tells if its rate in toxic documents is so many times that in clean ones, with a likelihood ratio (G) of at
#: least so much. A document counts for its first few occurrences only.
RATIO, SURE, CAPPED = 5.0, 25.0, 3

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (ASCII ones and all bytes beyond) in lower case: starts, ends, number by text, feature hashes,
    shapes (long, with a letter beyond ASCII, capital first).

    Case is folded for ASCII and for the Latin-1 letters. The hashed features are the whole word and its beginnings.
    """
    low = LOWER[data]
    if len(low) > 1:
        latin = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][latin] += 0x20
    starts, ends, per = runs(_LETTER[low], edges)
    hasher = Hasher(low)
    found = [mixed(hasher(starts, ends) + np.uint64(1))]
    for size in BEGINS:
        found.append(np.where(ends - starts >= size, mixed(hasher(starts, np.minimum(starts + size, ends)) + np.uint64(size)), np.uint64(0)))
    far = np.concatenate([[0], np.cumsum(low >= 128)])
    shapes = np.stack([ends - starts >= 8, far[ends] > far[starts], data[starts] != low[starts]], 1) if len(starts) else np.zeros((0, 3), bool)
    return starts, ends, per, np.stack(found, 1) if len(starts) else np.zeros((0, 1 + len(BEGINS)), np.uint64), shapes


def beginnings(per: np.ndarray) -> np.ndarray:
    """Which words begin a text."""
    first = np.zeros(int(per.sum()), bool)
    first[(np.cumsum(per) - per)[per > 0]] = True
    return first


@dataclass
class ToxicModel:
    """`keys` are the sorted hashes of the features with a weight; a bitmap spares most words the search among them."""

    keys: np.ndarray
    weights: np.ndarray
    around: np.ndarray
    bias: float
    chain: Chain
    final: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words hold features (a word for each feature it holds), and which features they are."""
        h = hashes.ravel()
        hit = np.flatnonzero(self.bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(self.keys):
            return hit[:0], hit[:0]
        at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        real = self.keys[at] == h[hit]
        return hit[real] // max(hashes.shape[1], 1), at[real]

    def context(self, at: np.ndarray, per: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """By word: its shape, whether the words before and after hold a feature, and how many around it do, as a
        logarithm, with and without regard to whether it holds one itself."""
        n = len(shapes)
        keyed = np.zeros(n, bool)
        keyed[at] = True
        end = np.repeat(np.cumsum(per), per)
        begin = end - np.repeat(per, per)
        place = np.arange(n)
        sums = np.concatenate([[0], np.cumsum(keyed)])
        near = sums[np.minimum(place + AROUND + 1, end)] - sums[np.maximum(place - AROUND, begin)] - keyed
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = keyed[:-1], keyed[1:]
        many = np.log1p(near)
        return np.stack([*shapes.T, before & (place > begin), after & (place < end - 1), many, many * keyed], 1).astype(np.float32)

    def emissions(self, hit: np.ndarray, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        return np.bincount(hit, self.weights[at], len(context)) + context @ self.around + self.bias

    def marginals(self, hashes: np.ndarray, per: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        hit, at = self.places(hashes)
        return self.chain.marginals(self.emissions(hit, at, self.context(hit, per, shapes)), beginnings(per))[0]

    def tags(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, number by text, and P(toxic) of each word."""
        starts, ends, per, hashes, shapes = words(data, edges)
        return starts, ends, per, self.marginals(hashes, per, shapes)

    def features(self, per: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By document: the largest marginal, and the logarithm of their sum and of that by 100 words (of a text with 20 more)."""
        row = np.repeat(np.arange(len(per)), per)
        total = np.bincount(row, p, len(per))
        most = np.zeros(len(per))
        some = per > 0
        if len(p):
            most[some] = np.maximum.reduceat(p, (np.cumsum(per) - per)[some])
        return np.stack([most, np.log1p(total), np.log1p(100 * total / (per + 20))], 1)

    def of(self, per: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Scores of documents from the marginals of their words."""
        x = self.features(per, p) @ self.final[:-1] + self.final[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def scores(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.of(*self.tags(data, edges)[2:])


def label_words(row: np.ndarray, hashes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of words, and the features (sorted) that tell toxic documents from clean ones."""
    h, r = hashes.ravel(), np.repeat(row, hashes.shape[1])
    on = h != 0
    h, r = h[on], r[on]
    order = np.lexsort((r, h))
    h, r = h[order], r[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.minimum(np.diff(np.append(head, len(h))), CAPPED)
    keys, at = np.unique(h[head], return_inverse=True)
    is_toxic = toxic[r[head]] > 0
    bad, good = (np.bincount(at[side], times[side], len(keys)) for side in (is_toxic, ~is_toxic))
    docs = np.bincount(at[is_toxic], minlength=len(keys))
    share = max(len(row) and (toxic[row] > 0).mean(), 1e-9)  # of all words
    rate_bad, rate_good = bad / share, (good + 0.3) / max(1 - share, 1e-9)
    all_ = bad + good
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / (all_ * share)), 0) + np.where(good > 0, good * np.log(good / (all_ * (1 - share))), 0))
    keys = keys[(docs >= 3) & (rate_bad >= RATIO * rate_good) & (g >= SURE)]
    if not len(keys):
        return np.zeros(len(row), np.int64), keys
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return ((keys[place] == hashes).any(1) & (toxic[row] > 0)).astype(np.int64), keys


def fit_words(hashes: np.ndarray, per: np.ndarray, shapes: np.ndarray, tags: np.ndarray, keys: np.ndarray, rounds: int = 30) -> ToxicModel:
    """The CRF from labelled words."""
    model = ToxicModel(keys, np.zeros(len(keys)), np.zeros(7), -4.0, Chain(np.zeros((2, 2)), 0.0), np.array([0.0, 0.0, 0.0, -3.0]))
    if not len(tags) or tags.min() == tags.max():
        return model
    hit, at = model.places(hashes)
    context = model.context(hit, per, shapes).astype(float)
    n = len(keys)
    state = {"step": np.full(n + 8, 0.3), "old": np.zeros(n + 8)}

    def update(d: np.ndarray) -> None:
        grad = np.concatenate([np.bincount(at, d[hit], n) - 1e-5 * model.weights, context.T @ d - 1e-5 * model.around, [d.sum()]])
        state["step"] = np.clip(np.where(grad * state["old"] > 0, state["step"] * 1.2, np.where(grad * state["old"] < 0, state["step"] * 0.5, state["step"])), 1e-6, 1.0)
        state["old"] = grad
        change = np.sign(grad) * state["step"]
        model.weights = np.clip(model.weights + change[:n], -10, 10)
        model.around = np.clip(model.around + change[n:-1], -10, 10)
        model.bias = float(np.clip(model.bias + change[-1], -15, 5))

    model.chain.fitted(lambda: model.emissions(hit, at, context), update, tags, beginnings(per), rounds, 0.2)
    return model


def fit_toxicity(texts: list[str | None], labels: list[int], rounds: int = 30) -> ToxicModel:
    """From documents with labels (1: toxic), all of them. Without both labels, all texts get one low score."""
    toxic = np.asarray(labels, np.int64)
    per, hashes, shapes = (np.concatenate(parts) for parts in zip(words(np.zeros(0, np.uint8), np.zeros(1, np.int64))[2:], *(words(*p)[2:] for p in flat_pieces(texts)), strict=True))
    row = np.repeat(np.arange(len(per)), per)
    tags, keys = label_words(row, hashes, toxic)
    model = fit_words(hashes, per, shapes, tags, keys, rounds)
    if len(toxic) and toxic.min() != toxic.max() and len(keys):
        model.final = logistic(model.features(per, model.marginals(hashes, per, shapes)), toxic, l2=1e-5)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", score: str = "score", spans: str | None = None, least: float = 0.5) -> DataFrame:
    """Adds `score` (0 to 1, higher: likelier toxic) to every row and, if named, `spans`: start, end (code points,
    end exclusive) and p of each word whose marginal is `least` or more.

    Null and empty texts have no words: they get the score of a document without toxic words, and no spans. Repeated
    rows score alike; an empty table gives an empty one; columns named like the new ones are replaced.
    """
    (work,) = fresh(docs, "tl_text")
    out = docs.drop(score, *[spans] * bool(spans)).withColumn(work, F.col(text))
    schema = out.drop(work).withColumn(score, F.lit(0.0)).schema
    if spans:
        schema = schema.add(spans, kind("array<struct<start:bigint,end:bigint,p:double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for piece in pieces(batch, work):
                data, edges = flat(piece.column(at))
                starts, ends, per, p = model.tags(data, edges)
                columns = [c for i, c in enumerate(piece.columns) if i != at] + [pa.array(model.of(per, p))]
                if spans:
                    row = np.repeat(np.arange(len(per)), per)
                    on = np.flatnonzero(p >= least)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    base = points[edges[row[on]]]
                    items = pa.StructArray.from_arrays([pa.array(points[starts[on]] - base), pa.array(points[ends[on]] - base), pa.array(p[on])], ["start", "end", "p"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[on], np.arange(len(per) + 1)), pa.int32()), items))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return out.mapInArrow(tidy(run), schema)
