"""Document quality: a linear-chain CRF labels each line good or bad; line marginals, weighted by length, make a score.

Features of a line come from its bytes and from the lines before and after it. The model is fitted on a sample of
labelled documents whose number is bounded by `most`; everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import LOWER, WHITE, Hasher, flat, flat_pieces, pieces, runs, tidy
from tarnlake.llm.chain import Chain
from tarnlake.llm.store import fresh

#: Bytes of a line at most; a longer one counts as several, so that the packed counters below can't overflow.
LINE = 1 << 20

_KINDS = ("upper", "lower", "digit", "mark", "bang", "odd", "far")


def _packed() -> tuple[np.ndarray, np.ndarray]:
    """For each byte, counters of 21 bits each: (upper, lower, digit) and (plain marks, exclamations, other symbols)."""
    a, b = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for x in range(128):
        c = chr(x)
        if c.isupper():
            a[x] = 1
        elif c.islower():
            a[x] = 1 << 21
        elif c.isdigit():
            a[x] = 1 << 42
        elif c in ".,;:'\"-?()":
            b[x] = 1
        elif c == "!":
            b[x] = 1 << 21
        elif x > 32:
            b[x] = 1 << 42
    return a, b


_A, _B = _packed()
_FIELD = np.uint64((1 << 21) - 1)


def line_features(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each non-empty line, the lines' lengths in bytes, and the number of lines of each text."""
    starts, ends, per = runs(data != 10, edges)
    if len(starts) and (ends - starts).max() > LINE:
        parts = -(-(ends - starts) // LINE)
        row = np.repeat(np.arange(len(per)), per)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        per = np.bincount(np.repeat(row, parts), minlength=len(per))
        starts, ends = np.repeat(starts, parts) + within * LINE, np.minimum(np.repeat(ends, parts), np.repeat(starts, parts) + (within + 1) * LINE)
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * 11 + 2), np.float32), np.zeros(0), per
    size = (ends - starts).astype(np.float64)
    cuts = np.empty(2 * n, np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    if cuts[-1] == len(data):
        cuts = cuts[:-1]
    a, b = np.add.reduceat(_A[data], cuts)[0::2], np.add.reduceat(_B[data], cuts)[0::2]
    upper, lower, digit = ((a >> np.uint64(s)) & _FIELD for s in (0, 21, 42))
    mark, bang, odd = ((b >> np.uint64(s)) & _FIELD for s in (0, 21, 42))
    word_at, word_end, _ = runs(~WHITE[data], edges)
    line_of = np.searchsorted(starts, word_at, "right") - 1
    words = np.bincount(line_of, minlength=n).astype(float)
    folded = LOWER[data]
    hashes = Hasher(folded)(word_at, word_end)
    same = np.zeros(len(word_at))
    if len(word_at) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    again = np.bincount(line_of, same, minlength=n)
    alone = np.bincount(line_of, (word_end - word_at) <= 1, minlength=n)  # words of one byte
    ends_odd = np.bincount(line_of, (_B[data[word_end - 1]] >> np.uint64(21)) > 0, minlength=n)  # words that end in ! or a symbol
    letters = np.maximum(upper + lower, 1).astype(float)
    w = np.maximum(words, 1)
    x = np.stack([upper / letters, odd / size, bang / size, digit / size, mark / size, again / w, alone / w, ends_odd / w, np.log1p(size) / 8, words / size, np.minimum(size / w, 30) / 30], 1).astype(np.float32)
    first = np.zeros(n, bool)
    at = np.cumsum(per) - per
    first[at[per > 0]] = True
    last = np.append(first[1:], True)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None]], 1).astype(np.float32), size, per


@dataclass
class QualityModel:
    """Weights of the CRF, and of the step from a document's share of good bytes to its score."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    chain: Chain
    slope: float
    shift: float

    def lines(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, its bytes, and lines by document."""
        x, size, per = line_features(data, edges)
        first = np.zeros(len(size), bool)
        first[(np.cumsum(per) - per)[per > 0]] = True
        p, _ = self.chain.marginals(((x - self.mean) / self.scale) @ self.weights + self.bias, first)
        return p, size, per

    def share(self, p: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals; 0.5 for a text without lines."""
        row = np.repeat(np.arange(len(per)), per)
        total = np.bincount(row, size, len(per))
        return np.where(total > 0, np.bincount(row, p * size, len(per)) / np.maximum(total, 1), 0.5)

    def scores(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """By document; 0 where there is nothing but white space."""
        share = self.share(*self.lines(data, edges))
        some = np.diff(np.concatenate([[0], np.cumsum(~WHITE[data])])[edges]) > 0
        return np.where(some, 1 / (1 + np.exp(-np.clip(self.slope * share + self.shift, -30, 30))), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression (the last is the bias) by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) / len(x) - l2 * w)
    return w


def fit_quality(texts: list[str | None], labels: list[int], rounds: int = 120) -> QualityModel:
    """Every line of a labelled document carries the document's label. Without both labels: a model that says 0.5."""
    y = np.asarray(labels, np.int64)
    x, size, per = (np.concatenate(parts) for parts in zip(line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64)), *(line_features(*p) for p in flat_pieces(texts)), strict=True))
    wide = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(wide, np.float32), np.ones(wide, np.float32))
    model = QualityModel(np.zeros(wide), 0.0, mean, scale, Chain(np.zeros((2, 2)), 0.0), 0.0, 0.0)
    if len(x) == 0 or y.min() == y.max():
        return model
    z = ((x - mean) / scale).astype(float)
    first = np.zeros(len(x), bool)
    first[(np.cumsum(per) - per)[per > 0]] = True
    tag = np.repeat(y, per)
    state = {"step": np.full(wide + 1, 0.1), "old": np.zeros(wide + 1)}

    def update(d: np.ndarray) -> None:
        grad = np.append(z.T @ d - 1e-4 * model.weights, d.sum())
        state["step"] = np.clip(np.where(grad * state["old"] > 0, state["step"] * 1.2, np.where(grad * state["old"] < 0, state["step"] * 0.5, state["step"])), 1e-6, 0.5)
        state["old"] = grad
        change = np.sign(grad) * state["step"]
        model.weights = model.weights + change[:-1]
        model.bias += change[-1]

    model.chain.fitted(lambda: z @ model.weights + model.bias, update, tag, first, rounds, 0.1)
    p, _ = model.chain.marginals(z @ model.weights + model.bias, first)
    share = model.share(p, size, per)
    model.slope, model.shift = logistic(share[:, None], y)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, text: str = "text", key: str = "doc_id") -> tuple[list, list]:
    """Texts and labels of at most `most` labelled rows that `allowed` (over the labels' columns) lets through.

    The labels are sampled first, by a hash of their id, so the join broadcasts at most `most` rows. Rows without an
    id or a label are left out; an id that is labelled twice counts once.
    """
    few = labels.where(allowed & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    few = few.orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), "_key").select("_key", "_text", "_label")
    rows = rows.orderBy(F.xxhash64("_key"), "_key", "_text").limit(most).collect()
    return [r["_text"] for r in rows], [r["_label"] for r in rows]


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds `score` (0 to 1, higher: likelier good) to every row.

    Null and empty texts, and those of white space alone, score 0: without content a document isn't good. Repeated rows score alike, for a
    score depends on the text alone. An empty table gives an empty one. A column named like `score` is replaced.
    """
    (work,) = fresh(docs, "tl_text")
    out = docs.drop(score).withColumn(work, F.col(text))
    schema = out.drop(work).withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for piece in pieces(batch, work):
                values = model.scores(*flat(piece.column(at)))
                columns = [c for i, c in enumerate(piece.columns) if i != at] + [pa.array(values, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return out.mapInArrow(tidy(run), schema)


def label_lines(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each non-empty line: key, line (from 0), bytes, p_good.

    Null and empty texts have no rows. Lines longer than LINE count as several. Repeated rows repeat their lines. Only
    `key` and `text` are read, so other columns and their names don't matter.
    """
    schema = docs.select(key).schema.add("line", "long").add("bytes", "long").add("p_good", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "tl_text"):
                p, size, per = model.lines(*flat(piece.column(1)))
                row = np.repeat(np.arange(len(per)), per)
                line = np.arange(len(p)) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(line), pa.array(size.astype(np.int64)), pa.array(p)], names=schema.names)

    return docs.select(key, F.col(text).alias("tl_text")).mapInArrow(tidy(run), schema)
