"""Quality by Bradley-Terry pairwise ranking.

A document's score is a linear function of features of its whole text. All preference pairs (a document
of quality 1 over one of quality 0) of all labelled training rows fit it by logistic loss on the
difference of scores. The score quantile at the share of low-quality training rows becomes the threshold 0.3.

The loss over all pairs depends on the scores alone: a pass over the rows sums, for each class, the rows and their features by
score, in bins of STEP; the driver gets those few sums and has loss and gradient over all pairs. The quantile is counted in bins that
are refined three times. The features of every document are stored once, for the fit and the scores.

Defined results: null and empty texts have all-zero features and a score like any; without both
classes among the training labels every score is 0.5; repeated rows get equal scores; columns
other than doc_id and text are not read, and doc_id is no input of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.model import held_out, sigmoid
from quillsieve.llm.shared import materialize, small_batches, small_side
from quillsieve.llm.textstats import SPACE, blocks, buffer_of, per_text, word_starts

THRESHOLD = 0.3
#: Width of a bin of scores, and the scores beyond which there are no further bins.
STEP, REACH = 0.1, 30.0


def _class(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_UPPER, _LOWER, _DIGIT, _HIGH = _class(range(0x41, 0x5B)), _class(range(0x61, 0x7B)), _class(range(0x30, 0x3A)), _class(range(0x80, 0x100))
_SINGLE = b"!|%$&*#@?.,;:-_=+<>/\\\"'()[]{}~^`"
_PUNCT = _class(_SINGLE)
_VOWEL = _class(b"aeiouyAEIOUY")


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: shares of byte classes, word and line shapes, repetition, length."""
    data, offsets = buffer_of(texts)
    n = np.maximum(1, np.diff(offsets)).astype(np.float64)
    starts = word_starts(data, offsets)
    words = per_text(starts, offsets).astype(np.float64)
    w = np.maximum(1, words)
    visible = np.maximum(1, per_text(~SPACE[data], offsets))
    newline = data == 10
    lines = per_text(newline, offsets) + 1.0
    columns = [per_text(c[data], offsets) / visible for c in (_UPPER, _LOWER, _DIGIT, _HIGH, _PUNCT, _VOWEL)]
    columns += [per_text(data == c, offsets) / visible for c in _SINGLE]
    repeat = np.zeros(len(data), dtype=bool)  # a byte like the one before it
    if len(data):
        repeat[1:] = (data[1:] == data[:-1]) & ~SPACE[data[1:]]
    single = np.zeros(len(data), dtype=bool)  # words of one byte
    if len(data):
        single[:-1] = starts[:-1] & SPACE[data[1:]]
    columns += [per_text(repeat, offsets) / visible, per_text(single, offsets) / w, visible / w / 10.0]
    columns += [per_text(starts & _UPPER[data], offsets) / w, per_text(starts & _PUNCT[data], offsets) / w, np.log1p(w / lines), np.log1p(words), lines / w]
    raw = data.tobytes()
    kinds = []
    for k in range(len(offsets) - 1):
        text = raw[offsets[k] : offsets[k + 1]]
        found, rows = text.split(), text.split(b"\n")
        kinds.append((len(set(found)) / max(1, len(found)) * min(1.0, math.sqrt(len(found)) / 10), 1 - len(set(rows)) / len(rows)))
    kinds = np.array(kinds, dtype=np.float64).reshape(-1, 2)
    columns += [kinds[:, 0], kinds[:, 1], (n <= 1).astype(np.float64)]
    x = np.stack(columns, axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


@dataclass
class QualityModel:
    mean: np.ndarray | None
    weights: np.ndarray | None
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return sigmoid((x - self.mean) @ self.weights + self.shift)


def pair_loss(counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss over all pairs, and its derivatives, by the counts of (bad, good) rows at each score of the grid."""
    bad, good = counts / counts.sum(axis=1, keepdims=True)
    at = np.arange(counts.shape[1]) * STEP
    apart = at[:, None] - at[None, :]  # of a good row's score from a bad one's
    wrong = sigmoid(-apart)
    return float(good @ np.logaddexp(0, -apart) @ bad), np.stack([good @ wrong, -(wrong @ bad)])


def bradley_terry(table: DataFrame, decay: float = 1e-4, steps: int = 40) -> QualityModel:
    """table: quality, x (feature bytes). Fit on all pairs of a row of quality 1 and one of 0."""
    columns = table.select("quality", "x")

    def rows(batch):
        quality = batch.column(0).to_numpy()
        return quality, np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(len(quality), -1).astype(np.float64)

    def moments(batches):
        n, mean, spread = 0, 0.0, 0.0
        for batch in batches:
            x = rows(batch)[1]
            if len(x):
                m, apart = x.mean(axis=0), x.mean(axis=0) - mean
                spread = spread + ((x - m) ** 2).sum(axis=0) + apart**2 * (n * len(x) / (n + len(x)))
                mean, n = mean + apart * (len(x) / (n + len(x))), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([spread.tobytes()])], names=["n", "mean", "spread"])

    n, mean, spread = 0, 0.0, 0.0
    # One row of each task; in the order of their bytes, so that reruns agree.
    for r in sorted(columns.mapInArrow(moments, "n long, mean binary, spread binary").collect(), key=lambda r: (r.n, bytes(r.mean))):
        m, v = np.frombuffer(r.mean), np.frombuffer(r.spread)
        apart = m - mean
        spread = spread + v + apart**2 * (n * r.n / (n + r.n))
        mean, n = mean + apart * (r.n / (n + r.n)), n + r.n
    scale = np.sqrt(spread / n)
    inverse = np.where(scale > 1e-9, 1 / np.where(scale > 1e-9, scale, 1), 0.0)
    size, last = len(mean), int(2 * REACH / STEP)

    def value(w):
        """Loss and gradient at w."""

        def run(batches):
            sums = np.zeros((2, last + 1, size + 1))
            for batch in batches:
                quality, x = rows(batch)
                x = (x - mean) * inverse
                at = np.clip((x @ w + REACH) / STEP, 0, last)
                low = np.minimum(at.astype(np.int64), last - 1)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                # A row between two scores of the grid counts at both, by nearness.
                np.add.at(sums, (quality, low), x * (low + 1 - at)[:, None])
                np.add.at(sums, (quality, low + 1), x * (at - low)[:, None])
            side, place = np.nonzero(sums[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(place), pa.array([r.tobytes() for r in sums[side, place]], type=pa.binary())], names=["side", "place", "sums"])

        total = np.zeros((2, last + 1, size + 1))
        for r in sorted(columns.mapInArrow(run, "side long, place long, sums binary").collect(), key=lambda r: (r.side, r.place, bytes(r.sums))):
            total[r.side, r.place] += np.frombuffer(r.sums)
        loss, (of_bad, of_good) = pair_loss(total[:, :, 0])
        each = total[:, :, 0].sum(axis=1)
        gradient = of_bad @ total[0, :, 1:] / each[0] + of_good @ total[1, :, 1:] / each[1]
        return loss + decay / 2 * float(w @ w), gradient + decay * w

    # Limited-memory BFGS, with halved steps where the loss does not fall.
    w, past = np.zeros(size), []
    loss, g = value(w)
    for _ in range(steps):
        step, back = g.copy(), []
        for s, y in reversed(past):
            back.append(float(s @ step) / float(s @ y))
            step -= back[-1] * y
        step *= float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, float(np.sqrt(g @ g)))
        for (s, y), was in zip(past, reversed(back), strict=True):
            step += s * (was - float(y @ step) / float(s @ y))
        for _ in range(6):
            new_loss, new_g = value(w - step)
            if new_loss < loss:
                break
            step = step / 3
        else:
            break
        s, y = -step, new_g - g
        if float(s @ y) > 1e-12:
            past = [*past[-9:], (s, y)]
        gain, w, loss, g = loss - new_loss, w - step, new_loss, new_g
        if gain < 1e-4 * loss:
            break
    return QualityModel(mean, w * inverse)


def low_quantile(table: DataFrame, model: QualityModel, low_share: float) -> float:
    """The score below which lies `low_share` of all rows, where the classes weigh (1 - low_share, low_share)."""
    bins, columns = 4000, table.select("quality", "x")

    def counted(low, wide):
        def run(batches):
            counts = np.zeros((2, bins + 2), dtype=np.int64)  # the first and last are what lies outside
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1).astype(np.float64)
                at = np.clip(np.floor(((x - model.mean) @ model.weights - low) / wide), -1, bins).astype(np.int64) + 1
                np.add.at(counts, (batch.column(0).to_numpy(), at), 1)
            side, place = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(place), pa.array(counts[side, place])], names=["side", "place", "n"])

        total = np.zeros((2, bins + 2), dtype=np.int64)
        for r in columns.mapInArrow(run, "side long, place long, n long").groupBy("side", "place").agg(F.sum("n").alias("n")).collect():
            total[r.side, r.place] = r.n
        return total

    low, wide = -1000.0, 0.5
    for _ in range(3):
        counts = counted(low, wide)
        share = np.array([low_share, 1 - low_share]) @ (counts / counts.sum(axis=1, keepdims=True))
        at = min(bins + 1, int(np.searchsorted(np.cumsum(share), low_share - 1e-12)))
        low, wide = low + (max(1, at) - 1) * wide, wide / bins
    return low


def _feature_batches(docs: DataFrame, finish, schema: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(1), 2 << 20):
                yield finish(batch.column(0).slice(at, n), features(batch.column(1).slice(at, n)))

    return docs.mapInArrow(run, schema)


def stored_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features as bytes of floats, of every row."""

    def finish(ids, x):
        return pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x.astype(np.float32)], type=pa.binary())], names=["doc_id", "x"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    return materialize(_feature_batches(plain, finish, "doc_id long, x binary"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs: documents, or their stored_features."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")).filter(~held_out() & F.col("quality").isin(0, 1))
    counts = {r.quality: r["count"] for r in train.groupBy("quality").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return QualityModel(None, None)
    known = docs if "x" in docs.columns else stored_features(docs)
    table = materialize(known.join(small_side(materialize(train.distinct())), "doc_id").select("quality", "x"))
    if table.select("quality").distinct().count() < 2:
        return QualityModel(None, None)
    model = bradley_terry(table)
    cut = low_quantile(table, model, counts[0] / (counts[0] + counts[1]))
    return QualityModel(model.mean, model.weights, math.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) for every row of docs (documents, or their stored_features)."""

    known = docs if "x" in docs.columns else stored_features(docs)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = known.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
