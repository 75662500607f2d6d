"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training documents, whatever their
labels, is unlabelled. The risk is prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with
logistic loss, and where the second part is negative the step goes against it (Kiryo and others,
2017). The class prior is the toxic share of the labelled training rows. Features are the distinct
words of the whole text and their beginnings of four to six bytes.

The fit uses bounded samples: `positives` confirmed rows and `unlabelled` rows, the first in the
order of a hash of doc_id. Scores are made for every document.

Defined results: null and empty texts get the score of no features; a table without toxic training
labels gives score 0 everywhere; repeated rows get equal scores; only doc_id and text of a
document are read, and doc_id is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.model import Adam, held_out, rows_of, sample_ids, sigmoid
from quillsieve.llm.phrases import mix, word_bounds, word_hashes
from quillsieve.llm.shared import small_batches
from quillsieve.llm.textstats import blocks, buffer_of

#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a space.
_WORD = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], dtype=np.uint8)
DIMENSIONS = 1 << 22
#: Bytes of the beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) in order: the distinct hashed features of each text; of the useful ones only, where told."""
    data = _WORD[data]
    starts, ends = word_bounds(data, offsets)
    texts, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(starts):
        text = np.searchsorted(offsets, starts, side="right") - 1
        for n in (0, *BEGINNINGS):
            at = np.flatnonzero(ends - starts > n)
            hashes = word_hashes(data, starts[at], starts[at] + n if n else ends[at])
            feature = (mix(hashes + np.uint64(n)) % np.uint64(DIMENSIONS)).astype(np.int64)
            if useful is not None:
                some = np.flatnonzero(useful[feature])
                at, feature = at[some], feature[some]
            texts.append(text[at])
            found.append(feature)
    both = np.unique(np.concatenate(texts) * DIMENSIONS + np.concatenate(found))
    return both // DIMENSIONS, both % DIMENSIONS


@dataclass
class ToxicityModel:
    """Weights by hashed feature, a bias; without weights and bias the score is 0."""

    weights: dict[int, float]
    bias: float | None

    def __post_init__(self) -> None:
        self.names = np.array(sorted(self.weights), dtype=np.int64)
        self.values = np.array([self.weights[k] for k in self.names.tolist()], dtype=np.float64)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of binary texts, a block at a time."""
        out = np.zeros(len(texts))
        if self.bias is None:
            return out
        useful = np.zeros(DIMENSIONS, dtype=bool)
        useful[self.names] = True
        for at, n in blocks(texts, 1 << 19):
            text, feature = features(*buffer_of(texts.slice(at, n)), useful)
            weight = self.values[np.searchsorted(self.names, feature)]
            out[at : at + n] = sigmoid(np.bincount(text, weights=weight, minlength=n) + self.bias)
        return out


def _feature_rows(rows: DataFrame) -> Iterator[np.ndarray]:
    """The distinct features of each of a bounded set of rows, one after another."""

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(1), 1 << 19):
                text, feature = features(*buffer_of(batch.column(1).slice(at, n)))
                ends = np.searchsorted(text, np.arange(n + 1))
                found = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(found, type=pa.binary())], names=["doc_id", "f"])

    for r in rows.mapInArrow(run, "doc_id long, f binary").sort("doc_id", "f").toLocalIterator():
        yield np.frombuffer(r.f, dtype=np.int32)


def nnpu(pos: list[np.ndarray], unl: Iterable[np.ndarray], prior: float, least: int = 8, apart: float = 2.5, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> tuple[dict[int, float], float | None]:
    """Weights of features and the bias, by non-negative PU risk.

    Features take part that at least `least` positives have, and more of them by `apart` standard deviations than
    chance gives at the feature's rate in the unlabelled rows: few positives tell few features from noise.
    """
    counts = np.zeros(DIMENSIONS, dtype=np.int32)
    for row in pos:
        counts[row] += 1  # features of a row are distinct
    chosen = np.flatnonzero(counts >= min(least, max(1, len(pos) // 4)))
    place = np.full(DIMENSIONS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def matrix(rows):
        columns = [x[x >= 0] for x in (place[r] for r in rows)]
        return np.concatenate([*columns, np.zeros(0, dtype=np.int32)]), np.repeat(np.arange(len(columns)), [len(c) for c in columns]), len(columns)

    (pc, pr, n_pos), (uc, ur, n_unl) = matrix(pos), matrix(unl)
    if not n_unl:
        return {}, None
    share = (np.bincount(uc, minlength=len(chosen)) + 0.5) / (n_unl + 1)
    telling = counts[chosen] - n_pos * share >= apart * np.sqrt(n_pos * share * (1 - share))
    again = np.cumsum(telling) - 1
    (pc, pr), (uc, ur) = ((again[c[telling[c]]], r[telling[c]]) for c, r in ((pc, pr), (uc, ur)))
    chosen, n = chosen[telling], int(telling.sum())
    w, adam = np.zeros(n + 1), Adam(n + 1, rate)
    w[n] = np.log(prior / (1 - prior))

    def back(columns, rows, g):
        return np.concatenate([np.bincount(columns, weights=g[rows], minlength=n), [g.sum()]])

    for _ in range(steps):
        sp = np.bincount(pr, weights=w[pc], minlength=n_pos) + w[n]
        su = np.bincount(ur, weights=w[uc], minlength=n_unl) + w[n]
        # logistic loss: l(+) = log(1 + e^-s), l(-) = log(1 + e^s)
        g_plus = -(1 - sigmoid(sp)) / n_pos
        g_p_minus, g_u_minus = sigmoid(sp) / n_pos, sigmoid(su) / n_unl
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        grad_negative = back(uc, ur, g_u_minus) - prior * back(pc, pr, g_p_minus)
        grad = prior * back(pc, pr, g_plus) + grad_negative if negative >= 0 else -grad_negative
        grad[:n] += decay * w[:n]
        adam.step(w, grad)
    keep = np.abs(w[:n]) > 1e-4
    return dict(zip(chosen[keep].tolist(), w[:n][keep].tolist(), strict=True)), float(w[n])


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12_000, seed: int = 5) -> ToxicityModel:
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out() & F.col("toxic").isNotNull())
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    if not counts.n or not counts.toxic:
        return ToxicityModel({}, None)
    prior = min(0.95, counts.toxic / counts.n)
    pos = list(_feature_rows(rows_of(docs, sample_ids(train.filter("toxic = 1"), positives, seed))))
    unl = _feature_rows(rows_of(docs, sample_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out()), unlabelled, seed + 1)))
    if not pos:
        return ToxicityModel({}, None)
    return ToxicityModel(*nnpu(pos, unl, prior))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all their columns, whose whole text scores below 0.5."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).cast(pa.binary())) < 0.5))

    return docs.mapInArrow(run, docs.schema)
